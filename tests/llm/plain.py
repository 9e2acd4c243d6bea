"""The contracts in plain Python, one text at a time."""

from __future__ import annotations

import hashlib
import re

WORD_BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD_LETTER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(_LOWER)


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def leaks(docs, items, n=10):
    """op2: docs and items are (id, text)."""
    windows = {}
    for item, text in items:
        w = tuple(WORD_LETTER.findall(lower(text)))
        name = "" if item is None else str(item)
        for i in range(max(1, len(w) - n + 1)):
            if w:
                windows.setdefault(w[i:i + n], set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = tuple(WORD_LETTER.findall(lower(text)))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if w[i:i + m] in windows:
                    hit.update(range(i, i + m))
                    found |= windows[w[i:i + m]]
        out.append((doc, len(w), len(hit), len(found), sha(sorted(found)), bool(hit)))
    return out


def quality(text, k=8):
    """op8: the base figures of a text and base_failed."""
    text = text or ""
    w = WORD_BLANK.findall(text)
    seen = {}
    for i in range(len(w) - k + 1):
        seen.setdefault(tuple(w[i:i + k]), []).append(i)
    again = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)}
    lines = [x for x in text.split("\n") if WORD_BLANK.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(again),
            len(w) < 20 or 100 * len(again) > 30 * len(w))


def judged(rows):
    """op8: rows are (text, host); (rate, verdict, kept) of each by the host's beta posterior."""
    found = []
    for text, _ in rows:
        n, chars, symbols, dup, _, failed = quality(text)
        lines = len([x for x in (text or "").split("\n") if WORD_BLANK.search(x)])
        found.append((failed, (5 * symbols > n) + (symbols > n) + (lines >= 4 and 2 * dup > lines)
                      + (chars < 2 * n or chars > 20 * n)))
    hosts = {}
    for (_, host), (failed, soft) in zip(rows, found, strict=True):
        n, bad = hosts.get(host or "", (0, 0))
        hosts[host or ""] = n + 1, bad + (failed or soft > 0)
    docs, bad = len(rows), sum(f for _, f in hosts.values())
    mean = (bad + 0.5) / (docs + 1)
    var_of_one = mean * (1 - mean)
    left = sum(n * (f / n - mean) ** 2 for n, f in hosts.values())
    # The spread about the smoothed mean, as sums of squares: what the shift of the mean adds.
    left += 2 * mean * (bad - docs * mean) - (len(hosts) - 1) * var_of_one
    room = docs - sum(n * n for n, _ in hosts.values()) / docs - (len(hosts) - 1)
    var = max(left, 0) / room if room > 0 else 0
    strength = min(docs, max(1, var_of_one / var - 1 if var > 0 else docs))
    verdicts = {}
    for host, (n, f) in hosts.items():
        rate = (f + mean * strength) / (n + strength)
        off = 1.645 * (rate * (1 - rate) / (n + strength + 1)) ** 0.5
        verdicts[host] = rate, ("bad" if rate - off >= 2 * mean / (1 - mean + 2 * mean) else "good"
                                if rate + off <= mean / 2 / (1 - mean / 2) else "usual")
    out = []
    for (_, host), (failed, soft) in zip(rows, found, strict=True):
        rate, verdict = verdicts[host or ""]
        out.append((rate, verdict, not failed and soft < {"bad": 1, "usual": 2, "good": 3}[verdict]))
    return out


def components(nodes, linked):
    """Smallest reachable id of each node; nodes are (id, set)."""
    up = list(range(len(nodes)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    posts = {}
    for i, (_, s) in enumerate(nodes):
        for x in s:
            posts.setdefault(x, []).append(i)
    for i, (_, s) in enumerate(nodes):
        near = {j for x in s for j in posts[x] if j < i}
        for j in near:
            if top(i) != top(j) and linked(s, nodes[j][1]):
                up[top(i)] = top(j)
    least = {}
    for i, (n, _) in enumerate(nodes):
        if n is not None:
            least[top(i)] = min(least.get(top(i), n), n)
    return [least.get(top(i)) for i in range(len(nodes))]


def shingles(text, k=3):
    w = WORD_BLANK.findall(lower(text))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def near(docs):
    """op1: docs are (id, text)."""
    nodes = [(d, shingles(t)) for d, t in docs]
    comp = components(nodes, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))
    return [(d, len(s), c, d == c) for (d, s), c in zip(nodes, comp, strict=True)]


PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"),
           ("all rights reserved", "reserved"))


def licenses(text, templates, threshold):
    """op7: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    w = WORD_LETTER.findall(lower(text))
    at, base = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        some = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += some
        base |= {label} if some else set()
    labels, best = set(base), 0.0
    for line in (text or "").split("\n"):
        have = set(WORD_LETTER.findall(lower(line)))
        for label, t in templates:
            t = set(t.split())
            share = len(have & t) / len(t)
            if share >= threshold - 1e-12:
                labels.add(label)
                best = max(best, share)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), 1.0 if at else best)


def line_runs(docs):
    """op10: docs are (id, text) in order; texts without the lines that stand in two lines or more
    seen before, line by line."""
    first, out = {}, {}
    for doc, text in docs:
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 1):
            two = (lines[i], lines[i + 1])
            if not "".join(two).strip():
                continue
            if two not in first:
                first[two] = (doc, i)
            else:
                gone |= {i + 1} if first[two] == (doc, i - 1) else {i, i + 1}
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def repeats(docs, n=50):
    """op5: (id, start_word, end_word) of the stretches whose windows of n words occur twice."""
    seen, words = {}, []
    for doc, text in docs:
        w = [x for x in WORD_BLANK.findall(lower(text))]
        words.append(w)
        for i in range(len(w) - n + 1):
            key = hash(tuple(w[i:i + n]))
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        last = None
        for i in range(len(w) - n + 1):
            if seen[hash(tuple(w[i:i + n]))] > 1:
                if last and i <= last[2]:
                    last[2] = i + n
                else:
                    last = [doc, i, i + n]
                    out.append(last)
    return sorted(map(tuple, out))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """op3: n_email, n_ip, n_card, n_phone, base spans."""
    text, spans, n = text or "", [], []
    for order, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD),
                                             ("phone", PHONE))):
        count = 0
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                  or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                  or kind == "phone" and 10 <= len(digits) <= 15)
            if ok:
                count += 1
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
        n.append(count)
    return (*n, sha([x for *_, x in sorted(spans)]))
