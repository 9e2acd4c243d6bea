"""Plain-Python versions of retrieval and feed, for small inputs only."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

TOKEN = re.compile(r"\w\w+")


def grams(text: str, stops) -> list[str]:
    t = [w for w in TOKEN.findall(text.lower()) if w not in stops]
    return t + [f"{a} {b}" for a, b in zip(t, t[1:])]


class Tfidf:
    def __init__(self, docs: dict[int, str], stops=(), min_df=2, max_df=0.95, max_features=5000):
        self.stops = set(stops)
        tf = {i: Counter(grams(t, self.stops)) for i, t in docs.items()}
        df, cf = Counter(), Counter()
        for c in tf.values():
            for term, n in c.items():
                df[term] += 1
                cf[term] += n
        n = len(docs)
        kept = [t for t in df if df[t] >= min_df and df[t] <= max_df * n]
        kept = sorted(kept, key=lambda t: (-cf[t], t))[:max_features]
        self.idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in kept}
        self.rows = {i: self.unit(c) for i, c in tf.items()}

    def unit(self, counts) -> dict[str, float]:
        x = {t: n * self.idf[t] for t, n in counts.items() if t in self.idf}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / norm for t, v in x.items()}

    def query(self, text: str) -> dict[str, float]:
        return self.unit(Counter(grams(text, self.stops)))


def dot(a: dict[str, float], b: dict[str, float]) -> float:
    if len(a) > len(b):
        a, b = b, a
    return round(sum(w * b.get(t, 0.0) for t, w in a.items()), 6)


def best(q: dict[str, float], rows: dict[int, dict], n: int, zero=True, skip=None):
    s = [(-dot(q, r), i) for i, r in rows.items() if i != skip]
    s = [(-a, i) for a, i in sorted(s) if zero or a < 0]
    return s[:n]


def r1(x: float) -> float:
    return round(x * 10) / 10


def home(user, courses: dict, model: Tfidf, searches: list, clicks: list) -> list[tuple]:
    """Sequential feed of one user: (course_id, source, score), at most twenty."""
    pop = sorted(courses.values(), key=lambda c: (-c["popularity_score"], c["course_id"]))

    def popular(n, cat=None):
        return [c["course_id"] for c in pop if cat is None or c["category"] == cat][:n]

    mine = sorted((s for s in searches if s["user_id"] == user),
                  key=lambda s: (s["timestamp"], s["id"]), reverse=True)[:3]
    out, why, sim = [], {}, {}

    def take(cid, source):
        if cid not in why:
            out.append(cid)
            why[cid] = source
            return True
        return False

    for s in mine[:2]:
        if s["query"]:
            for score, cid in best(model.query(s["query"]), model.rows, 3):
                if take(cid, "search"):
                    sim[cid] = r1(score * 100)
    counts = Counter(c["category"] for c in clicks if c["user_id"] == user)
    if counts:
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]
        total = sum(n for _, n in top)
        for cat, n in top:
            for cid in popular(max(2, round(n / total * 20)), cat):
                take(cid, "category")
                if len(out) >= 30:
                    break
            if len(out) >= 30:
                break
    else:
        for cat in sorted({c["category"] for c in courses.values()})[:3]:
            for cid in popular(4, cat):
                take(cid, "discover")
    if len(out) < 15:
        for cid in popular(25):
            if len(out) >= 25:
                break
            take(cid, "popular")
    total = sum(counts.values()) or 1
    scored = []
    for cid in out:
        c, s = courses[cid], sim.get(cid)
        if s:
            v = s * 100 if s <= 1 else s
            if total > 5:
                v -= min(total * 0.5, 15.0)
        else:
            base = {"search": 85.0, "category": 70.0 + counts.get(c["category"], 0) / total * 25,
                    "popular": 60.0, "discover": 50.0}[why[cid]]
            v = base + max(0, (c["rating"] - 4.0) * 10)
        scored.append((cid, why[cid], r1(max(40.0, min(99.0, v)))))
    scored.sort(key=lambda x: x[2], reverse=True)
    return scored[:20]


def personal(user, courses: dict, model: Tfidf, searches: list, clicks: list) -> list[tuple]:
    """Whole catalog in one user's order: (course_id, score)."""
    mine = sorted((s for s in searches if s["user_id"] == user),
                  key=lambda s: (s["timestamp"], s["id"]), reverse=True)[:3]
    counts = Counter(c["category"] for c in clicks if c["user_id"] == user)
    top = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2]]
    text = " ".join(s["query"] for s in mine)
    if top:
        text += " " + (" ".join(top) + " ") * 3
    if not text.strip():
        return []
    q = model.query(text)
    raw = {i: r1(dot(q, r) * 100) for i, r in model.rows.items()}
    most = max(max(raw.values()), 0.1)
    rows = sorted(courses.values(), key=lambda c: (-c["rating"], c["course_id"]))
    out = []
    for c in rows:
        s = raw[c["course_id"]]
        score = 0.0
        if s >= 0.01:
            bonus = (c["rating"] - 3.0) * 3 if c["rating"] > 3.0 else 0
            score = r1(max(40.0, min(99.5, 50 + math.sqrt(s / most) * 40 + bonus)))
        out.append((c["course_id"], score))
    out.sort(key=lambda x: x[1], reverse=True)
    return out


def accounts(existing: list[tuple], new: list[tuple]) -> dict:
    """(seq, username, email) rows one after the other -> reason or None."""
    names, mails = {u for u, _ in existing}, {e for _, e in existing}
    out = {}
    for seq, u, e in sorted(new):
        if u in names:
            out[seq] = "username_taken"
        elif e in mails:
            out[seq] = "email_taken"
        else:
            out[seq] = None
            names.add(u)
            mails.add(e)
    return out


def groups(rows, key):
    d = defaultdict(list)
    for r in rows:
        d[r[key]].append(r)
    return d
