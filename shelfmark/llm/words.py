"""Words of whole texts as 64-bit hashes, many texts at a time with NumPy.

Texts are taken in slabs of about a megabyte, so memory does not grow with the Arrow batch; one text
of any length is a slab of its own and is hashed piece by piece. A word's hash depends on its bytes
alone, so equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB = 1 << 20
_SPACE = 0x20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _table(separators: bytes, lower: bool) -> bytes:
    out = bytearray(range(256))
    if lower:
        for c in range(ord("A"), ord("Z") + 1):
            out[c] = c + 32
    for c in separators:
        out[c] = _SPACE
    return bytes(out)


_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
_SIGNS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words are what stands between blanks; case kept, or A-Z lower-cased.
BLANKS, BLANKS_LOWER = _table(_BLANK, False), _table(_BLANK, True)
#: Words are runs of digits, letters a-z and all that is not ASCII; A-Z lower-cased.
LETTERS_LOWER = _table(_SIGNS, True)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[_SPACE] = 0
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[i] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each hash."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def hash_words(plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word of `plain`, whose separators are
    blanks."""
    found = []
    pos = 0
    while pos < len(plain):
        end = plain.find(b" ", pos + SLAB)
        end = len(plain) if end < 0 else end
        a = np.frombuffer(plain, np.uint8, end - pos, pos)
        edge = np.diff((a != _SPACE).view(np.int8), prepend=0, append=0)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            up, down = _powers(len(a))
            run = np.zeros(len(a) + 1, np.uint64)
            np.cumsum(_BYTE[a] * up, out=run[1:])
            found.append((mix((run[stop] - run[start]) * down[start]), start + pos, stop + pos))
        pos = end
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def hash_windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k-1 positions have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k == 1:
        return mix(words + _U(k))
    up, down = _powers(len(words))
    run = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=run[1:])
    return mix((run[k:] - run[:n]) * down[:n] + _U(k))


@dataclass
class Slab:
    """Some texts of a batch: rows lo..hi, and the words of all of them in one array."""

    lo: int
    hi: int
    texts: list[bytes]
    words: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    bounds: np.ndarray  # the words of text i are bounds[i]..bounds[i+1]
    offsets: np.ndarray  # first byte of text i in the slab

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of k words from each position on, and whether they lie in one text."""
        h = hash_windows(self.words, k)
        own = self.owner()
        return h, own[:len(h)] == own[len(own) - len(h):] if len(h) else np.zeros(0, bool)


def groups(texts: list[bytes], size: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text each."""
    lo = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield lo, i
            lo, total = i, 0
        total += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a binary column; a null is an empty text."""
    return [x or b"" for x in column.to_pylist()]


def slabs(texts: list[bytes], table: bytes) -> Iterator[Slab]:
    for lo, hi in groups(texts):
        part = texts[lo:hi]
        plain = b" ".join(part).translate(table)
        words, start, stop = hash_words(plain)
        size = np.fromiter(map(len, part), np.int64, len(part)) + 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        bounds = np.searchsorted(start, offsets)
        yield Slab(lo, hi, part, words, start, stop, bounds, offsets[:-1])


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """A list column from the length of each list and all values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def longs(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64) if h.dtype == np.uint64 else h.astype(np.int64))
