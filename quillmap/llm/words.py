"""Words and shingles of whole Arrow text columns, vectorised over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

SLICE_BYTES = 2 << 20
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        m = max(n, _BLOCK) + 2
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield i, j
        i = j


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and each row's offset into them (one more than rows); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a text column: ``start`` and ``end`` in ``data``, ``first`` word of each row."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray):
        raw, offsets = text_bytes(texts)
        self.data = LOWER[raw]
        flag = is_word[self.data]
        n = len(flag)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        left, right = flag.copy(), flag.copy()
        left[1:] &= ~flag[:-1] | edge[1:n]
        right[:-1] &= ~flag[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(left), np.flatnonzero(right) + 1
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hashes, the same in every process."""
        start, end, out, i = self.start, self.end, np.empty(len(self.start), np.uint64), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, side="right")))
            lo, hi = start[i], end[j - 1]
            up, down = _powers(hi - lo)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[self.data[lo:hi]] * up[: hi - lo], out=sums[1:])
            out[i:j] = (sums[end[i:j] - lo] - sums[start[i:j] - lo]) * down[start[i:j] - lo]
            i = j
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def gram(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words from each position, ignoring row ends."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n])
    return out


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words from each position, ignoring row ends; its cost does not depend on ``k``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row; with fewer than k words the whole sequence."""
    for lo, hi in slices(texts):
        w = Words(texts.slice(lo, hi - lo), NOT_SPACE)
        h = w.hashes()
        grams = gram(h, k)
        first = w.first.tolist()
        for r in range(hi - lo):
            a, b = first[r], first[r + 1]
            if b - a >= k:
                s = np.sort(grams[a : b - k + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield lo + r, s[keep]
            else:
                yield lo + r, gram(h[a:b], b - a) if b > a else np.empty(0, np.uint64)
