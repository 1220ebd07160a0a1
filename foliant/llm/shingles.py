"""Word shingles of whole texts as sorted sets of 64-bit hashes, and SetSketch registers over them."""

from __future__ import annotations

import hashlib

import numpy as np

from foliant.llm.common import cuts, offsets_of

WORDS = 5
#: A-Z to a-z, and the blanks 09-0D to a space; every other byte stays.
FOLD = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))

_SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size, made = max(n, _SLICE + 4096), []
        for x in (_BASE, _INVERSE):
            steps = np.full(size, x, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of folded bytes."""
    starts, hashes = [], []
    for lo, hi in cuts(data, _SLICE):
        a = np.frombuffer(data, dtype=np.uint8, count=hi - lo, offset=lo)
        edge = np.diff((a != 32).astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            up, down = power_tables(len(a))
            total = np.zeros(len(a) + 1, dtype=np.uint64)
            np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
            starts.append(s + lo)
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


_SPREAD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; of a shorter text, its whole word sequence as one."""
    at = offsets_of([len(t) + 1 for t in texts])
    start, word = word_hashes(b" ".join(texts).translate(FOLD))
    first = np.searchsorted(start, at)
    n = len(word) - WORDS + 1
    every = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(WORDS):
        if n > 0:
            every += word[k : k + n] * _SPREAD[k]
    every = mix(every)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(every[a : b - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            short = (word[a:b] * np.array(_SPREAD[: b - a])).sum(keepdims=True)
            out.append(mix(mix(short) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def word_digest(text: bytes) -> bytes:
    """Of the word sequence itself: equal exactly for texts of the same words."""
    return hashlib.sha256(b" ".join(text.translate(FOLD).split())).digest()


class SetSketch:
    """m registers floor(1 - log_b(min of Exp(a) draws)): mergeable by maximum, equal in a position with about the probability of the Jaccard similarity.

    With b near 1 a register is a minimum kept to a tenth of a percent, 16 bits wide."""

    def __init__(self, m: int = 128, base: float = 1.001, rate: float = 20.0, seed: int = 7):
        self.m, self.base, self.rate = m, base, rate
        rng = np.random.Generator(np.random.PCG64(seed))
        self.flip = rng.integers(0, 1 << 32, m, dtype=np.uint32)
        self.times = rng.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def registers(self, sets: list[np.ndarray], chunk: int = 1 << 15) -> np.ndarray:
        """(len(sets), m) uint16; an empty set's registers are 0."""
        lengths = np.array([len(s) for s in sets], dtype=np.int64)
        low = np.zeros((len(sets), self.m), dtype=np.uint32)
        full = np.flatnonzero(lengths)
        at = 0
        while at < len(full):
            end, n = at, 0
            while end < len(full) and (n == 0 or n + lengths[full[end]] <= chunk):
                n += lengths[full[end]]
                end += 1
            rows = full[at:end]
            u = mix(np.concatenate([sets[r] for r in rows]) + np.uint64(0x632BE59BD9B4E019)).astype(np.uint32)
            begin = offsets_of(lengths[rows])[:-1]
            work = np.empty_like(u)
            for i in range(self.m):
                np.bitwise_xor(u, self.flip[i], out=work)
                np.multiply(work, self.times[i], out=work)
                low[rows, i] = np.minimum.reduceat(work, begin)
            at = end
        draw = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / self.rate
        k = np.floor(1 - np.log(draw) / np.log(self.base))
        k[lengths == 0] = 0
        return np.clip(k, 0, 65535).astype(np.uint16)

    def similarity(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 100) -> np.ndarray:
        """Maximum-likelihood Jaccard of register rows with known set sizes, from how many registers are greater, less and equal."""
        more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
        equal = self.m - more - less
        u = (na / np.maximum(na + nb, 1))[:, None]
        v = 1 - u
        most = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
        j = most * (np.arange(steps + 1) / steps)[None, :]
        part = lambda x: -np.log1p(-np.clip(x, 0, 1) * (self.base - 1) / self.base) / np.log(self.base)
        p, q = part(u - v * j), part(v - u * j)
        tiny = 1e-12
        like = more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + equal * np.log(np.maximum(1 - p - q, tiny))
        return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]
