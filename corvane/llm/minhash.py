"""MinHash signatures and their bands, vectorised over a batch of sets."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinHash:
    """``bands`` bands of ``rows`` values, each band drawn at random from a pool of ``pool`` hash functions.

    Two sets of similarity s share a band with probability s**rows, and at least one with about
    1 - (1 - s**rows)**bands; drawing the bands from a pool keeps the cost of a signature at ``pool`` hashes.
    """

    def __init__(self, rows: int, bands: int, pool: int | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        pool = pool or rows * bands
        self.mul = rng.integers(1, 2**63, pool, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, pool, dtype=np.uint64)
        if pool == rows * bands:
            self.pick = np.arange(pool).reshape(bands, rows)
        else:
            self.pick = np.stack([rng.choice(pool, rows, replace=False) for _ in range(bands)])
        self.weight = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def signatures(self, values: np.ndarray, sizes: np.ndarray, block: int = 60_000) -> np.ndarray:
        """uint32 (sets, pool); ``values`` are the sets' elements (uint32) one after the other; no set may be empty."""
        out = np.empty((len(sizes), len(self.mul)), dtype=np.uint32)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + block, side="right")))
            part = values[base : ends[stop - 1]]
            distinct, at = np.unique(part, return_inverse=True)
            table = ((distinct.astype(np.uint64)[:, None] * self.mul + self.add) >> np.uint64(32)).astype(np.uint32)
            out[start:stop] = np.minimum.reduceat(table[at], np.r_[0, np.cumsum(sizes[start : stop - 1])], axis=0)
            start = stop
        return out

    def bands(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """int64 (sets, bands): one key for each band, different bands salted apart."""
        sig = self.signatures(values, sizes)
        out = np.broadcast_to(self.salt, (len(sig), len(self.salt))).copy()
        for j, w in enumerate(self.weight):
            out += sig[:, self.pick[:, j]].astype(np.uint64) * w
            out ^= out >> np.uint64(29)
            out *= _MIX
        return out.view(np.int64)


def hash_words(words: list[str], cache: dict[str, int]) -> list[int]:
    """32-bit numbers of words; ``cache`` keeps them between calls, up to a bound."""
    from hashlib import blake2b

    if len(cache) > 500_000:
        cache.clear()
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = int.from_bytes(blake2b(w.encode("utf-8", "replace"), digest_size=4).digest(), "little")
        out.append(h)
    return out


def shingles(values: np.ndarray, sizes: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` elements in each sequence; a shorter sequence is one shingle, an empty one none."""
    values = values.astype(np.uint64)
    ends = np.cumsum(sizes)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    which = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends - sizes, counts)
    limit = np.repeat(ends, counts)
    padded = np.r_[values, np.zeros(width, np.uint64)]
    acc = np.zeros(len(which), dtype=np.uint64)
    for k in range(width):
        inside = at + k < limit
        acc = acc * np.uint64(0x100000001B3) + np.where(inside, padded[at + k] + np.uint64(1), np.uint64(0))
        acc ^= acc >> np.uint64(31)
        acc *= _MIX
    return (acc >> np.uint64(32)).astype(np.uint32), counts
