"""A Bloom filter of bounded size, built by the executors, that thins out one side of a join before its shuffle.

It only ever drops rows whose key is certainly absent, so the result is the same with any size; the size is
``bits_per_key`` bits a key, but never more than ``max_bytes``, which bounds what is collected and broadcast. Beyond that it
lets more rows pass, so it may only stand before a shuffle that is in proportion to the input without it, too. Tasks merge
their bits in two steps, so that the driver gets ``max_bytes`` at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.minhash import mix

MAX_BYTES = 32 << 20
_BLOCK = 1 << 13


class Bloom:
    def __init__(self, n_keys: int, max_bytes: int = MAX_BYTES, bits_per_key: int = 12):
        need = max(n_keys, 1) * bits_per_key
        self.n_bytes = _BLOCK
        while self.n_bytes * 8 < need and self.n_bytes < max_bytes:
            self.n_bytes *= 2
        self.hashes = int(min(4, max(1, round(0.69 * self.n_bytes * 8 / max(n_keys, 1)))))
        self.data: np.ndarray | None = None

    def _at(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        x = mix(keys.view(np.uint64) if keys.dtype == np.int64 else keys)
        mask = np.uint64(self.n_bytes * 8 - 1)
        for _ in range(self.hashes):
            yield x & mask
            x = mix(x + np.uint64(0x632BE59BD9B4E019))

    def add(self, keys: np.ndarray) -> None:
        if self.data is None:
            self.data = np.zeros(self.n_bytes, dtype=np.uint8)
        for at in self._at(keys):
            np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        if self.data is None:
            return np.zeros(len(keys), dtype=bool)
        out = np.ones(len(keys), dtype=bool)
        for at in self._at(keys):
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def build(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], n_keys: int, max_bytes: int = MAX_BYTES) -> Bloom:
    """The filter of all keys that ``keys_of`` makes (int64) from ``df``'s batches."""
    empty = Bloom(n_keys, max_bytes)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Bloom(n_keys, max_bytes)
        for batch in batches:
            if batch.num_rows:
                mine.add(keys_of(batch))
        if mine.data is not None:
            blocks = mine.data.reshape(-1, _BLOCK)
            used = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "bits"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    parts = df.mapInArrow(fill, "block int, bits binary").groupBy("block").applyInArrow(join, "block int, bits binary")
    for row in parts.collect():  # at most n_bytes in all
        if empty.data is None:
            empty.data = np.zeros(empty.n_bytes, dtype=np.uint8)
        empty.data[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.bits, np.uint8)
    return empty
