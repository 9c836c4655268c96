"""Exact nearest records: the k most similar of a pool for each query, also of a pool that grows from record to record.

Every query meets every row of its pool, in blocks of bounded size. For a fixed pool, queries and pool are dealt to blocks,
a pair of blocks is one cogroup that multiplies two matrices, and only the k best of each query leave it. A growing pool is
written once, in order; a task takes a block of its rows as queries and reads all rows before them from that table, block by
block, so that nothing is sent to every block and the disk holds the vectors once, however many there are. (For whole
collections of millions see the approximate search.)

Defined cases: NULL vectors, vectors of another length and NULL ids take no part; ties in distance go to the lower id; a
pool of one gives that one record; a query is not its own neighbour where it stands in the pool.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.distances import l2
from corvane.session import cut, parquet_rows

BLOCK = 2_048
GROWING = 8_192
DECIMALS = 9


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _match(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, pool: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows and pool.num_rows:
            q, p = _stack(queries.column("vec")), _stack(pool.column("vec"))
            qid, pid = queries.column("id").to_numpy(), pool.column("id").to_numpy()
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                d = np.sqrt(np.maximum((part * part).sum(1)[:, None] + (p * p).sum(1) - 2 * part @ p.T, 0))
                d[pid[None, :] == qid[a : a + 256, None]] = np.inf
                take = min(len(p), k + 16)
                at = np.argpartition(d, take - 1, axis=1)[:, :take]
                exact = np.round(np.sqrt(((p[at] - part[:, None, :]) ** 2).sum(2)), DECIMALS)
                exact[np.isinf(np.take_along_axis(d, at, 1))] = np.inf
                best = np.lexsort((pid[at], exact), axis=1)[:, :k]
                rows, ids = np.take_along_axis(exact, best, 1), np.take_along_axis(pid[at], best, 1)
                keep = np.isfinite(rows)
                out[0].append(np.repeat(qid[a : a + 256], keep.sum(1)))
                out[1].append(ids[keep])
                out[2].append(rows[keep])
        cols = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"id": pa.array(cols[0].astype(np.int64)), "other": pa.array(cols[1].astype(np.int64)), "distance": pa.array(cols[2].astype(np.float64))})

    return run


def _whole(vec: str, dim: int) -> Column:
    return F.col("id").isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda v: v.isNull())


def nearest(queries: DataFrame, pool: DataFrame, k: int, key: str = "id", vec: str = "vec", dim: int = 64, block: int = BLOCK) -> DataFrame:
    """``id, other, distance, rank``: the k nearest rows of the pool for each query (distances to 9 decimals)."""
    q, p = (d.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec")).where(_whole("vec", dim)) for d in (queries, pool))
    n_q, n_p = -(-max(1, q.count()) // block), -(-max(1, p.count()) // block)
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_q)))
    p = p.withColumn("pb", F.pmod(F.xxhash64("id"), F.lit(n_p)))
    q = q.withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(n_p - 1)).cast("array<bigint>")))
    p = p.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<bigint>")))
    q, p = (d.select(F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("qb").alias("qb"), F.col("pb").alias("pb")) for d in (q, p))
    hits = q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInArrow(_match(k), "id bigint, other bigint, distance double")
    best = hits.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, k).alias("best"))
    return best.select("id", F.posexplode("best").alias("at", "b")).select("id", F.col("b.other").alias("other"), F.col("b.distance").alias("distance"), (F.col("at") + 1).alias("rank"))


class _Best:
    """The k nearest of each query of a block, among all pool rows it has met."""

    def __init__(self, vec: np.ndarray, seq: np.ndarray, k: int):
        self.vec, self.seq, self.k, self.norm = vec, seq, k, (vec * vec).sum(1)
        self.distance = np.full((len(vec), k), np.inf)
        self.other = np.full((len(vec), k), np.iinfo(np.int64).max)

    def meet(self, vec: np.ndarray, seq: np.ndarray, ids: np.ndarray, at_once: int = 512) -> None:
        """Takes what is among the k best so far; single precision only sorts out, by a bound wide enough for its error and for ties."""
        norm = (vec * vec).sum(1)
        if not (fine := np.isfinite(norm)).all():
            vec, seq, ids, norm = vec[fine], seq[fine], ids[fine], norm[fine]
        if not len(vec):
            return
        most = max(norm.max(), self.norm[np.isfinite(self.norm)].max(initial=0))
        kind = np.float32 if most < 1e30 else np.float64
        error, least = (vec.shape[1] + 36) * np.finfo(kind).eps, np.finfo(kind).min
        wide = -(-len(vec) // 8) * 8  # what is added is infinitely far
        right = np.zeros((wide, vec.shape[1] + 1), kind)
        right[:, -1] = np.inf
        right[: len(vec), :-1], right[: len(vec), -1] = vec, norm
        nears, hits = np.empty((at_once, wide), kind), np.empty((at_once, wide), bool)
        for a in range(0, len(self.vec), at_once):
            part = slice(a, a + at_once)
            if seq.min() >= self.seq[part].max():
                continue
            left = np.column_stack([2 * self.vec[part], np.full(len(self.vec[part]), -1.0)]).astype(kind)
            near = np.matmul(left, right.T, out=nears[: len(left)])
            if seq.max() >= self.seq[part].min():
                near[:, : len(vec)][seq[None, :] >= self.seq[part, None]] = -np.inf
            size = np.sqrt(self.norm[part]) + np.sqrt(norm.max())
            slack = error * size**2 + 4 * 10.0**-DECIMALS * size + 1e-17
            low = np.maximum(self.norm[part] - self.distance[part, -1] ** 2 - slack, least).astype(kind)
            fresh = np.flatnonzero(np.isinf(self.distance[part, -1]))
            if len(fresh) and wide > self.k:
                kth = np.partition(near[fresh], -self.k, axis=1)[:, -self.k]
                low[fresh] = np.maximum(least, kth - 2 * slack[fresh]).astype(kind)
            hit = np.greater_equal(near, low[:, None], out=hits[: len(left)])
            eight = np.flatnonzero(hit.view(np.uint64))
            at = np.flatnonzero(hit.reshape(-1, 8)[eight])
            at = eight[at // 8] * 8 + at % 8
            if len(at):
                self._take(a + at // wide, at % wide, vec, ids)

    def _take(self, row: np.ndarray, col: np.ndarray, vec: np.ndarray, ids: np.ndarray) -> None:
        exact = np.empty(len(row))
        for a in range(0, len(row), 1 << 15):
            part = slice(a, a + (1 << 15))
            exact[part] = np.round(np.sqrt(((vec[col[part]] - self.vec[row[part]]) ** 2).sum(1)), DECIMALS)
        rows = np.unique(row)
        row = np.concatenate([row, np.repeat(rows, self.k)])
        exact, other = np.concatenate([exact, self.distance[rows].ravel()]), np.concatenate([ids[col], self.other[rows].ravel()])
        order = np.lexsort((other, exact, row))
        row = row[order]
        best = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.distance[rows], self.other[rows] = exact[best].reshape(-1, self.k), other[best].reshape(-1, self.k)


def _earlier(table: DataFrame, k: int, block: int) -> DataFrame:
    """``id, other, distance, rank`` for each row of a table in order (see ``few_shot``) that has two or more before it."""
    files = table.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).collect()
    files = sorted(map(tuple, files), key=lambda f: f[2])
    parts, before = [], 0
    for path, n, _, last in files:
        parts += [(before, path, a, min(a + block, n)) for a in range(0, n, block)]
        before += n
    parts.reverse()  # the longest first

    def rows(path: str, columns: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in parquet_rows(path, columns, block):
            yield batch, _stack(pa.chunked_array([batch.column("vec")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        for before, path, start, stop in parts[TaskContext.get().partitionId() :][:1]:
            got, at = [], 0
            for batch, vec in rows(path, ["id", "seq", "vec", "whole"]):
                piece = slice(max(0, start - at), max(0, stop - at))
                got.append((batch.column("id").to_numpy(zero_copy_only=False)[piece], batch.column("seq").to_numpy()[piece], vec[piece], batch.column("whole").to_numpy(zero_copy_only=False)[piece]))
                at += batch.num_rows
                if at >= stop:
                    break
            ids, seq, vec, whole = (np.concatenate(c) for c in zip(*got))
            best = _Best(vec, seq, k)
            for path, _, first, _ in files:
                if first >= seq.max():
                    break
                for batch, vec in rows(path, ["id", "seq", "vec", "usable"]):
                    use = batch.column("usable").to_numpy(zero_copy_only=False) & (batch.column("seq").to_numpy() < seq.max())
                    best.meet(vec[use], batch.column("seq").to_numpy()[use], batch.column("id").to_numpy(zero_copy_only=False)[use].astype(np.int64))
                    if not use.any() and batch.column("seq")[0].as_py() >= seq.max():
                        break
            m = before + start + np.arange(len(ids))
            keep = np.isfinite(best.distance) & (np.arange(k) < np.where(whole & (m >= 2), m - 1, 0)[:, None])
            row, rank = np.nonzero(keep)
            for a in range(0, len(row), 1 << 14):
                r, c = row[a : a + (1 << 14)], rank[a : a + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[r].astype(np.int64)), pa.array(best.other[r, c]), pa.array(best.distance[r, c]), pa.array((c + 1).astype(np.int32))], ["id", "other", "distance", "rank"])

    # a partition for each block, and as many numbers as there are neighbours, or Spark takes the result for a small one and broadcasts it
    return table.sparkSession.range(0, before * k, 1, max(1, len(parts))).mapInArrow(run, "id bigint, other bigint, distance double, rank int")


def few_shot(records: DataFrame, k: int, usable: str = "usable", dim: int = 64) -> DataFrame:
    """Neighbours for each record of a growing pool (id, seq, vec, usable): ``id, other, distance, rank``.

    With m records before it, a record gets none at m = 0, the only one, usable or not, at m = 1, and else the nearest
    min(m - 1, k) of those that are usable. The driver holds a row for each file of the ordered table and each block.
    """
    rows = records.where(F.size("vec") == dim).select(F.col("id").cast("long").alias("id"), F.col("seq").cast("long").alias("seq"), "vec", F.col(usable).alias("usable"))
    none = F.array_repeat(F.lit(0), dim).cast(rows.schema["vec"].dataType)  # keeps its place
    rows = rows.withColumn("whole", _whole("vec", dim)).select("id", "seq", F.when(F.col("whole"), F.col("vec")).otherwise(none).alias("vec"), "whole", (F.col("whole") & F.coalesce("usable", F.lit(False))).alias("usable"))
    table = cut(rows.repartitionByRange("seq").sortWithinPartitions("seq"), "pool")
    # the first two records meet in one row
    start = table.orderBy("seq").limit(2).agg(F.array_sort(F.collect_list(F.struct("seq", "id", "vec", "whole"))).alias("s")).where("size(s) = 2 and s[0].whole and s[1].whole")
    single = start.select(F.col("s")[1]["id"].alias("id"), F.col("s")[0]["id"].alias("other"), F.round(l2(F.col("s")[0]["vec"], F.col("s")[1]["vec"]), DECIMALS).alias("distance"), F.lit(1).alias("rank"))
    return _earlier(table, k, GROWING).unionByName(single)


def in_sorting(neighbours: DataFrame, sorting: str = "asc", seed: int = 0) -> DataFrame:
    """``id, others``: each record's neighbours nearest first ('asc', and any unknown word), nearest last ('desc') or shuffled."""
    item = F.struct("rank", "other")
    key = {"desc": F.struct((-F.col("rank")).alias("r"), "other"), "random": F.struct(F.xxhash64("id", "other", F.lit(seed)).alias("r"), "other")}.get(sorting, item)
    return neighbours.groupBy("id").agg(F.array_sort(F.collect_list(key)).getField("other").alias("others"))
