"""The k nearest vectors of every vector (problem 4).

Learned partitions: on a bounded sample the exact neighbour graph is built and cut into balanced parts by recursive
bisection with swaps that lower the number of cut edges; a small network (one hidden layer) then learns, from each
vector, how its neighbours are spread over the parts. Every vector is indexed in the part the network finds most likely,
and as a query visits the most likely parts that make up ``MASS`` of the predicted spread, at most ``PROBES``, where it is
ranked by its exact distances. A sample can tell only so many parts apart (one for 16 of its rows). Where a part has
more than ``SPLIT`` times ``PART_ROWS`` vectors, it gets a graph, parts and a network of its own, fitted on an executor from
a bounded sample of that part, and its queries go on to the likeliest parts below it; this is repeated, so that parts stay
of the same size, and the work for a query about the same, however large the collection is. A query whose parts hold fewer
than k others is searched in all blocks.

* equal vectors are collapsed before the search and spread again after it, so a group of copies costs one query;
* a part that is larger than ``BLOCK`` is searched in blocks and its queries come in chunks of ``CHUNK``; every block
  meets every chunk, so a hot part spreads over many tasks and nothing is left out;
* only the first sample (``SAMPLE`` vectors) and its network are ever on the driver, and how many rows the largest part has.

Defined cases: a row counts if it has a position and exactly ``DIM`` finite numbers; a position with several such vectors
takes part once, with the least of them in array order, whatever its encoder; ties go to the lower position; with fewer
than k others all of them are neighbours; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import bounded_sample, cut

DIM = 64
K = 5
SAMPLE = 12_000
PART_ROWS = 2_000
PROBES = 8
MASS = 0.92
BLOCK = 8_192
CHUNK = 16_384
SPLIT, LEVELS = 4, 5
_LEAST_SAMPLE_PER_PART = 16
_LEAST_WEIGHT = 0.02
_FAN = 1 << 12


def neighbour_graph(x: np.ndarray, k: int = 10, block: int = 1000) -> np.ndarray:
    """Indices of the k nearest others of each row."""
    n = len(x)
    k = min(k, n - 1)
    norms = (x * x).sum(1)
    out = np.empty((n, k), dtype=np.int32)
    for a in range(0, n, block):
        d = norms[None, :] - 2 * (x[a : a + block] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + block] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """The part of each row: recursive bisection at equal shares, then swaps of the pairs that gain most."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(x), dtype=np.int32)
    todo = [(np.arange(len(x)), parts, 0)]
    while todo:
        rows, count, first = todo.pop()
        if count == 1:
            label[rows] = first
            continue
        left_count = count // 2
        size = len(rows) * left_count // count
        centred = x[rows] - x[rows].mean(0)
        axis = rng.normal(size=x.shape[1]).astype(np.float32)
        for _ in range(8):  # power iteration for the main direction
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) + 1e-12
        side = np.zeros(len(rows), dtype=np.int8)
        side[np.argsort(centred @ axis, kind="stable")[size:]] = 1
        place = np.full(len(x), -1, dtype=np.int64)
        place[rows] = np.arange(len(rows))
        near = place[graph[rows]]
        known = near >= 0
        for _ in range(12):
            other = (side[np.maximum(near, 0)] != side[:, None]) & known
            gain = other.sum(1) - (known & ~other).sum(1)
            a, b = (np.flatnonzero((side == s) & (gain > 0)) for s in (0, 1))
            n = min(len(a), len(b))
            if n == 0:
                break
            a = a[np.argsort(-gain[a], kind="stable")[: max(1, n // 2)]]
            b = b[np.argsort(-gain[b], kind="stable")[: max(1, n // 2)]]
            side[a], side[b] = 1, 0
        todo.append((rows[side == 0], left_count, first))
        todo.append((rows[side == 1], count - left_count, first + left_count))
    return label


class Router:
    """A network with one hidden layer that gives each vector's likely parts."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def fit(cls, x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, hidden: int = 96, epochs: int = 14, seed: int = 5) -> Router:
        if parts == 1:
            return cls([])
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(0), x.std(0).mean() + 1e-9
        z = ((x - mean) / scale).astype(np.float32)
        target = np.zeros((len(x), parts), dtype=np.float32)
        target[np.arange(len(x)), label] = 3
        for j in range(graph.shape[1]):
            np.add.at(target, (np.arange(len(x)), label[graph[:, j]]), 1)
        target /= target.sum(1, keepdims=True)
        w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        w = [v.astype(np.float32) for v in w]
        m, s = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            rate = 4e-3 * (1 - epoch / epochs) + 2e-4
            for a in range(0, len(x), 128):
                i = order[a : a + 128]
                h = np.maximum(z[i] @ w[0] + w[1], 0)
                o = h @ w[2] + w[3]
                o -= o.max(1, keepdims=True)
                p = np.exp(o)
                p /= p.sum(1, keepdims=True)
                do = (p - target[i]) / len(i)
                dh = (do @ w[2].T) * (h > 0)
                grads = [z[i].T @ dh, dh.sum(0), h.T @ do, do.sum(0)]
                step += 1
                for v, g, mm, ss in zip(w, grads, m, s):
                    mm += 0.1 * (g - mm)
                    ss += 0.001 * (g * g - ss)
                    v -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.999**step)) + 1e-8)
        return cls([mean.astype(np.float32), np.float32(scale), *w])

    def ranked(self, x: np.ndarray, probes: int, mass: float = MASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The most likely parts of each row, the most likely first, how many of them make up ``mass`` of the predicted
        spread (two at least, ``probes`` at most), and each one's share."""
        if not self.weights:
            return np.zeros((len(x), 1), dtype=np.int64), np.ones(len(x), dtype=np.int64), np.ones((len(x), 1), np.float32)
        mean, scale, w0, b0, w1, b1 = self.weights
        o = np.maximum((x - mean) / scale @ w0 + b0, 0) @ w1 + b1
        o = np.exp(o - o.max(1, keepdims=True))
        o /= o.sum(1, keepdims=True)
        probes = min(probes, o.shape[1])
        top = np.argpartition(-o, probes - 1, axis=1)[:, :probes]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(o, top, axis=1), axis=1, kind="stable"), axis=1)
        share = np.take_along_axis(o, top, axis=1)
        return top.astype(np.int64), np.clip((np.cumsum(share, axis=1) < mass).sum(1) + 1, min(2, probes), probes), share


def fitted(x: np.ndarray, n: int, part_rows: int) -> Router:
    """The router of a sample ``x`` of ``n`` vectors."""
    parts = max(1, min(-(-n // part_rows), len(x) // _LEAST_SAMPLE_PER_PART, _FAN))
    if parts == 1:
        return Router([])
    graph = neighbour_graph(x)
    return Router.fit(x, graph, balanced_parts(x, graph, parts), parts)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, DIM)


def _packed(vectors: DataFrame, vec: str) -> DataFrame:
    """``pos, vec`` with the numbers as bytes, rows without exactly DIM finite numbers left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, DIM)
            fine = np.isfinite(flat).all(axis=1)
            flat = np.where(flat == 0, np.float32(0), flat)  # one zero, so that equal numbers are equal bytes
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), pa.array([r.tobytes() for r in flat[fine]], pa.binary())], ["pos", "vec"])

    base = vectors.select(vectors["pos"].cast("long").alias("pos"), vectors[vec].cast("array<float>").alias("vec"))
    base = base.where(F.col("pos").isNotNull() & (F.size("vec") == DIM) & ~F.exists("vec", lambda v: v.isNull()))
    return base.mapInArrow(run, "pos bigint, vec binary").groupBy("pos").agg(F.min("vec").alias("vec"))


def _search(k: int):
    """Reranking of one chunk of queries against one block of vectors."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        if not index.num_rows or not queries.num_rows:
            return empty
        x, ids = _matrix(index.column("vec")), index.column("id").to_numpy()
        q, qids = _matrix(queries.column("vec")), queries.column("id").to_numpy()
        norms = (x * x).sum(1)
        take = min(len(x), k + 6)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(q), 512):
            part, own = q[a : a + 512], qids[a : a + 512]
            rough = norms[None, :] - 2 * (part @ x.T)
            at = np.argpartition(rough, take - 1, axis=1)[:, :take]
            diff = x[at].astype(np.float64) - part[:, None, :]
            d = np.einsum("qtd,qtd->qt", diff, diff)
            other = ids[at]
            d[other == own[:, None]] = np.inf
            best = np.lexsort((other, d), axis=1)[:, :k]
            d, other = np.take_along_axis(d, best, 1), np.take_along_axis(other, best, 1)
            keep = np.isfinite(d)
            out.append((np.repeat(own, keep.sum(1)), other[keep], d[keep]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"id": pa.array(cols[0]), "other": pa.array(cols[1]), "d": pa.array(cols[2])})

    return run


_VISITS = "id bigint, vec binary, part bigint, home boolean, weight float"


def _below(rows: pa.Table, router: Router, probes: int) -> pa.Table:
    """A row for each part below that a visit is passed on to: those that make up MASS, less those that are very unlikely
    with the weight of the visit itself."""
    part, home, weight = (rows.column(c).to_numpy() for c in ("part", "home", "weight"))
    top, count, share = router.ranked(_matrix(rows.column("vec")), probes)
    share = share * weight[:, None]
    rank = np.arange(top.shape[1])[None, :]
    row, at = np.nonzero((rank < count[:, None]) & ((rank == 0) | (share >= _LEAST_WEIGHT)))
    some = rows.select(["id", "vec"]).take(pa.array(row))
    return pa.table({"id": some.column(0), "vec": some.column(1), "part": top[row, at] + (part[row] + 1) * _FAN, "home": (at == 0) & home[row], "weight": share[row, at].astype(np.float32)})


def visits_of(classes: DataFrame, n: int, part_rows: int = PART_ROWS, probes: int = PROBES, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """``id, vec, part, home, weight``: the parts that each vector visits; it is indexed where ``home`` is true."""
    some = bounded_sample(classes.select("id", "vec"), ["id"], sample).select("vec").toArrow()
    router = classes.sparkSession.sparkContext.broadcast(fitted(_matrix(some.column("vec")), n, part_rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                top, count, share = router.value.ranked(_matrix(batch.column(1)), probes)
                keep = np.arange(top.shape[1])[None, :] < count[:, None]
                ends = pa.array(np.r_[0, np.cumsum(count)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (top[keep], share[keep].astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], ["id", "vec", "parts", "weights"])

    # each vector is written once here, with the parts as a list
    routed = cut(classes.select("id", "vec").mapInArrow(route, "id bigint, vec binary, parts array<bigint>, weights array<float>"), "neighbours-routed")
    visits = routed.select("id", "vec", F.posexplode(F.arrays_zip("parts", "weights")).alias("at", "to"))
    visits = visits.select("id", "vec", F.col("to.parts").alias("part"), (F.col("at") == 0).alias("home"), F.col("to.weights").alias("weight"))
    for _ in range(LEVELS):
        sizes = visits.groupBy("part").agg(F.count_if("home").alias("homes"), F.count("*").alias("visits"))
        large = cut(sizes.where(F.col("homes") > SPLIT * part_rows), "neighbours-large")
        before = large.agg(F.max("homes").alias("n")).first().n
        if before is None:
            break
        split = cut(_split(visits, large, part_rows, probes, sample, chunk), "neighbours-visits")
        visits = visits.join(large.select("part"), "part", "left_anti").select("id", "vec", "part", "home", "weight").unionByName(split)
        if split.where("home").groupBy("part").count().agg(F.max("count").alias("n")).first().n >= before:
            break  # vectors that no network tells apart; blocks take care of them
    return visits


def _split(visits: DataFrame, large: DataFrame, part_rows: int, probes: int, sample: int, chunk: int) -> DataFrame:
    """The visits of the parts in ``large``, passed on to the parts below."""
    inside = visits.join(large, "part")
    share = F.least(F.lit(1.0), F.lit(1.1 * sample) / F.col("homes"))
    drawn = inside.where(F.col("home") & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30)))

    def fit(table: pa.Table) -> pa.Table:
        got = fitted(_matrix(table.column("vec")), table.column("homes")[0].as_py(), part_rows)
        return pa.table({"part": table.column("part").slice(0, 1), "router": pa.array([pickle.dumps(got.weights)], pa.binary())})

    routers = cut(drawn.select("part", "homes", "vec").groupBy("part").applyInArrow(fit, "part bigint, router binary"), "neighbours-routers")
    chunks = F.ceil(F.col("visits") / F.lit(chunk)).cast("int")
    sent = routers.join(large, "part").select("part", "router", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    dealt = inside.select("id", "vec", "part", "home", "weight", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"))

    def route(own: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows or not own.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("id", pa.int64()), ("vec", pa.binary()), ("part", pa.int64()), ("home", pa.bool_()), ("weight", pa.float32()))})
        return _below(rows, Router(pickle.loads(own.column("router")[0].as_py())), probes)

    return sent.groupBy("part", "chunk").cogroup(dealt.groupBy("part", "chunk")).applyInArrow(route, _VISITS)


def nearest_classes(classes: DataFrame, k: int = K, part_rows: int = PART_ROWS, probes: int = PROBES, sample: int = SAMPLE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``id, near``: for each id of ``classes`` (id, vec; vectors all different) its k nearest other ids, nearest first."""
    n = classes.count()
    if n == 0:
        return classes.select("id", F.array().cast("array<bigint>").alias("near"))
    visits = visits_of(classes, n, part_rows, probes, sample, chunk)
    sizes = visits.groupBy("part").agg(F.ceil(F.count_if("home") / F.lit(block)).cast("int").alias("blocks"), F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    sizes = cut(sizes.where("blocks > 0"), "neighbours-sizes")
    index = visits.where("home").select("id", "vec", "part").join(sizes, "part")
    index = index.select("id", "vec", "part", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    asked = visits.select(F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("part").alias("part")).join(sizes, "part")
    asked = asked.select("id", "vec", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"))
    keys = ["part", "block", "chunk"]
    near = cut(_best(index, asked, keys, k), "neighbours-near")
    short = classes.select("id", "vec").join(near.where(F.size("near") >= min(k, n - 1)).select("id"), "id", "left_anti")
    missing = short.count() if n > 1 else 0
    if missing:
        blocks, chunks = -(-n // block), -(-missing // chunk)
        number = lambda size: F.pmod(F.xxhash64("id"), F.lit(size)).cast("int")
        every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
        index = classes.select("id", "vec", number(blocks).alias("block"), every(chunks).alias("chunk"))
        asked = short.select(F.col("id").alias("id"), F.col("vec").alias("vec"), every(blocks).alias("block"), number(chunks).alias("chunk"))
        near = near.join(short.select("id"), "id", "left_anti").unionByName(_best(index, asked, ["block", "chunk"], k))
    return near


def _best(index: DataFrame, asked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``id, near``: the k nearest over all groups in which an asked id meets a part of the index."""
    hits = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k), "id bigint, other bigint, d double")
    ordered = F.array_sort(F.collect_list(F.struct("d", "other")))  # at most k for each group an id is in
    return hits.groupBy("id").agg(F.slice(ordered, 1, k).getField("other").alias("near"))


def nearest(vectors: DataFrame, k: int = K, vec: str = "vec", **how: int) -> DataFrame:
    """``pos, near``: for every position its k nearest others, nearest first (ties: the lower position)."""
    packed = cut(_packed(vectors, vec), "neighbours-packed")
    w = Window.partitionBy("vec").orderBy("pos")
    lowest = packed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    classes = cut(lowest.groupBy("vec").agg(F.array_sort(F.collect_list("pos")).alias("lead")).select(F.col("lead")[0].alias("id"), "vec", "lead"), "neighbours-classes")
    near = nearest_classes(classes.select("id", "vec"), k, **how)
    several = classes.where(F.size("lead") > 1).select(F.col("id").alias("other"), "lead")
    spread = near.select("id", F.posexplode("near").alias("place", "other")).join(several, "other", "left")
    spread = spread.select("id", "place", F.coalesce("lead", F.array("other")).alias("lead"))
    others = spread.groupBy("id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("place", "lead"))).getField("lead")).alias("others"))
    full = classes.join(others, "id", "left").select("vec", "lead", F.concat("lead", F.coalesce("others", F.array().cast("array<bigint>"))).alias("order"))
    alone = full.where(F.size("lead") == 1).select(F.col("lead")[0].alias("pos"), "order")
    grouped = packed.join(full.where(F.size("lead") > 1), "vec").select("pos", "order")
    return alone.unionByName(grouped).select("pos", F.slice(F.filter("order", lambda o: o != F.col("pos")), 1, k).alias("near"))


def pairs(vectors: DataFrame, k: int = K, **how: int) -> DataFrame:
    """``pos_a, pos_b`` with pos_a < pos_b: at least one is among the k nearest of the other."""
    links = nearest(vectors, k, **how).select("pos", F.explode("near").alias("other"))
    return links.select(F.least("pos", "other").alias("pos_a"), F.greatest("pos", "other").alias("pos_b")).distinct()
