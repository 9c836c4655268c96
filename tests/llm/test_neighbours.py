import numpy as np
import pytest

neighbours = pytest.importorskip("corvane.llm.neighbours")


def table(spark, x, extra=()):
    rows = [(i, "e", v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "pos long, encoder string, vec array<float>").selectExpr("*", "1 as id", "2 as near").repartition(5)


def brute(x, k=5):
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n // 12, neighbours.DIM))
    return (c[rng.integers(len(c), size=n)] + 0.25 * rng.normal(size=(n, neighbours.DIM))).astype(np.float32)


@pytest.mark.parametrize("how", [{}, {"part_rows": 60, "probes": 4}, {"part_rows": 60, "probes": 4, "block": 16, "chunk": 40}])
def test_recall(spark, how):
    x = clustered(900)
    want = brute(x)
    got = {r.pos: r.near for r in neighbours.nearest(table(spark, x), **how).collect()}
    assert len(got) == len(x) and all(len(set(v)) == 5 and p not in v for p, v in got.items())
    recall = np.mean([len(set(got[i]) & set(want[i].tolist())) / 5 for i in range(len(x))])
    assert recall >= (1.0 if not how else 0.9)


def test_copies_bad_vectors_and_small_tables(spark):
    x = clustered(40)
    x[10:22] = x[10]  # twelve copies
    bad = [(100, "e", None), (101, "e", [1.0] * 32), (102, None, [float("nan")] * 64), (None, "e", [0.0] * 64), (0, None, x[0].tolist()), (103, "e", [None] * 64)]
    got = {r.pos: r.near for r in neighbours.nearest(table(spark, x, bad)).collect()}
    assert set(got) == set(range(40))
    want = brute(x)
    for i in range(40):
        assert got[i] == want[i].tolist(), i
    two = {r.pos: r.near for r in neighbours.nearest(table(spark, x[:2])).collect()}
    assert two == {0: [1], 1: [0]}
    assert [r.near for r in neighbours.nearest(table(spark, x[:1])).collect()] == [[]]
    assert neighbours.pairs(table(spark, x).where("false")).count() == 0


def test_parts_with_too_few_vectors(spark, monkeypatch):
    # a router that scatters rows over parts of about two
    monkeypatch.setattr(neighbours, "_LEAST_SAMPLE_PER_PART", 1)
    x = np.random.default_rng(4).normal(size=(60, neighbours.DIM)).astype(np.float32)
    got = {r.pos: r.near for r in neighbours.nearest(table(spark, x), part_rows=2, probes=1).collect()}
    assert len(got) == 60 and all(len(v) == 5 for v in got.values())


def test_levels_keep_the_work_for_a_query(spark):
    """A sample that tells 20 parts apart: without levels the parts of ten times the vectors would be ten times as large."""
    how = {"part_rows": 40, "sample": 320}
    work = {}
    for n in (1000, 10_000):
        x = clustered(n)
        rows = [(i, v.tobytes()) for i, v in enumerate(x)]
        classes = spark.createDataFrame(rows, "id long, vec binary").repartition(4)
        visits = neighbours.visits_of(classes, n, **how).toPandas()
        homes = visits[visits.home]
        assert len(homes) == n and homes.id.nunique() == n
        sizes = homes.groupby("part").size()
        work[n] = visits.part.map(sizes).fillna(0).groupby(visits.id).sum().mean()
        if n == 10_000:
            assert sizes.max() <= neighbours.SPLIT * how["part_rows"]
            got = {r.id: r.near for r in neighbours.nearest_classes(classes, **how).collect()}
            want = brute(x[:300], 5) if n <= 300 else np.stack([np.lexsort((np.arange(n), ((x - x[i]).astype(np.float64) ** 2).sum(1) + (np.arange(n) == i) * 1e9))[:5] for i in range(0, n, 50)])
            recall = np.mean([len(set(got[i]) & set(w.tolist())) / 5 for i, w in zip(range(0, n, 50), want)])
            assert recall >= 0.95, recall
    assert work[10_000] < 2 * work[1000], work


def test_parts_are_balanced():
    x = clustered(800)
    label = neighbours.balanced_parts(x, neighbours.neighbour_graph(x), 7)
    sizes = np.bincount(label, minlength=7)
    assert sizes.min() >= 800 // 7 - 4 and sizes.max() <= 800 // 7 + 5
    assert neighbours.balanced_parts(x, neighbours.neighbour_graph(x), 1).max() == 0
