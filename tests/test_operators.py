import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import clusters, nearest, prompts, records, reports, sampling, series, stats


def test_presence_and_ignore(spark):
    rows = [(1, None, "x"), (2, "no", ""), (3, "", "x"), (4, "yes", "x"), (5, "FALSE", None), (6, "maybe", "x")]
    df = spark.createDataFrame(rows, "pos long, ignore_flag string, f_prime string").withColumn("f", F.lit("g"))
    ids = lambda c: sorted(r.pos for r in df.where(c).collect())
    assert ids(records.kept()) == [1, 2, 5]
    assert ids(records.annotated()) == [1, 2]
    assert ids(records.present("f_prime")) == [1, 2, 3, 4, 6]
    assert ids(records.eligible()) == [1] and ids(records.eligible(strict=False)) == [1, 2]
    assert ids(records.sampled_by_id()) == [1, 2, 3, 6]
    assert [r.f_prime for r in records.blanked(df, "f_prime").orderBy("pos").collect()] == ["", "", "", "", None, ""]


def test_set_and_joins_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, 7, "a"), (2, None, "b"), (3, 7, None), (4, 8, "d")], "pos long, id long, req string")
    got = {r.id: (r.first_pos, r.req) for r in records.by_id(df).collect()}
    assert got == {7: (1, None), 8: (4, "d")}
    assert sorted(r.pos for r in records.unseen(df, df.where("id = 8 or id is null")).collect()) == [1, 2, 3]
    other = spark.createDataFrame([(7, "a")], "id long, req string")
    assert sorted(map(tuple, records.inconsistent(records.by_id(df).select("id", "req"), other).collect())) == [(7, "differs"), (8, "missing")]
    order = spark.createDataFrame([(0, 7), (1, 9), (2, 7), (3, 8)], "seq long, id long")
    assert sorted(r.seq for r in records.ordered(df.where("pos > 2"), order, "req").collect()) == [3]
    assert records.point(df.where("id is not null"), 8).first().pos == 4
    assert records.unseen(df.where("false"), df).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_do_not_depend_on_partitions(spark, parts):
    values = random.Random(3).sample(range(100_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(parts)
    assert [r.n for r in records.numbered(df, "v").orderBy("v").collect()] == list(range(500))
    assert records.numbered(df.where("false"), "v").count() == 0


def vectors(spark, n, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist(), i % 3 != 0) for i, v in enumerate(x)], "id long, vec array<float>, usable boolean").withColumn("seq", F.col("id"))


@pytest.mark.parametrize("block", [7, 2048])
def test_nearest_against_brute_force(spark, block):
    x, df = vectors(spark, 60)
    df = df.union(spark.createDataFrame([(60, None, True, 60), (61, [1.0], True, 61), (None, [0.0] * 64, True, 62)], df.schema))
    got = {}
    for r in nearest.nearest(df.where("id % 5 = 0"), df, 4, block=block).collect():
        got.setdefault(r.id, {})[r.rank] = r.other
    for i in range(0, 60, 5):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = math.inf
        assert [got[i][k] for k in (1, 2, 3, 4)] == np.argsort(d, kind="stable")[:4].tolist()
    assert 60 not in got


@pytest.mark.parametrize("block", [5, 2048])
def test_growing_pool_sizes(spark, block, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", block)
    x, df = vectors(spark, 31)
    got = {}
    for r in nearest.few_shot(df, 20).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    usable = [i % 3 != 0 for i in range(31)]
    for m in range(31):
        have = sum(usable[:m])
        want = 0 if m == 0 else 1 if m == 1 else min(m - 1, 20, have)
        assert len(got.get(m, [])) == want, m
    assert got[1] == [(1, 0)]  # the only one, usable or not
    d = ((x[:30] - x[30]) ** 2).sum(1)
    assert [o for _, o in sorted(got[30])] == [i for i in np.argsort(d) if usable[i]][: min(20, sum(usable[:30]))]


def test_nearest_of_copies_and_empty_pools(spark):
    df = spark.createDataFrame([(i, [0.0] * 64, True, i) for i in range(6)], "id long, vec array<float>, usable boolean, seq long")
    got = sorted((r.id, r.rank, r.other) for r in nearest.nearest(df, df, 2).collect())
    assert got[:4] == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2)]
    assert nearest.nearest(df, df.where("false"), 2).count() == 0 and nearest.few_shot(df.where("false"), 3).count() == 0


@pytest.mark.parametrize("block", [16, 8192])
def test_growing_pool_sends_no_vector_to_every_block(spark, block, monkeypatch, capsys):
    monkeypatch.setattr(nearest, "GROWING", block, raising=False)
    x, df = vectors(spark, 150, dim=8)
    x[40:] = x[7]  # more copies than any surplus of candidates
    df = df.drop("vec").join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>"), "id")
    found = nearest.few_shot(df.repartition(5), 4, dim=8)
    found.explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "CoGroup" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r.id, {})[r.rank] = (r.other, r.distance)
    for i in range(2, 150):
        pool = [j for j in range(i) if j % 3]
        want = sorted((round(float(np.linalg.norm(x[j].astype(float) - x[i].astype(float))), 9), j) for j in pool)[: min(i - 1, 4)]
        assert [(got[i][k + 1][1], got[i][k + 1][0]) for k in range(len(want))] == want, i


def test_prompts(spark):
    pool = spark.createDataFrame([(1, "r1", "h1", "A ⊑ B"), (2, "r2", None, "C ⊑ D")], "id long, req string, headers string, f_prime string")
    near = spark.createDataFrame([(9, 1, 1), (9, 2, 2)], "id long, other long, rank int")
    shown = prompts.with_samples(near, pool, "desc").withColumn("req", F.lit("q")).withColumn("headers", F.lit("h"))
    text = shown.select(prompts.prompt("samples", "req", "headers").alias("p")).first().p
    assert text == prompts.FORMULA_PREFIX + "Input: r2\nHeaders: None\nOutput: C ⊑ D\n\nInput: r1\nHeaders: h1\nOutput: A ⊑ B\n\nInput: q\nHeaders: h\nOutput:"
    chat = shown.select(prompts.prompt("samples", "req", style="formula chat").alias("p")).first().p
    assert chat.endswith("r2:C ⊑ D, r1:A ⊑ B, " + prompts.FORMULA_CHAT_SUFFIX + "q")
    concepts = shown.select(prompts.prompt("samples", "req", style="concepts chat").alias("p")).first().p
    assert concepts.endswith("Concepts: A ⊑ B\nMy first requirement is: q\nConcepts:")
    with pytest.raises(ValueError):
        prompts.prompt("samples", "req", style="sonnet")
    with pytest.raises(ValueError):
        prompts.fixed_samples(pool, "nearest")


def test_samples_texts_are_looked_up_not_shuffled(spark, capsys):
    rows = [(i, f"r{i}" * 50, None if i % 7 == 0 else f"h{i}", None if i % 5 == 0 else f"A{i}") for i in range(300)]
    pool = spark.createDataFrame([*rows, (3, "again", "h", "B")], "id long, req string, headers string, f_prime string")
    near = spark.createDataFrame([(i, (i * 31 + j) % 320, j + 1) for i in range(200) for j in range(6)], "id long, other long, rank int").repartition(4)
    with_samples = prompts.with_samples(near, pool)
    with_samples.explain()
    assert "Exchange hashpartitioning(other" not in (plan := capsys.readouterr().out) and "Join" not in plan
    by_key = {}
    for key, *text in sorted([*rows, (3, "again", "h", "B")], key=lambda r: (r[0], r[1])):
        by_key.setdefault(key, []).append(tuple(text))
    want = {i: [t for j in range(6) for t in by_key.get((i * 31 + j) % 320, [])] for i in range(200)}
    lists = prompts._listed(near, "asc", 0)
    for got in (with_samples, prompts.looked_up(lists, pool, refs=50), prompts.looked_up(lists, pool, most=1_000)):
        assert {r.id: [tuple(s) for s in r.samples] for r in got.collect()} == want
    shown = prompts.generated(pool.where("id > 150 and id < 250"), pool, "most similar", "formula chat", neighbours=near)
    got = {r.id: r.prompt for r in shown.collect()}
    assert len(got) == 99 and got[240] == prompts.FORMULA_CHAT_PREFIX + prompts.FORMULA_CHAT_SUFFIX + "r240" * 50
    assert got[151].startswith(prompts.FORMULA_CHAT_PREFIX + "".join(f"{r}:{'None' if a is None else a}, " for r, _, a in want[151]))


def test_answers_are_retried(spark):
    def responder(batch):
        return [["", ""] if len(p) == 1 else ["A ", "⊑ B"] for p in batch]

    df = spark.createDataFrame([("x",), ("long",), (None,)], "prompt string")
    got = {r.prompt: r.f for r in prompts.answered(df, responder).collect()}
    assert got == {"x": "", "long": "A ⊑ B", None: None}


def test_statistics(spark):
    from datetime import datetime as dt

    t = dt(2024, 1, 1)
    rows = [(0, 1, "wer", 0.5, t, t), (0, 1, "wer", 0.7, t, dt(2024, 1, 2)), (1, 1, "wer", 0.9, None, t), (1, 2, "wer", 0.1, t, t), (0, 3, "wer", None, t, t)]
    s = stats.delivered(spark.createDataFrame(rows, "run_no int, id long, metric string, score double, scored_at timestamp, loaded_at timestamp"))
    r = stats.per_record(s).collect()
    assert [(x.id, x.n_runs, round(x.mean, 9), round(x["std"], 9)) for x in r] == [(1, 2, 0.8, 0.1)]
    assert stats.across_runs(s).first().mean_sum == pytest.approx(0.8)
    assert {x.metric for x in stats.undocument(stats.document(s)).collect()} == {"wer"}
    assert stats.per_run(s.where("false")).count() == 0


def line(spark, ys, name="s"):
    return spark.createDataFrame([(name, i, float(y)) for i, y in enumerate(ys)], "series string, x long, y double")


def test_series(spark):
    df = line(spark, [1, 2, 3, 4]).union(line(spark, [5, 5], "flat"))
    assert [r.y for r in series.cumulative(df.where("series = 's'"), ["series"], block=3).orderBy("x").collect()] == [1, 3, 6, 10]
    assert [r.y for r in series.normalised(df, ["series"]).orderBy("series", "x").collect()] == [None, None, 0, pytest.approx(1 / 3), pytest.approx(2 / 3), 1]
    gaps = spark.createDataFrame([("s", 7, 1.0), ("s", 3, 2.0), ("s", 3, 1.5), ("s", 900, 4.0), ("s", 5, None), ("s", None, 9.0)], "series string, seq long, v double")
    for block in (2, 65_536):
        assert [(r.x, r.y) for r in series.points(gaps, ["series"], "seq", "v", block).orderBy("x").collect()] == [(0, 1.5), (1, 2.0), (2, 1.0), (3, 4.0)]
    t = {r.series: r for r in series.trend(df, ["series"]).collect()}
    assert t["s"].slope == pytest.approx(1) and t["s"].band == pytest.approx(0)
    spike = line(spark, [0] * 20 + [100])
    assert series.without_outliers(spike, ["series"]).count() == 20 and series.without_outliers(df, ["series"]).count() == 6
    assert series.pipeline(df, ["series"]).count() == 6 and series.pipeline(df.where("false"), ["series"]).count() == 0


def test_clusters(spark):
    rows = [(0, 0, [0.0, 0.0]), (1, 0, [2.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    rep = {r.label: (r.representative, r.size) for r in clusters.representatives(df).collect()}
    assert rep == {0: (2, 3), 1: (3, 1)}
    assert [r.members for r in clusters.bins(df, singles=False).collect()] == [[0, 1, 2]]
    one = clusters.distortion(df).first()
    assert one.distortion == pytest.approx(0.5) and one.inertia == pytest.approx(2)
    s = clusters.silhouette(df, block=2).first().silhouette
    far = [math.dist(rows[i][2], (9, 9)) for i in range(3)]
    want = sum((b - a) / max(a, b) for a, b in zip((1.5, 1.5, 1.0), far)) / 4
    assert s == pytest.approx(want)


def test_samples_and_splits(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id long").withColumn("pos", F.col("id"))
    parts = sampling.prefix_split(df, "pos", 0.2, 5).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 5, "validation": 5}
    assert sampling.sample(df, 3).count() == 3 and sampling.sample(df, 30).count() == 10
    assert {r.id for r in sampling.sample(df, 3).collect()} == {r.id for r in sampling.sample(df.repartition(5), 3).collect()}
    order = sampling.iteration(df, [4, 2, 4, 99]).orderBy("seq").collect()
    assert [r.id for r in order] == [4, 2, 0, 1, 3, 5, 6, 7, 8, 9] and [r.seq for r in order] == list(range(1, 11))
    assert sampling.iteration(df, [4], limit=2).count() == 2 and [r.pos for r in sampling.head(df, "pos", 2).collect()] == [0, 1]


def test_reports(spark):
    df = spark.createDataFrame([(1, 2.0, 0.125, 0.5, None, 0), (2, None, 0.3, 0.25, 1.0, 1), (3, 4.0, 1.0, 0.0, 0.1, 2)], "id long, edit double, wer double, jaccard double, semantic double, seq int").withColumn("graph_edit", F.lit(1.0))
    text = reports.latex_table(df).first().text
    assert text.startswith(reports.TABLE_HEAD) and text.endswith(reports.TABLE_TAIL)
    assert "    1 & 2 & 0.13 & 0.5 &  \\\\\n    3 & 4 & 1.0 & 0.0 & 0.1 \\\\\n" in text and "    sum & 6.0 & 1.43 & 0.75 & 1.1\\\\\n" in text
    macros = reports.latex_macros(df, "x").first().text
    assert macros.startswith("\\newcommand*\\xDistance{6.000000}\\newcommand*\\xDistanceAve{3.000000}") and macros.count("newcommand") == 10
    assert reports.latex_table(df.where("false")).count() == 1
