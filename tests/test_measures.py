import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import session
from corvane.functions import distances
from corvane.operators import measures, prompts

ROWS = [(1, "A ⊑ B", "A ⊑ B", None), (2, "A ⊑ C", "A ⊓ B ⊑ C", "no"), (3, "x", "A ⊑ B", "yes"), (4, None, "A ⊑ B", None), (5, "A", "", None)]


def frame(spark):
    return spark.createDataFrame(ROWS, "pos long, f string, f_prime string, ignore_flag string")


def test_metrics_by_name(spark):
    every = [m for m in measures.METRICS if m != "graph_edit"]
    got = {r.pos: r for r in measures.evaluated(frame(spark), every, wer_max=True).collect()}
    assert got[1].jaccard == 0 and got[1].edit == 0 and got[1].chrf == 100 and got[2].wer <= 1 and got[2].edit == 2
    assert all(got[p][m] is None for p in (3, 4, 5) for m in every) and got[3].f == "x"
    with pytest.raises(ValueError):
        measures.evaluated(frame(spark), ["no such"])
    measures.register("same", lambda f, g: (F.col(f) == F.col(g)).cast("int"))
    try:
        assert {r.pos: r.same for r in measures.evaluated(frame(spark), ["same"]).collect()} == {1: 1, 2: 0, 3: None, 4: None, 5: None}
    finally:
        del measures.METRICS["same"]


def test_normalised(spark):
    given = frame(spark).withColumn("edit", F.when(F.col("pos") == 2, "6"))
    got = {r.pos: r for r in measures.evaluated(given, ["edit", "graph_edit", "wer"], normalize=True).collect()}
    assert got[1].norm_edit == 0 and got[2].norm_edit == pytest.approx(6 / 5) and got[1].norm_graph_edit == 0 and got[2].norm_graph_edit > 0 and "wer" not in measures.evaluated(given, ["wer"], True).columns


def test_embedding_adapter_and_semantic(spark):
    def embed(texts):
        return np.array([[len(t), t.count("A"), 1] for t in texts], dtype=np.float32)

    df = measures.embedded(measures.embedded(frame(spark), embed, "f", "v"), embed, "f_prime", "w")
    rows = {r.pos: r for r in df.collect()}
    assert rows[1].v == [5, 1, 1] and rows[4].v is None
    with pytest.raises(ValueError):
        measures.evaluated(df, ["semantic"])
    got = {r.pos: r.semantic for r in measures.evaluated(df, ["semantic"], vectors=("v", "w")).collect()}
    assert got[1] == pytest.approx(0, abs=1e-6) and got[2] > 0 and got[3] is None
    assert distances.semantic


def test_prompts_by_strategy(spark):
    pool = spark.createDataFrame([(i, f"r{i}", "h", f"A{i} ⊑ B") for i in range(1, 5)], "id long, req string, headers string, f_prime string").withColumn("ignore_flag", F.lit(None).cast("string"))
    near = spark.createDataFrame([(4, 2, 1), (4, 3, 2)], "id long, other long, rank int")
    for style in prompts.STYLES:
        by = {r.id: r.prompt for r in prompts.generated(pool, pool, " Most Similar ", style, neighbours=near, sorting="desc").collect()}
        assert len(by) == 4 and "A1" not in by[4] and (by[4].index("A3") < by[4].index("A2")) == (not style.endswith("chat")) and "A2" not in by[1]
        ids = prompts.generated(pool, pool, "ids", style, ids=[3, 1]).first().prompt
        assert ids.index("A3") < ids.index("A1")
        assert len(re.findall(r"A\d ⊑ B", prompts.generated(pool, pool, "random", style, headers=False, n=2).first().prompt)) == 2
    with pytest.raises(ValueError):
        prompts.generated(pool, pool, "other")


def test_cut_tables_are_released(spark):
    session.release(spark)
    df = session.cut(spark.range(5).toDF("id"), "test")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and session.release(spark) == 1 and session.release(spark) == 0
    assert not __import__("os").path.exists(path)
