"""Every core query against its SQL on the smallest tables, and the contract of the entry module."""

import math

import duckdb
import pytest
from conftest import TESTDATA

from corvane.operators import clusters
from corvane.plans import catalog

SF = TESTDATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v


def rows(values):
    return sorted((tuple(map(same, r)) for r in values), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    done = con.execute(catalog.SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == cols
    theirs = rows([r[names.index(c)] for c in cols] for r in done.fetchall())
    assert rows([r[c] for c in cols] for r in df.collect()) == theirs


@pytest.mark.parametrize("name", ["concept_chat_prompts", "similar_chat_prompts"])
def test_chat_prompts_shuffle_keys_only(spark, name, capsys):
    catalog.QUERIES[name](spark, str(SF)).explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "CoGroup" not in plan  # no row is sent to every block
    lists = [line for line in plan.splitlines() if "collect_list" in line]
    assert lists and not any("req" in line or "f_prime" in line or "answer" in line for line in lists)  # no sample's text is in a list that is shuffled


def value(con, statement):
    return con.execute(statement).fetchone()[0]


def test_rows_that_fail_and_rows_that_load_are_all_rows(spark, con):
    bad = catalog.QUERIES["p3_found"](spark, str(SF))
    assert bad.select("raw_id").distinct().count() == bad.count()
    assert bad.count() + catalog.QUERIES["p3_loaded"](spark, str(SF)).count() == value(con, "SELECT count(*) FROM gold_raw")


def test_edit_rate_scores_exactly_the_eligible(spark, con):
    scores = catalog.QUERIES["ter_scores"](spark, str(SF))
    assert scores.count() == value(con, "SELECT count(*) FROM gold") and scores.where("ter is not null").count() == scores.where("ter >= 0 and ter <= 1").count() > 0


def test_graph_distance_is_zero_for_equal_formulas_only(spark, con):
    gold = spark.read.parquet(f"{SF}/gold.parquet")
    scores = catalog.QUERIES["graph_edit_scores"](spark, str(SF)).join(gold.select("pos", "f", "f_prime"), "pos")
    assert scores.where("f = f_prime and graph_edit <> 0").count() == 0 and scores.where("graph_edit > 0").count() > 0
    parts = catalog.QUERIES["graph_parts"](spark, str(SF))
    assert parts.select("pos").distinct().count() == value(con, "SELECT count(*) FROM gold WHERE f_prime IS NOT NULL")


def test_every_row_gets_one_cluster(spark, con):
    got = catalog.QUERIES["kmeans_clusters"](spark, str(SF))
    assert got.count() == got.select("vec_id").distinct().count() == value(con, "SELECT count(*) FROM embeddings") and got.select("cluster").distinct().count() == 10


def test_elbow_falls(spark):
    got = {r.k: r for r in clusters.elbow(spark.read.parquet(f"{SF}/embeddings.parquet"), [2, 8, 30]).collect()}
    assert got[2].inertia > got[8].inertia > got[30].inertia and all(-1 <= r.silhouette <= 1 for r in got.values()) and list(clusters.ELBOW) == list(range(2, 81))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
