"""Scores aggregated over records and runs. NULL scores don't count; every spread is the population's.

The first level groups by (id, metric) or (run, metric) with partial sums in every task; the later levels see a handful of
rows. Scores are restricted to the keys of the first run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The metrics of the statistics, and the mark of a graph distance that ran out of time.
METRICS = ("wer", "jaccard", "semantic", "graph_edit", "norm_graph_edit", "edit", "norm_edit")
TIMED_OUT = 9999


def delivered(scores: DataFrame) -> DataFrame:
    """One score for each run, id and metric: the one loaded last (ties: scored last, then the largest)."""
    latest = F.max_by("score", F.struct("loaded_at", "scored_at", "score"))
    return scores.groupBy("run_no", "id", "metric").agg(latest.alias("score"))


def _in_first_run(scores: DataFrame) -> Column:
    """Is this row a score of the first run? (One scalar subquery, which reads the run number alone.)"""
    return (F.col("run_no") == scores.agg(F.min("run_no")).scalar()) & F.col("score").isNotNull()


def of_first_run(scores: DataFrame) -> DataFrame:
    """Scores whose id and metric the first run has too; a window on these keys, not a join of the scores with themselves."""
    marked = scores.withColumn("_first", _in_first_run(scores))
    return marked.withColumn("_has", F.max("_first").over(Window.partitionBy("id", "metric"))).where("_has").drop("_first", "_has")


def per_record(scores: DataFrame) -> DataFrame:
    """``id, metric, n_runs, mean, std`` over the runs."""
    kept = scores.withColumn("_first", _in_first_run(scores)).groupBy("id", "metric")
    kept = kept.agg(F.count("score").alias("n_runs"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.max("_first").alias("_has"))
    return kept.where("_has").drop("_has")


def per_run(scores: DataFrame) -> DataFrame:
    """``run_no, metric, n, total, mean`` over the records."""
    return of_first_run(scores).groupBy("run_no", "metric").agg(F.count("score").alias("n"), F.sum("score").alias("total"), F.avg("score").alias("mean"))


def across_runs(scores: DataFrame) -> DataFrame:
    """``metric, mean_sum, std_sum, mean_mean, std_mean``: the second level, over the runs' totals and means."""
    return per_run(scores).groupBy("metric").agg(F.avg("total").alias("mean_sum"), F.stddev_pop("total").alias("std_sum"), F.avg("mean").alias("mean_mean"), F.stddev_pop("mean").alias("std_mean"))


def report(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Sum and average of score columns, over the rows that have them."""
    out: list[Column] = []
    for c in columns:
        out += [F.sum(c).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_ave")]
    return df.groupBy(*by).agg(*out)


def longest(scores: DataFrame) -> DataFrame:
    """``data_len``: the number of records of the largest run."""
    return scores.groupBy("run_no").agg(F.countDistinct("id").alias("n")).agg(F.max("n").alias("data_len"))


def document(scores: DataFrame) -> DataFrame:
    """``key, value``: the statistics as JSON texts, one for each record and one for each metric."""
    records = per_record(scores).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("mean", "std"))))).alias("m"))
    metrics = across_runs(scores).select(F.col("metric").alias("key"), F.to_json(F.struct("mean_sum", "std_sum", "mean_mean", "std_mean")).alias("value"))
    return records.select(F.col("id").cast("string").alias("key"), F.to_json("m").alias("value")).unionByName(metrics)


def undocument(doc: DataFrame) -> DataFrame:
    """The metric rows of a statistics document, back as columns."""
    kind = "struct<mean_sum:double,std_sum:double,mean_mean:double,std_mean:double>"
    parsed = doc.where(~F.col("key").rlike("^-?[0-9]+$")).select(F.col("key").alias("metric"), F.from_json("value", kind).alias("v"))
    return parsed.select("metric", "v.*")
