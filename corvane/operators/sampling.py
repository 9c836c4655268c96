"""Samples, splits and iteration orders, all deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.records import numbered


def sample(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows by the order of a hash of key and seed (ties by key); all rows if there are no more."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def prefix_split(df: DataFrame, order: str, test_size: float = 0.2, max_train: int | None = None) -> DataFrame:
    """``part`` = 'train' for the first min(floor((1 - test_size) * N), max_train) rows in order, else 'validation'."""
    total = df.agg(F.count("*").alias("_n"))
    size = F.floor((F.lit(1.0) - F.lit(test_size)) * F.col("_n"))
    if max_train is not None:
        size = F.least(size, F.lit(max_train))
    rows = numbered(df, order, "_at").join(F.broadcast(total))
    return rows.withColumn("part", F.when(F.col("_at") < size, "train").otherwise("validation")).drop("_at", "_n")


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def iteration(df: DataFrame, ids: list[int], order: str = "pos", key: str = "id", limit: int | None = None) -> DataFrame:
    """``seq`` = 1, 2, ...: configured ids first in their order, then the other records in file order, each once."""
    spark = df.sparkSession
    first = spark.createDataFrame([(i, k) for i, k in enumerate(dict.fromkeys(ids))], f"_place int, {key} bigint")
    ranked = df.join(F.broadcast(first), key, "left").withColumn("_rank", F.struct(F.coalesce("_place", F.lit(len(ids))).alias("p"), F.col(order).alias("o")))
    once = ranked.withColumn("_row", F.row_number().over(Window.partitionBy(key).orderBy("_rank"))).where("_row = 1").drop("_row", "_place")
    out = numbered(once, "_rank", "seq").withColumn("seq", F.col("seq") + 1).drop("_rank")
    return out if limit is None else out.where(F.col("seq") <= limit)
