"""Clusters of vectors: bins, centres, representatives, distortion, silhouette, k-means and its elbow.

Centres are a row for each cluster, with the vector's components averaged one by one (posexplode, then a group-by with
partial sums), so a cluster of any size is summed in parallel; they are joined back on the label.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.distances import l2
from corvane.operators.records import numbered
from corvane.session import cut

N_CLUSTERS = 10
ELBOW = range(2, 81)


def centres(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """``label, size, centre``."""
    parts = df.select(label, F.posexplode(vec).alias("at", "v")).groupBy(label, "at").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count("*").alias("size"))
    return parts.groupBy(label).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "v"))).getField("v").alias("centre"))


def with_distance(df: DataFrame, label: str = "label", vec: str = "embedding", decimals: int = 9) -> DataFrame:
    """Every member with ``distance`` to its own centre."""
    return df.join(centres(df, label, vec), label).withColumn("distance", F.round(l2(vec, "centre"), decimals)).drop("centre")


def representatives(df: DataFrame, key: str = "vec_id", label: str = "label", vec: str = "embedding") -> DataFrame:
    """``label, size, representative, distance``: the member nearest to the centre (ties: the lower key)."""
    near = F.min(F.struct("distance", key)).alias("near")
    return with_distance(df, label, vec).groupBy(label).agg(F.max("size").alias("size"), near).select(label, "size", F.col(f"near.{key}").alias("representative"), F.col("near.distance").alias("distance"))


def bins(df: DataFrame, key: str = "vec_id", label: str = "label", singles: bool = True) -> DataFrame:
    """``label, members``: the keys of each cluster in order; with ``singles`` off only clusters of several."""
    out = df.groupBy(label).agg(F.array_sort(F.collect_list(key)).alias("members"))
    return out if singles else out.where(F.size("members") > 1)


def members(df: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """``label, place, key``: the members of each cluster in order, one row each, for clusters of any size."""
    place = F.struct(label, key)
    every = numbered(df.select(label, key, place.alias("_o")), "_o", "_n")
    first = every.groupBy(label).agg(F.min("_n").alias("_first"))
    return every.join(first, label).select(label, (F.col("_n") - F.col("_first")).alias("place"), key)


def distortion(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """``distortion``, the mean distance to the nearest centre, and ``inertia``, the sum of squared distances to the own."""
    every = centres(df, label, vec).agg(F.collect_list("centre")).scalar()  # one entry for each cluster
    nearest = F.array_min(F.transform("_centres", lambda c: l2(F.col(vec), c)))
    inertia = with_distance(df, label, vec, 15).agg(F.sum(F.col("distance") * F.col("distance")))
    return df.withColumn("_centres", every).agg(F.avg(nearest).alias("distortion")).withColumn("inertia", inertia.scalar())


def silhouette(df: DataFrame, key: str = "vec_id", label: str = "label", vec: str = "embedding", block: int = 1_024) -> DataFrame:
    """``silhouette``: the mean Euclidean silhouette over all rows; a row alone in its cluster counts 0.

    Distances to every row of every cluster are summed in pairs of blocks; only sums by row and cluster leave a block.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).alias("vec")).where("vec is not null")
    n = -(-max(1, rows.count()) // block)
    a = rows.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    b = rows.withColumn("pb", F.pmod(F.xxhash64("id"), F.lit(n))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    a, b = (d.select(*(F.col(c).alias(c) for c in ("id", "label", "vec", "qb", "pb"))) for d in (a, b))

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "own": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
        x, y = (t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1) for t in (left, right))
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
        d[left.column("id").to_numpy()[:, None] == right.column("id").to_numpy()] = 0
        labels, at = np.unique(right.column("label").to_numpy(), return_inverse=True)
        hot = np.zeros((len(y), len(labels)))
        hot[np.arange(len(y)), at] = 1
        total = d @ hot
        return pa.table({"id": pa.array(np.repeat(left.column("id").to_numpy(), len(labels))), "own": pa.array(np.repeat(left.column("label").to_numpy(), len(labels))), "other": pa.array(np.tile(labels, len(x))), "total": pa.array(total.ravel())})

    parts = a.groupBy("qb", "pb").cogroup(b.groupBy("qb", "pb")).applyInArrow(sums, "id bigint, own bigint, other bigint, total double")
    by_cluster = parts.groupBy("id", "own", "other").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n"))
    mean = by_cluster.join(F.broadcast(sizes), "other")
    inner = F.max(F.when(F.col("own") == F.col("other"), F.col("total") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a")
    outer = F.min(F.when(F.col("own") != F.col("other"), F.col("total") / F.col("n"))).alias("b")
    each = mean.groupBy("id").agg(inner, outer).select(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))).alias("s"))
    return each.agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("silhouette"))


def kmeans(df: DataFrame, k: int = N_CLUSTERS, seed: int = 0, vec: str = "embedding"):
    """The fitted model and the rows with their ``cluster``."""
    rows = df.where(F.col(vec).isNotNull()).withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows)
    return model, model.transform(rows).drop("features")


def elbow(df: DataFrame, ks: Iterable[int] = ELBOW, key: str = "vec_id", vec: str = "embedding", seed: int = 0, at_once: int = 6) -> DataFrame:
    """``k, inertia, distortion, silhouette`` for each number of clusters, with one fit for each, ``at_once`` at a time.

    Numbers of clusters that the rows cannot fill are left out; only the four numbers of each k come to the driver.
    """
    rows = cut(df.where(F.col(vec).isNotNull()).select(key, vec), "elbow")
    spark, n = rows.sparkSession, rows.count()

    def one(k: int) -> tuple[int, float, float, float]:
        model, marked = kmeans(rows, k, seed, vec)
        own = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
        d = marked.join(F.broadcast(own), "cluster").agg(F.avg(l2(vec, "centre"))).first()[0]
        return k, float(model.summary.trainingCost), float(d), float(silhouette(marked, key, "cluster", vec).first()[0])

    with ThreadPoolExecutor(at_once) as pool:
        lines = list(pool.map(inheritable_thread_target(spark)(one), [k for k in ks if k < n]))
    return spark.createDataFrame(lines, "k int, inertia double, distortion double, silhouette double")
