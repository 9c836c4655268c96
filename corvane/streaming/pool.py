"""The growing pool as a stream: requirements arrive in files, each batch joins the pool on disk and is never seen twice.

The pool is a Parquet table in the shared folder, written batch by batch under its batch number, so a batch that runs
again after a failure replaces itself; the stream's own checkpoint remembers which files were read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corvane.operators.records import kept
from corvane.session import shared_dir


def grow(stream: DataFrame, pool: str, checkpoint: str, key: str = "id") -> DataStreamWriter:
    """A writer that appends the unseen, kept records of each batch to the pool's folder."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = rows.where(kept() & F.col(key).isNotNull() & F.col("f_prime").isNotNull())
        fresh = fresh.groupBy(key).agg(F.min_by(F.struct("pos", "req", "headers", "f_prime"), "pos").alias("r")).select(key, "r.*")
        try:
            known = spark.read.parquet(pool).where(F.col("batch") < number).select(key)
            fresh = fresh.join(known, key, "left_anti")
        except Exception as e:  # noqa: BLE001 - the pool's folder comes with the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{pool}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def source_stream(spark: SparkSession, source: str, kind, files_per_batch: int) -> DataFrame:
    """The files of a folder as a stream; a single file is read from its own folder, by its name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(source)
    return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())


def pool_of(spark: SparkSession, source: str, files_per_batch: int = 4) -> DataFrame:
    """Runs the stream over all files that are there, then gives the pool: ``id, pos, req, headers, f_prime``."""
    base = f"{shared_dir(spark)}/corvane-stream-{uuid.uuid4().hex[:12]}"
    kind = spark.read.parquet(source).schema
    stream = source_stream(spark, source, kind, files_per_batch)
    query = grow(stream, f"{base}/pool", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/pool").select("id", "pos", "req", "headers", "f_prime")


def windowed_counts(stream: DataFrame, late: str = "1 day", width: str = "30 days") -> DataFrame:
    """``window, metric, n, mean`` of scores as they come, with a watermark for late ones."""
    timed = stream.where("scored_at is not null and score is not null").withWatermark("scored_at", late)
    return timed.groupBy(F.window("scored_at", width), "metric").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
