"""Session helpers: table loading, the shared folder, and cutting a lineage with a written table."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent (a local test session) a temporary folder is taken, which is right because a
    local session has one machine; a cluster session without the setting is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"corvane-{os.getpid()}")
    return f"file://{path}"


_CUTS: list[str] = []


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` has written so far, and tells how many there were.

    To be called once the results that were made from them have been written or collected.
    """
    n = 0
    while _CUTS:
        _remove(spark, _CUTS.pop())
        n += 1
    return n


def _at_exit(spark: SparkSession) -> None:
    if _CUTS and spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        release(spark)


def cut(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read again.

    The result has no lineage but that table, so a lost executor costs a re-read and nothing is computed twice. The
    table goes with ``release``, or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{what}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    if not _CUTS:
        atexit.register(_at_exit, spark)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def parquet_rows(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows of one file of a table, in its order, read within a task. ``path``: as in ``_metadata.file_path``."""
    store, name = pa_fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        yield from pq.ParquetFile(f).iter_batches(rows, columns=columns, use_threads=False)


def bounded_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, the ones with the lowest hash of ``keys``, so the same ones however the data are cut.

    Rows that cannot be among them are dropped by the hash alone first, so that the tasks don't each offer ``rows`` rows.
    """
    n = df.count()
    key = F.xxhash64(*keys)
    if n > 2 * rows:
        share = min(1.0, (1.2 * rows + 5 * rows**0.5) / n)
        df = df.where(key < F.lit(int(-(2**63) + share * 2**64)))
    return df.orderBy(key, *keys).limit(rows)
