"""Readers and writers: flat files of ``key: value`` lines, JSON lines, order lists, texts.

Files are split on the executors: a line knows its file, the block of the file its task read, and its place there. A running
count of the ``id`` lines in each block, plus those of the blocks before (a few numbers a file), gives each line its
record, so that even a single file of any size spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.records import numbered

# The keys of a record in the writer's order, with the columns that hold them.
KEYS = (
    ("id", "id"), ("req", "req"), ("headers", "headers"), ("F", "f"), ("F-prime", "f_prime"), ("C", "c"), ("C-prime", "c_prime"), ("wer", "wer"),
    ("jaccard", "jaccard"), ("semantic", "semantic"), ("parts", "parts"), ("correct", "correct"), ("graph_edit", "graph_edit"),
    ("norm_graph_edit", "norm_graph_edit"), ("delta", "delta"), ("edit", "edit"), ("norm_edit", "norm_edit"), ("ter", "ter"), ("chrf", "chrf"),
    ("note", "note"), ("ignore", "ignore_flag"),
)
LIST_KEYS = ("id", "req", "headers", "F", "F-prime", "wer", "delta", "note", "ignore")
ALWAYS = ("F", "F-prime")


def records_of(files: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """``name, record_no, id, kv``: the records in flat-file texts.

    A line is cut at ': '. One piece: a key with its colons taken out and an empty value; more than two: the value's
    pieces are joined by a blank, so inner colons are lost. An ``id`` line opens a record; lines before the first one and
    blank lines belong to none; of a repeated key the last value counts. An id that isn't a whole number is NULL.
    """
    lines = files.select(F.col(name).alias("name"), F.lit(0).cast("bigint").alias("block"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line"))
    return _records(lines)


def _records(lines: DataFrame) -> DataFrame:
    """The records of lines (name, block, at, line); ``at`` orders the lines of a block, ``block`` those of a name."""
    pieces = F.split(F.trim(F.regexp_replace("line", r"[\t\r]", " ")), ": ", -1)
    key = F.when(F.size(pieces) == 1, F.regexp_replace(pieces[0], ":", "")).otherwise(pieces[0])
    value = F.when(F.size(pieces) == 1, "").otherwise(F.array_join(F.slice(pieces, 2, F.greatest(F.lit(1), F.size(pieces) - 1)), " "))
    cut = lines.select("name", "block", "at", key.alias("key"), value.alias("value"))
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy("name", "block").agg(F.count_if(F.col("key") == "id").alias("ids")).select("name", "block", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids"))
    running = F.count_if(F.col("key") == "id").over(Window.partitionBy("name", "block").orderBy("at"))
    placed = cut.withColumn("running", running).join(blocks, ["name", "block"]).withColumn("record_no", F.col("ids") + F.col("running"))
    inside = placed.where("record_no > 0 and key <> ''")
    last = inside.groupBy("name", "record_no", "key").agg(F.max_by("value", F.struct("block", "at")).alias("value"))
    grouped = last.groupBy("name", "record_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("kv"))
    return grouped.select("name", "record_no", F.expr("try_cast(kv['id'] as bigint)").alias("id"), "kv")


def wide(records: DataFrame) -> DataFrame:
    """Known keys as columns; an absent key is NULL, an empty one ''."""
    rest = [F.col("kv")[k].alias(c) for k, c in KEYS if c != "id"]
    return records.select("name", F.col("record_no").alias("pos"), "id", *rest)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return wide(_records(lines.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))))


def _line(key: str, column: str, present: set[str], always: bool) -> Column:
    if column not in present:
        return F.lit(f"{key}:\n") if always else F.lit("")
    c = F.col(column).cast("string")
    return F.when(c.isNull(), F.lit(f"{key}:\n" if always else "")).otherwise(F.concat(F.lit(f"{key}: "), c, F.lit("\n")))


def rendered(df: DataFrame, canonical: bool = True, number: Column | None = None) -> Column:
    """A record's block. Canonical: all known keys in order, F and F-prime always; else the list writer's keys, if present.

    ``number``: what stands for an absent id, the record's place in the list.
    """
    present = set(df.columns)
    if number is not None:
        own = F.coalesce(F.col("id"), number) if "id" in present else number
        rest = [(k, c) for k, c in KEYS if k != "id" and (canonical or k in LIST_KEYS)]
        return F.concat(F.lit("id: "), own.cast("string"), F.lit("\n"), *(_line(k, c, present, canonical and k in ALWAYS) for k, c in rest), F.lit("\n"))
    keys = [(k, c) for k, c in KEYS if canonical or k in LIST_KEYS]
    return F.concat(*(_line(k, c, present, canonical and k in ALWAYS) for k, c in keys), F.lit("\n"))


def write_flat(df: DataFrame, path: str, order: str, canonical: bool = True, one_file: bool = False) -> None:
    """A folder whose files, by name, hold the blocks in the order of a column; ``one_file`` merges them into one.

    The list writer numbers the records and writes the number where there is no id.
    """
    if not canonical:
        df = numbered(df, order, "_number")
    text = rendered(df, canonical, None if canonical else F.col("_number"))
    blocks = df.select(order, F.regexp_replace(text, "\n$", "").alias("value"))
    blocks = blocks.orderBy(order).coalesce(1) if one_file else blocks.orderBy(order)
    blocks.select("value").write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; req and headers fall back on meta.org and meta.headers."""
    kind = "id bigint, req string, headers string, F string, `F-prime` string, note string, ignore string, meta struct<org:string,headers:string>"
    rows = spark.read.schema(kind).option("caseSensitive", "true").json(path).withColumn("name", F.col("_metadata.file_name"))
    return rows.select("name", "id", F.coalesce("req", "meta.org").alias("req"), F.coalesce("headers", "meta.headers").alias("headers"), F.col("F").alias("f"), F.col("`F-prime`").alias("f_prime"), "note", F.col("ignore").alias("ignore_flag"))


def jsonl_of(records: DataFrame) -> DataFrame:
    """``name, record_no, value``: one JSON object for each flat-file record, all values texts, empty ones left out."""
    full = F.map_filter("kv", lambda k, v: v != "")
    return records.select("name", "record_no", F.to_json(full).alias("value"))


def flat_from_json(spark: SparkSession, path: str, out: str) -> None:
    """A file or folder of JSON lines to flat files, one folder for each source file."""
    rows = read_jsonl(spark, path)
    rows.select("name", F.regexp_replace(rendered(rows.drop("name"), False), "\n$", "").alias("value")).write.mode("overwrite").partitionBy("name").text(out)


def read_order(spark: SparkSession, path: str) -> DataFrame:
    """``seq, id``: one whole number a line; blank lines and other text are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return lines.select(F.col("at").alias("seq"), F.expr("try_cast(trim(line) as bigint)").alias("id")).where("id is not null")


def append_order(df: DataFrame, path: str, key: str = "id") -> None:
    df.select(F.col(key).cast("string").alias("value")).write.mode("append").text(path)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    """Prompts, reports, statistics documents: one text a row."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
