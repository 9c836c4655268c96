"""Record sets: presence-aware filters, views by id, and joins between record sets.

An absent key is NULL, a present but empty one ''; no filter confuses the two. All filters are plain predicates, so they
reach the scan. Ids may repeat: ``by_id`` gives the set view (last record of an id, at its first position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut

# Words for no and yes in the ignore column.
NOT_IGNORED = ("false", "no", "0")
VETOED = ("yes", "1", "true")


def kept(ignore: Column | str = "ignore_flag") -> Column:
    """Not to be ignored: absent, or a word for no. An empty ignore drops the record."""
    c = F.col(ignore) if isinstance(ignore, str) else ignore
    return c.isNull() | F.lower(c).isin(*NOT_IGNORED)


def annotated(ignore: str = "ignore_flag", fprime: str = "f_prime") -> Column:
    """The annotator's stricter rule: kept and with a correct formula, empty or not."""
    return kept(ignore) & F.col(fprime).isNotNull()


def present(column: str) -> Column:
    return F.col(column).isNotNull()


def eligible(f: str = "f", fprime: str = "f_prime", ignore: str = "ignore_flag", strict: bool = True) -> Column:
    """Can the record be scored? ``strict`` also asks for a correct formula that isn't empty."""
    c = kept(ignore) & present(f) & present(fprime)
    return c & (F.col(fprime) != "") if strict else c


def sampled_by_id(ignore: str = "ignore_flag", fprime: str = "f_prime") -> Column:
    """The rule for samples named by id: vetoed only by a word for yes, or without a correct formula."""
    c = F.col(ignore)
    return present(fprime) & ~F.coalesce(F.lower(c).isin(*VETOED), F.lit(False))


def scored(df: DataFrame, scores: dict[str, Column], f: str = "f", fprime: str = "f_prime", **rule) -> DataFrame:
    """Adds or replaces score columns; records that can't be scored keep NULL and stay.

    The texts of such records are set to NULL before the scores see them: scores of NULL are NULL, and outside of a
    condition Catalyst computes what several scores share once.
    """
    can = eligible(f, fprime, **rule)
    held = {f"_{c}": F.col(c) for c in (f, fprime)}
    return df.withColumns(held | {c: F.when(can, F.col(c)) for c in (f, fprime)}).withColumns(scores).withColumns({c: F.col(f"_{c}") for c in (f, fprime)}).drop(*held)


def blanked(df: DataFrame, column: str) -> DataFrame:
    """'' wherever the column is present."""
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.lit("")))


def by_id(df: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """One row for each id that isn't NULL: the last record's values, with ``first_pos``, the place in the set's order."""
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("last")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_pos"), last).select(key, "first_pos", "last.*")


def in_order(df: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """The list view: every record, by id, then by position."""
    return df.where(F.col(key).isNotNull()).orderBy(key, order)


def unseen(records: DataFrame, pool: DataFrame, key: str = "id") -> DataFrame:
    """Records whose id the pool doesn't have (NULL ids are unseen)."""
    return records.join(pool.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def inconsistent(pool: DataFrame, records: DataFrame, key: str = "id", text: str = "req") -> DataFrame:
    """``key, reason``: ids of the pool that the records lack ('missing') or that have another text there ('differs')."""
    have = records.select(key, F.col(text).alias("theirs"), F.lit(True).alias("there"))
    both = pool.select(key, text).join(have, key, "left")
    reason = F.when(F.col("there").isNull(), "missing").when(~F.col(text).eqNullSafe(F.col("theirs")), "differs")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def ordered(data: DataFrame, order: DataFrame, value: str, key: str = "id") -> DataFrame:
    """The order list joined with the data: ids that repeat repeat, unknown ids and records without ``value`` drop out.

    Both sides shuffle on the id only if Spark finds neither small enough to send.
    """
    return order.join(data.where(F.col(value).isNotNull()).select(key, value), key)


def by_id_list(data: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """The records of a configured id list that may be sampled, with their ``place`` in it."""
    spark = data.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), f"place int, {key} bigint")
    return wanted.join(data.where(sampled_by_id()), key)


def point(data: DataFrame, key: int | None = None, seed: int | None = None, column: str = "id") -> DataFrame:
    """One record: that of ``key``; else a random one by ``seed``; else that of the lowest id."""
    if key is not None:
        return data.where(F.col(column) == key)
    if seed is not None:
        return data.orderBy(F.xxhash64(F.col(column), F.lit(seed)), column).limit(1)
    return data.orderBy(column).limit(1)


def paired(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Pairs row n of one set with row n of the other. Positions come from a range sort, not from one window."""
    return numbered(left, left_order).join(numbered(right, right_order), "n")


def numbered(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    """``name`` = 0, 1, ... in the order of a column, without gathering the rows in one task.

    Range partitions are numbered each for itself and shifted by the sizes of those before; only one number for each
    partition goes through a single task.
    """
    spread = df.withColumn("_order", F.col(order)).repartitionByRange("_order").sortWithinPartitions("_order")
    local = spread.withColumn("_part", F.spark_partition_id())
    # written once, since another evaluation might cut the partitions elsewhere
    local = cut(local.withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)).drop("_order"), "numbered")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")
