"""Ordered series: outliers, min-max scaling, running sums, linear trends with a band.

A series is a set of rows (series, x, y). Aggregates that only need totals are group-bys joined back on the series (two
small exchanges); only numbering and the running sum need the rows of a series in order. There, blocks of consecutive
places are counted or summed in parallel and shifted by the blocks before, so even one very long series spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 3.0
BLOCK = 65_536


def _blocks(df: DataFrame, series: list[str], place: str, block: int, total: Column) -> DataFrame:
    """The rows with ``_block``, consecutive ranges of ``place``, and ``_before``, the total over all earlier blocks."""
    s = df.withColumn("_block", F.floor(F.col(place) / block))
    sums = s.groupBy(*series, "_block").agg(total.alias("_sum"))
    before = Window.partitionBy(*series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*series, "_block", F.sum("_sum").over(before).alias("_before"))
    return s.join(sums, [*series, "_block"])


def _numbered(df: DataFrame, series: list[str], place: str, tie: str, block: int) -> DataFrame:
    """``x`` = 0, 1, ... in the order of ``place``, then ``tie``."""
    inside = Window.partitionBy(*series, "_block").orderBy(place, tie)
    x = F.row_number().over(inside) - 1 + F.coalesce("_before", F.lit(0))
    return _blocks(df, series, place, block, F.count(F.lit(1))).withColumn("x", x.cast("long")).drop("_block", "_before")


def points(ordered: DataFrame, series: list[str], place: str, value: str, block: int = BLOCK) -> DataFrame:
    """``series..., x, y`` with x = 0, 1, ... in the order of ``place`` within each series (ties: by value).

    ``place`` is a number that is near enough unique, so that a range of ``block`` places is one task's work.
    """
    rows = ordered.where(F.col(value).isNotNull() & F.col(place).isNotNull()).select(*series, F.col(place).alias("_place"), F.col(value).cast("double").alias("y"))
    return _numbered(rows, series, "_place", "y", block).select(*series, "x", "y")


def _with(df: DataFrame, series: list[str], *aggregates) -> DataFrame:
    return df.join(df.groupBy(*series).agg(*aggregates), series)


def without_outliers(df: DataFrame, series: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Rows within ``threshold`` population deviations of the mean; a series without spread is kept whole."""
    s = _with(df, series, F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"))
    far = F.abs(F.col("y") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return s.where(F.coalesce(far <= threshold, F.lit(True))).drop("_m", "_s")


def renumbered(df: DataFrame, series: list[str], block: int = BLOCK) -> DataFrame:
    return _numbered(df.withColumnRenamed("x", "_place"), series, "_place", "y", block).select(*series, "x", "y")


def normalised(df: DataFrame, series: list[str]) -> DataFrame:
    """y scaled to 0..1; NULL in a series without spread."""
    s = _with(df, series, F.min("y").alias("_a"), F.max("y").alias("_b"))
    return s.withColumn("y", (F.col("y") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))).drop("_a", "_b")


def cumulative(df: DataFrame, series: list[str], block: int = BLOCK) -> DataFrame:
    """``y`` as a running total in the order of x."""
    inside = Window.partitionBy(*series, "_block").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    s = _blocks(df, series, "x", block, F.sum("y"))
    return s.withColumn("y", F.sum("y").over(inside) + F.coalesce("_before", F.lit(0.0))).drop("_block", "_before")


def trend(df: DataFrame, series: list[str]) -> DataFrame:
    """``series..., slope, intercept, band``: the least-squares line of y on x and the deviation of what it leaves."""
    lines = df.groupBy(*series).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    rest = df.join(lines, series).withColumn("_r", F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept")))
    return rest.groupBy(*series).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.stddev_pop("_r").alias("band"))


def banded(df: DataFrame, series: list[str]) -> DataFrame:
    """Every point with its trend and the band around it: ``y, fit, low, high``."""
    fit = F.col("slope") * F.col("x") + F.col("intercept")
    return df.join(trend(df, series), series).select(*series, "x", "y", fit.alias("fit"), (fit - F.col("band")).alias("low"), (fit + F.col("band")).alias("high"))


def pipeline(df: DataFrame, series: list[str], outliers: bool = True, scale: bool = True, add_up: bool = True) -> DataFrame:
    """Outliers, then scaling, then the running sum, then trend and band."""
    if outliers:
        df = renumbered(without_outliers(df, series), series)
    if scale:
        df = normalised(df, series)
    if add_up:
        df = cumulative(df, series)
    return banded(df, series)
