"""Reports as text: LaTeX tables and macros, cluster and prediction reports. Each is one row, or a row for each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of the long table and the macros' names.
TABLE_HEAD = "\\begin{longtable}{ccccc}\\toprule\n    id & distance & wer & jaccard & semantic\\\\ \\midrule\n"
TABLE_RULE = "    \\midrule\n"
TABLE_TAIL = "    \\bottomrule\n\\end{longtable}\n"
MACROS = (("Distance", "edit"), ("GraphDistance", "graph_edit"), ("Wer", "wer"), ("Jaccard", "jaccard"), ("Semantic", "semantic"))
COLUMNS = ("edit", "wer", "jaccard", "semantic")


def number(c: Column, digits: int = 2) -> Column:
    """A number as text, rounded half up on its decimal digits, without needless zeros."""
    text = F.round(c.cast("decimal(24,8)"), digits).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ".0")


def latex_table(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """``text``: the long table of the rows that have an edit distance, with sums and averages over those that have each score."""
    line = F.concat(F.lit("    "), F.col(key).cast("string"), F.lit(" & "), F.col("edit").cast("int").cast("string"), *(x for c in COLUMNS[1:] for x in (F.lit(" & "), F.coalesce(number(F.col(c)), F.lit("")))), F.lit(" \\\\\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("edit").isNotNull(), F.struct(F.col(order).alias("o"), F.col(key).alias("k"), line.alias("l"))))), lambda x: x.l), "")

    def summary(word: str, f) -> Column:
        cells = [x for c in COLUMNS for x in (F.lit(" & "), F.coalesce(number(f(c)), F.lit("")))]
        return F.concat(F.lit(f"    {word}"), *cells, F.lit("\\\\\n"))

    return rows.agg(F.concat(F.lit(TABLE_HEAD), body, F.lit(TABLE_RULE), summary("sum", F.sum), F.lit(TABLE_RULE), summary("average", F.avg), F.lit(TABLE_TAIL)).alias("text"))


def _macro(prefix: str, name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\\newcommand*\\{prefix}{name}{{"), F.coalesce(F.format_string("%.6f", value.cast("double")), F.lit("")), F.lit("}"))


def latex_macros(rows: DataFrame, prefix: str) -> DataFrame:
    """``text``: sum and average of five scores as macros, one after the other."""
    parts = []
    for name, c in MACROS:
        parts += [_macro(prefix, name, F.sum(c)), _macro(prefix, f"{name}Ave", F.avg(c))]
    return rows.agg(F.concat(*parts).alias("text"))


def latex_run_macros(statistics: DataFrame, prefix: str) -> DataFrame:
    """``text``: the four statistics over runs of five scores as macros; ``statistics`` as from ``stats.across_runs``."""
    parts = []
    for name, metric in MACROS:
        of = lambda c: F.max(F.when(F.col("metric") == metric, F.col(c)))  # noqa: E731, B023
        parts += [_macro(prefix, f"{name}{end}", of(c)) for end, c in (("", "mean_sum"), ("Std", "std_sum"), ("Ave", "mean_mean"), ("AveStd", "std_mean"))]
    return statistics.agg(F.concat(*parts).alias("text"))


def cluster_blocks(members: DataFrame, label: str = "label", key: str = "id") -> DataFrame:
    """``label, text``: the records of each cluster of several, as blocks of id, req and F-prime."""
    block = F.concat(F.lit("id: "), F.col(key).cast("string"), F.lit("\nreq: "), F.coalesce("req", F.lit("")), F.lit("\nF-prime: "), F.coalesce("f_prime", F.lit("")), F.lit("\n\n"))
    out = members.groupBy(label).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), block.alias("b")))), lambda x: x.b), "").alias("text"))
    return out.where("n > 1").select(label, "text")


def prediction_lines(rows: DataFrame, left: str, right: str, arrow: str = "\n-->\t") -> DataFrame:
    """``text``: what was given and what was predicted, one block for each row."""
    return rows.select(F.concat(F.coalesce(left, F.lit("")), F.lit(arrow), F.coalesce(right, F.lit(""))).alias("text"))
