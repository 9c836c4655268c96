"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, leak, neighbours, overlap, pairs, pii, radix, truncation
from corvane.session import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(load(spark, sf_dir, "gold"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.report(load(spark, sf_dir, "gold"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found(load(spark, sf_dir, "gold"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.report(load(spark, sf_dir, "gold"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pairs(load(spark, sf_dir, "req_vectors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.find_copies(load(spark, sf_dir, "gold"))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.collapse(load(spark, sf_dir, "gold"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found(load(spark, sf_dir, "gold"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(load(spark, sf_dir, "gold"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(load(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.mark_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def _tagger(spark: SparkSession, sf_dir: str) -> pii.Tagger | None:
    return pii.trained(load(spark, sf_dir, "documents"), load(spark, sf_dir, "given_names"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(load(spark, sf_dir, "documents"), _tagger(spark, sf_dir))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(load(spark, sf_dir, "documents"), _tagger(spark, sf_dir))


QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p1_report, p2_found, p2_report, p4_found, p5_found, p5_collapsed, p6_found, p6_report, p7_ids, p8_found, p8_cleaned, p9_found, p9_redacted)}

_LETTERS = "regexp_replace(lower(nfc_normalize({0})), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_ENTRIES = f"list_sort(list_filter(list_transform(string_split_regex(req || ';' || coalesce(headers, ''), '[;>|]'), lambda t: {_LETTERS.format('t')}), lambda t: t <> ''))"
_GROUPS = f"SELECT pos, min(pos) OVER (PARTITION BY k) AS first_pos FROM (SELECT pos, {_ENTRIES} AS k FROM gold WHERE req IS NOT NULL AND pos IS NOT NULL)"
_RUNS = "SELECT DISTINCT {0}, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {0}, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM {1} WHERE text IS NOT NULL))"

SQL: dict[str, str] = {
    "p4_found": "WITH v AS (SELECT pos, CAST(min(vec) AS DOUBLE[]) AS x FROM req_vectors WHERE len(vec) = 64 GROUP BY pos), "
    "n AS (SELECT a.pos AS p, b.pos AS q, row_number() OVER (PARTITION BY a.pos ORDER BY list_distance(a.x, b.x), b.pos) AS r FROM v a JOIN v b ON a.pos <> b.pos) "
    "SELECT DISTINCT least(p, q) AS pos_a, greatest(p, q) AS pos_b FROM n WHERE r <= 5",
    "p5_found": f"SELECT first_pos, pos AS copy_pos FROM ({_GROUPS}) WHERE pos <> first_pos",
    "p5_collapsed": f"SELECT first_pos, count(*) AS n_copies FROM ({_GROUPS}) GROUP BY first_pos",
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_RUNS.format('doc_id', 'documents')}) JOIN ({_RUNS.format('item_id', 'eval_items')}) USING (run)",
}
