"""Pieces of SQL that several of the catalogue's statements share."""

from __future__ import annotations

KEPT = "(ignore_flag IS NULL OR lower(ignore_flag) IN ('false', 'no', '0'))"
ELIGIBLE = f"({KEPT} AND f IS NOT NULL AND f_prime IS NOT NULL AND f_prime <> '')"
DELIVERED = (
    "SELECT run_no, id, metric, score FROM annotation_scores QUALIFY row_number() OVER (PARTITION BY run_no, id, metric "
    "ORDER BY loaded_at DESC NULLS LAST, scored_at DESC NULLS LAST, score DESC NULLS LAST) = 1"
)
FIRST_RUN = (
    f"d AS ({DELIVERED}), s AS (SELECT * FROM d WHERE (id, metric) IN "
    "(SELECT (id, metric) FROM d WHERE run_no = (SELECT min(run_no) FROM d) AND score IS NOT NULL))"
)
BY_ID = "SELECT *, min(pos) OVER (PARTITION BY id) AS first_pos FROM gold WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1"
SERIES = (
    f"d AS ({DELIVERED}), p AS (SELECT o.run_no, metric, row_number() OVER (PARTITION BY o.run_no, metric ORDER BY o.seq, score) - 1 AS x, "
    "CAST(score AS DOUBLE) AS y FROM experiment_order o JOIN d ON d.run_no = o.run_no AND d.id = o.id WHERE score IS NOT NULL)"
)
OUTLIERS = "o AS (SELECT * FROM (SELECT *, avg(y) OVER w AS m, stddev_pop(y) OVER w AS s FROM p WINDOW w AS (PARTITION BY run_no, metric)) WHERE coalesce(abs(y - m) / nullif(s, 0) <= 3, true))"


def tokens(c: str) -> str:
    c = f"replace(replace({c}, '[', ' '), ']', '')"
    c = f"regexp_replace({c}, '([∃∀¬])', '\\1 ', 'g')"
    c = f"regexp_replace({c}, '([≥≤=][0-9])', '\\1 ', 'g')"
    return f"string_split_regex(replace(replace({c}, '(', ''), ')', ''), '[ .]')"


def coded(items: str, vocabulary: str) -> str:
    """One ASCII character for each item; holds up to 94 different items a pair."""
    return f"array_to_string(list_transform({items}, lambda t: chr(CAST(32 + list_position({vocabulary}, t) AS INTEGER))), '')"


def pieces(source: str, keys: str) -> str:
    """Pieces of ``t`` between ⊓, ⊔ and ⊑ outside parentheses, for every row (keys, t) of ``source``; rows (keys, piece)."""
    return (
        f"SELECT DISTINCT {keys}, trim(coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT sep), '')) AS piece FROM (SELECT *, sum(CAST(sep AS INTEGER)) OVER (PARTITION BY {keys} ORDER BY i) AS part FROM ("
        f"SELECT *, depth = 0 AND c IN ('⊓', '⊔', '⊑') AS sep FROM (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i) AS depth FROM ("
        f"SELECT {keys}, unnest(CASE WHEN t = '' THEN [''] ELSE string_split(t, '') END) AS c, unnest(range(greatest(1, length(t)))) AS i FROM {source})))) GROUP BY {keys}, part"
    )
