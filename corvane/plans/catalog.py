"""The core queries by name, and the SQL that gives the same rows. Every query reads its tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import distances, formula, graph
from corvane.operators import clusters, measures, nearest, prompts, records, rejects, reports, sampling, series, stats
from corvane.plans import sql
from corvane.session import cut, load
from corvane.sources import flatfile
from corvane.streaming import pool

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "jaccard_scores"

N_SAMPLES = 20
CONFIGURED_IDS = list(range(5, 105, 5))
KEYS = ["run_no", "metric"]


def query(statement: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- rows that fail to parse


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.faulty_rows(load(spark, d, "gold_raw"))


@query()
def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load_rows(load(spark, d, "gold_raw")).where("reason is null").drop("reason")


# ---- records: filters, views, joins


@query(
    f"SELECT pos, {sql.KEPT} AS kept, {sql.KEPT} AND f_prime IS NOT NULL AS annotated, f_prime IS NOT NULL AS has_fprime, {sql.ELIGIBLE} AS eligible, "
    f"{sql.KEPT} AND f IS NOT NULL AND f_prime IS NOT NULL AS eligible_loose, f_prime IS NOT NULL AND NOT coalesce(lower(ignore_flag) IN ('yes', '1', 'true'), false) AS sampled FROM gold"
)
def record_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = {"kept": records.kept(), "annotated": records.annotated(), "has_fprime": records.present("f_prime"), "eligible": records.eligible(), "eligible_loose": records.eligible(strict=False), "sampled": records.sampled_by_id()}
    return load(spark, d, "gold").select("pos", *(c.alias(n) for n, c in flags.items()))


@query(f"SELECT id, first_pos, req, f, f_prime FROM ({sql.BY_ID})")
def record_set(spark: SparkSession, d: str) -> DataFrame:
    return records.by_id(load(spark, d, "gold").select("id", "pos", "req", "f", "f_prime")).select("id", "first_pos", "req", "f", "f_prime")


@query("SELECT id, pos, row_number() OVER (ORDER BY id, pos) - 1 AS n FROM gold WHERE id IS NOT NULL")
def sorted_records(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "gold").where("id is not null").select("id", "pos", F.struct("id", "pos").alias("o"))
    return records.numbered(rows, "o").select("id", "pos", "n")


@query("SELECT pos, CASE WHEN f IS NOT NULL THEN '' END AS f FROM gold")
def blanked_answers(spark: SparkSession, d: str) -> DataFrame:
    return records.blanked(load(spark, d, "gold").select("pos", "f"), "f")


@query("SELECT pos, id FROM gold WHERE split = 'test' AND NOT coalesce(id IN (SELECT id FROM gold WHERE split = 'train' AND id IS NOT NULL), false)")
def unseen_records(spark: SparkSession, d: str) -> DataFrame:
    gold = load(spark, d, "gold").select("pos", "id", "split")
    return records.unseen(gold.where("split = 'test'").select("pos", "id"), gold.where("split = 'train'").select("id")).select("pos", "id")


_SET_OF = "SELECT id, req FROM gold WHERE id IS NOT NULL AND split IN ({}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1"


@query(
    f"SELECT p.id, CASE WHEN r.id IS NULL THEN 'missing' ELSE 'differs' END AS reason FROM ({_SET_OF.format("'train'")}) p LEFT JOIN ({_SET_OF.format("'test', 'validation'")}) r ON p.id = r.id WHERE r.id IS NULL OR p.req IS DISTINCT FROM r.req"
)
def inconsistent_records(spark: SparkSession, d: str) -> DataFrame:
    gold = load(spark, d, "gold").select("id", "pos", "req", "split")
    train, rest = gold.where("split = 'train'"), gold.where("split in ('test', 'validation')")
    return records.inconsistent(records.by_id(train).select("id", "req"), records.by_id(rest).select("id", "req"))


@query(f"SELECT run_no, seq, o.id, f_prime FROM experiment_order o JOIN ({sql.BY_ID}) g ON g.id = o.id WHERE f_prime IS NOT NULL")
def order_join(spark: SparkSession, d: str) -> DataFrame:
    data = records.by_id(load(spark, d, "gold").select("id", "pos", "f_prime"))
    return records.ordered(data, load(spark, d, "experiment_order"), "f_prime").select("run_no", "seq", "id", "f_prime")


@query(
    f"SELECT CAST(list_position({CONFIGURED_IDS}, id) - 1 AS INTEGER) AS place, id, req FROM ({sql.BY_ID}) WHERE id IN ({', '.join(map(str, CONFIGURED_IDS))}) AND f_prime IS NOT NULL AND NOT coalesce(lower(ignore_flag) IN ('yes', '1', 'true'), false)"
)
def configured_samples(spark: SparkSession, d: str) -> DataFrame:
    data = records.by_id(load(spark, d, "gold").select("id", "pos", "req", "f_prime", "ignore_flag"))
    return records.by_id_list(data, CONFIGURED_IDS).select("place", "id", "req")


@query(f"SELECT 'named' AS how, id, req FROM ({sql.BY_ID}) WHERE id = 7 UNION ALL SELECT 'lowest', id, req FROM ({sql.BY_ID}) WHERE id = (SELECT min(id) FROM gold)")
def point_lookups(spark: SparkSession, d: str) -> DataFrame:
    data = records.by_id(load(spark, d, "gold").select("id", "pos", "req"))
    return records.point(data, 7).select(F.lit("named").alias("how"), "id", "req").unionByName(records.point(data).select(F.lit("lowest").alias("how"), "id", "req"))


@query("SELECT a.pos AS train_pos, b.pos AS test_pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM gold WHERE split = 'train') a JOIN (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM gold WHERE split = 'test') b USING (n)")
def paired_records(spark: SparkSession, d: str) -> DataFrame:
    gold = load(spark, d, "gold").select("pos", "split")
    sides = [gold.where(F.col("split") == s).select(F.col("pos").alias(f"{s}_pos")) for s in ("train", "test")]
    return records.paired(*sides, "train_pos", "test_pos").select("train_pos", "test_pos")


# ---- formula text


@query(f"SELECT pos, array_to_string({sql.tokens('f')}, '¦') AS tokens, len({sql.tokens('f')}) AS n, len(list_distinct({sql.tokens('f')})) AS n_distinct, len(string_split_regex(f, '[. ]')) > 600 AS too_long FROM gold WHERE f IS NOT NULL")
def formula_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = formula.tokens("f")
    rows = load(spark, d, "gold").where("f is not null")
    return rows.select("pos", F.array_join(t, "¦").alias("tokens"), F.size(t).cast("bigint").alias("n"), F.size(formula.token_set("f")).cast("bigint").alias("n_distinct"), formula.too_long("f").alias("too_long"))


@query(sql.pieces("(SELECT pos, f_prime AS t FROM gold WHERE f_prime IS NOT NULL)", "pos"))
def formula_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "gold").where("f_prime is not null")
    return rows.select("pos", F.explode(formula.parts("f_prime")).alias("piece"))


# ---- scores


def _scored(spark: SparkSession, d: str, **scores) -> DataFrame:
    rows = load(spark, d, "gold").select("pos", "f", "f_prime", "ignore_flag")
    return records.scored(rows, scores).drop("f", "f_prime", "ignore_flag")


_TF, _TG = sql.tokens("f"), sql.tokens("f_prime")


@query(
    f"SELECT pos, CASE WHEN {sql.ELIGIBLE} THEN round(1 - i / u, 6) END AS jaccard, CASE WHEN {sql.ELIGIBLE} THEN round(i / u, 6) END AS jaccard_index FROM "
    f"(SELECT *, CAST(len(list_intersect(list_distinct({_TF}), list_distinct({_TG}))) AS DOUBLE) AS i, len(list_distinct({_TF} || {_TG})) AS u FROM gold)"
)
def jaccard_scores(spark: SparkSession, d: str) -> DataFrame:
    index = _scored(spark, d, jaccard_index=distances.jaccard_index("f", "f_prime"))
    return _rounded(index.withColumn("jaccard", F.lit(1.0) - F.col("jaccard_index")), "jaccard", "jaccard_index")


_WF, _WG = (f"list_filter(string_split_regex({c}, '[\\s\\x{{00A0}}]+'), lambda w: w <> '')" for c in ("f", "f_prime"))


@query(
    f"SELECT pos, round(wer, 6) AS wer, CASE WHEN wer IS NOT NULL THEN round(least(1.0, wer), 6) END AS wer_max FROM (SELECT pos, CASE WHEN {sql.ELIGIBLE} THEN levenshtein({sql.coded('a', 'v')}, {sql.coded('b', 'v')}) / CAST(nullif(len(b), 0) AS DOUBLE) END AS wer FROM "
    f"(SELECT *, list_distinct(a || b) AS v FROM (SELECT *, {_WF} AS a, {_WG} AS b FROM gold)))"
)
def wer_scores(spark: SparkSession, d: str) -> DataFrame:
    rates = _scored(spark, d, wer=distances.word_error_rate("f", "f_prime"))
    return _rounded(rates.withColumn("wer_max", F.when(F.col("wer").isNotNull(), F.least(F.lit(1.0), "wer"))), "wer", "wer_max")


@query(
    f"SELECT pos, CAST(edit AS BIGINT) AS edit, round(edit / CAST(n AS DOUBLE), 6) AS norm_edit FROM (SELECT pos, n, CASE WHEN {sql.ELIGIBLE} THEN least(damerau_levenshtein({sql.coded('a', 'v')}, {sql.coded('b', 'v')}), n - CAST(list_contains(b, '') AS INTEGER)) END AS edit FROM "
    f"(SELECT *, list_distinct(a || b) AS v, len(b) AS n FROM (SELECT *, {_TF} AS a, {_TG} AS b FROM gold)))"
)
def edit_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = records.scored(load(spark, d, "gold").select("pos", "f", "f_prime", "ignore_flag"), {"edit": distances.edit("f", "f_prime")})
    return _rounded(rows.select("pos", F.col("edit").cast("bigint").alias("edit"), distances.norm_edit(F.col("edit"), "f_prime").alias("norm_edit")), "norm_edit")


_SIDES = f"(SELECT pos, side, who, string_split(CASE who WHEN 'f' THEN f ELSE f_prime END, '⊑')[side] AS t FROM gold, (VALUES (1), (2)) s(side), (VALUES ('f'), ('g')) w(who) WHERE {sql.ELIGIBLE} AND contains(f, '⊑') AND contains(f_prime, '⊑'))"


@query(
    f"WITH p AS ({sql.pieces(_SIDES, 'pos, side, who')}), g AS (SELECT pos, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM p q WHERE q.pos = p.pos AND q.side = p.side AND q.who = 'f' AND q.piece = p.piece)) AS same FROM p WHERE who = 'g' GROUP BY pos) "
    "SELECT pos, round(1 - same / CAST(n AS DOUBLE), 6) AS parts FROM gold LEFT JOIN g USING (pos)"
)
def changed_parts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d, parts=distances.changed_parts("f", "f_prime")), "parts")


@query()
def ter_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d, ter=distances.ter("f", "f_prime")), "ter")


@query(
    f"WITH t AS (SELECT pos, regexp_replace(f, '[\\s\\x{{00A0}}]', '', 'g') AS p, regexp_replace(f_prime, '[\\s\\x{{00A0}}]', '', 'g') AS g FROM gold WHERE {sql.ELIGIBLE}), "
    "a AS (SELECT pos, n, substr(p, i, n) AS x, count(*) AS c FROM (SELECT pos, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM t, range(1, 7) r(n)) GROUP BY ALL), "
    "b AS (SELECT pos, n, substr(g, i, n) AS x, count(*) AS c FROM (SELECT pos, g, n, unnest(range(1, length(g) - n + 2)) AS i FROM t, range(1, 7) r(n)) GROUP BY ALL), "
    "s AS (SELECT pos, n, sum(least(a.c, b.c)) AS same FROM a JOIN b USING (pos, n, x) GROUP BY ALL), na AS (SELECT pos, n, sum(c) AS c FROM a GROUP BY ALL), nb AS (SELECT pos, n, sum(c) AS c FROM b GROUP BY ALL), "
    "o AS (SELECT pos, avg(coalesce(same, 0) / CAST(na.c AS DOUBLE)) AS pr, avg(coalesce(same, 0) / CAST(nb.c AS DOUBLE)) AS re FROM na JOIN nb USING (pos, n) LEFT JOIN s USING (pos, n) GROUP BY pos) "
    f"SELECT pos, CASE WHEN {sql.ELIGIBLE} THEN round(coalesce(100 * 5 * pr * re / nullif(4 * pr + re, 0), 0), 6) END AS chrf FROM gold LEFT JOIN o USING (pos)"
)
def chrf_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d, chrf=distances.chrf("f", "f_prime")), "chrf")


@query()
def graph_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "gold").where("f_prime is not null").select("pos", graph.parsed("f_prime").alias("g"))
    return rows.select("pos", F.inline("g.nodes"))


@query()
def graph_edit_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = records.scored(load(spark, d, "gold").select("pos", "f", "f_prime", "ignore_flag"), {"graph_edit": graph.graph_edit("f", "f_prime"), "size": graph.graph_size("f_prime")})
    return rows.select("pos", "graph_edit", F.round(F.col("graph_edit") / F.nullif("size", F.lit(0)), 6).alias("norm_graph_edit"))


@query(
    "SELECT a.vec_id, round(list_cosine_similarity(x, y), 6) AS cosine, round(1 - list_cosine_similarity(x, y), 6) AS semantic, round(list_distance(x, y), 6) AS l2 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings) b USING (vec_id)"
)
def semantic_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return pairs.select("vec_id", *(F.round(f("x", "y"), 6).alias(n) for n, f in (("cosine", distances.cosine_similarity), ("semantic", distances.semantic), ("l2", distances.l2))))


_MEASURED = " JOIN ".join(f"({SQL[n]}) {n} USING (pos)" for n in ("wer_scores", "edit_scores", "changed_parts", "chrf_scores"))


@query(f"SELECT pos, jaccard, wer_max AS wer, edit, parts, chrf FROM ({SQL['jaccard_scores']}) j JOIN {_MEASURED}")
def measured(spark: SparkSession, d: str) -> DataFrame:
    """Several metrics by their names in one pass."""
    rows = load(spark, d, "gold").select("pos", "f", "f_prime", "ignore_flag")
    names = ["jaccard", "wer", "edit", "parts", "chrf"]
    got = measures.evaluated(rows, names, wer_max=True).select("pos", *names)
    return _rounded(got.withColumn("edit", F.col("edit").cast("bigint")), "jaccard", "wer", "parts", "chrf")


@query(f"SELECT pos, CASE WHEN {sql.ELIGIBLE} THEN round(CASE WHEN pos % 2 = 0 THEN pos ELSE edit END / CAST(len({_TG}) AS DOUBLE), 6) END AS norm_edit FROM gold JOIN ({SQL['edit_scores']}) USING (pos)")
def normalised_measures(spark: SparkSession, d: str) -> DataFrame:
    """Distances that some records already have are taken as they are."""
    rows = load(spark, d, "gold").select("pos", "f", "f_prime", "ignore_flag", F.when(F.col("pos") % 2 == 0, F.col("pos")).alias("edit"))
    return _rounded(measures.evaluated(rows, ["jaccard", "edit"], normalize=True).select("pos", "norm_edit"), "norm_edit")


# ---- neighbours and prompts

_KNN = (
    "SELECT q.vec_id AS id, p.vec_id AS other, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 9) AS distance FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0"
)
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM ({_KNN})"


@query(f"SELECT id, other, distance, CAST(rank AS INTEGER) AS rank FROM ({_RANKED}) WHERE rank <= {N_SAMPLES}")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every row whose id is divisible by 50, against all rows."""
    e = load(spark, d, "embeddings")
    return nearest.nearest(e.where("vec_id % 50 = 0"), e, N_SAMPLES, "vec_id", "embedding")


@query(f"SELECT id, string_agg(CAST(other AS VARCHAR), ' ' ORDER BY rank DESC) AS others FROM ({_RANKED}) WHERE rank <= {N_SAMPLES} GROUP BY id")
def knn_farthest_first(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    found = nearest.nearest(e.where("vec_id % 50 = 0"), e, N_SAMPLES, "vec_id", "embedding")
    return nearest.in_sorting(found, "desc").select("id", F.array_join("others", " ").alias("others"))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    """Records with a vector: the position is id and order, usable are those with a correct formula."""
    vectors = load(spark, d, "req_vectors").where(F.size("vec") == 64).groupBy("pos").agg(F.min("vec").alias("vec"))
    rows = load(spark, d, "gold").select("pos", F.col("f_prime").isNotNull().alias("usable"))
    return vectors.join(rows, "pos").select(F.col("pos").alias("id"), F.col("pos").alias("seq"), "vec", "usable")


_POOL = (
    "v AS (SELECT pos AS id, CAST(min(vec) AS DOUBLE[]) AS vec FROM req_vectors WHERE len(vec) = 64 GROUP BY pos), e AS (SELECT v.id, vec, f_prime IS NOT NULL AS usable, row_number() OVER (ORDER BY v.id) - 1 AS m FROM v JOIN gold g ON g.pos = v.id), "
    "n AS (SELECT a.id, a.m, b.id AS other, round(list_distance(a.vec, b.vec), 9) AS distance FROM e a JOIN e b ON b.id < a.id WHERE b.usable OR a.m = 1), "
    f"k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM n) WHERE rank <= least(greatest(m - 1, 1), {N_SAMPLES}))"
)


@query(f"WITH {_POOL} SELECT id, other, distance, CAST(rank AS INTEGER) AS rank FROM k")
def growing_pool(spark: SparkSession, d: str) -> DataFrame:
    return nearest.few_shot(_embedded(spark, d), N_SAMPLES)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _none(c: str) -> str:
    return f"coalesce({c}, 'None')"


@query(
    f"WITH {_POOL}, s AS (SELECT k.id, string_agg('Input: ' || {_none('g.req')} || chr(10) || 'Headers: ' || {_none('g.headers')} || chr(10) || 'Output: ' || {_none('g.f_prime')} || chr(10) || chr(10), '' ORDER BY rank DESC) AS t FROM k JOIN gold g ON g.pos = k.other GROUP BY k.id) "
    f"SELECT e.id, {_quoted(prompts.FORMULA_PREFIX)} || coalesce(t, '') || 'Input: ' || {_none('g.req')} || chr(10) || 'Headers: ' || {_none('g.headers')} || chr(10) || 'Output:' AS prompt FROM e JOIN gold g ON g.pos = e.id LEFT JOIN s ON s.id = e.id"
)
def fewshot_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, sorting="desc")


def _similar(spark: SparkSession, d: str, **how) -> DataFrame:
    """Prompts of the records with a vector; samples come from among them."""
    embedded = _embedded(spark, d)
    gold = load(spark, d, "gold").select(F.col("pos").alias("id"), "req", "headers", "f_prime")
    asked = cut(embedded.select("id").join(gold, "id"), "asked")
    return prompts.generated(asked, asked, "most similar", neighbours=nearest.few_shot(embedded, N_SAMPLES), **how)


@query(
    f"WITH {_POOL}, s AS (SELECT k.id, string_agg({_none('g.req')} || ':' || {_none('g.f_prime')} || ', ', '' ORDER BY rank) AS t FROM k JOIN gold g ON g.pos = k.other GROUP BY k.id) "
    f"SELECT e.id, {_quoted(prompts.FORMULA_CHAT_PREFIX)} || coalesce(t, '') || {_quoted(prompts.FORMULA_CHAT_SUFFIX)} || {_none('g.req')} AS prompt FROM e JOIN gold g ON g.pos = e.id LEFT JOIN s ON s.id = e.id"
)
def similar_chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, style="formula chat")


@query(
    f"WITH {_POOL}, s AS (SELECT k.id, string_agg('Requirement: ' || {_none('g.req')} || chr(10) || 'Concepts: ' || {_none('g.f_prime')} || chr(10), '' ORDER BY rank) AS t FROM k JOIN gold g ON g.pos = k.other GROUP BY k.id) "
    f"SELECT e.id, {_quoted(prompts.CONCEPT_CHAT_PREFIX)} || coalesce(t, '') || 'My first requirement is: ' || {_none('g.req')} || chr(10) || 'Concepts:' AS prompt FROM e JOIN gold g ON g.pos = e.id LEFT JOIN s ON s.id = e.id"
)
def concept_chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, style="concepts chat", headers=False)


_IDS_SAMPLES = f"s AS (SELECT string_agg({_none('req')} || ':' || {_none('f_prime')} || ', ', '' ORDER BY list_position({CONFIGURED_IDS}, id)) AS t FROM ({sql.BY_ID}) WHERE id IN ({', '.join(map(str, CONFIGURED_IDS))}) AND f_prime IS NOT NULL AND NOT coalesce(lower(ignore_flag) IN ('yes', '1', 'true'), false))"


@query(f"WITH {_IDS_SAMPLES} SELECT pos, {_quoted(prompts.FORMULA_CHAT_PREFIX)} || coalesce((SELECT t FROM s), '') || {_quoted(prompts.FORMULA_CHAT_SUFFIX)} || {_none('req')} AS prompt FROM gold")
def chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    gold = load(spark, d, "gold")
    samples = prompts.fixed_samples(records.by_id(gold.select("id", "pos", "req", "headers", "f_prime", "ignore_flag")), "ids", CONFIGURED_IDS)
    return gold.select("pos", "req").withColumn("samples", samples.scalar()).select("pos", prompts.prompt("samples", "req", style="formula chat").alias("prompt"))


@query(
    f"WITH s AS (SELECT string_agg('Requirement: ' || {_none('req')} || chr(10) || 'Headers: ' || {_none('headers')} || chr(10) || 'Concepts: ' || {_none('f_prime')} || chr(10) || chr(10), '' ORDER BY id) AS t FROM (SELECT * FROM ({sql.BY_ID}) WHERE f_prime IS NOT NULL ORDER BY md5(id || ':0'), id LIMIT 5)) "
    f"SELECT pos, {_quoted(prompts.CONCEPT_PREFIX)} || coalesce((SELECT t FROM s), '') || 'Requirement: ' || {_none('req')} || chr(10) || 'Headers: ' || {_none('headers')} || chr(10) || 'Concepts:' AS prompt FROM gold"
)
def concept_prompts(spark: SparkSession, d: str) -> DataFrame:
    gold = load(spark, d, "gold")
    pool_rows = records.by_id(gold.select("id", "pos", "req", "headers", "f_prime")).where("f_prime is not null")
    samples = prompts.fixed_samples(pool_rows, "random", n=5)
    return gold.select("pos", "req", "headers").withColumn("samples", samples.scalar()).select("pos", prompts.prompt("samples", "req", "headers", "concepts").alias("prompt"))


@query("SELECT pos, CASE WHEN req IS NULL THEN NULL WHEN length(req) % 3 = 0 THEN '' ELSE 'A ⊑ ' || length(req) || '|again' END AS f FROM gold")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """The model call with a stand-in that answers by the prompt's length: choices joined, empty ones asked again, then ''."""

    def stand_in(texts: list[str]) -> list[list[str]]:
        return [["A ⊑ ", str(len(t)), "|again"] if len(t) % 3 else [" "] for t in texts]

    got = prompts.answered(load(spark, d, "gold").select("pos", "req"), stand_in, "req")
    return got.select("pos", F.when(F.trim("f") == "", "").otherwise(F.col("f")).alias("f"))


# ---- statistics over runs


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    return stats.delivered(load(spark, d, "annotation_scores"))


@query(f"WITH {sql.FIRST_RUN} SELECT id, metric, count(score) AS n_runs, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM s GROUP BY id, metric")
def run_record_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.per_record(_delivered(spark, d)), "mean", "std")


_TOTALS = "r AS (SELECT run_no, metric, count(score) AS n, sum(score) AS total, avg(score) AS mean FROM s GROUP BY run_no, metric)"


@query(f"WITH {sql.FIRST_RUN}, {_TOTALS} SELECT run_no, metric, n, round(total, 6) AS total, round(mean, 6) AS mean FROM r")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.per_run(_delivered(spark, d)), "total", "mean")


_SUMMARY = "SELECT metric, round(avg(total), 6) AS mean_sum, round(stddev_pop(total), 6) AS std_sum, round(avg(mean), 6) AS mean_mean, round(stddev_pop(mean), 6) AS std_mean FROM r GROUP BY metric"
_FOUR = ("mean_sum", "std_sum", "mean_mean", "std_mean")


@query(f"WITH {sql.FIRST_RUN}, {_TOTALS} {_SUMMARY}")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.across_runs(_delivered(spark, d)), *_FOUR)


@query(f"WITH {sql.FIRST_RUN}, {_TOTALS} {_SUMMARY}")
def statistics_document(spark: SparkSession, d: str) -> DataFrame:
    """The statistics written as JSON texts and read back."""
    return _rounded(stats.undocument(stats.document(_delivered(spark, d))), *_FOUR)


@query(f"SELECT metric, round(sum(score), 6) AS score_sum, round(avg(score), 6) AS score_ave FROM ({sql.DELIVERED}) GROUP BY metric")
def metric_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.report(_delivered(spark, d), ["score"], "metric"), "score_sum", "score_ave")


@query("SELECT max(n) AS data_len FROM (SELECT run_no, count(DISTINCT id) AS n FROM annotation_scores GROUP BY run_no)")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return stats.longest(load(spark, d, "annotation_scores"))


# ---- series


def _points(spark: SparkSession, d: str) -> DataFrame:
    data = load(spark, d, "experiment_order").join(_delivered(spark, d), ["run_no", "id"])
    return series.points(data, KEYS, "seq", "score")


@query(f"WITH {sql.SERIES} SELECT run_no, metric, x, y FROM p")
def series_points(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d)


@query(f"WITH {sql.SERIES}, {sql.OUTLIERS} SELECT run_no, metric, x, y FROM o")
def series_outliers(spark: SparkSession, d: str) -> DataFrame:
    return series.without_outliers(_points(spark, d), KEYS)


@query(f"WITH {sql.SERIES} SELECT run_no, metric, x, round((y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0), 6) AS y FROM p WINDOW w AS (PARTITION BY run_no, metric)")
def series_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.normalised(_points(spark, d), KEYS), "y")


@query(f"WITH {sql.SERIES} SELECT run_no, metric, x, round(sum(y) OVER (PARTITION BY run_no, metric ORDER BY x), 6) AS y FROM p")
def series_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.cumulative(_points(spark, d), KEYS), "y")


_LINE = "l AS (SELECT run_no, metric, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM {0} GROUP BY run_no, metric), t AS (SELECT run_no, metric, slope, intercept, stddev_pop(y - (slope * x + intercept)) AS band FROM {0} JOIN l USING (run_no, metric) GROUP BY ALL)"


@query(f"WITH {sql.SERIES}, {_LINE.format('p')} SELECT run_no, metric, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(band, 6) AS band FROM t")
def series_trend(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.trend(_points(spark, d), KEYS), "slope", "intercept", "band")


@query(
    f"WITH {sql.SERIES}, {sql.OUTLIERS}, q AS (SELECT run_no, metric, row_number() OVER (PARTITION BY run_no, metric ORDER BY x) - 1 AS x, (y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0) AS y FROM o WINDOW w AS (PARTITION BY run_no, metric)), "
    f"c AS (SELECT run_no, metric, x, sum(y) OVER (PARTITION BY run_no, metric ORDER BY x) AS y FROM q), {_LINE.format('c')} SELECT run_no, metric, x, round(y, 6) AS y, round(slope * x + intercept, 6) AS fit, round(slope * x + intercept - band, 6) AS low, round(slope * x + intercept + band, 6) AS high FROM c JOIN t USING (run_no, metric)"
)
def series_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.pipeline(_points(spark, d), KEYS), "y", "fit", "low", "high")


# ---- clusters

_CENTRE = "c AS (SELECT label, list(v ORDER BY i) AS centre FROM (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label), e AS (SELECT vec_id, label, round(list_distance(CAST(embedding AS DOUBLE[]), centre), 9) AS distance FROM embeddings JOIN c USING (label))"


@query(f"WITH {_CENTRE} SELECT label, count(*) AS size, arg_min(vec_id, (distance, vec_id)) AS representative, round(min(distance), 6) AS distance FROM e GROUP BY label")
def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(clusters.representatives(load(spark, d, "embeddings")), "distance")


@query("SELECT label, string_agg(CAST(vec_id AS VARCHAR), ' ' ORDER BY vec_id) AS members FROM embeddings GROUP BY label")
def cluster_bins(spark: SparkSession, d: str) -> DataFrame:
    return clusters.bins(load(spark, d, "embeddings")).select("label", F.array_join("members", " ").alias("members"))


@query("SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, vec_id FROM embeddings")
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    return clusters.members(load(spark, d, "embeddings"))


@query(
    f"WITH {_CENTRE} SELECT round((SELECT avg(m) FROM (SELECT min(list_distance(CAST(embedding AS DOUBLE[]), centre)) AS m FROM embeddings, c GROUP BY vec_id)), 6) AS distortion, round((SELECT sum(list_distance(CAST(embedding AS DOUBLE[]), centre) ** 2) FROM embeddings JOIN c USING (label)), 6) AS inertia"
)
def cluster_distortion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(clusters.distortion(load(spark, d, "embeddings")), "distortion", "inertia")


@query(
    "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), m AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS total, count(*) AS n FROM v a, v b GROUP BY ALL), "
    "s AS (SELECT vec_id, max(CASE WHEN label = other THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN label <> other THEN total / n END) AS b FROM m GROUP BY vec_id) "
    "SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM s"
)
def cluster_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(clusters.silhouette(load(spark, d, "embeddings")), "silhouette")


@query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.kmeans(load(spark, d, "embeddings"))[1].select("vec_id", "cluster")


@query()
def kmeans_elbow(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(clusters.elbow(load(spark, d, "embeddings")), "inertia", "distortion", "silhouette")


@query(
    "SELECT id AS label, string_agg('id: ' || pos || chr(10) || 'req: ' || coalesce(req, '') || chr(10) || 'F-prime: ' || coalesce(f_prime, '') || chr(10) || chr(10), '' ORDER BY pos) AS text FROM gold WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1"
)
def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    """Records delivered under the same id, as a cluster report."""
    rows = load(spark, d, "gold").where("id is not null").select(F.col("id").alias("label"), F.col("pos").alias("id"), "req", "f_prime")
    return reports.cluster_blocks(rows)


# ---- samples, splits, orders


@query(f"SELECT id FROM ({sql.BY_ID}) ORDER BY md5(id || ':0'), id LIMIT {N_SAMPLES}")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(records.by_id(load(spark, d, "gold").select("id", "pos")), N_SAMPLES).select("id")


@query("SELECT pos, CASE WHEN n < floor(0.8 * t) THEN 'train' ELSE 'validation' END AS part FROM (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS n, count(*) OVER () AS t FROM gold)")
def prefix_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.prefix_split(load(spark, d, "gold").select("pos"), "pos").select("pos", "part")


@query("SELECT pos, f_prime FROM gold WHERE f_prime IS NOT NULL ORDER BY pos LIMIT 10")
def first_predictions(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head(load(spark, d, "gold").where("f_prime is not null").select("pos", "f_prime"), "pos", 10)


@query(
    f"SELECT id, row_number() OVER (ORDER BY coalesce(list_position({CONFIGURED_IDS}, id) - 1, {len(CONFIGURED_IDS)}), first_pos) AS seq FROM ({sql.BY_ID})"
)
def iteration_order(spark: SparkSession, d: str) -> DataFrame:
    data = records.by_id(load(spark, d, "gold").select("id", "pos"))
    return sampling.iteration(data, CONFIGURED_IDS, "first_pos").select("id", "seq")


# ---- files and reports


def _flat_sql(canonical: bool) -> str:
    def line(key: str, c: str, always: bool) -> str:
        return f"CASE WHEN {c} IS NULL THEN '{key + ':' if always else ''}' || {'chr(10)' if always else repr('')} ELSE '{key}: ' || {c} || chr(10) END"

    keys = (("id", "id"), ("req", "req"), ("headers", "headers"), ("F", "f"), ("F-prime", "f_prime"), ("note", "note"), ("ignore", "ignore_flag"))
    return " || ".join(line(k, c, canonical and k in flatfile.ALWAYS) for k, c in keys) + " || chr(10)"


@query(f"SELECT pos, {_flat_sql(True)} AS text FROM gold")
def flat_text(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "gold").select("pos", "id", "req", "headers", "f", "f_prime", "note", "ignore_flag")
    return rows.select("pos", flatfile.rendered(rows).alias("text"))


@query(f"SELECT pos, {_flat_sql(False)} AS text FROM (SELECT * REPLACE (coalesce(id, row_number() OVER (ORDER BY pos) - 1) AS id) FROM gold)")
def flat_text_list(spark: SparkSession, d: str) -> DataFrame:
    rows = records.numbered(load(spark, d, "gold").select("pos", "id", "req", "headers", "f", "f_prime", "note", "ignore_flag"), "pos")
    return rows.select("pos", flatfile.rendered(rows, False, F.col("n")).alias("text"))


_FLAT = (
    "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE kind = 'flat' AND text IS NOT NULL), "
    "p AS (SELECT doc_id, place, string_split(trim(regexp_replace(line, '[\\t\\r]', ' ', 'g')), ': ') AS s FROM l), "
    "k AS (SELECT doc_id, place, CASE WHEN len(s) = 1 THEN replace(s[1], ':', '') ELSE s[1] END AS key, CASE WHEN len(s) = 1 THEN '' ELSE array_to_string(s[2:], ' ') END AS value FROM p), "
    "r AS (SELECT *, sum(CAST(key = 'id' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY place) AS record_no FROM k), "
    "u AS (SELECT doc_id, record_no, key, value FROM r WHERE record_no > 0 AND key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, record_no, key ORDER BY place DESC) = 1)"
)


def _flat_records(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "documents").where("kind = 'flat' and text is not null").select(F.col("doc_id").alias("name"), "text")
    return flatfile.records_of(files)


@query(f"WITH {_FLAT} SELECT doc_id, CAST(record_no AS BIGINT) AS record_no, key, value FROM u")
def flat_records(spark: SparkSession, d: str) -> DataFrame:
    """The documents of kind flat, read as flat files."""
    return _flat_records(spark, d).select(F.col("name").alias("doc_id"), "record_no", F.explode("kv").alias("key", "value"))


@query(
    f"WITH {_FLAT} SELECT r.doc_id, CAST(r.record_no AS BIGINT) AS record_no, '{{' || coalesce(string_agg(CAST(to_json(key) AS VARCHAR) || ':' || CAST(to_json(value) AS VARCHAR), ',' ORDER BY key) FILTER (value <> ''), '') || '}}' AS value FROM u r GROUP BY ALL"
)
def jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    return flatfile.jsonl_of(_flat_records(spark, d)).withColumnRenamed("name", "doc_id")


def _score_table(spark: SparkSession, d: str) -> DataFrame:
    """Run 0's scores as one row for each id of its order."""
    scores = _delivered(spark, d).where("run_no = 0 and score is not null")
    wide = scores.groupBy("id").pivot("metric", list(stats.METRICS)).agg(F.max("score"))
    return load(spark, d, "experiment_order").where("run_no = 0").select("seq", "id").join(wide, "id")


_WIDE = f"w AS (SELECT id, {', '.join(f"max(score) FILTER (metric = '{m}') AS {m}" for m in stats.METRICS)} FROM ({sql.DELIVERED}) WHERE run_no = 0 AND score IS NOT NULL GROUP BY id), t AS (SELECT seq, w.* FROM experiment_order o JOIN w ON w.id = o.id WHERE run_no = 0)"


def _num(c: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace(CAST(round(CAST({c} AS DECIMAL(24,8)), 2) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '.0'), '')"


_CELLS = " || ' & ' || "


@query(
    f"WITH {_WIDE} SELECT {_quoted(reports.TABLE_HEAD)} || coalesce(string_agg('    ' || id || ' & ' || CAST(edit AS INTEGER) || ' & ' || {_num('wer')} || ' & ' || {_num('jaccard')} || ' & ' || {_num('semantic')} || ' \\\\' || chr(10), '' ORDER BY seq, id) FILTER (edit IS NOT NULL), '') || {_quoted(reports.TABLE_RULE)} || "
    f"'    sum & ' || {_CELLS.join(_num(f'sum({c})') for c in reports.COLUMNS)} || '\\\\' || chr(10) || {_quoted(reports.TABLE_RULE)} || '    average & ' || {_CELLS.join(_num(f'avg({c})') for c in reports.COLUMNS)} || '\\\\' || chr(10) || {_quoted(reports.TABLE_TAIL)} AS text FROM t"
)
def latex_table(spark: SparkSession, d: str) -> DataFrame:
    return reports.latex_table(_score_table(spark, d))


def _macros_sql(ends: tuple[tuple[str, str], ...], value: str) -> str:
    return " || ".join(f"'\\newcommand*\\exp{name}{end}{{' || coalesce(printf('%.6f', {value.format(c=c, m=m)}), '') || '}}'" for name, m in reports.MACROS for end, c in ends)


@query(f"WITH {_WIDE} SELECT {_macros_sql((('', 'sum'), ('Ave', 'avg')), '{c}({m})')} AS text FROM t")
def latex_macros(spark: SparkSession, d: str) -> DataFrame:
    return reports.latex_macros(_score_table(spark, d), "exp")


@query(
    f"WITH {sql.FIRST_RUN}, {_TOTALS}, a AS (SELECT metric, avg(total) AS mean_sum, stddev_pop(total) AS std_sum, avg(mean) AS mean_mean, stddev_pop(mean) AS std_mean FROM r GROUP BY metric) "
    f"SELECT {_macros_sql((('', 'mean_sum'), ('Std', 'std_sum'), ('Ave', 'mean_mean'), ('AveStd', 'std_mean')), "max({c}) FILTER (metric = '{m}')")} AS text FROM a"
)
def latex_run_macros(spark: SparkSession, d: str) -> DataFrame:
    return reports.latex_run_macros(stats.across_runs(_delivered(spark, d)), "exp")


@query("SELECT coalesce(f_prime, '') || chr(10) || '-->' || chr(9) || coalesce(f, '') AS text FROM gold WHERE f IS NOT NULL")
def prediction_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.prediction_lines(load(spark, d, "gold").where("f is not null"), "f_prime", "f")


# ---- the pool as a stream


@query(
    f"SELECT id, pos, req, headers, f_prime FROM gold WHERE {sql.KEPT} AND id IS NOT NULL AND f_prime IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1"
)
def streamed_pool(spark: SparkSession, d: str) -> DataFrame:
    return pool.pool_of(spark, f"{d}/gold.parquet")
