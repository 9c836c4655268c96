"""Few-shot prompts as columns, and the model call as a pluggable column function.

A prompt is a prefix, the samples in their order and the query; a sample list is an array of structs, so building a
prompt is one expression in the JVM. Only the samples' keys are shuffled: their texts, twenty times the input or more, are
looked up last, by the tasks, in a table of the pool that is written once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.session import cut, parquet_rows

STRATEGIES = ("most similar", "ids", "random")

# The texts around the samples, which a language model's answers depend on word by word.
FORMULA_PREFIX = (
    "Below are some inputs and the outputs of a semantic parser of industry standards. It always transforms a sentence into its correct "
    "corresponding logical representation. The input is a requirement from an industry standard. The output is a logical representation in "
    "description logic (DL) format. The ouput represents classes, properties, individuals and restrictions. The symbols used in the DL syntax "
    "are: ∃, ⊑, ⊓, ⊔, and ¬. On the left-hand side of the ⊑ is most often a physical object and possibly a condition on the object. The "
    "right-hand side of the ⊑ is what is demanded of the object on the left side.\n\n"
)
FORMULA_CHAT_PREFIX = (
    "I want you to act as a Semantic Parser.I will type in textual requirements and you will reply with a logical representation in "
    "description logic format (DL syntax). Your output should be in a standard syntax and use the appropriate constructs for representing "
    "classes, properties, individuals, and restrictions. The only logical operators you are allowed to use are: ∃, ⊑, ⊓, ⊔ and ¬. All outputs "
    "should be in form of a subclass axiom on the form A ⊑ B where A and B can be complex class descriptions. The left hand side of the ⊑ is "
    "typically a physical object and possibly a condition on the object, and the right hand side is what is demanded of the physical object on "
    "the left side. It is possible that one requirement must be translated to more than one formula. In that case, return all formulas, "
    "separated by | Some examples of correct description logic formulas are: "
)
FORMULA_CHAT_SUFFIX = (
    "Do not include redundant or extraneous information. Do not write explanations. Your reply should be a direct representation of the input "
    "requirement. My first requirement is: "
)
CONCEPT_PREFIX = (
    "You are an Information Extractor of industry standards. I will provide a requirement along with the headers from the document tree, and "
    "you will reply with a the important concpets that will be used in a downstream application translating the requirement to a logical "
    "representation. You need to identify class names and the relations between classes all class names are camel case starting with an "
    "uppercase letter, all relations are camel cased starting with a lowercase letter."
)
CONCEPT_CHAT_PREFIX = CONCEPT_PREFIX + (
    " Do not include redundant or extraneous information. Do not write explanations. Do not make your assumptions explicit. Your reply should "
    "be one string with all important concepts from the input requirement. Here are some examples: "
)
STYLES = ("formula", "formula chat", "concepts", "concepts chat")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit("None"))


def prompt(samples: Column | str, req: Column | str, headers: Column | str | None = None, style: str = "formula") -> Column:
    """The prompt of a record. ``samples``: array of structs (req, headers, answer) in order; an absent text reads None.

    Without ``headers`` neither the samples' nor the query's headers are shown. Concept samples without an answer show none.
    """
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}")
    s, r = (F.col(c) if isinstance(c, str) else c for c in (samples, req))
    h = F.col(headers) if isinstance(headers, str) else headers
    if style == "formula chat":
        shown = F.transform(s, lambda x: F.concat(_text(x.req), F.lit(":"), _text(x.answer), F.lit(", ")))
        return F.concat(F.lit(FORMULA_CHAT_PREFIX), F.array_join(shown, ""), F.lit(FORMULA_CHAT_SUFFIX), _text(r))
    word, answer = ("Input", "Output") if style == "formula" else ("Requirement", "Concepts")
    end = "\n" if style == "concepts chat" else "\n\n"
    header = lambda c: F.concat(F.lit("Headers: "), _text(c), F.lit("\n")) if h is not None else F.lit("")

    def one(x: Column) -> Column:
        closing = F.concat(F.lit(f"{answer}: "), _text(x.answer), F.lit(end))
        if style == "concepts":
            closing = F.when(x.answer.isNotNull(), closing).otherwise("")
        return F.concat(F.lit(f"{word}: "), _text(x.req), F.lit("\n"), header(x.headers), closing)

    prefix = {"formula": FORMULA_PREFIX, "concepts": CONCEPT_PREFIX, "concepts chat": CONCEPT_CHAT_PREFIX}[style]
    lead = "My first requirement is" if style == "concepts chat" else word
    return F.concat(F.lit(prefix), F.array_join(F.transform(s, one), ""), F.lit(f"{lead}: "), _text(r), F.lit("\n"), header(h), F.lit(f"{answer}:"))


def with_samples(neighbours: DataFrame, pool: DataFrame, sorting: str = "asc", seed: int = 0, answer: str = "f_prime", key: str = "id") -> DataFrame:
    """``id, samples``: each record's neighbours (id, other, rank) as an array of structs in the order asked for."""
    return looked_up(_listed(neighbours, sorting, seed), pool, answer, key)


def _listed(neighbours: DataFrame, sorting: str, seed: int) -> DataFrame:
    """``id, others``: the keys of each record's neighbours in the order asked for."""
    rank = {"desc": -F.col("rank"), "random": F.xxhash64("id", "other", F.lit(seed))}.get(sorting, F.col("rank").cast("long"))
    return neighbours.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "other"))), lambda x: x.other.cast("long")).alias("others"))


def looked_up(rows: DataFrame, pool: DataFrame, answer: str = "f_prime", key: str = "id", refs: int = 1 << 17, most: int = 96 << 20) -> DataFrame:
    """``rows`` with ``samples`` in place of ``others``: the pool's texts in the order of those keys; keys it lacks drop out.

    The pool's texts are written once, sorted by key. A task takes rows until they have ``refs`` keys, reads that table once
    for all of them and keeps what they name; rows that name more than ``most`` bytes are halved and read for separately.
    """
    texts = pool.select(F.col(key).cast("long").alias("other"), "req", "headers", F.col(answer).alias("answer")).where("other is not null")
    order = ["other", "req", "headers", "answer"]
    table = cut(texts.repartitionByRange("other").sortWithinPartitions(*order), "samples")
    files = table.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("other").alias("first"), F.max("other").alias("last")).collect()
    files = sorted(map(tuple, files), key=lambda f: f[1])
    item = StructType([StructField(c, table.schema[c].dataType) for c in order[1:]])
    shape = StructType([f for f in rows.schema if f.name != "others"] + [StructField("samples", ArrayType(item))])
    to = to_arrow_schema(shape)
    kind = to.field("samples").type

    def named(keys: np.ndarray) -> tuple[pa.Table | None, int]:
        """The rows of the table that ``keys`` (sorted, distinct) name, unless they are too large."""
        got, size = [], 0
        for path, first, last in files:
            if not len(keys) or last < keys[0] or first > keys[-1]:
                continue
            for batch in parquet_rows(path, order, 4_096):
                have = batch.column(0).to_numpy()
                some = batch.filter(pa.array(keys[np.minimum(np.searchsorted(keys, have), len(keys) - 1)] == have))
                if some.num_rows:
                    got.append(some)
                    size += some.get_total_buffer_size()
                if size > most:
                    return None, size
        return pa.Table.from_batches(got) if got else None, 0

    def filled(part: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = part.column("others").combine_chunks()
        flat, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        found, over = named(np.unique(flat))
        if over and part.num_rows > 1:
            half = part.num_rows // 2
            yield from filled(part.slice(0, half))
            yield from filled(part.slice(half))
            return
        if over:  # one row's own samples, whatever their size
            found = pa.Table.from_batches([b.filter(pa.array(np.isin(b.column(0).to_numpy(), flat))) for path, _, _ in files for b in parquet_rows(path, order, 4_096)])
        have = found.column("other").to_numpy() if found else np.empty(0, np.int64)
        structs = pa.StructArray.from_arrays([found.column(c).combine_chunks() if found else pa.array([], f.type) for c, f in zip(order[1:], kind.value_type)], fields=list(kind.value_type))
        start = np.searchsorted(have, flat, "left")
        many = np.searchsorted(have, flat, "right") - start
        at = np.repeat(start - np.r_[0, np.cumsum(many)[:-1]] if len(many) else start, many) + np.arange(many.sum())
        ends = np.r_[0, np.cumsum(many)][np.r_[0, np.cumsum(n)]]
        rest = part.drop_columns(["others"]).combine_chunks()
        for a in range(0, part.num_rows, 256):
            b = min(a + 256, part.num_rows)
            values = structs.take(pa.array(at[ends[a] : ends[b]]))
            samples = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), values).cast(kind)
            yield from (pa.RecordBatch.from_arrays([*x.columns, samples], names=to.names) for x in rest.slice(a, b - a).combine_chunks().to_batches())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column("others").flatten()) if batch.num_rows else 0
            if n >= refs:
                yield from filled(pa.Table.from_batches(held))
                held, n = [], 0
        if sum(b.num_rows for b in held):
            yield from filled(pa.Table.from_batches(held))

    return rows.select(*(f.name for f in rows.schema if f.name != "others"), "others").mapInArrow(run, shape)


def fixed_samples(pool: DataFrame, strategy: str, ids: list[int] | None = None, n: int = 0, seed: int = 0, answer: str = "f_prime", key: str = "id") -> DataFrame:
    """One row with ``samples``: those of an id list in its order, or n at random; the same for every record."""
    from corvane.operators.records import by_id_list
    from corvane.operators.sampling import sample

    strategy = strategy.lower().strip()
    if strategy == "ids":
        rows = by_id_list(pool, ids or [], key).withColumn("_at", F.col("place").cast("long"))
    elif strategy == "random":
        rows = sample(pool, n, seed, key).withColumn("_at", F.col(key).cast("long"))
    else:
        raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES[1:]}")
    item = F.struct("_at", F.struct("req", "headers", F.col(answer).alias("answer")).alias("s"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.s).alias("samples"))


def generated(
    records: DataFrame, pool: DataFrame, strategy: str, style: str = "formula", headers: bool = True, neighbours: DataFrame | None = None, ids: list[int] | None = None, n: int = 0, sorting: str = "asc", seed: int = 0, answer: str = "f_prime", key: str = "id"
) -> DataFrame:
    """``key, prompt`` for every record (key, req, headers): any style with any strategy.

    'most similar' takes each record's ``neighbours`` (id, other, rank) from the pool (key, req, headers, answer) in
    ``sorting``, which the chat styles don't have (nearest first); 'ids' and 'random' give all records the same samples.
    """
    strategy = strategy.lower().strip()
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")
    shown = records.select(F.col(key), "req", "headers")
    if strategy == "most similar":
        if neighbours is None:
            raise ValueError("'most similar' needs neighbours")
        own = _listed(neighbours, "asc" if style.endswith("chat") else sorting, seed)
        shown = looked_up(shown.join(own.select(F.col("id").alias(key), "others"), key, "left"), pool, answer, key)
    else:
        shown = shown.withColumn("samples", fixed_samples(pool, strategy, ids, n, seed, answer).scalar())
    return shown.select(key, prompt("samples", "req", "headers" if headers else None, style).alias("prompt"))


def answered(df: DataFrame, responder: Callable[[list[str]], list[list[str]]], column: str = "prompt", into: str = "f", retries: int = 3) -> DataFrame:
    """Adds the model's answer to every prompt; ``responder`` maps a batch of prompts to the choices of each.

    Choices are joined into one text. A prompt with an empty answer is asked again up to ``retries`` times, then stays ''.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = pd.Series("", index=texts.index, dtype=object)
            left = list(texts.index[texts.notna()])
            for _ in range(retries):
                if not left:
                    break
                for i, choices in zip(left, responder([texts[i] for i in left])):
                    out[i] = "".join(choices)
                left = [i for i in left if not out[i].strip()]
            out[texts.isna()] = None
            yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(into, F.pandas_udf(run, "string")(F.col(column)))
