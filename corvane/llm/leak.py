"""Held-out passages inside the training text (problem 8).

A generalised suffix automaton over the words of the normalised test items is built on the driver and sent to the
executors; the corpus streams through it. For every word of a document the automaton gives the length of the longest
passage of any item that ends there. From ``min_words`` on, the items that hold this passage are those of the state's
*threshold ancestor* (the suffix-link ancestor whose passages are the shortest of at least ``min_words`` words), so the
result is exact for runs of that length. The corpus is read once and never shuffled.

The items' size is checked before they go to the driver: beyond ``max_item_chars`` they are dealt by hash into blocks.
Each block is a pass of its own over the corpus with its own automaton, so a task never holds more than one, and the
blocks' results are united. (2.2 million characters of items in random words of a vocabulary of 30,000 took 206 MB on the
driver while the automaton was built and 145 MB in a task.)

A word is a run of letters and digits after case folding and NFC; everything else separates words.

Defined cases: NULL, empty and blank texts (documents or items) and items shorter than ``min_words`` match nothing;
repeated rows give repeated results only in ``mark_leaks``, while ``find_leaks`` gives one row for a document id and item
id; NULL ids stay NULL; an empty item table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm.text import digest
from corvane.session import cut

MIN_WORDS = 12
MAX_ITEM_CHARS = 2_000_000

_WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return unicodedata.normalize("NFC", text).casefold() if text else ""


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(normal(text))


class Passages:
    """Suffix automaton of all items' word sequences, with the item ids at the states that matter."""

    def __init__(self, items: list[tuple[object, str | None]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.vocab: dict[str, int] = {}
        sequences = []
        for key, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            if len(ids) >= min_words:
                sequences.append((key, ids))
        self.width = max(1, len(self.vocab))
        self.length, self.link, edges = [0], [-1], [{}]
        for _, ids in sequences:
            last = 0
            for w in ids:
                last = self._extend(edges, last, w)
        self.step: dict[int, int] = {}
        for s, out in enumerate(edges):
            for w, to in out.items():
                self.step[s * self.width + w] = to
            edges[s] = None  # so that the edges are not held twice
        self.anchor = self._anchors()
        held: dict[int, set] = {}
        for key, ids in sequences:
            state = 0
            for i, w in enumerate(ids):
                state = self.step[state * self.width + w]
                if i + 1 >= min_words:
                    held.setdefault(self.anchor[state], set()).add(key)
        self.items = {s: tuple(keys) for s, keys in held.items()}

    def _extend(self, edges: list[dict[int, int]], last: int, w: int) -> int:
        length, link = self.length, self.link
        known = edges[last].get(w)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._split(edges, last, known, w)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        edges.append({})
        at = last
        while at >= 0 and w not in edges[at]:
            edges[at][w] = new
            at = link[at]
        if at >= 0:
            to = edges[at][w]
            link[new] = to if length[to] == length[at] + 1 else self._split(edges, at, to, w)
        return new

    def _split(self, edges: list[dict[int, int]], at: int, to: int, w: int) -> int:
        copy = len(self.length)
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[to])
        edges.append(dict(edges[to]))
        self.link[to] = copy
        while at >= 0 and edges[at].get(w) == to:
            edges[at][w] = copy
            at = self.link[at]
        return copy

    def _anchors(self) -> list[int]:
        """For each state the ancestor whose passages are the shortest of at least min_words words, else -1."""
        out = [-1] * len(self.length)
        for s in np.argsort(self.length, kind="stable").tolist():
            if self.length[s] >= self.min_words:
                up = self.link[s]
                out[s] = s if self.length[up] < self.min_words else out[up]
        return out

    def scan(self, text: str | None) -> tuple[set, list[tuple[int, int]], int]:
        """Items met, the maximal word spans [from, to) that are covered, and the number of words."""
        step, link, length, width, need = self.step.get, self.link, self.length, self.width, self.min_words
        get = self.vocab.get
        state = run = 0
        found: set[int] = set()
        spans: list[list[int]] = []
        n = 0
        for n, word in enumerate(words_of(text), 1):
            w = get(word)
            if w is None:
                state = run = 0
                continue
            to = step(state * width + w)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = step(state * width + w)
            if to is None:
                state = run = 0
                continue
            state = to
            run += 1
            if run >= need:
                found.add(self.anchor[state])
                if spans and n - run <= spans[-1][1]:
                    spans[-1][1] = n
                    spans[-1][0] = min(spans[-1][0], n - run)
                else:
                    spans.append([n - run, n])
        keys: set = set()
        for s in found:
            keys.update(self.items[s])
        return keys, [(a, b) for a, b in spans], n


def _block_numbers(items: DataFrame, max_item_chars: int) -> Iterator[Callable[[], list[tuple[object, str | None]]]]:
    """For each block of items a function that fetches it."""
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, math.ceil(total / max_item_chars))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        yield lambda part=part: [(r.key, r.text) for r in part.collect()]


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(items[id_col].alias("key"), items[text_col].alias("text")).where("text is not null")


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_item_chars: int = MAX_ITEM_CHARS, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id``: which items share a run of at least ``min_words`` words with which document."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    arrow = to_arrow_type(items.schema[item_id].dataType)
    base = docs.select(docs[doc_id].alias("doc"), docs[text_col].alias("text")).where("text is not null")
    doc_kind = docs.schema[doc_id].dataType.simpleString()
    out = None
    for block in _block_numbers(_items(items, item_id, text_col), max_item_chars):
        shared = spark.sparkContext.broadcast(Passages(block(), min_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages = shared.value
            for batch in batches:
                rows, keys = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    met = passages.scan(text)[0]
                    rows.extend([i] * len(met))
                    keys.extend(sorted(met, key=lambda k: (k is None, k)))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(keys, type=arrow)], ["doc", "item"])

        part = base.mapInArrow(run, f"doc {doc_kind}, item {kind}")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()


def mark_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_coverage: float = 0.5, max_item_chars: int = MAX_ITEM_CHARS, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, leaked_words, n_spans, coverage, dropped, cleaned``: every document with its leaked spans cut out.

    A document of which more than ``max_coverage`` is leaked is dropped as a whole (``dropped``, ``cleaned`` = '');
    otherwise ``cleaned`` is its text without the spans. NULL text: no words, coverage 0, cleaned NULL. With items in
    several blocks each is a pass of its own that gives the spans of the texts it meets, by the text's digest; their union is
    joined to the documents.
    """
    spark = docs.sparkSession
    base = docs.select(docs[doc_id].alias("doc"), docs[text_col].alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    shape = f"doc {kind}, n_words int, leaked_words int, n_spans int, coverage double, dropped boolean, cleaned string"
    parts = []
    blocks = list(_block_numbers(_items(items, "item_id", "text"), max_item_chars))
    for block in blocks:
        shared = spark.sparkContext.broadcast(Passages(block(), min_words))
        if len(blocks) == 1:

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield _marked(batch.column(0), batch.column(1).to_pylist(), lambda text, _: shared.value.scan(text)[1:], max_coverage)

            return base.mapInArrow(run, shape).withColumnRenamed("doc", doc_id)

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                met = {}
                for text in batch.column(0).to_pylist():
                    if spans := shared.value.scan(text)[1]:
                        met[digest(text)] = [x for span in spans for x in span]
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array(met, pa.binary()), pa.array(met.values(), pa.list_(pa.int32()))], ["key", "spans"])

        parts.append(base.select("text").where("text is not null").mapInArrow(meet, "key binary, spans array<int>"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    # the spans of one text, which its length bounds
    every = cut(every.distinct().groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "leak-spans")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [digest(t) if t is not None else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["doc", "text", "key"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).to_pylist()
            yield _marked(batch.column(0), batch.column(1).to_pylist(), lambda text, i: (_pairs(flat[i] or []), len(words_of(text))), max_coverage)  # noqa: B023

    joined = base.mapInArrow(keyed, f"doc {kind}, text string, key binary").join(every, "key", "left").select("doc", "text", "spans")
    return joined.mapInArrow(clean, shape).withColumnRenamed("doc", doc_id)


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2]))


def _marked(doc: pa.Array, texts: list[str | None], look: Callable[[str | None, int], tuple[list[tuple[int, int]], int]], max_coverage: float) -> pa.RecordBatch:
    """``look`` gives a text's leaked word spans, in any order, and its number of words."""
    cols: list[list] = [[], [], [], [], [], []]
    for i, text in enumerate(texts):
        spans, n = look(text, i)
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        leaked = sum(b - a for a, b in merged)
        share = leaked / n if n else 0.0
        drop = share > max_coverage
        for col, v in zip(cols, (n, leaked, len(merged), round(share, 6), drop, "" if drop else cut_spans(text, merged))):
            col.append(v)
    types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([doc, *(pa.array(c, type=t) for c, t in zip(cols, types))], ["doc", "n_words", "leaked_words", "n_spans", "coverage", "dropped", "cleaned"])


def word_places(text: str) -> list[tuple[int, int]]:
    """Where each of ``words_of(text)`` stands in the text itself."""
    folded = normal(text)
    places = [m.span() for m in _WORD.finditer(folded)]
    if len(folded) == len(text):
        return places
    # a place in the folded text -> the piece of the text it comes from: a character with its marks, or else (where
    # such pieces don't fold on their own) what stands between blanks
    for unit in (re.compile(r"[\s\S](?:(?![\s])[^\w\s\x00-\x7f])*"), re.compile(r"\S+|\s+")):
        low, high, parts = [], [], []
        for m in unit.finditer(text):
            part = normal(m[0])
            parts.append(part)
            low += [m.start()] * len(part)
            high += [m.end()] * len(part)
        if "".join(parts) == folded:
            return [(low[a], high[b - 1]) for a, b in places]
    return [(0, len(text))] * len(places)


def cut_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """``text`` without the word spans."""
    if not text or not spans:
        return text
    at = word_places(text)
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : max(last, at[a][0])])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])
