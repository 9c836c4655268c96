"""Corpus encoding with a byte-level BPE vocabulary (problem 7).

The vocabulary is read once on the driver, from a path given as a parameter, into three numpy arrays whose size the
vocabulary fixes (about 4 MB for 50,000 tokens); these go to the executors. Each Arrow batch is encoded as follows:

* the splitting pattern cuts the texts into words, and every distinct word is encoded once;
* the bytes of all new words stand in one flat array, and merge rounds run over all of them at once: the key of each
  adjacent pair is looked up by binary search in the sorted pair keys, the lowest rank in each word is found with a
  segmented minimum, and all occurrences of that pair are merged from left to right. Words without a mergeable pair
  leave the array, so a round costs only what is still unfinished;
* words that were seen before come from a bounded cache.

Defined cases: NULL and '' give the empty list; blank texts are encoded as they are; text that looks like a special
token is ordinary text; a lone surrogate cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The vocabulary's splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_SHIFT = 20  # ids stay below 2**20
_NONE = np.int32(2**31 - 1)
_CACHE_WORDS = 200_000
_SLICE_CHARS = 4_000_000


def whole_words(path: str = VOCABULARY) -> frozenset[str]:
    """The vocabulary's tokens that are a whole word in small letters behind a blank; the vocabulary bounds their number."""
    with open(path, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in f if line.strip())
        return frozenset(t[1:] for t in tokens if t[:1] == " " and t[1:].isalpha() and t.islower())


class Vocabulary:
    """Sorted pair keys with the merged id of each, and the id of each single byte."""

    def __init__(self, keys: np.ndarray, merged: np.ndarray, byte_ids: np.ndarray):
        self.keys, self.merged, self.byte_ids = keys, merged, byte_ids
        self.cache: dict[str, np.ndarray] = {}

    def __reduce__(self):
        return Vocabulary, (self.keys, self.merged, self.byte_ids)

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        byte_ids = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ids.items():
            for at in range(1, len(token)):
                left, right = ids.get(token[:at]), ids.get(token[at:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = rank
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        merged = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        return cls(keys[order], merged[order], byte_ids)

    def _ranks(self, ids: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The merged id of each symbol with its right neighbour in the same word, else _NONE; it is the rank too."""
        out = np.full(len(ids), _NONE, dtype=np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        keys = ids[inside].astype(np.int64) << _SHIFT | ids[inside + 1]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == keys
        out[inside[found]] = self.merged[at[found]]
        return out

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, by merge rounds over all words at once."""
        raw = [w.encode("utf-8", "replace") for w in words]
        ids = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
        done: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        while len(ids):
            rank = self._ranks(ids, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(rank, starts)
            over = least == _NONE
            if over.any():
                for s, n in zip(starts[over], sizes[over]):
                    done[word[s]] = ids[s : s + n].copy()
                stay = np.repeat(~over, sizes)
                ids, word, rank = ids[stay], word[stay], rank[stay]
                if not len(ids):
                    break
                sizes, least = sizes[~over], least[~over]
            hit = rank == np.repeat(least, sizes)
            # a run of overlapping hits (aaa) merges every other one, from its left end
            at = np.flatnonzero(hit)
            first = np.r_[True, np.diff(at) > 1]
            run_start = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            at = at[(at - run_start) % 2 == 0]
            ids[at] = rank[at]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        return done

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of the texts."""
        split = regex.compile(PATTERN).findall
        index: dict[str, int] = {}
        inverse, counts = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                words = split(text)
                counts[i] = len(words)
                inverse.extend([index.setdefault(w, len(index)) for w in words])
        if not index:
            return np.zeros(len(texts) + 1, dtype=np.int32), np.empty(0, dtype=np.int32)
        if len(self.cache) > _CACHE_WORDS:
            self.cache.clear()
        fresh = [w for w in index if w not in self.cache]
        if fresh:
            self.cache.update(zip(fresh, self.encode_words(fresh)))
        parts = [self.cache[w] for w in index]
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        pool = np.concatenate(parts)
        which = np.array(inverse, dtype=np.int64)
        each = lengths[which]
        ends = np.cumsum(each)
        flat = pool[np.repeat(begin[which] - (ends - each), each) + np.arange(ends[-1])]
        at_word = np.r_[0, np.cumsum(counts)]
        offsets = np.r_[0, ends][at_word]
        return offsets.astype(np.int32), flat.astype(np.int32)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= _SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>``: one row for each input row, in place, without a shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                offsets, flat = vocab.encode(texts[a:b])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["doc_id", "ids"])

    out = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")
    return out.withColumnRenamed("doc_id", id_col)
