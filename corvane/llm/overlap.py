"""Evaluation records that also stand in the training split (problem 6).

Two records overlap if their requirement sentences have the same letters and digits, or share at least 85 % of their
distinct words, or if their formulas are the same apart from blanks and the order of conjuncts.

* ``features`` reduces each row, once, to three 16-byte keys (letters, word set, formula) and its word set.
* Equal letters and equal formulas are joins on the keys, train against evaluation rows only.
* Similar word sets go through MinHash: 48 bands of 12 values. Every set of both sides sends each of its band keys, packed
  with its id into 10 bytes, to the key's slice of about ``SLICE_KEYS`` keys (once for each distinct set of a task, however
  many copies it has), where the ids of both sides that share a key become candidates. Nothing but the keys' number
  decides how many slices there are, and nothing is broadcast for it. A key that a sample finds hot is dealt over
  several slices by the training set's id; evaluation sets with that key go to all of them.
* The candidates' exact Jaccard similarity decides. At 85 % a pair is found with a probability of 99 %, at 90 % with more
  than 99.99 %.
* Verified pairs of word sets are spread over the rows that have them; the report counts them by classes of equal rows and
  spreads nothing.

Defined cases: rows with NULL req, NULL position or another split take no part; a sentence without letters and digits
matches none by its words; NULL, '' and blank formulas match none; a position that occurs twice gives its pairs once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import bloom
from corvane.llm.minhash import MinHash, hash_words
from corvane.llm.text import digest, sentence_first, words
from corvane.session import bounded_sample, cut

PERCENT = 85
ROWS, BANDS, POOL = 12, 48, 192
SLICE_KEYS = 400_000
SPLIT_ROWS, HOT_SAMPLE, HOT_SHARE = 2_000_000, 20_000, 0.01
_PAIRS_AT_ONCE = 2_000_000
TRAIN, EVALUATION = ("train",), ("validation", "test")

_INNER = re.compile(r"\(([^()]*)\)")
_HELD = re.compile("\x01(\\d+)\x02")
_FEATURES = "pos bigint, held boolean, letters binary, formula binary, wid binary, words array<int>"


def formula_key(formula: str | None) -> str | None:
    """The formula without blanks, the conjuncts of every level in sorted order; None if there is nothing."""
    if not formula:
        return None
    text = "".join(formula.split())
    if not text:
        return None
    # brackets from the inside out: a sorted group becomes a placeholder, so that its ⊓ isn't cut again
    groups: list[str] = []

    def whole(part: str) -> str:
        while "\x01" in part:
            part = _HELD.sub(lambda m: groups[int(m[1])], part)
        return part

    def in_order(text: str) -> str:
        return "⊓".join(sorted(map(whole, text.split("⊓"))))

    def hold(m: re.Match) -> str:
        groups.append(f"({in_order(m[1])})")
        return f"\x01{len(groups) - 1}\x02"

    n = 1
    while n:
        text, n = _INNER.subn(hold, text)
    return "|".join("⊑".join(map(in_order, axiom.split("⊑"))) for axiom in text.split("|"))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in batches:
        pos, held, reqs, headers, formulas = batch.columns
        keys: list[list] = [[], [], []]
        sets, sizes = [], []
        for req, head, formula in zip(reqs.to_pylist(), headers.to_pylist(), formulas.to_pylist()):
            w = words(sentence_first(req, head)[0])
            numbers = sorted(set(hash_words(w, cache)))
            sets.extend(numbers)
            sizes.append(len(numbers))
            keys[0].append(digest("".join(w)) if w else None)
            key = formula_key(formula)
            keys[1].append(digest(key) if key else None)
            keys[2].append(digest(np.array(numbers, np.uint32).tobytes()) if w else None)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.array(sets, np.uint32).view(np.int32)))
        yield pa.RecordBatch.from_arrays([pos, held, *(pa.array(k, pa.binary()) for k in keys), lists], ["pos", "held", "letters", "formula", "wid", "words"])


def features(rows: DataFrame) -> DataFrame:
    base = rows.select(rows["pos"].cast("long").alias("pos"), rows["split"].isin(*EVALUATION).alias("held"), rows["req"].alias("req"), rows["headers"].alias("headers"), rows["f_prime"].alias("f_prime"), rows["split"].alias("part"))
    base = base.where(F.col("pos").isNotNull() & F.col("req").isNotNull() & F.col("part").isin(*TRAIN, *EVALUATION)).drop("part")
    return cut(base.mapInArrow(_features, _FEATURES), "overlap")


def _band_keys(words_column: pa.Array, minhash: MinHash) -> np.ndarray:
    words_column = words_column.combine_chunks() if isinstance(words_column, pa.ChunkedArray) else words_column
    sizes = np.diff(words_column.offsets.to_numpy())
    values = words_column.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    return minhash.bands(values, sizes)


def _packed(keys: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted 32-bit keys and 48-bit ids, byte plane by byte plane, so that the keys' leading bytes compress well."""
    order = np.argsort(keys, kind="stable")
    planes = [keys[order].astype("<u4").view(np.uint8).reshape(-1, 4)[:, ::-1].T, ids[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in planes)


def _unpacked(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, ids = [], []
    for b in blocks:
        planes = np.frombuffer(b, np.uint8).reshape(10, -1).astype(np.uint64)
        keys.append(planes[0] << np.uint64(24) | planes[1] << np.uint64(16) | planes[2] << np.uint64(8) | planes[3])
        ids.append(sum(planes[4 + i] << np.uint64(8 * i) for i in range(6)))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(keys), np.concatenate(ids)


def _once(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (key, id) once, in order."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    return keys[new], ids[new]


def _meet(table: pa.Table) -> pa.Table:
    """One slice: the ids of both sides that share a key, each pair once."""
    held = np.array(table.column("held").to_pylist(), bool)
    data = table.column("data").to_pylist()
    ek, ei = _once(*_unpacked([d for d, h in zip(data, held) if h]))
    tk, ti = _unpacked([d for d, h in zip(data, held) if not h])
    lo, hi = np.searchsorted(ek, tk, "left"), np.searchsorted(ek, tk, "right")
    some = hi > lo
    tk, ti = _once(tk[some], ti[some])
    lo, hi = np.searchsorted(ek, tk, "left"), np.searchsorted(ek, tk, "right")
    pairs, start, ends = np.zeros((0, 2), np.uint64), 0, np.cumsum(hi - lo)
    while start < len(tk):  # a bounded number of pairs at a time
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS_AT_ONCE, "right")))
        n = (hi - lo)[start:stop]
        at = np.repeat(lo[start:stop] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        pairs = np.unique(np.concatenate([pairs, np.stack([np.repeat(ti[start:stop], n), ei[at]], 1)]), axis=0)
        start = stop
    return pa.table({"train_id": pa.array(pairs[:, 0].astype(np.int64)), "eval_id": pa.array(pairs[:, 1].astype(np.int64))})


def _id_of(wid: bytes) -> int:
    return int.from_bytes(wid[:6], "little")


def _hot_keys(sets: DataFrame, n: int, minhash: MinHash, split_rows: int) -> dict[int, int]:
    """Band keys that may have more than ``split_rows`` word sets, and over how many slices they are dealt."""
    if n <= split_rows:  # no key can have more
        return {}
    some = bounded_sample(sets.select("pos", "wid", "words"), ["pos", "wid"], HOT_SAMPLE).toArrow()
    first = list({w: i for i, w in enumerate(some.column("wid").to_pylist())}.values())
    keys, counts = np.unique(_band_keys(some.column("words").take(pa.array(first)), minhash), return_counts=True)
    share = counts / len(first)
    return {int(k): math.ceil(s * n / split_rows) for k, s in zip(keys, share) if s >= HOT_SHARE and s * n > split_rows}


def _candidates(feats: DataFrame, slice_keys: int = SLICE_KEYS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``train_id, eval_id``: ids of word sets that share a band across the splits, each pair once."""
    minhash = MinHash(ROWS, BANDS, POOL)
    sets = feats.where("wid is not null")
    n = sets.count()
    slices = max(1, -(-n * BANDS // slice_keys))
    hot = sorted(_hot_keys(sets, n, minhash, split_rows).items())
    hot_key = np.array([k for k, _ in hot], np.int64)
    hot_parts = np.array([p for _, p in hot], np.int64)
    hot_first = slices + np.r_[0, np.cumsum(hot_parts)[:-1]].astype(np.int64) if hot else hot_parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, set[bytes]] = {False: set(), True: set()}
        for batch in batches:
            helds, wids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for side in (False, True):
                fresh = []
                for i, (h, w) in enumerate(zip(helds, wids)):
                    if h == side and w not in seen[side]:
                        seen[side].add(w)
                        fresh.append(i)
                if len(seen[side]) > 1_000_000:
                    seen[side].clear()
                if fresh:
                    yield block(side, [wids[i] for i in fresh], batch.column(2).take(pa.array(fresh)))

    def block(side: bool, wids: list[bytes], words: pa.Array) -> pa.RecordBatch:
        keys = _band_keys(words, minhash).ravel()
        ids = np.repeat(np.array([_id_of(w) for w in wids], np.uint64), BANDS)
        at = (keys.view(np.uint64) % np.uint64(slices)).astype(np.int64)
        if hot:
            place = np.minimum(np.searchsorted(hot_key, keys), len(hot_key) - 1)
            is_hot = hot_key[place] == keys
            parts, first = hot_parts[place], hot_first[place]
            if side:  # an evaluation set meets every part of a hot key
                times = np.where(is_hot, parts, 1)
                turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at = np.repeat(np.where(is_hot, first, at), times) + turn * np.repeat(is_hot, times)
                keys, ids = np.repeat(keys, times), np.repeat(ids, times)
            else:
                at = np.where(is_hot, first + (ids % parts.astype(np.uint64)).astype(np.int64), at)
        order = np.argsort(at, kind="stable")
        at, low, ids = at[order], (keys.view(np.uint64)[order] >> np.uint64(32)).astype(np.uint32), ids[order]
        edges = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
        data = [_packed(low[a:b], ids[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]]), pa.array([side] * len(data)), pa.array(data, pa.binary())], ["slice", "held", "data"])

    blocks = sets.select("held", "wid", "words").mapInArrow(run, "slice bigint, held boolean, data binary")
    # two slices a task whatever the session's number of shuffle partitions
    blocks = blocks.repartition(max(1, (slices + int(hot_parts.sum())) // 2), "slice")
    return blocks.groupBy("slice").applyInArrow(_meet, "train_id bigint, eval_id bigint").distinct()


def _sets_of(feats: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``id, wid, words`` of the word sets named, once each.

    A bounded Bloom filter drops most of the others in the map tasks; where there are too many ids for it, all sets are
    shuffled once, which is still in proportion to the input.
    """
    needed = bloom.build(ids, lambda b: b.column(0).to_numpy(zero_copy_only=False), n)
    sent = feats.sparkSession.sparkContext.broadcast(needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = np.array([_id_of(w) for w in batch.column(0).to_pylist()], np.int64)
                keep = pa.array(sent.value.may_hold(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids).filter(keep), *batch.filter(keep).columns], ["id", "wid", "words"])

    named = feats.where("wid is not null").select("wid", "words").mapInArrow(run, "id bigint, wid binary, words array<int>")
    return named.groupBy("id", "wid").agg(F.first("words").alias("words"))


def _similar(feats: DataFrame, percent: int) -> DataFrame:
    """``train_wid, eval_wid`` of at least ``percent`` % Jaccard similarity."""
    pairs = cut(_candidates(feats), "overlap-pairs")
    n = pairs.count()
    sets = cut(_sets_of(feats, pairs.select(F.col("train_id").alias("id")).union(pairs.select("eval_id")).distinct(), max(1, 2 * n)), "overlap-sets")
    both = pairs.join(sets.select(F.col("id").alias("train_id"), F.col("wid").alias("train_wid"), F.col("words").alias("a")), "train_id")
    both = both.join(sets.select(F.col("id").alias("eval_id"), F.col("wid").alias("eval_wid"), F.col("words").alias("b")), "eval_id")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common * 100 >= (F.size("a") + F.size("b") - common) * percent).select("train_wid", "eval_wid")


def overlaps(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``train_pos, eval_pos``: every overlapping pair once."""
    feats = features(rows)
    similar = _similar(feats, percent)
    train, held = feats.where("not held"), feats.where("held")
    by_words = (
        similar.join(train.select(F.col("wid").alias("train_wid"), F.col("pos").alias("train_pos")), "train_wid")
        .join(held.select(F.col("wid").alias("eval_wid"), F.col("pos").alias("eval_pos")), "eval_wid")
        .select("train_pos", "eval_pos")
    )

    def keys(part: DataFrame, name: str) -> DataFrame:
        kinds = F.array(F.struct(F.lit(0).cast("byte").alias("kind"), F.col("letters").alias("key")), F.struct(F.lit(1).cast("byte").alias("kind"), F.col("formula").alias("key")))
        return part.select(F.col("pos").alias(name), F.inline(kinds)).where("key is not null")

    by_keys = keys(train, "train_pos").join(keys(held, "eval_pos"), ["kind", "key"]).select("train_pos", "eval_pos")
    return by_words.unionByName(by_keys).distinct()


def found(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``pos_a, pos_b`` with pos_a < pos_b."""
    pairs = overlaps(rows, percent)
    return pairs.select(F.least("train_pos", "eval_pos").alias("pos_a"), F.greatest("train_pos", "eval_pos").alias("pos_b"))


def report(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``split, source, n_rows, n_overlapping, n_pairs``: one row for each evaluation split and source.

    The training rows of a class of equal rows are counted, not listed: those with the row's formula, plus those whose
    requirement is similar, less those that are both. A position that occurs twice is counted twice.
    """
    base = rows.where(rows["pos"].isNotNull() & rows["req"].isNotNull())
    feats = features(base)
    cls = F.concat("letters", "wid").alias("cls")  # what a requirement is compared by
    train = feats.where("not held").groupBy(cls, "letters", "wid", "formula").agg(F.count("*").alias("n"))
    held = feats.where("held").select("pos", cls, "letters", "wid", "formula")
    classes = lambda part, name: part.where("cls is not null").select(F.col("cls").alias(f"{name}_cls"), "letters", F.col("wid").alias(f"{name}_wid")).distinct()
    t, e = classes(train, "train"), classes(held, "eval")
    alike = _similar(feats, percent).join(t.drop("letters"), "train_wid").join(e.drop("letters"), "eval_wid").select("train_cls", "eval_cls")
    alike = cut(alike.unionByName(t.join(e, "letters").select("train_cls", "eval_cls")).distinct(), "overlap-classes")
    of_class = train.groupBy(F.col("cls").alias("train_cls")).agg(F.sum("n").alias("n"))
    of_formula = train.where("formula is not null").groupBy("formula").agg(F.sum("n").alias("by_formula"))
    by_words = alike.join(of_class, "train_cls").groupBy(F.col("eval_cls").alias("cls")).agg(F.sum("n").alias("by_words"))
    kinds = held.where("cls is not null and formula is not null").select(F.col("cls").alias("eval_cls"), "formula").distinct()
    both = kinds.join(alike, "eval_cls").join(train.select(F.col("cls").alias("train_cls"), "formula", "n"), ["train_cls", "formula"])
    both = both.groupBy(F.col("eval_cls").alias("cls"), "formula").agg(F.sum("n").alias("both"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counted = held.join(of_formula, "formula", "left").join(by_words, "cls", "left").join(both, ["cls", "formula"], "left")
    pairs = counted.select("pos", (zero("by_formula") + zero("by_words") - zero("both")).alias("pairs")).groupBy("pos").agg(F.max("pairs").alias("pairs"))
    shown = base.where(base["split"].isin(*EVALUATION)).select(base["pos"].cast("long").alias("pos"), "split", "source").join(pairs, "pos", "left")
    return shown.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("pairs") > 0).alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
