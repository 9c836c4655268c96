import random

import numpy as np
import pyarrow as pa
import pytest

overlap = pytest.importorskip("corvane.llm.overlap")
from corvane.llm import bloom  # noqa: E402
from corvane.llm.minhash import MinHash, shingles  # noqa: E402
from corvane.llm.text import letters, sentence_first, words  # noqa: E402


def test_formula_key():
    k = overlap.formula_key
    assert k("B ⊓ A ⊓ ∃x.(D ⊓ ∃y.(F ⊓ E) ⊓ C) ⊑ G") == k("A⊓∃x.(C ⊓ ∃y.(E⊓F)⊓D)⊓ B ⊑ G")
    assert k("A ⊑ B") != k("B ⊑ A") and k("A ⊔ B ⊑ C") != k("B ⊔ A ⊑ C") and k("A ⊑ B | C ⊑ D") != k("C ⊑ D | A ⊑ B")
    assert k(None) is None and k(" \n") is None and k("))((") == "))(("


def test_bloom_never_loses_a_key(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    for size in (8192, 1 << 20):
        b = bloom.Bloom(len(keys), size)
        assert not b.may_hold(keys).any()
        b.add(keys)
        assert b.may_hold(keys).all()
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(7)
    built = bloom.build(df, lambda b: b.column(0).to_numpy(), len(keys))
    assert built.may_hold(keys).all() and built.may_hold(keys + 1).mean() < 0.05


def test_bands_meet_as_often_as_promised():
    rng = np.random.default_rng(5)
    m = MinHash(overlap.ROWS, overlap.BANDS, overlap.POOL)
    hits = 0
    for _ in range(120):
        pool = rng.integers(0, 2**32, 40, dtype=np.uint32)
        a, b = pool[:37], np.r_[pool[:34], pool[37:]]  # 34 of 40 in common: 85 %
        k = m.bands(np.r_[a, b], np.array([len(a), len(b)]))
        hits += (k[0] == k[1]).any()
    assert hits >= 114


def test_shingles():
    v = np.arange(10, dtype=np.uint32)
    flat, counts = shingles(v, np.array([7, 0, 3]), 5)
    assert counts.tolist() == [3, 0, 1] and len(set(flat.tolist())) == 4


def brute(rows, percent):
    out = set()
    live = [r for r in rows if r[0] is not None and r[1] is not None]
    for a in (r for r in live if r[3] == "train"):
        for b in (r for r in live if r[3] in ("test", "validation")):
            x, y = (sentence_first(r[1], r[2])[0] for r in (a, b))
            w, v = set(words(x)), set(words(y))
            same = letters(x) and letters(x) == letters(y)
            near = w and v and 100 * len(w & v) >= percent * len(w | v)
            k = overlap.formula_key(a[4])
            if same or near or (k and k == overlap.formula_key(b[4])):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(24)] for _ in range(12)]
    rows = []
    for pos in rng.sample(range(500), 160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        req, headers = " ".join(w), rng.choice([None, "h a; h b"])
        if headers and rng.random() < 0.2:
            req, headers = headers, req
        rows.append((pos, req, headers, rng.choice(["train", "test", "validation", None]), rng.choice([None, "", "A ⊓ B ⊑ C", "B⊓A ⊑ C", f"A ⊑ D{rng.randrange(30)}"])))
    rows += [(600, None, None, "train", "Q ⊑ R"), (601, "", None, "test", "Q ⊑ R"), (602, "...", None, "train", None), (603, "!", None, "test", None), (None, "w", None, "test", None), (604, "u" * 20_000, None, "train", None), (605, "U" * 20_000, None, "test", None)]
    df = spark.createDataFrame(rows, "pos long, req string, headers string, split string, f_prime string").selectExpr("*", "1 as words", "2 as held", "'s' as source").repartition(4)
    got = list(map(tuple, overlap.found(df).collect()))
    want = brute(rows, 85)
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.02 * len(want)
    report = overlap.report(df).collect()
    split_of = {r[0]: r[3] for r in rows}
    held = {next(p for p in pair if split_of[p] != "train") for pair in got}
    assert sum(r.n_pairs for r in report) == len(got) and sum(r.n_overlapping for r in report) == len(held)


def test_packing_and_meeting():
    rng = np.random.default_rng(3)
    keys, ids = rng.integers(0, 50, 300).astype(np.uint32), rng.integers(0, 2**48, 300, dtype=np.uint64)
    k, i = overlap._unpacked([overlap._packed(keys, ids)])
    assert sorted(zip(k.tolist(), i.tolist())) == sorted(zip(keys.tolist(), ids.tolist()))
    held = rng.random(300) < 0.3
    blocks = [(bool(h), overlap._packed(keys[m], ids[m])) for h in (False, True) for m in (np.flatnonzero(held == h)[::2], np.flatnonzero(held == h)[1::2])] * 2
    old, overlap._PAIRS_AT_ONCE = overlap._PAIRS_AT_ONCE, 7
    got = overlap._meet(pa.table({"held": [h for h, _ in blocks], "data": [d for _, d in blocks]}))
    overlap._PAIRS_AT_ONCE = old
    want = {(int(a), int(b)) for a, x in zip(ids[~held], keys[~held]) for b, y in zip(ids[held], keys[held]) if x == y}
    assert len(got) == len(want) and set(zip(got["train_id"].to_pylist(), got["eval_id"].to_pylist())) == want


def test_many_slices_and_hot_keys_give_the_same(spark):
    rng = random.Random(9)
    core = [f"c{i}" for i in range(30)]
    rows = []
    for pos in range(300):  # a third of all sets hardly differ, so that their band keys are hot
        w = list(core) if pos % 3 else [f"w{rng.randrange(900)}" for _ in range(20)]
        w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        rows.append((pos, " ".join(w), None, "train" if pos % 4 else "test", None))
    df = spark.createDataFrame(rows, "pos long, req string, headers string, split string, f_prime string").repartition(3)
    feats = overlap.features(df)
    n = feats.count()
    minhash = MinHash(overlap.ROWS, overlap.BANDS, overlap.POOL)
    assert overlap._hot_keys(feats, n, minhash, 10**6) == {} and max(overlap._hot_keys(feats, n, minhash, 40).values()) >= 3
    base = set(map(tuple, overlap._candidates(feats).collect()))
    split = set(map(tuple, overlap._candidates(feats, slice_keys=50, split_rows=40).collect()))
    assert base and base == split


def test_no_rows(spark):
    df = spark.createDataFrame([], "pos long, req string, headers string, split string, f_prime string, source string")
    assert overlap.found(df).count() == 0 and overlap.report(df).count() == 0
