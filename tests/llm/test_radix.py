import random
import unicodedata
from collections import Counter

import pytest

radix = pytest.importorskip("corvane.llm.radix")


def same_texts(a, b):
    """The definition, written on its own: the texts between the separators of both columns, as a multiset of letters and digits."""

    def texts(req, headers):
        text = ";".join([req, headers or ""]).replace(">", ";").replace("|", ";")
        plain = ("".join(c for c in unicodedata.normalize("NFC", t).casefold() if c.isalnum()) for t in text.split(";"))
        return Counter(t for t in plain if t)

    return texts(*a) == texts(*b)


def brute(rows):
    first, out = [], set()
    for pos, req, headers in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        got = next((p for p, r, h in first if same_texts((r, h), (req, headers))), None)
        if got is None:
            first.append((pos, req, headers))
        else:
            out.add((got, pos))
    return out


def test_trie():
    t = radix.Trie(4)
    keys = [b"", b"abcd", b"abcdefgh", b"abcdefgi", b"abc", b"abcd", b"x" * 1000, b"x" * 1001, b"x" * 1000]
    for i, k in enumerate(keys):
        t.add(k, 1, -i)
    assert t.size == 7
    assert t.terminal(b"abcd")[1:] == [2, -5] and t.terminal(b"x" * 1000)[1:] == [2, -8]


def test_forms_that_count_as_the_same():
    base = radix.canonical("The Main pump, shall hold.", "a b; c")
    same = [("the MAIN PUMP shall hold", "c>A-B"), ("(a b) | C", "THE main pump\nshall hold!"), ("The Main pump, - shall hold", "a b|c|"), ("the main pump shall hold", "c;;a b")]
    assert all(radix.canonical(*s) == base for s in same)
    assert radix.canonical("The Main pump shall hold", None) == radix.canonical("The Main pump shall hold", "") != base
    assert radix.canonical("İx", None) == radix.canonical("i̇x", None)


def test_exchanged_columns():
    def canon(req, headers):
        return radix.canonical(req, headers)

    for a, b in [("The pump shall hold", "general; scope"), ("ab", "cd"), ("ab;cd", "abx|y"), ("", "x"), ("abcd;e", "abcd")]:
        assert canon(a, b) == canon(b, a)
    assert canon("the pump shall hold", "scope > GENERAL") == canon("general|scope", "The pump shall hold.")
    assert canon("the pump shall hold", "a; b") != canon("the pump shall hold", "a; c")


@pytest.mark.parametrize("bucket_bytes,task_keys,task_bytes", [(2 << 20, 150_000, 48 << 20), (300, 7, 48 << 20), (60, 99, 90)])
def test_copies_against_brute_force(spark, monkeypatch, bucket_bytes, task_keys, task_bytes):
    monkeypatch.setattr(radix, "TASK_KEYS", task_keys)
    monkeypatch.setattr(radix, "TASK_BYTES", task_bytes)
    rng = random.Random(bucket_bytes)
    rows = []
    for pos in rng.sample(range(1000), 150):
        req = rng.choice(["Same Long Beginning of text ", "", "Other "]) + rng.choice(["one", "two", "TWO!", "three four"])
        headers = rng.choice([None, "", "h one; h two", "h two|h one"])
        rows.append((pos, headers, req) if headers and req and rng.random() < 0.3 else (pos, req, headers))
    rows += [(2000 + i, "hot row", "x") for i in range(80)] + [(None, "hot row", "x"), (3000, None, "x"), (3001, "z" * 40_000, None), (3002, "Z" * 40_000, "")]
    df = spark.createDataFrame(rows, "pos long, req string, headers string").selectExpr("*", "1 as first", "2 as n").repartition(5)
    got = list(map(tuple, radix.find_copies(df, bucket_bytes).collect()))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    counts = {r.first_pos: r.n_copies for r in radix.collapse(df, bucket_bytes).collect()}
    assert sum(counts.values()) == sum(r[0] is not None and r[1] is not None for r in rows) and counts[2000] == 80


def test_no_rows(spark):
    df = spark.createDataFrame([], "pos long, req string, headers string")
    assert radix.find_copies(df).count() == 0 and radix.collapse(df).count() == 0
