import random

import pytest

leak = pytest.importorskip("corvane.llm.leak")


def brute(docs, items, n):
    grams = {}
    for k, t in items:
        w = leak.words_of(t)
        for i in range(len(w) - n + 1):
            grams.setdefault(tuple(w[i : i + n]), set()).add(k)
    return {(d, k) for d, t in docs for w in [leak.words_of(t)] for i in range(len(w) - n + 1) for k in grams.get(tuple(w[i : i + n]), ())}


@pytest.mark.parametrize("seed", range(6))
def test_against_all_runs(seed):
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, make(rng.randint(0, 25))) for i in range(8)] + [(99, None), (98, "")]
    docs = [(i, make(rng.randint(0, 60))) for i in range(40)] + [(100, items[0][1].upper() + "!"), (101, None)]
    passages = leak.Passages(items, 5)
    assert {(d, k) for d, t in docs for k in passages.scan(t)[0]} == brute(docs, items, 5)


def test_spans_cover_the_runs():
    p = leak.Passages([(1, "one two three four five six")], 3)
    keys, spans, n = p.scan("x ONE two, three\nfour y two three four five z one two")
    assert keys == {1} and spans == [(1, 5), (6, 10)] and n == 13
    assert leak.cut_spans("x ONE two, three\nfour y", [[1, 5]]) == "x  y"
    assert leak.cut_spans("Keep ßß One two three!", [[2, 5]]) == "Keep ßß !"
    assert leak.cut_spans("Große Straße: One, two Cafe\u0301 x End ŉ", [[2, 5]]) == "Große Straße:  x End ŉ"
    assert leak.cut_spans("A \u0928\u093c b \u1112\u1161\u11ab C dß", [[1, 3]]).endswith("\u1112\u1161\u11ab C dß")


@pytest.mark.parametrize("seed", range(20))
def test_places_of_words(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["ß", "e\u0301", "İ", " ", "Ab", "_", ",", "ﬁ", "\u1112\u1161", "9", "Å", "\u0344", "\U0001d15e"]) for _ in range(40))
    places = leak.word_places(text)
    words = leak.words_of(text)
    assert len(places) == len(words) and all(a < b for a, b in places) and places == sorted(places)
    assert all(w in "".join(leak.normal(text[a:b])) for w, (a, b) in zip(words, places))


def test_tables(spark):
    text = "a b c d e f g h i j k l m"
    docs = spark.createDataFrame([(1, text), (2, text.upper().replace(" ", ", ")), (2, text), (3, None), (4, ""), (5, "q " * 5000 + text), (None, text), (6, "a b c d e f g h i j k x")], "doc_id long, text string").selectExpr("*", "'s' as item_id")
    items = spark.createDataFrame([(7, "zz " + text), (8, text), (8, text), (9, None), (10, "short")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    for limit in (8_000_000, 10):  # one block of items, or several
        got = sorted(map(tuple, leak.find_leaks(docs, items, max_item_chars=limit).collect()), key=str)
        assert got == sorted([(d, i) for d in (1, 2, 5, None) for i in (7, 8)], key=str)
    same = [sorted(map(str, leak.mark_leaks(docs, items, max_item_chars=limit).collect())) for limit in (8_000_000, 10)]
    assert same[0] == same[1]
    marked = leak.mark_leaks(docs, items).collect()
    assert len(marked) == 8
    by = {r.doc_id: r for r in marked}
    assert by[1].dropped and by[1].cleaned == "" and by[3].cleaned is None and by[5].leaked_words == 13 and not by[5].dropped and " a b" not in by[5].cleaned
    assert leak.find_leaks(docs, items.where("false")).count() == 0 and leak.find_leaks(docs.where("false"), items).count() == 0
