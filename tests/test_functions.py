import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import distances as D
from corvane.functions import formula, graph
from corvane.functions.syntax import formulas_valid

TEXTS = ["", "A ⊑ ≥12r.(B ⊔ ¬C) ", "∃ hasValue.float[0.5]", "A ⊓ ∃r.(B ⊓ C) ⊑ D", "  ", "A . B", "plain words here", "(((", None]
symbols = st.lists(st.sampled_from(["A", "B", "r", "⊓", "⊔", "⊑", "∃", "¬", "(", ")", "[", "]", ".", " ", "1", "≥", '"']), max_size=25).map("".join)


def test_tokens_by_hand(spark):
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", formula.tokens("t").alias("x")).collect()}
    assert got[""] == [""] and got[None] is None
    assert got["A ⊑ ≥12r.(B ⊔ ¬C) "] == ["A", "⊑", "≥1", "2r", "B", "⊔", "¬", "C", ""]
    assert got["∃ hasValue.float[0.5]"] == ["∃", "", "hasValue", "float", "0", "5"]
    assert all(x == D.python_tokens(t) for t, x in got.items() if t is not None)


def test_scores_in_columns(spark):
    pairs = [("A ⊓ B ⊑ C", "A ⊓ D ⊑ C"), ("", ""), ("a b c", "a c"), (None, "A"), ("A", None), ("A", ""), ("x" * 3000, "A ⊑ B")]
    df = spark.createDataFrame(pairs, "f string, g string").select(
        "f", "g", D.jaccard("f", "g").alias("j"), D.word_error_rate("f", "g").alias("w"), D.edit("f", "g").alias("e"), D.changed_parts("f", "g").alias("p"), D.ter("f", "g").alias("t"), D.chrf("f", "g").alias("c"), graph.graph_edit("f", "g").alias("ge")
    )
    got = {(r.f, r.g): r for r in df.collect()}
    r = got["A ⊓ B ⊑ C", "A ⊓ D ⊑ C"]
    assert r.p == pytest.approx(1 - 2 / 3) and r.e == 1 and r.w == pytest.approx(1 / 5) and r.ge == 1
    assert got["", ""].j == 0 and got["", ""].w is None and got["", ""].e == 0
    assert got["a b c", "a c"].w == pytest.approx(0.5)
    assert all(v is None for v in tuple(got[None, "A"])[2:]) and all(v is None for v in tuple(got["A", None])[2:])


def test_empty_formula_bounds_the_edit_distance():
    g = "A ⊑ B. C "
    n = len(D.python_tokens(g))
    assert D.edit_of("x y z w v u t s r q p", g) == n - 1  # one of its tokens is empty
    assert D.edit_of("", "A ⊑ B") == 3


def osa_free(a, b):
    """Unrestricted Damerau distance by search over all single edits (tiny inputs only)."""
    letters = set(a) | set(b)
    seen, frontier, d = {tuple(a)}, [tuple(a)], 0
    goal = tuple(b)
    while goal not in seen:
        d += 1
        new = []
        for s in frontier:
            out = [s[:i] + s[i + 1 :] for i in range(len(s))]
            out += [s[:i] + (c,) + s[i:] for i in range(len(s) + 1) for c in letters if len(s) < max(len(a), len(b)) + 1]
            out += [s[:i] + (c,) + s[i + 1 :] for i in range(len(s)) for c in letters]
            out += [s[:i] + (s[i + 1], s[i]) + s[i + 2 :] for i in range(len(s) - 1)]
            for x in out:
                if x not in seen:
                    seen.add(x)
                    new.append(x)
        frontier = new
    return d


def test_damerau_against_search():
    for a, b in itertools.product(["", "a", "ab", "ba", "abc", "cab", "acb", "bca"], repeat=2):
        assert D.damerau(list(a), list(b)) == osa_free(a, b), (a, b)
    assert D.damerau(list("ca"), list("abc")) == 2


@settings(max_examples=60, deadline=None)
@given(symbols, symbols)
def test_score_properties(a, b):
    assert D.edit_of(a, a) == 0
    assert D.edit_of(a, b) <= len(D.python_tokens(b))
    assert 0 <= D.ter_of(a, b) <= 1 and D.ter_of(a, a) == 0
    assert 0 <= D.chrf_of(a, b) <= 100
    g, h = graph.graph_of(a), graph.graph_of(b)
    assert graph.graph_edit_of(a, a) == 0
    assert 0 <= graph.graph_edit_of(a, b, 100) <= graph.size_of(g) + graph.size_of(h)


words = st.lists(st.sampled_from("abcd"), max_size=70)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_bit_vectors_equal_the_table(a, b):
    assert D.token_edits(a, b) == D._levenshtein(a, b)


def plain_chrf(p, g):
    from collections import Counter

    p, g = "".join(p.split()), "".join(g.split())
    pr, re, k = 0.0, 0.0, 0
    for n in range(1, 7):
        x, y = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (p, g))
        if x and y:
            pr, re, k = pr + sum((x & y).values()) / sum(x.values()), re + sum((x & y).values()) / sum(y.values()), k + 1
    return 100 * 5 * pr * re / k / (4 * pr + re) if k and pr + re else 0.0


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=25), st.text("abc ", max_size=25), st.text("ab", max_size=10))
def test_chrf_equals_the_plain_count(a, b, shared):
    for p, g in ((a, b), (shared + a, shared + b), (a + shared, b + shared), (a + shared + b, a + b)):
        assert D.chrf_of(p, g) == pytest.approx(plain_chrf(p, g))


def test_ter_counts_a_shift_once():
    assert D.ter_of("a b c d", "b c d a") == pytest.approx(0.25)


def test_graphs_by_hand():
    g = graph.graph_of("A ⊑ B")
    assert g.labels == ["⊑", "B", "A"] and g.edges == [(1, 0, "0"), (2, 0, "1")]
    assert graph.graph_of("A").edges == [(0, 0, "0")]
    assert graph.graph_of("(A ⊓ B) ⊑ C").labels == ["⊑", "C", "(A ⊓ B)"]
    assert graph.graph_of("A ⊑ B ⊑ C").edges[0][1] == 0 and len(graph.graph_of("A ⊑ B ⊑ C").labels) == 5
    assert graph.graph_edit_of("A ⊑ C", "A ⊑ B") == 1
    assert graph.graph_edit_of("", "A ⊑ B") == 4


def brute_ged(a, b):
    """All placements of a's nodes, root on root."""
    ea, eb = graph._edge_map(a), graph._edge_map(b)
    best = 10**9
    for image in itertools.product(range(-1, len(b.labels)), repeat=len(a.labels) - 1):
        if len({j for j in image if j >= 0}) < sum(j >= 0 for j in image) or 0 in image:
            continue
        place = (0, *image)
        cost = sum(1 if j < 0 else a.labels[i] != b.labels[j] for i, j in enumerate(place)) + len(b.labels) - sum(j >= 0 for j in place)
        used = set()
        for (x, y), label in ea.items():
            key = (min(place[x], place[y]), max(place[x], place[y]))
            if key in eb and min(key) >= 0:
                used.add(key)
                cost += eb[key] != label
            else:
                cost += 1
        best = min(best, cost + len(eb) - len(used))
    return best


@pytest.mark.parametrize("pair", [("A ⊓ B ⊑ C", "A ⊑ C"), ("A ⊑ ∃r.B", "A ⊑ ∃s.C"), ("A", "B ⊑ C"), ("A ⊓ B ⊑ C", "B ⊓ A ⊑ C"), ("A ⊔ B", "A ⊓ B ⊓ C")])
def test_graph_edit_is_exact_within_the_budget(pair):
    a, b = map(graph.graph_of, pair)
    assert graph.edit_distance(a, b, 10**6) == brute_ged(a, b)


def test_graph_edit_of_long_formulas_is_proven(spark):
    clause = "∃{}.(PhysicalProperty ⊓ ∃hasUnit.string[\"{}\"] ⊓ ∃hasValue.int[{}])"
    right = "Tank ⊓ ∃locatedIn.Room ⊓ ∃madeOf.Brass ⊓ ∃exposedTo.Ice ⊑ ∃hasFeature.Plug ⊓ " + clause.format("hasLoad", "kN", 7) + " ⊓ ∃verifiedBy.Test ⊓ ∃hasTime.string[\"after trials\"]"
    # a clause more, the same clauses in another order, another sentence of formulas behind it
    more = right + " ⊓ ∃locatedIn.Hall"
    turned = " ⊓ ".join(reversed(right.split(" ⊑ ")[0].split(" ⊓ "))) + " ⊑ " + right.split(" ⊑ ")[1]
    two = "Tank ⊓ ¬∃exposedTo.Ice ⊑ " + right.split(" ⊑ ")[1] + " | Crane ⊑ ∃hasFeature.Valve"
    df = spark.createDataFrame([(1, more, right), (2, turned, right), (3, two, right), (4, right, right)], "k int, f string, g string")
    got = {r.k: r.d for r in df.select("k", graph.graph_edit("f", "g").alias("d")).collect()}
    assert got == {1: 4, 2: 0, 3: graph.edit_bounds_of(two, right)[0], 4: 0}
    a, b = graph.graph_of(two), graph.graph_of(right)
    assert graph.distance_bounds(a, b) == graph.distance_bounds(b, a)


@settings(max_examples=150, deadline=None)
@given(symbols, symbols)
def test_graph_edit_equals_all_placements(a, b):
    a, b = graph.graph_of(a), graph.graph_of(b)
    if (len(b.labels) + 1) ** (len(a.labels) - 1) <= 20_000:
        assert graph.distance_bounds(a, b) == (brute_ged(a, b),) * 2


def test_an_unfinished_search_is_marked(monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 1)
    f, g = (" ⊓ ".join(f"∃r.(A ⊓ ∃s.{x})" for x in names) + " ⊑ C" for names in ("ABCD", "EFGHI"))
    least, most = graph.edit_bounds_of(f, g, 0)
    true = graph.graph_edit_of(f, g)
    assert least <= true <= most and least < most
    assert graph.proven_edit_of(f, g, 0) == graph.NO_RESULT and graph.proven_edit_of(f, g) == true


def test_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(D.cosine_similarity("a", "b").alias("c"), D.l2("a", "b").alias("l"), D.semantic("a", "b").alias("s")).collect()
    assert got[0].c == 0 and got[0].l == pytest.approx(2**0.5) and got[1].s == pytest.approx(0)
    assert got[2].c is None and got[3].l is None and got[4].c is None


def test_parts(spark):
    df = spark.createDataFrame([("A ⊓ ∃r.(B ⊓ C) ⊑ D ⊔ A",), ("",), (None,)], "t string").select(formula.parts("t").alias("p"), formula.too_long(F.lit("a " * 700)).alias("l"))
    got = df.collect()
    assert got[0].p == ["A", "D", "∃r.(B ⊓ C)"] and got[1].p == [""] and got[2].p is None and got[0].l
    assert formula.bare("∃r.(A ⊓ B)") == "∃r.A ⊓ B" and formula.bare("(A") == "(A"


@pytest.mark.parametrize(
    "text,good",
    [
        (None, True), ("", True), (" ", True), ("A ⊑ B", True), ("A ⊓ ∃r.(B ⊔ C) ⊑ ∃h.string[\"a ⊑ b\"]", True), ("A ⊑ B | C ⊑ ∃r.D", True), ("A ⊑ B |", False), ("A ⊓ B", False),
        ("A ⊑ B ⊑ C", False), ("A ⊒ B", False), ("A ⊑ (B", False), ("A ⊑ B)", False), ("A ⊑ ⊓ B", False), ("A ⊓ ⊑ B", False), ("⊑ B", False), ("A ⊑", False), ("A ⊑ ∃r", False), ("A ⊑ ∃.B", False),
        ("A ⊑ ∃r.", False), ("A ⊑ ∃r.(B]", False), ('A ⊑ ∃h.string["x', False), ("A ⊓ (B ⊑ C)", False), ("(A ⊑ B)", False), ("0", False),
    ],
)
def test_valid_formulas(text, good):
    assert formulas_valid(text) is good
