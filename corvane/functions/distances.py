"""Distances between a predicted and a correct formula, and between vectors.

Every score is NULL if either text is NULL, or if its denominator is 0. Distances that array operations can express stay
in the JVM; the others are Arrow UDFs that work batch by batch and score equal pairs once. (The word error rate could use
the built-in edit distance on coded words, but finding each word's code in an array took eight times as long.)
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.formula import PART_SYMBOLS, split_at_top, token_set, tokens

# Orders and weight of the character n-gram score.
CHRF_ORDER, CHRF_BETA = 6, 2.0


def set_index(x: Column, y: Column) -> Column:
    """Shared / all of two arrays, as sets."""
    common = F.size(F.array_intersect(x, y))
    return common / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - common)


def jaccard_index(a: Column | str, b: Column | str) -> Column:
    return set_index(token_set(a), token_set(b))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """1 - shared tokens / all tokens."""
    return F.lit(1.0) - jaccard_index(a, b)


def _pairwise(kind: T.DataType, score: Callable[[str, str], float | int | None]):
    """An Arrow UDF of two texts; a pair that occurs several times in a batch is scored once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float | int | None] = {}
        out = []
        for pair in zip(a, b):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in seen:
                seen[pair] = score(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def token_edits(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two token lists, a whole row of the table at a time in the bits of one number (Hyyrö)."""
    a, b = _trim(a, b)
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for t in b:
        match = where.get(t, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(diagonal | up) & full, up & diagonal
        distance += bool(rise & last) - bool(fall & last)
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(diagonal | rise)) & full, rise & diagonal & full
    return distance


def wer_of(predicted: str, gold: str) -> float | None:
    words = gold.split()
    return token_edits(predicted.split(), words) / len(words) if words else None


word_error_rate = _pairwise(T.DoubleType(), wer_of)  # NULL if the correct text has no words; may exceed 1


def python_tokens(text: str) -> list[str]:
    """The same tokens as ``formula.tokens``."""
    import re

    text = text.replace("[", " ").replace("]", "")
    text = re.sub("([∃∀¬])", r"\1 ", text)
    text = re.sub("([≥≤=][0-9])", r"\1 ", text)
    return re.split("[ .]", text.replace("(", "").replace(")", ""))


def damerau(a: list[str], b: list[str]) -> int:
    """Edits with unrestricted transpositions of neighbours (Lowrance and Wagner)."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        return len(a) + len(b)
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [far, i]
        prev, match = rows[i], 0
        for j, y in enumerate(b, 1):
            seen = last.get(y, 0)
            if x == y:
                best = prev[j]
            else:
                best = min(prev[j], row[j], prev[j + 1]) + 1
            swap = rows[seen][match] + (i - seen - 1) + 1 + (j - match - 1)
            row.append(min(best, swap))
            if x == y:
                match = j
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


def edit_of(predicted: str, gold: str) -> int:
    """The smaller of the distances from the prediction and from an empty formula."""
    g = python_tokens(gold)
    empty = len(g) - (1 if "" in g else 0)
    return 0 if predicted == gold and g else min(damerau(python_tokens(predicted), g), empty)


edit = _pairwise(T.IntegerType(), edit_of)


def norm_edit(distance: Column, gold: Column | str) -> Column:
    return distance / F.size(tokens(gold))


def changed_parts_of(predicted: str, gold: str, axiom_symbol: str = "⊑") -> float | None:
    a, b = predicted.split(axiom_symbol), gold.split(axiom_symbol)
    if len(a) < 2 or len(b) < 2:
        return None
    pairs = [(set(split_at_top(x, PART_SYMBOLS)), set(split_at_top(y, PART_SYMBOLS))) for x, y in zip(a[:2], b[:2])]
    return 1 - sum(len(x & y) for x, y in pairs) / sum(len(y) for _, y in pairs)


changed_parts = _pairwise(T.DoubleType(), changed_parts_of)


def _trim(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Without what both begin and end with, which costs nothing."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k = 0
    while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
        k += 1
    return (a[:-k], b[:-k]) if k else (a, b)


def _levenshtein(a: list[str], b: list[str]) -> int:
    a, b = _trim(a, b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(diagonal + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _faults(a: list[str], b: list[str]) -> tuple[list[bool], list[bool]]:
    """Which tokens of either side an optimal alignment doesn't match."""
    table = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        above, row = table[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j - 1] + (x != y), above[j] + 1, row[j - 1] + 1))
        table.append(row)
    bad_a, bad_b = [True] * len(a), [True] * len(b)
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1] and table[i][j] == table[i - 1][j - 1]:
            bad_a[i - 1] = bad_b[j - 1] = False
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return bad_a, bad_b


def ter_of(predicted: str, gold: str, longest_shift: int = 10) -> float | None:
    """Translation edit rate: edits and block shifts / tokens of the correct formula, at most 1.

    Shifts are chosen greedily: of all blocks that also stand in the correct formula, elsewhere, the move that saves most
    edits is made, as long as it saves more than the one edit it costs. Only blocks with a token out of place are moved,
    and only to places where the correct formula has an unmatched token.
    """
    p, g = python_tokens(predicted), python_tokens(gold)
    shifts, now = 0, _levenshtein(p, g)
    while now > 1:
        bad_p, bad_g = _faults(p, g)
        places: dict[tuple[str, ...], list[int]] = {}
        for n in range(1, min(longest_shift, len(g)) + 1):
            for i in range(len(g) - n + 1):
                if any(bad_g[i : i + n]):
                    places.setdefault(tuple(g[i : i + n]), []).append(i)
        best, chosen = now, None
        for n in range(min(longest_shift, len(p)), 0, -1):
            for i in range(len(p) - n + 1):
                if not any(bad_p[i : i + n]):
                    continue
                block = p[i : i + n]
                for to in places.get(tuple(block), ()):
                    if to == i:
                        continue
                    rest = p[:i] + p[i + n :]
                    moved = rest[:to] + block + rest[to:]
                    if (d := _levenshtein(moved, g)) < best:
                        best, chosen = d, moved
            if chosen is not None and now - best > n:
                break
        if chosen is None or best + 1 >= now:
            break
        p, now, shifts = chosen, best, shifts + 1
    return min(1.0, (now + shifts) / len(g))


ter = _pairwise(T.DoubleType(), ter_of)


def chrf_of(predicted: str, gold: str, order: int = CHRF_ORDER, beta: float = CHRF_BETA) -> float:
    """Character n-gram F score in per cent, blanks left out, averaged over the orders that either text has."""
    p, g = "".join(predicted.split()), "".join(gold.split())
    if p == g:
        return 100.0 if p else 0.0
    # what both begin or end with matches by itself; only n-grams that touch the middle are counted
    short = min(len(p), len(g))
    head = next((i for i in range(short) if p[i] != g[i]), short)
    tail = next((i for i in range(short - head) if p[-1 - i] != g[-1 - i]), short - head)
    precision, recall, n_orders = 0.0, 0.0, 0
    for n in range(1, min(order, short) + 1):
        first = max(0, head - n + 1)
        x, y = (Counter(t[i : i + n] for i in range(first, min(len(t) - tail, len(t) - n + 1))) for t in (p, g))
        same = first + max(0, tail - n + 1) + sum((x & y).values())
        precision += same / (len(p) - n + 1)
        recall += same / (len(g) - n + 1)
        n_orders += 1
    if not n_orders:
        return 0.0
    precision, recall = precision / n_orders, recall / n_orders
    weight = beta * beta
    return 100 * (1 + weight) * precision * recall / (weight * precision + recall) if precision + recall else 0.0


chrf = _pairwise(T.DoubleType(), chrf_of)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """NULL for vectors of different lengths or of length 0."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(F.size(x) == F.size(y), _dot(x, y) / F.nullif(F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y)), F.lit(0.0)))


def semantic(a: Column | str, b: Column | str) -> Column:
    """1 - cosine similarity."""
    return F.lit(1.0) - cosine_similarity(a, b)


def l2(a: Column | str, b: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    squares = F.zip_with(x, y, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q))
    return F.when(F.size(x) == F.size(y), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)))
