"""Formulas as labelled graphs, and the edit distance between them.

The graph of a formula has a node for each operator, quantified property and concept. ⊑ binds loosest, then ⊓, then ⊔, then
the dot; operands are numbered from the right. An edge to node 0 carries a running number as its label, other edges none;
a formula without ⊑ has an edge from its root to itself. A second ⊑ gives a node without an edge. Parentheses are taken
off the operands of ⊓, ⊔ and of a single dot, not off the sides of ⊑.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.distances import _pairwise
from corvane.functions.formula import bare, split_at_top

# Steps of the search behind the bound (some 20 s, the time the reference allows), rounds of prices, and rounds without gain.
BUDGET = 1_000_000
ROUNDS, PATIENCE = 200, 20
NO_RESULT = 9999

SCHEMA = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("label", T.StringType())]))),
        T.StructField("edges", T.ArrayType(T.StructType([T.StructField("src", T.IntegerType()), T.StructField("dst", T.IntegerType()), T.StructField("label", T.StringType())]))),
    ]
)


@dataclass
class Graph:
    labels: list[str] = field(default_factory=list)
    edges: list[tuple[int, int, str | None]] = field(default_factory=list)

    def node(self, label: str, parent: int, linked: bool = True) -> int:
        me = len(self.labels)
        self.labels.append(label)
        if linked:
            number = sum(e[2] is not None for e in self.edges)
            self.edges.append((me, parent, str(number) if parent == 0 else None))
        return me


def graph_of(formula: str) -> Graph:
    g = Graph()
    todo: list[tuple[str, int]] = [(formula, 0)]
    while todo:
        text, parent = todo.pop()
        sides = split_at_top(text, "⊑")
        if len(sides) > 1:
            me = g.node("⊑", parent, linked=len(sides) == 2 and len(g.labels) > 0)
            todo += [(sides[0], me), (sides[1] if len(sides) == 2 else " ⊑ ".join(sides[1:]), me)]
            continue
        for operator in "⊓⊔":
            pieces = split_at_top(text, operator)
            if len(pieces) > 1:
                me = g.node(operator, parent)
                todo += [(bare(p), me) for p in pieces]
                break
        else:
            head, *rest = split_at_top(text, ".")
            me = g.node(head, parent)
            if len(rest) == 1:
                todo.append((bare(rest[0]), me))
            elif rest:
                todo.append((".".join(rest), me))
    return g


def size_of(g: Graph) -> int:
    return len(g.labels) + len(g.edges)


def _edge_map(g: Graph) -> dict[tuple[int, int], str | None]:
    return {(min(a, b), max(a, b)): label for a, b, label in g.edges}


def distance_bounds(a: Graph, b: Graph, budget: int = BUDGET) -> tuple[int, int]:
    """(at least, at most) the fewest node and edge edits that turn a into b, root on root; equal unless ``budget`` ran out.

    Nodes cost 1 unless their labels are equal, edges 1 to insert or delete, and 1 to change unless their labels are equal
    or both absent. The smaller graph's nodes all find a partner, so the distance is the larger one's nodes and all edges
    less what the placement keeps: 1 for equal labels, 2 for an edge, 1 for an edge with another label.

    A node has one edge to an earlier node at most. So if several nodes were allowed the same partner, the best placement
    would follow from the leaves upwards, exactly. That is the bound; prices on partners that are wanted more than once
    lower it (Lagrangian relaxation), and the placements on the way give the other bound. What is left between the two is
    searched depth first, for one value after the other, losing no more against the bound than the value allows.
    """
    if len(a.labels) > len(b.labels):
        a, b = b, a
    n, m = len(a.labels), len(b.labels)
    ea, eb = _edge_map(a), _edge_map(b)
    whole = m + len(ea) + len(eb)
    if not n:
        return whole, whole
    up: list[int] = [-1] * n
    tag: list[str | None] = [None] * n
    for (x, y), label in ea.items():
        if x != y:
            up[y], tag[y] = x, label
    root = (a.labels[0] == b.labels[0]) + ((0, 0) in ea and (0, 0) in eb) * (1 + (ea.get((0, 0)) == eb.get((0, 0))))
    nowhere = m
    steps = {t: [(q, j, 2 if label == t else 1) for (x, y), label in eb.items() if x != y for q, j in ((x, y), (y, x)) if j] for t in set(tag)}
    near: dict[str | None, list[dict[int, int]]] = {t: [{} for _ in range(m + 1)] for t in steps}
    for t, links in steps.items():
        for q, j, w in links:
            near[t][q][j] = w
    same: dict[str, list[int]] = {}
    for j in range(1, m):
        same.setdefault(b.labels[j], []).append(j)

    def relaxed(price: list[float]) -> tuple[float, list[list[float]], list[list[float]]]:
        """The bound; for each node what it and all below it keep at each place, and at most if its parent is at each place."""
        sums: list[list[float] | None] = [None] * n
        most: list[list[float]] = [[]] * n
        free = [-1e9, *(-x for x in price[1:]), 0.0]
        total = sum(price) + root
        for i in range(n - 1, 0, -1):
            v = sums[i] = free[:] if sums[i] is None else [x + y for x, y in zip(sums[i], free)]
            for j in same.get(a.labels[i], ()):
                v[j] += 1
            top = max(v)
            u = most[i] = [top] * (m + 1)
            if up[i] < 0:
                total += top
                continue
            for q, j, w in steps[tag[i]]:
                if v[j] + w > u[q]:
                    u[q] = v[j] + w
            sums[up[i]] = u if sums[up[i]] is None else [x + y for x, y in zip(sums[up[i]], u)]
        return total + (sums[0][0] if sums[0] else 0), sums, most

    def placed(value: list[list[float]], most: list[list[float]], once: bool) -> tuple[int, list[int]]:
        """What the best places from the root downwards keep, and how often each is taken; once: none twice."""
        place, used, kept = [0] * n, [1] + [0] * m, root
        for i in range(1, n):
            q = place[up[i]] if up[i] >= 0 else nowhere
            v, links = value[i], near[tag[i]][q]
            best, at = max(((v[j] + w, j) for j, w in links.items() if not (once and used[j])), default=(-1e18, nowhere))
            if best < most[i][q]:
                x, j = max((x, j) for j, x in enumerate(v) if j == nowhere or not used[j]) if once else (max(v), v.index(max(v)))
                at = j if x > best else at
            place[i] = at
            if at != nowhere:
                used[at] += 1
                kept += (a.labels[i] == b.labels[at]) + links.get(at, 0)
        return kept, used

    price = [0.0] * m
    low, best, pace, idle = -1, None, 1.0, 0
    for _ in range(ROUNDS):
        total, value, most = relaxed(price)
        low = max(low, placed(value, most, True)[0])
        if best is None or total < best[0] - 1e-9:
            best, idle = (total, value, most, price[:]), 0
        elif (idle := idle + 1) == PATIENCE:
            pace, idle = pace / 2, 0
        if int(best[0] + 1e-6) <= low:
            return whole - low, whole - low
        used = placed(value, most, False)[1]
        slope = [0, *(used[j] - 1 if used[j] > 1 or price[j] > 0 else 0 for j in range(1, m))]
        norm = sum(g * g for g in slope)
        if not norm:
            break
        price = [max(0.0, x + pace * max(0.25, total - low) / norm * g) for x, g in zip(price, slope)]
    total, value, most, price = best
    spent = 0

    def moves(i: int, place: list[int], taken: list[bool], slack: float) -> list[tuple[float, int]]:
        q = place[up[i]] if up[i] >= 0 else nowhere
        links, top = near[tag[i]][q], most[i][q]
        losses = ((top - x - links.get(j, 0), j) for j, x in enumerate(value[i]) if not taken[j])
        return sorted(move for move in losses if move[0] <= slack)

    for high in range(int(total + 1e-6), low, -1):
        place, taken = [0] * n, [True] + [False] * m
        slack = [total - high + 1e-6] * n
        todo = [iter(())] * n
        i = 1
        if n > 1:
            todo[1] = iter(moves(1, place, taken, slack[1]))
        while 0 < i < n:
            if 0 < place[i] < nowhere:
                taken[place[i]] = False
            place[i] = 0
            loss, j = next(todo[i], (0.0, 0))
            if not j:
                i -= 1
                continue
            place[i], taken[j] = j, j != nowhere
            left = slack[i] - loss
            if i + 1 == n:
                if sum(x for x, t in zip(price, taken) if not t) <= left:
                    return whole - high, whole - high
                continue
            spent += 1
            if spent > budget:
                return whole - high, whole - low
            i += 1
            slack[i] = left
            todo[i] = iter(moves(i, place, taken, left))
    return whole - low, whole - low


def edit_distance(a: Graph, b: Graph, budget: int = BUDGET) -> int:
    """The distance, or the best found when ``budget`` ran out (see ``distance_bounds``)."""
    return distance_bounds(a, b, budget)[1]


def edit_bounds_of(predicted: str, gold: str, budget: int = BUDGET) -> tuple[int, int]:
    """(at least, at most) the smaller of the distances from the prediction and from a lone ⊑ to the correct formula."""
    if predicted == gold:
        return 0, 0
    b = graph_of(gold)
    alone = (b.labels[0] != "⊑") + size_of(b) - 1
    least, most = distance_bounds(graph_of(predicted), b, budget)
    return min(least, alone), min(most, alone)


def graph_edit_of(predicted: str, gold: str, budget: int = BUDGET) -> int:
    return edit_bounds_of(predicted, gold, budget)[1]


def proven_edit_of(predicted: str, gold: str, budget: int = BUDGET) -> int:
    """The distance, or NO_RESULT if the search wasn't finished."""
    least, most = edit_bounds_of(predicted, gold, budget)
    return most if least == most else NO_RESULT


graph_edit = _pairwise(T.IntegerType(), proven_edit_of)


@F.pandas_udf(SCHEMA)
def parsed(text: pd.Series) -> pd.DataFrame:
    graphs = [graph_of(t) if t is not None else None for t in text]
    return pd.DataFrame(
        {
            "nodes": [None if g is None else [{"id": i, "label": x} for i, x in enumerate(g.labels)] for g in graphs],
            "edges": [None if g is None else [{"src": a, "dst": b, "label": x} for a, b, x in g.edges] for g in graphs],
        }
    )


@F.pandas_udf(T.IntegerType())
def graph_size(text: pd.Series) -> pd.Series:
    """Nodes and edges."""
    return pd.Series([None if t is None else size_of(graph_of(t)) for t in text], dtype=object)
