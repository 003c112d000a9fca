"""Cheapest paths against Dijkstra, and restriction inference on hand-made merged graphs."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tests.test_line_graph import graph, rows
from tramlines.lineage import cut
from tramlines.operators import routing

STAR = {"m": (0, 0), "a": (-200, 0), "b": (200, 0), "c": (0, 200), "d": (0, -200)}


def table(spark, arcs):
    return spark.createDataFrame(arcs, "line_id string, arc string, next string, cost double")


def starts(spark, given):
    return spark.createDataFrame(given, "query string, line_id string, arc string, bound double")


def test_first_edge_costs_nothing(spark):
    steps = table(spark, [("1", "ab", "bc", 10.0), ("1", "bc", "cd", 10.0), ("2", "ab", "cd", 1.0)])
    got = rows(routing.cheapest(starts(spark, [("q", "1", "ab", 100.0)]), steps), "arc", "cost", "prev")
    assert got == [("ab", 0.0, None), ("bc", 10.0, "ab"), ("cd", 20.0, "bc")]
    assert rows(routing.cheapest(starts(spark, [("q", "1", "ab", 20.0)]), steps), "arc") == [("ab",), ("bc",)]
    assert rows(routing.cheapest(starts(spark, []), steps)) == []


def test_equals_dijkstra(spark):
    rng = random.Random(1)
    arcs = [(str(line), f"n{i}", f"n{j}", float(rng.randrange(1, 9))) for line in range(2) for i, j in (rng.sample(range(40), 2) for _ in range(90))]
    cheapest = {}
    for line, i, j, c in arcs:
        cheapest[line, i, j] = min(c, cheapest.get((line, i, j), 99))
    given = [(f"q{k}", str(k % 2), f"n{s}", 15.0 + k) for k in range(6) for s in rng.sample(range(40), 2)]
    want = set()
    for q in {g[0] for g in given}:
        line, bound = next((g[1], g[3]) for g in given if g[0] == q)
        best, heap = {}, [(0.0, g[2]) for g in given if g[0] == q]
        while heap:
            c, n = heapq.heappop(heap)
            if n in best:
                continue
            best[n] = c
            for (ln, i, j), w in cheapest.items():
                if ln == line and i == n and c + w < bound:
                    heapq.heappush(heap, (c + w, j))
        want |= {(q, n, c) for n, c in best.items()}
    got = routing.cheapest(starts(spark, given), table(spark, [(ln, i, j, w) for (ln, i, j), w in cheapest.items()]))
    assert {(r.query, r.arc, r.cost) for r in got.collect()} == want


def identity(spark, g):
    return g.edges.select("edge_id", F.col("edge_id").alias("original_id"))


RULES = routing.Inference(aggregate=20, check=20, deviation=60)


def test_own_graph_gives_its_own_exceptions(spark):
    g = graph(spark, STAR, {"1": [(n, "m", None) for n in "abcd"], "2": [("a", "m", None), ("b", "m", None)]}, [("m", "1", "a-m", "b-m"), ("m", "1", "c-m", "d-m")])
    got = routing.infer_restrictions(g.with_(exceptions=None), g, identity(spark, g), RULES)
    assert rows(got.exceptions, "line_id", "edge_a", "edge_b") == [("1", "a-m", "b-m"), ("1", "b-m", "a-m"), ("1", "c-m", "d-m"), ("1", "d-m", "c-m")]
    free = routing.infer_restrictions(g, g.with_(exceptions=None), identity(spark, g), RULES)
    assert rows(free.exceptions) == []


def test_merged_nodes_keep_apart_what_was_apart(spark):
    """Two crossings of one line, twenty apart, were merged into one node."""
    old = graph(
        spark, {"a": (-200, 10), "p": (0, 10), "b": (200, 10), "c": (10, 200), "q": (10, -10), "d": (10, -200)},
        {"1": [("a", "p", None), ("b", "p", None), ("c", "q", None), ("d", "q", None)]},
    )
    new = graph(spark, STAR, {"1": [(n, "m", None) for n in "abcd"]})
    origins = spark.createDataFrame([("a-m", "a-p"), ("b-m", "b-p"), ("c-m", "c-q"), ("d-m", "d-q")], "edge_id string, original_id string")
    got = routing.infer_restrictions(new, old, origins, RULES)
    want = sorted((x, y) for p in "ab" for q in "cd" for x, y in ((f"{p}-m", f"{q}-m"), (f"{q}-m", f"{p}-m")))
    assert rows(got.exceptions, "edge_a", "edge_b") == want
    # A long way round does not count, a short one does.
    joined = graph(
        spark, {"a": (-200, 10), "p": (0, 10), "b": (200, 10), "c": (10, 200), "q": (10, -10), "d": (10, -200)},
        {"1": [("a", "p", None), ("b", "p", None), ("c", "q", None), ("d", "q", None), ("p", "q", None)]},
    )
    assert rows(routing.infer_restrictions(new, joined, origins, RULES).exceptions) == []
    strict = routing.Inference(aggregate=20, check=20, deviation=5)
    assert rows(routing.infer_restrictions(new, joined, origins, strict).exceptions, "edge_a", "edge_b") == want


def test_single_directions_are_not_asked_for(spark):
    """Two edges that both lead to the node need no exception; a line against its direction finds no way."""
    new = graph(spark, STAR, {"1": [("a", "m", "m"), ("b", "m", "m"), ("c", "m", "c")]})
    old = graph(spark, STAR, {"1": [("a", "m", "m"), ("b", "m", "b"), ("c", "m", "c")]})
    got = routing.infer_restrictions(new, old, identity(spark, new), RULES)
    assert rows(got.exceptions, "edge_a", "edge_b") == [("b-m", "c-m"), ("c-m", "b-m")] or rows(got.exceptions) == []
    # b leads away in the original, so b to c is no way; b has no other edge to go on to: its exceptions are lifted.
    assert rows(got.exceptions) == []


def lifted_one_by_one(edges, exceptions):
    """edges {edge: inward or None}, exceptions {frozenset}: the rule applied edge by edge in name order."""
    left = set(exceptions)
    goes = lambda a, b: (edges[a] is None or edges[b] is None or edges[a] != edges[b]) and frozenset((a, b)) not in left
    for a in sorted(edges):
        if len(edges) > 1 and not any(goes(a, b) for b in edges if b != a):
            left -= {e for e in left if a in e}
    return left


@pytest.mark.parametrize("seed", range(3))
def test_dead_ends_are_lifted_in_name_order(spark, seed):
    rng = random.Random(seed)
    nodes, lines, banned, want = {}, {}, [], set()
    for k in range(8):
        hub, arms = f"m{k}", [f"{c}{k}" for c in "abcd"[: rng.randrange(2, 5)]]
        nodes |= {hub: (k * 10, 0)} | {n: (k * 10 + i, 5) for i, n in enumerate(arms)}
        inward = {n: rng.choice([None, True, False, True]) for n in arms}
        lines.setdefault("1", []).extend((n, hub, None if inward[n] is None else hub if inward[n] else n) for n in arms)
        named = {"-".join(sorted((n, hub))): inward[n] for n in arms}
        pairs = {frozenset((a, b)) for a in named for b in named if a < b and rng.random() < 0.8}
        banned += [(hub, "1", *sorted(p)) for p in pairs]
        want |= {(hub, x, y) for p in lifted_one_by_one(named, pairs) for x in p for y in p if x != y}
    g = graph(spark, nodes, lines, banned)
    assert set(rows(routing.lift_dead_ends(g).exceptions, "node_id", "edge_a", "edge_b")) == want


def test_a_search_knows_rides_and_not_their_pieces(spark, monkeypatch):
    """However many handles cut an original edge, a search has a step for each turn, and numbers for names."""
    old = graph(spark, {"a": (-200, 0), "m": (0, 0), "b": (200, 0)}, {"1": [("a", "m", None), ("m", "b", None)]})
    new = graph(spark, {"a": (-200, 0), "p": (-100, 0), "m": (0, 0), "b": (200, 0)}, {"1": [("a", "p", None), ("p", "m", None), ("m", "b", None)]})
    origins = spark.createDataFrame([("a-p", "a-m"), ("m-p", "a-m"), ("b-m", "b-m")], "edge_id string, original_id string")
    seen, search = [], routing.cheapest
    monkeypatch.setattr(routing, "cheapest", lambda starts, steps, *a, **k: seen.append((starts, steps)) or search(starts, steps, *a, **k))
    got = routing.infer_restrictions(new, old, origins, RULES)
    assert rows(got.exceptions) == []
    ((begun, steps),) = seen
    assert {t for d in (begun, steps) for _, t in d.dtypes} == {"bigint", "double"}
    # At each of three nodes back over the same edge, and at the middle one straight on, both ways.
    assert steps.count() == 6


def test_a_cut_computes_its_rows_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            counted.add(len(f))
            yield f

    table = cut(spark.range(100).mapInPandas(run, "id long"))
    assert (table.count(), counted.value) == (100, 100)
    assert rows(cut(spark.range(0)), "id") == []
