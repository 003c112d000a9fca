"""Lines at nodes kept with the graph, legs with their steps, and lists whose files do not multiply."""

import random

from tramlines.model import LineGraph
from tramlines.operators import aggregate, algebra, chains, ordering, structure


def _graph(spark, seed):
    r = random.Random(seed)
    nodes = spark.createDataFrame([(i, r.random(), r.random()) for i in range(9)], "node_id long, x double, y double")
    hops = [(a, b, r.choice("pqrs")) for a, b in ((r.randrange(9), r.randrange(9)) for _ in range(90)) if a != b]
    g = aggregate.line_graph(nodes, aggregate.occurrences(spark.createDataFrame(hops, "from_node long, to_node long, line_id string")))
    at = [tuple(t) for t in g.attached().select("node_id", "line_id", "edge_id").collect()]
    barred = [(n, k, e, f) for n, k, e in at for m, j, f in at if (n, k) == (m, j) and e != f and (hash((e, f)) if e < f else hash((f, e))) % 4 == 0]
    return g.with_(exceptions=spark.createDataFrame(barred, "node_id long, line_id string, edge_a string, edge_b string"))


def test_attached_lines_are_those_of_the_edges(spark):
    g = _graph(spark, 1)
    plain = LineGraph(g.nodes, g.edges, g.occs)
    key = lambda d: sorted(map(repr, d.attached().collect()))
    assert g.held is not None and key(g) == key(plain)
    assert "Join" not in g.attached()._jdf.queryExecution().optimizedPlan().toString()
    fewer = g.with_(occs=g.occs.where("line_id <> 'p'"))
    assert fewer.held is None and fewer.attached().where("line_id = 'p'").isEmpty()
    assert g.with_(nodes=g.nodes).held is not None


def test_turned_legs_are_legs_with_their_distance(spark):
    g = _graph(spark, 2)
    order = ordering.default_order(g)
    names = ["node_id", "line_id", "edge_a", "edge_b", "sa", "sb", "steps"]
    plain = ordering.legs_of(g, order).join(ordering.circular_distance(g), ["node_id", "edge_a", "edge_b"]).select(*names)
    got = sorted(map(tuple, ordering.turned_legs(g, order).select(*names).collect()))
    assert got and got == sorted(map(tuple, plain.collect()))


def test_pass_through_pairs_lines_at_nodes_of_two_edges_only(spark):
    g = _graph(spark, 3)
    found = structure.pass_through(g)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1  # the ends of edges, once
    lines = {r.edge_id: set() for r in g.edges.collect()}
    for r in g.occs.collect():
        lines[r.edge_id].add(r.line_id)
    at = {}
    for r in g.incidence().collect():
        at.setdefault(r.node_id, []).append(r.edge_id)
    on = {}
    for r in algebra.continuations(g).collect():
        on.setdefault((r.node_id, r.edge_a, r.edge_b), set()).add(r.line_id)
    want = [(n, *sorted(e)) for n, e in at.items() if len(e) == 2 and lines[e[0]] == lines[e[1]] == on.get((n, *sorted(e)))]
    assert sorted(map(tuple, found.select("node_id", "edge_a", "edge_b").collect())) == sorted(want)


def test_ranked_lists_keep_the_number_of_partitions(spark):
    n = 200
    items = spark.createDataFrame([(i, i + 1 if i < n else None, None) for i in range(n + 1)], "id long, next long, name string")
    ranked = chains.rank_lists(items)
    assert sorted((r.id, r.n) for r in ranked.collect()) == [(i, n - i + 1) for i in range(n + 1)]
    assert len(ranked.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
