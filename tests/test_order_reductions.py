"""Order graph: ends hung on nodes of their own, and lines that always run together taken as one."""

from tests.test_line_graph import graph, rows
from tramlines.operators import algebra, ordergraph

STAR = {"m": (0, 0), "a": (-1, 0), "b": (1, 0), "c": (0, 1), "d": (0, 2), "e": (1, 1)}


def test_ends_are_hung_on_nodes_of_their_own(spark):
    # 1 runs a-m-b; 2 ends at m on m-c, which goes on to d; its exception at m is void, the one at c moves along.
    g = graph(spark, STAR, {"1": [("a", "m", None), ("m", "b", None)], "2": [("c", "m", "m"), ("c", "d", None), ("c", "e", None)]}, [("m", "2", "c-m", "a-m"), ("c", "2", "c-m", "c-e")])
    out = ordergraph.detach_ends(g.tracked())
    new = "c-m|c\\-m"
    assert rows(out.edges, "edge_id", "a", "b") == [("a-m", "a", "m"), ("b-m", "b", "m"), ("c-d", "c", "d"), ("c-e", "c", "e"), (new, "c", "m|c-m")]
    assert rows(out.occs, "edge_id", "line_id", "direction") == [("a-m", "1", None), ("b-m", "1", None), ("c-d", "2", None), ("c-e", "2", None), (new, "2", "m|c-m")]
    assert rows(out.exceptions, "node_id", "edge_a", "edge_b") == [("c", "c-e", new), ("c", new, "c-e")]
    assert rows(out.nodes.where("node_id = 'm|c-m'"), "x", "y") == [(0.0, 0.0)] and (new, "c-m") in rows(out.origins, "edge_id", "original_id")
    assert {r.node_id: r.degree for r in algebra.degrees(out).collect()} == {"a": 1, "b": 1, "c": 3, "d": 1, "e": 1, "m": 2, "m|c-m": 1}


def test_one_edge_of_a_node_stays(spark):
    g = graph(spark, STAR, {"1": [("a", "m", None)], "2": [("m", "b", None)], "3": [("c", "m", None)]})
    out = ordergraph.detach_ends(g)
    assert out.edges.count() == 3 and {r.node_id for r in algebra.degrees(out).collect()} == {"a", "b", "c", "m", "m|a-m", "m|b-m"}
    assert out.edges.where("edge_id = 'c-m'").count() == 1


LINE = {c: (i, 0) for i, c in enumerate("abcdefgh")} | {"x": (2, 1), "y": (3, 1)}


def path(text):
    return [(p, q, None) for p, q in zip(text, text[1:])]


def groups(g):
    return rows(ordergraph.partner_groups(g))


def test_lines_that_always_run_together(spark):
    together = {"1": path("abcd"), "2": path("abcd"), "3": path("abcde")}
    g = graph(spark, LINE, together)
    # 3 goes on beside the path of 1 and 2; its own path has nothing that runs along all of it.
    assert groups(g) == [("1", line, e) for line in "12" for e in ("a-b", "b-c", "c-d")]
    out = ordergraph.collapse_partners(g)
    assert rows(out.occs, "edge_id", "line_id", "partners") == [
        ("a-b", "1", ["1", "2"]), ("a-b", "3", None), ("b-c", "1", ["1", "2"]), ("b-c", "3", None), ("c-d", "1", ["1", "2"]), ("c-d", "3", None), ("d-e", "3", None)]


def test_what_parts_partners(spark):
    two = {"1": path("abcd"), "2": path("abcd")}
    # An exception at an inner node parts the one line that it forbids.
    assert groups(graph(spark, LINE, two, [("b", "2", "a-b", "b-c")])) == []
    # A branch of one line is no simple path, the other's path is left by it.
    assert groups(graph(spark, LINE, two | {"2": path("abcd") + path("cx")})) == []
    # An edge of another line between two nodes of the path makes it none; a closed line is none.
    assert groups(graph(spark, LINE, two | {"3": path("bd")})) == []
    assert groups(graph(spark, LINE, {"1": path("abca"), "2": path("abca")})) == []
    # Single edges and parts of one line that lie apart; opposite directions do not go on.
    apart = {"1": path("ab") + path("cde"), "2": path("ab") + path("cde"), "3": path("ab")}
    assert groups(graph(spark, LINE, apart)) == [("1", "1", "a-b"), ("1", "1", "c-d"), ("1", "1", "d-e"), ("1", "2", "a-b"), ("1", "2", "c-d"), ("1", "2", "d-e"), ("1", "3", "a-b")]
    assert groups(graph(spark, LINE, {"1": path("abc"), "2": [("a", "b", "b"), ("b", "c", "b")]})) == []


def test_no_lines(spark):
    g = graph(spark, LINE, {"1": path("ab")})
    empty = g.with_(edges=g.edges.limit(0), occs=g.occs.limit(0))
    assert groups(empty) == [] and ordergraph.detach_ends(empty).edges.count() == 0
