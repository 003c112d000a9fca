"""Reductions before lines are ordered, and sizes of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import LineGraph, edge_key
from .algebra import continuations, degrees, termini
from .chains import rank_lists
from .numbering import numbered
from .structure import components


def cut_single(g: LineGraph, name=None) -> LineGraph:
    """Edges of one line cut in the middle into two dead ends, as their order is trivial.

    An edge one of whose nodes has no other edge is such an end already and stays.  Each half hangs on a
    new node near the middle (at 45 and 55 % from the smaller end) and keeps its line and its direction;
    exceptions follow the halves.  `name` (edge, half, 1 or 2) makes the new nodes' names.
    """
    name = name or (lambda edge, half: F.concat(edge.cast("string"), F.lit("|"), half.cast("string")))
    one = g.occs.groupBy("edge_id").agg(F.count("*").alias("n")).where("n = 1").select("edge_id")
    stump = degrees(g).where("degree < 2").select("node_id")
    ends = g.edges.join(one, "edge_id", "left_semi").join(stump.withColumnRenamed("node_id", "a"), "a", "left_anti").join(stump.withColumnRenamed("node_id", "b"), "b", "left_anti")
    halves = F.explode(F.array(F.struct(F.lit(1).alias("half"), F.col("a").alias("node"), F.lit(0.45).alias("share")), F.struct(F.lit(2).alias("half"), F.col("b").alias("node"), F.lit(0.55).alias("share"))))
    cuts = ends.select("edge_id", "a", "b", halves.alias("h")).select("edge_id", "a", "b", "h.half", "h.node", "h.share", name(F.col("edge_id"), F.col("h.half")).alias("end"))
    cuts = cut(cuts.withColumn("to", edge_key(F.col("node"), F.col("end"))))
    at = lambda c: g.nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"x_{c}"), F.col("y").alias(f"y_{c}"))
    new = cuts.join(at("a"), "a").join(at("b"), "b").select(F.col("end").alias("node_id"), F.expr("x_a + share * (x_b - x_a)").alias("x"), F.expr("y_a + share * (y_b - y_a)").alias("y"))
    rest = [c for c in g.occs.columns if c not in ("edge_id", "direction")]
    # Towards the half's own node, or away from it towards the cut.
    towards = F.when(F.col("direction") == F.col("node"), F.col("node")).when(F.col("direction").isNotNull(), F.col("end"))
    occs = g.occs.join(cuts, "edge_id").select(F.col("to").alias("edge_id"), towards.alias("direction"), *rest)
    whole = cuts.select("edge_id").distinct()
    edges = g.edges.join(whole, "edge_id", "left_anti").select("edge_id", "a", "b").union(cuts.select("to", F.least("node", "end"), F.greatest("node", "end")))
    exceptions = g.exceptions
    if exceptions is not None:
        for c in ("edge_a", "edge_b"):
            moved = cuts.select(F.col("edge_id").alias(c), F.col("node").alias("node_id"), "to")
            exceptions = exceptions.join(moved, [c, "node_id"], "left").withColumn(c, F.coalesce("to", c)).select("node_id", "line_id", "edge_a", "edge_b")
    return LineGraph(g.nodes.unionByName(new, allowMissingColumns=True), edges, g.occs.join(whole, "edge_id", "left_anti").select(*g.occs.columns).union(occs.select(*g.occs.columns)), exceptions, g.traced(cuts.select("edge_id", "to")))


def detached_ends(g: LineGraph) -> DataFrame:
    """(node_id, edge_id, end_id): ends of edges at which every line terminates; such an end can be hung
    on a node of its own (end_id), which takes the edge out of the node's order."""
    size = g.occs.groupBy("edge_id").agg(F.count("*").alias("n"))
    ending = termini(g).groupBy("node_id", "edge_id").agg(F.count("*").alias("n"))
    degree = g.incidence().groupBy("node_id").agg(F.count("*").alias("degree")).where("degree > 1")
    return ending.join(size, ["edge_id", "n"]).join(degree, "node_id").select("node_id", "edge_id", F.concat_ws("|", F.col("node_id").cast("string"), "edge_id").alias("end_id"))


def detach_ends(g: LineGraph, name=None) -> LineGraph:
    """Edges at whose end every line terminates hung on a node of their own there, in the same place.

    An edge is cut off at one end, the smaller if both qualify.  Where all edges of a node would go, the
    last of them by name stays.  Exceptions of the edge at that end are gone, as no line went on there.
    `name` (node, edge) makes the new nodes' names.
    """
    name = name or (lambda node, edge: F.concat(node.cast("string"), F.lit("|"), edge.cast("string")))
    found = detached_ends(g).select("node_id", "edge_id").join(g.edges.select("edge_id", "a", "b"), "edge_id")
    one = found.groupBy("edge_id").agg(F.min(F.struct("node_id", F.when(F.col("node_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))).alias("e")).select("edge_id", "e.*")
    degree = degrees(g).select("node_id", "degree")
    last = one.groupBy("node_id").agg(F.count("*").alias("n"), F.max("edge_id").alias("last")).join(degree, "node_id").where("n = degree").select("node_id", F.col("last").alias("edge_id"))
    one = one.join(last, ["node_id", "edge_id"], "left_anti").withColumn("end", name(F.col("node_id"), F.col("edge_id")))
    one = cut(one.withColumn("to", edge_key(F.col("other"), F.col("end"))))
    new = one.select("node_id", "end").join(g.nodes.select("node_id", "x", "y"), "node_id").select(F.col("end").alias("node_id"), "x", "y")
    moved = one.select("edge_id", "to", F.col("node_id").alias("gone"), "end")
    occs = g.occs.join(moved, "edge_id", "left").withColumn("direction", F.when(F.col("direction") == F.col("gone"), F.col("end")).otherwise(F.col("direction"))).withColumn("edge_id", F.coalesce("to", "edge_id")).select(*g.occs.columns)
    edges = g.edges.select("edge_id", "a", "b").join(moved.select("edge_id"), "edge_id", "left_anti").union(one.select("to", F.least("other", "end"), F.greatest("other", "end")))
    exceptions = g.exceptions
    if exceptions is not None:
        for c in ("edge_a", "edge_b"):
            off = one.select(F.col("edge_id").alias(c), "node_id")
            ren = one.select(F.col("edge_id").alias(c), F.col("other").alias("node_id"), "to")
            exceptions = exceptions.join(off, [c, "node_id"], "left_anti").join(ren, [c, "node_id"], "left").withColumn(c, F.coalesce("to", c)).select("node_id", "line_id", "edge_a", "edge_b")
    return LineGraph(g.nodes.unionByName(new, allowMissingColumns=True), edges, occs, exceptions, g.traced(moved.select("edge_id", "to")))


def _simple_paths(g: LineGraph) -> DataFrame:
    """(path, edge_id, n): the parts of lines that are a simple path, with the number of their edges.

    A part is what edges with the line connect.  It is a path if no node of it has more than two edges to
    nodes of it, whether they carry the line or not, and it is not closed.  Ends of parts are found by
    list ranking over both directions of every edge, so a long path takes a logarithmic number of rounds.
    """
    on = g.edges.select("edge_id", "a", "b").join(g.occs.select("edge_id", "line_id").distinct(), "edge_id")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.lit(1).alias("s"), F.col("b").alias("u"), F.col("a").alias("v"))))
    half = on.select("edge_id", "line_id", ends.alias("e")).select("edge_id", "line_id", "e.u", "e.v", F.struct("line_id", "edge_id", "e.s").alias("id"))
    half = cut(half)
    degree = half.groupBy("line_id", "u").agg(F.count("*").alias("n"))
    out = half.join(degree.where("n = 2").select("line_id", "u"), ["line_id", "u"], "left_semi").select("line_id", F.col("u").alias("v"), F.col("id").alias("next"))
    follow = half.join(out, ["line_id", "v"]).where("id.edge_id <> next.edge_id").select("id", "next")
    ranked = rank_lists(half.select("id").join(follow, "id", "left").withColumn("name", F.lit(None).cast("string"))).where("not closed").select("id", "last")
    stop = half.join(degree.where("n = 1").select("line_id", F.col("u").alias("v")), ["line_id", "v"], "left_semi").select(F.col("id").alias("last"))
    good = ranked.join(stop, "last", "left_semi").groupBy("id.line_id", "id.edge_id").agg(F.min("last").alias("path"), F.count("*").alias("n")).where("n = 2").select("path", "edge_id")
    good = cut(good)
    nodes = good.join(g.edges, "edge_id").select("path", F.explode(F.array("a", "b")).alias("node_id")).distinct()
    # A part of n edges has n + 1 nodes; edges without the line between them make it no path.
    at = lambda c: nodes.withColumnRenamed("node_id", c)
    among = g.edges.select("edge_id", "a", "b").join(at("a"), "a").join(at("b"), ["path", "b"]).groupBy("path").agg(F.count("*").alias("n"))
    sizes = good.groupBy("path").agg(F.count("*").alias("n")).join(among, ["path", "n"])
    return good.join(sizes, "path")


def partner_groups(g: LineGraph) -> DataFrame:
    """(representative, line_id, edge_id): lines that always run together along a simple path.

    All of them are on every edge of the path, go on over each of its inner nodes, and go on to no edge
    beside it.  The smallest of a group, itself included, represents it.
    """
    paths = cut(_simple_paths(g))
    # The same path may be a part of several lines.
    mark = paths.groupBy("path", "n").agg(F.min("edge_id").alias("low"), F.max("edge_id").alias("high"), F.sum(F.xxhash64("edge_id").cast("decimal(38,0)")).alias("h"))
    keep = mark.groupBy("n", "low", "high", "h").agg(F.min("path").alias("path")).select("path")
    paths = paths.join(keep, "path", "left_semi")
    full = paths.join(g.occs.select("edge_id", "line_id").distinct(), "edge_id").groupBy("path", "n", "line_id").agg(F.count("*").alias("on")).where("on = n").select("path", "n", "line_id")
    inside = paths.select("path", F.col("edge_id").alias("edge_b"), F.lit(True).alias("inside"))
    on = paths.select("path", F.col("edge_id").alias("edge_a")).join(continuations(g), "edge_a").join(inside, ["path", "edge_b"], "left")
    ways = on.groupBy("path", "line_id").agg(F.count_if(F.col("inside") & (F.col("edge_a") < F.col("edge_b"))).alias("over"), F.count_if(F.col("inside").isNull()).alias("beside"))
    lines = full.join(ways, ["path", "line_id"], "left").where("coalesce(over, 0) = n - 1 and coalesce(beside, 0) = 0")
    first = lines.groupBy("path").agg(F.min("line_id").alias("representative"), F.count("*").alias("size")).where("size > 1").select("path", "representative")
    return lines.join(first, "path").join(paths.select("path", "edge_id"), "path").select("representative", "line_id", "edge_id").distinct()


def collapse_partners(g: LineGraph) -> LineGraph:
    """Partners as one line: the representative stays on the path's edges, with `partners`, the lines that
    it stands for from the smallest to the largest, null for all other occurrences."""
    groups = cut(partner_groups(g))
    others = groups.where("line_id <> representative").select("edge_id", "line_id")
    stands = groups.groupBy("edge_id", F.col("representative").alias("line_id")).agg(F.sort_array(F.collect_set(F.col("line_id"))).alias("partners"))
    return g.with_(occs=g.occs.join(others, ["edge_id", "line_id"], "left_anti").join(stands, ["edge_id", "line_id"], "left").select(*g.occs.columns, "partners"))


def component_sizes(g: LineGraph) -> DataFrame:
    """(component, nodes, edges, max_lines, log10_orders) of every component with an edge."""
    label = components(g.nodes, g.edges.select("a", "b"))
    size = g.occs.groupBy("edge_id").agg(F.count("*").alias("n")).withColumn("lg", F.expr("aggregate(sequence(1L, n), 0D, (s, k) -> s + log10(k))"))
    on = g.edges.join(label.withColumnRenamed("node_id", "a"), "a").join(size, "edge_id")
    edges = on.groupBy("component").agg(F.count("*").alias("edges"), F.max("n").alias("max_lines"), F.round(F.sum("lg"), 6).alias("log10_orders"))
    return edges.join(label.groupBy("component").agg(F.count("*").alias("nodes")), "component").select("component", "nodes", "edges", "max_lines", "log10_orders")


def edge_ordering(g: LineGraph) -> DataFrame:
    """(edge_id, place): edges by number of lines, then by the degrees of their nodes, largest first."""
    size = g.occs.groupBy("edge_id").agg(F.count("*").alias("lines"))
    degree = g.incidence().groupBy("node_id").agg(F.count("*").alias("degree"))
    side = g.incidence().join(degree, "node_id").groupBy("edge_id").agg(F.sum("degree").alias("degrees"))
    rows = size.join(side, "edge_id").select("edge_id", (-F.col("lines")).alias("l"), (-F.col("degrees")).alias("d"))
    return numbered(rows, "l", "d", "edge_id").select("edge_id", (F.col("at") + 1).alias("place"))
