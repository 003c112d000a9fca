"""Repairs and costs of a line graph's topology, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import LineGraph, edge_key, with_geometry
from . import geometry
from .algebra import continuations, degrees, termini
from .structure import drop_isolated, pass_through


def pair_relations(g: LineGraph) -> DataFrame:
    """(node_id, edge_a, edge_b, lines_a, lines_b, shared, continued, same, relation) of adjacent edges.

    shared: lines on both; continued: lines that run on between them; same: shared lines with the same
    direction seen along the pair.  relation: equal (every line of both runs on), contained (every line
    of the first does), partial (some do), blocked (shared but none runs on) or disjoint.
    """
    inc = g.incidence().select("node_id", "edge_id")
    pairs = inc.select("node_id", F.col("edge_id").alias("edge_a")).join(inc.select("node_id", F.col("edge_id").alias("edge_b")), "node_id").where("edge_a <> edge_b")
    size = g.occs.groupBy("edge_id").agg(F.count("*").alias("n"))
    at = g.incidence().join(g.occs, "edge_id").select("node_id", "line_id", "edge_id", F.when(F.col("direction").isNotNull(), F.col("direction") == F.col("node_id")).alias("inward"))
    a = at.select("node_id", "line_id", F.col("edge_id").alias("edge_a"), F.col("inward").alias("ia"))
    b = at.select("node_id", "line_id", F.col("edge_id").alias("edge_b"), F.col("inward").alias("ib"))
    same = (F.col("ia").isNull() & F.col("ib").isNull()) | (F.col("ia") != F.col("ib"))
    shared = a.join(b, ["node_id", "line_id"]).where("edge_a <> edge_b").groupBy("node_id", "edge_a", "edge_b").agg(F.count("*").alias("shared"), F.sum(F.when(same, 1).otherwise(0)).cast("long").alias("same"))
    on = continuations(g).groupBy("node_id", "edge_a", "edge_b").agg(F.count("*").alias("continued"))
    rows = pairs.join(size.select(F.col("edge_id").alias("edge_a"), F.col("n").alias("lines_a")), "edge_a").join(size.select(F.col("edge_id").alias("edge_b"), F.col("n").alias("lines_b")), "edge_b")
    rows = rows.join(shared, ["node_id", "edge_a", "edge_b"], "left").join(on, ["node_id", "edge_a", "edge_b"], "left").fillna(0, ["shared", "same", "continued"])
    full = F.col("continued") == F.col("lines_a")
    relation = F.when(full & (F.col("continued") == F.col("lines_b")), "equal").when(full, "contained").when(F.col("continued") > 0, "partial").when(F.col("shared") > 0, "blocked").otherwise("disjoint")
    return rows.select("node_id", "edge_a", "edge_b", "lines_a", "lines_b", "shared", "continued", "same", relation.alias("relation"))


def unique_extensions(g: LineGraph) -> DataFrame:
    """(node_id, line_id, edge_a, edge_b): continuations that are the only one from their edge."""
    on = continuations(g)
    only = on.groupBy("node_id", "line_id", "edge_a").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return on.join(only, ["node_id", "line_id", "edge_a"], "left_semi").select("node_id", "line_id", "edge_a", "edge_b")


def useful_exceptions(g: LineGraph) -> DataFrame:
    """The exceptions without those of a line that could go nowhere from an edge because of them.

    If a line on an edge has other edges at the node but an exception towards each of them, all its
    exceptions with that edge go.
    """
    at = g.incidence().join(g.occs, "edge_id").select("node_id", "line_id", "edge_id")
    others = at.groupBy("node_id", "line_id").agg((F.count("*") - 1).alias("others"))
    banned = g.exceptions.join(at.select("node_id", "line_id", F.col("edge_id").alias("edge_b")), ["node_id", "line_id", "edge_b"], "left_semi")
    stuck = banned.groupBy("node_id", "line_id", "edge_a").agg(F.count("*").alias("n")).join(others, ["node_id", "line_id"]).where("n >= others and others > 0")
    stuck = stuck.select("node_id", "line_id", F.col("edge_a").alias("edge"))
    first, second = stuck.withColumnRenamed("edge", "edge_a"), stuck.withColumnRenamed("edge", "edge_b")
    return g.exceptions.join(first, ["node_id", "line_id", "edge_a"], "left_anti").join(second, ["node_id", "line_id", "edge_b"], "left_anti").select("node_id", "line_id", "edge_a", "edge_b")


def orphan_lines(g: LineGraph, served: DataFrame) -> DataFrame:
    """(edge_id, line_id): lines that end on an edge at a node that does not serve them.

    served(node_id, line_id).  An edge all of whose lines would go keeps them, unless an end of it has
    no other edge.
    """
    ends = termini(g).join(served, ["node_id", "line_id"], "left_anti").select("edge_id", "line_id").distinct()
    going = ends.groupBy("edge_id").agg(F.count("*").alias("going"))
    size = g.occs.groupBy("edge_id").agg(F.count("*").alias("n"))
    stump = g.incidence().join(degrees(g).where("degree = 1"), "node_id").select("edge_id").distinct().withColumn("stump", F.lit(True))
    free = size.join(going, "edge_id").join(stump, "edge_id", "left").where("going < n or stump").select("edge_id")
    return ends.join(free, "edge_id", "left_semi").select("edge_id", "line_id")


def lift_between(g: LineGraph, gone: DataFrame) -> DataFrame:
    """The exceptions without those between two edges that a line of `gone` (edge_id, line_id) joined over that edge."""
    on = continuations(g).join(gone.withColumnRenamed("edge_id", "edge_a"), ["edge_a", "line_id"], "left_semi")
    left = on.select("node_id", "line_id", "edge_a", F.col("edge_b").alias("one"))
    joined = left.join(on.select("node_id", "line_id", "edge_a", F.col("edge_b").alias("two")), ["node_id", "line_id", "edge_a"]).where("one <> two")
    free = joined.select("node_id", "line_id", F.col("one").alias("edge_a"), F.col("two").alias("edge_b")).distinct()
    return g.exceptions.join(free, ["node_id", "line_id", "edge_a", "edge_b"], "left_anti").select("node_id", "line_id", "edge_a", "edge_b")


def drop_orphans(g: LineGraph, served: DataFrame, rounds: int = 1000) -> LineGraph:
    """Remove orphan lines, empty edges and bare nodes until none is left; their exceptions go with them.

    Where a line ran between two edges only by way of an edge that it leaves, it may now run between
    them directly: the exception between these two is lifted.
    """
    before = -1
    for _ in range(rounds):
        gone = cut(orphan_lines(g, served))
        if g.exceptions is not None:
            g = g.with_(exceptions=cut(lift_between(g, gone)))
        occs = cut(g.occs.join(gone, ["edge_id", "line_id"], "left_anti").select(*g.occs.columns))
        now = occs.count()
        edges = cut(g.edges.join(occs.select("edge_id").distinct(), "edge_id", "left_semi"))
        g = drop_isolated(g.with_(occs=occs, edges=edges))
        if g.exceptions is not None:
            on = occs.select("edge_id", "line_id")
            kept = g.exceptions.join(on.withColumnRenamed("edge_id", "edge_a"), ["edge_a", "line_id"], "left_semi").join(on.withColumnRenamed("edge_id", "edge_b"), ["edge_b", "line_id"], "left_semi")
            g = g.with_(exceptions=cut(kept.select("node_id", "line_id", "edge_a", "edge_b")))
        if now == before:
            return g
        before = now
    raise RuntimeError(f"orphans did not settle in {rounds} rounds")


def turn_costs(g: LineGraph, penalty: float, full_turn: float) -> DataFrame:
    """(line_id, node_id, edge_a, edge_b, cost): what it costs a line to go over to the next edge: that
    edge's length, and a penalty if the turn is sharper than `full_turn` degrees.  Turns that
    exceptions or directions forbid, and turning back, are not listed."""
    at = g.nodes.select("node_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    to = g.nodes.select(F.col("node_id").alias("other"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    ray = g.incidence().join(at, "node_id").join(to, "other").select("node_id", "edge_id", (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"))
    a = ray.select("node_id", F.col("edge_id").alias("edge_a"), F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    b = ray.select("node_id", F.col("edge_id").alias("edge_b"), F.col("dx").alias("bx"), F.col("dy").alias("by"))
    rows = continuations(g).join(a, ["node_id", "edge_a"]).join(b, ["node_id", "edge_b"])
    turn = geometry.angle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    cost = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by")) + F.when(turn < full_turn, penalty).otherwise(0.0)
    return rows.select("line_id", "node_id", "edge_a", "edge_b", cost.alias("cost"))


def split_edges(g: LineGraph, cuts: DataFrame) -> LineGraph:
    """Cut edges at new nodes: cuts(edge_id, share, node_id), any number for an edge, shares in (0, 1).

    The pieces carry the edge's lines, direction towards the end that it pointed to, and their part of
    its vertices if the graph has any; exceptions move to the piece that touches their node.
    """
    bent = "geom" in g.edges.columns
    whole_edges = cut(with_geometry(g).edges)
    placed = cuts.join(whole_edges, "edge_id").withColumn("p", geometry.point_at(F.col("geom"), F.col("share")))
    new = placed.select("node_id", "p.x", "p.y")
    stops = whole_edges.join(cuts.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("share", "node_id"))).alias("s")), "edge_id")
    chain = F.concat(F.array(F.struct(F.lit(0.0).alias("share"), F.col("a").alias("node_id"))), F.col("s"), F.array(F.struct(F.lit(1.0).alias("share"), F.col("b").alias("node_id"))))
    hops = stops.withColumn("c", chain).select("edge_id", "a", "b", "geom", "c", F.posexplode("c").alias("i", "u")).where(F.col("i") < F.size("c") - 1)
    hops = hops.select("edge_id", F.col("a").alias("old_a"), F.col("b").alias("old_b"), "geom", F.col("u.node_id").alias("u"), F.col("u.share").alias("from"), F.get("c", F.col("i") + 1).alias("v"))
    hops = hops.select("edge_id", "old_a", "old_b", "geom", "u", "from", F.col("v.node_id").alias("v"), F.col("v.share").alias("to"))
    piece = cut(hops.withColumn("piece", edge_key(F.col("u"), F.col("v"))))
    lines = piece.join(g.occs, "edge_id")
    towards = F.when(F.col("direction") == F.col("old_b"), F.col("v")).when(F.col("direction") == F.col("old_a"), F.col("u"))
    rest = [c for c in g.occs.columns if c not in ("edge_id", "direction")]
    occs = lines.select(F.col("piece").alias("edge_id"), towards.alias("direction"), *rest).select(*g.occs.columns)
    whole = stops.select("edge_id")
    columns = ["edge_id", "a", "b", *(["geom"] if bent else [])]
    part = geometry.sub_path(F.col("geom"), F.col("from"), F.col("to"))
    edges = piece.select(F.col("piece").alias("edge_id"), F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), *([F.when(F.col("u") < F.col("v"), part).otherwise(F.reverse(part)).alias("geom")] if bent else []))
    exceptions = g.exceptions
    if exceptions is not None:
        touch = piece.select("edge_id", "piece", F.explode(F.array("u", "v")).alias("node_id"))
        for c in ("edge_a", "edge_b"):
            moved = exceptions.join(touch.select(F.col("edge_id").alias(c), "node_id", "piece"), [c, "node_id"], "left")
            exceptions = moved.withColumn(c, F.coalesce("piece", c)).select("node_id", "line_id", "edge_a", "edge_b")
    return LineGraph(
        g.nodes.unionByName(new, allowMissingColumns=True), g.edges.join(whole, "edge_id", "left_anti").select(*columns).union(edges),
        g.occs.join(whole, "edge_id", "left_anti").select(*g.occs.columns).union(occs), exceptions, g.traced(piece.select("edge_id", F.col("piece").alias("to"))),
    )


def contract_stray(g: LineGraph, stops: DataFrame | None = None, rounds: int = 1000) -> LineGraph:
    """Contract nodes of two edges over which every line of both runs, until none is left.

    Stations in `stops` stay, and so do nodes whose neighbours share an edge already.  In each round
    the nodes that come before their candidate neighbours (by a hash of their name) go.
    """
    for _ in range(rounds):
        found = pass_through(g, stops)
        far = g.incidence().join(found.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.min("other").alias("p"), F.max("other").alias("q")).where("p <> q")
        far = far.join(g.edges.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"], "left_anti")
        far = cut(far.withColumn("key", F.struct(F.xxhash64("node_id"), "node_id")))
        near = far.select("key", F.explode(F.array("p", "q")).alias("node_id")).groupBy("node_id").agg(F.min("key").alias("low"))
        chosen = far.join(near, "node_id", "left").where("low is null or key < low")
        # Two chains between the same ends would make a double edge: the first stays a candidate.
        chosen = chosen.groupBy("p", "q").agg(F.min("key").alias("key")).select("p", "q", F.col("key.node_id").alias("node_id"))
        chosen = cut(chosen)
        if chosen.isEmpty():
            return g
        old = g.incidence().join(chosen.select("node_id", "p", "q"), "node_id").select("edge_id", "node_id", "other", "p", "q", edge_key(F.col("p"), F.col("q")).alias("new"))
        moved = g.occs.join(old.where("other = p"), "edge_id")
        towards = F.when(F.col("direction") == F.col("node_id"), F.col("q")).when(F.col("direction") == F.col("p"), F.col("p"))
        back = g.occs.join(old.where("other = q"), "edge_id").select("new", "line_id", F.when(F.col("direction") == F.col("node_id"), F.col("p")).when(F.col("direction") == F.col("q"), F.col("q")).alias("d2"))
        rest = [c for c in g.occs.columns if c not in ("edge_id", "direction", "line_id")]
        merged = moved.withColumn("d1", towards).join(back, ["new", "line_id"]).select(F.col("new").alias("edge_id"), "line_id", F.coalesce("d1", "d2").alias("direction"), *rest).select(*g.occs.columns)
        gone = cut(old.select("edge_id").distinct())
        exceptions = g.exceptions
        if exceptions is not None:
            to = old.select(F.col("edge_id").alias("e"), F.col("other").alias("node_id"), "new")
            for c in ("edge_a", "edge_b"):
                exceptions = exceptions.join(to.withColumnRenamed("e", c), [c, "node_id"], "left").withColumn(c, F.coalesce("new", c)).select("node_id", "line_id", "edge_a", "edge_b")
            exceptions = cut(exceptions.join(chosen.select("node_id"), "node_id", "left_anti"))
        fresh = chosen.select(edge_key(F.col("p"), F.col("q")).alias("edge_id"), F.col("p").alias("a"), F.col("q").alias("b"))
        columns = ["edge_id", "a", "b"]
        if "geom" in g.edges.columns:
            # From p to the node and from there to q; vertices run from an edge's smaller node.
            bent = old.join(g.edges.select("edge_id", "geom"), "edge_id")
            first = bent.where("other = p").select(F.col("new").alias("edge_id"), F.when(F.col("p") < F.col("node_id"), F.col("geom")).otherwise(F.reverse("geom")).alias("one"))
            second = bent.where("other = q").select(F.col("new").alias("edge_id"), F.when(F.col("node_id") < F.col("q"), F.col("geom")).otherwise(F.reverse("geom")).alias("two"))
            fresh = fresh.join(first, "edge_id").join(second, "edge_id").withColumn("geom", F.concat("one", F.slice("two", F.lit(2), F.size("two"))))
            columns.append("geom")
        edges = g.edges.join(gone, "edge_id", "left_anti").select(*columns).union(fresh.select(*columns))
        origins = g.traced(old.select("edge_id", F.col("new").alias("to")))
        origins = origins if origins is None else cut(origins)
        g = LineGraph(cut(g.nodes.join(chosen.select("node_id"), "node_id", "left_anti")), cut(edges), cut(g.occs.join(gone, "edge_id", "left_anti").select(*g.occs.columns).union(merged)), exceptions, origins)
    raise RuntimeError(f"stray nodes did not settle in {rounds} rounds")


def node_means(g: LineGraph) -> DataFrame:
    """(node_id, x, y): the mean of the ends at each node of its edges' geometries."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.get("geom", F.lit(0)).alias("p")), F.struct(F.col("b").alias("node_id"), F.element_at("geom", -1).alias("p"))))
    return with_geometry(g).edges.select(ends.alias("e")).groupBy("e.node_id").agg(F.avg("e.p.x").alias("x"), F.avg("e.p.y").alias("y"))
