"""Relational algebra on line graphs: connections of lines over nodes and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LineGraph


def degrees(g: LineGraph) -> DataFrame:
    """(node_id, degree, line_degree): edges at a node and line occurrences on them."""
    per_edge = g.occs.groupBy("edge_id").agg(F.count("*").alias("lines"))
    inc = g.incidence().join(per_edge, "edge_id", "left")
    return inc.groupBy("node_id").agg(F.count("*").alias("degree"), F.sum(F.coalesce("lines", F.lit(0))).alias("line_degree"))


def adjacent_edges(g: LineGraph) -> DataFrame:
    """(node_id, edge_a, edge_b) for every ordered pair of different edges at a node."""
    inc = g.incidence().select("node_id", "edge_id")
    both = inc.select("node_id", F.col("edge_id").alias("edge_a")).join(inc.select("node_id", F.col("edge_id").alias("edge_b")), "node_id")
    return both.where(F.col("edge_a") != F.col("edge_b"))


def directions_agree() -> Column:
    """A line that runs towards `da` on one edge and `db` on the other can run over `node_id`; null is both ways."""
    return F.col("da").isNull() | F.col("db").isNull() | ((F.col("da") == F.col("node_id")) != (F.col("db") == F.col("node_id")))


def continuations(g: LineGraph) -> DataFrame:
    """(node_id, line_id, edge_a, edge_b), ordered pairs: the line runs on from one edge to the other.

    Both edges carry it, the node has more than one edge, directions agree (it does not run towards
    or away from the node on both) and no exception forbids it.
    """
    at = g.attached().select("node_id", "line_id", "edge_id", "direction")
    a = at.select("node_id", "line_id", F.col("edge_id").alias("edge_a"), F.col("direction").alias("da"))
    b = at.select("node_id", "line_id", F.col("edge_id").alias("edge_b"), F.col("direction").alias("db"))
    out = a.join(b, ["node_id", "line_id"]).where((F.col("edge_a") != F.col("edge_b")) & directions_agree()).select("node_id", "line_id", "edge_a", "edge_b")
    if g.exceptions is not None:
        out = out.join(g.exceptions, ["node_id", "line_id", "edge_a", "edge_b"], "left_anti")
    return out


def termini(g: LineGraph) -> DataFrame:
    """(node_id, line_id, edge_id): the line has no continuation at this end of the edge."""
    ends = g.attached().select("node_id", "line_id", "edge_id")
    on = continuations(g).select("node_id", "line_id", F.col("edge_a").alias("edge_id")).distinct()
    return ends.join(on, ["node_id", "line_id", "edge_id"], "left_anti")


def branching(g: LineGraph) -> DataFrame:
    """(node_id, line_id, edge_id, n): lines that run on from an edge to two edges or more."""
    return continuations(g).groupBy("node_id", "line_id", F.col("edge_a").alias("edge_id")).agg(F.countDistinct("edge_b").alias("n")).where("n > 1")


def connection_cardinality(g: LineGraph) -> DataFrame:
    """(node_id, n): unordered pairs of edges at the node that some line joins, counted by line."""
    return continuations(g).where("edge_a < edge_b").groupBy("node_id").agg(F.count("*").alias("n"))


def shared_lines(g: LineGraph) -> DataFrame:
    """(node_id, edge_a, edge_b, lines): lines on both of two adjacent edges, by name, comma-joined."""
    pairs = adjacent_edges(g).where("edge_a < edge_b")
    a = g.occs.select(F.col("edge_id").alias("edge_a"), "line_id")
    b = g.occs.select(F.col("edge_id").alias("edge_b"), "line_id")
    both = pairs.join(a, "edge_a").join(b, ["edge_b", "line_id"])
    return both.groupBy("node_id", "edge_a", "edge_b").agg(F.array_join(F.sort_array(F.collect_set("line_id")), ",").alias("lines"))


def equal_lines(g: LineGraph) -> DataFrame:
    """(node_id, edge_a, edge_b): adjacent edges with the same lines, each of which runs over the node."""
    size = g.occs.groupBy("edge_id").agg(F.count("*").alias("n"))
    on = continuations(g).where("edge_a < edge_b").groupBy("node_id", "edge_a", "edge_b").agg(F.countDistinct("line_id").alias("n"))
    return on.join(size.select(F.col("edge_id").alias("edge_a"), "n"), ["edge_a", "n"]).join(size.select(F.col("edge_id").alias("edge_b"), "n"), ["edge_b", "n"]).select("node_id", "edge_a", "edge_b")


def partners(g: LineGraph) -> DataFrame:
    """(line_a, line_b): lines that run over exactly the same edges."""
    sets = g.occs.groupBy("line_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("edge_id")), ","), 256).alias("route"))
    return sets.select(F.col("line_id").alias("line_a"), "route").join(sets.select(F.col("line_id").alias("line_b"), "route"), "route").where("line_a < line_b").select("line_a", "line_b")


def served(g: LineGraph, not_served: DataFrame) -> DataFrame:
    """(node_id, line_id): lines present at a node and not marked as passing through."""
    at = g.attached().select("node_id", "line_id").distinct()
    return at.join(not_served, ["node_id", "line_id"], "left_anti")


def counts(g: LineGraph) -> DataFrame:
    """One row: nodes with edges, edges, lines, largest number of lines on an edge, largest degree and
    log10 of the number of possible line orders."""
    per_edge = g.occs.groupBy("edge_id").agg(F.count("*").alias("n"))
    space = per_edge.withColumn("lg", F.expr("aggregate(sequence(1L, n), 0D, (s, k) -> s + log10(k))"))
    edges = space.agg(F.count("*").alias("edges"), F.max("n").alias("max_lines"), F.round(F.sum("lg"), 6).alias("log10_orders"))
    nodes = degrees(g).agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"))
    lines = g.occs.agg(F.countDistinct("line_id").alias("lines"))
    return edges.crossJoin(nodes).crossJoin(lines)  # three single rows


def exception_count(exceptions: DataFrame) -> DataFrame:
    """(node_id, n): half the number of (line, from-edge) entries that have an exception, rounded down."""
    entries = exceptions.select("node_id", "line_id", "edge_a").distinct()
    return entries.groupBy("node_id").agg(F.floor(F.count("*") / 2).cast("long").alias("n"))


def colours(g: LineGraph) -> DataFrame:
    """(line_id, color): a fixed colour for every line, from its name."""
    return g.occs.select("line_id").distinct().select("line_id", F.substring(F.md5(F.col("line_id").cast("string")), 1, 6).alias("color"))
