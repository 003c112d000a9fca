"""From timetables to line occurrences: hops, direction folding, pruning, occurring turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import LineGraph, edge_key


def trip_hops(stop_times: DataFrame, trip: str, stop: str, order: list[str]) -> DataFrame:
    """(trip, from_node, to_node, seq) of consecutive different stops of every trip of two stops or more.

    A repeated stop makes no hop and the next hop starts from it.
    """
    w = Window.partitionBy(trip).orderBy(*order)
    rows = stop_times.select(F.col(trip).alias("trip"), F.lag(stop).over(w).alias("from_node"), F.col(stop).alias("to_node"), F.row_number().over(w).alias("seq"))
    return rows.where(F.col("from_node").isNotNull() & (F.col("from_node") != F.col("to_node")))


def fold_direction(to_node: Column) -> Column:
    """Aggregate: the one node that all point to, or null for both ways (a null input is both ways)."""
    mixed = (F.min(to_node) != F.max(to_node)) | (F.count(to_node) < F.count(F.lit(1)))
    return F.when(mixed, None).otherwise(F.min(to_node))


def occurrences(hops: DataFrame) -> DataFrame:
    """(edge_id, a, b, line_id, direction, n) from (from_node, to_node, line_id); self hops are dropped."""
    real = hops.where(F.col("from_node") != F.col("to_node"))
    key = real.withColumn("a", F.least("from_node", "to_node")).withColumn("b", F.greatest("from_node", "to_node"))
    folded = key.groupBy("a", "b", "line_id").agg(fold_direction(F.col("to_node")).alias("direction"), F.count("*").alias("n"))
    return folded.select(edge_key(F.col("a"), F.col("b")).alias("edge_id"), "a", "b", "line_id", "direction", "n")


def line_graph(nodes: DataFrame, occs: DataFrame) -> LineGraph:
    """A bundle from nodes and the result of `occurrences`."""
    held = occs.select(F.explode(F.array("a", "b")).alias("node_id"), "edge_id", "line_id", "direction", "n")
    return LineGraph(nodes, occs.select("edge_id", "a", "b").distinct(), occs.select("edge_id", "line_id", "direction", "n"), held=held)


def prune_rare(occs: DataFrame, threshold: float) -> DataFrame:
    """Drop lines of an edge that are seen less than `threshold` times the average over all occurrences."""
    mean = occs.agg(F.avg("n").alias("mean"))
    return occs.crossJoin(F.broadcast(mean)).where(F.col("n") >= threshold * F.col("mean")).drop("mean")  # one row is broadcast


def occurring_turns(hops: DataFrame) -> DataFrame:
    """(node_id, edge_a, edge_b, n): turns that some trip makes, from the result of `trip_hops`."""
    w = Window.partitionBy("trip").orderBy("seq")
    edge = edge_key(F.col("from_node"), F.col("to_node"))
    pairs = hops.select("trip", "seq", F.col("from_node").alias("node_id"), edge.alias("edge_b")).withColumn("edge_a", F.lag("edge_b").over(w)).where("edge_a is not null")
    return pairs.groupBy("node_id", F.least("edge_a", "edge_b").alias("edge_a"), F.greatest("edge_a", "edge_b").alias("edge_b")).agg(F.count("*").alias("n"))


def missing_turns(graph: LineGraph, turns: DataFrame) -> DataFrame:
    """(node_id, edge_a, edge_b): pairs of edges at a node that no trip joins."""
    inc = graph.incidence().select("node_id", "edge_id")
    pairs = inc.select("node_id", F.col("edge_id").alias("edge_a")).join(inc.select("node_id", F.col("edge_id").alias("edge_b")), "node_id").where("edge_a < edge_b")
    return pairs.join(turns.select("node_id", "edge_a", "edge_b"), ["node_id", "edge_a", "edge_b"], "left_anti")
