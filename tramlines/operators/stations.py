"""Stations: clusters by name, candidate edges and nodes, their scores and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut
from ..model import LineGraph
from .numbering import numbered
from .spatial import cell


def clusters(g: LineGraph, stations: DataFrame) -> DataFrame:
    """(name, x, y, n_nodes, n_edges, n_lines) of stations(node_id, name) that share a name.

    A cluster stands where its smallest node does.
    """
    at = stations.join(g.nodes.select("node_id", "x", "y"), "node_id")
    first = at.groupBy("name").agg(F.min(F.struct("node_id", "x", "y")).alias("m"), F.count("*").alias("n_nodes"))
    on = stations.join(g.incidence(), "node_id").select("name", "edge_id").distinct()
    edges = on.groupBy("name").agg(F.count("*").alias("n_edges"))
    lines = on.join(g.occs, "edge_id").groupBy("name").agg(F.countDistinct("line_id").alias("n_lines"))
    rows = first.join(edges, "name", "left").join(lines, "name", "left").fillna(0, ["n_edges", "n_lines"])
    return rows.select("name", "m.x", "m.y", "n_nodes", "n_edges", "n_lines")


def served_sets(g: LineGraph, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, edge_id) and (name, line_id): what each cluster should serve."""
    on = stations.join(g.incidence(), "node_id").select("name", "edge_id").distinct()
    return on, on.join(g.occs, "edge_id").select("name", "line_id").distinct()


def candidate_edges(g: LineGraph, places: DataFrame, distance: float) -> DataFrame:
    """(name, edge_id, d, share): edges in a box of 4 * distance around places(name, x, y), with the
    place's distance to the edge and the share of the edge's length where it is nearest."""
    at = lambda c, n: g.nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    pad = 4 * distance
    edges = g.edges.join(at("a", 1), "a").join(at("b", 2), "b")
    edges = edges.withColumn("cx", F.explode(F.sequence(cell(F.least("x1", "x2") - pad, pad), cell(F.greatest("x1", "x2") + pad, pad))))
    edges = edges.withColumn("cy", F.explode(F.sequence(cell(F.least("y1", "y2") - pad, pad), cell(F.greatest("y1", "y2") + pad, pad))))
    asked = places.select("name", "x", "y", cell(F.col("x"), pad).alias("cx"), cell(F.col("y"), pad).alias("cy"))
    near = asked.join(edges, ["cx", "cy"]).where((F.col("x") >= F.least("x1", "x2") - pad) & (F.col("x") <= F.greatest("x1", "x2") + pad) & (F.col("y") >= F.least("y1", "y2") - pad) & (F.col("y") <= F.greatest("y1", "y2") + pad))
    t = F.expr("least(1D, greatest(0D, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0D)))")
    near = near.withColumn("share", F.coalesce(t, F.lit(0.0)))
    d = F.expr("sqrt(pow(x - x1 - share * (x2 - x1), 2) + pow(y - y1 - share * (y2 - y1), 2))")
    return near.select("name", "edge_id", d.alias("d"), "share", F.expr("sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))").alias("length"))


def score(d: Column, should_edges: Column, edges: Column, should_lines: Column, lines: Column, too_close: Column) -> Column:
    """Lower is better: the distance, up to 100 for edges and 500 for lines that are not served, and
    200 for each end of the edge that is too close (prefer the node there)."""
    share = lambda should, has: F.when(should > 0, (should - has) / should).otherwise(F.lit(0.0))
    return d + 100 * share(should_edges, edges) + 500 * share(should_lines, lines) + 200 * too_close


def candidates(g: LineGraph, stations: DataFrame, distance: float) -> DataFrame:
    """(name, kind, target, d, score): the edges near each cluster and the nodes of those edges."""
    places = clusters(g, stations)
    near = candidate_edges(g, places.select("name", "x", "y"), distance)
    edge = near.select("name", F.lit("edge").alias("kind"), F.col("edge_id").alias("target"), "d", ((F.col("length") * (1 - F.col("share")) < distance).cast("int") + (F.col("length") * F.col("share") < distance).cast("int")).alias("close"))
    at = g.incidence().select("edge_id", "node_id").join(g.nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny")), "node_id")
    node = near.select("name", "edge_id").join(at, "edge_id").select("name", "node_id", "nx", "ny").distinct().join(places.select("name", "x", "y"), "name")
    node = node.select("name", F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("target"), F.expr("sqrt(pow(nx - x, 2) + pow(ny - y, 2))").alias("d"), F.lit(0).alias("close"))
    all_ = edge.union(node)
    touches = g.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("target"), "edge_id").union(g.incidence().select(F.lit("node"), F.col("node_id").cast("string"), "edge_id"))
    want_edges, want_lines = served_sets(g, stations)
    has = all_.select("name", "kind", "target").join(touches, ["kind", "target"])
    edges = has.join(want_edges, ["name", "edge_id"]).groupBy("name", "kind", "target").agg(F.count("*").alias("edges"))
    lines = has.join(g.occs.select("edge_id", "line_id"), "edge_id").select("name", "kind", "target", "line_id").distinct().join(want_lines, ["name", "line_id"]).groupBy("name", "kind", "target").agg(F.count("*").alias("lines"))
    rows = all_.join(edges, ["name", "kind", "target"], "left").join(lines, ["name", "kind", "target"], "left").fillna(0, ["edges", "lines"]).join(places.select("name", "n_edges", "n_lines"), "name")
    return rows.select("name", "kind", "target", "d", score(F.col("d"), F.col("n_edges"), F.col("edges"), F.col("n_lines"), F.col("lines"), F.col("close")).alias("score"))


def best(found: DataFrame) -> DataFrame:
    """The candidate of lowest score of each cluster; ties (to a billionth) by kind and name."""
    w = Window.partitionBy("name").orderBy(F.round("score", 9), "kind", "target")
    return found.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def insert(g: LineGraph, stations: DataFrame, chosen: DataFrame, distance: float, name=None) -> LineGraph:
    """The graph with each cluster's chosen candidate (name, kind, target) as its station.

    A chosen edge is cut where it is nearest to the cluster, several stations on one edge in order; a
    chosen node becomes the station.  Former stations lose their label.  Nodes get station_label, and
    not_serving with the lines at the station that the cluster does not serve.  `name` makes the
    names of new nodes from those of clusters.
    """
    from .topology import split_edges

    name = name or (lambda c: F.concat(F.lit("station:"), c))
    placed = candidate_edges(g, clusters(g, stations).select("name", "x", "y"), distance)
    near = chosen.where("kind = 'edge'").select("name", F.col("target").alias("edge_id")).join(placed.select("name", "edge_id", "share"), ["name", "edge_id"])
    # Ends of the edge are nodes already: a place there is that node.
    ends = near.join(g.edges.select("edge_id", "a", "b"), "edge_id").where("share <= 0 or share >= 1").select("name", F.when(F.col("share") <= 0, F.col("a")).otherwise(F.col("b")).alias("node_id"))
    cuts = cut(near.where("share > 0 and share < 1").select("edge_id", "share", name(F.col("name")).alias("node_id"), "name"))
    wanted = cut(served_sets(g, stations)[1])
    out = split_edges(g, cuts.select("edge_id", "share", "node_id"))
    key = g.nodes.schema["node_id"].dataType
    on_nodes = chosen.where("kind = 'node'").select("name", F.col("target").cast(key).alias("node_id"))
    labels = cuts.select("name", "node_id").union(on_nodes.select("name", "node_id")).union(ends.select("name", "node_id")).groupBy("node_id").agg(F.min("name").alias("station_label"))
    there = labels.join(out.incidence(), "node_id").join(out.occs.select("edge_id", "line_id"), "edge_id").select("node_id", F.col("station_label").alias("name"), "line_id").distinct()
    wrong = there.join(wanted, ["name", "line_id"], "left_anti").groupBy("node_id").agg(F.array_sort(F.collect_set("line_id")).alias("not_serving"))
    nodes = out.nodes.drop("station_label", "not_serving").join(labels, "node_id", "left").join(wrong, "node_id", "left")
    return out.with_(nodes=nodes)


def unserved(g: LineGraph, stations: DataFrame, chosen: DataFrame) -> DataFrame:
    """(name, line_id): lines that a cluster should serve and its chosen candidate does not."""
    touches = g.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("target"), "edge_id").union(g.incidence().select(F.lit("node"), F.col("node_id").cast("string"), "edge_id"))
    _, want = served_sets(g, stations)
    has = chosen.select("name", "kind", "target").join(touches, ["kind", "target"]).join(g.occs.select("edge_id", "line_id"), "edge_id").select("name", "line_id").distinct()
    return want.join(has, ["name", "line_id"], "left_anti")


def label_order(g: LineGraph, stations: DataFrame) -> DataFrame:
    """(node_id, name, place): the order in which stations are labelled: where a line ends first, then
    by degree and by line degree, largest first."""
    from .algebra import degrees, termini

    ends = termini(g).select("node_id").distinct().withColumn("ends", F.lit(1))
    rows = stations.join(degrees(g), "node_id").join(ends, "node_id", "left").fillna(0, ["ends"])
    keyed = rows.select("node_id", "name", *[(-F.col(c)).alias(c) for c in ("ends", "degree", "line_degree")])
    return numbered(keyed, "ends", "degree", "line_degree", "node_id").select("node_id", "name", (F.col("at") + 1).alias("place"))


def biggest(stations: DataFrame, size: str) -> DataFrame:
    """(name, node_id): of the stations of a name the one of largest `size`; ties by smallest node."""
    w = Window.partitionBy("name").orderBy(F.desc(size), "node_id")
    return stations.withColumn("k", F.row_number().over(w)).where("k = 1").select("name", "node_id")
