"""GTFS feeds as tables, and the line graph of a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import functions as fx
from ..lineage import cut
from ..model import LineGraph, edge_key
from ..operators import aggregate, courses, geometry


def read(spark: SparkSession, folder: str, shapes: bool = False) -> dict[str, DataFrame]:
    """The text files of an unpacked feed that the aggregation uses, all columns as strings."""
    names = ("stops", "routes", "trips", "stop_times", *(("shapes",) if shapes else ()))
    return {n: spark.read.csv(f"{folder}/{n}.txt", header=True, mode="PERMISSIVE") for n in names}


def _place(lng: str, lat: str) -> tuple[Column, Column]:
    return fx.mercator_x(F.col(lng).cast("double")), fx.mercator_y(F.col(lat).cast("double"))


#: Geometries that lie in a corridor of CORRIDOR around a longer one are absorbed; means are taken every STEP (metres).
CORRIDOR, STEP = 50.0, 20.0


def hop_geometries(feed: dict[str, DataFrame], hops: DataFrame, trips: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, geom): each edge's mean geometry, from its smaller node, by the number of its hops.

    Geometries within the corridor of a longer one are absorbed first.  A hop runs along its trip's shape between the places nearest to its stops, or straight if there is
    no shape or it does not lead on from the first to the second.  A shape's points are gathered in
    one row, which its length bounds.
    """
    x, y = _place("shape_pt_lon", "shape_pt_lat")
    ordered = feed["shapes"].select("shape_id", F.struct(F.col("shape_pt_sequence").cast("long").alias("i"), x.alias("x"), y.alias("y")).alias("q"))
    shapes = ordered.groupBy("shape_id").agg(F.sort_array(F.collect_list("q")).alias("q")).select("shape_id", F.transform("q", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("p"))
    ways = hops.join(trips.select(F.col("trip_id").alias("trip"), "shape_id"), "trip").groupBy("shape_id", "from_node", "to_node").agg(F.count("*").alias("n"))
    at = lambda c, n: nodes.select(F.col("node_id").alias(c), F.struct("x", "y").alias(n))
    ways = ways.join(at("from_node", "u"), "from_node").join(at("to_node", "v"), "to_node").join(shapes, "shape_id", "left")
    start, end = (geometry.nearest_on(F.col("p"), F.col(f"{c}.x"), F.col(f"{c}.y"))["share"] for c in "uv")
    ways = ways.withColumn("s", start).withColumn("e", end)
    along = F.when(F.col("p").isNotNull() & (F.size("p") > 1) & (F.col("s") < F.col("e")), geometry.sub_path(F.col("p"), F.col("s"), F.col("e"))).otherwise(F.array("u", "v"))
    folded = F.when(F.col("from_node") > F.col("to_node"), F.reverse("geom")).otherwise(F.col("geom"))
    rows = ways.withColumn("geom", along).select(edge_key(F.col("from_node"), F.col("to_node")).alias("edge_id"), "n", folded.alias("geom"))
    # Hops of equal geometry are one course.
    seen = rows.groupBy("edge_id", "geom").agg(F.sum("n").cast("double").alias("weight")).withColumn("course", F.sha2(F.col("geom").cast("string"), 256))
    return courses.merge(cut(seen), CORRIDOR, STEP)


def line_graph(feed: dict[str, DataFrame], route_types: list[int] | None = None, prune: float | None = None, turns: bool = False) -> LineGraph:
    """Stops are nodes, hops between consecutive stops of a trip are edges, routes are lines.

    With `prune`, lines of an edge seen less than `prune` times the average are dropped; with `turns`,
    pairs of a line's edges that none of its trips joins become exceptions; edges have the trips'
    shapes if the feed has any.
    """
    routes = feed["routes"]
    if route_types:
        routes = routes.where(F.col("route_type").cast("int").isin(route_types))
    kept = feed["trips"].join(routes.select("route_id"), "route_id", "left_semi")
    trips = kept.select("trip_id", "route_id", (F.col("shape_id") if "shape_id" in kept.columns else F.lit(None).cast("string")).alias("shape_id"))
    times = feed["stop_times"].select("trip_id", "stop_id", F.col("stop_sequence").cast("long").alias("seq")).join(trips.select("trip_id"), "trip_id", "left_semi")
    hops = aggregate.trip_hops(times, "trip_id", "stop_id", ["seq"])
    named = hops.join(trips.select(F.col("trip_id").alias("trip"), F.col("route_id").alias("line_id")), "trip")
    x, y = _place("stop_lon", "stop_lat")
    nodes = feed["stops"].select(F.col("stop_id").alias("node_id"), x.alias("x"), y.alias("y"), F.col("stop_id").alias("station_id"), F.col("stop_name").alias("station_label"))
    occs = aggregate.occurrences(named.select("from_node", "to_node", "line_id"))
    g = aggregate.line_graph(nodes, occs if prune is None else aggregate.prune_rare(occs, prune))
    if "shapes" in feed:
        g = g.with_(edges=g.edges.join(hop_geometries(feed, hops, trips, nodes), "edge_id"))
    if turns:
        w = Window.partitionBy("trip").orderBy("seq")
        made = named.withColumn("edge_b", edge_key(F.col("from_node"), F.col("to_node"))).withColumn("edge_a", F.lag("edge_b").over(w)).where("edge_a is not null")
        made = made.select(F.col("from_node").alias("node_id"), "line_id", "edge_a", "edge_b")
        made = made.union(made.select("node_id", "line_id", "edge_b", "edge_a")).distinct()
        at = g.incidence().join(g.occs, "edge_id").select("node_id", "line_id", "edge_id")
        pairs = at.withColumnRenamed("edge_id", "edge_a").join(at.withColumnRenamed("edge_id", "edge_b"), ["node_id", "line_id"]).where("edge_a <> edge_b")
        g = g.with_(exceptions=pairs.join(made, ["node_id", "line_id", "edge_a", "edge_b"], "left_anti"))
    looks = feed["routes"].select(F.col("route_id").alias("line_id"), F.col("route_short_name").alias("label"), fx.html_colour(F.col("route_color")).alias("color"))
    return g.with_(occs=g.occs.join(looks, "line_id", "left"))
