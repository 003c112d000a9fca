"""GeoJSON line graphs: points are nodes, line strings are edges, `lines` are occurrences.

Files hold a FeatureCollection, or one feature per line (which is how graphs are written, so that
no task ever holds a whole graph).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import functions as fx
from ..model import LineGraph, edge_key, with_geometry

_NAMES = ("id", "label", "lbl", "color", "colour", "col", "direction")
LINE = T.StructType([T.StructField(c, T.StringType()) for c in _NAMES])
_TURN = T.StructType([T.StructField(c, T.StringType()) for c in ("line", "node_from", "node_to")])
PROPERTIES = T.StructType(
    [T.StructField(c, T.StringType()) for c in (*_NAMES, "station_id", "station_label", "station_lbl", "from", "to")]
    + [T.StructField("component", T.LongType()), T.StructField("not_serving", T.ArrayType(T.StringType())), T.StructField("excluded_conn", T.ArrayType(_TURN)), T.StructField("lines", T.ArrayType(LINE))]
)
#: Fixed value: the id of a line without id, label and colour.
NAMELESS = "<EMPTY PLACEHOLDER>"
#: Coordinates nest differently for points and lines, so they are kept as JSON text at first.
GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
FEATURE = T.StructType([T.StructField("type", T.StringType()), T.StructField("geometry", GEOMETRY), T.StructField("properties", PROPERTIES)])
#: Fixed names of the figures that a stage leaves in a file for the next one.
STATISTICS = "num_nds_in long, num_edgs_in long, len_before double, num_nds_out long, num_edgs_out long, num_stations_out long, num_components long, num_restrs long, len_after double, tot_merged_edgs long, tot_support_graph_edgs long, max_merged_edgs long, avg_merged_edgs double"
COLLECTION = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(FEATURE))])


def features(spark: SparkSession, path: str, form: str = "auto") -> DataFrame:
    """Every feature of the files at `path`, each once.

    form: "lines" for one feature a line, which never puts a whole file into one task, "collection" for
    FeatureCollections, which are parsed whole, or "auto", which decides for each file.
    """
    if form not in ("auto", "lines", "collection"):
        raise ValueError(f"unknown form {form!r}")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    if form == "auto":
        collections = lines.where(F.col("value").contains('"FeatureCollection"')).select("file").distinct()
        lines, whole = lines.join(collections, "file", "left_anti"), whole.join(collections, "file", "left_semi")
    single = lines.where(F.col("value").contains("{")).select(F.from_json("value", FEATURE).alias("f")).select("f.*").where("type = 'Feature'")
    many = whole.select(F.explode(F.from_json("value", COLLECTION)["features"]).alias("f")).select("f.*")
    return many if form == "collection" else single if form == "lines" else single.unionByName(many)


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(value): the properties of graphs at `path` as JSON text: those of FeatureCollections, and those of
    features without geometry, which stand for the graph where a file has a feature a line."""
    files = lambda whole: spark.read.text(path, wholetext=whole)
    one = files(False).where(F.col("value").contains('"Feature"')).where("get_json_object(value, '$.type') = 'Feature' and get_json_object(value, '$.geometry') is null")
    many = files(True).where(F.col("value").contains('"FeatureCollection"')).where("get_json_object(value, '$.type') = 'FeatureCollection'")
    return many.union(one).select(F.get_json_object("value", "$.properties").alias("value")).where("value is not null")


def prior_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The statistics that an earlier stage wrote with the graph, a row for each block; none without any."""
    blocks = properties(spark, path).select(F.get_json_object("value", "$.statistics").alias("s")).where("s is not null")
    return blocks.select(F.from_json("s", STATISTICS).alias("s")).select("s.*")


def read(spark: SparkSession, path: str, form: str = "auto", project: bool = False) -> LineGraph:
    """A line graph from GeoJSON; with `project`, longitudes and latitudes become web mercator metres.

    Edges are stored from their smaller node: an edge that is given the other way has its vertices
    reversed and its lines in reverse order, so sides are kept.  Of several line strings between two
    nodes the one of fewest vertices gives the geometry.

    The first node of an id counts; nodes without id and edges without ends take the truncated
    coordinates as their name.  Loops, edges without lines and edges to unknown nodes are dropped;
    a line string without `lines` is itself one line.  Line ids fall back to label and colour; the
    smallest label and colour of an id are kept.  Directions count only if they name an end.  A node made for an edge is in its component.
    """
    f = features(spark, path, form).select("geometry.*", "properties.*").withColumnRenamed("type", "kind")
    flat = lambda p: F.array(fx.mercator_x(F.get(p, F.lit(0))), fx.mercator_y(F.get(p, F.lit(1)))) if project else p
    spot = lambda p: F.concat_ws("|", F.get(p, F.lit(0)).cast("long").cast("string"), F.get(p, F.lit(1)).cast("long").cast("string"))
    point = f.where("kind = 'Point'").withColumn("p", flat(F.from_json("coordinates", "array<double>")))
    given = point.select(F.coalesce("id", spot(F.col("p"))).alias("node_id"), F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), fx.first_of(F.col("station_id")).alias("station_id"), fx.first_of(F.col("station_label"), F.col("station_lbl")).alias("station_label"), "component", "not_serving", "excluded_conn")
    path_ = f.where("kind = 'LineString'").withColumn("p", F.transform(F.from_json("coordinates", "array<array<double>>"), flat))
    own = F.array(F.struct(*[F.col(c) for c in _NAMES]))
    ends = path_.select(F.coalesce("from", spot(F.get("p", F.lit(0)))).alias("f"), F.coalesce("to", spot(F.element_at("p", -1))).alias("t"), F.col("from").isNull().alias("nf"), F.col("to").isNull().alias("nt"), "p", "component", F.coalesce("lines", own).alias("lines"))
    made = ends.where("nf").select(F.col("f").alias("node_id"), F.get("p", F.lit(0)).alias("q"), "component").union(ends.where("nt").select("t", F.element_at("p", -1), "component"))
    made = made.select("node_id", F.get("q", F.lit(0)).alias("x"), F.get("q", F.lit(1)).alias("y"), "component")
    first = Window.partitionBy("node_id").orderBy("made", "x", "y", "component")
    nodes = given.withColumn("made", F.lit(0)).unionByName(made.withColumn("made", F.lit(1)), allowMissingColumns=True).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "made")
    known = nodes.select("node_id")
    good = ends.where("f <> t").join(known.withColumnRenamed("node_id", "f"), "f", "left_semi").join(known.withColumnRenamed("node_id", "t"), "t", "left_semi")
    turned = F.col("f") > F.col("t")
    good = good.withColumn("p", F.when(turned, F.reverse("p")).otherwise(F.col("p"))).withColumn("lines", F.when(turned, F.reverse("lines")).otherwise(F.col("lines")))
    good = good.select(edge_key(F.col("f"), F.col("t")).alias("edge_id"), F.least("f", "t").alias("a"), F.greatest("f", "t").alias("b"), "p", "lines")
    line = good.select("edge_id", "a", "b", F.posexplode("lines").alias("pos", "l"))
    label = fx.first_of(F.col("l.label"), F.col("l.lbl"))
    colour = fx.html_colour(fx.first_of(F.col("l.color"), F.col("l.colour"), F.col("l.col")))
    line = line.select("edge_id", "a", "b", "pos", F.coalesce(fx.first_of(F.col("l.id")), label, colour, F.lit(NAMELESS)).alias("line_id"), label.alias("label"), colour.alias("color"), "l.direction")
    line = line.withColumn("direction", F.when(F.col("direction").isin(F.col("a"), F.col("b")), F.col("direction")))
    mixed = (F.min("direction") != F.max("direction")) | (F.count("direction") < F.count(F.lit(1)))
    occs = line.groupBy("edge_id", "line_id").agg(F.when(mixed, None).otherwise(F.min("direction")).alias("direction"), F.count("*").alias("n"), F.min("pos").alias("pos"), F.min("label").alias("label"), F.min("color").alias("color"))
    exc = nodes.where("excluded_conn is not null").select("node_id", F.explode("excluded_conn").alias("e")).select("node_id", F.col("e.line").alias("line_id"), edge_key(F.col("node_id"), F.col("e.node_from")).alias("edge_a"), edge_key(F.col("node_id"), F.col("e.node_to")).alias("edge_b")).where("edge_a <> edge_b")
    exceptions = exc.union(exc.select("node_id", "line_id", "edge_b", "edge_a")).distinct()
    vertices = F.transform("p", lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y")))
    carried = line.select("edge_id").distinct()
    edges = good.join(carried, "edge_id", "left_semi").groupBy("edge_id", "a", "b").agg(F.min(F.struct(F.size("p").alias("n"), vertices.alias("geom"))).alias("m")).select("edge_id", "a", "b", "m.geom")
    on = edges.select("edge_id")
    exceptions = exceptions.join(on.withColumnRenamed("edge_id", "edge_a"), "edge_a", "left_semi").join(on.withColumnRenamed("edge_id", "edge_b"), "edge_b", "left_semi").select("node_id", "line_id", "edge_a", "edge_b")
    return LineGraph(nodes.drop("excluded_conn"), edges, occs, exceptions)


def polygons(spark: SparkSession, path: str, form: str = "auto", project: bool = False) -> DataFrame:
    """(polygon, ring): outer rings of the polygons at `path`, arrays of structs x, y, named by a hash of their corners."""
    f = features(spark, path, form).where("geometry.type = 'Polygon'").select(F.get(F.from_json("geometry.coordinates", "array<array<array<double>>>"), F.lit(0)).alias("r"))
    at = lambda p, i: F.get(p, F.lit(i))
    corner = lambda p: F.struct((fx.mercator_x(at(p, 0)) if project else at(p, 0)).alias("x"), (fx.mercator_y(at(p, 1)) if project else at(p, 1)).alias("y"))
    rings = f.where(F.size("r") > 2).select(F.transform("r", corner).alias("ring"))
    return rings.select(F.sha2(F.col("ring").cast("string"), 256).alias("polygon"), "ring").dropDuplicates(["polygon"])


def feature_rows(g: LineGraph, project: bool = False) -> DataFrame:
    """One JSON feature per row: nodes with stations, exceptions and their component, if they have the
    column, edges with their vertices, lines in order, labels of these in one string and the component of
    their nodes; with `project`, web mercator metres become longitudes and latitudes."""
    extra = [c for c in ("station_id", "station_label", "component", "not_serving") if c in g.nodes.columns]
    nodes = g.nodes
    if g.exceptions is not None:
        ends = g.edges.select("edge_id", "a", "b")
        side = lambda c, n: ends.select(F.col("edge_id").alias(c), F.col("a").alias(f"a{n}"), F.col("b").alias(f"b{n}"))
        far = lambda n: F.when(F.col(f"a{n}") == F.col("node_id"), F.col(f"b{n}")).otherwise(F.col(f"a{n}")).cast("string")
        banned = g.exceptions.where("edge_a < edge_b").join(side("edge_a", 1), "edge_a").join(side("edge_b", 2), "edge_b")
        banned = banned.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct(F.col("line_id").alias("line"), far(1).alias("node_from"), far(2).alias("node_to")))).alias("excluded_conn"))
        nodes, extra = nodes.join(banned, "node_id", "left"), [*extra, "excluded_conn"]
    text = lambda c: F.col(c).cast("string")
    pair = lambda p: F.array(fx.lng_of(p["x"]), fx.lat_of(p["y"])) if project else F.array(p["x"], p["y"])
    point = nodes.select(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), pair(F.struct("x", "y")).alias("coordinates")).alias("geometry"), F.struct(text("node_id").alias("id"), *extra).alias("properties"))
    order = "pos" if "pos" in g.occs.columns else "line_id"
    look = [c for c in ("label", "color") if c in g.occs.columns]
    lines = g.occs.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(text("line_id").alias("id"), *look, text("direction").alias("direction")).alias("line")))).alias("l"))
    edges = with_geometry(g).edges.join(lines, "edge_id")
    labels = F.array_join(F.transform("l", lambda x: F.coalesce(x["line"]["label"], F.lit(""))), ",") if "label" in look else F.lit(None).cast("string")
    of = []
    if "component" in g.nodes.columns:
        edges, of = edges.join(g.nodes.select(F.col("node_id").alias("a"), "component"), "a", "left"), ["component"]
    path = edges.select(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.transform("geom", pair).alias("coordinates")).alias("geometry"), F.struct(text("a").alias("from"), text("b").alias("to"), F.transform("l", lambda x: x["line"]).alias("lines"), labels.alias("dbg_lines"), *of).alias("properties"))
    one = lambda df: df.select(F.to_json(F.struct("type", "geometry", "properties")).alias("value"))
    return one(point).union(one(path))


def write(g: LineGraph, path: str, by: DataFrame | None = None, project: bool = False, statistics: DataFrame | None = None) -> None:
    """Write the features as text, one a line; with by(node_id, component), a folder for each component.

    The rows of `statistics` go into the file as features without geometry, which readers of graphs pass
    over; `prior_statistics` finds them.  In folders of components they stand beside these, as component
    "statistics".
    """
    rows = feature_rows(g, project)
    block = None
    if statistics is not None:
        block = statistics.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.struct(*statistics.columns).alias("statistics")).alias("properties"))).alias("value"))
    if by is None:
        (rows if block is None else rows.union(block)).write.text(path)
        return
    rows = rows.withColumn("node_id", F.coalesce(F.get_json_object("value", "$.properties.from"), F.get_json_object("value", "$.properties.id")))
    rows = rows.join(by.select(F.col("node_id").cast("string").alias("node_id"), F.col("component").cast("string").alias("component")), "node_id").select("value", "component")
    (rows if block is None else rows.union(block.withColumn("component", F.lit("statistics")))).write.partitionBy("component").text(path)
