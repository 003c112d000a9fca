"""DOT graphs: node and edge statements, one to a line or separated by semicolons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fx
from ..model import LineGraph, edge_key
from ..operators.aggregate import fold_direction

#: A statement ends at a semicolon outside quotes; its attributes stand in brackets.
_STATEMENT = r'((?:[^;"]|"[^"]*")+)'
_PARTS = r'^\s*([^\[]*?)\s*(?:\[(.*)\])?\s*$'
_TOKEN = r'("[^"]*"|-[->]|[^\s"-]+)'
_ATTRIBUTE = r'(\w[\w-]*)\s*=\s*("[^"]*"|[^",\]\s]*)'


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, attrs, directed): a node has no b; a chain `a -- b -> c` makes a row for each of its edges."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"^\s*(strict\s+)?(di)?graph[^{]*\{|\}\s*$", "").alias("s"))
    rows = rows.select(F.explode(F.regexp_extract_all("s", F.lit(_STATEMENT), 1)).alias("s")).where("trim(s) <> ''")
    bare = lambda v: F.regexp_replace(v, '"', "")
    found = lambda i: F.regexp_extract_all(F.regexp_extract("s", _PARTS, 2), F.lit(_ATTRIBUTE), i)
    rows = rows.select(F.regexp_extract_all(F.regexp_extract("s", _PARTS, 1), F.lit(_TOKEN), 1).alias("t"), F.map_from_arrays(found(1), F.transform(found(2), bare)).alias("attrs"))
    rows = rows.select("attrs", F.transform(F.filter("t", lambda x: ~x.isin("--", "->")), bare).alias("ids"), F.filter("t", lambda x: x.isin("--", "->")).alias("ops"))
    edge = rows.where("size(ops) > 0 and size(ids) = size(ops) + 1").select("attrs", "ids", F.posexplode("ops").alias("i", "op"))
    edge = edge.select(F.get("ids", F.col("i")).alias("a"), F.get("ids", F.col("i") + 1).alias("b"), "attrs", (F.col("op") == "->").alias("directed"))
    node = rows.where("size(ops) = 0 and size(ids) = 1 and ids[0] not in ('node', 'edge', 'graph')").select(F.get("ids", F.lit(0)).alias("a"), F.lit(None).cast("string").alias("b"), "attrs", F.lit(False).alias("directed"))
    return edge.union(node)


def read(spark: SparkSession, path: str) -> LineGraph:
    """A line graph from DOT: `pos` places a node; nodes seen only in edges stand at the origin.

    An edge's line is its id, label or colour, or else the edge's name; `->` gives the
    line the direction of its target.
    """
    rows = statements(spark, path)
    placed = rows.where("b is null and attrs['pos'] is not null").select(F.col("a").alias("node_id"), F.split(F.col("attrs")["pos"], ",").alias("p"), F.col("attrs")["station_id"].alias("station_id"), F.col("attrs")["label"].alias("station_label"))
    placed = placed.select("node_id", F.try_element_at("p", F.lit(1)).try_cast("double").alias("x"), F.try_element_at("p", F.lit(2)).try_cast("double").alias("y"), "station_id", "station_label").dropDuplicates(["node_id"])
    edge = rows.where("b is not null and a <> b")
    bare = edge.select(F.explode(F.array("a", "b")).alias("node_id")).distinct().join(placed, "node_id", "left_anti").select("node_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    attr = lambda n: F.col("attrs")[n]
    line = edge.select(edge_key(F.col("a"), F.col("b")).alias("edge_id"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), fx.first_of(attr("id"), attr("label"), attr("color")).alias("line_id"), attr("label").alias("label"), fx.html_colour(attr("color")).alias("color"), F.when(F.col("directed"), F.col("b")).alias("direction"))
    line = line.withColumn("line_id", F.coalesce("line_id", F.col("edge_id")))
    occs = line.groupBy("edge_id", "line_id").agg(fold_direction(F.col("direction")).alias("direction"), F.count("*").alias("n"), F.min("label").alias("label"), F.min("color").alias("color"))
    return LineGraph(placed.unionByName(bare, allowMissingColumns=True), line.select("edge_id", "a", "b").distinct(), occs)
