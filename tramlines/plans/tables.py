"""Line graphs derived from the driver's tables by fixed rules, and the same rules in SQL.

`full`: nations are nodes on a 5 x 5 grid, an order's line items are hops from the customer's nation
to the supplier's, brands are lines.

`near`, which grows with the data: customers are nodes on a grid ten wide, every order is a hop from
its customer to one of three neighbours or back to the left one, by the order's number, priorities are
lines.  Lines seen less than 0.7 times the average are pruned; turns whose two counts add up to a multiple of 4 are forbidden.  Every
third node is a station.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import LineGraph
from ..operators import aggregate


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return read(spark, sf_dir, "nation").select(key.alias("node_id"), (key % 5).cast("double").alias("x"), F.floor(key / 5).cast("double").alias("y"), F.col("n_regionkey").cast("long").alias("zone"))


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_node, to_node, line_id) of every line item between different nations."""
    t = lambda n: read(spark, sf_dir, n)
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    rows = rows.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("to_node")), "l_suppkey")
    rows = rows.join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("line_id")), "l_partkey")
    ordered = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("from_node")), "o_custkey")
    return rows.join(ordered.select("l_orderkey", "from_node"), "l_orderkey").where("from_node <> to_node").select("from_node", "to_node", "line_id")


def full(spark: SparkSession, sf_dir: str) -> LineGraph:
    return aggregate.line_graph(nodes(spark, sf_dir), aggregate.occurrences(hops(spark, sf_dir)))


def city_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    return read(spark, sf_dir, "customer").select(k.alias("node_id"), (k % 10).cast("double").alias("x"), F.floor(k / 10).cast("double").alias("y"), F.col("c_nationkey").cast("long").alias("zone"))


def city_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_node, to_node, line_id) of every order whose neighbour exists."""
    step = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 11 ELSE -1 END")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("from_node"), (F.col("o_custkey") + step).cast("long").alias("to_node"), F.col("o_orderpriority").alias("line_id"))
    there = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("to_node"))
    return rows.where("abs(pmod(from_node, 10) - pmod(to_node, 10)) <= 1").join(there, "to_node", "left_semi").select("from_node", "to_node", "line_id")


def near_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.occurrences(city_hops(spark, sf_dir))


def forbidden(g: LineGraph) -> DataFrame:
    at = g.attached().select("node_id", "line_id", "edge_id", "n")
    a = at.select("node_id", "line_id", F.col("edge_id").alias("edge_a"), F.col("n").alias("na"))
    b = at.select("node_id", "line_id", F.col("edge_id").alias("edge_b"), F.col("n").alias("nb"))
    return a.join(b, ["node_id", "line_id"]).where("edge_a <> edge_b and (na + nb) % 4 = 0").select("node_id", "line_id", "edge_a", "edge_b")


def near(spark: SparkSession, sf_dir: str, threshold: float = 0.7, occs: DataFrame | None = None) -> LineGraph:
    """The graph is aggregated once, unless `occs` are given, and cut before it is pruned: what follows, the
    average too, reads its tables, not the orders again."""
    occs = cut(aggregate.prune_rare(cut(near_occurrences(spark, sf_dir)) if occs is None else occs, threshold))
    g = aggregate.line_graph(city_nodes(spark, sf_dir), occs)
    return g.with_(exceptions=cut(forbidden(g)))


def thin(spark: SparkSession, sf_dir: str) -> LineGraph:
    """`near` pruned at the average: five lines on many chains of nodes with two edges."""
    return near(spark, sf_dir, 1.0)


def sparse(spark: SparkSession, sf_dir: str) -> LineGraph:
    """All hops as one line, edges seen at least as often as the average: pieces with nodes of two edges."""
    occs = aggregate.occurrences(city_hops(spark, sf_dir).withColumn("line_id", F.lit("all")))
    return aggregate.line_graph(city_nodes(spark, sf_dir), cut(aggregate.prune_rare(cut(occs), 1.0)))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, name): every third node; nodes a hundred apart share a name."""
    return city_nodes(spark, sf_dir).where("node_id % 3 = 0").select("node_id", F.concat(F.lit("s"), (F.col("node_id") % 100).cast("string")).alias("name"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y): the first two numbers of every embedding."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x1, y1, x2, y2): from each even point to the next one."""
    p = points(spark, sf_dir)
    to = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return p.where("id % 2 = 0").join(to, "id").select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")


BASE = """
nodes AS (SELECT n_nationkey::BIGINT AS node_id, (n_nationkey % 5)::DOUBLE AS x, (n_nationkey // 5)::DOUBLE AS y, n_regionkey::BIGINT AS zone FROM nation),
hops AS (SELECT c_nationkey::BIGINT AS from_node, s_nationkey::BIGINT AS to_node, p_brand AS line_id
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE c_nationkey <> s_nationkey),
all_occs AS (SELECT least(from_node, to_node) || '-' || greatest(from_node, to_node) AS edge_id, least(from_node, to_node) AS a, greatest(from_node, to_node) AS b, line_id,
             CASE WHEN min(to_node) <> max(to_node) THEN NULL ELSE min(to_node) END AS direction, count(*)::BIGINT AS n
             FROM hops GROUP BY ALL)"""
CITY = """
nodes AS (SELECT c_custkey::BIGINT AS node_id, (c_custkey % 10)::DOUBLE AS x, (c_custkey // 10)::DOUBLE AS y, c_nationkey::BIGINT AS zone FROM customer),
moves AS (SELECT o_custkey::BIGINT AS from_node, (o_custkey + CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 11 ELSE -1 END)::BIGINT AS to_node, o_orderpriority AS line_id FROM orders),
hops AS (SELECT * FROM moves WHERE abs(from_node % 10 - (to_node + 10) % 10) <= 1 AND to_node IN (SELECT c_custkey FROM customer)),
near_all AS (SELECT least(from_node, to_node) || '-' || greatest(from_node, to_node) AS edge_id, least(from_node, to_node) AS a, greatest(from_node, to_node) AS b, line_id,
             CASE WHEN min(to_node) <> max(to_node) THEN NULL ELSE min(to_node) END AS direction, count(*)::BIGINT AS n FROM hops GROUP BY ALL),
stations AS (SELECT node_id, 's' || (node_id % 100) AS name FROM nodes WHERE node_id % 3 = 0)"""
NEAR = CITY + """,
occs AS (SELECT * FROM near_all WHERE n >= 0.7 * (SELECT avg(n) FROM near_all)),
edges AS (SELECT DISTINCT edge_id, a, b FROM occs),
inc AS (SELECT edge_id, a AS node_id, b AS other FROM edges UNION ALL SELECT edge_id, b, a FROM edges),
att AS (SELECT inc.node_id, inc.edge_id, line_id, direction, n FROM inc JOIN occs USING (edge_id)),
exc AS (SELECT p.node_id, p.line_id, p.edge_id AS edge_a, q.edge_id AS edge_b FROM att p JOIN att q USING (node_id, line_id) WHERE p.edge_id <> q.edge_id AND (p.n + q.n) % 4 = 0),
ctd AS (SELECT p.node_id, p.line_id, p.edge_id AS edge_a, q.edge_id AS edge_b FROM att p JOIN att q USING (node_id, line_id)
        WHERE p.edge_id <> q.edge_id AND (p.direction IS NULL OR q.direction IS NULL OR (p.direction = node_id) <> (q.direction = node_id))
        AND NOT EXISTS (SELECT 1 FROM exc e WHERE e.node_id = p.node_id AND e.line_id = p.line_id AND e.edge_a = p.edge_id AND e.edge_b = q.edge_id)),
deg AS (SELECT node_id, count(*)::BIGINT AS degree FROM inc GROUP BY 1),
circ AS (SELECT inc.node_id, edge_id, (row_number() OVER (PARTITION BY inc.node_id ORDER BY round(CASE WHEN atan2(m.x - k.x, m.y - k.y) < 0 THEN atan2(m.x - k.x, m.y - k.y) + 2 * pi() ELSE atan2(m.x - k.x, m.y - k.y) END, 9), edge_id) - 1)::BIGINT AS rank,
         (count(*) OVER (PARTITION BY inc.node_id))::BIGINT AS degree FROM inc JOIN nodes k ON k.node_id = inc.node_id JOIN nodes m ON m.node_id = inc.other),
dist AS (SELECT p.node_id, p.edge_id AS edge_a, q.edge_id AS edge_b, ((q.rank - p.rank + p.degree) % p.degree)::BIGINT AS steps FROM circ p JOIN circ q USING (node_id) WHERE p.edge_id <> q.edge_id),
ord AS (SELECT edge_id, a, b, line_id, (row_number() OVER (PARTITION BY edge_id ORDER BY n DESC, line_id) - 1)::BIGINT AS pos, (count(*) OVER (PARTITION BY edge_id))::BIGINT AS lines FROM occs),
seen AS (SELECT a AS node_id, edge_id, line_id, lines - 1 - pos AS seen FROM ord UNION ALL SELECT b, edge_id, line_id, pos FROM ord),
legs AS (SELECT ctd.*, p.seen AS sa, q.seen AS sb FROM ctd JOIN seen p ON p.node_id = ctd.node_id AND p.line_id = ctd.line_id AND p.edge_id = ctd.edge_a JOIN seen q ON q.node_id = ctd.node_id AND q.line_id = ctd.line_id AND q.edge_id = ctd.edge_b),
same AS (SELECT p.node_id, count(*)::BIGINT AS same FROM legs p JOIN legs q USING (node_id, edge_a, edge_b) WHERE p.edge_a < p.edge_b AND p.sb < q.sb AND p.sa < q.sa GROUP BY 1),
legd AS (SELECT legs.*, steps FROM legs JOIN dist USING (node_id, edge_a, edge_b)),
diff AS (SELECT p.node_id, count(*)::BIGINT AS diff FROM legd p JOIN legd q USING (node_id, edge_a) WHERE p.line_id <> q.line_id AND p.steps < q.steps AND p.sa < q.sa GROUP BY 1),
sep AS (SELECT p.node_id, count(*)::BIGINT AS sep FROM legs p JOIN legs q ON p.node_id = q.node_id AND p.edge_a = q.edge_a AND p.edge_b = q.edge_b AND p.sb = q.sb - 1 WHERE abs(p.sa - q.sa) > 1 GROUP BY 1)"""
THIN = NEAR.replace("0.7 * ", "1.0 * ")
SPARSE = NEAR.replace("o_orderpriority AS line_id", "'all' AS line_id").replace("0.7 * ", "1.0 * ").replace("(p.n + q.n) % 4 = 0", "false")
POINTS = """
points AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
segs AS (SELECT p.id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM points p JOIN points q ON q.id = p.id + 1 WHERE p.id % 2 = 0)"""
