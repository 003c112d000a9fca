"""Registered queries of ways that lines may take, what stands in their way, and where edges stem from, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import aggregate, evaluate, obstacles, routing, structure, topology
from . import tables as T
from .catalog import query

# Looked up in its own graph, a turn is possible unless an exception forbids it: with edges of length 1 or
# more, no way round is within half a unit.

LIFTED = T.NEAR + """,
turn AS (SELECT p.node_id, p.line_id, p.edge_id AS edge_a, q.edge_id AS edge_b, p.direction = p.node_id AS ia FROM att p JOIN att q USING (node_id, line_id)
         WHERE p.edge_id <> q.edge_id AND (p.direction IS NULL OR q.direction IS NULL OR (p.direction = node_id) <> (q.direction = node_id))),
missing AS (SELECT node_id, line_id, edge_a, edge_b FROM turn EXCEPT SELECT node_id, line_id, edge_a, edge_b FROM ctd),
stuck AS (SELECT node_id, line_id, p.edge_id AS edge, p.direction = node_id AS ia FROM att p WHERE EXISTS (SELECT 1 FROM att q WHERE q.node_id = p.node_id AND q.line_id = p.line_id AND q.edge_id <> p.edge_id)
          AND NOT EXISTS (SELECT 1 FROM ctd WHERE ctd.node_id = p.node_id AND ctd.line_id = p.line_id AND ctd.edge_a = p.edge_id)),
fst AS (SELECT node_id, line_id, arg_min(edge, edge) AS edge, arg_min(coalesce(ia::INT, -1), edge) AS ia FROM stuck GROUP BY 1, 2),
freed AS (SELECT s.node_id, s.line_id, s.edge FROM stuck s JOIN fst f USING (node_id, line_id) WHERE s.edge = f.edge OR (f.ia >= 0 AND s.ia::INT = f.ia))"""


@query("""SELECT node_id, line_id, edge_a, edge_b FROM missing m WHERE NOT EXISTS (SELECT 1 FROM freed f WHERE f.node_id = m.node_id AND f.line_id = m.line_id AND f.edge IN (m.edge_a, m.edge_b))""", LIFTED)
def restrict_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of the graph, found again from the ways that lines have in it."""
    g = T.near(spark, sf_dir)
    origins = g.edges.select("edge_id", F.col("edge_id").alias("original_id"))
    rules = routing.Inference(aggregate=0.1, check=0.1, deviation=0.5, reach=0.05)
    return routing.infer_restrictions(g.with_(exceptions=None), g, origins, rules).exceptions


SAMPLES = 500
ROUTES = T.NEAR + f""",
num AS (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS nth, count(*) OVER () AS n FROM nodes),
smp AS (SELECT i AS sample, node_id AS f, x, y FROM range({SAMPLES}) r(i) JOIN num ON nth = (i * 1103515245 + 12345) % n),
nb AS (SELECT s.sample, s.f, list_sort(list(m.node_id)) AS near FROM smp s JOIN nodes m ON sqrt((m.x - s.x)^2 + (m.y - s.y)^2) <= 2.5 GROUP BY 1, 2),
prs AS (SELECT sample, f, near[(sample * 1103515245 + 54321) % len(near) + 1] AS t FROM nb),
gat AS (SELECT edge_id, a AS node_id, line_id FROM near_all UNION SELECT edge_id, b, line_id FROM near_all),
lns AS (SELECT sample, f, t, list_sort(list(DISTINCT line_id)) AS lines FROM prs JOIN gat ON gat.node_id IN (f, t) GROUP BY ALL),
ask AS (SELECT sample, f, t, lines[(sample * 1103515245 + 99991) % len(lines) + 1] AS line_id FROM lns),
garc AS (SELECT edge_id, a AS u, b AS v, line_id FROM near_all WHERE direction IS NULL OR direction = b UNION ALL SELECT edge_id, b, a, line_id FROM near_all WHERE direction IS NULL OR direction = a),
tarc AS (SELECT edge_id, a AS u, b AS v, line_id FROM occs WHERE direction IS NULL OR direction = b UNION ALL SELECT edge_id, b, a, line_id FROM occs WHERE direction IS NULL OR direction = a),
len AS (SELECT edge_id, sqrt((p.x - q.x)^2 + (p.y - q.y)^2) AS d FROM (SELECT DISTINCT edge_id, a, b FROM near_all) JOIN nodes p ON p.node_id = a JOIN nodes q ON q.node_id = b),
gw(sample, line_id, edge_id, u, v, cost) AS (SELECT sample, ask.line_id, edge_id, u, v, 0.0::DOUBLE FROM ask JOIN garc ON u = f AND garc.line_id = ask.line_id
  UNION SELECT w.sample, w.line_id, n.edge_id, n.u, n.v, w.cost + d FROM gw w JOIN garc n ON n.u = w.v AND n.line_id = w.line_id AND n.edge_id <> w.edge_id JOIN len ON len.edge_id = n.edge_id WHERE w.cost + d < 4),
tw(sample, line_id, edge_id, u, v, cost) AS (SELECT sample, ask.line_id, edge_id, u, v, 0.0::DOUBLE FROM ask JOIN tarc ON u = f AND tarc.line_id = ask.line_id
  UNION SELECT w.sample, w.line_id, n.edge_id, n.u, n.v, w.cost + d FROM tw w JOIN tarc n ON n.u = w.v AND n.line_id = w.line_id AND n.edge_id <> w.edge_id JOIN len ON len.edge_id = n.edge_id WHERE w.cost + d < 4
  AND NOT EXISTS (SELECT 1 FROM exc e WHERE e.node_id = w.v AND e.line_id = w.line_id AND e.edge_a = w.edge_id AND e.edge_b = n.edge_id))"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    occs = cut(T.near_occurrences(spark, sf_dir))
    truth = aggregate.line_graph(T.city_nodes(spark, sf_dir), occs)
    return evaluate.sampled_routes(truth, T.near(spark, sf_dir, occs=occs), SAMPLES, 0.5, span=2.5, limit=4.0)


@query("""SELECT sample, line_id, round((SELECT min(cost) FROM gw WHERE gw.sample = ask.sample AND v = t), 6) AS truth_cost, round((SELECT min(cost) FROM tw WHERE tw.sample = ask.sample AND v = t), 6) AS test_cost FROM ask""", ROUTES)
def eval_sampled_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of at most four units, drawn in the graph of all orders, and their length in the pruned graph."""
    return _routes(spark, sf_dir).select("sample", "line_id", F.round("truth_cost", 6).alias("truth_cost"), F.round("test_cost", 6).alias("test_cost"))


@query()
def eval_route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and distances of the same routes; tests compare it with plain searches."""
    return evaluate.route_summary(_routes(spark, sf_dir), 0.5)


# Obstacles: a triangle of every third embedding, and the segments of the others

AREAS = T.POINTS + """,
tri AS (SELECT vec_id AS polygon, [embedding[1]::DOUBLE, embedding[3]::DOUBLE, embedding[5]::DOUBLE] AS px, [embedding[2]::DOUBLE, embedding[4]::DOUBLE, embedding[6]::DOUBLE] AS py FROM embeddings WHERE vec_id % 3 = 1),
tside AS (SELECT polygon, px[i] AS x3, py[i] AS y3, px[i % 3 + 1] AS x4, py[i % 3 + 1] AS y4 FROM tri, range(1, 4) r(i)),
touched AS (SELECT id, polygon FROM segs, tside WHERE ((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)) * ((x2 - x1) * (y4 - y1) - (y2 - y1) * (x4 - x1)) <= 0
            AND ((x4 - x3) * (y1 - y3) - (y4 - y3) * (x1 - x3)) * ((x4 - x3) * (y2 - y3) - (y4 - y3) * (x2 - x3)) <= 0),
held AS (SELECT id, polygon FROM segs, tside WHERE (y3 <= y1) <> (y4 <= y1) AND x1 < x3 + (y1 - y3) / (y4 - y3) * (x4 - x3) GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.struct(F.col("embedding")[2 * i].cast("double").alias("x"), F.col("embedding")[2 * i + 1].cast("double").alias("y"))
    return T.read(spark, sf_dir, "embeddings").where("vec_id % 3 = 1").select(F.col("vec_id").alias("polygon"), F.array(at(0), at(1), at(2)).alias("ring"))


@query("SELECT id, count(*)::BIGINT AS polygons FROM (SELECT * FROM touched UNION SELECT * FROM held) GROUP BY 1", AREAS)
def obstacle_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many triangles each segment meets or lies in."""
    return obstacles.blocked_counts(T.segments(spark, sf_dir), _areas(spark, sf_dir), 0.1).withColumnRenamed("n", "polygons")


@query("SELECT p.id, polygon FROM points p, tside WHERE (y3 <= p.y) <> (y4 <= p.y) AND p.x < x3 + (p.y - y3) / (y4 - y3) * (x4 - x3) GROUP BY ALL HAVING count(*) % 2 = 1", AREAS)
def obstacle_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which points lie in which triangles; corners are none's inside by parity."""
    return obstacles.points_inside(T.points(spark, sf_dir), _areas(spark, sf_dir), 0.1)


# Course penalties: steps of a lattice of 0.05 between lattice places that have points, and segments as courses

LATTICE = T.POINTS + """,
lat AS (SELECT DISTINCT round(x / 0.05)::BIGINT AS gx, round(y / 0.05)::BIGINT AS gy FROM points),
hop AS (SELECT p.gx * 1000 + p.gy * 2 + (q.gy - p.gy) AS id, p.gx * 0.05 AS hx1, p.gy * 0.05 AS hy1, q.gx * 0.05 AS hx2, q.gy * 0.05 AS hy2 FROM lat p JOIN lat q ON (q.gx = p.gx + 1 AND q.gy = p.gy) OR (q.gx = p.gx AND q.gy = p.gy + 1)),
par AS (SELECT s.id AS edge_id, hop.id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((hx1 - x1) * (x2 - x1) + (hy1 - y1) * (y2 - y1)) / ((x2 - x1)^2 + (y2 - y1)^2))) AS t,
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((hx2 - x1) * (x2 - x1) + (hy2 - y1) * (y2 - y1)) / ((x2 - x1)^2 + (y2 - y1)^2))) AS u, * EXCLUDE (id) FROM segs s, hop)"""


@query("""SELECT edge_id, id, round(penalty, 6) AS penalty FROM (SELECT edge_id, id, 3 * greatest(sqrt((hx1 - x1 - t * (x2 - x1))^2 + (hy1 - y1 - t * (y2 - y1))^2), sqrt((hx2 - x1 - u * (x2 - x1))^2 + (hy2 - y1 - u * (y2 - y1))^2))^2 / 0.05^2 AS penalty FROM par) WHERE penalty <= 6.7""", LATTICE)
def obstacle_course_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda c: F.round(F.col(c) / 0.05).cast("long")
    lattice = T.points(spark, sf_dir).select(place("x").alias("gx"), place("y").alias("gy")).distinct()
    ahead = lattice.select("gx", "gy", F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))).alias("m")).select("gx", "gy", (F.col("gx") + F.col("m.dx")).alias("qx"), (F.col("gy") + F.col("m.dy")).alias("qy"))
    steps = ahead.join(lattice.select(F.col("gx").alias("qx"), F.col("gy").alias("qy")), ["qx", "qy"])
    hops = steps.select((F.col("gx") * 1000 + F.col("gy") * 2 + F.col("qy") - F.col("gy")).alias("id"), *[(F.col(c) * 0.05).alias(n) for c, n in (("gx", "x1"), ("gy", "y1"), ("qx", "x2"), ("qy", "y2"))])
    s = T.segments(spark, sf_dir)
    courses = s.select(F.col("id").alias("edge_id"), F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))).alias("geom"))
    return obstacles.course_penalties(hops, courses, 0.05, 3.0, 6.7).select("edge_id", "id", F.round("penalty", 6).alias("penalty"))


# Origins through a merge of nodes and a cut of edges

TRACED = T.NEAR + """,
fold AS (SELECT DISTINCT edge_id AS original_id, least(a - a % 3, b - b % 3) AS p, greatest(a - a % 3, b - b % 3) AS q FROM edges WHERE a - a % 3 <> b - b % 3),
cutup AS (SELECT original_id, p AS u, -(p * 1000003 + q) - 1 AS v FROM fold WHERE p % 2 = 0 UNION ALL SELECT original_id, -(p * 1000003 + q) - 1, q FROM fold WHERE p % 2 = 0 UNION ALL SELECT original_id, p, q FROM fold WHERE p % 2 <> 0)"""


def _traced(spark: SparkSession, sf_dir: str):
    """The graph with every three nodes in a row merged, and then edges from even nodes cut in the middle."""
    g = T.near(spark, sf_dir).tracked()
    merged = structure.remap(g, g.nodes.select("node_id", (F.col("node_id") - F.col("node_id") % 3).alias("into")))
    names = g.nodes.select((F.col("node_id") - F.col("node_id") % 3).alias("node_id"), "x", "y").dropDuplicates(["node_id"])
    merged = merged.with_(nodes=names, edges=cut(merged.edges))
    cuts = merged.edges.where("a % 2 = 0").select("edge_id", F.lit(0.5).alias("share"), (-(F.col("a") * 1000003 + F.col("b")) - 1).alias("node_id"))
    return topology.split_edges(merged, cuts)


@query("SELECT DISTINCT least(u, v) || '-' || greatest(u, v) AS edge_id, original_id FROM cutup", TRACED)
def lineage_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir).origins


@query("SELECT count(*)::BIGINT AS edges, round(avg(n), 6) AS mean_merged, max(n)::BIGINT AS max_merged FROM (SELECT u, v, count(DISTINCT original_id) AS n FROM cutup GROUP BY ALL)", TRACED)
def lineage_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.merged_edges(_traced(spark, sf_dir))
    return found.select("edges", F.round("mean_merged", 6).alias("mean_merged"), "max_merged")
