"""Registered queries of geometry, topology, stations, grids and drawing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import with_geometry
from ..operators import aggregate, algebra, drawing, geometry, grids, ordergraph, ordering, schematic, spatial, stations, structure, topology
from . import tables as T
from .catalog import query

# Polylines of four points: the first eight numbers of every embedding

PATHS = """
v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y1, embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS y2,
      embedding[5]::DOUBLE AS x3, embedding[6]::DOUBLE AS y3, embedding[7]::DOUBLE AS x4, embedding[8]::DOUBLE AS y4 FROM embeddings),
d AS (SELECT *, sqrt((x2 - x1)^2 + (y2 - y1)^2) AS a, sqrt((x3 - x2)^2 + (y3 - y2)^2) AS b, sqrt((x4 - x3)^2 + (y4 - y3)^2) AS c FROM v),
l AS (SELECT *, a + b + c AS len FROM d)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, p): polylines of four points."""
    at = lambda i: geometry.point(F.col("embedding")[2 * i].cast("double"), F.col("embedding")[2 * i + 1].cast("double"))
    return T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[at(i) for i in range(4)]).alias("p"))


@query("SELECT id, round(len, 6) AS length, round(least(x1, x2, x3, x4), 6) AS x_min, round(greatest(y1, y2, y3, y4), 6) AS y_max FROM l", PATHS)
def geo_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geometry.box(F.col("p"))
    return paths(spark, sf_dir).select("id", F.round(geometry.length(F.col("p")), 6).alias("length"), F.round(b["x1"], 6).alias("x_min"), F.round(b["y2"], 6).alias("y_max"))


@query("""SELECT id, 0::BIGINT AS i, 0.0::DOUBLE AS s FROM l UNION ALL SELECT id, 1, round(a, 6) FROM l UNION ALL SELECT id, 2, round(a + b, 6) FROM l UNION ALL SELECT id, 3, round(len, 6) FROM l""", PATHS)
def geo_arc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths(spark, sf_dir).select("id", F.posexplode(geometry.arc_lengths(F.col("p"))).alias("i", "s"))
    return rows.select("id", F.col("i").cast("long").alias("i"), F.round("s", 6).alias("s"))


AT = """(CASE WHEN {s} * len < a THEN {v}1 + {s} * len / a * ({v}2 - {v}1) WHEN {s} * len < a + b THEN {v}2 + ({s} * len - a) / b * ({v}3 - {v}2) ELSE {v}3 + ({s} * len - a - b) / c * ({v}4 - {v}3) END)"""


@query(f"SELECT id, round({AT.format(s='0.4::DOUBLE', v='x')}, 6) AS x, round({AT.format(s='0.4::DOUBLE', v='y')}, 6) AS y FROM l", PATHS)
def geo_point_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths(spark, sf_dir).select("id", geometry.point_at(F.col("p"), F.lit(0.4)).alias("q"))
    return rows.select("id", F.round("q.x", 6).alias("x"), F.round("q.y", 6).alias("y"))


@query("SELECT id, round(len * 0.5::DOUBLE, 6) AS length FROM l", PATHS)
def geo_sub_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle half of every polyline is half as long."""
    return paths(spark, sf_dir).select("id", F.round(geometry.length(geometry.sub_path(F.col("p"), F.lit(0.25), F.lit(0.75))), 6).alias("length"))


@query(f"""SELECT id, i::BIGINT AS i, round((CASE i WHEN 0 THEN x1 WHEN 1 THEN {AT.format(s='0.5::DOUBLE', v='x')} ELSE x4 END + CASE i WHEN 0 THEN x4 WHEN 1 THEN {AT.format(s='0.5::DOUBLE', v='x')} ELSE x1 END) / 2, 6) AS x FROM l, range(0, 3) r(i)""", PATHS)
def geo_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every polyline and itself from the other end, at three shares."""
    rows = paths(spark, sf_dir).select("id", F.posexplode(geometry.average(F.col("p"), F.reverse("p"), 2)).alias("i", "q"))
    return rows.select("id", F.col("i").cast("long").alias("i"), F.round("q.x", 6).alias("x"))


@query("""SELECT id, i::BIGINT AS i, round(CASE i WHEN 0 THEN x1 WHEN 1 THEN x1 + 0.75 * (x2 - x1) WHEN 2 THEN x2 + 0.25 * (x3 - x2) WHEN 3 THEN x2 + 0.75 * (x3 - x2) WHEN 4 THEN x3 + 0.25 * (x4 - x3) ELSE x4 END, 6) AS x FROM l, range(0, 6) r(i)""", PATHS)
def geo_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths(spark, sf_dir).select("id", F.posexplode(geometry.chaikin(F.col("p"))).alias("i", "q"))
    return rows.select("id", F.col("i").cast("long").alias("i"), F.round("q.x", 6).alias("x"))


SEG = "sqrt(({p}x + t{k} * ({q}x - {p}x))^2 + ({p}y + t{k} * ({q}y - {p}y))^2)"


@query("""SELECT id, round(least(sqrt((x1 + t1 * (x2 - x1))^2 + (y1 + t1 * (y2 - y1))^2), sqrt((x2 + t2 * (x3 - x2))^2 + (y2 + t2 * (y3 - y2))^2), sqrt((x3 + t3 * (x4 - x3))^2 + (y3 + t3 * (y4 - y3))^2)), 6) AS d
FROM (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / a^2)) AS t1, least(1.0::DOUBLE, greatest(0.0::DOUBLE, -(x2 * (x3 - x2) + y2 * (y3 - y2)) / b^2)) AS t2,
least(1.0::DOUBLE, greatest(0.0::DOUBLE, -(x3 * (x4 - x3) + y3 * (y4 - y3)) / c^2)) AS t3 FROM l)""", PATHS)
def geo_nearest_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How close every polyline comes to the origin."""
    return paths(spark, sf_dir).select("id", F.round(geometry.nearest_on(F.col("p"), F.lit(0.0), F.lit(0.0))["d"], 6).alias("d"))


# Topology

PAIRS = T.NEAR + """,
pe AS (SELECT edge_id, count(*) AS n FROM occs GROUP BY 1),
sh AS (SELECT p.node_id, p.edge_id AS edge_a, q.edge_id AS edge_b, count(*) AS shared, sum(CASE WHEN p.direction IS NULL AND q.direction IS NULL THEN 1 WHEN (p.direction = p.node_id) <> (q.direction = q.node_id) THEN 1 ELSE 0 END) AS same
       FROM att p JOIN att q USING (node_id, line_id) WHERE p.edge_id <> q.edge_id GROUP BY ALL),
cn AS (SELECT node_id, edge_a, edge_b, count(*) AS continued FROM ctd GROUP BY ALL),
rel AS (SELECT i.node_id, i.edge_id AS edge_a, j.edge_id AS edge_b, pa.n AS la, pb.n AS lb, coalesce(shared, 0) AS shared, coalesce(continued, 0) AS continued, coalesce(same, 0) AS same FROM inc i JOIN inc j ON i.node_id = j.node_id AND i.edge_id <> j.edge_id
        JOIN pe pa ON pa.edge_id = i.edge_id JOIN pe pb ON pb.edge_id = j.edge_id LEFT JOIN sh ON sh.node_id = i.node_id AND sh.edge_a = i.edge_id AND sh.edge_b = j.edge_id LEFT JOIN cn ON cn.node_id = i.node_id AND cn.edge_a = i.edge_id AND cn.edge_b = j.edge_id)"""


@query("""SELECT node_id, edge_a, edge_b, la::BIGINT AS lines_a, lb::BIGINT AS lines_b, shared::BIGINT AS shared, continued::BIGINT AS continued, same::BIGINT AS same,
CASE WHEN continued = la AND continued = lb THEN 'equal' WHEN continued = la THEN 'contained' WHEN continued > 0 THEN 'partial' WHEN shared > 0 THEN 'blocked' ELSE 'disjoint' END AS relation FROM rel""", PAIRS)
def topology_pair_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.pair_relations(T.near(spark, sf_dir))


@query("SELECT node_id, line_id, edge_a, edge_b FROM ctd JOIN (SELECT node_id, line_id, edge_a FROM ctd GROUP BY ALL HAVING count(*) = 1) USING (node_id, line_id, edge_a)", T.NEAR)
def topology_unique_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.unique_extensions(T.near(spark, sf_dir))


STUCK = T.NEAR + """,
oth AS (SELECT node_id, line_id, count(*) - 1 AS others FROM att GROUP BY 1, 2),
stuck AS (SELECT exc.node_id, exc.line_id, edge_a AS edge FROM exc JOIN oth ON oth.node_id = exc.node_id AND oth.line_id = exc.line_id AND others > 0 GROUP BY exc.node_id, exc.line_id, edge_a, others HAVING count(DISTINCT edge_b) >= others)"""


@query("""SELECT node_id, line_id, edge_a, edge_b FROM exc WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.node_id = exc.node_id AND s.line_id = exc.line_id AND s.edge = exc.edge_a)
AND NOT EXISTS (SELECT 1 FROM stuck s WHERE s.node_id = exc.node_id AND s.line_id = exc.line_id AND s.edge = exc.edge_b)""", STUCK)
def topology_useful_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.useful_exceptions(T.near(spark, sf_dir))


ORPHANS = T.NEAR + """,
term AS (SELECT node_id, line_id, edge_id FROM att WHERE NOT EXISTS (SELECT 1 FROM ctd WHERE ctd.node_id = att.node_id AND ctd.line_id = att.line_id AND ctd.edge_a = att.edge_id)),
bad AS (SELECT DISTINCT edge_id, line_id FROM term WHERE node_id NOT IN (SELECT node_id FROM stations)),
pe AS (SELECT edge_id, count(*) AS n FROM occs GROUP BY 1), gone AS (SELECT edge_id, count(*) AS g FROM bad GROUP BY 1),
stump AS (SELECT DISTINCT edge_id FROM inc JOIN deg USING (node_id) WHERE degree = 1)"""


@query("SELECT edge_id, line_id FROM bad JOIN pe USING (edge_id) JOIN gone USING (edge_id) WHERE g < n OR edge_id IN (SELECT edge_id FROM stump)", ORPHANS)
def topology_orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.near(spark, sf_dir)
    served = T.stations(spark, sf_dir).select("node_id").join(g.incidence().join(g.occs, "edge_id").select("node_id", "line_id").distinct(), "node_id")
    return topology.orphan_lines(g, served)


@query("""SELECT line_id, node_id, edge_a, edge_b, round(sqrt(bx^2 + by_^2) + CASE WHEN degrees(acos(greatest(-1, least(1, round((ax * bx + ay * by_) / sqrt((ax^2 + ay^2) * (bx^2 + by_^2)), 12))))) < 60 THEN 5 ELSE 0 END, 6) AS cost
FROM ctd JOIN (SELECT inc.node_id, edge_id AS edge_a, m.x - k.x AS ax, m.y - k.y AS ay FROM inc JOIN nodes k ON k.node_id = inc.node_id JOIN nodes m ON m.node_id = inc.other) USING (node_id, edge_a)
JOIN (SELECT inc.node_id, edge_id AS edge_b, m.x - k.x AS bx, m.y - k.y AS by_ FROM inc JOIN nodes k ON k.node_id = inc.node_id JOIN nodes m ON m.node_id = inc.other) USING (node_id, edge_b)""", T.NEAR)
def topology_turn_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.turn_costs(T.near(spark, sf_dir), 5.0, 60.0).withColumn("cost", F.round("cost", 6))


SPLIT = T.NEAR + """,
pieces AS (SELECT edge_id, a AS u, -(a * 1000003 + b) - 1 AS v, a, b FROM edges WHERE a % 2 = 0 UNION ALL SELECT edge_id, -(a * 1000003 + b) - 1, b, a, b FROM edges WHERE a % 2 = 0),
named AS (SELECT *, least(u, v) || '-' || greatest(u, v) AS piece FROM pieces)"""


@query("""SELECT piece AS edge_id, line_id, CASE WHEN direction = named.b THEN v WHEN direction = named.a THEN u END::VARCHAR AS direction, n FROM named JOIN occs USING (edge_id)
UNION ALL SELECT edge_id, line_id, direction::VARCHAR, n FROM occs WHERE edge_id NOT IN (SELECT edge_id FROM named)""", SPLIT)
def topology_split_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge whose smaller node is even is cut in the middle."""
    g = T.near(spark, sf_dir)
    cuts = g.edges.where("a % 2 = 0").select("edge_id", F.lit(0.5).alias("share"), (-(F.col("a") * 1000003 + F.col("b")) - 1).alias("node_id"))
    return topology.split_edges(g, cuts).occs.select("edge_id", "line_id", F.col("direction").cast("string").alias("direction"), "n")


@query("""SELECT node_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM (
SELECT a AS node_id, p.x + 0.1 * (q.x - p.x) AS x, p.y + 0.1 * (q.y - p.y) AS y FROM edges JOIN nodes p ON p.node_id = a JOIN nodes q ON q.node_id = b
UNION ALL SELECT b, p.x + 0.7 * (q.x - p.x), p.y + 0.7 * (q.y - p.y) FROM edges JOIN nodes p ON p.node_id = a JOIN nodes q ON q.node_id = b) GROUP BY 1""", T.NEAR)
def topology_node_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose geometries reach from 10 to 70 % of the way between their nodes."""
    g = with_geometry(T.near(spark, sf_dir))
    g = g.with_(edges=g.edges.withColumn("geom", geometry.sub_path(F.col("geom"), F.lit(0.1), F.lit(0.7))))
    return topology.node_means(g).select("node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def topology_contract_stray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of the sparse graph contracted to a fixpoint; tested against a sequential contraction."""
    g = topology.contract_stray(T.sparse(spark, sf_dir))
    return g.edges


# Stations

CLUSTERS = T.NEAR + """,
son AS (SELECT DISTINCT name, edge_id FROM stations JOIN inc USING (node_id)),
slin AS (SELECT DISTINCT name, line_id FROM son JOIN occs USING (edge_id)),
clu AS (SELECT name, arg_min(x, node_id) AS x, arg_min(y, node_id) AS y, count(*) AS n_nodes, (SELECT count(*) FROM son WHERE son.name = s.name) AS n_edges, (SELECT count(*) FROM slin WHERE slin.name = s.name) AS n_lines
        FROM stations s JOIN nodes USING (node_id) GROUP BY name)"""
CANDS = CLUSTERS + """,
geo AS (SELECT edge_id, a, b, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, sqrt((p.x - q.x)^2 + (p.y - q.y)^2) AS length FROM edges JOIN nodes p ON p.node_id = a JOIN nodes q ON q.node_id = b),
nearby AS (SELECT name, edge_id, a, b, x, y, x1, y1, x2, y2, length, n_edges, n_lines, coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(length^2, 0))), 0) AS share FROM clu JOIN geo ON x BETWEEN least(x1, x2) - 0.8 AND greatest(x1, x2) + 0.8 AND y BETWEEN least(y1, y2) - 0.8 AND greatest(y1, y2) + 0.8),
placed AS (SELECT *, sqrt((x - x1 - share * (x2 - x1))^2 + (y - y1 - share * (y2 - y1))^2) AS d FROM nearby)"""
SCORED = CANDS + """,
allc AS (SELECT name, 'edge' AS kind, edge_id AS target, d, (length * (1 - share) < 0.2)::INT + (length * share < 0.2)::INT AS close, n_edges, n_lines FROM placed
         UNION ALL SELECT DISTINCT p.name, 'node', k.node_id::VARCHAR, sqrt((k.x - p.x)^2 + (k.y - p.y)^2), 0, n_edges, n_lines FROM placed p JOIN nodes k ON k.node_id = p.a OR k.node_id = p.b),
touch AS (SELECT 'edge' AS kind, edge_id AS target, edge_id FROM edges UNION ALL SELECT 'node', node_id::VARCHAR, edge_id FROM inc),
te AS (SELECT name, kind, target, count(*) AS edges FROM allc JOIN touch USING (kind, target) JOIN son USING (name, edge_id) GROUP BY ALL),
tl AS (SELECT name, kind, target, count(DISTINCT line_id) AS lines FROM allc JOIN touch USING (kind, target) JOIN occs USING (edge_id) JOIN slin USING (name, line_id) GROUP BY ALL),
sc AS (SELECT name, kind, target, d, d + CASE WHEN n_edges > 0 THEN 100.0::DOUBLE * (n_edges - coalesce(edges, 0)) / n_edges ELSE 0 END + CASE WHEN n_lines > 0 THEN 500.0::DOUBLE * (n_lines - coalesce(lines, 0)) / n_lines ELSE 0 END + 200 * close AS score
       FROM allc LEFT JOIN te USING (name, kind, target) LEFT JOIN tl USING (name, kind, target)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 9), kind, target) AS k FROM sc) WHERE k = 1)"""


@query("SELECT name, x, y, n_nodes::BIGINT AS n_nodes, n_edges::BIGINT AS n_edges, n_lines::BIGINT AS n_lines FROM clu", CLUSTERS)
def station_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.clusters(T.near(spark, sf_dir), T.stations(spark, sf_dir))


@query("SELECT name, edge_id, round(d, 6) AS d, round(share, 6) AS share FROM placed", CANDS)
def station_candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.near(spark, sf_dir)
    places = stations.clusters(g, T.stations(spark, sf_dir)).select("name", "x", "y")
    return stations.candidate_edges(g, places, 0.2).select("name", "edge_id", F.round("d", 6).alias("d"), F.round("share", 6).alias("share"))


@query("SELECT name, kind, target, round(score, 6) AS score FROM sc", SCORED)
def station_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.candidates(T.near(spark, sf_dir), T.stations(spark, sf_dir), 0.2).select("name", "kind", "target", F.round("score", 6).alias("score"))


@query("SELECT name, kind, target FROM best", SCORED)
def station_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.best(stations.candidates(T.near(spark, sf_dir), T.stations(spark, sf_dir), 0.2)).select("name", "kind", "target")


@query("""SELECT name, line_id FROM slin WHERE name IN (SELECT name FROM best_edge) AND NOT EXISTS (SELECT 1 FROM best_edge JOIN occs ON occs.edge_id = best_edge.target WHERE best_edge.name = slin.name AND occs.line_id = slin.line_id)""",
SCORED + """, best_edge AS (SELECT * FROM (SELECT name, target, row_number() OVER (PARTITION BY name ORDER BY round(score, 9), target) AS k FROM sc WHERE kind = 'edge') WHERE k = 1)""")
def station_unserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best edge of each cluster leaves unserved."""
    g, s = T.near(spark, sf_dir), T.stations(spark, sf_dir)
    chosen = stations.best(stations.candidates(g, s, 0.2).where("kind = 'edge'"))
    return stations.unserved(g, s, chosen).join(chosen.select("name"), "name", "left_semi")


@query("""SELECT node_id, name, (row_number() OVER (ORDER BY (node_id IN (SELECT node_id FROM term))::INT DESC, degree DESC, ld DESC, node_id))::BIGINT AS place
FROM stations JOIN deg USING (node_id) JOIN (SELECT node_id, count(*) AS ld FROM att GROUP BY 1) USING (node_id)""", ORPHANS)
def station_label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.label_order(T.near(spark, sf_dir), T.stations(spark, sf_dir))


@query("SELECT name, arg_min(node_id, (-degree, node_id)) AS node_id FROM stations JOIN deg USING (node_id) GROUP BY 1", T.NEAR)
def station_biggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.near(spark, sf_dir)
    return stations.biggest(T.stations(spark, sf_dir).join(algebra.degrees(g), "node_id"), "degree")


# Order graph


SINGLES = T.NEAR + """,
single AS (SELECT edge_id, a, b FROM edges WHERE (SELECT count(*) FROM occs o WHERE o.edge_id = edges.edge_id) = 1 AND a IN (SELECT node_id FROM deg WHERE degree > 1) AND b IN (SELECT node_id FROM deg WHERE degree > 1)),
halves AS (SELECT edge_id, a AS node, -(a * 1000003 + b) * 2 - 1 AS fresh FROM single UNION ALL SELECT edge_id, b, -(a * 1000003 + b) * 2 - 2 FROM single)"""


@query("""SELECT edge_id, line_id, direction::VARCHAR AS direction FROM occs WHERE edge_id NOT IN (SELECT edge_id FROM single)
UNION ALL SELECT least(node, fresh) || '-' || greatest(node, fresh), line_id, CASE WHEN direction = node THEN node WHEN direction IS NOT NULL THEN fresh END::VARCHAR FROM halves JOIN occs USING (edge_id)""", SINGLES)
def order_cut_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on edges after those of one line are cut in two."""
    g = T.near(spark, sf_dir)
    a, b = F.split("edge_id", "-")[0].cast("long"), F.split("edge_id", "-")[1].cast("long")
    name = lambda edge, half: -(a * 1000003 + b) * 2 - half
    return ordergraph.cut_single(g, name).occs.select("edge_id", "line_id", F.col("direction").cast("string").alias("direction"))


@query("SELECT node_id, edge_id, node_id || '|' || edge_id AS end_id FROM (SELECT node_id, edge_id, count(*) AS n FROM term GROUP BY ALL) JOIN pe USING (edge_id, n) JOIN deg USING (node_id) WHERE degree > 1", ORPHANS)
def order_detached_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordergraph.detached_ends(T.near(spark, sf_dir))


DETACHED = ORPHANS + """,
ends AS (SELECT node_id, edge_id FROM (SELECT node_id, edge_id, count(*) AS n FROM term GROUP BY ALL) JOIN pe USING (edge_id, n) JOIN deg USING (node_id) WHERE degree > 1),
one AS (SELECT min(node_id) AS node_id, edge_id FROM ends GROUP BY edge_id),
off AS (SELECT node_id, edge_id, -(a * 1000003 + b) AS fresh, CASE WHEN node_id = a THEN b ELSE a END AS other FROM one JOIN edges USING (edge_id)
        WHERE (node_id, edge_id) NOT IN (SELECT node_id, max(edge_id) FROM one JOIN deg USING (node_id) GROUP BY node_id, degree HAVING count(*) = degree))"""


@query("""SELECT coalesce(least(other, fresh) || '-' || greatest(other, fresh), edge_id) AS edge_id, line_id, CASE WHEN direction = node_id THEN fresh ELSE direction END::VARCHAR AS direction FROM occs LEFT JOIN off USING (edge_id)""", DETACHED)
def order_detach_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on edges after ends without a line that goes on are hung on nodes of their own."""
    a, b = F.split("edge_id", "-")[0].cast("long"), F.split("edge_id", "-")[1].cast("long")
    g = ordergraph.detach_ends(T.near(spark, sf_dir), lambda node, edge: -(a * 1000003 + b))
    return g.occs.select("edge_id", "line_id", F.col("direction").cast("string").alias("direction"))


@query("""SELECT DISTINCT min(line_id) OVER (PARTITION BY path) AS representative, line_id, edge_id FROM (SELECT path, line_id, count(*) OVER (PARTITION BY path) AS size FROM partner) JOIN part USING (path) WHERE size > 1""",
T.THIN + """, hop AS (SELECT line_id, a AS u, b AS v FROM occs UNION ALL SELECT line_id, b, a FROM occs),
reach(line_id, node_id, r) AS (SELECT DISTINCT line_id, u, u FROM hop UNION SELECT reach.line_id, reach.node_id, hop.v FROM reach JOIN hop ON hop.line_id = reach.line_id AND hop.u = reach.r),
piece AS (SELECT line_id || '/' || min(r) AS path, line_id, node_id FROM reach GROUP BY line_id, node_id),
inner_ AS (SELECT p.path, e.edge_id, e.a, e.b FROM edges e JOIN piece p ON p.node_id = e.a JOIN piece q ON q.node_id = e.b AND q.path = p.path),
degs AS (SELECT path, node_id, count(*) AS d FROM (SELECT path, a AS node_id FROM inner_ UNION ALL SELECT path, b FROM inner_) GROUP BY ALL),
simple AS (SELECT path FROM degs GROUP BY path HAVING max(d) <= 2 AND min(d) = 1),
part AS (SELECT path, edge_id, (count(*) OVER (PARTITION BY path)) AS n FROM inner_ WHERE path IN (SELECT path FROM simple)),
whole AS (SELECT path, part.n AS n, line_id FROM part JOIN occs USING (edge_id) GROUP BY ALL HAVING count(*) = part.n),
ways AS (SELECT p.path, c.line_id, count(*) FILTER (WHERE q.path IS NOT NULL AND edge_a < edge_b) AS over_, count(*) FILTER (WHERE q.path IS NULL) AS beside
         FROM part p JOIN ctd c ON c.edge_a = p.edge_id LEFT JOIN part q ON q.path = p.path AND q.edge_id = c.edge_b GROUP BY ALL),
partner AS (SELECT w.path, w.line_id FROM whole w LEFT JOIN ways v ON v.path = w.path AND v.line_id = w.line_id WHERE coalesce(over_, 0) = n - 1 AND coalesce(beside, 0) = 0)""")
def order_partner_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that always run together along a simple path, with the path's edges."""
    return ordergraph.partner_groups(T.thin(spark, sf_dir))


@query("""SELECT component, (SELECT count(*) FROM comp c WHERE c.component = e.component)::BIGINT AS nodes, count(*)::BIGINT AS edges, max(n)::BIGINT AS max_lines, round(sum(list_sum(list_transform(range(1, n + 1), lambda k: log10(k)))), 6) AS log10_orders
FROM (SELECT component, n FROM edges JOIN comp ON comp.node_id = a JOIN pe USING (edge_id)) e GROUP BY component""",
T.SPARSE + """, pe AS (SELECT edge_id, count(*)::BIGINT AS n FROM occs GROUP BY 1), hop AS (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges),
reach(node_id, r) AS (SELECT node_id, node_id FROM nodes UNION SELECT reach.node_id, hop.v FROM reach JOIN hop ON hop.u = reach.r), comp AS (SELECT node_id, min(r) AS component FROM reach GROUP BY 1)""")
def order_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordergraph.component_sizes(T.sparse(spark, sf_dir))


@query("""SELECT edge_id, (row_number() OVER (ORDER BY n DESC, degrees DESC, edge_id))::BIGINT AS place FROM (SELECT edge_id, count(*) AS n FROM occs GROUP BY 1) JOIN (SELECT edge_id, sum(degree) AS degrees FROM inc JOIN deg USING (node_id) GROUP BY 1) USING (edge_id)""", T.NEAR)
def order_edge_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordergraph.edge_ordering(T.near(spark, sf_dir))


@query("SELECT edge_id, line_id, (lines - 1 - pos)::BIGINT AS pos, lines FROM ord", T.NEAR)
def order_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge's order turned round by a permutation of its places."""
    order = ordering.default_order(T.near(spark, sf_dir))
    return ordering.apply_order(order, order.select("edge_id", "pos", (F.col("lines") - 1 - F.col("pos")).alias("new_pos")))


# Grids

EXTENT = "ext AS (SELECT 10::BIGINT AS w, (max(c_custkey) // 10 + 1)::BIGINT AS h FROM customer)"
GRID = EXTENT + """,
pts AS (SELECT id % w AS x, id // w AS y, w, h FROM (SELECT unnest(range(w * h)) AS id, w, h FROM ext)),
mv(dir, dx, dy) AS (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)),
hops8 AS (SELECT x, y, dir::BIGINT AS dir, x + dx AS to_x, y + dy AS to_y FROM pts, mv WHERE x + dx >= 0 AND x + dx < w AND y + dy >= 0 AND y + dy < h)"""


def extent(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return 10, T.read(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] // 10 + 1


@query("SELECT x, y, dir, to_x, to_y, CASE dir % 4 WHEN 0 THEN 0.0 WHEN 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS cost FROM hops8", GRID)
def grid_octilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.octilinear(spark, *extent(spark, sf_dir))


@query("SELECT x, y, dir // 2 AS dir, to_x, to_y, CASE WHEN dir // 2 % 2 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE AS cost FROM hops8 WHERE dir % 2 = 0", GRID)
def grid_orthogonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.orthogonal(spark, *extent(spark, sf_dir), grids.Costs(vertical=0.25, horizontal=0.75))


@query("""SELECT x, y, dir::BIGINT AS dir, x + dx AS to_x, y + dy AS to_y, CASE WHEN dir IN (1, 4) THEN 0.0 ELSE 0.5 END::DOUBLE AS cost FROM pts JOIN hex ON y % 2 = parity WHERE x + dx >= 0 AND x + dx < w AND y + dy >= 0 AND y + dy < h""",
GRID + """, hex(parity, dir, dx, dy) AS (VALUES (0, 0, 0, 1), (0, 1, 1, 0), (0, 2, 0, -1), (0, 3, -1, -1), (0, 4, -1, 0), (0, 5, -1, 1), (1, 0, 1, 1), (1, 1, 1, 0), (1, 2, 1, -1), (1, 3, 0, -1), (1, 4, -1, 0), (1, 5, 0, 1))""")
def grid_hexagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.hexagonal(spark, *extent(spark, sf_dir))


@query("SELECT p.x, p.y, p.dir, q.x AS other_x, q.y AS other_y, q.dir AS other_dir FROM hops8 p JOIN hops8 q ON p.dir = 1 AND q.dir = 3 AND q.x = p.x AND q.y = p.y + 1", GRID)
def grid_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.crossings(grids.octilinear(spark, *extent(spark, sf_dir)))


@query("SELECT x, y, dir, to_x, to_y FROM hops8 WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 40 AND to_x BETWEEN 2 AND 6 AND to_y BETWEEN 1 AND 40", GRID)
def grid_inside_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.inside_box(grids.octilinear(spark, *extent(spark, sf_dir)), 2, 1, 6, 40).drop("cost")


@query("SELECT x, y FROM pts WHERE y >= 0 AND x + y <= 9 AND x >= y", GRID)
def grid_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid points inside a triangle."""
    return grids.hull_mask(grids.points(spark, *extent(spark, sf_dir)), [(0, 0), (9, 0), (4.5, 4.5)])


@query("SELECT id, round(sqrt((gx * 0.05 - x)^2 + (gy * 0.05 - y)^2) / 0.05 * (0.5 + 1.0 + 0.0), 6) AS penalty FROM (SELECT id, x, y, round(x / 0.05) AS gx, round(y / 0.05) AS gy FROM points)", T.POINTS)
def grid_move_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of drawing each point on its nearest grid point."""
    p = T.points(spark, sf_dir)
    d = F.sqrt((F.round(F.col("x") / 0.05) * 0.05 - F.col("x")) ** 2 + (F.round(F.col("y") / 0.05) * 0.05 - F.col("y")) ** 2)
    return p.select("id", F.round(grids.move_penalty(d, 0.05), 6).alias("penalty"))


# Drawing


@query("SELECT edge_id, count(*)::BIGINT AS lines, (count(*) * 30.0 - 10)::DOUBLE AS total FROM occs GROUP BY 1", T.NEAR)
def draw_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing.edge_widths(T.near(spark, sf_dir))


@query("""SELECT node_id, edge_id, round(x0 + t * ux + uy * total / 2, 6) AS x1, round(y0 + t * uy - ux * total / 2, 6) AS y1, round(x0 + t * ux - uy * total / 2, 6) AS x2, round(y0 + t * uy + ux * total / 2, 6) AS y2 FROM (
SELECT inc.node_id, edge_id, k.x AS x0, k.y AS y0, least(0.3, len / 2) AS t, (m.x - k.x) / len AS ux, (m.y - k.y) / len AS uy, lines * 0.03 - 0.01 AS total
FROM inc JOIN nodes k ON k.node_id = inc.node_id JOIN nodes m ON m.node_id = inc.other JOIN (SELECT edge_id, count(*)::DOUBLE AS lines FROM occs GROUP BY 1) USING (edge_id), LATERAL (SELECT sqrt((m.x - k.x)^2 + (m.y - k.y)^2) AS len))""", T.NEAR)
def draw_node_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.near(spark, sf_dir)
    rows = drawing.node_fronts(g, drawing.edge_widths(g, 0.02, 0.01), 0.3)
    return rows.select("node_id", "edge_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""SELECT node_id, edge_id FROM inc JOIN nodes k USING (node_id) JOIN nodes m ON m.node_id = inc.other, LATERAL (SELECT sqrt((m.x - k.x)^2 + (m.y - k.y)^2) AS len)
WHERE len > 1.2 OR least(0.3, len / 2) > 6 * 1.2 OR node_id IN (SELECT node_id FROM stations) OR other IN (SELECT node_id FROM stations)""", T.NEAR)
def draw_open_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts stand at right angles 0.3 from their nodes, so that is their distance."""
    g = T.near(spark, sf_dir)
    return drawing.open_fronts(g, drawing.node_fronts(g, drawing.edge_widths(g, 0.02, 0.01), 0.3), T.stations(spark, sf_dir), 1.2)


@query("SELECT node_id, line_id, edge_a, edge_b, sa AS pos_a, sb AS pos_b FROM legs WHERE edge_a < edge_b", T.NEAR)
def draw_inner_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.near(spark, sf_dir)
    return drawing.inner_connections(g, ordering.default_order(g))


@query("""SELECT node_id, edge_a, edge_b, lines, (row_number() OVER (PARTITION BY node_id ORDER BY lines DESC, edge_a, edge_b) - 1)::BIGINT AS z FROM (SELECT node_id, edge_a, edge_b, count(*)::BIGINT AS lines FROM legs WHERE edge_a < edge_b GROUP BY ALL)""", T.NEAR)
def draw_inner_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.near(spark, sf_dir)
    return drawing.inner_cliques(g, ordering.default_order(g))


TILE = T.POINTS + """,
w AS (SELECT id, x1 * 1e7 AS x1, y1 * 1e7 AS y1, x2 * 1e7 AS x2, y2 * 1e7 AS y2, 40075016.685578488 / 32 AS wd FROM segs),
tl AS (SELECT *, floor((x1 + 20037508.342789244) / wd)::BIGINT AS tx, floor((20037508.342789244 - y1) / wd)::BIGINT AS ty FROM w),
tp AS (SELECT id, tx, ty, floor((x1 + 20037508.342789244 - tx * wd) / wd * 4096)::BIGINT AS a, floor((20037508.342789244 - y1 - ty * wd) / wd * 4096)::BIGINT AS b,
       floor((x2 + 20037508.342789244 - tx * wd) / wd * 4096)::BIGINT AS c, floor((20037508.342789244 - y2 - ty * wd) / wd * 4096)::BIGINT AS d FROM tl)"""


@query("""SELECT id, tx, ty, '9,' || CASE WHEN a < 0 THEN -2 * a - 1 ELSE 2 * a END || ',' || CASE WHEN b < 0 THEN -2 * b - 1 ELSE 2 * b END || ',10,' || CASE WHEN c - a < 0 THEN -2 * (c - a) - 1 ELSE 2 * (c - a) END || ',' || CASE WHEN d - b < 0 THEN -2 * (d - b) - 1 ELSE 2 * (d - b) END AS commands FROM tp""", TILE)
def draw_tile_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment as the command integers of a vector tile, in the tile of its first point."""
    s = T.segments(spark, sf_dir).select("id", *[(F.col(c) * 1e7).alias(c) for c in ("x1", "y1", "x2", "y2")])
    width = 2 * drawing.WORLD / 32
    s = s.withColumn("tx", F.floor((F.col("x1") + drawing.WORLD) / width)).withColumn("ty", F.floor((drawing.WORLD - F.col("y1")) / width))
    (a, b), (c, d) = (drawing.tile_points(F.col(f"x{i}"), F.col(f"y{i}"), 5, F.col("tx"), F.col("ty")) for i in (1, 2))
    commands = drawing.line_commands(F.array(a, c), F.array(b, d))
    return s.select("id", "tx", "ty", F.array_join(F.transform(commands, lambda v: v.cast("string")), ",").alias("commands"))


@query("""SELECT json_extract_string(value, '$.edges')::BIGINT AS edges, json_extract_string(value, '$.max_lines')::BIGINT AS max_lines FROM (SELECT json_object('edges', (SELECT count(*) FROM pe), 'max_lines', (SELECT max(n) FROM pe)) AS value)""",
T.NEAR + ", pe AS (SELECT edge_id, count(*) AS n FROM occs GROUP BY 1)")
def draw_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = drawing.statistics(T.near(spark, sf_dir))
    return s.select(F.get_json_object("value", "$.edges").cast("long").alias("edges"), F.get_json_object("value", "$.max_lines").cast("long").alias("max_lines"))


@query("SELECT round(min(rate), 6) AS least, round(max(rate), 6) AS most, round(avg(rate), 6) AS mean FROM (SELECT line_id, sum((f IS NOT NULL)::INT) / count(*) AS rate FROM (SELECT line_id, edge_id FROM near_all) LEFT JOIN (SELECT line_id, edge_id, 1 AS f FROM occs) USING (line_id, edge_id) GROUP BY 1)",
T.NEAR.replace("0.7 * ", "1.0 * "))
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import evaluate

    truth = aggregate.line_graph(T.city_nodes(spark, sf_dir), T.near_occurrences(spark, sf_dir))
    rates = evaluate.line_match(truth, T.near(spark, sf_dir, 1.0)).select((F.col("matched") / F.col("expected")).alias("rate"))
    return rates.agg(F.round(F.min("rate"), 6).alias("least"), F.round(F.max("rate"), 6).alias("most"), F.round(F.avg("rate"), 6).alias("mean"))


@query("SELECT node_id FROM nodes WHERE node_id IN (SELECT node_id FROM inc)", T.NEAR)
def graph_drop_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.drop_isolated(T.near(spark, sf_dir)).nodes.select("node_id")


# More of space, structure and drawing

APART = "sqrt(({px} - {ax} - coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax})^2 + ({by} - {ay})^2, 0))), 0) * ({bx} - {ax}))^2 + ({py} - {ay} - coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax})^2 + ({by} - {ay})^2, 0))), 0) * ({by} - {ay}))^2)"
FOUR = ", ".join(APART.format(px=f"x{p}", py=f"y{p}", ax=f"x{a}", ay=f"y{a}", bx=f"x{b}", by=f"y{b}") for p, a, b in ((1, 3, 4), (2, 3, 4), (3, 1, 2), (4, 1, 2)))


@query(f"""SELECT a, b, round(d, 6) AS d FROM (SELECT a, b, CASE WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN 0.0 ELSE least({FOUR}) END AS d FROM (SELECT *, ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / nullif(den, 0) AS t, ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / nullif(den, 0) AS u FROM (
SELECT p.id AS a, q.id AS b, (p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1) AS den, p.x1, p.y1, p.x2, p.y2, q.x1 AS x3, q.y1 AS y3, q.x2 AS x4, q.y2 AS y4 FROM segs p JOIN segs q ON p.id < q.id AND least(p.x1, p.x2) <= greatest(q.x1, q.x2) + 0.02 AND least(q.x1, q.x2) <= greatest(p.x1, p.x2) + 0.02))) WHERE d <= 0.01""", T.POINTS)
def spatial_segments_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.segments_within(T.segments(spark, sf_dir), 0.01, digits=6)


@query("""SELECT arg_min(id, (d, id)) AS id, gx, gy FROM (SELECT id, gx, gy, round(sqrt((gx * 0.05 - x)^2 + (gy * 0.05 - y)^2), 9) AS d FROM (
SELECT id, x, y, round(x / 0.05)::BIGINT + i AS gx, round(y / 0.05)::BIGINT + j AS gy FROM points, range(-2, 3) a(i), range(-2, 3) b(j))) WHERE d <= 0.1 GROUP BY gx, gy""", T.POINTS)
def schematic_split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schematic.split_candidates(schematic.grid_candidates(T.points(spark, sf_dir), 0.05, 2)).select("id", "gx", "gy")


CHAINED = T.NEAR + """,
mv AS (SELECT node_id, edge_id, least(ceil((degree - 4) / 2.0), (rank - 3) // 2 + 1)::BIGINT AS level FROM circ WHERE degree > 4 AND rank >= 3),
fin AS (SELECT e.edge_id, coalesce(-(a * 100 + p.level), a) AS p, coalesce(-(b * 100 + q.level), b) AS q, a, b FROM edges e LEFT JOIN mv p ON p.edge_id = e.edge_id AND p.node_id = a LEFT JOIN mv q ON q.edge_id = e.edge_id AND q.node_id = b),
trk AS (SELECT edge_id, CASE WHEN l = 1 THEN node_id ELSE -(node_id * 100 + l - 1) END AS u, -(node_id * 100 + l) AS v FROM (SELECT *, unnest(range(1, level + 1)) AS l FROM mv))"""


@query("""SELECT least(p, q) || '-' || greatest(p, q) AS edge_id, line_id, CASE WHEN direction = fin.a THEN p WHEN direction = fin.b THEN q END::VARCHAR AS direction, n FROM fin JOIN occs USING (edge_id)
UNION ALL SELECT least(u, v) || '-' || greatest(u, v), line_id, NULL, sum(n)::BIGINT FROM trk JOIN occs USING (edge_id) GROUP BY u, v, line_id""", CHAINED)
def graph_split_high_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on the edges of a graph whose nodes have at most four edges."""
    g = structure.split_high_degree(T.near(spark, sf_dir), 4, name=lambda node, level: -(node * 100 + level).cast("long"))
    return g.occs.select("edge_id", "line_id", F.col("direction").cast("string").alias("direction"), "n")


@query("""SELECT node_id, arg_min(edge_id, (d, edge_id)) AS edge_id, round(arg_min(pos, (d, edge_id)), 6) AS share FROM (SELECT *, sqrt((x - x1 - pos * (x2 - x1))^2 + (y - y1 - pos * (y2 - y1))^2) AS d FROM (
SELECT n.node_id, n.x, n.y, edge_id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((n.x - p.x) * (q.x - p.x) + (n.y - p.y) * (q.y - p.y)) / ((q.x - p.x)^2 + (q.y - p.y)^2))) AS pos
FROM nodes n, edges JOIN nodes p ON p.node_id = a JOIN nodes q ON q.node_id = b WHERE n.node_id NOT IN (SELECT node_id FROM inc))) WHERE d <= 1.5 GROUP BY 1""", T.SPARSE.replace("1.0 * ", "1.5 * "))
def graph_snap_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that only rare edges touch, on the graph without these."""
    occs = aggregate.occurrences(T.city_hops(spark, sf_dir).withColumn("line_id", F.lit("all")))
    g = aggregate.line_graph(T.city_nodes(spark, sf_dir), T.cut(aggregate.prune_rare(occs, 1.5)))
    return structure.snap_orphans(g, 1.5).select("node_id", "edge_id", F.round("share", 6).alias("share"))


SNAPPED = T.SPARSE.replace("1.0 * ", "1.5 * ") + """,
snap AS (SELECT node_id, arg_min(edge_id, (d, edge_id)) AS edge_id, round(arg_min(pos, (d, edge_id)), 6) AS share FROM (SELECT *, sqrt((x - x1 - pos * (x2 - x1))^2 + (y - y1 - pos * (y2 - y1))^2) AS d FROM (
SELECT n.node_id, n.x, n.y, edge_id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((n.x - p.x) * (q.x - p.x) + (n.y - p.y) * (q.y - p.y)) / ((q.x - p.x)^2 + (q.y - p.y)^2))) AS pos
FROM nodes n, edges JOIN nodes p ON p.node_id = a JOIN nodes q ON q.node_id = b WHERE n.node_id NOT IN (SELECT node_id FROM inc))) WHERE d <= 1.5 GROUP BY 1),
stop AS (SELECT edge_id, a AS node_id, 0 AS k, 0.0::DOUBLE AS share FROM edges UNION ALL SELECT edge_id, node_id, 1, share FROM snap WHERE share > 0 AND share < 1 UNION ALL SELECT edge_id, b, 2, 1.0 FROM edges),
hop AS (SELECT edge_id, node_id AS u, lead(node_id) OVER (PARTITION BY edge_id ORDER BY k, share, node_id) AS v FROM stop)"""


@query("SELECT least(u, v) || '-' || greatest(u, v) AS edge_id FROM hop WHERE v IS NOT NULL", SNAPPED)
def graph_attach_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after the nodes that only rare edges touch were put on the nearest of the others."""
    occs = cut(aggregate.prune_rare(aggregate.occurrences(T.city_hops(spark, sf_dir).withColumn("line_id", F.lit("all"))), 1.5))
    return structure.attach_orphans(aggregate.line_graph(T.city_nodes(spark, sf_dir), occs), 1.5).edges.select("edge_id")


@query()
def graph_contract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges shorter than a diagonal, away from stations, contracted on the thin graph; tested against one at a time.

    All nodes but two in seven are stations.
    """
    stops = T.city_nodes(spark, sf_dir).where("node_id % 7 > 1").select("node_id", F.col("node_id").cast("string").alias("name"))
    g = structure.contract_edges(T.thin(spark, sf_dir), 1.2, stops, only_free=True, step=0.5)
    return g.occs.select("edge_id", "line_id", F.col("direction").cast("string").alias("direction"), "n")


@query("SELECT count(*)::BIGINT AS edges, round(sum(d), 6) AS total, round(max(d), 6) AS longest, round(avg(n), 6) AS mean_lines, max(n)::BIGINT AS max_lines FROM (SELECT sqrt((p.x - q.x)^2 + (p.y - q.y)^2) AS d, n FROM edges JOIN nodes p ON p.node_id = a JOIN nodes q ON q.node_id = b JOIN (SELECT edge_id, count(*) AS n FROM occs GROUP BY 1) USING (edge_id))", T.NEAR)
def agg_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.lengths(T.near(spark, sf_dir))


@query("SELECT inc.node_id, edge_id, round(degrees(atan2(m.y - k.y, m.x - k.x)), 6) AS angle FROM inc JOIN nodes k ON k.node_id = inc.node_id JOIN nodes m ON m.node_id = inc.other", T.NEAR)
def draw_out_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing.out_angles(T.near(spark, sf_dir)).select("node_id", "edge_id", F.round("angle", 6).alias("angle"))


@query("""SELECT node_id, edge_a, edge_b, (row_number() OVER (PARTITION BY node_id, edge_a, edge_b ORDER BY pos_a) - 1)::BIGINT AS clique, lines, pos_a, pos_b, reference,
(row_number() OVER (PARTITION BY node_id ORDER BY lines DESC, edge_a, edge_b, pos_a) - 1)::BIGINT AS z FROM clq""", T.NEAR + """,
stk AS (SELECT node_id, line_id, edge_a, edge_b, sa, sb FROM legs WHERE edge_a < edge_b),
tops AS (SELECT * FROM stk p WHERE NOT EXISTS (SELECT 1 FROM stk q WHERE q.node_id = p.node_id AND q.edge_a = p.edge_a AND q.edge_b = p.edge_b AND q.sa = p.sa - 1 AND q.sb = p.sb + 1)),
grow(node_id, edge_a, edge_b, sa, sb, k) AS (SELECT node_id, edge_a, edge_b, sa, sb, 1::BIGINT FROM tops UNION ALL SELECT w.node_id, w.edge_a, w.edge_b, w.sa, w.sb, w.k + 1 FROM grow w JOIN stk q ON q.node_id = w.node_id AND q.edge_a = w.edge_a AND q.edge_b = w.edge_b AND q.sa = w.sa + w.k AND q.sb = w.sb - w.k),
clq AS (SELECT g.node_id, g.edge_a, g.edge_b, g.sa AS pos_a, g.sb AS pos_b, max(k) AS lines, any_value(t.line_id) AS reference FROM grow g JOIN tops t ON t.node_id = g.node_id AND t.edge_a = g.edge_a AND t.edge_b = g.edge_b AND t.sa = g.sa AND t.sb = g.sb GROUP BY ALL)""")  # fmt: skip
def draw_adjacent_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.near(spark, sf_dir)
    return drawing.adjacent_cliques(g, ordering.default_order(g))


FRONTS = T.NEAR + """,
fr AS (SELECT node_id, x0 + t * ux + uy * total / 2 AS x1, y0 + t * uy - ux * total / 2 AS y1, x0 + t * ux - uy * total / 2 AS x2, y0 + t * uy + ux * total / 2 AS y2 FROM (
SELECT inc.node_id, edge_id, k.x AS x0, k.y AS y0, least(0.3, len / 2) AS t, (m.x - k.x) / len AS ux, (m.y - k.y) / len AS uy, lines * 0.03 - 0.01 AS total
FROM inc JOIN nodes k ON k.node_id = inc.node_id JOIN nodes m ON m.node_id = inc.other JOIN (SELECT edge_id, count(*)::DOUBLE AS lines FROM occs GROUP BY 1) USING (edge_id), LATERAL (SELECT sqrt((m.x - k.x)^2 + (m.y - k.y)^2) AS len))),
bx AS (SELECT node_id, min(least(x1, x2)) - 0.21 AS x1, min(least(y1, y2)) - 0.21 AS y1, max(greatest(x1, x2)) + 0.21 AS x2, max(greatest(y1, y2)) + 0.21 AS y2 FROM fr GROUP BY 1)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.near(spark, sf_dir)
    return drawing.stop_boxes(drawing.node_fronts(g, drawing.edge_widths(g, 0.02, 0.01), 0.3), 0.21)


@query("SELECT node_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM bx", FRONTS)
def draw_stop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("node_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _rounds(n: int) -> str:
    """The rounds in which boxes stay and go, each as tables of what is open and what stays."""
    out = """,
k AS (SELECT *, (node_id * 7919) % 100003 AS key FROM bx),
hit AS MATERIALIZED (SELECT p.node_id AS a, q.node_id AS b, (p.key, p.node_id) < (q.key, q.node_id) AS before FROM k p JOIN k q ON p.node_id <> q.node_id AND p.x1 <= q.x2 AND q.x1 <= p.x2 AND p.y1 <= q.y2 AND q.y1 <= p.y2),
u0 AS MATERIALIZED (SELECT node_id FROM k)"""
    for i in range(n):
        out += f""",
s{i} AS MATERIALIZED (SELECT node_id FROM u{i} WHERE NOT EXISTS (SELECT 1 FROM hit JOIN u{i} o ON o.node_id = hit.a WHERE hit.b = u{i}.node_id AND before)),
u{i + 1} AS MATERIALIZED (SELECT node_id FROM u{i} WHERE node_id NOT IN (SELECT node_id FROM s{i}) AND node_id NOT IN (SELECT hit.b FROM hit JOIN s{i} ON s{i}.node_id = hit.a))"""
    return out


@query(" UNION ALL ".join(f"SELECT node_id FROM s{i}" for i in range(24)), FRONTS + _rounds(24))
def draw_drop_overlapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of nodes taken in a mixed order; one that overlaps a box taken before goes."""
    return drawing.drop_overlapped(boxes(spark, sf_dir), 1.0, F.col("node_id") * 7919 % 100003).select("node_id")


@query("""SELECT node_id, turn, count(e.edge_id)::BIGINT AS crossed FROM (SELECT node_id, turn, x AS x1, y AS y1, x + 1.3 * cos(radians(turn * 45.0 + 10)) AS x2, y + 1.3 * sin(radians(turn * 45.0 + 10)) AS y2 FROM stations JOIN nodes USING (node_id), range(0, 8) r(turn)) b
LEFT JOIN (SELECT edge_id, p.x AS x3, p.y AS y3, q.x AS x4, q.y AS y4 FROM edges JOIN nodes p ON p.node_id = a JOIN nodes q ON q.node_id = b) e
ON ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / nullif((x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3), 0) > 0.0001 AND ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / nullif((x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3), 0) < 0.9999
AND ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / nullif((x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3), 0) > 0.0001 AND ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / nullif((x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3), 0) < 0.9999
GROUP BY ALL""", T.NEAR)
def draw_label_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.near(spark, sf_dir)
    return drawing.label_penalties(g, drawing.label_bands(g, T.stations(spark, sf_dir), 1.3, 10.0), 1.0)
