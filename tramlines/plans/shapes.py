"""Registered queries of chains, courses, hulls and grids over points, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains, courses, geometry, hulls, sparse_grids, tiles
from . import tables as T
from .catalog import query
from .network import PATHS

# Chains of nodes with two edges

CHAINS = T.THIN + """,
half AS (SELECT edge_id || '>' AS id, edge_id, a AS u, b AS v FROM edges UNION ALL SELECT edge_id || '<', edge_id, b, a FROM edges),
two AS (SELECT node_id FROM deg WHERE degree = 2),
nxt AS (SELECT h.id, h.v AS name, k.id AS next FROM half h JOIN two ON two.node_id = h.v JOIN half k ON k.u = h.v AND k.edge_id <> h.edge_id),
wk(start, cur, names) AS (SELECT id, id, []::BIGINT[] FROM half WHERE u NOT IN (SELECT node_id FROM two) UNION ALL SELECT start, next, list_append(names, name) FROM wk JOIN nxt ON nxt.id = wk.cur),
rg(start, cur, names) AS (SELECT id, id, []::BIGINT[] FROM half WHERE id NOT IN (SELECT cur FROM wk) UNION ALL SELECT start, next, list_append(names, name) FROM rg JOIN nxt ON nxt.id = rg.cur WHERE next <> start),
ring AS (SELECT list_reverse_sort(list_append(names, name)) AS top FROM rg JOIN nxt ON nxt.id = rg.cur WHERE next = start),
ch AS (SELECT least(s.u, e.v) AS c, greatest(s.u, e.v) AS d, s.edge_id AS first, list_reverse_sort(names) AS top FROM wk JOIN half s ON s.id = wk.start JOIN half e ON e.id = wk.cur
       WHERE wk.cur NOT IN (SELECT id FROM nxt) AND (s.edge_id < e.edge_id OR (s.edge_id = e.edge_id AND s.u < e.v))),
kept AS (SELECT top[1] AS node_id FROM (SELECT top, row_number() OVER (PARTITION BY c, d ORDER BY least(len(top), 1), top[1], first) AS i FROM ch WHERE c <> d) WHERE i > 1
         UNION SELECT unnest(top[1:2]) FROM ch WHERE c = d UNION SELECT unnest(top[1:3]) FROM ring),
nx2 AS (SELECT * FROM nxt WHERE name NOT IN (SELECT node_id FROM kept)),
w2(start, cur, rank) AS (SELECT id, id, 0::BIGINT FROM half WHERE u NOT IN (SELECT name FROM nx2) UNION ALL SELECT start, next, rank + 1 FROM w2 JOIN nx2 ON nx2.id = w2.cur),
whole AS (SELECT start, s.u AS p, e.v AS q, rank + 1 AS pieces FROM w2 JOIN half s ON s.id = w2.start JOIN half e ON e.id = w2.cur WHERE w2.cur NOT IN (SELECT id FROM nx2) AND s.u < e.v),
pc AS (SELECT c.edge_id AS piece, p || '-' || q AS edge_id, p, q, rank, c.u AS node_id, c.u < c.v AS forward, pieces FROM w2 JOIN whole USING (start) JOIN half c ON c.id = w2.cur)"""


@query("SELECT piece, edge_id, rank, forward, pieces FROM pc", CHAINS)
def chain_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former edges of every combined edge, in order."""
    return chains.combine_degree_two(T.thin(spark, sf_dir)).pieces.select("piece", "edge_id", "rank", "forward", "pieces")


@query("SELECT pc.edge_id, p AS a, q AS b, pieces, max(lines)::BIGINT AS max_lines FROM pc JOIN (SELECT edge_id, count(*) AS lines FROM occs GROUP BY 1) o ON o.edge_id = pc.piece GROUP BY ALL", CHAINS)
def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.combine_degree_two(T.thin(spark, sf_dir)).edges.select("edge_id", "a", "b", "pieces", "max_lines")


@query("""SELECT n.node_id, round(coalesce(CASE WHEN s <= w THEN ax + sign(bx - ax) * s ELSE bx END, n.x), 6) AS x, round(coalesce(CASE WHEN s <= w THEN ay ELSE ay + sign(by_ - ay) * (s - w) END, n.y), 6) AS y
FROM nodes n LEFT JOIN (SELECT pc.node_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, abs(b.x - a.x) AS w, (abs(b.x - a.x) + abs(b.y - a.y)) * rank / pieces AS s
FROM pc JOIN nodes a ON a.node_id = p JOIN nodes b ON b.node_id = q WHERE rank > 0) USING (node_id) WHERE n.node_id IN (SELECT node_id FROM inc)""", CHAINS)
def chain_reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined edges drawn along x and then along y, and all nodes put back on them."""
    g = T.thin(spark, sf_dir)
    c = chains.combine_degree_two(g)
    at = lambda n: g.nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    drawn = c.edges.join(at("a"), "a").join(at("b"), "b")
    bent = F.array(geometry.point(F.col("xa"), F.col("ya")), geometry.point(F.col("xb"), F.col("ya")), geometry.point(F.col("xb"), F.col("yb")))
    placed = chains.reinsert(g, c, drawn.select("edge_id", bent.alias("geom"))).nodes
    used = g.incidence().select("node_id").distinct()
    return placed.join(used, "node_id", "left_semi").select("node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Geometries of one edge

COURSES = """
v AS (SELECT vec_id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y1, embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS y2, label::BIGINT + 1 AS weight, vec_id // 3 AS edge FROM embeddings),
l AS (SELECT *, sqrt((x2 - x1)^2 + (y2 - y1)^2) AS len, max(sqrt((x2 - x1)^2 + (y2 - y1)^2)) OVER (PARTITION BY edge) AS longest FROM v),
g AS (SELECT edge, sum(weight) AS w, sum(weight * x1) / sum(weight) AS ax, sum(weight * y1) / sum(weight) AS ay, sum(weight * x2) / sum(weight) AS bx, sum(weight * y2) / sum(weight) AS by_ FROM l GROUP BY edge)"""


@query("""SELECT edge AS edge_id, round(ax, 6) AS x1, round(ay, 6) AS y1, round(bx, 6) AS x2, round(by_, 6) AS y2 FROM g""", COURSES)
def course_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted mean of three straight courses at a time, which is straight again; its ends."""
    v = T.read(spark, sf_dir, "embeddings")
    at = lambda i: geometry.point(F.col("embedding")[2 * i].cast("double"), F.col("embedding")[2 * i + 1].cast("double"))
    rows = v.select(F.floor(F.col("vec_id") / 3).alias("edge_id"), F.array(at(0), at(1)).alias("geom"), (F.col("label") + 1).cast("double").alias("weight"))
    p = courses.average(rows, 0.05)
    first, last = F.get("geom", F.lit(0)), F.element_at("geom", -1)
    return p.select("edge_id", *[F.round(e[c], 6).alias(f"{c}{i}") for i, e in ((1, first), (2, last)) for c in "xy"])


# Straight courses: all vertices are ends, and the distance of a point to a segment decides.
APART = "sqrt(({p}x - {q}x1 - {t} * ({q}x2 - {q}x1))^2 + ({p}y - {q}y1 - {t} * ({q}y2 - {q}y1))^2)"
SHARE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({p}x - {q}x1) * ({q}x2 - {q}x1) + ({p}y - {q}y1) * ({q}y2 - {q}y1)) / {q}len^2))"


def _apart(point: tuple[str, str], q: str) -> str:
    t = SHARE.replace("{p}x", point[0]).replace("{p}y", point[1]).replace("{q}", q)
    return APART.replace("{p}x", point[0]).replace("{p}y", point[1]).replace("{q}", q).replace("{t}", t)


def _holds(a: str, b: str) -> str:
    """Whether course a has both ends of course b within 0.3."""
    return " AND ".join(f"{_apart((f'{b}x{i}', f'{b}y{i}'), a)} <= 0.3" for i in (1, 2))


HELD = COURSES + f""",
h AS (SELECT q.edge, q.vec_id AS small, p.vec_id AS big, p.len FROM l p JOIN l q ON p.edge = q.edge AND p.len > q.len WHERE {_holds('p.', 'q.')} AND NOT ({_holds('q.', 'p.')})),
top AS (SELECT edge, arg_max(vec_id, (len, vec_id::VARCHAR)) AS top FROM l GROUP BY 1),
goal AS (SELECT h.edge, small, coalesce(arg_max(big, (len, big::VARCHAR)) FILTER (big NOT IN (SELECT small FROM h)), any_value(top)) AS goal FROM h JOIN top ON top.edge = h.edge GROUP BY ALL)"""


@query("SELECT coalesce(goal, vec_id)::VARCHAR AS course, l.edge AS edge_id, sum(weight)::DOUBLE AS weight FROM l LEFT JOIN goal ON goal.edge = l.edge AND small = vec_id GROUP BY ALL", HELD)
def course_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three straight courses at a time stay, and the weight they come to."""
    v = T.read(spark, sf_dir, "embeddings")
    at = lambda i: geometry.point(F.col("embedding")[2 * i].cast("double"), F.col("embedding")[2 * i + 1].cast("double"))
    rows = v.select(F.floor(F.col("vec_id") / 3).alias("edge_id"), F.col("vec_id").cast("string").alias("course"), F.array(at(0), at(1)).alias("geom"), (F.col("label") + 1).cast("double").alias("weight"))
    return courses.absorb(rows, 0.3).select("course", "edge_id", "weight")


# Hulls of the nodes of each zone

HULLS = T.CITY + """,
side AS (SELECT p.zone, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM nodes p JOIN nodes q ON p.zone = q.zone AND (p.x <> q.x OR p.y <> q.y)
         WHERE NOT EXISTS (SELECT 1 FROM nodes o WHERE o.zone = p.zone AND ((q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) < 0
           OR ((q.x - p.x) * (o.y - p.y) = (q.y - p.y) * (o.x - p.x) AND ((o.x - p.x) * (q.x - o.x) < 0 OR (o.y - p.y) * (q.y - o.y) < 0))))),
corner AS (SELECT zone, ax AS x, ay AS y FROM side UNION SELECT zone, bx, by_ FROM side),
bnd AS (SELECT zone, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM nodes GROUP BY 1),
spot AS (SELECT zone, gx, gy, x0 + gx AS x, y0 + gy AS y FROM (SELECT *, unnest(range((y1 - y0)::BIGINT + 1)) AS gy FROM (SELECT *, unnest(range((x1 - x0)::BIGINT + 1)) AS gx FROM bnd))),
pin AS (SELECT zone, gx, gy FROM spot WHERE (SELECT count(*) FROM corner c WHERE c.zone = spot.zone) > 2
        AND NOT EXISTS (SELECT 1 FROM side s WHERE s.zone = spot.zone AND (bx - ax) * (spot.y - ay) < (by_ - ay) * (spot.x - ax)))"""


@query("SELECT zone, x, y FROM corner", HULLS)
def hull_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hulls.convex_hulls(T.city_nodes(spark, sf_dir), "zone")
    return found.select("zone", F.explode("hull").alias("p")).select("zone", "p.x", "p.y")


@query("""SELECT p.zone, p.gx, p.gy, dir::BIGINT AS dir, q.gx AS to_gx, q.gy AS to_gy FROM pin p JOIN (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)) m(dir, dx, dy) ON true
JOIN pin q ON q.zone = p.zone AND q.gx = p.gx + dx AND q.gy = p.gy + dy""", HULLS)
def hull_octilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the eight-way grids in the hulls of the zones' nodes."""
    return hulls.hull_grid(T.city_nodes(spark, sf_dir), "zone", 1.0)[1]


# Sparse grids of each zone's nodes, whose coordinates are whole

SPOTS = T.CITY + """,
bnd AS (SELECT zone, min(x)::BIGINT AS x0, min(y)::BIGINT AS y0, (max(x) - min(x))::BIGINT AS w, (max(y) - min(y))::BIGINT AS h FROM nodes GROUP BY 1),
seed AS (SELECT zone, x::BIGINT - x0 AS x, y::BIGINT - y0 AS y FROM nodes JOIN bnd USING (zone)),
spot AS (SELECT zone, x, y FROM (SELECT *, unnest(range(h + 1)) AS y FROM (SELECT *, unnest(range(w + 1)) AS x FROM bnd)))"""


def _round(before: str, after: str) -> str:
    """Points of `before` become lines, and the spots on two of them the points of `after`."""
    n = after
    return f""",
{n}0 AS (SELECT DISTINCT zone, y AS k FROM {before}), {n}1 AS (SELECT DISTINCT zone, x AS k FROM {before}), {n}2 AS (SELECT DISTINCT zone, x - y AS k FROM {before}), {n}3 AS (SELECT DISTINCT zone, x + y AS k FROM {before}),
{n} AS (SELECT s.zone, x, y, a.k IS NOT NULL AS f0, b.k IS NOT NULL AS f1, c.k IS NOT NULL AS f2, d.k IS NOT NULL AS f3 FROM spot s LEFT JOIN {n}0 a ON a.zone = s.zone AND a.k = y LEFT JOIN {n}1 b ON b.zone = s.zone AND b.k = x
  LEFT JOIN {n}2 c ON c.zone = s.zone AND c.k = x - y LEFT JOIN {n}3 d ON d.zone = s.zone AND d.k = x + y
  WHERE (a.k IS NOT NULL)::INT + (b.k IS NOT NULL)::INT + (c.k IS NOT NULL)::INT + (d.k IS NOT NULL)::INT > 1)"""


def _ways(points: str) -> str:
    one = lambda f, d, at: f"SELECT zone, x AS gx, y AS gy, {d}::BIGINT AS dir, lead(x) OVER w AS to_gx, lead(y) OVER w AS to_gy FROM {points} WHERE {f} WINDOW w AS (PARTITION BY zone, {at} ORDER BY x, y)"
    parts = [one("f0", 2, "y"), one("f1", 0, "x"), one("f2", 1, "x - y"), one("f3", 3, "x + y")]
    return f"SELECT *, greatest(to_gx - gx, abs(to_gy - gy)) AS hops FROM ({' UNION ALL '.join(parts)}) WHERE to_gx IS NOT NULL"


@query("SELECT zone, x AS gx, y AS gy FROM one", SPOTS + _round("seed", "one"))
def hanan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_grids.hanan(T.city_nodes(spark, sf_dir), "zone", 1.0)[0]


@query(_ways("two"), SPOTS + _round("seed", "one") + _round("one", "two"))
def hanan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the grids after two rounds."""
    return sparse_grids.hanan(T.city_nodes(spark, sf_dir), "zone", 1.0, 2)[1]


@query("""SELECT p.zone, p.gx, p.gy, p.to_gx, p.to_gy, q.gx AS other_gx, q.gy AS other_gy, q.to_gx AS other_to_gx, q.to_gy AS other_to_gy FROM way p JOIN way q ON p.zone = q.zone AND p.dir = 1 AND q.dir = 3
AND (p.gx - p.gy + q.gx + q.gy) % 2 <> 0 AND (p.gx - p.gy + q.gx + q.gy) / 2.0 BETWEEN greatest(p.gx, q.gx) AND least(p.to_gx, q.to_gx)""", SPOTS + _round("seed", "one") + f", way AS ({_ways('one')})")
def hanan_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_grids.diagonal_crossings(sparse_grids.hanan(T.city_nodes(spark, sf_dir), "zone", 1.0)[1], "zone")


QUADS = SPOTS + """,
root AS (SELECT zone, ceil(log2(greatest(1, w, h)))::BIGINT AS depth FROM bnd),
lvl AS (SELECT zone, depth, unnest(range(depth)) AS level FROM root),
cnt AS (SELECT l.zone, l.depth, level, least((1 << depth) - 1, x) >> (depth - level) AS qx, least((1 << depth) - 1, y) >> (depth - level) AS qy FROM lvl l JOIN seed USING (zone) GROUP BY ALL HAVING count(*) > 1),
sub AS (SELECT zone, depth, level + 1 AS level, 2 * qx + i AS qx, 2 * qy + j AS qy FROM cnt, range(2) a(i), range(2) b(j) UNION ALL SELECT zone, depth, 0, 0, 0 FROM root),
leaf AS (SELECT zone, level::BIGINT AS level, (qx << (depth - level))::BIGINT AS gx, (qy << (depth - level))::BIGINT AS gy, (1 << (depth - level))::BIGINT AS side FROM sub
         WHERE NOT EXISTS (SELECT 1 FROM cnt c WHERE c.zone = sub.zone AND c.level = sub.level AND c.qx = sub.qx AND c.qy = sub.qy))"""


@query("SELECT zone, level, gx, gy, side FROM leaf", QUADS)
def quadtree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of at most one node."""
    return sparse_grids.quadtree(T.city_nodes(spark, sf_dir), "zone", 1.0, 1)


@query("""SELECT zone, gx, gy, dir::BIGINT AS dir, gx + min(side) * any_value(ux) AS to_gx, gy + min(side) * any_value(uy) AS to_gy, min(side) AS hops FROM (
SELECT zone, gx + px * side AS gx, gy + py * side AS gy, dir, side, ux, uy FROM leaf, (VALUES (1, 0, 0, 1, 1), (3, 0, 1, 1, -1), (2, 0, 0, 1, 0), (2, 0, 1, 1, 0), (0, 0, 0, 0, 1), (0, 1, 0, 0, 1)) e(dir, px, py, ux, uy)) GROUP BY zone, gx, gy, dir""", QUADS)
def quadtree_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_grids.quadtree_edges(sparse_grids.quadtree(T.city_nodes(spark, sf_dir), "zone", 1.0, 1), "zone")


# Tiles of polylines of four points, a unit being ten thousand kilometres

TILES = PATHS + """,
seg AS (SELECT id, i, CASE i WHEN 0 THEN x1 WHEN 1 THEN x2 ELSE x3 END * 1e7 AS x1, CASE i WHEN 0 THEN y1 WHEN 1 THEN y2 ELSE y3 END * 1e7 AS y1, CASE i WHEN 0 THEN x2 WHEN 1 THEN x3 ELSE x4 END * 1e7 AS x2, CASE i WHEN 0 THEN y2 WHEN 1 THEN y3 ELSE y4 END * 1e7 AS y2 FROM v, range(0, 3) r(i)),
zoom AS (SELECT z, 20037508.342789244 AS h, 2 * 20037508.342789244 / (1 << z) AS w, 2 * 20037508.342789244 / (1 << z) * 50 / 1024 AS m FROM (VALUES (3), (6)) t(z)),
col AS (SELECT *, unnest(range(greatest(0, floor((least(x1, x2) - m + h) / w))::BIGINT, least((1 << z) - 1, floor((greatest(x1, x2) + m + h) / w))::BIGINT + 1)) AS tx FROM seg, zoom),
cel AS (SELECT *, unnest(range(greatest(0, floor((least(y1, y2) - m + h) / w))::BIGINT, least((1 << z) - 1, floor((greatest(y1, y2) + m + h) / w))::BIGINT + 1)) AS sy FROM col),
bxd AS (SELECT *, tx * w - h - m AS p1, (tx + 1) * w - h + m AS p2, sy * w - h - m AS q1, (sy + 1) * w - h + m AS q2 FROM cel),
cut_ AS (SELECT *, [(x2 - x1) * (q1 - y1) - (y2 - y1) * (p1 - x1), (x2 - x1) * (q2 - y1) - (y2 - y1) * (p1 - x1), (x2 - x1) * (q1 - y1) - (y2 - y1) * (p2 - x1), (x2 - x1) * (q2 - y1) - (y2 - y1) * (p2 - x1)] AS s FROM bxd
         WHERE greatest(x1, x2) >= p1 AND least(x1, x2) <= p2 AND greatest(y1, y2) >= q1 AND least(y1, y2) <= q2),
isl AS (SELECT z, tx, (1 << z) - 1 - sy AS ty, id, i, i - row_number() OVER (PARTITION BY z, tx, sy, id ORDER BY i) AS k FROM cut_ WHERE NOT (list_min(s) > 0 OR list_max(s) < 0))"""


@query("SELECT z::INT AS z, tx, ty::BIGINT AS ty, id, (row_number() OVER (PARTITION BY z, tx, ty, id ORDER BY k) - 1)::BIGINT AS part, n FROM (SELECT z, tx, ty, id, k, count(*)::BIGINT + 1 AS n FROM isl GROUP BY ALL)", TILES)
def tile_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points the parts of each line have in each tile, on two zooms."""
    at = lambda i: geometry.point(F.col("embedding")[2 * i].cast("double") * 1e7, F.col("embedding")[2 * i + 1].cast("double") * 1e7)
    lines = T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[at(i) for i in range(4)]).alias("geom"))
    return tiles.tiled(lines, [3, 6]).select("z", "tx", "ty", "id", "part", F.size("points").cast("long").alias("n"))
