"""Operators, sources and queries of the line graph library."""

import functools
import itertools
import math
import random
import re
from urllib.parse import unquote

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramlines import functions as fx
from tramlines.model import LineGraph
from tramlines.operators import aggregate, algebra, evaluate, ordering, schematic, spatial, structure
from tramlines.plans import catalog, tables
from tramlines.sources import dot, geojson, gtfs, svg
from tramlines.streaming.hops import windowed_occurrences

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def graph(spark, nodes, lines, exceptions=()):
    """nodes: {id: (x, y)}; lines: {line: [(a, b, direction or None), ...]}."""
    n = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in nodes.items()], "node_id string, x double, y double")
    occ = [("-".join(sorted((a, b))), *sorted((a, b)), line, d, 1) for line, es in lines.items() for a, b, d in es]
    o = spark.createDataFrame(occ, "edge_id string, a string, b string, line_id string, direction string, n long")
    g = aggregate.line_graph(n, o)
    both = [x for n_, line, p, q in exceptions for x in ((n_, line, p, q), (n_, line, q, p))]
    return g.with_(exceptions=spark.createDataFrame(both, "node_id string, line_id string, edge_a string, edge_b string")) if both else g


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


CROSS = {"a": (0, 1), "b": (1, 0), "c": (0, -1), "d": (-1, 0), "m": (0, 0)}


def test_direction_lattice(spark):
    hops = spark.createDataFrame([("a", "b", "1"), ("a", "b", "1"), ("b", "a", "2"), ("a", "b", "2"), ("c", "b", "3"), ("c", "c", "3")], "from_node string, to_node string, line_id string")
    assert rows(aggregate.occurrences(hops), "edge_id", "line_id", "direction", "n") == [("a-b", "1", "b", 2), ("a-b", "2", None, 2), ("b-c", "3", "b", 1)]


def test_trip_hops_skip_repeated_stops(spark):
    t = spark.createDataFrame([("t", 1, "a"), ("t", 2, "a"), ("t", 3, "b"), ("t", 4, "a"), ("u", 1, "z")], "trip_id string, seq long, stop string")
    hops = aggregate.trip_hops(t, "trip_id", "stop", ["seq"])
    assert rows(hops, "from_node", "to_node") == [("a", "b"), ("b", "a")]
    assert rows(aggregate.occurring_turns(hops)) == [("b", "a-b", "a-b", 1)]


def test_connections_termini_and_exceptions(spark):
    lines = {"1": [("a", "m", None), ("m", "c", None)], "2": [("a", "m", "m"), ("m", "b", "m")], "3": [("a", "m", None), ("m", "d", None)]}
    g = graph(spark, CROSS, lines, [("m", "3", "a-m", "d-m")])
    assert rows(algebra.continuations(g)) == [("m", "1", "a-m", "c-m"), ("m", "1", "c-m", "a-m")]
    ends = rows(algebra.termini(g))
    assert ("m", "2", "a-m") in ends and ("m", "3", "d-m") in ends and ("m", "1", "a-m") not in ends
    assert rows(algebra.exception_count(g.exceptions)) == [("m", 1)]
    assert rows(algebra.degrees(g), "node_id", "degree", "line_degree")[-1] == ("m", 4, 6)
    c = algebra.counts(g).first()
    assert (c.edges, c.nodes, c.lines, c.max_lines, c.max_degree) == (4, 5, 3, 3, 4) and c.log10_orders == round(math.log10(6), 6)


def test_circular_order_starts_at_twelve(spark):
    g = graph(spark, CROSS, {"1": [("a", "m", None), ("m", "b", None), ("m", "c", None), ("m", "d", None)]})
    assert [e for _, e in sorted((r.rank, r.edge_id) for r in ordering.circular_order(g).where("node_id = 'm'").collect())] == ["a-m", "b-m", "c-m", "d-m"]
    assert {(r.edge_a, r.edge_b): r.steps for r in ordering.circular_distance(g).collect()}["d-m", "b-m"] == 2


def order_of(spark, spec):
    return spark.createDataFrame([(e, line, i, len(ls)) for e, ls in spec.items() for i, line in enumerate(ls)], "edge_id string, line_id string, pos long, lines long")


def test_crossings_of_a_straight_pair(spark):
    g = graph(spark, {"a": (0, 0), "b": (1, 0), "c": (2, 0)}, {x: [("a", "b", None), ("b", "c", None)] for x in "123"})
    good = order_of(spark, {"a-b": "123", "b-c": "123"})
    bad = order_of(spark, {"a-b": "123", "b-c": "321"})
    assert rows(ordering.same_crossings(g, good)) == [] and rows(ordering.same_crossings(g, bad)) == [("b", 3)]
    apart = order_of(spark, {"a-b": "132", "b-c": "123"})
    assert rows(ordering.same_crossings(g, apart)) == [("b", 1)] and rows(ordering.separations(g, apart)) == [("b", 2)]
    assert ordering.total(g, good) == 0


def test_crossings_of_a_fork(spark):
    nodes = {"a": (0, 0), "b": (1, 0), "c": (2, 1), "d": (2, -1)}
    g = graph(spark, nodes, {"1": [("a", "b", None), ("b", "c", None)], "2": [("a", "b", None), ("b", "d", None)]})
    scores = {o: ordering.total(g, order_of(spark, {"a-b": o, "b-c": "1", "b-d": "2"})) for o in ("12", "21")}
    assert sorted(scores.values()) == [0.0, 3.0]


def test_improve_never_worse_and_finds_the_fork(spark):
    g = graph(spark, {"a": (0, 0), "b": (1, 0), "c": (2, 0), "d": (3, 0)}, {x: [("a", "b", None), ("b", "c", None), ("c", "d", None)] for x in "1234"})
    start = order_of(spark, {"a-b": "1234", "b-c": "4231", "c-d": "1234"})
    best = ordering.improve(g, start)
    assert ordering.total(g, best) <= ordering.total(g, start)
    assert all(sorted(v) == [0, 1, 2, 3] for v in ([r.pos for r in best.where(F.col("edge_id") == e).collect()] for e in ("a-b", "b-c", "c-d")))


def test_components_of_a_long_path_and_isolated(spark):
    n = 200
    nodes = spark.range(n + 1).withColumnRenamed("id", "node_id")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 99], "a long, b long")
    got = dict(rows(structure.components(nodes, pairs)))
    assert got == {i: 0 if i < 100 else 100 if i < n else n for i in range(n + 1)}


def test_components_of_a_shuffled_path_settle_in_few_rounds(spark):
    order = random.Random(5).sample(range(3000), 3000)
    nodes = spark.range(3001).withColumnRenamed("id", "node_id")
    pairs = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(order[0], 5000)], "a long, b long")
    got = structure.components(nodes, pairs, max_rounds=11)
    assert got.where("component = 0").count() == 3000 and rows(got.where("component <> 0")) == [(3000, 3000)]


def test_contract_and_remap_keep_lines_and_exceptions(spark):
    nodes = {"a": (0, 0), "b": (1, 0), "c": (1.1, 0), "d": (2, 0), "e": (1, 1)}
    lines = {"1": [("a", "b", "b"), ("b", "c", "c"), ("c", "d", "d")], "2": [("b", "e", None), ("c", "e", "e")]}
    g = structure.contract_short(graph(spark, nodes, lines, [("c", "1", "b-c", "c-d"), ("c", "2", "c-d", "c-e")]), 0.5)
    assert rows(g.edges) == [("a-b", "a", "b"), ("b-d", "b", "d"), ("b-e", "b", "e")]
    assert rows(g.occs, "edge_id", "line_id", "direction", "n") == [("a-b", "1", "b", 1), ("b-d", "1", "d", 1), ("b-e", "2", None, 2)]
    assert rows(g.exceptions) == [("b", "2", "b-d", "b-e"), ("b", "2", "b-e", "b-d")] and g.nodes.count() == 4


def test_pass_through(spark):
    g = graph(spark, {"a": (0, 0), "b": (1, 0), "c": (2, 0), "d": (3, 0)}, {"1": [("a", "b", None), ("b", "c", None), ("c", "d", None)], "2": [("a", "b", None), ("b", "c", None)]})
    assert rows(structure.pass_through(g), "node_id") == [("b",)]
    stop = spark.createDataFrame([("b",)], "node_id string")
    assert structure.pass_through(g, stop).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6))
def test_spatial_joins_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pts = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(40)]
    p = spark.createDataFrame(pts, "id long, x double, y double")
    dist = lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2])
    assert rows(spatial.neighbours(p, 0.7), "a", "b") == sorted((a[0], b[0]) for a, b in itertools.combinations(pts, 2) if dist(a, b) <= 0.7)
    near = {r.id: r.target for r in spatial.nearest(p.where("id % 2 = 1"), p.where("id % 2 = 0"), 1.0).collect()}
    for a in pts[1::2]:
        b = min((b for b in pts[::2] if dist(a, b) <= 1.0), key=lambda b: dist(a, b), default=None)
        assert near.get(a[0]) == (b and b[0])


def test_planarise_parts_add_up(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0), (2, 1.0, -1.0, 1.0, 1.0), (3, 3.0, -1.0, 3.0, 1.0), (4, 0.0, 5.0, 4.0, 5.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    parts = structure.planarise(s, 1.5)
    assert rows(parts.groupBy("id").count()) == [(1, 3), (2, 2), (3, 2), (4, 1)]
    assert rows(parts.where("id = 1"), "x1", "x2") == [(0.0, 1.0), (1.0, 3.0), (3.0, 4.0)]
    assert structure.densify(s, 1.0).where("id = 1").count() == 5


def test_snap_gives_each_its_own(spark):
    p = spark.createDataFrame([(i, 0.01 * i, 0.0) for i in range(6)], "id long, x double, y double")
    got = schematic.snap(p, 1.0, 2).collect()
    assert len({(r.gx, r.gy) for r in got}) == len(got) == 6


def test_frechet(spark):
    p = np.array([[0, 0], [1, 0], [2, 0]], float)
    assert evaluate.discrete_frechet(p, p) == 0 and evaluate.discrete_frechet(p, p + [0, 2]) == 2
    df = spark.createDataFrame([(1, [(0.0, 0.0)], [(3.0, 4.0)]), (2, [], [(0.0, 0.0)])], "id long, p array<struct<x: double, y: double>>, q array<struct<x: double, y: double>>")
    assert {r.id: r.distance for r in evaluate.frechet(df).collect()} == {1: 5.0, 2: None}


def test_evaluation_of_itself_is_perfect(spark):
    g = graph(spark, CROSS, {"1": [("a", "m", None), ("m", "c", None)]})
    assert rows(evaluate.line_match(g, g)) == [("1", 2, 2, 2, 1.0)]


def test_functions(spark):
    df = spark.createDataFrame([([3, 1, 2], [2, 0, 1], ' "x" ', "#Ab1", 8.4, 49.0)], "v array<int>, o array<int>, s string, c string, lng double, lat double")
    r = df.select(
        fx.inversions(F.col("v")), fx.permuted(F.col("v"), F.col("o")), fx.first_of(F.lit(None).cast("string"), F.lit(" "), F.col("s")), fx.html_colour(F.col("c")),
        fx.same_cycle(F.col("v"), fx.rotated(F.col("v"), F.lit(2))), fx.same_cycle(F.col("v"), F.reverse("v")), fx.lng_of(fx.mercator_x(F.col("lng"))), fx.lat_of(fx.mercator_y(F.col("lat"))),
    ).first()
    assert tuple(r[:6]) == (2, [2, 3, 1], "x", "aabb11", True, False) and math.isclose(r[6], 8.4) and math.isclose(r[7], 49.0)


# Sources

COLLECTION = """{"type": "FeatureCollection", "features": [
{"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {"id": "a", "station_id": "s", "station_label": "Stop", "excluded_conn": [{"line": "1", "node_from": "b", "node_to": "c"}]}},
{"type": "Feature", "geometry": {"type": "Point", "coordinates": [9, 9]}, "properties": {"id": "a"}},
{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 0]}, "properties": {"id": "b"}},
{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 0]]}, "properties": {"from": "a", "to": "b", "lines": [{"label": "1", "color": "#F00"}, {"label": "2", "direction": "b"}, {"label": "2", "direction": "b"}]}},
{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [5.7, 2]]}, "properties": {"from": "a", "lbl": "1"}},
{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 0]]}, "properties": {"from": "a", "to": "a", "lines": [{"label": "1"}]}},
{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 0]]}, "properties": {"from": "a", "to": "nowhere", "lines": [{"label": "1"}]}},
{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 0]]}, "properties": {"from": "b", "to": "a", "lines": []}}]}"""


def test_geojson_reads_and_writes(spark, tmp_path):
    (tmp_path / "g.json").write_text(COLLECTION)
    g = geojson.read(spark, f"file://{tmp_path}/g.json")
    assert rows(g.nodes, "node_id", "x") == [("5|2", 5.7), ("a", 0.0 if g.nodes.where("node_id = 'a' and x = 0").count() else 9.0), ("b", 1.0)]
    assert rows(g.edges, "edge_id") == [("5|2-a",), ("a-b",)]
    assert rows(g.occs, "edge_id", "line_id", "direction", "color") == [("5|2-a", "1", None, None), ("a-b", "1", None, "ff0000"), ("a-b", "2", "b", None)]
    geojson.write(g, f"file://{tmp_path}/out")
    again = geojson.read(spark, f"file://{tmp_path}/out")
    assert rows(again.occs, "edge_id", "line_id", "direction") == rows(g.occs, "edge_id", "line_id", "direction") and rows(again.nodes, "node_id", "x", "y") == rows(g.nodes, "node_id", "x", "y")
    geojson.write(g, f"file://{tmp_path}/parts", structure.components(g.nodes, g.edges))
    assert [unquote(p.name) for p in (tmp_path / "parts").glob("component=*")] == ["component=5|2"]  # Spark may escape it


def test_dot(spark, tmp_path):
    (tmp_path / "g.dot").write_text('graph G {\n a [pos="1,2", station_id="s"];\n b [pos="3,4"];\n a -- b [id="L1", color="#0f0"];\n b -- c [label="L2"];\n}\n')
    g = dot.read(spark, f"file://{tmp_path}/g.dot")
    assert rows(g.nodes, "node_id", "x", "y") == [("a", 1.0, 2.0), ("b", 3.0, 4.0), ("c", 0.0, 0.0)]
    assert rows(g.occs, "edge_id", "line_id", "color") == [("a-b", "L1", "00ff00"), ("b-c", "L2", None)]


def test_gtfs(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon\nA,Aa,49,8\nB,Bb,49.1,8\nC,Cc,49.2,8.1\n")
    (tmp_path / "routes.txt").write_text("route_id,route_short_name,route_type,route_color\nr1,1,0,FF0000\nr2,2,3,00FF00\n")
    (tmp_path / "trips.txt").write_text("trip_id,route_id\nt1,r1\nt2,r1\nt3,r2\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_sequence,stop_id\nt1,1,A\nt1,2,B\nt1,10,C\nt2,1,B\nt2,2,A\nt3,1,A\nt3,2,C\n")
    g = gtfs.line_graph(gtfs.read(spark, f"file://{tmp_path}"), [0])
    assert rows(g.occs, "edge_id", "line_id", "direction", "n", "color") == [("A-B", "r1", None, 2, "ff0000"), ("B-C", "r1", "C", 1, "ff0000")]


def test_svg(spark):
    g = graph(spark, {"a": (0, 0), "b": (1, 0)}, {"1": [("a", "b", None)], "2": [("a", "b", None)]})
    out = svg.elements(g, 100).orderBy("z", "part").collect()
    assert [r.z for r in out] == [0, 0, 1, 1] and '<polyline points="0,-3 100,-3"' in out[0].value and '<circle cx="100" cy="0"' in out[3].value


def test_streaming_equals_batch(spark, tmp_path):
    data = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "ab"[i % 2], "bc"[i % 2], str(i % 2)) for i in range(30)]
    hops = spark.createDataFrame(data, "ts string, from_node string, to_node string, line_id string").withColumn("ts", F.to_timestamp("ts"))
    hops.repartition(3).write.parquet(f"{tmp_path}/hops")
    stream = spark.readStream.schema(hops.schema).parquet(f"{tmp_path}/hops")
    run = windowed_occurrences(stream).writeStream.outputMode("complete").format("memory").queryName("occ").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows(spark.table("occ")) == rows(windowed_occurrences(hops))


# Registered queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def shared_graphs():
    """Graphs of the tables are made once for all queries; what a stage cut is only read."""
    kept = {n: getattr(tables, n) for n in ("near", "sparse", "full")}
    for n, make in kept.items():
        setattr(tables, n, functools.cache(make))
    yield
    for n, make in kept.items():
        setattr(tables, n, make)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, shared_graphs, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    found = duck.sql(catalog.ORACLE_SQL[name])
    assert cols == sorted(found.columns)
    want = sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    assert got == want


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
    assert all(re.fullmatch(r"\w+", n) for n in e.queries()) and isinstance(e.entry(spark), type(spark.range(1)))
    assert LineGraph is not None
