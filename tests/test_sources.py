"""Sources: sides, vertices, names and projections survive a round trip."""

import json

from pyspark.sql import functions as F

from tests.test_line_graph import rows
from tramlines.model import edge_key
from tramlines.sources import dot, geojson, gtfs


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}, "properties": properties}


FEATURES = [
    feature("Point", [0, 0], id="x-1", station_id="s", station_label="S", excluded_conn=[{"line": "1", "node_from": "a", "node_to": "z"}]),
    feature("Point", [2, 0], id="z"), feature("Point", [0, 3], id="a"),
    feature("LineString", [[2, 0], [1, 0.5], [0, 0]], **{"from": "z", "to": "x-1"}, lines=[{"id": "1"}, {"id": "2"}, {"id": "3", "direction": "z"}]),
    feature("LineString", [[0, 0], [0, 3]], **{"from": "x-1", "to": "a"}, lines=[{"id": "1"}]),
]


def texts(g):
    return sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in geojson.feature_rows(g).collect())


def test_geojson_forms_are_read_once_and_round_trip(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, FEATURES)))
    (tmp_path / "pretty.json").write_text('{"type": "FeatureCollection", "features": [\n' + ",\n".join(map(json.dumps, FEATURES)) + "\n]}")
    (tmp_path / "indented.json").write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    (tmp_path / "flat.json").write_text(json.dumps({"features": FEATURES, "type": "FeatureCollection"}))
    found = []
    for name in ("lines", "pretty", "indented", "flat"):
        g = geojson.read(spark, f"file://{tmp_path}/{name}.json")
        assert rows(g.occs, "line_id", "n") == [("1", 1), ("1", 1), ("2", 1), ("3", 1)]
        found.append(texts(g))
    assert found[0] == found[1] == found[2] == found[3]
    edge = next(r for r in g.edges.collect() if {r.a, r.b} == {"x-1", "z"})
    assert (edge.a, [tuple(p) for p in edge.geom]) == ("x-1", [(0, 0), (1, 0.5), (2, 0)])
    # Seen from the other end the lines stand the other way round.
    assert [r.line_id for r in g.occs.where(g.occs.edge_id == edge.edge_id).orderBy("pos").collect()] == ["3", "2", "1"]
    geojson.write(g, f"file://{tmp_path}/out")
    assert texts(geojson.read(spark, f"file://{tmp_path}/out", form="lines")) == found[0]
    node = next(json.loads(r.value)["properties"] for r in geojson.feature_rows(g).collect() if '"x-1"' in r.value and "Point" in r.value)
    assert sorted(node["excluded_conn"][0].values()) == ["1", "a", "z"]


def test_geojson_projects_there_and_back(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, FEATURES)))
    g = geojson.read(spark, f"file://{tmp_path}/lines.json", project=True)
    assert round(g.nodes.where("node_id = 'z'").first().x, 3) == 222638.982
    back = {json.loads(r.value)["properties"].get("id"): json.loads(r.value)["geometry"]["coordinates"] for r in geojson.feature_rows(g, project=True).collect()}
    assert [round(v, 9) for v in back["a"]] == [0, 3]


def test_edge_names_tell_hyphens_apart(spark):
    df = spark.createDataFrame([("a-b", "c"), ("a", "b-c"), ("a-", "b"), ("a", "-b"), ("c", "a-b")], "p string, q string")
    names = [r.k for r in df.select(edge_key(F.col("p"), F.col("q")).alias("k")).collect()]
    assert len(set(names[:4])) == 4 and names[4] == names[0]
    assert spark.createDataFrame([(-5, 3)], "p long, q long").select(edge_key(F.col("p"), F.col("q")).alias("k")).first().k == "-5-3"


def test_dot_directions_chains_and_quotes(spark, tmp_path):
    (tmp_path / "g.dot").write_text('digraph G {\n a [pos="1,2", label="x; y"]; b -> c [id=L1];\n a -- b -- "d e" [color="red"]; node [shape=box]\n c -> b [id=L2]; b -> c [id=L2]; c -- a\n}\n')
    g = dot.read(spark, f"file://{tmp_path}/g.dot")
    assert rows(g.occs, "edge_id", "line_id", "direction") == [("a-b", "red", None), ("a-c", "a-c", None), ("b-c", "L1", "c"), ("b-c", "L2", None), ("b-d e", "red", None)]
    assert rows(g.nodes, "node_id", "x", "station_label") == [("a", 1.0, "x; y"), ("b", 0.0, None), ("c", 0.0, None), ("d e", 0.0, None)]


def test_gtfs_shapes_pruning_and_turns(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon\nA,Aa,0,0\nB,Bb,0,2\nC,Cc,0,4\nD,Dd,2,2\n")
    (tmp_path / "routes.txt").write_text("route_id,route_short_name,route_type,route_color\nr1,1,0,FF0000\n")
    (tmp_path / "trips.txt").write_text("trip_id,route_id,shape_id\nt1,r1,s1\nt2,r1,s1\nt3,r1,\nt4,r1,\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_sequence,stop_id\n" + "".join(f"{t},{i},{s}\n" for t, way in (("t1", "ABC"), ("t2", "ABC"), ("t3", "DB"), ("t4", "CB")) for i, s in enumerate(way)))
    (tmp_path / "shapes.txt").write_text("shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\n" + "".join(f"s1,{i},{y},{x}\n" for i, (x, y) in enumerate([(0, 0), (1, 1), (2, 0), (4, 0)])))
    feed = gtfs.read(spark, f"file://{tmp_path}", shapes=True)
    g = gtfs.line_graph(feed, turns=True)
    geom = {r.edge_id: len(r.geom) for r in g.edges.collect()}
    assert geom == {"A-B": 3, "B-C": 2, "B-D": 2}
    assert rows(g.exceptions, "node_id", "edge_a", "edge_b") == [("B", "A-B", "B-D"), ("B", "B-C", "B-D"), ("B", "B-D", "A-B"), ("B", "B-D", "B-C")]
    assert rows(gtfs.line_graph(feed, prune=1.0).edges, "edge_id") == [("A-B",), ("B-C",)]


def test_components_statistics_and_labels_go_through_files(spark, tmp_path):
    from tests.test_line_graph import graph
    from tramlines.operators import structure

    nodes = {"a": (0, 0), "b": (3, 4), "c": (6, 8), "p": (0, 9), "q": (5, 9), "z": (9, 9)}
    g = graph(spark, nodes, {"1": [("a", "b", None), ("b", "c", None)], "2": [("b", "c", "c"), ("p", "q", "q")]}, [("b", "1", "a-b", "b-c")])
    g = g.with_(occs=g.occs.withColumn("label", F.when(F.col("line_id") == "1", "one")))
    after = structure.with_components(g.tracked())
    stats = structure.build_statistics(g, after, spark.createDataFrame([("a",), ("z",), ("gone",)], "node_id string"))
    want = {"num_nds_in": 6, "num_edgs_in": 3, "len_before": 15.0, "num_nds_out": 6, "num_edgs_out": 3, "num_stations_out": 2, "num_components": 3, "num_restrs": 1, "len_after": 15.0,
            "tot_merged_edgs": 3, "tot_support_graph_edgs": 3, "max_merged_edgs": 1, "avg_merged_edgs": 1.0}
    assert stats.first().asDict() == want
    path = f"file://{tmp_path}/out"
    geojson.write(after, path, statistics=stats)
    back = geojson.read(spark, path)
    assert rows(back.nodes, "node_id", "component") == [("a", 0), ("b", 0), ("c", 0), ("p", 1), ("q", 1), ("z", 2)] and rows(back.edges, "edge_id") == [("a-b",), ("b-c",), ("p-q",)]
    props = [json.loads(r.value)["properties"] for r in spark.read.text(path).collect()]
    assert sorted((p["from"], p["dbg_lines"], p["component"]) for p in props if "from" in p) == [("a", "one", 0), ("b", "one,", 0), ("p", "", 1)]
    assert geojson.prior_statistics(spark, path).first().asDict() == want
    # A stage after it: what was before stays, merged edges add up.
    whole = F.lit("a-b").alias("to")
    merged = back.tracked()
    merged = merged.with_(origins=merged.traced(spark.createDataFrame([("b-c",)], "edge_id string").withColumn("to", whole)), edges=merged.edges.where("edge_id <> 'b-c'"), nodes=merged.nodes.where("node_id <> 'c'"), exceptions=None)
    later = structure.build_statistics(back, merged, prior=geojson.prior_statistics(spark, path)).first()
    assert (later.num_nds_in, later.num_nds_out, later.len_before, later.len_after, later.num_restrs) == (6, 5, 15.0, 10.0, 0)
    assert (later.tot_merged_edgs, later.tot_support_graph_edgs, later.max_merged_edgs, later.avg_merged_edgs) == (6, 5, 2, 1.2)
    geojson.write(after, f"file://{tmp_path}/parts", by=after.nodes, statistics=stats)
    assert rows(geojson.read(spark, f"file://{tmp_path}/parts/component=1").nodes, "node_id") == [("p",), ("q",)]
    assert geojson.prior_statistics(spark, f"file://{tmp_path}/parts/component=statistics").count() == 1


def test_properties_of_collections_and_awkward_components(spark, tmp_path):
    features = [feature("Point", [0, 0], id="a", component=7), feature("Point", [1, 0], id="b", component="x"), feature("LineString", [[1, 0], [4, 0]], **{"from": "b"}, component=3, lines=[{"id": "1"}])]
    (tmp_path / "one.json").write_text(json.dumps({"type": "FeatureCollection", "properties": {"statistics": {"num_nds_in": 9, "len_before": 2.5, "iters": 4}}, "features": features}, indent=1))
    (tmp_path / "none.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = geojson.prior_statistics(spark, f"file://{tmp_path}/one.json").collect()
    assert [(r.num_nds_in, r.len_before, r.num_nds_out) for r in got] == [(9, 2.5, None)] and geojson.prior_statistics(spark, f"file://{tmp_path}/none.json").count() == 0
    assert json.loads(geojson.properties(spark, f"file://{tmp_path}/one.json").first().value)["statistics"]["iters"] == 4
    assert rows(geojson.read(spark, f"file://{tmp_path}/one.json").nodes, "node_id", "component") == [("4|0", 3), ("a", 7), ("b", None)]
