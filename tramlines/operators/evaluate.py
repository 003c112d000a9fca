"""Comparing a line graph with a reference graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import LineGraph, with_geometry
from . import routing, spatial
from .numbering import numbered


def line_match(truth: LineGraph, test: LineGraph) -> DataFrame:
    """(line_id, expected, found, matched, rate): edges of each line in both graphs and the share matched."""
    a = truth.occs.select("line_id", "edge_id", F.lit(1).alias("t"))
    b = test.occs.select("line_id", "edge_id", F.lit(1).alias("f"))
    rows = a.join(b, ["line_id", "edge_id"], "full").groupBy("line_id").agg(F.count("t").alias("expected"), F.count("f").alias("found"), F.sum(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1).otherwise(0)).alias("matched"))
    return rows.withColumn("rate", F.round(F.col("matched") / F.greatest("expected", F.lit(1)), 6))


def discrete_frechet(p: np.ndarray, q: np.ndarray) -> float:
    """Discrete Frechet distance of two point sequences."""
    d = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
    row = np.maximum.accumulate(d[0])
    for i in range(1, len(p)):
        new = np.empty_like(row)
        new[0] = max(row[0], d[i, 0])
        for j in range(1, len(q)):
            new[j] = max(min(row[j], row[j - 1], new[j - 1]), d[i, j])
        row = new
    return float(row[-1])


def dense(p: np.ndarray, gap: float) -> np.ndarray:
    """A point sequence with further points, so that neighbours are at most `gap` apart."""
    if len(p) < 2:
        return p
    parts = np.maximum(1, np.ceil(np.hypot(*np.diff(p, axis=0).T) / gap)).astype(int)
    at = np.concatenate([i + np.arange(k) / k for i, k in enumerate(parts)] + [[len(p) - 1.0]])
    return np.stack([np.interp(at, np.arange(len(p)), p[:, c]) for c in (0, 1)], 1)


def frechet(paths: DataFrame, gap: float | None = None) -> DataFrame:
    """(id, distance) of rows (id, p, q), p and q being arrays of structs x, y; null if either is empty.

    With a gap, both are filled up with points to at most that distance first.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            plain = lambda v: np.array([[s["x"], s["y"]] for s in v]).reshape(-1, 2)
            at = plain if gap is None else lambda v: dense(plain(v), gap)
            yield pd.DataFrame({"id": f["id"], "distance": [discrete_frechet(at(p), at(q)) if len(p) and len(q) else None for p, q in zip(f["p"], f["q"], strict=True)]})

    return paths.select("id", "p", "q").mapInPandas(run, "id long, distance double")


def draw(sample, salt: int, n):
    """The number below n that a sample draws; the same in any run."""
    return F.pmod(F.pmod(sample, F.lit(1 << 31)) * 1103515245 + salt, n)


def sample_pairs(nodes: DataFrame, samples: int, seed: int = 0, span: float | None = None) -> DataFrame:
    """(sample, from_node, to_node): pairs of nodes drawn with repetition.

    With a span the second node is drawn among those at most so far from the first (itself included).
    """
    placed = cut(numbered(nodes.select("node_id", "x", "y"), "node_id"))
    n = placed.count()
    drawn = nodes.sparkSession.range(samples).withColumnRenamed("id", "sample").withColumn("at", draw(F.col("sample"), 12345 + seed, F.lit(n)))
    first = drawn.join(placed, "at").select("sample", F.col("node_id").alias("from_node"), "x", "y")
    if span is None:
        second = first.withColumn("at", draw(F.col("sample"), 54321 + seed, F.lit(n))).join(placed.select("at", F.col("node_id").alias("to_node")), "at")
        return second.select("sample", "from_node", "to_node")
    # The nodes around are looked up once for each first node, not for each sample.
    start = first.select(F.col("from_node").alias("id"), "x", "y").distinct()
    around = spatial.within(start, placed.select(F.col("node_id").alias("id"), "x", "y"), span).groupBy("id").agg(F.array_sort(F.collect_list("target")).alias("near"))
    choice = F.get("near", draw(F.col("sample"), 54321 + seed, F.size("near")).cast("int"))
    return first.join(around, first["from_node"] == around["id"]).select("sample", "from_node", choice.alias("to_node"))


def _legs(g: LineGraph, name: str, asked: DataFrame, distance: float, limit: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Starts and ends of the routes asked for (sample, line_id, x1, y1, x2, y2) in one graph, what its lines travel, and its arcs."""
    directed = cut(routing.arcs(g).withColumn("arc", F.concat(F.lit(name), "arc")))
    points = g.nodes.select(F.col("node_id").alias("id"), "x", "y")
    ride = cut(routing.travelled(g, directed).join(directed.select("arc", "length"), "arc"))
    at = lambda k: cut(spatial.within(asked.select(F.col("sample").alias("id"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")), points, distance).select(F.col("id").alias("sample"), "target").join(asked.select("sample", "line_id"), "sample"))
    query = F.concat(F.lit(name), F.col("sample").cast("string"))
    starts = at(1).join(ride.withColumnRenamed("u", "target"), ["target", "line_id"]).select(query.alias("query"), "line_id", "arc", F.lit(limit).alias("bound"))
    ends = at(2).join(ride.withColumnRenamed("v", "target"), ["target", "line_id"]).select(query.alias("query"), "line_id", "arc").distinct()
    return starts, ends, ride, directed.select("arc", "geom")


def _onward(g: LineGraph, name: str, ride: DataFrame, front: DataFrame) -> DataFrame:
    """The rows of `front` in one graph with the arcs that their lines may turn to (next) and how long these are (step)."""
    here = front.where(F.col("query").startswith(name)).join(ride.select("line_id", "arc", F.col("v").alias("node_id"), F.col("edge_id").alias("edge_a")), ["line_id", "arc"])
    out = ride.select("line_id", F.col("u").alias("node_id"), F.col("arc").alias("next"), F.col("edge_id").alias("edge_b"), F.col("length").alias("step"))
    turns = cut(here).join(out, ["line_id", "node_id"]).where("edge_a <> edge_b")
    if g.exceptions is not None:
        # What is forbidden of these few turns is looked up from their side, so that exceptions stay where they are.
        turns = cut(turns)
        barred = g.exceptions.select("node_id", "line_id", "edge_a", "edge_b").join(turns.select("node_id", "line_id", "edge_a", "edge_b").distinct(), ["node_id", "line_id", "edge_a", "edge_b"], "left_semi")
        turns = turns.join(barred, ["node_id", "line_id", "edge_a", "edge_b"], "left_anti")
    return turns.select(*front.columns, "next", "step")


def sampled_routes(truth: LineGraph, test: LineGraph, samples: int, distance: float, seed: int = 0, span: float | None = None, limit: float = float("inf"), gap: float | None = None) -> DataFrame:
    """(sample, line_id, truth_cost, test_cost, frechet) of routes drawn in `truth` and travelled in both graphs.

    A sample is two nodes of `truth` and one of the lines at the nodes within `distance` of either; the
    route may start and end at any node within `distance` of the two, in both graphs.  Costs are those
    of all edges but the first; null where there is no route for less than `limit`.  frechet compares the
    courses of both routes, filled up to points `gap` (by default a tenth of `distance`) apart.
    """
    held = lambda g: with_geometry(g.with_(edges=cut(g.edges), occs=cut(g.occs)))
    truth, test = (held(g) for g in (truth, test))
    pairs = sample_pairs(truth.nodes, samples, seed, span)
    at = lambda c, k: truth.nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    ends = cut(pairs.join(at("from_node", 1), "from_node").join(at("to_node", 2), "to_node").select("sample", "x1", "y1", "x2", "y2"))
    points = ends.select("sample", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(F.col("sample").alias("id"), "p.x", "p.y")
    close = cut(spatial.within(points, truth.nodes.select(F.col("node_id").alias("id"), "x", "y"), distance).select("id", "target").distinct())
    here = cut(close.join(truth.incidence().select(F.col("node_id").alias("target"), "edge_id"), "target"))
    lines = here.join(truth.occs.select("edge_id", "line_id"), "edge_id").groupBy(F.col("id").alias("sample")).agg(F.array_sort(F.collect_set("line_id")).alias("lines"))
    asked = cut(ends.join(lines, "sample").withColumn("line_id", F.get("lines", draw(F.col("sample"), 99991 + seed, F.size("lines")).cast("int"))).drop("lines"))
    graphs = ((truth, "g"), (test, "t"))
    both = [_legs(g, name, asked, distance, limit) for g, name in graphs]
    starts, stops, _, courses = (a.unionByName(b) for a, b in zip(*both, strict=True))
    # The samples are few, the graphs may be large: turns are made only where a search arrives.
    rides = [ride for _, _, ride, _ in both]
    ways = routing.cheapest(starts, lambda front: _onward(*graphs[0], rides[0], front).unionByName(_onward(*graphs[1], rides[1], front)))
    last = ways.join(stops, ["query", "line_id", "arc"]).groupBy("query").agg(F.min(F.struct("cost", "arc", "prev")).alias("m")).select("query", "m.cost", "m.arc", "m.prev")
    # The routes from their ends, an arc a round for all of them.
    back = ways.select("query", "arc", F.col("prev").alias("prev2"))
    walked = front = cut(last.select("query", F.lit(0).alias("k"), "arc", "prev"))
    while not front.where("prev is not null").isEmpty():
        ahead = front.where("prev is not null").select("query", (F.col("k") + 1).alias("k"), F.col("prev").alias("arc"))
        front = cut(ahead.join(back, ["query", "arc"]).select("query", "k", "arc", F.col("prev2").alias("prev")))
        walked = walked.union(front)
    bent = walked.join(courses, "arc").groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "geom"))).alias("a")).select("query", F.flatten(F.transform("a", lambda e: e["geom"])).alias("course"))
    routes = last.select("query", "cost").join(bent, "query").withColumn("sample", F.substring("query", 2, 20).cast("long")).withColumn("truth", F.col("query").startswith("g"))
    routes = cut(routes)
    side = lambda flag, cost, course: routes.where(F.col("truth") == flag).select("sample", F.col("cost").alias(cost), F.col("course").alias(course))
    compared = frechet(side(True, "c", "p").join(side(False, "d", "q"), "sample").withColumnRenamed("sample", "id"), gap or distance / 10)
    rows = asked.select("sample", "line_id").join(side(True, "truth_cost", "p").drop("p"), "sample", "left").join(side(False, "test_cost", "q").drop("q"), "sample", "left")
    return rows.join(compared.select(F.col("id").alias("sample"), F.col("distance").alias("frechet")), "sample", "left").select("sample", "line_id", "truth_cost", "test_cost", "frechet")


def route_summary(routes: DataFrame, distance: float) -> DataFrame:
    """One row: rate of matching samples, least, largest and mean distance.

    Samples without a route in either graph don't count; one with a route in one graph only is no match.
    """
    counted = routes.where("truth_cost is not null or test_cost is not null")
    n = F.count("*")
    return counted.agg(n.alias("samples"), (F.sum(F.when(F.col("frechet") < distance, 1).otherwise(0)) / n).alias("rate"), F.min("frechet").alias("least"), F.max("frechet").alias("largest"), (F.sum("frechet") / n).alias("mean"))
