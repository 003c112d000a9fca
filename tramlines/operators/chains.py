"""Chains of nodes with two edges: list ranking, combination into one edge, and putting the nodes back.

Nothing walks a chain step by step.  Every edge is two directed items, each item knows the next one,
and pointers double in every round, so a chain of a million nodes takes twenty rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import LineGraph, edge_key
from . import geometry
from .algebra import degrees


def rank_lists(items: DataFrame, keep: int = 0, rounds: int = 64) -> DataFrame:
    """(id, last, n, top, closed) for items (id, next, name), of which each has at most one before it.

    last: the item at which the list ends; n: items from this one to that; top: the `keep` largest
    names from here to the end.  Items of a ring are closed: their top is that of the ring, and last
    and n mean nothing.  An item is known to lie on a ring as soon as its smallest item is met twice.
    """
    best = lambda names: F.slice(F.sort_array(F.array_distinct(names), asc=False), 1, keep) if keep else F.slice(names, 1, 0)
    named = F.when(F.col("name").isNotNull(), F.array("name")).otherwise(F.slice(F.array("name"), 1, 0))
    rows = cut(items.select("id", F.col("next").alias("to"), F.col("id").alias("last"), F.lit(1).cast("long").alias("n"), best(named).alias("top"), F.col("id").alias("low"), F.lit(False).alias("closed")))
    for _ in range(rounds):
        open_ = rows.where("to is not null and not closed")
        if open_.isEmpty():
            return rows.select("id", "last", "n", "top", "closed")
        far = rows.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("n").alias("n2"), F.col("top").alias("top2"), F.col("low").alias("low2"), F.col("closed").alias("closed2"))
        moved = open_.join(far, "to").select(
            "id", F.col("to2").alias("to"), F.col("last2").alias("last"), (F.col("n") + F.col("n2")).alias("n"), best(F.concat("top", "top2")).alias("top"),
            F.least("low", "low2").alias("low"), (F.col("closed2") | (F.col("low") == F.col("low2"))).alias("closed"),
        )
        # A union adds up the files of both sides, which would double in every round.
        rows = cut(rows.where("to is null or closed").union(moved).coalesce(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    raise RuntimeError(f"lists did not end in {rounds} rounds")


def _halves(g: LineGraph) -> DataFrame:
    """(id, edge_id, u, v): every edge in both directions."""
    ends = F.explode(F.array(F.struct(F.lit(">").alias("s"), F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.lit("<").alias("s"), F.col("b").alias("u"), F.col("a").alias("v"))))
    return g.edges.select("edge_id", ends.alias("e")).select(F.concat(F.col("edge_id").cast("string"), F.col("e.s")).alias("id"), "edge_id", "e.u", "e.v")


def _items(halves: DataFrame, inner: DataFrame) -> DataFrame:
    """Halves with the half that goes on where they end at an inner node, and that node as their name."""
    out = halves.join(inner.select(F.col("node_id").alias("u")), "u", "left_semi").select(F.col("u").alias("v"), F.col("id").alias("next"), F.col("edge_id").alias("next_edge"))
    on = halves.join(out, "v").where("edge_id <> next_edge").select("id", "next", F.col("v").alias("name"))
    return halves.select("id").join(on, "id", "left")


@dataclass(frozen=True)
class Combined:
    """A graph without the inner nodes of its chains.

    edges(edge_id, a, b, pieces, max_lines); pieces(piece, edge_id, rank, forward): the former edges in
    order from a to b, `forward` if the former edge's own a comes first; places(node_id, edge_id, rank):
    inner nodes, rank pieces after a.
    """

    nodes: DataFrame
    edges: DataFrame
    pieces: DataFrame
    places: DataFrame


def combine_degree_two(g: LineGraph) -> Combined:
    """Take out nodes of two edges as far as no double edge and no loop comes about.

    The result is that of taking them out one by one in the order of their names: of the chains between
    two nodes one goes over to a single edge (a direct edge if there is one, else the chain that is
    through first), the others keep their last node; a chain back to its own node keeps its last two, a
    ring its last three.  Lines don't matter, as pieces keep theirs.
    """
    halves = cut(_halves(g))
    inner = degrees(g).where("degree = 2").select("node_id")
    walked = rank_lists(_items(halves, inner), keep=3)
    starts = halves.join(inner.select(F.col("node_id").alias("u")), "u", "left_anti").select("id", F.col("edge_id").alias("first"), F.col("u").alias("p"))
    ends = halves.select(F.col("id").alias("last"), F.col("edge_id").alias("end"), F.col("v").alias("q"))
    chains = starts.join(walked, "id").join(ends, "last").where("first < end or (first = end and p < q)")
    pair = chains.withColumn("c", F.least("p", "q")).withColumn("d", F.greatest("p", "q")).withColumn("key", F.struct(F.size("top").alias("k"), F.get("top", F.lit(0)).alias("t"), "first"))
    # A direct edge has no name in `top`; sizes beyond that must not decide.
    pair = pair.withColumn("key", F.struct(F.least(F.col("key.k"), F.lit(1)).alias("k"), "key.t", "key.first"))
    through = pair.where("c <> d").groupBy("c", "d").agg(F.min("key").alias("through"))
    beside = pair.where("c <> d").join(through, ["c", "d"]).where("key > through").select(F.get("top", F.lit(0)).alias("node_id"))
    loops = pair.where("c = d").select(F.explode(F.slice("top", 1, 2)).alias("node_id"))
    rings = walked.where("closed").select(F.explode("top").alias("node_id"))
    kept = cut(beside.union(loops).union(rings).distinct())
    gone = cut(inner.join(kept, "node_id", "left_anti"))
    final = rank_lists(_items(halves, gone))
    ahead = halves.join(final, "id").join(ends, "last").select("edge_id", "u", "v", "q", "n")
    side = lambda which, q, n: ahead.join(g.edges.select("edge_id", "a", "b"), "edge_id").where(F.col("v") == F.col(which)).select("edge_id", F.col("q").alias(q), F.col("n").alias(n))
    both = cut(side("b", "after", "n_after").join(side("a", "before", "n_before"), "edge_id"))
    forward = F.col("before") < F.col("after")
    pieces = both.select(
        F.col("edge_id").alias("piece"), edge_key(F.col("before"), F.col("after")).alias("edge_id"), F.when(forward, F.col("n_before") - 1).otherwise(F.col("n_after") - 1).alias("rank"),
        forward.alias("forward"), F.least("before", "after").alias("a"), F.greatest("before", "after").alias("b"), (F.col("n_before") + F.col("n_after") - 1).alias("pieces"),
    )
    lines = g.occs.groupBy(F.col("edge_id").alias("piece")).agg(F.count("*").alias("lines"))
    edges = pieces.join(lines, "piece", "left").groupBy("edge_id", "a", "b", "pieces").agg(F.coalesce(F.max("lines"), F.lit(0)).alias("max_lines"))
    first = g.edges.select(F.col("edge_id").alias("piece"), F.col("a").alias("ea"), F.col("b").alias("eb"))
    places = pieces.where("rank > 0").join(first, "piece").select(F.when(F.col("forward"), F.col("ea")).otherwise(F.col("eb")).alias("node_id"), "edge_id", "rank", "pieces")
    return Combined(g.nodes.join(gone, "node_id", "left_anti"), edges, pieces.select("piece", "edge_id", "rank", "forward", "pieces"), places)


def reinsert(g: LineGraph, combined: Combined, drawn: DataFrame) -> LineGraph:
    """`g` with the geometry of its combined edges: drawn(edge_id, geom), vertices from a to b.

    Inner nodes stand at equal distances along the drawn edge, pieces are the parts between them, and
    lines, directions and exceptions are those of `g`.  Nodes of no drawn edge keep their place.
    """
    lines = combined.edges.select("edge_id", "a", "b").join(drawn.select("edge_id", "geom"), "edge_id")
    ends = lines.select(F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.get("geom", F.lit(0)).alias("p")), F.struct(F.col("b").alias("node_id"), F.element_at("geom", -1).alias("p")))).alias("e"))
    outer = ends.groupBy("e.node_id").agg(F.min("e.p").alias("p"))
    inner = combined.places.join(lines, "edge_id").select("node_id", geometry.point_at(F.col("geom"), F.col("rank") / F.col("pieces")).alias("p"))
    placed = g.nodes.join(outer.union(inner), "node_id", "left")
    nodes = placed.withColumn("x", F.coalesce("p.x", "x")).withColumn("y", F.coalesce("p.y", "y")).select(*g.nodes.columns)
    part = geometry.sub_path(F.col("geom"), F.col("rank") / F.col("pieces"), (F.col("rank") + 1) / F.col("pieces"))
    cutup = combined.pieces.join(lines.select("edge_id", "geom"), "edge_id").select(F.col("piece").alias("edge_id"), F.when(F.col("forward"), part).otherwise(F.reverse(part)).alias("new"))
    edges = g.edges.join(cutup, "edge_id", "left")
    geom = F.coalesce("new", "geom") if "geom" in g.edges.columns else F.col("new")
    return g.with_(nodes=nodes, edges=edges.withColumn("geom", geom).select("edge_id", "a", "b", "geom"))
