"""Bounded cheapest paths over arcs that lines may take, from many sources at once, and what follows from them.

A search is a table of (query, arc, cost).  Each round joins what got cheaper with the next arcs and
keeps, for each query and arc, the cheapest way found; what a query's bound excludes is never made.  All
queries, over all lines, share a round, so the number of rounds is the largest number of arcs on a way
within its bound, and no search is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import LineGraph, with_geometry
from . import geometry
from .numbering import numbered


def cheapest(starts: DataFrame, steps: DataFrame | Callable[[DataFrame], DataFrame], rounds: int = 10_000, prev: bool = True) -> DataFrame:
    """(query, line_id, arc, cost, prev) of all arcs that a query reaches for less than its bound.

    starts(query, line_id, arc, bound): the first arcs, which cost nothing, or what a column `cost` says;
    steps(line_id, arc, next, cost): what the line pays to go over to the next arc.  prev is the arc
    before on the cheapest way (ties by its name), null at a start; without `prev` it is left out.
    line_id may be absent on both sides where arcs are a line's own.  Few searches in a large graph need
    not have all steps made: a function adds `next` and `step` to the rows that got cheaper.
    """
    at = [c for c in ("line_id", "arc") if c in starts.columns]
    key, rest = ["query", *at], ["cost", "prev"] if prev else ["cost"]
    best = F.min(F.struct("cost", "prev") if prev else F.struct("cost")).alias("m")
    starts = starts if "cost" in starts.columns else starts.withColumn("cost", F.lit(0.0))
    # A start's own cost comes first among ties, as its prev is null.
    known = starts.withColumn("prev", F.lit(None).cast(starts.schema["arc"].dataType)).where("cost < bound").groupBy(*key).agg(F.max("bound").alias("bound"), best)
    known = front = cut(known.select(*key, "bound", "m.*"))
    for _ in range(rounds):
        front = front.select(*key, "bound", "cost")
        onward = (steps(front) if callable(steps) else front.join(steps.withColumnRenamed("cost", "step"), at)).where(F.col("cost") + F.col("step") < F.col("bound"))
        onward = onward.select("query", *at[:-1], F.col("next").alias("arc"), "bound", (F.col("cost") + F.col("step")).alias("cost"), F.col("arc").alias("prev"))
        found = onward.groupBy(*key).agg(F.max("bound").alias("bound"), best).select(*key, "bound", "m.*")
        before = known.select(*key, F.col("cost").alias("old"))
        front = cut(found.join(before, key, "left").where("old is null or cost < old").drop("old"))
        if front.isEmpty():
            return known.select(*key, *rest)
        known = cut(known.join(front.select(*key), key, "left_anti").union(front))
    raise RuntimeError(f"searches did not end in {rounds} rounds")


def arcs(g: LineGraph) -> DataFrame:
    """(arc, edge_id, u, v, geom, length): every edge in both directions; the graph needs vertices."""
    both = F.explode(F.array(
        F.struct(F.lit(">").alias("s"), F.col("a").alias("u"), F.col("b").alias("v"), F.col("geom")),
        F.struct(F.lit("<").alias("s"), F.col("b").alias("u"), F.col("a").alias("v"), F.reverse("geom").alias("geom")),
    ))
    rows = g.edges.select("edge_id", both.alias("e"))
    return rows.select(F.concat(F.col("edge_id").cast("string"), F.col("e.s")).alias("arc"), "edge_id", "e.u", "e.v", "e.geom", geometry.length(F.col("e.geom")).alias("length"))


def travelled(g: LineGraph, directed: DataFrame) -> DataFrame:
    """(line_id, arc, edge_id, u, v): the arcs that each line may take."""
    rows = directed.select("arc", "edge_id", "u", "v").join(g.occs.select("edge_id", "line_id", "direction"), "edge_id")
    return rows.where("direction is null or direction = v").select("line_id", "arc", "edge_id", "u", "v")


def _turns(g: LineGraph, directed: DataFrame, angles: bool = True) -> DataFrame:
    """(line_id, node_id, arc, edge_a, next, edge_b, angle): turns between arcs of a line that no exception forbids.

    Without `angles` there is no angle, and vertices are not joined to every turn.
    """
    ride = travelled(g, directed)
    into = ride.select("line_id", F.col("v").alias("node_id"), "arc", F.col("edge_id").alias("edge_a"))
    out = ride.select("line_id", F.col("u").alias("node_id"), F.col("arc").alias("next"), F.col("edge_id").alias("edge_b"))
    pairs = into.join(out, ["line_id", "node_id"])
    if g.exceptions is not None:
        pairs = pairs.join(g.exceptions.select("node_id", "line_id", "edge_a", "edge_b"), ["node_id", "line_id", "edge_a", "edge_b"], "left_anti")
    if not angles:
        return pairs.select("line_id", "node_id", "arc", "edge_a", "next", "edge_b")
    at = g.nodes.select(F.col("node_id").alias("v"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    tail = directed.join(at, "v").select("arc", (F.element_at("geom", -2)["x"] - F.col("x0")).alias("ax"), (F.element_at("geom", -2)["y"] - F.col("y0")).alias("ay"))
    head = directed.join(at.withColumnRenamed("v", "u"), "u").select(F.col("arc").alias("next"), (F.get("geom", F.lit(1))["x"] - F.col("x0")).alias("bx"), (F.get("geom", F.lit(1))["y"] - F.col("y0")).alias("by"))
    angle = geometry.angle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return pairs.join(tail, "arc").join(head, "next").select("line_id", "node_id", "arc", "edge_a", "next", "edge_b", angle.alias("angle"))


def _price(penalty: float, full_turn: float):
    """What a turn costs on top of lengths; 0 if there is no penalty, so that no angle is needed."""
    return F.when(F.col("angle") < full_turn, penalty).otherwise(0.0) if penalty else F.lit(0.0)


def arc_steps(g: LineGraph, penalty: float = 0.0, full_turn: float = 0.0) -> DataFrame:
    """(line_id, arc, next, cost): each line's turns over the whole edges of a graph; never straight back."""
    g = with_geometry(g)
    directed = arcs(g)
    size = directed.select(F.col("arc").alias("next"), "length")
    turns = _turns(g, directed, bool(penalty)).where("edge_a <> edge_b").join(size, "next")
    return turns.select("line_id", "arc", "next", (F.col("length") + _price(penalty, full_turn)).alias("cost"))


# Turn restrictions


@dataclass(frozen=True)
class Inference:
    """How turns are looked up in the original graph, in units of the map.

    aggregate: how far edges were moved when they were merged; check: how far handles reach to either
    side; deviation: how much longer a way may be than expected; penalty and full_turn: what a turn
    sharper than so many degrees costs; reach: half the length over which a handle's slope is taken.
    """

    aggregate: float = 50.0
    check: float = 50.0
    deviation: float = 500.0
    penalty: float = 0.0
    full_turn: float = 0.0
    reach: float = 5.0


def across(p: Column, share: Column, half: float, reach: float) -> Column:
    """Struct x1, y1, x2, y2: the segment of twice `half` at right angles to a polyline at a share of its length."""
    total = F.greatest(geometry.length(p), F.lit(1e-12))

    def turned(e: Column) -> Column:
        ux, uy = F.when(e["d"] > 0, (e["b"]["x"] - e["a"]["x"]) / e["d"]).otherwise(F.lit(1.0)), F.when(e["d"] > 0, (e["b"]["y"] - e["a"]["y"]) / e["d"]).otherwise(F.lit(0.0))
        return F.struct((e["m"]["x"] - uy * half).alias("x1"), (e["m"]["y"] + ux * half).alias("y1"), (e["m"]["x"] + uy * half).alias("x2"), (e["m"]["y"] - ux * half).alias("y2"))

    spots = geometry.let(total, lambda n: F.struct(geometry.point_at(p, share).alias("m"), geometry.point_at(p, share - reach / n).alias("a"), geometry.point_at(p, share + reach / n).alias("b")))
    return geometry.let(spots, lambda s: geometry.let(F.struct(s["m"].alias("m"), s["a"].alias("a"), s["b"].alias("b"), geometry.distance(s["a"], s["b"]).alias("d")), turned))


def meetings(p: Column, s: Column) -> Column:
    """Points, structs x and y, at which a polyline meets a segment (struct x1, y1, x2, y2)."""
    n = F.size(p)
    ends = F.arrays_zip(F.slice(p, F.lit(1), n - 1).alias("a"), F.slice(p, F.lit(2), n - 1).alias("b"))
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]

    def one(e: Column) -> Column:
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        den = ex * dy - ey * dx
        t = ((s["x1"] - e["a"]["x"]) * dy - (s["y1"] - e["a"]["y"]) * dx) / F.nullif(den, F.lit(0.0))
        u = ((s["x1"] - e["a"]["x"]) * ey - (s["y1"] - e["a"]["y"]) * ex) / F.nullif(den, F.lit(0.0))
        hit = lambda c: F.when(c["t"].between(0, 1) & c["u"].between(0, 1), geometry.point(e["a"]["x"] + c["t"] * ex, e["a"]["y"] + c["t"] * ey))
        return geometry.let(F.struct(t.alias("t"), u.alias("u")), hit)

    return F.filter(F.transform(ends, one), lambda q: q.isNotNull())


def handles(g: LineGraph, original: LineGraph, origins: DataFrame, rules: Inference = Inference()) -> DataFrame:
    """(edge_id, side, original_id, pos): where the handles of edges meet the original edges that they stem from.

    An edge has a handle across it at a third (side a) and two thirds (side b).  An original edge is
    looked at if it meets a second segment, nearer to that end; it is cut where it meets the handle, or
    else that segment.  pos is a share of the original edge's length, from its a to its b.
    """
    now = g.edges.select("edge_id", F.col("geom").alias("p"))
    total = F.greatest(geometry.length(F.col("p")), F.lit(1e-12))
    near = F.least(total / 2, F.lit(2 * rules.aggregate)) / total
    line = lambda share: across(F.col("p"), share, rules.check, rules.reach)
    side = lambda s, at, test: F.struct(F.lit(s).alias("side"), line(F.lit(at)).alias("at"), line(test).alias("test"))
    sides = now.select("edge_id", F.explode(F.array(side("a", 1 / 3, near), side("b", 2 / 3, 1 - near))).alias("h")).select("edge_id", "h.side", "h.at", "h.test")
    sides = cut(sides)
    at = lambda c: original.nodes.select(F.col("node_id").alias(c), geometry.point(F.col("x"), F.col("y")).alias(f"p_{c}"))
    old = original.edges.join(at("a"), "a").join(at("b"), "b")
    old = old.select(F.col("edge_id").alias("original_id"), "geom", F.concat(F.array("p_a"), F.col("geom"), F.array("p_b")).alias("whole"))
    rows = sides.join(origins.select("edge_id", "original_id"), "edge_id").join(old, "original_id").withColumn("t", meetings(F.col("whole"), F.col("test"))).where(F.size("t") > 0)
    rows = rows.withColumn("m", meetings(F.col("whole"), F.col("at"))).withColumn("q", F.explode(F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("t"))))
    pos = geometry.nearest_on(F.col("geom"), F.col("q.x"), F.col("q.y"))["share"]
    return rows.select("edge_id", "side", "original_id", pos.alias("pos")).distinct()


def infer_restrictions(g: LineGraph, original: LineGraph, origins: DataFrame | None = None, rules: Inference = Inference()) -> LineGraph:
    """`g` with the exceptions that its lines' ways through the original graph imply.

    origins(edge_id, original_id) tells which original edges an edge was made of; by default the graph's
    own.  A line may turn
    between two edges of a node if, in the original graph, it gets from a handle of the one to a handle
    of the other, in either direction, by a way at most `deviation` longer than a third of both edges.
    Exceptions that would leave a line no way to go on from an edge are lifted again.
    """
    origins = g.origins if origins is None else origins
    if origins is None:
        raise ValueError("the graph tracks no origins, so they must be given")
    g, original = with_geometry(g), with_geometry(original)
    g = g.with_(edges=cut(g.edges))
    directed = cut(arcs(original))
    held = cut(handles(g, original, origins, rules))
    # The ends of edges at which a line is asked for, by number, and the pairs of them, from both sides.
    third = g.edges.select("edge_id", "a", (geometry.length(F.col("geom")) * 0.33).alias("third"))
    ends = g.incidence().select("edge_id", "node_id").join(third, "edge_id").join(g.occs.select("edge_id", "line_id", "direction"), "edge_id")
    inward = F.when(F.col("direction").isNotNull(), F.col("direction") == F.col("node_id"))
    ends = ends.select("line_id", "node_id", "edge_id", "third", F.when(F.col("a") == F.col("node_id"), "a").otherwise("b").alias("side"), inward.alias("inward"))
    ends = cut(numbered(ends, "line_id", "node_id", "edge_id", name="end"))
    one = ends.select("node_id", "line_id", F.col("end").alias("end_a"), F.col("third").alias("ta"), F.col("inward").alias("ia"))
    two = ends.select("node_id", "line_id", F.col("end").alias("end_b"), F.col("third").alias("tb"), F.col("inward").alias("ib"))
    wanted = one.join(two, ["node_id", "line_id"]).where("end_a <> end_b and (ia is null or ib is null or ia <> ib)")
    wanted = cut(wanted.select("end_a", "end_b", (F.col("ta") + F.col("tb")).alias("thirds")))
    # A ride is a line on an arc, by number; where its handles stand and which other rides it may turn to.
    rides = cut(numbered(travelled(original, directed).join(directed.select("arc", "length"), "arc"), "line_id", "arc", name="ride"))
    marks = held.join(directed.select("arc", F.col("edge_id").alias("original_id")), "original_id")
    marks = marks.select("arc", "edge_id", "side", F.when(F.col("arc").endswith("<"), 1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"))
    placed = marks.withColumn("i", F.row_number().over(Window.partitionBy("arc").orderBy("pos", "edge_id", "side")))
    stops = placed.join(rides.select("arc", "line_id", "ride", "length"), "arc").join(ends.select("end", "line_id", "edge_id", "side"), ["line_id", "edge_id", "side"])
    stops = cut(stops.select("end", "ride", "i", (F.col("pos") * F.col("length")).alias("along"), "length"))
    turns = _turns(original, directed, bool(rules.penalty)).join(marks.select("arc", F.lit(True).alias("cut")).distinct(), "arc", "left").where("edge_a <> edge_b or cut")
    ride = lambda arc, name: rides.select("line_id", F.col("arc").alias(arc), F.col("ride").alias(name))
    turns = turns.join(rides.select("line_id", "arc", F.col("ride").alias("from"), "length"), ["line_id", "arc"]).join(ride("next", "to"), ["line_id", "next"])
    turns = cut(turns.select(F.col("from").alias("arc"), F.col("to").alias("next"), "length", _price(rules.penalty, rules.full_turn).alias("price")))
    # A search knows what a ride costs from its beginning; handles lie along it.
    asked = wanted.groupBy(F.col("end_a").alias("query")).agg((F.max("thirds") + rules.deviation + 0.1).alias("bound"))
    begun = cut(asked.join(stops.withColumnRenamed("end", "query"), "query").select("query", "bound", F.col("ride").alias("arc"), "i", "along", "length"))
    onto = begun.join(turns.select("arc", "next", "price"), "arc").select("query", F.col("next").alias("arc"), "bound", (F.col("length") - F.col("along") + F.col("price")).alias("cost"))
    ways = cheapest(onto, turns.select("arc", "next", (F.col("length") + F.col("price")).alias("cost")), prev=False)
    there = stops.select(F.col("end").alias("end_b"), F.col("ride").alias("arc"), F.col("i").alias("i2"), F.col("along").alias("along2"))
    same = begun.join(there, "arc").where("i <= i2").select(F.col("query").alias("end_a"), "end_b", (F.col("along2") - F.col("along")).alias("cost"))
    other = ways.join(there, "arc").select(F.col("query").alias("end_a"), "end_b", (F.col("cost") + F.col("along2")).alias("cost"))
    found = wanted.join(same.union(other), ["end_a", "end_b"]).where(F.col("cost") - F.col("thirds") < rules.deviation).select("end_a", "end_b")
    either = found.union(found.select("end_b", "end_a")).distinct()
    missing = wanted.select("end_a", "end_b").join(either, ["end_a", "end_b"], "left_anti")
    named = lambda c: ends.select(F.col("end").alias(f"end_{c}"), "node_id", "line_id", F.col("edge_id").alias(f"edge_{c}"))
    missing = missing.join(named("a"), "end_a").join(named("b").drop("node_id", "line_id"), "end_b").select("node_id", "line_id", "edge_a", "edge_b")
    return lift_dead_ends(g.with_(exceptions=cut(missing)))


def lift_dead_ends(g: LineGraph) -> LineGraph:
    """Without the exceptions that leave a line no way to go on from an edge though others carry it.

    Edges of a line at a node are seen in the order of their names; once the exceptions of one are
    lifted, an edge that can go on to it keeps its own.  So the first such edge is freed, and those that
    are run in the same single direction as it, which cannot go on to it.
    """
    at = g.incidence().join(g.occs, "edge_id")
    at = at.select("node_id", "line_id", "edge_id", F.when(F.col("direction").isNotNull(), F.col("direction") == F.col("node_id")).alias("inward"))
    other = at.select("node_id", "line_id", F.col("edge_id").alias("edge_b"), F.col("inward").alias("ib"))
    pairs = at.withColumnRenamed("edge_id", "edge_a").withColumnRenamed("inward", "ia").join(other, ["node_id", "line_id"]).where("edge_a <> edge_b")
    barred = g.exceptions.select("node_id", "line_id", "edge_a", "edge_b", F.lit(True).alias("barred"))
    joined = pairs.join(barred, ["node_id", "line_id", "edge_a", "edge_b"], "left")
    goes = (F.col("ia").isNull() | F.col("ib").isNull() | (F.col("ia") != F.col("ib"))) & F.col("barred").isNull()
    stuck = joined.groupBy("node_id", "line_id", F.col("edge_a").alias("edge"), "ia").agg(F.max(goes).alias("goes")).where("not goes")
    first = stuck.groupBy("node_id", "line_id").agg(F.min(F.struct("edge", "ia")).alias("f"))
    freed = cut(stuck.join(first, ["node_id", "line_id"]).where("edge = f.edge or ia = f.ia").select("node_id", "line_id", "edge"))
    kept = g.exceptions
    for c in ("edge_a", "edge_b"):
        kept = kept.join(freed.withColumnRenamed("edge", c), ["node_id", "line_id", c], "left_anti")
    return g.with_(exceptions=kept.select("node_id", "line_id", "edge_a", "edge_b"))
