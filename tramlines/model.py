"""The table bundle that every stage reads and returns.

A line graph is a simple undirected graph whose edges carry lines.  It is held as DataFrames:

* ``nodes(node_id, x, y)``, with further columns as a source provides them;
* ``edges(edge_id, a, b)`` with a < b, at most one row for a pair of nodes, and where a source has
  them the vertices ``geom``, an array of structs x, y from a to b;
* ``occs(edge_id, line_id, direction, n)``: a line on an edge, towards node `direction` or both
  ways (null), seen n times;
* ``exceptions(node_id, line_id, edge_a, edge_b)``: a line may not turn between two edges; both
  orders of a pair are kept;
* ``origins(edge_id, original_id)``, where they are tracked: the edges of an earlier graph that an edge
  was made of.  Stages that rename, merge or cut edges carry it along;
* ``held(node_id, edge_id, line_id, direction, n)``, where a source has it: a row for each line at each
  end of its edge, as `attached` gives.  A copy with other edges or lines goes without.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineGraph:
    """DataFrames of one line graph; stages return a changed copy."""

    nodes: DataFrame
    edges: DataFrame
    occs: DataFrame
    exceptions: DataFrame | None = None
    origins: DataFrame | None = None
    held: DataFrame | None = None

    def tracked(self) -> LineGraph:
        """The graph with every edge as its own origin: later stages are traced back to this one."""
        return self.with_(origins=self.edges.select("edge_id", F.col("edge_id").alias("original_id")))

    def traced(self, moves: DataFrame, rest: bool = True) -> DataFrame | None:
        """Origins after moves(edge_id, to): an edge may go over to several and several to one.

        Edges without a move stay, or are gone if `rest` is false.
        """
        if self.origins is None:
            return None
        moved = self.origins.join(moves.select("edge_id", "to"), "edge_id", "left" if rest else "inner")
        return moved.select(F.coalesce("to", "edge_id").alias("edge_id"), "original_id").distinct()

    def with_(self, **tables: DataFrame) -> LineGraph:
        if "held" not in tables and ("edges" in tables or "occs" in tables):
            tables["held"] = None
        return replace(self, **tables)

    def attached(self) -> DataFrame:
        """(node_id, edge_id, line_id, direction, n): one row for each line at each end of its edge."""
        if self.held is not None:
            return self.held
        return self.incidence().join(self.occs, "edge_id").select("node_id", "edge_id", "line_id", "direction", "n")

    def incidence(self) -> DataFrame:
        """(edge_id, node_id, other): one row for each end of each edge."""
        ends = F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("other"))))
        return self.edges.select("edge_id", ends.alias("end")).select("edge_id", "end.node_id", "end.other")


def edge_key(a, b):
    """The name of the edge between two nodes, the same from either side.

    A hyphen inside a node's name is escaped, so different pairs have different names.
    """
    name = lambda c: F.when(F.locate("-", c.cast("string")) > 1, F.regexp_replace(c.cast("string"), "(?<!^)-", r"\\-")).otherwise(c.cast("string"))
    return F.concat_ws("-", name(F.least(a, b)), name(F.greatest(a, b)))


def with_geometry(g: LineGraph) -> LineGraph:
    """Every edge with vertices: straight from node to node where the source has none."""
    at = lambda c: g.nodes.select(F.col("node_id").alias(c), F.struct("x", "y").alias(f"p_{c}"))
    rows = g.edges.join(at("a"), "a").join(at("b"), "b")
    straight = F.array("p_a", "p_b")
    geom = F.coalesce("geom", straight) if "geom" in g.edges.columns else straight
    return g.with_(edges=rows.withColumn("geom", geom).select("edge_id", "a", "b", "geom"))
