"""Line occurrences of a running stream of hops, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import edge_key
from ..operators.aggregate import fold_direction


def windowed_occurrences(hops: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, edge_id, line_id, direction, n) of a stream (ts, from_node, to_node, line_id).

    Hops later than `late` are dropped; state is kept for open windows only.  The same code serves
    a batch table.
    """
    rows = hops.where("from_node <> to_node").withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", window), edge_key(F.col("from_node"), F.col("to_node")).alias("edge_id"), "line_id").agg(fold_direction(F.col("to_node")).alias("direction"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "edge_id", "line_id", "direction", "n")
