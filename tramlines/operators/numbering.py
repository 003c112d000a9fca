"""Numbers for rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def numbered(df: DataFrame, *order: str, name: str = "at") -> DataFrame:
    """`df` with the place of each row in the order of the columns, from 0.

    Rows are dealt out by ranges and cut there, so their ranges stay what they are if a task is lost;
    each range is numbered by itself, after the rows of the ranges before it.  Only the sizes of the
    ranges meet in one task.
    """
    keys = [F.col(c) for c in order]
    dealt = cut(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1)
    return inside.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_range", "_before", "_row")  # a row for each range
