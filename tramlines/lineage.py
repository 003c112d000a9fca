"""Cutting lineage between the rounds of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """`df` as a table of its own: the plan starts anew there and survives lost executors.

    It is written once, as Parquet; a checkpoint computes its last stage twice, to count and to write it,
    and holds whole rows.  The folder is one in that which spark.checkpoint.dir names; only in a local
    session (tests) a folder of this machine takes its place where that is unset.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='tramlines-')}")
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
