"""Rows without an id belong to a fold, and intermediate tables need a shared folder on a cluster."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tramlines.llm import textops, toxicity


def test_folds_of_null_ids(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (77,)], "doc_id long")
    got = {r.doc_id: r.fold for r in df.withColumn("fold", toxicity.remainder(7)).collect()}
    assert got[None] == 0 and all(v is not None for v in got.values())
    assert df.where(toxicity.remainder(3) != 1).where(F.col("doc_id").isNull()).count() == 1


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        textops.shared_dir(SimpleNamespace(conf=conf, sparkContext=context), "x")
