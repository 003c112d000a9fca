"""The pipeline on awkward tables: nulls, repeats, long and empty texts, extra columns, no rows."""

import collections

import corpus_pipeline
from tests.llm.conftest import awkward


def tables(spark, make, folder, rows, labels=(), items=()):
    make(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def test_pipeline_takes_awkward_rows(spark, make, prose, tmp_path):
    leak = prose(77, 30)
    rows = awkward(prose) + [(None, prose(50, 60)), (None, None), (2**60 + 1, prose(51, 60)), (20, prose(52, 60)), (20, prose(53, 60)), (30, prose(54, 40) + " " + leak), (31, "utter vermin " + prose(55, 50))]
    labels = [(100 + i, 1, 0) for i in range(3)] + [(31, 0, 1), (31, 0, 1), (6, 1, 0), (None, 0, 1)]
    sf = tables(spark, make, tmp_path, rows, labels, [(1, leak), (2, None)])
    out = corpus_pipeline.run(spark, sf).collect()
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    # Copies of the text of 7 go, but not its own rows; the leak goes; what has no id stays.
    assert 30 not in pieces and 8 not in pieces
    assert {2**60 + 1, None, 6, 20} <= set(pieces)
    assert sum(r.piece == 0 for r in pieces[20]) == 2 and sum(r.piece == 0 for r in pieces[None]) == 2
    fill = collections.Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_pipeline_of_nothing(spark, make, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, make, tmp_path, [])).count() == 0


def test_stages_return_the_columns_of_documents(spark, make, prose, tmp_path):
    sf = tables(spark, make, tmp_path, awkward(prose))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
