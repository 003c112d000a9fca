"""Rows that repeat an id, and rows without one."""

from tramlines.llm import repeats

BIG = (1 << 53) + 1


def test_rows_of_one_id_keep_their_own_texts(spark, make, prose):
    import corpus_pipeline as P

    first, clean, tail = prose(1, 40), prose(2, 40), prose(3, 40)
    rows = [(1, first), (5, first), (5, clean), (5, first + " " + tail), (5, None), (6, clean), (None, first), (None, clean + "!")]
    out = [(r.doc_id, r.text) for r in P.cut_repeats(spark, make(rows), "").collect()]
    want = [(1, first), (5, clean), (5, " " + tail), (5, None), (None, first), (None, clean + "!")]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_null_ids_are_last_and_large_ids_exact(spark, prose):
    text = prose(1, 40)
    rows = [(None, text), (BIG, text), (BIG + 2, text), ((1 << 63) - 1, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    n = len(text.encode())
    out = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs).collect()), key=str)
    assert out == sorted([(None, n, n), (BIG, n, 0), (BIG + 2, n, n), ((1 << 63) - 1, 5, 0)], key=str)
