"""The filter audit against 120 plain runs over the documents, its SQL, and awkward rows."""

from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tramlines.llm import filter_audit

from .conftest import awkward

DOCS = "doc_id long, text string, lang string, part string, fails int, good string, n string, digest string"
COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, "p", 1, "g", "n", "d") for i, t, lang in rows], DOCS).repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain(rows, labels):
    """Every order applied to every document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            bad.add("C")
        if any(c in "#$%&*|" for c in t):
            bad.add("D")
        if i is not None and first[t] < i:
            bad.add("E")
        docs.append((lang or "", bad, i in good, i in toxic))
    out, worth = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[0]]
                gone = sum(f in d[0] for d in mine) - len(lost)
                left = [d for d in left if f not in d[0]]
                out[part, "".join(order), step] = [len(left), len(lost), gone, sum(d[0] == {f} for d in mine), sum(d[1] for d in lost), sum(d[2] for d in lost)]
                worth[part, f] += len(lost)
    return {(*k, *v, worth[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def case(prose):
    rows = [(i, t, ["en", None, "", "de"][i % 4]) for i, t in awkward(prose)]
    rows += [(100 + i, prose(i // 3, 150 + 40 * (i % 4)), ["en", "de"][i % 2]) for i in range(60)]
    rows += [(200 + i, "SHOUT " * 300 if i % 2 else prose(i, 400, 5000) + "#" * (i % 3), "en") for i in range(12)]
    rows += [(None, prose(0, 150), "en"), (None, None, None), (90, prose(0, 150), "fr"), (90, prose(0, 150), "fr"), (90, prose(0, 150), "en")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 230, 2)] + [(2, 1, 1), (102, 1, 1), (None, 1, 1), (104, None, None)]
    return rows, labels


def test_equals_plain_runs(spark, case):
    got = filter_audit.audit(*tables(spark, *case)).select(COLUMNS).collect()
    assert len(got) == len({tuple(r) for r in got}) == 600 * len({lang or "" for _, _, lang in case[0]})
    assert {tuple(r) for r in got} == plain(*case)


def test_sql_agrees_but_for_null_ids(spark, case):
    rows = [r for r in case[0] if r[0] is not None]
    docs, labels = tables(spark, rows, case[1])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    want = con.sql(f"select {', '.join(COLUMNS)} from ({filter_audit.ORACLE_SQL})").fetchall()
    assert set(want) == {tuple(r) for r in filter_audit.audit(docs, labels).select(COLUMNS).collect()}


def test_eighty_edges_and_orders(spark, case):
    docs, labels = tables(spark, *case)
    edges = filter_audit.edges(filter_audit.histogram(docs, labels))
    assert {r["count"] for r in edges.groupBy("part").count().collect()} == {80}
    assert edges.groupBy("part", "filter").sum("paths").select("sum(paths)").distinct().collect()[0][0] == 120
    assert filter_audit.orders(spark).count() == 600


def test_empty(spark):
    docs, labels = tables(spark, [], [])
    assert filter_audit.audit(docs, labels).count() == 0
    docs, labels = tables(spark, [(1, None, None)], [])
    assert {(r["part"], r["kept"]) for r in filter_audit.audit(docs, labels).where("step = 5").collect()} == {("", 0)}


@pytest.mark.parametrize("text, mask", [(b"", 1), (b"A b", 1 | 4), (b"#", 1 | 8), (b"a a a", 1 | 2), ("é ".encode() * 200, 2), (b"a b\x0bc\x0cd", 1), ("a b c".encode(), 1)])
def test_bits(text, mask):
    assert filter_audit.fails(text) == mask
