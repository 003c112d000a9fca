"""Source mixing against a sequential version, its SQL, and awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tramlines.llm import mixing

from .conftest import awkward

SCHEMA = "doc_id long, text string, source string, size string, target string, lo int, digest string, key string, weight string"


def table(spark, rows):
    """(doc_id, text, source) with further columns of clashing names."""
    return spark.createDataFrame([(i, t, s, "x", "y", 1, "d", "k", "w") for i, t, s in rows], SCHEMA).repartition(3)


def shares(sizes, most=3):
    """Targets by the rule's own words: share, stop at the bound, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        add = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += add[s]
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def sequential(rows, mix=mixing.Mix()):
    """Multiset of (doc_id, source, size, taken): every source sorted whole."""
    by, sizes = defaultdict(list), Counter()
    for i, t, s in rows:
        t = t or ""
        digest = hashlib.md5(f"{mix.seed}:{'null' if i is None else i}:{t}".encode()).hexdigest()
        u = (int(digest[:13], 16) + 0.5) / 2**52
        solid = re.sub(r"[\x20\x09-\x0D]", "", t)
        w = mix.floor + (1 - mix.floor) * (len(re.sub(r"[\x00-\x40\x5B-\x60\x7B-\x7F]", "", t)) / len(solid) if solid else 0.0)
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        by[s].append((-math.log(u) / w, digest, i is not None, i, n))
        sizes[s] += n
    target, out = shares(sizes), Counter()
    for s, docs in by.items():
        epochs = int(target[s] // sizes[s] + 1e-12) if sizes[s] else 0
        budget = math.floor(target[s] - epochs * sizes[s] + 0.5)
        for *_, i, n in sorted(docs, key=lambda d: d[:3] + (d[3] or 0,)):
            part = max(0, min(n, budget))
            budget -= part
            out[i, s, n, epochs * n + part] += 1
    return out, target


@pytest.fixture
def small_slots(monkeypatch):
    """Few slots and short sorts, so that small tables take several rounds."""
    monkeypatch.setattr(mixing, "SLOTS", 4)
    monkeypatch.setattr(mixing, "SORTED_ROWS", 3)


@pytest.mark.parametrize("few", [True, False])
def test_plan_equals_sequential(spark, prose, small_slots, monkeypatch, few):
    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(i, prose(i, 5 + i * 7 % 60), "hot" if i % 3 else f"s{i % 5}") for i in range(200)]
    rows += [(i, t, "odd") for i, t in awkward(prose)] + [(None, "some words", None), (None, None, None), (900, "tiny", "z"), (None, "some words", None)]
    rows += [(950, "the same row", "same")] * 20
    got = mixing.plan(table(spark, rows)).collect()
    want, target = sequential(rows)
    assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == want
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]]) and r["taken"] <= 3 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in taken)


def test_excess_is_shared_again(spark):
    """A source of three words stops at nine; what it leaves goes to the others by weight."""
    rows = [(1, "a b c", "b"), (2, " ".join("w" * 1 for _ in range(60)), "a"), (3, " ".join("v" for _ in range(37)), "c")]
    got = {r["source"]: r["target"] for r in mixing.plan(table(spark, rows)).collect()}
    assert got == {"a": 22.75, "b": 9.0, "c": 68.25}


def test_given_weights(spark):
    rows = [(1, "a b c d", "x"), (2, "a b", "y"), (3, "a b c", "z")]
    weights = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "source string, weight double")
    got = {r["source"]: r["target"] for r in mixing.plan(table(spark, rows), weights=weights).collect()}
    assert got == {"x": 4.5, "y": 4.5, "z": 0.0}
    alone = spark.createDataFrame([("y", 2.0)], "source string, weight double")
    assert {r["source"]: r["target"] for r in mixing.plan(table(spark, rows), weights=alone).collect()} == {"x": 0.0, "y": 6.0, "z": 0.0}


def test_better_texts_are_taken_oftener(spark):
    """Of texts of letters and of symbols, alike in size, the sample takes more of the former."""
    rows = [(i, ("word " if i % 2 else "#1$2 ") * 20, "a") for i in range(600)] + [(1000 + i, "filler " * 20, "b") for i in range(100)]
    got = mixing.plan(table(spark, rows)).where("source = 'a'").collect()
    good = sum(r["taken"] for r in got if r["doc_id"] % 2)
    assert sum(r["taken"] for r in got) == 8000 and good > 0.95 * 6000  # 400 of 600 documents, nearly all 300 good ones


def test_texts_hold_the_taken_words(spark, prose):
    rows = [(i, prose(i, 3 + i % 9), f"s{i % 4}") for i in range(40)] + [(50, "one two\n three ", "tiny"), (50, "one two\n three ", "tiny")]
    docs = table(spark, rows)
    planned = mixing.plan(docs)
    mixed = mixing.texts(docs, planned).collect()
    by = Counter()
    for r in mixed:
        by[r["doc_id"]] += len(r["text"].split())
    want = Counter()
    for r in planned.collect():
        want[r["doc_id"]] += r["taken"]
    assert by == +want
    bodies = {i: t for i, t, _ in rows}
    assert all(bodies[r["doc_id"]].startswith(r["text"]) for r in mixed)


def test_empty_and_reruns(spark, prose):
    assert mixing.plan(table(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.plan(table(spark, [(1, None, None), (2, " ", None)])).collect()] == [0, 0]
    rows = [(i, prose(i, 20), f"s{i % 3}") for i in range(90)]
    first = {(r["doc_id"], r["taken"]) for r in mixing.plan(table(spark, rows)).collect()}
    assert first == {(r["doc_id"], r["taken"]) for r in mixing.plan(table(spark, rows[::-1]).repartition(7)).collect()}


def test_sql_agrees_on_awkward_rows(spark, prose):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in awkward(prose)] + [(None, "null id", None)]
    docs = table(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = Counter(con.sql(mixing.oracle_sql()).fetchall())
    columns = "doc_id source size source_size target taken".split()
    assert Counter(tuple(r) for r in mixing.plan(docs).select(columns).collect()) == want


def test_no_python_in_the_plan(spark, make):
    plan = mixing.measured(make([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
