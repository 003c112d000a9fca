"""Near-duplicates, repeats and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import awkward
from tramlines.llm import components, neardup, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in up}, {i: len(s) for i, s in sets}


def altered(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(make, prose, k):
    base, other = prose(1, 150), prose(2, 90)
    rows = [(i, t) for i, t in awkward(prose) if i != 7] + [(100 + i, altered(base, i, 0.004 * (i % 12))) for i in range(150)]
    rows += [(400 + i, base.upper()) for i in range(40)] + [(500 + i, altered(other, i, 0.02)) for i in range(40)] + [(600 + i, prose(600 + i, 60)) for i in range(40)] + [(700, "one two three"), (701, "ONE two\nthree"), (702, "one two")]
    out = {r.doc_id: r for r in neardup.near_duplicates(make(rows), neardup.NearDup(k=k)).collect()}
    want, sizes = brute_components(rows, k)
    assert {i: (r.component_id, r.n_shingles) for i, r in out.items()} == {i: (c, sizes[i]) for i, c in want.items()}
    assert all(r.kept == (i == r.component_id) for i, r in out.items())


def test_near_duplicates_repeated_ids_and_empty(make, prose):
    rows = [(7, prose(7, 80)), (7, prose(7, 80)), (3, prose(7, 80)), (5, None), (5, None)]
    out = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(make(rows)).collect())
    assert out == [(3, 3, True), (5, 5, True), (5, 5, True), (7, 3, False), (7, 3, False)]
    assert neardup.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("block", [1 << 16, 1 << 10])
def test_one_large_group_of_near_copies(make, prose, block):
    """Copies on either side of the threshold around one text, in one block and in many."""
    base = prose(1, 150)
    rows = [(1, base)] + [(i, altered(base, i // 3, 0.004 * (i % 25))) for i in range(2, 1500)]  # every third shares its edits
    out = {r.doc_id: r.component_id for r in neardup.near_duplicates(make(rows), neardup.NearDup(k=4, block_shingles=block)).collect()}
    assert out == brute_components(rows, 4)[0]
    assert len(set(out.values())) > 100


def test_near_duplicates_of_ids_with_two_texts_and_of_null_ids(make, prose):
    one, two = prose(1, 150), prose(2, 150)
    rows = [(1, one), (1, two), (2, altered(one, 1, 0.01)), (3, altered(two, 1, 0.01)), (None, one), (None, None), (2**60 + 1, two), (4, None)]
    rows += [(10 + i, altered(one, i, 0.09)) for i in range(30)] + [(50 + i, altered(two, i, 0.09)) for i in range(30)]
    out = neardup.near_duplicates(make(rows), neardup.NearDup(k=4)).collect()
    assert len(out) == len(rows)
    assert {r.component_id for r in out if r.doc_id in (1, 2, 3, 2**60 + 1)} == {1}
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None) and any(r.doc_id == 2**60 + 1 for r in out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    links = spark.createDataFrame(pairs, "u long, v long") if pairs else spark.createDataFrame([], "u long, v long")
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in pairs:
        if u != v:
            p, q = top(u), top(v)
            up[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {x: top(x) for x in up}


# repeats


def brute_repeats(rows, width=50):
    first = {}
    out = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - width + 1):
            w = data[p : p + width]
            if first.setdefault(w, i) < i:
                gone[p : p + width] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("chunk", "bucket"), [(1 << 22, 1 << 20), (3000, 200)])
def test_remove_repeats(make, prose, chunk, bucket):
    passage, short = prose(999, 30), "é" * 24 + "ab"
    rows = awkward(prose) + [(100 + i, prose(i, 20) + passage[i % 9 : -1 - i % 4] + prose(i + 50, 20)) for i in range(30)]
    rows += [(200, short), (201, "x" + short), (202, short[1:]), (203, "y" * 49), (204, "y" * 51), (205, "ab" * 80), (206, "ba" * 80), (207, passage), (208, passage + passage)]
    out = sorted(tuple(r) for r in repeats.remove_repeats(make(rows), chunk_bytes=chunk, bucket_anchors=bucket).collect())
    assert out == sorted(brute_repeats(rows))


@pytest.mark.parametrize("seed", range(4))
def test_remove_repeats_small_alphabet(make, seed):
    """Two letters: many repeats of every length, ties of anchors, overlapping matches."""
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randrange(20, 90))) for _ in range(6)] + ["a" * 70]
    rows = [(i // 2 if i % 5 == 0 else i, "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))) for i in range(60)]
    out = sorted(tuple(r) for r in repeats.remove_repeats(make(rows), chunk_bytes=700, bucket_anchors=50).collect())
    assert out == sorted(brute_repeats(rows))


def test_remove_repeats_text_and_empty(make, prose):
    t = prose(1, 40)
    kept = {r.doc_id: r.kept_text for r in repeats.remove_repeats(make([(1, t), (2, "é" + t + "ü")]), with_text=True).collect()}
    assert kept == {1: t, 2: "éü"} and repeats.remove_repeats(make([])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25))
def test_interval_tree(lcp):
    got = repeats.lcp_intervals(np.array(lcp, np.int64), 2)
    want = set()
    for i in range(len(lcp)):
        for j in range(i, len(lcp)):
            low = min(lcp[i : j + 1])
            if low >= 2 and (i == 0 or lcp[i - 1] < low) and (j + 1 == len(lcp) or lcp[j + 1] < low):
                want.add((low, i, j + 1))
    assert {x[:3] for x in got} == want and len(got) == len(want)
    for depth, a, b, parent in got:
        around = [g for g in got if g[1] <= a and g[2] >= b and g[0] < depth]
        assert (parent == -1) == (not around) and (parent == -1 or got[parent][0] == max(g[0] for g in around))


def test_repeat_groups_are_left_maximal():
    texts = [b"xAAAABBBB", b"yAAAABBBB", b"zBBBB"]
    rows, docs, lefts = [], [], []
    for d, t in enumerate(texts):
        for p in range(len(t)):
            rows.append(np.frombuffer(t[p:].ljust(9, b"\0"), np.uint8))
            docs.append(d)
            lefts.append(t[p - 1] if p else 0)
    first, groups = repeats.repeat_groups(np.array(rows), np.array(docs), np.array(lefts, np.uint8), 4)
    found = collections.Counter((g["depth"] if g["depth"] < 9 else 9, len(g["members"])) for g in groups)
    assert (8 if (8, 2) in found else 9, 2) in found and any(len(g["members"]) == 3 for g in groups)
    assert not any(g["depth"] == 7 and len(g["members"]) == 2 for g in groups)  # always preceded by the same byte
    assert first[list(map(bytes, rows)).index(texts[1][1:].ljust(9, b"\0"))] == 0


# pipeline


def test_pipeline(spark, make, prose, tmp_path):
    import corpus_pipeline as P

    passage = prose(777, 70)
    item = prose(888, 30)
    rows = [(i, prose(i, 120)) for i in range(1, 40)]
    rows += [(50 + i, prose(300 + i, 60) + " you vile blockhead") for i in range(30)] + [(90, prose(1, 120)), (91, prose(2, 120).replace(prose(2, 120).split()[60], "changed", 1)), (92, prose(92, 60) + " " + passage), (93, prose(93, 60) + " " + passage), (94, prose(94, 50) + " " + item), (95, None), (96, "")]
    docs = make(rows).select("doc_id", "text", "lang", "source", "n_chars")
    d = f"{tmp_path}"
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(50 <= i < 80)) for i in [*range(1, 40), *range(50, 80)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    state = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, state, d)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/{name}")
        state = spark.read.parquet(f"{d}/{name}")
        kept.append({r.doc_id: r.text for r in state.collect()})
    assert set(kept[0]) == {i for i, _ in rows if not 50 <= i < 80}
    assert set(kept[0]) - set(kept[1]) == {90, 91}
    assert kept[2][92] == dict(rows)[92] and kept[2][93] == prose(93, 60) and set(kept[2]) == set(kept[1])
    assert set(kept[2]) - set(kept[3]) == {94}
    packed = P.run(spark, d)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept[3])
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "suffix_array_dedup", "decontamination", "packing"]
