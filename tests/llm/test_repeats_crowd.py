"""Anchors with very many distinct segments."""

import collections
import random
from types import SimpleNamespace

import pyarrow as pa

from tests.llm.test_dedup_operators import brute_repeats
from tramlines.llm import repeats


def crowd_rows(n):
    rng = random.Random(5)
    line = " this common line of the footer stands in every document here "
    side = lambda: "".join(rng.choice("abcdefgh ") for _ in range(40))
    return [(i, side() + line + side()) for i in range(n)] + [(n + 1, "x" * 300), (n + 2, "x" * 300)]


def test_crowded_anchors_equal_brute_force(make):
    rows = crowd_rows(120)
    want = sorted(brute_repeats(rows))
    for crowd in (0, 5, 50, 10_000):
        out = repeats.remove_repeats(make(rows), chunk_bytes=2000, bucket_anchors=300, crowd=crowd).collect()
        assert sorted(tuple(r) for r in out) == want, crowd


def test_crowded_anchor_never_meets_in_one_matrix(monkeypatch):
    """The steps in one process: the largest matrix of suffixes does not grow with an anchor's segments."""
    sizes = []
    whole = repeats.repeat_groups
    monkeypatch.setattr(repeats, "repeat_groups", lambda rows, *a: (sizes.append(len(rows)), whole(rows, *a))[1])
    monkeypatch.setattr(repeats, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = crowd_rows(3000)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    width, k, buckets = 50, 26, 3
    chunks = pa.Table.from_batches(repeats._chunks(repeats.CHUNK_BYTES)([batch]))
    group = lambda t: [t.filter(pa.compute.equal(t["bucket"], b)) for b in sorted(set(t["bucket"].to_pylist()))]
    asked = pa.Table.from_batches(repeats._ask(width, k, buckets)(chunks.to_batches()))
    answers = collections.defaultdict(list)
    for t in group(asked):
        for r in repeats._seen_elsewhere(repeats.CROWD_RUNS)(t).to_pylist():
            answers[r["chunk"]].append(r)
    known = chunks.append_column("answers", pa.array([answers[c] for c in chunks["chunk"].to_pylist()]))
    sent = pa.Table.from_batches(repeats._send(width, k, buckets)(known.to_batches()))
    for t in group(sent):
        repeats._judge_segments(width, k)(t)
    assert max(sizes, default=0) <= 25 * 1024
