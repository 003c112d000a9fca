"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms (lower-cased words cut at white space and ASCII
punctuation, and the first five bytes of longer words).  The score is the logistic of

    w0 + sum of w[t] + sum over pairs of terms of <v[s], v[t]>

so an insult beside a group's mention can weigh more than both alone.  The pair sum takes linear
time by the usual identity.  The machine is fitted on a bounded sample of labelled documents: at
most `per_class` of each label, those of least hashed id.  Every term of the sample carries a weight
and a factor.  As the labels are sampled apart, w0 is set back by the log of the ratio of their
sampled shares, so a score means the same for any number of labels.  Scores read the text alone.

Edge cases: a null or empty text has no terms and scores the logistic of w0; very long texts are
sets like any other; repeated label rows count once, by the largest label; without labels of both
kinds every score is the share of toxic labels smoothed towards one half; an empty table gives an
empty result; other columns of the inputs are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X

BITS = 20


@dataclass(frozen=True)
class Machine:
    """slot: hashed term -> row of w and v, or -1."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray


#: Bytes of a machine in one row between its task and the driver: small rows leave no large objects in a heap.
PART_BYTES = 1 << 18


def pressed(m: Machine) -> bytes:
    """A machine for transport: terms, weights and factors (in half precision), compressed."""
    terms = np.flatnonzero(m.slot >= 0).astype(np.int32)
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((terms, m.w0, m.w.astype(np.float32), m.v.astype(np.float16))))


def opened(body: bytes) -> Machine:
    terms, w0, w, v = pickle.loads(zstandard.ZstdDecompressor().decompress(body))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[terms] = np.arange(len(terms))
    return Machine(slot, w0, w, v.astype(np.float32))


@dataclass(frozen=True)
class Fit:
    """Bounds and learning settings.

    Weights of terms whose association with a label (chi-squared) exceeds `least_chi` start at the
    terms' log-odds, the others at 0; all are learned.
    """

    per_class: int = 6000
    terms: int = 1 << BITS
    factors: int = 8
    epochs: int = 40
    rate: float = 0.2
    l2: float = 2e-4
    least_chi: float = 28.0
    start: float = 0.8
    seed: int = 7


def doc_terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed term) of every term of every text, repeats included."""
    low = X.lower_ascii(data)
    start, end, bounds = X.word_spans(low, offs, punctuation=True)
    prefix = X.prefix_hashes(low)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    long_ = end - start > 5
    heads = X.mix(X.span_hashes(prefix, start[long_], start[long_] + 5) + X.U64(1))
    term = np.concatenate([X.span_hashes(prefix, start, end), heads]) >> X.U64(64 - BITS)
    return np.concatenate([text, text[long_]]), term.astype(np.int64)


def _sets(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(text * (1 << BITS) + term)
    return key >> BITS, key & ((1 << BITS) - 1)


def _forward(m: Machine, rows: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of n documents whose terms are rows (of w and v), and the sums of v."""
    sums = np.zeros((n, m.v.shape[1]))
    squares = np.zeros(n)
    linear = np.bincount(owner, m.w[rows], n)
    if len(rows):
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sums[owner[at]] = np.add.reduceat(m.v[rows], at, 0)
        squares[owner[at]] = np.add.reduceat((m.v[rows] ** 2).sum(1), at)
    return m.w0 + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def fit(doc: np.ndarray, term: np.ndarray, label: np.ndarray, how: Fit, ratio: float = 1.0) -> Machine:
    """Fit on documents 0..len(label)-1 given as (doc, term) pairs sorted by document.

    ratio: the sampled share of the toxic labels over that of the clean ones.
    """
    slot = np.full(1 << BITS, -1, np.int32)
    n, pos = len(label), int(label.sum())
    prior = np.log((pos + 1) / (n - pos + 1))
    if not 0 < pos < n:
        return Machine(slot, prior - np.log(ratio), np.zeros(0), np.zeros((0, how.factors)))
    yes = np.bincount(term[label[doc] == 1], minlength=1 << BITS)
    df = np.bincount(term, minlength=1 << BITS)
    a, b = yes, df - yes
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(df >= 2, n * (a * (n - pos - b) - b * (pos - a)) ** 2.0 / (df * (n - df + 1e-9) * pos * (n - pos)), 0)
    chosen = np.flatnonzero(df)
    chosen = np.sort(chosen[np.argsort(-chi[chosen], kind="stable")[: how.terms]])
    slot[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(how.seed)
    # Weights start at, and are drawn towards, the terms' smoothed log-odds: rare but one-sided terms count.
    odds = np.log((a[chosen] + 0.25) / (pos + 0.5) * (n - pos + 0.5) / (b[chosen] + 0.25))
    odds *= how.start * (chi[chosen] > how.least_chi)
    m = Machine(slot, prior, odds.copy(), rng.normal(0, 0.02, (len(chosen), how.factors)).astype(np.float32))
    use = slot[term] >= 0
    doc, rows = doc[use], slot[term[use]]
    cuts = np.searchsorted(doc, np.arange(n + 1))
    # First steps are small enough for all terms of a document to take them at once.
    first = (how.rate * len(doc) / n) ** 2
    g0, gw, gv = 1e-8, np.full(len(chosen), first), np.full(m.v.shape, first, np.float32)
    w0 = m.w0
    # Batches are dealt once, so that their terms are sorted once, and come in another order each epoch.
    batches = []
    for part in np.array_split(rng.permutation(n), max(1, n // 128)):
        size = cuts[part + 1] - cuts[part]
        idx = np.repeat(cuts[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
        r, owner = rows[idx], np.repeat(np.arange(len(part), dtype=np.int32), size)
        by = np.argsort(r, kind="stable")
        at = np.flatnonzero(np.append(True, r[by][1:] != r[by][:-1]))
        batches.append((part, r, owner, owner[by], at, r[by][at] if len(r) else r))
    for _ in range(how.epochs):
        for b in rng.permutation(len(batches)):
            part, r, owner, sorted_owner, at, u = batches[b]
            z, sums = _forward(Machine(slot, w0, m.w, m.v), r, owner, len(part))
            err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label[part]
            d0 = err.sum()
            g0 += d0 * d0
            w0 -= how.rate * d0 / np.sqrt(g0)
            if not len(r):
                continue
            total = np.add.reduceat(err[sorted_owner], at)
            dw = total + how.l2 * len(part) * (m.w[u] - odds[u])
            pulls = (err[:, None] * sums).astype(np.float32)
            dv = np.add.reduceat(pulls[sorted_owner], at, 0) + m.v[u] * (how.l2 * len(part) - total).astype(np.float32)[:, None]
            gw[u] += dw**2
            gv[u] += dv**2
            m.w[u] -= how.rate * dw / np.sqrt(gw[u])
            m.v[u] -= 0.25 * how.rate * dv / np.sqrt(gv[u])
    return Machine(slot, float(w0 - np.log(ratio)), m.w.astype(np.float32), m.v)


def train(docs: DataFrame, labels: DataFrame, learn: Column, how: Fit = Fit()) -> Machine:
    """Fit on the labelled documents for which `learn`, an expression over doc_id, holds."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    labels = labels.where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in labels.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    share = [min(1.0, how.per_class / max(1, total.get(t, 0))) for t in (0, 1)]
    ranked = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = labels.where("toxic = 1").orderBy(*ranked).limit(how.per_class).union(labels.where("toxic = 0").orderBy(*ranked).limit(how.per_class))
    sample = X.documents_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in X.slices(batch.column(1)):
                text, term = _sets(*doc_terms(data, offs))
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                sets = [term[cuts[i] : cuts[i + 1]].astype("<i4").tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sets, pa.binary())], ["doc_id", "toxic", "terms"])

    def learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["toxic"], r["terms"]) for b in batches for r in b.to_pylist())
        sets = [np.frombuffer(r[2], "<i4").astype(np.int64) for r in rows]
        doc = np.repeat(np.arange(len(rows)), [len(s) for s in sets])
        m = fit(doc, np.concatenate(sets) if sets else np.zeros(0, np.int64), np.array([r[1] for r in rows], np.int64), how, share[1] / share[0])
        body = pressed(m)
        del rows, sets, doc, m
        X.release_memory()
        for i, at in enumerate(range(0, len(body), PART_BYTES)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([body[at : at + PART_BYTES]], pa.binary())], ["part", "machine"])

    # At most 2 * per_class rows meet in the one task that fits.
    fitted = sample.mapInArrow(terms, "doc_id long, toxic int, terms binary").repartition(1).mapInArrow(learner, "part long, machine binary").collect()
    return opened(b"".join(r.machine for r in sorted(fitted, key=lambda r: r.part)))


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score, between 0 and 1, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(pressed(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared.value)
        for batch in batches:
            for a, b, data, offs in X.slices(batch.column(1)):
                text, term = doc_terms(data, offs)
                use = m.slot[term] >= 0
                text, term = _sets(text[use], term[use])
                z, _ = _forward(m, m.slot[term], text, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return X.documents_of(docs).mapInArrow(run, "doc_id long, score double")


def remainder(divisor: int) -> Column:
    """CRC-32 of the id as text, modulo `divisor`: the folds of training and held-out documents.

    A null id counts as an empty text, whose CRC-32 is 0, so its row is no held-out one.
    """
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor
