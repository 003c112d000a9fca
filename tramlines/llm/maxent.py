"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are lower-cased words and one end token a text.  Three kinds of statistics are kept:

* the count of every distinct training token, exact, in a table as large as the vocabulary;
* a bounded `head` of the most frequent tokens, which is broadcast;
* the model: the `words` most frequent tokens in a tree of classes by frequency, and the other tokens
  in classes by the shape of their letters.

P(token) = P(group or shape | context) * P(class | group, context) * P(word | class, context).  Each
factor is a softmax over its frequencies' logarithms plus the sum of hashed rows, one for each feature:
previous word, previous two words, the words two and three places back (skips), and the shapes among
the last eight words.  Inside a shape class the last factor is the smoothed frequency, with one place
for unseen tokens, so the probabilities of all tokens sum to one.

Training is by distributed updates over every position of every training document, in two rounds:

1. An update of iterative scaling from zero: the row of a feature moves by the logarithm of observed
   over expected counts (each smoothed).  Tasks sum the observed counts; at zero weights the expected
   ones are the row's uses times the frequencies.  Sums do not depend on how the input is split.
2. How far each feature should go, by how often its row was seen, is learned by natural-gradient steps
   on the likelihood of every position, which leave the position's own count out.  Tasks step through
   their documents and the steps are averaged by positions, so scores vary a little (in the third
   digit or so) with the split of the input.

The number of hashed rows grows with the training tokens, one for each `tokens_a_row` of a node, up to
the bounds `rows`, as the model is broadcast; the table of counts grows with the vocabulary.
Scoring is one pass in numpy batches; tokens outside the head are counted by document and joined
with the count table.

Edge cases: a null or empty text is its end token; a text of any length is scored whole; rows that
repeat an id, or have none, are scored each by itself; tokens of equal frequency are ranked by their
hash; without training rows every count is 0 and N and V are 0; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X

END = 0x5E2D0C1B7A694837
SHAPES = 16
#: Features of the three factors: previous word, previous two, two back, three back, shapes.
FEATURES = ((0, 1, 2, 3, 4), (0, 1, 4), (0, 1, 4))
#: Rows are told apart by how often they were seen: each bin is four times the one before.
BINS = 8
#: A row's counts are emitted in this many parts for each factor.
BLOCKS = 32
#: Positions whose rows are summed together: few, so that the rows stay in a core's own cache.
AT_ONCE = 1024


@dataclass(frozen=True)
class Shape:
    """Sizes and learning settings."""

    head: int = 1 << 17
    groups: int = 32
    classes: int = 32
    each: int = 32
    rows: tuple[int, int, int] = (1 << 15, 1 << 16, 1 << 17)
    tokens_a_row: int = 64
    smooth: float = 4.0
    batch: int = 8192
    fan_in: int = 32

    @property
    def words(self) -> int:
        return self.groups * self.classes * self.each


@dataclass
class Lookup:
    """Sorted 64-bit keys with constant-time vectorised search."""

    keys: np.ndarray
    bits: int = 18
    start: np.ndarray = field(init=False)

    def __post_init__(self):
        self.start = np.searchsorted(self.keys, np.arange((1 << self.bits) + 1, dtype=np.uint64) << X.U64(64 - self.bits)) if len(self.keys) else np.zeros((1 << self.bits) + 1, np.int64)
        self.start[-1] = len(self.keys)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key, or -1."""
        slot = (wanted >> X.U64(64 - self.bits)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out = np.full(len(wanted), -1, np.int64)
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.keys[at[todo]] == wanted[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


@dataclass
class Factor:
    """One softmax for each node: `start` and `size` place the rows of a node's features in `table`."""

    start: np.ndarray
    size: np.ndarray
    prior: np.ndarray
    table: np.ndarray
    uses: np.ndarray
    bins: np.ndarray
    gain: np.ndarray

    def rows(self, feats: np.ndarray, which: tuple[int, ...], node: np.ndarray) -> np.ndarray:
        mask = (self.size[node] - 1).astype(np.uint64)
        out = np.empty((len(which), len(node)), np.int64)
        for i, f in enumerate(which):
            out[i] = self.start[node, i] + (feats[:, f] >> X.U64(33) & mask).astype(np.int64)
        return out

    def room(self, *shape: int) -> np.ndarray:
        """Room for the outcomes of AT_ONCE positions."""
        return np.empty((*shape, AT_ONCE, self.table.shape[1]), np.float32)


@dataclass
class Model:
    """What scoring needs besides the count table; its size is bounded by Shape."""

    shape: Shape
    n: int
    v: int
    head: Lookup
    counts: np.ndarray
    vocabulary: Lookup
    rank: np.ndarray
    shape_total: np.ndarray
    factors: list[Factor]


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end token after each text, their shapes, and the offsets of texts."""
    low = X.lower_ascii(data)
    start, end, bounds = X.word_spans(low, offs)
    words = X.span_hashes(X.prefix_hashes(low), start, end)
    n = len(offs) - 1
    cuts = bounds + np.arange(n + 1)
    out = np.full(cuts[-1], X.U64(END), np.uint64)
    shape = np.zeros(cuts[-1], np.int64)
    mine = np.ones(cuts[-1], bool)
    mine[cuts[1:] - 1] = False
    out[mine] = words
    if len(start):
        mark = np.append(np.where((low >= 0x80) & (low < 0xC0), low, 0), 0).astype(np.uint8)
        most = np.maximum.reduceat(mark, np.stack([start, end], 1).ravel())[::2].astype(np.int64)
        shape[mine] = np.where(most > 0, 1 + most % (SHAPES - 1), 0)
    return out, shape, cuts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, shapes, sums, held = [], [], [], 0

    def merged() -> pa.RecordBatch:
        k, s, c = np.concatenate(keys), np.concatenate(shapes), np.concatenate(sums)
        order = np.argsort(k, kind="stable")
        at = np.flatnonzero(np.append(True, k[order][1:] != k[order][:-1]))
        return pa.RecordBatch.from_arrays([pa.array(k[order][at].view(np.int64)), pa.array(s[order][at].astype(np.int32)), pa.array(np.add.reduceat(c[order], at))], ["token", "shape", "count"])

    for batch in batches:
        for _, _, data, offs in X.slices(batch.column(0)):
            t, s, _ = tokens(data, offs)
            u, first, c = np.unique(t, return_index=True, return_counts=True)
            keys.append(u), shapes.append(s[first]), sums.append(c.astype(np.int64))
            held += len(u)
            if held > 4_000_000:
                yield merged()
                keys, shapes, sums, held = [], [], [], 0
    if held:
        yield merged()


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, shape, count) of every distinct token of the texts, end tokens included."""
    rows = texts.select("text").mapInArrow(_count, "token long, shape int, count long")
    return rows.groupBy("token").agg(F.min("shape").alias("shape"), F.sum("count").alias("count"))


def start_model(counts: DataFrame, shape: Shape) -> Model:
    """Totals, the bounded head and the unigram model."""
    bin_ = F.floor(F.log2("count") * 64)
    bins = counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("count").alias("sum")).collect()  # at most 64 * 63 rows
    n, v = sum(b["sum"] for b in bins), sum(b["n"] for b in bins)
    least, held = None, 0
    for b in sorted(bins, key=lambda b: -b["bin"]):
        held += b["n"]
        if held > shape.head:
            break
        least = b["bin"]
    top = counts.where(bin_ >= F.lit(least if least is not None else 1 << 20)).toPandas() if bins else None
    if top is None or not len(top):
        keys, shapes, count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        top = top.sort_values("token")
        keys = top["token"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, shapes, count = keys[order], top["shape"].to_numpy()[order].astype(np.int64), top["count"].to_numpy()[order]
    ranked = np.lexsort((keys, -count))[: shape.words]
    chosen = np.sort(ranked)
    rank = np.empty(len(keys), np.int64)
    rank[ranked] = np.arange(len(ranked))
    per_shape = {r["shape"]: (r["n"], r["v"]) for r in counts.groupBy("shape").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()}
    total = np.array([sum(per_shape.get(s, (0, 0))) for s in range(SHAPES)], float) + 1
    np.subtract.at(total, shapes[chosen], count[chosen] + 1.0)
    words = np.zeros(shape.words)
    words[rank[chosen]] = count[chosen] + 0.5  # places without a word have probability 0
    nodes = [words.reshape(-1, shape.each)]
    nodes.insert(0, nodes[0].sum(1).reshape(-1, shape.classes))
    nodes.insert(0, np.append(nodes[0].sum(1), total)[None, :])
    return Model(
        shape, int(n or 0), int(v or 0), Lookup(keys), count, Lookup(keys[chosen], 16), rank[chosen], total,
        [_factor(w, len(which), most, shape) for w, which, most in zip(nodes, FEATURES, shape.rows, strict=True)],
    )


def _factor(weight: np.ndarray, features: int, most: int, shape: Shape) -> Factor:
    """Frequencies of each node's outcomes -> an untrained factor with rows in proportion to them."""
    mass = weight.sum(1)
    wanted = np.minimum(mass / shape.tokens_a_row, mass / max(1.0, mass.sum()) * most / features)
    size = (1 << np.floor(np.log2(np.maximum(wanted, 1))).astype(np.int64)).astype(np.int64)
    start = np.cumsum(np.repeat(size, features)) - np.repeat(size, features)
    with np.errstate(divide="ignore", invalid="ignore"):
        prior = np.maximum(np.log(weight / mass[:, None]), -1e30)
    prior = np.where(mass[:, None] > 0, prior, -np.log(weight.shape[1])).astype(np.float32)
    n = int(size.sum()) * features
    return Factor(start.reshape(-1, features), size, prior, np.zeros((n, weight.shape[1]), np.float32), np.zeros(n, np.float32), np.zeros(n, np.uint8), np.full((features, BINS), 1 / features))


def contexts(ids: np.ndarray, shapes: np.ndarray, cuts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Feature hashes (one column each) of the positions `at`."""
    bos = 1 << 20
    place = at - np.repeat(cuts[:-1], np.diff(cuts))[at] if len(at) < len(ids) else at - np.repeat(cuts[:-1], np.diff(cuts))
    back = lambda j: np.where(place >= j, ids[np.maximum(at - j, 0)], bos).astype(np.uint64)
    one, two, three = back(1), back(2), back(3)
    bits = np.int64(1) << shapes
    seen = np.zeros(len(at), np.int64)
    for j in range(1, 9):
        seen |= np.where(place >= j, bits[np.maximum(at - j, 0)], 0)
    out = np.empty((len(at), 5), np.uint64)
    for f, value in enumerate((one, two * X.U64(1 << 21) + one, two, three, seen.astype(np.uint64))):
        out[:, f] = X.mix(value * X.U64(8) + X.U64(f + 1))
    return out


def _ids(m: Model, toks: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Rank of tokens in the model's vocabulary; other tokens are named by their shape."""
    found = m.vocabulary.find(toks)
    return np.where(found >= 0, m.rank[found] if len(m.rank) else 0, m.shape.words + shapes)


def _steps(m: Model, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each factor: the positions that it decides, their nodes and outcomes."""
    s = m.shape
    known = np.flatnonzero(ids < s.words)
    i = ids[known]
    group, cls = i // (s.classes * s.each), i // s.each
    first = np.where(ids < s.words, ids // (s.classes * s.each), s.groups + ids - s.words)
    return [(np.arange(len(ids)), np.zeros(len(ids), np.int64), first), (known, group, cls % s.classes), (known, cls, i % s.each)]


def _slices(m: Model, batch: pa.RecordBatch, column: int):
    for a, b, data, offs in X.slices(batch.column(column)):
        toks, shapes, cuts = tokens(data, offs)
        yield a, b, toks, shapes, cuts, _ids(m, toks, shapes)


def _observe(shared):
    """Texts -> observed counts of every row and outcome, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        held: list[list[np.ndarray]] = [[] for _ in m.factors]
        total = [np.zeros(f.table.size, np.int32) for f in m.factors]

        def settle(least: int) -> None:
            for k, parts in enumerate(held):
                if sum(map(len, parts)) > least:
                    total[k] += np.bincount(np.concatenate(parts), minlength=len(total[k])).astype(np.int32)
                    parts.clear()

        any_ = False
        for batch in batches:
            for _, _, _, shapes, cuts, ids in _slices(m, batch, 0):
                any_ = True
                feats = contexts(ids, shapes, cuts, np.arange(len(ids)))
                for k, (at, node, outcome) in enumerate(_steps(m, ids)):
                    rows = m.factors[k].rows(feats[at], FEATURES[k], node)
                    held[k].append((rows * m.factors[k].table.shape[1] + outcome).ravel())
                settle(2_000_000)
        settle(0)
        if any_:
            part, press = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
            for k, counts in enumerate(total):
                for j, cells in enumerate(np.array_split(counts, BLOCKS)):
                    row = [k * BLOCKS + j, part, press.compress(cells.astype("<i4").tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "node", "counts"])

    return run


COUNTS = "block long, node long, counts binary"


def _sum_blocks(table: pa.Table) -> pa.Table:
    """Counts of one block from several tasks -> their sum."""
    unpress = zstandard.ZstdDecompressor()
    total = None
    for cell in table.column("counts"):
        counts = np.frombuffer(unpress.decompress(cell.as_py()), "<i4")
        total = counts.copy() if total is None else np.add(total, counts, out=total)
    return pa.table({"block": table.column("block")[:1], "node": table.column("node")[:1], "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})


def _scale(f: Factor, counts: np.ndarray, smooth: float) -> None:
    """Fill in a factor's rows: the logarithm of observed over expected counts."""
    f.uses = counts.sum(1, dtype=np.int64).astype(np.float32)
    f.bins = np.minimum(np.log2(f.uses + 1) // 2, BINS - 1).astype(np.uint8)
    node = np.repeat(np.arange(len(f.size)), f.size * f.gain.shape[0])
    prior = np.exp(f.prior)
    for a in range(0, len(counts), 1 << 14):
        part = slice(a, a + (1 << 14))
        p = smooth * prior[node[part]]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.log((counts[part] + p) / p) - np.log(f.uses[part, None] / smooth + 1)
        f.table[part] = np.where(p > 0, x, 0)


def _learn(shared):
    """Texts -> the sums over positions of each gain after natural-gradient steps through all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        gains = [f.gain.ravel().copy() for f in m.factors]
        fisher = [np.eye(len(g)) * 10 for g in gains]
        seen = 0
        for batch in batches:
            for _, _, _, shapes, cuts, ids in _slices(m, batch, 0):
                seen += len(ids)
                feats = contexts(ids, shapes, cuts, np.arange(len(ids)))
                for k, (at, node, outcome) in enumerate(_steps(m, ids)):
                    for lo in range(0, len(at), m.shape.batch):
                        part = slice(lo, lo + m.shape.batch)
                        slope = _slopes(m.factors[k], FEATURES[k], gains[k], feats[at[part]], node[part], outcome[part], m.shape.smooth)
                        fisher[k] += slope.T @ slope
                        gains[k] = np.clip(gains[k] - np.linalg.solve(fisher[k], slope.sum(0)), -0.5, 1.5)
        flat = np.concatenate(gains)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen))], ["gain", "sum", "positions"])

    return run


def _slopes(f: Factor, which: tuple[int, ...], gain: np.ndarray, feats: np.ndarray, node: np.ndarray, outcome: np.ndarray, smooth: float) -> np.ndarray:
    """The derivative of each position's loss by every gain, its own count left out."""
    rows = f.rows(feats, which, node)
    place = np.arange(len(which))[:, None] * BINS + f.bins[rows]
    gains, uses = gain.astype(np.float32)[place], f.uses[rows] / smooth + 1
    out = np.zeros((len(node), len(gain)))
    xs, zs, shares, ones = f.room(len(which)), f.room(), f.room(), np.ones(f.prior.shape[1], np.float32)
    for lo in range(0, len(node), AT_ONCE):
        part = slice(lo, lo + AT_ONCE)
        o, g = outcome[part], gains[:, part]
        n = len(o)
        at, x, z, prior = np.arange(n), xs[:, :n], zs[:n], shares[:n]
        np.take(f.table, rows[:, part], 0, x, "clip")
        np.take(f.prior, node[part], 0, prior, "clip")
        expected, own = smooth * np.exp(prior[at, o]), x[:, at, o]
        count = np.exp(own) * uses[:, part] * expected
        less = np.log(np.maximum(count - 1, expected) / count)
        np.einsum("fn,fnc->nc", g, x, out=z)
        z += prior
        z[at, o] += (g * less).sum(0)
        z -= z.max(1, keepdims=True)
        e = np.exp(z, out=z)
        total = e @ ones
        out[part][at, place[:, part]] = np.einsum("nc,fnc->fn", e, x) / total + (e[at, o] / total - 1) * less - own
    return out


def train(texts: DataFrame, counts: DataFrame, shape: Shape = Shape()) -> Model:
    """Fit the model on all texts, given their token counts."""
    model = start_model(counts, shape)
    if not model.n:
        return model
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast(model)
    level = X.written(texts.select("text").mapInArrow(_observe(shared), COUNTS), "observed")
    nodes = level.agg(F.max("node")).first()[0] + 1
    while True:
        nodes = -(-nodes // shape.fan_in)
        level = level.withColumn("node", F.col("node") % nodes).groupBy("block", "node").applyInArrow(_sum_blocks, COUNTS)
        if nodes == 1:
            break
    parts: dict[int, bytes] = {r.block: r.counts for r in level.collect()}  # one row for each block of a bounded model
    unpress = zstandard.ZstdDecompressor()
    for k, f in enumerate(model.factors):
        flat = np.concatenate([np.frombuffer(unpress.decompress(parts[k * BLOCKS + j]), "<i4") for j in range(BLOCKS)])
        _scale(f, flat.reshape(f.table.shape), shape.smooth)
    shared.unpersist()
    shared = sc.broadcast(model)
    learned = texts.select("text").mapInArrow(_learn(shared), "gain long, sum double, positions long").groupBy("gain").agg((F.sum("sum") / F.sum("positions")).alias("value"))
    value = np.array([v for _, v in sorted(tuple(r) for r in learned.collect())])  # as many as there are gains
    for f in model.factors:
        f.gain, value = value[: f.gain.size].reshape(f.gain.shape), value[f.gain.size :]
    shared.unpersist()
    return model


def applied(model: Model) -> Model:
    """The model with its gains multiplied into the rows, as scoring uses it."""
    for f in model.factors:
        feature = np.repeat(np.tile(np.arange(len(f.gain)), len(f.size)), np.repeat(f.size, len(f.gain)))
        f.table *= f.gain[feature, f.bins][:, None].astype(np.float32)
        f.gain = np.ones_like(f.gain)
    return model


def outcomes(f: Factor, which: tuple[int, ...], feats: np.ndarray, node: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
    """Log-probabilities of every outcome of the nodes in their contexts, or of one each; gains are in the rows."""
    rows = f.rows(feats, which, node)
    out = np.empty((len(node), f.prior.shape[1]) if only is None else len(node), np.float32)
    zs, xs, ones = f.room(), f.room(), np.ones(f.prior.shape[1], np.float32)
    for lo in range(0, len(node), AT_ONCE):
        part = slice(lo, lo + AT_ONCE)
        n = len(node[part])
        z, x = zs[:n], xs[:n]
        np.take(f.prior, node[part], 0, z, "clip")
        for r in rows[:, part]:
            z += np.take(f.table, r, 0, x, "clip")
        z -= z.max(1, keepdims=True)
        total = np.log(np.exp(z, out=x) @ ones)
        out[part] = z - total[:, None] if only is None else z[np.arange(n), only[part]] - total
    return out


SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, tokens array<long>, times array<int>"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        row = TaskContext.get().partitionId() << 34
        for batch in batches:
            for a, b, toks, shapes, cuts, ids in _slices(m, batch, 1):
                feats = contexts(ids, shapes, cuts, np.arange(len(ids)))
                logp = np.zeros(len(toks))
                for k, (at, node, outcome) in enumerate(_steps(m, ids)):
                    for lo in range(0, len(at), m.shape.batch):
                        part = slice(lo, lo + m.shape.batch)
                        logp[at[part]] += outcomes(m.factors[k], FEATURES[k], feats[at[part]], node[part], outcome[part])
                logp /= np.log(10)
                at = m.head.find(toks)
                inside = at >= 0
                one = np.zeros(len(toks))
                one[inside] = np.log10(m.counts[at[inside]] + 1.0)
                rest = ids >= m.shape.words
                logp[rest] += one[rest] - np.log10(m.shape_total[shapes[rest]])
                out = np.flatnonzero(~inside)
                text = np.repeat(np.arange(b - a), np.diff(cuts))[out]
                order = np.lexsort((toks[out], text))
                t, o = toks[out][order], text[order]
                first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (o[1:] != o[:-1]))[: len(t)])
                heads = np.searchsorted(o[first], np.arange(b - a + 1)).astype(np.int32)
                cols = [
                    pa.array(row + np.arange(b - a)), batch.column(0).slice(a, b - a), pa.array(np.diff(cuts).astype(np.int64)), pa.array(X.per_text(inside, cuts)),
                    pa.array(X.per_text(one, cuts)), pa.array(X.per_text(logp, cuts)),
                    pa.ListArray.from_arrays(pa.array(heads), pa.array(t[first].view(np.int64))), pa.ListArray.from_arrays(pa.array(heads), pa.array(np.diff(np.append(first, len(t))).astype(np.int32))),
                ]
                row += b - a
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCORED.split(", ")])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(applied(model))
    rows = X.written(X.documents_of(docs).mapInArrow(_score(shared), SCORED), "scored")
    shared.unpersist()
    rare = rows.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("t")).select("row", F.col("t.tokens").alias("token"), F.col("t.times").alias("times"))
    found = rare.join(counts.select("token", "count"), "token").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("logs"))
    joined = rows.drop("tokens", "times").join(found, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    floor = float(np.log10(model.n + model.v + 1))
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * floor).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
