"""MinHash near-duplicate detection over word shingles.

1. Every text becomes its set of distinct k-word shingles (64-bit hashes), an order-free 128-bit
   digest of the set and `bands` keys, each made of `rows` universal-hash minima.  Texts with the
   same set form one class; only the class's smallest id goes on, so copies never meet in pairs.
2. Classes that share a band key are candidates.  A bucket is never expanded into all its pairs:
   its member with the most collisions over all its buckets (the text that a group of near copies
   was made from, say) is the centre that the rest are compared with.
3. Candidates are verified, first on the signatures, then exactly on the full sets, and links are
   closed by alternating large-star and small-star.
4. Members of one bucket that are in different components have not been compared with each other,
   only with the centre c.  What a text x differs in from c, D(x) = x without c and c without x, is
   all that this takes: |x - y| + |y - x| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, so the exact similarity
   of x and y follows from their sizes and the shingles that D(x) and D(y) share.  The texts apart
   from the centre are looked up in inverted lists of the members' differences, in blocks of
   `block_shingles` dealt over tasks; a block returns a link for each text and component at most.

So every colliding pair is compared exactly, ruled out by its signatures or already in one component;
nothing is capped, no pair makes a row before it is a link, and no task holds more than two blocks.
A member makes a row for each block of texts apart from the centre: one row in groups up to a
thousand or so such texts, whatever the number of members.

Two bounds of chance: a pair at similarity 0.8 shares none of 32 bands of 5 rows with probability
3e-6; signatures rule out pairs with the centre that agree in 7 standard deviations less than 0.8 of
their minima, which a pair at 0.8 does with probability under 1e-9.  Ties between centres go to the
largest id, which changes no component.

Edge cases: a null, empty or blank text has an empty set, is linked with nothing and is its own
component; a text of fewer than k words has its whole word sequence as its one shingle; rows that
repeat an id are each judged by their own text and linked under that id; a row without an id is not
linked with anything, its component_id is null and it is kept; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .components import connected_components


@dataclass(frozen=True)
class NearDup:
    """Shingle length, similarity threshold and signature shape."""

    k: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    seed: int = 20240917
    block_shingles: int = 1 << 16

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.bands * self.rows
        return rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and the offsets of each set."""
    low = X.lower_ascii(data)
    start, end, bounds = X.word_spans(low, offs)
    words = X.span_hashes(X.prefix_hashes(low), start, end)
    keys, at = X.window_hashes(words, bounds, k)
    n_words = np.diff(bounds)
    text = np.repeat(np.arange(len(offs) - 1), n_words)
    owner = text[at]
    for n in range(1, k):  # texts of fewer words: the whole sequence
        if len(short := np.flatnonzero(n_words == n)):
            whole = np.zeros(len(short), np.uint64)
            for j in range(n):
                whole += words[bounds[short] + j] * X.U64(pow(X._BASE, 2 * j + 1, 1 << 64))
            keys = np.concatenate([keys, X.mix(whole + X.U64(n))])
            owner = np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[first], owner[first]
    return keys, np.searchsorted(owner, np.arange(len(offs)))


def signatures(keys: np.ndarray, bounds: np.ndarray, params: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """Minima of every universal hash for each non-empty set, and which sets those are."""
    full = np.flatnonzero(np.diff(bounds))
    a, b = params.hashes()
    out = np.empty((len(full), len(a)), np.uint32)
    if len(full):
        x, at = (keys >> X.U64(32)).astype(np.uint32), bounds[:-1][full]
        v = np.empty_like(x)
        for j in range(len(a)):
            np.multiply(x, a[j], out=v)
            np.add(v, b[j], out=v)
            out[:, j] = np.minimum.reduceat(v, at)
    return out, full


def _profile(params: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.array([pow(X._BASE, 2 * j + 1, 1 << 64) for j in range(params.rows)], np.uint64)
        for batch in batches:
            for a, b, data, offs in X.slices(batch.column(1)):
                keys, bounds = shingle_sets(data, offs, params.k)
                n = np.diff(bounds)
                sig, full = signatures(keys, bounds, params)
                bands = np.empty((len(full), params.bands), np.uint64)
                for j in range(params.bands):
                    part = sig[:, j * params.rows : (j + 1) * params.rows].astype(np.uint64)
                    bands[:, j] = X.mix((part * step).sum(1, dtype=np.uint64) + X.U64(j + 1))
                sizes = np.zeros(b - a, np.int32)
                sizes[full] = params.bands
                heads = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                d1 = np.zeros(b - a, np.uint64)
                d2 = np.zeros(b - a, np.uint64)
                if len(full):
                    d1[full] = np.add.reduceat(keys, bounds[:-1][full])
                    d2[full] = np.add.reduceat(X.mix(keys), bounds[:-1][full])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(heads), pa.array(bands.reshape(-1).view(np.int64)))],
                    ["doc_id", "n_shingles", "d1", "d2", "keys"],
                )

    return run


def _sets(params: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in X.slices(batch.column(1)):
                keys, bounds = shingle_sets(data, offs, params.k)
                sig, full = signatures(keys, bounds, params)
                raw = keys.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(full)), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([raw[8 * bounds[i] : 8 * bounds[i + 1]] for i in full], pa.binary())],
                    ["doc_id", "sig", "keys"],
                )

    return run


def _verify(params: NearDup):
    percent = round(100 * params.threshold)
    n = params.bands * params.rows
    least = params.threshold - 7 * (params.threshold * (1 - params.threshold) / n) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            cols = [batch.column(i) for i in range(2, 6)]
            for i in range(batch.num_rows):
                sa, ka, sb, kb = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(cols, (np.uint32, np.uint64) * 2, strict=True))
                if 100 * min(len(ka), len(kb)) < percent * max(len(ka), len(kb)) or (sa == sb).mean() < least:
                    continue
                both = np.concatenate([ka, kb])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["u", "v", "linked"])

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, x) with their sets -> sizes and the shingles that only one of the two has; `of` names c's set, as ids may repeat."""
    for batch in batches:
        names, lengths, sizes, cells = [], [], [], []
        for cell_c, cell_x in zip(batch.column(3), batch.column(5), strict=True):
            kc, kx = np.frombuffer(cell_c.as_buffer(), np.uint64), np.frombuffer(cell_x.as_buffer(), np.uint64)
            d = np.setxor1d(kc, kx, assume_unique=True)
            names.append(int(kc.sum(dtype=np.uint64).view(np.int64))), lengths.append(len(d)), sizes.append(len(kx)), cells.append(d.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), batch.column(1), pa.array(lengths, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cells, pa.binary())], ["c", "of", "x", "d", "size", "diff"])


def _block_links(percent: int):
    """Members of a block and the texts to look up in it -> links between different components."""

    def run(table: pa.Table) -> pa.Table:
        col = lambda n: table.column(n).to_numpy()
        probe, x, label, size, d = col("probe"), col("x"), col("label"), col("size"), col("d")
        cells = [np.frombuffer(b, np.uint64) for b in table.column("diff").to_pylist()]
        held, asked = np.flatnonzero(~probe), np.flatnonzero(probe)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(held) and len(asked):
            shingle = np.concatenate([cells[i] for i in held])
            member = np.repeat(np.arange(len(held)), d[held])
            order = np.argsort(shingle, kind="stable")
            shingle, member = shingle[order], member[order]
            step = max(1, (1 << 20) // len(held))
            for at in range(0, len(asked), step):
                part = asked[at : at + step]
                want = np.concatenate([cells[i] for i in part])
                who = np.repeat(np.arange(len(part)), d[part])
                lo, hi = np.searchsorted(shingle, want), np.searchsorted(shingle, want, side="right")
                shared = np.zeros(len(part) * len(held), np.int64)
                few = max(1, (1 << 22) // len(held))  # list entries in hand at once: a few million at most
                for a in range(0, len(want), few):
                    n = (hi - lo)[a : a + few]
                    where = np.arange(n.sum()) + np.repeat(lo[a : a + few] - (np.cumsum(n) - n), n)
                    shared += np.bincount(np.repeat(who[a : a + few], n) * len(held) + member[where], minlength=len(shared))
                total = size[part][:, None] + size[held][None, :]
                differ = d[part][:, None] + d[held][None, :] - 2 * shared.reshape(len(part), len(held))
                linked = (100 * (total - differ) >= percent * (total + differ)) & (label[part][:, None] != label[held][None, :])
                i, j = np.nonzero(linked)
                if len(i):
                    pair = np.stack([x[part[i]], label[held[j]]])
                    first = np.unique(pair, axis=1, return_index=True)[1]
                    found.append((x[part[i[first]]], x[held[j[first]]]))
        u, v = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(2))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, params: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept, one row per document."""
    docs = X.documents_of(docs)
    profile = X.written(docs.mapInArrow(_profile(params), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"), "profiles")
    classes = profile.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys"))
    members = classes.select("rep", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    crowded = X.written(members.join(buckets.select("key", "n"), "key"), "buckets")
    popular = X.written(crowded.groupBy("rep").agg(F.sum("n").alias("pop")), "popular")
    crowded = crowded.select("key", "rep").join(popular, "rep")
    wanted = docs.join(popular.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = X.written(wanted.mapInArrow(_sets(params), "doc_id long, sig binary, keys binary"), "sets")

    def with_sets(pairs: DataFrame) -> DataFrame:
        """u, v and their signatures and sets; a centre u of many v is dealt out by salt."""
        salted = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(256)).alias("salt"))
        left = sets.select(F.col("doc_id").alias("u"), F.col("sig").alias("sig_u"), F.col("keys").alias("keys_u"))
        right = sets.select(F.col("doc_id").alias("v"), F.col("sig").alias("sig_v"), F.col("keys").alias("keys_v"))
        centres = salted.select("u", "salt").distinct().join(left, "u")
        return salted.join(right, "v").join(centres, ["u", "salt"]).select("u", "v", "sig_u", "keys_u", "sig_v", "keys_v")

    centre = crowded.groupBy("key").agg(F.max(F.struct("pop", "rep")).alias("c")).select("key", F.col("c.rep").alias("c"))
    stars = X.written(crowded.select("key", "rep").join(centre, "key").where("rep <> c").select(F.col("c").alias("u"), F.col("rep").alias("v")).distinct(), "stars")
    tested = X.written(with_sets(stars).mapInArrow(_verify(params), "u long, v long, linked boolean"), "star-verified")
    labels = X.written(connected_components(tested.where("linked").select("u", "v")), "labels")

    # Centres that have members in another component than their own, with all their members.
    names = labels.select(F.col("node").alias("v"), "component")
    member = stars.join(names, "v", "left").select(F.col("u").alias("c"), F.col("v").alias("x"), F.coalesce("component", "v").alias("label"))
    own = stars.select(F.col("u").alias("v")).distinct().join(names, "v", "left").select(F.col("v").alias("c"), F.coalesce("component", "v").alias("own"))
    apart = member.join(own, "c").groupBy("c", "own").agg(F.sum(F.when(F.col("label") != F.col("own"), 1).otherwise(0)).alias("apart"), F.count("*").alias("n")).where("apart > 0 and n > 1")
    member = X.written(member.join(apart.select("c", "own"), "c").withColumn("probe", F.col("label") != F.col("own")), "members")
    if not member.isEmpty():
        both = with_sets(member.select(F.col("c").alias("u"), F.col("x").alias("v")))
        away = both.mapInArrow(_differences, "c long, of long, x long, d long, size long, diff binary").join(member, ["c", "x"])
        away = X.written(away.select("c", "of", "x", "label", "probe", "d", "size", "diff"), "differences")
        cut = lambda n: F.greatest(F.lit(1), F.ceil(n / params.block_shingles)).cast("int")
        blocks = away.groupBy("c", "of").agg(cut(F.sum("d")).alias("rows"), cut(F.sum(F.when(F.col("probe"), F.col("d")))).alias("columns"))
        away = away.join(blocks, ["c", "of"])
        at = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        held = away.select("c", "of", at("rows").alias("i"), every("columns").alias("j"), F.lit(False).alias("probe"), "x", "label", "d", "size", "diff")
        asked = away.where("probe").select("c", "of", every("rows").alias("i"), at("columns").alias("j"), "probe", "x", "label", "d", "size", "diff")
        links = held.union(asked).groupBy("c", "of", "i", "j").applyInArrow(_block_links(round(100 * params.threshold)), "u long, v long")
        more = X.written(links.distinct(), "block-links")
        if not more.isEmpty():
            labels = X.written(connected_components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "labels")
    out = profile.select("doc_id", "n_shingles", "d1", "d2").join(classes.select("n_shingles", "d1", "d2", "rep"), ["n_shingles", "d1", "d2"], "left")
    out = out.withColumn("rep", F.coalesce("rep", "doc_id")).join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
