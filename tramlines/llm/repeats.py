"""Removal of byte strings that also stand in an earlier document, by a distributed suffix array.

A suffix array of the whole corpus cannot be sorted in one place, and almost all suffixes repeat
nowhere.  So suffixes are routed by an *anchor*: of the 25 26-byte grams of a 50-byte window, the
leftmost one of least hash.  Equal windows have equal anchors at equal places, so all windows that
could be equal meet in one bucket, and only anchors that two documents share go there.

1. Texts are packed into chunks of some megabytes and written once.
2. Every chunk sends the hashes of its anchors to buckets (4 bytes each, one for a chunk however
   many of its documents hold it); a bucket answers with a bit for each: seen elsewhere or not.
3. For shared anchors a chunk sends the *segment* of text that the anchor's windows cover, once
   for equal segments, with the smallest document that has it.
4. A bucket builds the enhanced suffix array of its distinct segments: windows in suffix order with
   their common-prefix lengths.  A stack scan over those lengths yields the interval tree; an
   interval of at least 50 bytes is a repeat group with all its occurrences, maximal to the left if
   the bytes before its occurrences differ.  The smallest document of the outermost interval decides
   for every window whether an earlier document has it.  Answers go back as a bit for each window.
5. Each chunk removes the union of its repeated windows.

An anchor of more than `CROWD_RUNS` runs (a common line among ever new neighbours) has its windows sent
one by one instead, each to a bucket by its own bytes, so no bucket has to hold all of its segments.

Hot passages cost one segment for each chunk, never one for each pair of documents.  Hash width only
affects how many anchors are looked at in vain: windows are compared by their bytes.

Edge cases: a null or empty text has 0 bytes and stays empty; texts under 50 bytes are left alone;
copies keep only the document of smallest id; rows that repeat an id are not earlier than each
other; matches never cross documents; a text without an id comes after all others and is
earlier than none; an empty table gives an empty result; other columns of the input are ignored.  The remaining bytes may split a character; `kept_text` drops such pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X

#: Bytes of text in a chunk, at least and at most; between, a corpus makes `CHUNKS` of them, so that rows between
#: chunks and buckets stay large as the corpus grows.
CHUNK_BYTES, MOST_CHUNK_BYTES, CHUNKS = 1 << 20, 1 << 23, 1 << 13
#: Anchors that a bucket should get.
BUCKET_ANCHORS = 1 << 19
#: Bytes of text whose windows are hashed at once; a longer document is hashed whole.
WINDOW_BYTES = 1 << 19
#: Runs of an anchor from which its windows are dealt out one by one, so that no bucket holds them all.
CROWD_RUNS = 1024
#: Stands for a null id, which is never earlier than another; a chunk has the complement of such a text's length.
LAST = np.iinfo(np.int64).max
#: Added to the anchor's place in a segment that is a single window of such an anchor.
SINGLE = 128
U64 = np.uint64


def _chunks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held, ids, lens, bodies = TaskContext.get().partitionId(), 0, 0, [], [], []
        press = zstandard.ZstdCompressor(level=2)

        def full() -> pa.RecordBatch:
            row = [(part << 32) + serial, held, np.concatenate(ids).tobytes(), np.concatenate(lens).tobytes(), press.compress(b"".join(bodies))]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["chunk", "n_bytes", "ids", "lens", "data"])

        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            for a, b, data, offs in X.slices(batch.column(1)):
                if held and held + len(data) > limit:
                    yield full()
                    serial, held, ids, lens, bodies = serial + 1, 0, [], [], []
                ids.append(doc[a:b].astype("<i8"))
                lens.append(np.where(null[a:b], ~np.diff(offs), np.diff(offs)).astype("<i8"))
                bodies.append(data.tobytes())
                held += len(data)
        if ids:
            yield full()

    return run


class Runs:
    """The windows of a slice of texts, as runs that share an anchor.

    For run i: first[i]..last[i] are the starts of its windows, anchor[i] the place of its gram,
    doc[i] the text it lies in, gram[i] the gram's hash.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, width: int, k: int):
        w = width - k + 1
        self.prefix = X.prefix_hashes(data)
        n = len(data) - width + 1
        if n <= 0:
            self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        m = len(data) - k + 1
        grams = X.mix((self.prefix[k:] - self.prefix[:m]) * X.powers(X._INVERSE, m))
        least = (grams & U64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        step = 1
        while 2 * step <= w:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < w:
            least = np.minimum(least[: len(least) - (w - step)], least[w - step :])
        at = (least & U64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
        inside = np.arange(n) + width <= offs[1:][doc]
        head = inside.copy()
        head[1:] &= ~inside[:-1] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        tail = inside.copy()
        tail[:-1] &= ~inside[1:] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        self.first, self.last = np.flatnonzero(head), np.flatnonzero(tail)
        self.anchor, self.doc = at[self.first], doc[self.first]
        self.gram = X.mix(grams[self.anchor] + U64(1))


def _segment_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of the bytes begin..end of each segment and of the anchor's place in them."""
    return X.mix(X.span_hashes(prefix, begin, end) + X.mix(place.astype(np.uint64) + U64(7)))


class Chunk:
    """One written chunk, opened."""

    def __init__(self, ids: bytes, lens: bytes, data: bytes, n_bytes: int):
        self.ids = np.frombuffer(ids, "<i8")
        sizes = np.frombuffer(lens, "<i8")
        self.null = sizes < 0
        self.offs = np.concatenate([[0], np.cumsum(np.where(self.null, ~sizes, sizes))])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=n_bytes) if n_bytes else b"", np.uint8)

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at, n = 0, len(self.ids)
        while at < n:
            end = max(at + 1, int(np.searchsorted(self.offs, self.offs[at] + WINDOW_BYTES, side="right")) - 1)
            yield at, self.data[self.offs[at] : self.offs[end]], self.offs[at : end + 1] - self.offs[at]
            at = end

    def runs(self, width: int, k: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray, Runs]], np.ndarray, np.ndarray]:
        """The runs of every slice, and of all: gram hashes and texts."""
        parts = [(at, data, offs, Runs(data, offs, width, k)) for at, data, offs in self.slices()]
        none = [np.zeros(0, np.uint64)]
        return parts, np.concatenate([p[3].gram for p in parts] or none), np.concatenate([p[3].doc + p[0] for p in parts] or [np.zeros(0, np.int64)])


def _grams_of(gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct gram hashes of a chunk, in order, whether two of its texts have each, and its runs."""
    order = np.argsort(gram, kind="stable")
    g, d = gram[order], doc[order]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    at = np.flatnonzero(head)
    many = (np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at)) if len(at) else np.zeros(0, bool)
    return g[at], many, np.diff(np.append(at, len(g)))


def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket and key, and the bounds of each bucket in it."""
    bucket = ((keys >> U64(32)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((keys & U64(0xFFFFFFFF), bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _ask(width: int, k: int, buckets: int):
    """Chunk -> a row for each bucket: hashes that one text has, hashes that several have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, size, *cells = (c[row].as_py() for c in batch.columns)
                _, gram, doc = Chunk(*cells, size).runs(width, k)
                keys, many, count = _grams_of(gram, doc)
                order, cuts = _split(keys, buckets)
                low, many, count = (keys[order] & U64(0xFFFFFFFF)).astype("<u4"), many[order], np.minimum(count[order], 65535).astype("<u2")
                full = np.flatnonzero(np.diff(cuts))
                ones = [low[cuts[b] : cuts[b + 1]][~many[cuts[b] : cuts[b + 1]]].tobytes() for b in full]
                more = [low[cuts[b] : cuts[b + 1]][many[cuts[b] : cuts[b + 1]]].tobytes() for b in full]
                counts = [np.concatenate([c[~m], c[m]]).tobytes() for b in full for c, m in [(count[cuts[b] : cuts[b + 1]], many[cuts[b] : cuts[b + 1]])]]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(np.full(len(full), name, np.int64)), *(pa.array(x, pa.binary()) for x in (ones, more, counts))], ["bucket", "chunk", "ones", "more", "counts"])

    return run


def _seen_elsewhere(crowd: int):
    """Bucket -> for each chunk a bit for each hash of `ones`: another chunk has it; and one for each of `ones` and `more`: it has over `crowd` runs."""

    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(b, "<u4") for pair in zip(table.column("ones").to_pylist(), table.column("more").to_pylist(), strict=True) for b in pair]
        lens = np.array([len(x) for x in lists], np.int64)
        values = np.concatenate([*lists, np.zeros(0, np.uint32)])
        counts = np.concatenate([*(np.frombuffer(b, "<u2") for b in table.column("counts").to_pylist()), np.zeros(0, np.uint16)]).astype(np.int64)
        many = np.repeat(np.arange(len(lens)) % 2, lens)
        shared, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
        if len(values):
            order = np.argsort(values, kind="stable")
            head = np.append(True, values[order][1:] != values[order][:-1])
            at, group = np.flatnonzero(head), np.cumsum(head) - 1
            shared[order] = ((np.diff(np.append(at, len(values))) > 1) | (np.maximum.reduceat(many[order], at) > 0))[group]
            hot[order] = (np.add.reduceat(counts[order], at) > crowd)[group]
        cuts = np.concatenate([[0], np.cumsum(lens)])
        chunks, masks, hots = [], [], []
        for i, chunk in enumerate(table.column("chunk").to_pylist()):
            hit, busy = shared[cuts[2 * i] : cuts[2 * i + 1]], hot[cuts[2 * i] : cuts[2 * i + 2]]
            if hit.any() or busy.any():
                chunks.append(chunk)
                masks.append(np.packbits(hit).tobytes())
                hots.append(np.packbits(busy).tobytes() if busy.any() else b"")
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        X.release_memory()
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(chunks), pa.int64()), "answer": pa.array(masks, pa.binary()), "hot": pa.array(hots, pa.binary())})

    return run


def _shared_runs(chunk: Chunk, answers: list[dict] | None, width: int, k: int, buckets: int):
    """The slices of a chunk with their runs, and for each run of all: is its anchor shared, is it crowded."""
    parts, gram, doc = chunk.runs(width, k)
    keys, many, _ = _grams_of(gram, doc)
    order, cuts = _split(keys, buckets)
    shared, hot = many.copy(), np.zeros(len(keys), bool)
    for a in answers or []:
        all_ = order[cuts[a["bucket"]] : cuts[a["bucket"] + 1]]
        mine = all_[~many[all_]]
        shared[mine] = np.unpackbits(np.frombuffer(a["answer"], np.uint8), count=len(mine)).astype(bool)
        if a["hot"]:
            hot[np.concatenate([mine, all_[many[all_]]])] = np.unpackbits(np.frombuffer(a["hot"], np.uint8), count=len(all_)).astype(bool)
    at = np.searchsorted(keys, gram)
    return parts, gram, shared[at], hot[at]


def _segments_of(chunk: Chunk, parts, gram: np.ndarray, shared: np.ndarray, hot: np.ndarray, width: int, buckets: int):
    """The distinct segments of a chunk's shared runs, dealt to buckets by anchor.

    A run of a crowded anchor counts as runs of one window each, dealt by their bytes: equal windows
    still meet.  Returns for each distinct segment, in the order they are sent, a run that has it
    with the smallest document, and its bucket bounds; and for each shared run its segment's number,
    its slice, first and last window, anchor's place and document.
    """
    where = np.flatnonzero(shared)
    counts = np.cumsum([0] + [len(p[3].first) for p in parts])
    all_ = lambda name: np.concatenate([getattr(p[3], name) for p in parts] or [np.zeros(0, np.int64)])
    begin, last = all_("first")[where], all_("last")[where]
    times = np.where(hot[where], last - begin + 1, 1)
    off = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    where, begin, last = (np.repeat(x, times) for x in (where, begin, last))
    single = hot[where]
    begin = begin + off
    last = np.where(single, begin, last)
    place = all_("anchor")[where] - begin + SINGLE * single
    part = np.searchsorted(counts, where, side="right") - 1
    local = where - counts[part]
    seg = np.zeros(len(where), np.uint64)
    doc = np.zeros(len(where), np.int64)
    for i, (at, _, _, runs) in enumerate(parts):
        mine = part == i
        seg[mine] = _segment_hashes(runs.prefix, begin[mine], last[mine] + width, place[mine])
        doc[mine] = chunk.ids[runs.doc[local[mine]] + at]
    bucket = ((np.where(single, X.mix(seg + U64(1)), gram[where]) >> U64(32)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((doc, seg, bucket))
    head = np.ones(len(order), bool)
    head[1:] = (seg[order][1:] != seg[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(head) - 1
    first = order[head]
    return first, np.searchsorted(bucket[first], np.arange(buckets + 1)), number, part, begin, last, place, doc


def _send(width: int, k: int, buckets: int):
    """Chunk and its answers -> a row for each bucket with the chunk's distinct shared segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=2)
        for batch in batches:
            for row in range(batch.num_rows):
                name, size, ids, lens, data, answers = (c[row].as_py() for c in batch.columns)
                chunk = Chunk(ids, lens, data, size)
                parts, *runs = _shared_runs(chunk, answers, width, k, buckets)
                first, cuts, _, part, begin, last, place, doc = _segments_of(chunk, parts, *runs, width, buckets)
                base = np.cumsum([0] + [len(p[1]) for p in parts])
                size_, place = last[first] + width - begin[first], place[first]
                begin = begin[first] + base[part[first]]
                before = (begin > 0) & ~np.isin(begin, chunk.offs)
                left = np.where(before, chunk.data[np.maximum(begin - 1, 0)], 0).astype(np.uint8) if len(chunk.data) else np.zeros(0, np.uint8)
                for b in np.flatnonzero(np.diff(cuts)):
                    s = slice(cuts[b], cuts[b + 1])
                    ends = np.cumsum(size_[s])
                    take = np.arange(ends[-1]) + np.repeat(begin[s] - (ends - size_[s]), size_[s])
                    cells = [int(b), name, size_[s].astype(np.uint8).tobytes(), place[s].astype(np.uint8).tobytes(), left[s].tobytes(), press.compress(doc[first[s]].astype("<i8").tobytes()), press.compress(chunk.data[take].tobytes())]
                    types = [pa.int64(), pa.int64()] + [pa.binary()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, types, strict=True)], ["bucket", "chunk", "sizes", "places", "lefts", "docs", "bytes"])
        X.release_memory()

    return run


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """The interval tree of an enhanced suffix array by one stack scan.

    lcp[i] is the common prefix of suffixes i and i+1.  Returns (depth, first, last, parent) of
    every interval of at least `least` bytes; parent is an index into the list or -1.
    """
    out: list[list[int]] = []
    stack: list[list] = []  # depth, first suffix, children
    for i in range(len(lcp) + 1):
        here = int(lcp[i]) if i < len(lcp) else 0
        first, children = i, []
        while stack and stack[-1][0] > here:
            depth, first, below = stack.pop()
            out.append([depth, first, i, -1])
            for c in below:
                out[c][3] = len(out) - 1
            if stack and stack[-1][0] >= here and stack[-1][0] < depth:
                stack[-1][2].append(len(out) - 1)
                children = []
            else:
                children = [len(out) - 1]
        if here >= least and (not stack or stack[-1][0] < here):
            stack.append([here, first, children])
    return [tuple(x) for x in out]


def repeat_groups(rows: np.ndarray, docs: np.ndarray, lefts: np.ndarray, width: int) -> tuple[np.ndarray, list[dict]]:
    """Repeat groups among suffixes and, for each suffix, the smallest document that has its first `width` bytes.

    rows: a matrix of zero-padded suffixes; lefts: the byte before each (0: none).  A group is an
    interval of common prefix of at least `width` bytes whose left extensions differ.
    """
    n, deep = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{deep}").ravel(), kind="stable") if n else np.zeros(0, np.int64)
    ranked = rows[order]
    differ = ranked[1:] != ranked[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), deep) if n > 1 else np.zeros(0, np.int64)
    first_doc = docs.copy()
    groups = []
    left, who = lefts[order], docs[order]
    for depth, a, b, parent in lcp_intervals(lcp, width):
        members = order[a : b + 1]
        if parent < 0:
            first_doc[members] = who[a : b + 1].min()
        diverse = left[a] == 0 or (left[a : b + 1] != left[a]).any()
        if diverse:
            groups.append({"depth": depth, "members": members})
    return first_doc, groups


def _judge_segments(width: int, k: int):
    """Bucket of segments -> for each chunk, 32 bits for each of its segments: windows that an earlier document has."""

    def run(table: pa.Table) -> pa.Table:
        cell = {c: table.column(c).to_pylist() for c in ("chunk", "sizes", "places", "lefts", "docs", "bytes")}
        size = np.concatenate([np.frombuffer(b, np.uint8) for b in cell["sizes"]]).astype(np.int64)
        place = np.concatenate([np.frombuffer(b, np.uint8) for b in cell["places"]]).astype(np.int64)
        left = np.concatenate([np.frombuffer(b, np.uint8) for b in cell["lefts"]])
        unpress = zstandard.ZstdDecompressor()
        doc = np.concatenate([np.frombuffer(unpress.decompress(b), "<i8") for b in cell["docs"]])
        data = np.frombuffer(b"".join(map(unpress.decompress, cell["bytes"])), np.uint8)
        ends = np.cumsum(size)
        begin = ends - size
        single = place >= SINGLE
        at = begin + place - SINGLE * single
        gram, seg = np.empty(len(size), np.uint64), np.empty(len(size), np.uint64)
        lo = 0
        while lo < len(size):  # hashed in windows, so that buffers stay small
            hi = max(lo + 1, int(np.searchsorted(ends, begin[lo] + WINDOW_BYTES, side="right")))
            part, base = slice(lo, hi), begin[lo]
            prefix = X.prefix_hashes(data[base : ends[hi - 1]])
            gram[part] = X.span_hashes(prefix, at[part] - base, at[part] - base + k)
            seg[part] = _segment_hashes(prefix, begin[part] - base, ends[part] - base, place[part])
            lo = hi
        order = np.lexsort((doc, seg, gram))
        g, s = gram[order], seg[order]
        new_seg = np.ones(len(order), bool)
        new_seg[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        one = order[new_seg]  # for each distinct segment, the occurrence in its smallest document
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new_seg) - 1
        owner = doc[one]
        alone = np.ones(len(one), bool)  # the only segment of its anchor
        same = gram[one][1:] == gram[one][:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        alone |= single[one]  # equal single windows are equal segments
        windows = size[one] - width + 1
        earlier = np.repeat(owner, windows)
        heads = np.cumsum(windows) - windows
        crowd = np.flatnonzero(~alone)
        if len(crowd):
            deep = int(size[one[crowd]].max())
            step = 1 + (1 << 21) // deep // 32
            cuts = [0]
            while cuts[-1] < len(crowd):  # segments of an anchor stay together; matrices stay small
                end = cuts[-1] + step
                while end < len(crowd) and gram[one[crowd[end]]] == gram[one[crowd[end - 1]]]:
                    end += 1
                cuts.append(min(end, len(crowd)))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine = crowd[a:b]
                n = windows[mine]
                which = np.repeat(mine, n)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = begin[one[which]] + off
                room = size[one[which]] - off
                col = np.arange(deep)
                rows = data[np.minimum(start[:, None] + col, len(data) - 1)]
                rows[col >= room[:, None]] = 0
                before = np.where(off > 0, data[np.maximum(start - 1, 0)], left[one[which]])
                earlier[heads[which] + off] = repeat_groups(rows, owner[which], before, width)[0]
        bits = np.zeros(len(doc), np.uint32)
        n = windows[number]
        for j in range(int(n.max()) if len(n) else 0):
            has = np.flatnonzero(n > j)
            bits[has] |= (earlier[heads[number[has]] + j] < doc[has]).astype(np.uint32) << np.uint32(j)
        bounds = np.cumsum([0] + [len(b) for b in cell["sizes"]])
        answer = [bits[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        X.release_memory()
        return pa.table({"chunk": pa.array(cell["chunk"], pa.int64()), "bucket": table.column("bucket"), "answer": pa.array(answer, pa.binary())})

    return run


def _remove(width: int, k: int, buckets: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text", "text_sha256"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, size, ids, lens, data, answers, verdicts = (c[row].as_py() for c in batch.columns)
                chunk = Chunk(ids, lens, data, size)
                parts, *runs = _shared_runs(chunk, answers, width, k, buckets)
                first, cuts, number, part, begin, last, _, doc = _segments_of(chunk, parts, *runs, width, buckets)
                bits = np.zeros(len(first), np.uint32)
                for v in verdicts or []:
                    bits[cuts[v["bucket"]] : cuts[v["bucket"] + 1]] = np.frombuffer(v["answer"], "<u4")
                # The chunk's first document of a segment has the bucket's bits; later ones repeat all of it.
                mine = np.where(doc > doc[first][number], np.uint32(0xFFFFFFFF), bits[number]) if len(number) else np.zeros(0, np.uint32)
                for i, (at, body, offs, _) in enumerate(parts):
                    delta = np.zeros(len(body) + 1, np.int32)
                    here = part == i
                    a, z, m = begin[here], last[here], mine[here]
                    for j in range(width - k + 1):
                        on = ((m >> np.uint32(j)) & np.uint32(1)).astype(bool) & (a + j <= z)
                        delta[a[on] + j] += 1
                        delta[a[on] + j + width] -= 1
                    gone = np.cumsum(delta[:-1]) > 0
                    head = gone.copy()
                    head[1:] &= ~gone[:-1]
                    starts = offs[:-1][offs[:-1] < offs[1:]]
                    head[starts] = gone[starts]
                    removed, spans = X.per_text(gone, offs), X.per_text(head, offs)
                    keep = body[~gone].tobytes()
                    left = np.concatenate([[0], np.cumsum(np.diff(offs) - removed)])
                    kept = [keep[left[j] : left[j + 1]] for j in range(len(offs) - 1)]
                    cols = [pa.array(chunk.ids[at : at + len(kept)].astype(np.int64), mask=chunk.null[at : at + len(kept)]), pa.array(np.diff(offs).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                    if with_text:
                        cols.append(pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()))
                        cols.append(pa.array([hashlib.sha256(body[offs[j] : offs[j + 1]].tobytes()).hexdigest() for j in range(len(kept))]))
                    yield pa.RecordBatch.from_arrays(cols, names)
        X.release_memory()

    return run


def remove_repeats(docs: DataFrame, width: int = 50, with_text: bool = False, chunk_bytes: int | None = None, bucket_anchors: int = BUCKET_ANCHORS, crowd: int = CROWD_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept_text and the text_sha256 of the whole text of every document.

    `width` is the length in bytes of a repeat, 16 to 56.
    """
    if not 16 <= width <= 56:
        raise ValueError("width must be 16 to 56 bytes")
    k = width - width // 2 + 1
    docs = X.documents_of(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    chunk_bytes = chunk_bytes or min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, (total or 0) // CHUNKS))
    staged = X.written(docs.mapInArrow(_chunks(chunk_bytes), "chunk long, n_bytes long, ids binary, lens binary, data binary"), "chunks", compression="uncompressed")
    buckets = max(1, -(-(total or 0) * 2 // (width // 2) // bucket_anchors))
    asked = staged.mapInArrow(_ask(width, k, buckets), "bucket long, chunk long, ones binary, more binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(_seen_elsewhere(crowd), "chunk long, bucket long, answer binary, hot binary")
    seen = X.written(answered, "seen").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer", "hot")).alias("answers"))
    known = staged.join(seen, "chunk", "left").select("chunk", "n_bytes", "ids", "lens", "data", "answers")
    segments = known.mapInArrow(_send(width, k, buckets), "bucket long, chunk long, sizes binary, places binary, lefts binary, docs binary, bytes binary")
    judged = X.written(segments.groupBy("bucket").applyInArrow(_judge_segments(width, k), "chunk long, bucket long, answer binary"), "judged")
    verdicts = judged.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias("verdicts"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string, text_sha256 string" * with_text
    return known.join(verdicts, "chunk", "left").select("chunk", "n_bytes", "ids", "lens", "data", "answers", "verdicts").mapInArrow(_remove(width, k, buckets, with_text), schema)
