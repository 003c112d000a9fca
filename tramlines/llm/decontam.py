"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND, then overlap checks.

The index holds the test items; every passage of every document is a query.  Passages are windows
of 2L words, one each L words, L being the longest item, so that any occurrence of an item lies
whole in one passage.

* BM25 impacts are computed over all items.  An item's threshold is its score against itself less
  its `allowed` largest impacts, where `allowed` is how many of the shingles of its question and its
  answer a verified passage may lack: a missing word breaks at least one shingle, so no passage that
  would pass the overlap check can score below it.
* Items are numbered by threshold and cut into blocks; the index keeps, for each term, its largest
  impact overall and in each block.
* A vectorised pass bounds every passage by the sums of those maxima over its distinct terms.
  Passages that stay above some block's threshold go through the block-max WAND loop, which returns
  every item at or above its threshold (no top-k).
* A retrieved item is verified by its distinct five-word shingles: at least `overlap` of those of its
  question (all lines but the last) and of those of its answer (the last line) must stand in the
  passage.  An item of one line is its own question and answer.

The index is broadcast.  Its size is bounded: items are dealt into parts of about `block_items` items
and `block_bytes` of text, each an index of its own.  Documents pass one part after the other, row by
row, and are written between parts, so the result is the same for any number of parts.

Edge cases: a null or empty document has no passage and is clean; null or blank items, and items
without an id, match nothing; an item part of fewer than five words is one shingle of its whole
sequence; repeated items are each reported; documents that repeat an id, or have none, are each judged
by their own text; of items with equal overlaps the figures are the same; an empty benchmark leaves
every document clean; an empty table gives an empty result; other columns of the inputs are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X

K = 5
STEP = 4  # items in a block of the index: small, as the vectorised bound is only as tight as a block
SCHEMA = "doc_id long, n_passages long, n_retrieved long, item_ids array<long>, best_overlap double, question_overlap double, answer_overlap double, contaminated boolean"
#: Between parts of the benchmark the text goes along.
BETWEEN = SCHEMA.replace("doc_id long", "doc_id long, text string")


@dataclass
class Index:
    """Items ordered by threshold, with impact-annotated postings."""

    items: np.ndarray
    threshold: np.ndarray
    terms: np.ndarray
    heads: np.ndarray
    posting: np.ndarray
    impact: np.ndarray
    top: np.ndarray
    block_top: np.ndarray
    present: np.ndarray
    lists: tuple
    longest: int
    shingles: list[np.ndarray] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    question: list[np.ndarray] = field(default_factory=list)
    answer: list[np.ndarray] = field(default_factory=list)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offs = X.text_buffer(pa.array(texts, pa.string()))
    low = X.lower_ascii(data)
    start, end, bounds = X.word_spans(low, offs, punctuation=True)
    return X.span_hashes(X.prefix_hashes(low), start, end), bounds


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(X.window_hashes(words, np.array([0, len(words)]), k)[0])


def statistics(benchmark: DataFrame) -> tuple[int, float, int, DataFrame]:
    """Number of items with words, their mean and largest length, and (term, df) of every term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = _words([t or "" for t in batch.column(1).to_pylist()])
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                if z > a:
                    terms = np.unique(words[a:z])
                    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.where(np.arange(len(terms)) == 0, z - a, 0))], ["term", "words"])

    rows = benchmark.mapInArrow(run, "term long, words long")
    n, total, longest = rows.agg(F.sum(F.when(F.col("words") > 0, 1).otherwise(0)), F.sum("words"), F.max("words")).first()
    return int(n or 0), float(total or 0) / max(1, n or 0), int(longest or 0), rows.groupBy("term").agg(F.count("*").alias("df"))


def build_index(rows: list[tuple[int, str]], n_items: int, mean: float, longest: int, df: dict[int, int], overlap: float, k1: float = 1.2, b: float = 0.75) -> Index | None:
    """The index of one block of items, with statistics of all items."""
    found = []
    for item, text in rows:
        words, _ = _words([text or ""])
        if not len(words):
            continue
        terms, tf = np.unique(words, return_counts=True)
        docs = np.array([df[int(t)] for t in terms.view(np.int64)], float)
        impact = np.log(1 + (n_items - docs + 0.5) / (docs + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
        k = min(K, len(words))
        shingles = _shingles(words, k)
        lines = [x for x in (text or "").split("\n") if len(_words([x])[0])]
        question, answer = "\n".join(lines[:-1] or lines), lines[-1]
        parts = [(w := _words([x])[0], _shingles(w, min(K, len(w))), min(K, len(w)))[1:] for x in (question, answer)]
        lacking = [len(x) - int(np.ceil(round(overlap * len(x), 9))) for x, _ in parts]
        allowed = min(len(terms), sum(lacking) if len(lines) > 1 else lacking[0])
        least = impact.sum() - np.sort(impact)[len(impact) - allowed :].sum() if allowed else impact.sum()
        found.append((least - 1e-9, item, terms, impact, shingles, k, parts))
    if not found:
        return None
    found.sort(key=lambda x: (x[0], x[1]))
    term = np.concatenate([f[2] for f in found])
    number = np.repeat(np.arange(len(found)), [len(f[2]) for f in found])
    impact = np.concatenate([f[3] for f in found])
    order = np.lexsort((number, term))
    term, number, impact = term[order], number[order], impact[order]
    terms, heads = np.unique(term, return_index=True)
    block_top = np.zeros((len(terms), -(-len(found) // STEP)))
    np.maximum.at(block_top, (np.searchsorted(terms, term), number // STEP), impact)
    present = np.zeros(1 << 20, bool)
    present[terms >> X.U64(44)] = True
    blocks: list[dict[int, float]] = [{} for _ in terms]
    for t, i, x in zip(np.searchsorted(terms, term).tolist(), number.tolist(), impact.tolist(), strict=True):
        blocks[t][i // STEP] = max(x, blocks[t].get(i // STEP, 0.0))
    lists = (number.tolist(), impact.tolist(), block_top.max(1).tolist(), [f[0] for f in found], blocks)
    return Index(
        np.array([f[1] for f in found], np.int64), np.array([f[0] for f in found]), terms, np.append(heads, len(term)), number, impact, block_top.max(1), block_top.astype(np.float32), present, lists, longest,
        [f[4] for f in found], [f[5] for f in found], [f[6][0] for f in found], [f[6][1] for f in found],
    )


def block_max_wand(index: Index, query: np.ndarray) -> list[int]:
    """Numbers of all items whose BM25 score with the query's terms reaches their threshold.

    Thresholds grow with the item number, so the one at a cursor's item bounds all later items.
    """
    posting, impact, top, least, blocks = index.lists
    cursors = [[posting[index.heads[t]], int(index.heads[t]), int(index.heads[t + 1]), int(t)] for t in query]
    found = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for i, (item, _, _, t) in enumerate(cursors):
            bound += top[t]
            if bound >= least[item]:
                pivot = i
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        block = item // STEP
        bound = 0.0
        for c in cursors[: pivot + 1]:
            bound += blocks[c[3]].get(block, 0.0)
        if bound < least[item]:
            # No item of this block before the next cursor's can pass: go to the nearer of both ends.
            target = (block + 1) * STEP
            if pivot + 1 < len(cursors):
                target = min(target, cursors[pivot + 1][0])
            target = max(target, item + 1)
        elif cursors[0][0] == item:
            score = 0.0
            for c in cursors[: pivot + 1]:
                score += impact[c[1]]
            if score >= least[item]:
                found.append(item)
            target = item + 1
        else:
            target = item
        done = False
        for c in cursors[: pivot + 1]:
            if c[0] < target:
                c[1] = bisect_left(posting, target, c[1], c[2])
                if c[1] < c[2]:
                    c[0] = posting[c[1]]
                else:
                    done = True
        if done:
            cursors = [c for c in cursors if c[1] < c[2]]
    return found


def _overlap(have: np.ndarray, want: np.ndarray) -> float:
    return float(np.isin(want, have).mean()) if len(want) else 0.0


def search(index: Index, data: np.ndarray, offs: np.ndarray, overlap: float) -> dict[str, list]:
    """Figures of every text of a slice against one index."""
    n = len(offs) - 1
    low = X.lower_ascii(data)
    start, end, bounds = X.word_spans(low, offs, punctuation=True)
    words = X.span_hashes(X.prefix_hashes(low), start, end)
    length = index.longest
    n_words = np.diff(bounds)
    cells = -(-n_words // length)  # runs of L words; a passage is two neighbours
    first_cell = np.concatenate([[0], np.cumsum(cells)])
    text = np.repeat(np.arange(n), n_words)
    cell = first_cell[text] + (np.arange(len(words)) - bounds[text]) // length
    near = np.flatnonzero(index.present[words >> X.U64(44)])
    at = np.minimum(np.searchsorted(index.terms, words[near]), len(index.terms) - 1)
    real = index.terms[at] == words[near]
    known, at = near[real], at[real]
    width = len(index.terms)
    pairs = np.sort(cell[known] * width + at)
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    pair_cell, pair_term = pairs // width, pairs % width
    total = int(first_cell[-1])
    alive = np.zeros(total, bool)
    follows = np.zeros(total, bool)  # the next cell is of the same text
    if total:
        follows[:-1] = np.repeat(np.arange(n), cells)[1:] == np.repeat(np.arange(n), cells)[:-1]
    full = np.flatnonzero(np.append(True, pair_cell[1:] != pair_cell[:-1])[: len(pair_cell)])
    least = (index.threshold[::STEP] - 1e-2).astype(np.float32)  # single precision: a little slack
    for part in range(0, index.block_top.shape[1], 64):
        bound = np.zeros((total, len(least[part : part + 64])), np.float32)
        if len(full):
            bound[pair_cell[full]] = np.add.reduceat(index.block_top[pair_term, part : part + 64], full, 0)
        bound[:-1] += np.where(follows[:-1, None], bound[1:], 0)
        alive |= (bound >= least[part : part + 64]).any(1)
    cuts = np.searchsorted(pair_cell, np.arange(total + 1))
    out = {"n_passages": np.maximum(cells - 1, np.minimum(cells, 1)), "n_retrieved": np.zeros(n, np.int64), "items": [set() for _ in range(n)], "best": np.zeros((n, 3))}
    owner = np.repeat(np.arange(n), cells)
    for c in np.flatnonzero(alive):
        i = owner[c]
        query = np.unique(pair_term[cuts[c] : cuts[c + 1 + follows[c]]])
        hits = block_max_wand(index, query)
        if not hits:
            continue
        a = bounds[i] + (c - first_cell[i]) * length
        passage = words[a : min(a + 2 * length, bounds[i + 1])]
        have = {k: _shingles(passage, k) for k in range(1, K + 1)}
        for h in hits:
            out["n_retrieved"][i] += 1
            share = _overlap(have[index.sizes[h]], index.shingles[h])
            q, r = (_overlap(have[k], s) for s, k in (index.question[h], index.answer[h]))
            if (share, q, r) > tuple(out["best"][i]):
                out["best"][i] = share, q, r
            if min(q, r) >= overlap - 1e-9:
                out["items"][i].add(int(index.items[h]))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, block_items: int = 2_000, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: passages queried, items retrieved, items found in it, the best overlap
    and that item's question and answer overlaps, and `contaminated` (some item found)."""
    spark = docs.sparkSession
    docs = X.documents_of(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n_rows, n_bytes = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_items, mean, longest, df = statistics(items)
    parts = max(1, -(-n_rows // block_items), -(-(n_bytes or 0) // block_bytes)) if n_items else 0
    empty = F.array().cast("array<long>")
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    found = docs.select("doc_id", "text", zero.alias("n_passages"), zero.alias("n_retrieved"), empty.alias("item_ids"), none.alias("best_overlap"), none.alias("question_overlap"), none.alias("answer_overlap"), F.lit(False).alias("contaminated"))
    passed = 0
    for number in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == number)
        texts = [(r.item_id, r.text) for r in mine.collect()]  # bounded by block_items and block_bytes on average
        terms = np.unique(_words([t for _, t in texts])[0]).view(np.int64).tolist() if texts else []
        wanted = spark.createDataFrame([(t,) for t in terms], "term long") if terms else None
        known = {r.term: r.df for r in df.join(F.broadcast(wanted), "term").collect()} if terms else {}
        index = build_index(texts, n_items, mean, longest, known, overlap)
        if index is not None:
            found = X.written(found, "part") if passed else found
            found = found.mapInArrow(_scan(spark.sparkContext.broadcast(index), overlap), BETWEEN)
            passed += 1
    return found.select(*[c.split()[0] for c in SCHEMA.split(", ")])


def _scan(shared, overlap: float):
    """doc_id, text and what earlier parts found -> the same with this part's findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in X.slices(batch.column(1)):
                out = search(shared.value, data, offs, overlap)
                before = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns)]
                found = [sorted(s | set(x)) for s, x in zip(out["items"], before[4].to_pylist(), strict=True)]
                best = [max(tuple(x), y) for x, y in zip(out["best"].tolist(), zip(*(before[j].to_pylist() for j in (5, 6, 7)), strict=True), strict=True)]
                cols = [
                    before[0], before[1], pa.array(out["n_passages"].astype(np.int64)), pa.array(out["n_retrieved"] + before[3].to_numpy()), pa.array(found, pa.list_(pa.int64())),
                    *(pa.array([x[j] for x in best], pa.float64()) for j in range(3)), pa.array([bool(f) for f in found], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in BETWEEN.split(", ")])

    return run
