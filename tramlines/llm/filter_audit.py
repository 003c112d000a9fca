"""How filters overlap: every order of five filters as a path through the lattice of filter sets.

The filters, each a condition under which a document fails: A: under 200 words; B: fewer than half of
the words are distinct; C: more than 3 % of the code points are ``[A-Z]``; D: any of ``#$%&*|``;
E: the text is that of a document of smaller id, anywhere in the table.  An edge of the lattice is
(set of filters applied already, next filter); there are 80.  What an order does at a step is told by
one edge alone, so documents are counted once by the set of filters that they fail, those counts make
80 edges for each part, and the 600 steps of the 120 orders are joined to the edges.

Identical texts are found by the minimum id of each text's SHA-256, aggregated before every exchange;
who does not fail E is counted there, who does is the rest, so that no group of copies is joined back.

Edge cases: a null text is empty (it fails A; the shares of no words and no characters fail neither
B nor C); a null lang is the part ''; a row without id has no smaller id and is none for others, so
it never fails E; rows that repeat an id and a text don't make each other fail E; repeated labels
count by their largest marks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X

FILTERS = "ABCDE"
_E = 1 << FILTERS.index("E")
_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"


def fails(text: bytes) -> int:
    """Bit set of the filters A to D that the UTF-8 text fails; words are cut at ASCII white space, as bytes.split does."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (n < 200)
        | (100 * len(set(words)) < 50 * n) << 1
        | (100 * capitals > 3 * len(text.decode("utf-8", "surrogatepass"))) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3
    )


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails) of every row, fails without E."""
    X.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column(2):
                text = value.as_py() or b""
                masks.append(fails(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], ["doc_id", "part", "digest", "fails"])

    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, part string, digest binary, fails int"
    )


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each part by the set of failed filters and their labels: (part, fails, good, toxic, n)."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    rows = X.written(marks(docs).join(known, "doc_id", "left").withColumn("good", F.coalesce("good", no)).withColumn("toxic", F.coalesce("toxic", no)), "marks")
    kind = ["part", "fails", "good", "toxic"]
    totals = rows.groupBy(*kind).agg(F.count("*").alias("n"))
    # Of a text the documents of smallest id pass E: first by id and part, then the least id in each part, then in all.
    ids = rows.where("doc_id is not null").groupBy("digest", "doc_id", "part").agg(F.count("*").alias("c"), F.max("fails").alias("fails"), F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    least = ids.groupBy("digest", "part").agg(F.min(F.struct("doc_id", "c", "fails", "good", "toxic")).alias("x"))
    each = least.groupBy("digest").agg(F.min("x.doc_id").alias("first"), F.collect_list(F.struct("part", "x")).alias("parts"))  # one entry for each part
    firsts = each.select("first", F.explode("parts").alias("p")).where("p.x.doc_id = first").select("p.part", "p.x.fails", "p.x.good", "p.x.toxic", F.col("p.x.c").alias("n"))
    free = rows.where("doc_id is null").select(*kind, F.lit(1).cast("long").alias("n"))
    passed = firsts.select(*kind, "n").unionByName(free).groupBy(*kind).agg(F.sum("n").alias("n"))
    # What is not among those fails E.
    signed = totals.withColumn("fails", F.col("fails") + _E).unionByName(passed).unionByName(passed.withColumn("fails", F.col("fails") + _E).withColumn("n", -F.col("n")))
    return signed.groupBy(*kind).agg(F.sum("n").alias("n")).where("n > 0")


def edges(counts: DataFrame) -> DataFrame:
    """The 80 lattice edges of each part: (part, before, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, paths).

    `before` and `filter` are bit sets; `paths` is how many orders walk the edge.
    """
    pairs = [(s, 1 << f, factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) for s in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not s >> f & 1]
    lattice = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("paths")) for s, f, w in pairs])
    rows = counts.withColumn("e", F.explode(lattice)).select("*", "e.before", "e.filter", "e.paths")
    there = F.col("fails").bitwiseAND(F.col("before")) == 0
    hit = F.col("fails").bitwiseAND(F.col("filter")) != 0
    lost = there & hit
    total = lambda which, name: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long").alias(name)
    return rows.groupBy("part", "before", "filter", "paths").agg(
        total(there & ~hit, "kept"), total(lost, "removed"), total(~there & hit, "redundant"), total(F.col("fails") == F.col("filter"), "unique_fails"),
        total(lost & F.col("good"), "good_lost"), total(lost & F.col("toxic"), "toxic_lost"),
    )


def orders(spark: SparkSession) -> DataFrame:
    """The 600 steps of the 120 orders: (filter_order, step, before, filter)."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            rows.append((name, step, before, 1 << f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step; `shapley` sums what the step's filter removes over all orders."""
    lattice = X.written(edges(histogram(docs, labels)), "lattice")
    worth = lattice.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    steps = lattice.drop("paths").join(worth, ["part", "filter"]).join(F.broadcast(orders(docs.sparkSession)), ["before", "filter"])  # 600 rows
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
with recursive t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from t),
l as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
docs as (
  select part, coalesce(good, false) as good, coalesce(l.toxic, false) as toxic,
    case when len(words) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
    || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when first < w.doc_id then 'E' else '' end as fails
  from w left join l on l.doc_id = w.doc_id),
counts as (select part, fails, good, toxic, count(*) as n from docs group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
paths as (
  select f as filter_order, 1 as step, '' as before, f from letters
  union all
  select p.filter_order || l.f, p.step + 1, p.filter_order, l.f from paths p join letters l on not contains(p.filter_order, l.f)),
ends as (select filter_order from paths where step = 5),
steps as (select e.filter_order, i.step, substr(e.filter_order, 1, i.step - 1) as before, substr(e.filter_order, i.step, 1) as f from ends e, (select unnest([1, 2, 3, 4, 5]) as step) i),
marked as (
  select part, filter_order, step, f, n, good, toxic, contains(fails, f) as hit, fails = f as single,
    translate(fails, before, '') <> fails as gone
  from steps, counts),
seen as (
  select part, filter_order, step, any_value(f) as f, coalesce(sum(n) filter (not gone and not hit), 0)::bigint as kept, coalesce(sum(n) filter (not gone and hit), 0)::bigint as removed,
    coalesce(sum(n) filter (gone and hit), 0)::bigint as redundant, coalesce(sum(n) filter (single), 0)::bigint as unique_fails,
    coalesce(sum(n) filter (not gone and hit and good), 0)::bigint as good_lost, coalesce(sum(n) filter (not gone and hit and toxic), 0)::bigint as toxic_lost
  from marked group by part, filter_order, step)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from seen"""
