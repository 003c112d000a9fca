"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

A document's size is its number of words.  Sources share the words of the whole table by weight; no
target passes `most` times its source's size, and what lies above is shared again by weight among
the others until none is above.  A target is served in two parts: as many complete epochs of the
source as fit, then a weighted sample without replacement for the rest.  The sample orders the
source's documents by -ln(u) / w, where u is a hash of id and text in (0, 1) and w the document's
quality, and takes them until the word budget is used up; the document at the boundary gives only
its first words.  So every source takes its target rounded to a whole word.

The sample never sorts a source.  The exponential keys are counted in `SLOTS` slots for each source,
the slot in which the budget runs out is found by a prefix sum over slots and cut into slots again,
until it holds at most `SORTED_ROWS` rows; only those are sorted, equal rows as one row with a count.

Edge cases: a null or empty text has size 0 and takes nothing; a null id is an id like any other, a
null source a source of its own, after all others; repeated rows are documents of their own, of
which any may be the ones taken as they are equal; a source without words has target 0; an empty
table gives an empty result; very long texts are measured whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X

#: Slots that a source's keys are counted in, in each round.
SLOTS = 4096
#: A boundary slot of at most so many rows is sorted; a longer one is cut into slots again.
SORTED_ROWS = 50_000
#: Up to so many sources (rows of some 100 bytes) their figures are broadcast, beyond it joined by salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 64
_WHITE = r"\x20\x09-\x0D"
#: ASCII characters that are no letters.
_NO_LETTER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]"


@dataclass(frozen=True)
class Mix:
    """most: largest multiple of a source's (and a document's) size; floor: quality weight of a text without letters."""

    most: int = 3
    floor: float = 0.05
    seed: str = "mix"


def word_count(text: Column) -> Column:
    """Number of words: every word and the white space after it shrinks to one character."""
    return F.length(F.ltrim(F.regexp_replace(text, f"[^{_WHITE}]+[{_WHITE}]*", "x"), F.lit(" \t\n\x0b\x0c\r"))).cast("long")


def quality_weight(text: Column, floor: float) -> Column:
    """From `floor` to 1: the share of letters (and characters beyond ASCII) in all but white space."""
    letters = F.length(F.regexp_replace(text, f"{_NO_LETTER}+", ""))
    solid = F.length(F.regexp_replace(text, f"[{_WHITE}]+", ""))
    return F.lit(floor) + F.lit(1 - floor) * F.coalesce(letters / F.nullif(solid, F.lit(0)), F.lit(0.0))


def measured(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, size, digest, key) of every row; key is exponential with the quality as its rate."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
        quality_weight(text, mix.floor).alias("weight"), F.md5(named).alias("digest"),
    )
    uniform = (F.conv(F.substring("digest", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)
    return rows.withColumn("key", F.negative(F.log(uniform)) / F.col("weight")).drop("weight")


def targets(sizes: DataFrame, mix: Mix = Mix(), weights: DataFrame | None = None) -> DataFrame:
    """Targets of sources (source, source_size); a table, one row per source.

    `weights` names each source's weight (source, weight); without it sources weigh 1, 2, 3 and so on
    again in the order of their names.  Sources stand by how soon they meet their bound; the first
    whose share of what the ones before it leave is within its bound settles the level of all after.
    """
    if weights is None:
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        sizes = sizes.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))
    else:
        theirs = weights.select(F.col("source").alias("named"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(theirs, F.col("source").eqNullSafe(F.col("named")), "left").drop("named").fillna(0.0, ["weight"])
    bound = (F.lit(mix.most) * F.col("source_size")).alias("bound")
    by_bound = Window.orderBy((F.col("bound") / F.nullif(F.col("weight"), F.lit(0.0))).asc_nulls_last(), F.col("source").asc_nulls_last())
    before, rest = by_bound.rowsBetween(Window.unboundedPreceding, -1), by_bound.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0))
    shared = sizes.withColumn("bound", bound).withColumn("level", left / F.nullif(F.sum("weight").over(rest), F.lit(0.0))).withColumn("at", F.row_number().over(by_bound))
    within = F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct("at", "level"))
    level = F.min(within).over(everything)["level"]
    # Without a level every source of some weight stops at its bound.
    bounded, none = F.col("bound").cast("double"), F.lit(0.0)
    share = F.when(F.col("weight") <= 0, none).when(F.col("settled").isNull(), bounded).otherwise(F.least(bounded, F.col("settled") * F.col("weight")))
    return shared.withColumn("settled", level).select("source", "source_size", share.alias("target"))


def _attach(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """Rows with their source's figures; a hot source is never dealt to one task."""
    state = state.withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    if few:
        return rows.join(F.broadcast(state), same).drop("of")
    salted = state.withColumn("grain", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("grain"))).drop("of", "salt", "grain")


def _inside() -> Column:
    return (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))


def _narrow(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """The state with the slot of each source's interval in which the budget runs out as its interval."""
    width = F.col("hi") - F.col("lo")
    slot = F.when(width > 0, F.least(F.lit(SLOTS - 1), F.floor((F.col("key") - F.col("lo")) / width * SLOTS))).otherwise(F.lit(0))
    found = _attach(rows, state.select("source", "lo", "hi"), few).where(_inside()).withColumn("slot", slot)
    slots = found.groupBy("source", "slot").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("from"), F.max("key").alias("to"))
    figures = state.select(F.col("source").alias("of"), "base", "budget")
    run = Window.partitionBy("of").orderBy("slot")
    summed = slots.join(F.broadcast(figures) if few else figures, F.col("source").eqNullSafe(F.col("of"))).withColumn("after", F.col("base") + F.sum("words").over(run))
    crossing = F.struct("slot", F.col("from").alias("lo"), F.col("to").alias("hi"), (F.col("after") - F.col("words")).alias("base"), "n")
    first = summed.where("after > budget").groupBy(F.col("source").alias("of")).agg(F.min(crossing).alias("x"))
    kept = state.drop("lo", "hi", "base", "n").join(first, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return kept.select("*", "x.lo", "x.hi", "x.base", "x.n").drop("x")


def plan(docs: DataFrame, mix: Mix = Mix(), weights: DataFrame | None = None) -> DataFrame:
    """What the mix takes of every row: doc_id, source, digest, size, source_size, target, epochs, taken.

    `taken` counts words: `epochs` times the size, and the sampled part of it.
    """
    rows = X.written(measured(docs, mix), "measured")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))
    sizes = X.written(sizes, "sources")
    goals = targets(sizes.select("source", "source_size"), mix, weights).withColumnRenamed("source", "of").drop("source_size")
    state = sizes.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    state = state.withColumn("epochs", epochs).withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5))).withColumn("base", F.lit(0).cast("long"))
    state = X.written(state, "state")
    few = state.count() <= BROADCAST_SOURCES
    while True:
        state = X.written(_narrow(rows, state, few), "state")
        if state.where((F.col("n") > SORTED_ROWS) & (F.col("hi") > F.col("lo"))).isEmpty():
            break
    full = F.col("epochs") * F.col("size")
    known = _attach(rows, state, few)
    # A source without a boundary is taken whole; then lo and hi are null.
    clear = known.where(~F.coalesce(_inside(), F.lit(False))).withColumn("taken", full + F.when(F.coalesce(F.col("key") < F.col("lo"), F.lit(True)), F.col("size")).otherwise(F.lit(0)))
    same = known.where(_inside()).groupBy("source", "key", "digest", "doc_id", "size", "source_size", "target", "epochs", "budget", "base").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("key", "digest", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("base") + F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n")
    each = same.withColumn("start", start).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    left = F.col("budget") - F.col("start") - F.col("at") * F.col("size")
    edge = each.withColumn("taken", full + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    columns = ["doc_id", "source", "digest", "size", "source_size", "target", "epochs", "taken"]
    return clear.select(columns).unionByName(edge.select(columns))


def texts(docs: DataFrame, planned: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: (doc_id, source, epoch, text), whole texts once per epoch and the sampled part of the rest.

    Rows of one digest have the same id and text, so a digest's text is looked up once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text)
    bodies = docs.select(F.md5(named).alias("digest"), text.alias("text")).dropDuplicates(["digest"])
    part = F.col("taken") - F.col("epochs") * F.col("size")
    cut = F.when(part == F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"[{_WHITE}]*[^{_WHITE}]+"), F.lit(0)), 1, F.col("part").cast("int")), "")
    )
    last = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = planned.where("taken > 0").withColumn("part", part).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    return rows.join(bodies, "digest").select("doc_id", "source", "epoch", F.when(F.col("epoch") <= F.col("epochs"), F.col("text")).otherwise(cut).alias("text"))


def oracle_sql(mix: Mix = Mix()) -> str:
    """The whole mix in DuckDB SQL: a source's documents in the order of their keys, with a running sum."""
    return rf"""
with t as (select doc_id, source, coalesce(text, '') as text from documents),
measured as (
  select doc_id, source, len(regexp_extract_all(text, '[^{_WHITE}]+')) as size,
    {mix.floor} + {1 - mix.floor} * coalesce(length(regexp_replace(text, '{_NO_LETTER}', '', 'g')) / nullif(length(regexp_replace(text, '[{_WHITE}]', '', 'g')), 0), 0.0) as weight,
    md5('{mix.seed}:' || coalesce(doc_id::varchar, 'null') || ':' || text) as digest
  from t),
keyed as (select *, -ln((('0x' || substr(digest, 1, 13))::bigint + 0.5) / 4503599627370496.0) / weight as key from measured),
sizes as (select source, sum(size)::bigint as source_size from keyed group by source),
weighed as (select *, {mix.most} * source_size as bound, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from sizes),
levels as (
  select *, row_number() over (order by bound / w, source nulls last) as nth,
    (sum(source_size) over () - coalesce(sum(bound) over (order by bound / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
      / sum(w) over (order by bound / w, source nulls last rows between current row and unbounded following) as level
  from weighed),
goals as (
  select source, source_size, least(bound::double, coalesce((select arg_min(level, nth) from levels where level * w <= bound), 0) * w) as target from levels),
state as (
  select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as epochs from goals),
ordered as (
  select k.doc_id, k.source, k.size, s.source_size, s.target, s.epochs, floor(s.target - s.epochs * s.source_size + 0.5)::bigint as budget,
    sum(k.size) over (partition by k.source order by k.key, k.digest, k.doc_id rows between unbounded preceding and current row) - k.size as start
  from keyed k join state s on k.source is not distinct from s.source)
select doc_id, source, size::bigint as size, source_size, target, (epochs * size + greatest(0, least(size, budget - start)))::bigint as taken from ordered"""
