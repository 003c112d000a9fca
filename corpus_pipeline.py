"""A corpus pipeline of the operators in tramlines.llm, from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, but
the last, which returns packed pieces.  Stages work on all that their predecessor kept, keep nulls
and other columns as they are, and give the same rows for any partitioning.  Rows without an id
belong to no decision and are kept; rows that repeat an id share the decision about it, but repeats
are cut from each row's own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramlines.llm import decontam, neardup, packing, repeats, toxicity
from tramlines.llm import textops as X

ORACLE_SQL = None  # model scores, signatures and token ids are beyond SQL; tests compare with brute force
#: A document of at least this toxicity score goes.
TOXIC = 0.7


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents whose id is not in `rejected`, a table of the ids that go."""
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (4): fitted on all labelled documents of the input; documents of a high score go."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return _without(docs, X.written(toxicity.scores(docs, machine).where(F.col("score") >= TOXIC).select("doc_id"), "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (7) on five-word shingles: of each group the document of smallest id stays."""
    found = neardup.near_duplicates(docs)
    return _without(docs, X.written(found.where("not kept").select("doc_id"), "copies"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup (9): cut passages of 50 bytes or more that an earlier document has.

    A document that is repeated whole goes; n_chars follows the text where the table has it.
    """
    # Rows of one id and one text lose the same bytes, so both together are the key.
    found = repeats.remove_repeats(docs, with_text=True).where("n_removed > 0 and doc_id is not null")
    cut = X.written(found.groupBy(F.col("doc_id").alias("cut_id"), "text_sha256").agg(F.min("kept_text").alias("kept_text")), "cut")
    same = (F.col("doc_id") == F.col("cut_id")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("text_sha256"))
    joined = docs.join(cut, same, "left").where("kept_text is null or kept_text <> ''")
    out = joined.withColumn("text", F.coalesce("kept_text", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("kept_text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (8): documents that hold a test item go."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, X.written(found.where("contaminated").select("doc_id"), "leaks"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (10) into sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through every stage, each written as Parquet and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = X.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
