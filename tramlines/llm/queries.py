"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, filter_audit, html_density, licenses, maxent, mixing, neardup, packing, quality, repeats, token_store, toxicity, whitening
from . import textops as X

ORACLE_SQL: dict[str, str] = {
    "op1_license_digests": licenses.oracle_sql(),
    "op11_filter_lattice": filter_audit.ORACLE_SQL,
    "op12_source_mixing": mixing.oracle_sql(),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(documents(spark, sf_dir)).drop("clean_text")


def op3_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.documents_of(documents(spark, sf_dir))
    fold = toxicity.remainder(7)
    learn = docs.where(fold != 2)
    counts = X.written(maxent.token_counts(learn), "counts")
    scored = maxent.score(docs, maxent.train(learn, counts), counts)
    return scored.withColumn("held_out", fold == 2)


def op4_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = documents(spark, sf_dir), toxicity.remainder(3)
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 1)
    scored = toxicity.scores(docs, machine)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = X.shared_dir(spark, "tokens")
    token_store.write(documents(spark, sf_dir), path)
    return token_store.checksums(spark, path)


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), neardup.NearDup(k=4))


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_filter_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.col("deviation")
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation_exact", exact).withColumn("deviation", exact.try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_digests": op1_license_digests,
    "op2_line_first_cleaning": op2_line_first_cleaning,
    "op3_hashed_maxent": op3_hashed_maxent,
    "op4_factorization_toxicity": op4_factorization_toxicity,
    "op5_token_lists": op5_token_lists,
    "op6_text_density": op6_text_density,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_bm25_decontamination": op8_bm25_decontamination,
    "op9_repeat_removal": op9_repeat_removal,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_filter_lattice": op11_filter_lattice,
    "op12_source_mixing": op12_source_mixing,
    "op13_embedding_whitening": op13_embedding_whitening,
}
