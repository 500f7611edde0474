"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, langid, lm, mixing, neardup, pii, quality, recipes, sharding, snapshots, token_files, url_filter
from .common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.url_verdicts(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", lm.fold(4) == 2)
    model = langid.fit(docs.filter(~F.col("held_out")).select("text", "lang"))
    return docs.select("doc_id", "held_out", langid.predict(F.col("text"), model, spans=False).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(_table(spark, sf_dir, "documents"), lm.fold(7) == 2)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_measures(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), shared_path(spark, "tokens"))
    return token_files.read_token_files(spark, files).drop("ids")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def fim_digest(docs: DataFrame) -> DataFrame:
    made = fim.fill_in_middle(docs)
    digests = [F.sha2(c, 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (fim.restored(), "restored_sha256"))]
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *digests)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digest(_table(spark, sf_dir, "documents"))


def op12_snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return snapshots.changes(docs, snapshots.later_documents(docs))


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_language_id,
        op3_source_mixing,
        op4_near_duplicates,
        op5_lm_scoring,
        op6_personal_data,
        op7_quality_rules,
        op8_token_files,
        op9_decontamination,
        op10_sharding,
        op11_fill_in_middle,
        op12_snapshot_difference,
        op13_exact_duplicates,
    )
}

ORACLES = {
    "op1_url_filters": url_filter.oracle(),
    "op3_source_mixing": mixing.oracle(),
    "op4_near_duplicates": neardup.oracle(),
    "op10_sharding": sharding.oracle(),
    "op11_fill_in_middle": fim.oracle(),
    "op12_snapshot_difference": snapshots.oracle(),
    "op13_exact_duplicates": recipes.oracle(),
}
