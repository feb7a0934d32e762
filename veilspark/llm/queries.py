"""The registered queries: each applies one operator, with production parameters, to its whole table and
derives the columns asked for from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, line_dedup, packing, pu_quality, quality_rules, secrets, sharding, simhash, suffix_lm
from .common import materialize

Query = Callable[[SparkSession, str], DataFrame]


def default_tokenizer() -> str:
    """Path of the public vocabulary that packing counts in."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("char_distance", "word_distance")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), default_tokenizer())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the first scans and stores its ledger, the second reports from it and finds nothing due."""
    versions = documents(spark, sf_dir)
    ledger = materialize(secrets.scan_versions(versions)[1], "secret-ledger")
    found, _ = secrets.scan_versions(versions, ledger)
    base = F.filter("spans", lambda s: s.kind.isin([r.kind for r in secrets.RULES if r.base]))
    kinds = F.transform("spans", lambda s: s.kind)
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op5_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.lm_scores(documents(spark, sf_dir), beyond=3)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    own = (op1_quality_rules, op2_best_fit_packing, op3_secret_scan, op4_license_scan, op5_suffix_lm, op6_simhash, op7_quality_classifier, op8_sharding, op9_decontamination, op10_line_dedup)
    return {f.__name__: f for f in own}
