"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all the documents that its predecessor kept, and
returns the columns of ``documents`` (the last: the packed pieces). Between stages the documents are
written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontam, line_dedup, packing, pu_quality, simhash
from veilspark.llm.common import materialize, without
from veilspark.llm.queries import default_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Each row is scored by its own text and filtered where
    it lies, so null and repeated ids need no care; null and empty texts are scored like any other. An
    empty table stays empty; without labels to learn from every score is 0.5 and all documents stay."""
    model = pu_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pu_quality.accepted(docs.select(COLUMNS), model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in an earlier one; n_chars follows the text."""
    drops = line_dedup.repeated_lines(docs)
    return line_dedup.rewrite(docs.select(COLUMNS).join(drops, "doc_id", "left"), COLUMNS).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id. Documents without an id stay."""
    found = simhash.near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs.select(COLUMNS), gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination. Rows that share an id go if one of them is contaminated;
    documents without an id stay."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs.select(COLUMNS), found.where("contaminated").select("doc_id").distinct())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: A learned classifier and a tokenizer are part of it, so it is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, f"stage{n}")
    return docs
