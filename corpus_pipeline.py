"""The corpus pipeline: documents through five of the operators, each stage written as Parquet and read again.

1. quality: documents that a quality rule rejects go.
2. line_dedup: lines within one word edit of an earlier line go; documents that lose every line go.
3. near_dedup: one document of each SimHash component stays, that of the least doc_id.
4. decontamination: documents that hold a benchmark item go.
5. bpe: token counts and digests of what is left.

All stages but the last return the columns of documents; n_chars follows the text. Each stage is as exact as its
operator; nulls, ties, repeated rows, empty tables and extra columns are as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.llm import bpe, decontam, linededup, quality, simhash
from vaultlens.llm.common import folder, fresh, made, release, ship, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, removed = fresh(docs, "n_lines", "n_removed")
    out = linededup.dedup_lines(docs)
    left = out.where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encoding_digests(docs, bpe.vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]
#: SQL has neither fingerprints of shingles nor this encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. When a stage is written, what it read and what its operator stored on the way is deleted."""
    docs, before = table(spark, sf_dir, "documents"), made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = folder(spark, f"pipeline-{k}-{name}")
            docs.write.parquet(path)
            release(spark, before, keep=(path,))
            docs = spark.read.parquet(path)
    return docs
