"""A corpus pipeline of the training-data operators (counted as part of ``strataline.llm``).

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame with
the columns of ``documents``; the last one adds the columns of the mix. ``run`` writes each stage's rows to the
shared folder and rereads them, so a lost executor never reaches back over a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import decontaminate, lines, mixing, nearcopies, quality
from strataline.llm.common import Scratch, crc_bucket

#: Below this score a document is rejected.
QUALITY = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; labels teach it as in op6 (crc32 mod 3 is not 1)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.quality_scores(docs, labels, "quality", crc_bucket(F.col("doc_id"), 3) != 1)
    return scored.where(F.col("score") >= QUALITY).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated line runs; n_chars follows the text."""
    got = lines.dedup_lines(docs)
    return got.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (proposed by SimHash fingerprints, verified: five-word Jaccard
    similarity of 0.8 or more): the one of least doc_id, null ids last; of equal ids the one of least text hash, and any one of rows that agree in both."""
    return nearcopies.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, bench).where("NOT contaminated").select(*docs.columns)


def mixing_sample(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample of the mix: columns of documents, and topic, tokens, weight and probability."""
    got = mixing.mix(docs).where("mix_kept")
    return got.select(*docs.columns, "mix_topic", "mix_tokens", "mix_weight", "mix_probability")


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_sample),
]

#: No SQL expresses the classifier; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written to the shared folder and reread."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        last, docs = docs, scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(last)
    return docs
