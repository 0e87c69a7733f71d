"""The corpus pipeline: documents through five operators of lakeloom.llm, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, mixing, near_dedup, quality, spill, substring_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of the better grade is at least 0.5."""
    return quality.keep(docs, quality.ratings(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near duplicates (five-word shingles, similarity 0.8)."""
    groups = near_dedup.near_duplicates(docs, shingle=5, percent=80).where("NOT kept").select(F.col("doc_id")).distinct()
    gone = spill.write(groups, "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of passages that repeat an earlier document; documents that lose all they have go. Documents that
    lose nothing, null and empty texts among them, keep their text as it is."""
    cut = substring_dedup.cut(docs, words=50, base=25, emptied=False)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its copies say, with its rate for the target weights and the number of the copy."""
    got = mixing.mixed(spark, docs, sf_dir).where("copies > 0")
    own = [c for c in docs.columns if c not in ("rate", "copy", "copies", *mixing.RESULT)]
    return got.select(*own, "rate", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: The classifiers' stages are not expressible in SQL; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spill.write(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
