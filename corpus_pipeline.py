"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxframe.llm.common import Scratch
from lynxframe.llm.decontamination import decontaminate
from lynxframe.llm.lines import line_dedup
from lynxframe.llm.packing import pack
from lynxframe.llm.quality import quality
from lynxframe.llm.simhash import near_copies

RANKS = "byte_bpe_50k.tiktoken"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared blocks leave later documents; documents of which nothing is left go."""
    cut = line_dedup(docs.select(*COLUMNS)).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def simhash_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays; documents without an id stay."""
    groups = near_copies(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(groups.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, a row per piece."""
    return pack(docs, RANKS, capacity=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("simhash near-dedup", simhash_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Compression ratios, patience alignment, covering codes and BPE are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        after = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
