"""Frozen truth sets: written once after a complete review, corrected by errata beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxframe.operators import gates
from lynxframe.sources import versions

ERRATUM = "truth_id string, column string, value string, reason string, after_inference boolean, at timestamp"


def freeze(spark: SparkSession, truth: DataFrame, decided: DataFrame, key: str, root: str) -> int:
    """Publish the truth as a version with its fingerprint; an error if a row of it has no decision."""
    gates.require(gates.not_reviewed(truth, decided, key), "review is not complete")
    return versions.publish(spark, truth, root)


def add_errata(spark: SparkSession, errata: DataFrame, root: str) -> None:
    """Append corrections (columns of ERRATUM) beside a frozen truth, which stays; each must state a reason."""
    if versions.versions(spark, root).isEmpty():
        raise ValueError(f"no frozen truth in {root}")
    gates.require(errata.where("reason is null or trim(reason) = ''"), "an erratum without a reason")
    errata.select(*[c.split()[0] for c in ERRATUM.split(", ")]).write.mode("append").parquet(f"{root}/errata")


def corrected(truth: DataFrame, errata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The truth with the latest erratum of each id and column put in; others stay as frozen. At one instant the greatest
    value counts."""
    last = errata.groupBy(F.col("truth_id").alias("_id"), "column").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    by = last.groupBy("_id").pivot("column", columns).agg(F.first("value"))
    by = by.select("_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    named = errata.groupBy(F.col("truth_id").alias("_id")).agg(F.collect_set("column").alias("_columns"))
    both = truth.join(by.join(named, "_id"), F.col(key).cast("string") == F.col("_id"), "left")
    put = {c: F.when(F.array_contains("_columns", c), F.col(f"_new_{c}").cast(truth.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    return both.select(*[put[c].alias(c) if c in put else F.col(c) for c in truth.columns])
