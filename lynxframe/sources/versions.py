"""Immutable dataset versions with a fingerprint, in one folder of Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame) -> str:
    """Order-free: the row count with the sum and the exclusive or of row hashes over columns by name."""
    key = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))
    n, total, mixed = rows.select(key.alias("k")).agg(F.count("*"), F.sum(F.col("k").cast("decimal(20,0)")), F.bit_xor("k")).first()
    return f"{n}:{total or 0}:{mixed or 0}"


MANIFEST = "version long, fingerprint string, folder string"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``version``, ``fingerprint``, ``folder`` of all published versions; none for a folder that is not there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest") if there else spark.createDataFrame([], MANIFEST)


def publish(spark: SparkSession, rows: DataFrame, root: str) -> int:
    """Write the rows as the next version, into a folder of its own. The manifest row comes last, so a version that it names
    is whole. Of two publishers that take one number at a time neither overwrites the other; ``resolve`` takes the one whose
    folder's name is smaller, always the same."""
    version = (versions(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    folder = f"data/{version}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    spark.createDataFrame([(version, fingerprint(spark.read.parquet(f"{root}/{folder}")), folder)], MANIFEST).write.mode("append").parquet(f"{root}/manifest")
    return version


def resolve(spark: SparkSession, root: str, version: int | None = None, verify: bool = False) -> DataFrame:
    """A version's rows, the latest by default. Raises if there is none, or if ``verify`` finds other rows than published."""
    known = versions(spark, root)
    row = (known.where(F.col("version") == version) if version else known).orderBy(F.desc("version"), "folder").first()
    if row is None:
        raise ValueError(f"no version {version or ''} in {root}")
    rows = spark.read.parquet(f"{root}/{row['folder']}")
    if verify and fingerprint(rows) != row["fingerprint"]:
        raise ValueError(f"version {row['version']} in {root} has changed")
    return rows
