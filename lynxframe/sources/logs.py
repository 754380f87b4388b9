"""JSON-lines logs: a scan that skips what cannot be parsed, and one that fails on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "timestamp string, timestamp_unix double, sequence long, stream_id string, level string, event string, message string, details map<string,string>"


def read_logs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The entries at ``path`` (file, folder or glob). Lines that are no entry are left out, or, if strict, an error."""
    if strict:
        return spark.read.schema(LOG).option("mode", "FAILFAST").json(path)
    return parse(spark.read.text(path))


def parse(lines: DataFrame) -> DataFrame:
    """Entries of lines of text (column ``value``); those that are none are left out."""
    entry = F.from_json("value", LOG + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(entry.alias("e")).where("e is not null and e._corrupt is null and e.stream_id is not null").select("e.*").drop("_corrupt")


def after(logs: DataFrame, sequence: int, level: str | None = None, event: str | None = None) -> DataFrame:
    """Entries behind a cursor, filtered; the filters reach the scan."""
    out = logs.where(F.col("sequence") > sequence)
    if level:
        out = out.where(F.col("level") == level)
    return out.where(F.col("event") == event) if event else out
