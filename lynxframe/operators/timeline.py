"""Operators over time within a key, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxframe.operators import blocks


def zone_join(observations: DataFrame, zones: DataFrame, inside: Column) -> DataFrame:
    """Observations with the zones of their stream that hold them."""
    return observations.join(zones, "stream_id").where(inside)


def sessions(rows: DataFrame, keys: list[str], ts: str, most_gap: float, tie: str) -> DataFrame:
    """``session``: counts up in a key wherever more than ``most_gap`` passes between rows."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    new = F.when(F.col(ts) - F.lag(ts).over(w) > most_gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def dwell_alerts(rows: DataFrame, keys: list[str], grace: float, threshold: float, tie: str) -> DataFrame:
    """The first row of each visit at which it has lasted ``threshold``: a visit ends when more than ``grace`` passes."""
    visits = sessions(rows, keys, "ts_s", grace, tie)
    visit = Window.partitionBy(*keys, "session")
    late = visits.withColumn("entered_s", F.min("ts_s").over(visit)).withColumn("dwell_s", F.col("ts_s") - F.col("entered_s")).where(F.col("dwell_s") >= threshold)
    first = F.row_number().over(visit.orderBy("ts_s", tie))
    return late.withColumn("_n", first).where("_n = 1").drop("_n")


def elapsed_evidence(rows: DataFrame, keys: list[str], most_gap: float, tie: str) -> DataFrame:
    """``evidence_s``: time so far, counting only steps above 0 and up to ``most_gap``. Keys may be as long as streams are."""
    stepped = blocks.previous(rows, keys, ["ts_s", tie], ["ts_s"])
    step = F.col("ts_s") - F.col("prev1_ts_s")
    counted = F.when((step > 0) & (step <= most_gap), step).otherwise(0.0)
    return blocks.running(stepped, keys, ["ts_s", tie], sums={"evidence_s": counted}).drop("prev1_ts_s")


def m_of_n(rows: DataFrame, keys: list[str], hit: Column, m: int, n: int, tie: str) -> DataFrame:
    """``hits`` among the last ``n`` rows and whether they are ``m`` or more; rows without a hit count as misses."""
    last = Window.partitionBy(*keys).orderBy("ts_s", tie).rowsBetween(-(n - 1), 0)
    return rows.withColumn("hits", F.sum(hit.cast("int")).over(last)).withColumn("confirmed", F.col("hits") >= m)


def monotonic(rows: DataFrame, keys: list[str], arrival: str, ts: str = "ts_s", block: int = 100_000) -> DataFrame:
    """``accepted``: whether a row's clock is later than that of all rows that arrived before, and ``refused``, why not (no
    clock, not later). ``arrival`` numbers the rows; so many numbers are a block."""
    seen = blocks.running(rows, keys, [arrival], highs={"_high": F.col(ts)}, block=F.floor(F.col(arrival) / block))
    late = F.col("_high").isNotNull() & (F.col(ts) <= F.col("_high"))
    refused = F.when(F.col(ts).isNull(), "no clock").when(late, "not later")
    return seen.withColumn("refused", refused).withColumn("accepted", F.col("refused").isNull()).drop("_high")


def frozen(rows: DataFrame, keys: list[str], order: list[str], content: str, clock: Column, n: int) -> DataFrame:
    """``frozen``: whether the last ``n`` rows of the key have one content and their clock stood still."""
    seen = blocks.previous(rows.withColumn("_clock", clock), keys, order, [content, "_clock"], n=n - 1)
    same = F.lit(True)
    for i in range(1, n):
        same = same & F.coalesce((F.col(f"prev{i}_{content}") == F.col(content)) & (F.col(f"prev{i}__clock") == F.col("_clock")), F.lit(False))
    return seen.select(*rows.columns, same.alias("frozen"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def covered_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per key: covered length, extent, gaps and the greatest gap of overlapping intervals."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.max(end).over(before)
    marked = rows.withColumn("_upto", upto).withColumn("_gap", F.when(F.col(start) > F.col("_upto"), F.col(start) - F.col("_upto")).otherwise(0.0))
    fresh = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce("_upto", F.col(start))))
    return marked.groupBy(*keys).agg(
        F.sum(fresh).alias("covered_s"), (F.max(end) - F.min(start)).alias("extent_s"), F.count_if(F.col("_gap") > 0).alias("gaps"), F.max("_gap").alias("max_gap_s")
    )
