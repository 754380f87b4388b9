"""Scores of ranked and weighted rows, percentiles and ratios, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxframe.operators import blocks


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero denominator."""
    return F.when(b > 0, a / b)


def weighted_scores(rows: DataFrame, group: str) -> DataFrame:
    """Weighted precision and recall, and the share of negatives rejected, per group and over all (group null)."""
    w = F.col("weight").cast("double")

    def total(flag: Column) -> Column:
        return F.sum(F.when(flag, w).otherwise(0.0))

    pos, passed = F.col("label") == 1, F.col("passed")
    return rows.rollup(group).agg(
        F.count("*").alias("n"),
        F.round(ratio(total(pos & passed), total(passed)), 6).alias("precision"),
        F.round(ratio(total(pos & passed), total(pos)), 6).alias("recall"),
        F.round(ratio(total(~pos & ~passed), total(~pos)), 6).alias("negative_reduction"),
    )


def _counts_by_score(rows: DataFrame, key: str) -> DataFrame:
    """Positives and rows per score, with the positives of higher scores: a row a score, summed over range partitions."""
    by = rows.groupBy(key, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    summed = blocks.numbered(by, [key], [F.desc("score")], ["pos"])
    return summed.withColumn("pos_above", F.col("sum_pos") - F.col("pos"))


def roc_auc(rows: DataFrame, key: str) -> DataFrame:
    """Share of (positive, negative) pairs in which the positive scores higher; ties count half."""
    by = _counts_by_score(rows, key)
    neg = F.col("n") - F.col("pos")
    won = F.sum(neg * (F.col("pos_above") + F.col("pos") / 2))
    return by.groupBy(key).agg(F.round(ratio(won, F.sum("pos") * F.sum(neg)), 6).alias("auc"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share at 95 %; null where n is 0."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, (mid - half) / scale), F.when(n > 0, (mid + half) / scale)


def nearest_rank(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """The value at rank ceil(share * n): exact, by ranks over range partitions."""
    placed = blocks.numbered(rows.select(key, value), [key], [F.col(value)])
    return placed.where(F.col("place") == F.ceil(F.col("of") * share)).select(key, F.col(value).alias("value"))


def average_precision(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """Mean of the precision at each positive, by falling score; null for a key without one."""
    ranked = blocks.numbered(rows.select(key, "score", tie, "label"), [key], [F.desc("score"), F.col(tie)], ["label"])
    return ranked.groupBy(key).agg(F.round(ratio(F.sum(F.col("label") * F.col("sum_label") / F.col("place")), F.sum("label")), 6).alias("average_precision"))


def choose_threshold(rows: DataFrame, key: str, steps: int, near: float) -> DataFrame:
    """Per key, the threshold k / ``steps`` with the fewest false positives a hundred rows among those whose hit rate is
    within ``near`` of the best; of equal ones the highest. Keys without a positive give no row.

    Rows are counted once per score band; thresholds are running sums over a key's bands.
    """
    at = F.when(F.col("t") < steps, F.col("t")).otherwise(steps - 1)
    bands = rows.groupBy(key, F.floor(F.col("score") * steps).alias("t")).agg(F.sum("label").alias("pos"), F.count("*").alias("n")).withColumn("t", at)
    every = bands.groupBy(key).agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n")).where("all_pos > 0").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    down = Window.partitionBy(key).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    sums = every.join(bands.groupBy(key, "t").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")), [key, "t"], "left").na.fill(0, ["pos", "n"])
    hit, n = F.sum("pos").over(down), F.sum("n").over(down)
    scored = sums.select(key, "t", (hit / F.col("all_pos")).alias("rate"), (100.0 * (n - hit) / F.col("all_n")).alias("fp"))
    close = scored.withColumn("best", F.max("rate").over(Window.partitionBy(key))).where(F.col("best") - F.col("rate") <= near)
    first = F.row_number().over(Window.partitionBy(key).orderBy("fp", F.desc("t")))
    return close.withColumn("k", first).where("k = 1").select(key, (F.col("t") / steps).alias("threshold"), F.round("rate", 6).alias("hit_rate"), F.round("fp", 6).alias("fp_per_100"))


def robust_scale(rows: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    """Median of each key, and 1.4826 times the median distance from it, ``floor`` at least."""
    mid = blocks.exact_median(rows, keys, value)
    off = rows.select(*keys, value).join(mid, keys).withColumn("_off", F.abs(F.col(value) - F.col("median")))
    mad = blocks.exact_median(off, keys, "_off", "_mad")
    return mid.join(mad, keys).select(*keys, "median", F.greatest(1.4826 * F.col("_mad"), F.lit(floor)).alias("scale"))
