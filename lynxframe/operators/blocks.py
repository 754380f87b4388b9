"""Order within long keys without a task per key: rows are cut into blocks, blocks hand on what the next one needs.

A stream, unlike a track, has no bound on its rows. A window over ``keys`` and a block (a day, say) is sorted in as many
tasks as there are blocks; what comes before a block is a small table with a row per block, and only that table is put in
order per key. Ranks over whole keys come from a range-partitioned sort with the sizes of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxframe.shared import Scratch


def by_time(ts: str = "ts_s", length: float = 86400.0) -> Column:
    """The block of a clock; null clocks are a block of their own."""
    return F.floor(F.col(ts) / length)


def _blocked(rows: DataFrame, block: Column) -> DataFrame:
    return rows.withColumn("_block", F.coalesce(block, F.lit(-(1 << 62))))


def _with_carried(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the row of ``carried`` of their key and block; null keys are a key."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_block"]]
    more = [F.col(f"c.{c}") for c in carried.columns if c not in (*keys, "_block")]
    return rows.alias("o").join(carried.alias("c").hint("merge"), same, "left").select("o.*", *more)


def previous(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], n: int = 1, block: Column | None = None) -> DataFrame:
    """``rows`` with ``prev1_c`` ... ``prevN_c``: the columns of the N rows before in the key (null where there are none).

    ``order`` starts with the column that ``block`` (default: ``by_time`` of it) rises with, and is unique in a key.
    """
    cut = _blocked(rows, block if block is not None else by_time(order[0]))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    kept = F.struct(*columns)
    last = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*[F.desc(c) for c in order]))
    # The last n rows of each block; those before a block are the last n of all blocks before it.
    ends = cut.select(*keys, "_block", F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"), kept.alias("_k"), last.alias("_r")).where(F.col("_r") <= n)
    ends = ends.groupBy(*keys, "_block").agg(F.reverse(F.array_sort(F.collect_list(F.struct("_o", "_k")))).alias("_ends"))
    for i in range(1, n):
        before = F.lag("_ends", i).over(Window.partitionBy(*keys).orderBy("_block"))
        ends = ends.withColumn(f"_b{i}", F.coalesce(before, F.expr("slice(_ends, 1, 0)")))
    carried = F.slice(F.concat("_ends", *[f"_b{i}" for i in range(1, n)]), 1, n)
    ends = ends.withColumn("_carried", F.lag(carried).over(Window.partitionBy(*keys).orderBy("_block"))).select(*keys, "_block", "_carried")
    placed = cut.withColumn("_at", F.row_number().over(inside)).select("*", *[F.lag(kept, i).over(inside).alias(f"_l{i}") for i in range(1, n + 1)])
    joined = _with_carried(placed, ends, keys)
    for i in range(1, n + 1):
        # The i-th row before: in the block, or so many places back in what was carried.
        outside = F.get(F.col("_carried"), (F.lit(i) - F.col("_at"))).getField("_k")
        joined = joined.withColumn(f"_p{i}", F.when(F.col("_at") > i, F.col(f"_l{i}")).otherwise(outside))
    out = [F.col(f"_p{i}").getField(c).alias(f"prev{i}_{c}") for i in range(1, n + 1) for c in columns]
    return joined.select(*rows.columns, *out)


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, highs: dict[str, Column] | None = None, block: Column | None = None) -> DataFrame:
    """``rows`` with running sums (this row included) and running maxima of the rows before (this row not included)."""
    sums, highs = sums or {}, highs or {}
    cut = _blocked(rows, block if block is not None else by_time(order[0]))
    for n, c in [*sums.items(), *highs.items()]:
        cut = cut.withColumn(f"_v_{n}", c)
    per = cut.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_s_{n}") for n in highs])
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*keys, "_block", *[F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)).alias(f"_c_{n}") for n in sums], *[F.max(f"_s_{n}").over(upto).alias(f"_c_{n}") for n in highs])
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    now, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    own = cut.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(now), F.lit(0)).alias(f"_w_{n}") for n in sums], *[F.max(f"_v_{n}").over(before).alias(f"_w_{n}") for n in highs])
    joined = _with_carried(own, carried, keys)
    return joined.select(*rows.columns, *[(F.col(f"_w_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums], *[F.greatest(f"_w_{n}", f"_c_{n}").alias(n) for n in highs])


def numbered(rows: DataFrame, keys: list[str], order: list[Column], sums: list[str] = (), name: str = "place") -> DataFrame:
    """``rows`` with ``place`` (from 1, in the order within the key), ``of`` (rows of the key) and ``sum_c``, the running
    sums of ``sums`` along the order: by range partitions, so that a key may be larger than a task. Ties of ``order`` are
    placed one way or the other, so it should end in something unique."""
    scratch = Scratch(rows.sparkSession, "numbered", tidy=False)
    ordered = scratch.save(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", F.sum("_n").over(whole).alias("of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_c_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = ordered.select("*", F.row_number().over(inside).alias("_at"), *[F.sum(c).over(upto).alias(f"_w_{c}") for c in sums])
    condition = [F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = own.alias("o").join(starts.alias("s"), [F.col("o._part") == F.col("s._part"), *condition])
    return joined.select(*[F.col(f"o.{c}") for c in rows.columns], (F.col("_from") + F.col("_at")).alias(name), "of", *[(F.col(f"_c_{c}") + F.col(f"_w_{c}")).alias(f"sum_{c}") for c in sums])


def exact_median(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The median of each key (mean of the middle two for an even number), nulls left out; a key may be larger than a task."""
    placed = numbered(rows.where(F.col(value).isNotNull()).select(*keys, value), keys, [F.col(value)])
    middle = placed.where((F.col("place") == F.floor((F.col("of") + 1) / 2)) | (F.col("place") == F.floor(F.col("of") / 2) + 1))
    return middle.groupBy(*keys).agg(F.avg(value).alias(name))
