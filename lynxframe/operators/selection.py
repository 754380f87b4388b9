"""Deterministic sampling: ranks come from hashes of keys, never from a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxframe.shared import Scratch


def stable_rank(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def stratified(rows: DataFrame, strata: list[str], n: int, seed: str, key: str) -> DataFrame:
    """``n`` rows of each stratum by stable rank, with the weight that makes up for the others."""
    by = Window.partitionBy(*strata)
    ranked = rows.withColumn("place", F.row_number().over(by.orderBy(stable_rank(seed, F.col(key))))).withColumn("stratum_n", F.count("*").over(by))
    return ranked.where(F.col("place") <= n).withColumn("weight", F.col("stratum_n") / F.least(F.col("stratum_n"), F.lit(n)))


def round_robin(rows: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of each group, numbered round by round."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("round") <= cap)


def split_holdout(rows: DataFrame, group: str, key: str, share: float, seed: str, forced_train: Column) -> DataFrame:
    """``split``: the first share of each group by stable rank is held out, forced rows always train."""
    free = Window.partitionBy(group, forced_train).orderBy(stable_rank(seed, F.col(key)))
    n = F.count("*").over(Window.partitionBy(group))
    return rows.withColumn("split", F.when(forced_train, "train").when(F.row_number().over(free) <= F.floor(n * share), "holdout").otherwise("train"))


def quota_then_refill(rows: DataFrame, group: str, source: str, order: list[Column], quota: int, total: int) -> DataFrame:
    """At most ``total`` rows a group: first up to ``quota`` of each source, spare places go to the next best of all."""
    own = F.row_number().over(Window.partitionBy(group, source).orderBy(*order))
    ranked = rows.withColumn("in_quota", own <= quota)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("in_quota"), *order))).where(F.col("place") <= total)


def staged(rows: DataFrame, group: str, key: str, stages: list[tuple[str, Column, list[Column], int]]) -> DataFrame:
    """A budget filled stage by stage: each takes its best rows (condition, order, number) that no earlier stage took.

    Within a group only the best ``n`` rows of a stage plus all earlier picks can matter, so every stage is one ranked
    window over what is left and an anti-join with the few picks so far.
    """
    picked = None
    for name, condition, order, n in stages:
        left = rows.where(condition)
        if picked is not None:
            left = left.join(picked.select(group, key), [group, key], "left_anti")
        place = F.row_number().over(Window.partitionBy(group).orderBy(*order, key))
        best = left.withColumn("place", place).where(F.col("place") <= n).select(group, key, F.lit(name).alias("stage"), "place")
        picked = best if picked is None else picked.unionByName(best)
    return picked


def spread(rows: DataFrame, keys: list[str], place: str, n: int) -> DataFrame:
    """``n`` rows per key at even distances of their place (from 1), all of them if there are no more; first and last are in."""
    of = F.count("*").over(Window.partitionBy(*keys))
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("_of") - 1) / (n - 1)).cast("long") + 1)
    return rows.withColumn("_of", of).where((F.col("_of") <= n) | F.array_contains(spots, F.col(place).cast("long"))).drop("_of")


def even_hours(rows: DataFrame, keys: list[str], ts: str, key: str, n: int) -> DataFrame:
    """The earliest row of each hour of a key's day, then ``n`` of these hours evenly spaced."""
    hour = F.floor(F.col(ts) / 3600)
    first = rows.groupBy(*keys, F.floor(F.col(ts) / 86400).alias("day"), hour.alias("hour")).agg(F.min_by(key, F.struct(ts, key)).alias(key))
    place = F.row_number().over(Window.partitionBy(*keys, "day").orderBy("hour"))
    return spread(first.withColumn("_at", place), [*keys, "day"], "_at", n).drop("_at")


def typical_member(rows: DataFrame, key: str, id_: str, ts: str) -> DataFrame:
    """The representative of each group: near the middle of its order in time, of about median size, not truncated.

    The score of a member is its distance from the middle place as a share of the members, plus the relative difference of
    its mean side from that of the median box, plus 1 if it is truncated; ties by time and id.
    """
    w = Window.partitionBy(key)
    side = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    mid = rows.groupBy(key).agg(F.sqrt((F.percentile("x1", F.lit(0.5)) - F.percentile("x0", F.lit(0.5))) * (F.percentile("y1", F.lit(0.5)) - F.percentile("y0", F.lit(0.5)))).alias("_mid"))
    at = F.row_number().over(w.orderBy(ts, id_)) - 1
    scored = rows.withColumn("_at", at).withColumn("_of", F.count("*").over(w)).join(mid, key)
    score = F.abs(F.col("_at") - (F.col("_of") - 1) / 2) / F.col("_of") + F.abs(side - F.col("_mid")) / F.greatest("_mid", F.lit(1e-6)) + F.col("truncated").cast("int")
    return scored.groupBy(key).agg(F.count("*").alias("members"), F.min_by(id_, F.struct(score, F.col(ts), F.col(id_))).alias("representative"))


def set_cover(rows: DataFrame, key: str, buckets: str, n: int) -> list:
    """``n`` keys in the order in which each adds most buckets not covered yet (ties by key): one distributed aggregate and
    one row to the driver a pick, so ``n`` is a few hundred at most."""
    covered: set = set()
    chosen: list = []
    while len(chosen) < n:
        gain = F.size(F.array_except(buckets, F.array(*[F.lit(b) for b in sorted(covered)]).cast("array<string>")))
        left = rows.where(~F.col(key).isin(chosen)) if chosen else rows
        best = left.select(key, buckets, gain.alias("gain")).agg(F.max_by(F.struct(key, buckets), F.struct(F.col("gain"), -F.col(key))).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append(best[key])
        covered |= set(best[buckets])
    return chosen


def evenly_spaced(rows: DataFrame, key: str, at: str, id_: str, n: int) -> DataFrame:
    """``n`` rows a key, each the free one nearest to the middle of one of ``n`` equal parts of its time span, in order of the
    parts; all rows of a key that has no more. Ties by time, then id. Returns key, id, slot (null where all are taken).

    Of the n rows nearest to an instant at most n - 1 are taken before, so these are all that a slot may need; they are
    found by a limited rank, which Spark cuts before the shuffle, and a key's n * n candidates are folded in one row.
    """
    span = rows.groupBy(key).agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.count("*").alias("_n"))
    wide = rows.select(key, at, id_).join(span, key)
    few = wide.where(F.col("_n") <= n).select(key, id_, F.lit(None).cast("int").alias("slot"))
    asked = wide.where(F.col("_n") > n).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    off = F.abs(F.col(at) - (F.col("_low") + (F.col("_slot") + 0.5) * (F.col("_high") - F.col("_low")) / n))
    nearest = F.row_number().over(Window.partitionBy(key, "_slot").orderBy("_off", at, id_))
    near = asked.withColumn("_off", off).withColumn("_r", nearest).where(F.col("_r") <= n)
    listed = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_slot").alias("slot"), F.col("_r").alias("r"), F.col(id_).alias("id")))).alias("_all"))
    taken = F.aggregate("_all", F.slice("_all", 1, 0), lambda m, e: F.when(F.exists(m, lambda k: (k.slot == e.slot) | (k.id == e.id)), m).otherwise(F.concat(m, F.array(e))))
    return listed.select(key, F.explode(taken).alias("_t")).select(key, F.col("_t.id").alias(id_), F.col("_t.slot").alias("slot")).unionByName(few)


def prune(scores: DataFrame, view: str, tick: str, item: str, holds: str, most_loss: float, most_pause: int) -> DataFrame:
    """Items that others make up for, removed one a round: round, item, loss, pause (how many ticks longer the longest
    stretch without any item gets), in that order.

    scores: ``view``, ``tick`` (counts the ticks of a view without a gap), ``item`` and ``holds``, whether the item fits then.
    A tick is covered if any item that is left holds. In each round the item goes whose loss, the share of all ticks that it
    alone covers, is smallest (then: the least longer pause, the smaller item), of those within ``most_loss`` and
    ``most_pause``; all is judged anew on what is left, so that two items that make up for each other do not both go. The
    last item stays.

    A round is one pass over the ticks that none or one item covers, for all candidates at once; there are at most as many
    rounds as items, of which a bank has tens. The uncovered ticks of a view and candidate are ordered in one task. Null
    ``holds`` count as false.
    """
    spark = scores.sparkSession
    scratch = Scratch(spark, "prune", tidy=False)
    fit = F.array_sort(F.collect_set(F.when(F.col(holds), F.col(item))))
    ticks = scratch.save(scores.groupBy(view, tick).agg(fit.alias("fit")))
    left = [r[0] for r in scores.select(item).where(F.col(item).isNotNull()).distinct().orderBy(item).collect()]
    n = ticks.count()
    kind = scores.schema[item].dataType
    removed: list[tuple] = []
    while len(left) > 1:
        bank = F.array(*[F.lit(x).cast(kind) for x in left])
        now = ticks.withColumn("fit", F.array_intersect("fit", bank)).where(F.size("fit") <= 1)
        # A tick that none covers is uncovered for every candidate, and as it is now (null); one that an item alone covers, for that one.
        who = F.when(F.size("fit") == 0, F.concat(bank, F.array(F.lit(None).cast(kind)))).otherwise(F.col("fit"))
        open_ = now.select(view, tick, F.explode(who).alias("item"), (F.size("fit") == 1).alias("alone"))
        island = F.col(tick) - F.row_number().over(Window.partitionBy(view, "item").orderBy(tick))
        runs = open_.withColumn("_i", island).groupBy(view, "item", "_i").agg(F.count("*").alias("run"), F.count_if("alone").alias("alone"))
        found = {r["item"]: (r["alone"], r["run"]) for r in runs.groupBy("item").agg(F.sum("alone").alias("alone"), F.max("run").alias("run")).collect()}
        before = found.get(None, (0, 0))[1]
        costs = [(found.get(x, (0, 0))[0] / n, found.get(x, (0, before))[1] - before, x) for x in left]
        best = min((c for c in costs if c[0] <= most_loss and c[1] <= most_pause), default=None)
        if best is None:
            break
        removed.append((len(removed) + 1, best[2], best[0], best[1]))
        left.remove(best[2])
    return spark.createDataFrame(removed, f"round int, item {kind.simpleString()}, loss double, pause bigint")
