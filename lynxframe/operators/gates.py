"""Gates: queries whose rows are violations. An empty result lets the next write go on; ``require`` stops it otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(violations: DataFrame, what: str) -> None:
    """Raise if there is any violation; at most three reach the driver."""
    found = violations.limit(3).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def count_gate(rows: DataFrame, group: str, expected: DataFrame) -> DataFrame:
    """Groups whose number of rows is not the ``expected`` one (columns: group, expected), on either side."""
    have = rows.groupBy(group).agg(F.count("*").alias("n"))
    both = have.join(expected, group, "full").na.fill(0, ["n", "expected"])
    return both.where("n <> expected").select(group, "n", "expected")


def members_once(members: DataFrame, all_: DataFrame, key: str) -> DataFrame:
    """Members that no group has, or that several have, or that are unknown: ``key``, ``n`` (groups), ``known``."""
    n = members.groupBy(key).agg(F.count("*").alias("n"))
    both = n.join(all_.select(key, F.lit(True).alias("known")).distinct(), key, "full")
    both = both.select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("known", F.lit(False)).alias("known"))
    return both.where("n <> 1 or not known")


def mixed_groups(rows: DataFrame, group: str, same: list[str], start: str, end: str) -> DataFrame:
    """Groups whose rows differ in one of the columns ``same``, or that end before they start."""
    out = rows.groupBy(group).agg(*[F.countDistinct(c).alias(c) for c in same], F.min(start).alias("_start"), F.max(end).alias("_end"))
    fault = F.concat_ws(",", *[F.when(F.col(c) > 1, f"mixed {c}") for c in same], F.when(F.col("_end") < F.col("_start"), "ends before it starts"))
    return out.select(group, fault.alias("fault")).where("fault <> ''")


def same_id_other_members(rows: DataFrame, id_: str, member: str) -> DataFrame:
    """Ids that stand for more than one member set: rows of ``id_``, ``version`` and ``member``."""
    sets = rows.groupBy(id_, "version").agg(F.count("*").alias("_n"), F.sum(F.xxhash64(member).cast("decimal(20,0)")).alias("_s"), F.bit_xor(F.xxhash64(member)).alias("_x"))
    return sets.groupBy(id_).agg(F.countDistinct("_n", "_s", "_x").alias("sets")).where("sets > 1")


def not_reviewed(asked: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Rows that no decision has been made on."""
    return asked.join(decided.select(key), key, "left_anti")


def sealed_rows(read: DataFrame, sealed: DataFrame, key: str) -> DataFrame:
    """Rows of a read that belong to a sealed set."""
    return read.join(sealed.select(key).distinct(), key, "left_semi")


def pool_faults(pool: DataFrame, holdout: DataFrame, key: str, tile: str, label: str, allowed: list[int]) -> DataFrame:
    """A training pool's faults: labels out of range, held-out rows, tiles of both polarities. Columns key, fault."""
    odd = pool.where(~F.col(label).isin(allowed) | F.col(label).isNull()).select(key, F.lit("label").alias("fault"))
    held = sealed_rows(pool, holdout, key).select(key, F.lit("held out").alias("fault"))
    both = pool.groupBy(tile).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a <> _b").select(tile)
    mixed = pool.join(both, tile, "left_semi").select(key, F.lit("both polarities").alias("fault"))
    return odd.unionByName(held).unionByName(mixed)


def split_drift(split: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Rows whose part of a split is not the recomputed one, or that only one side has."""
    both = split.select(key, F.col("split").alias("was")).join(again.select(key, F.col("split").alias("now")), key, "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def not_done(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose identity, stage and hashes (``keys``) no committed ledger row has: what an incremental run has to do."""
    return rows.join(ledger.where("status = 'committed'").select(*keys).distinct(), keys, "left_anti")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has, and which: empty if the id sets are equal."""
    both = a.select(key, F.lit(1).alias("_a")).distinct().join(b.select(key, F.lit(1).alias("_b")).distinct(), key, "full")
    return both.where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "right only").otherwise("left only").alias("side"))


def halves_gate(rows: DataFrame, key: str, whole: Column, first: Column, second: Column) -> DataFrame:
    """Truncation: ids that the whole window lists and its halves don't, or the other way round."""
    return same_ids(rows.where(whole).select(key), rows.where(first | second).select(key), key)
