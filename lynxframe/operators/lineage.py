"""Where the members of an episode come from: trainability, risk of a wrong grouping, readiness, times on a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxframe.functions.rules import chain
from lynxframe.operators import blocks

#: Fixed value: reasons that tell of a missing source, not of a doubtful grouping.
LINEAGE_ONLY = ("lineage_source_file_id_unavailable",)


def trainability(members: DataFrame, lineage: DataFrame, episode: str, card: str, oldest: Column | None = None, need_assets: bool = True) -> DataFrame:
    """``status``, ``method`` and ``reason`` per episode from what any of its members has; the first rule that holds decides.

    members: episode, card. lineage, a row a card: file_id, frame_id, ts_s (null: unknown), full_frame, assets, reachable
    (booleans, null: false). ``oldest``: the first instant still kept; without it, or without a ``ts_s``, age is unknown and
    does not count against a member. A card without lineage has nothing but its name.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    file, frame, timed = F.col("file_id").isNotNull(), F.col("frame_id").isNotNull(), F.col("ts_s").isNotNull()
    expired = F.coalesce(F.col("ts_s") < oldest, F.lit(False)) if oldest is not None else F.lit(False)
    assets = yes("assets") if need_assets else F.lit(True)
    known = yes("_known")
    tests = {
        "_a": yes("full_frame"),
        "_b": file & ~expired & assets,
        "_reach": file & yes("reachable"),
        "_old": file & expired,
        "_crop": known & ~file & ~frame & yes("assets"),
        "_recover": ~file & frame & timed,
        "_gone": ~yes("assets"),
    }
    any_ = members.select(episode, card).join(lineage.withColumn("_known", F.lit(True)), card, "left").groupBy(episode).agg(*[F.max(t).alias(n) for n, t in tests.items()])
    good = F.col("_a") | F.col("_b")
    reason = chain(
        (F.col("_a"), ""),
        (F.col("_b") & F.col("_reach"), ""),
        (F.col("_b"), "ps_reachability_unverified_requires_refetch"),
        (F.col("_old"), "recording_beyond_declared_retention_window"),
        (F.col("_crop"), "only_derived_crop_or_context_no_source_route"),
        (F.col("_recover"), "source_file_id_missing_may_recover_via_frame_id_timestamp"),
        (F.col("_gone"), "referenced_asset_missing"),
        other="insufficient_lineage_evidence",
    )
    return any_.select(
        episode,
        chain((good, "TRAINABLE_SOURCE_NATIVE"), (F.col("_old") | F.col("_crop"), "REVIEW_ONLY"), other="LINEAGE_UNRESOLVED").alias("status"),
        chain((F.col("_a"), "A_source_resolution_frame_asset"), (F.col("_b"), "B_ps_file_id_plus_timestamp"), other="none").alias("method"),
        reason.alias("reason"),
    )


def readiness(audited: DataFrame) -> DataFrame:
    """Rows of ``trainability`` counted by status and by reason (the method where there is no reason)."""
    why = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.nullif(F.col("method"), F.lit("")), F.lit("none"))
    return audited.groupBy("status", why.alias("why")).agg(F.count("*").alias("n"))


def grouping_risk(candidates: DataFrame, members: DataFrame, episode: str, moment: str, wrong_box: Column) -> DataFrame:
    """What is doubtful of each candidate (episode, ``reasons`` array): ``grouping_reasons`` and ``lineage_reasons``, sorted
    and distinct, ``grouping_risk`` (any of the first) and ``lineage_only`` (any of the second and none of the first).

    Two members at one ``moment`` (null: unknown) and a member with a wrong box are risks of groups of two or more only.
    """
    at = members.groupBy(episode, moment).agg(F.count("*").alias("_n"), F.max(F.coalesce(wrong_box, F.lit(False))).alias("_wrong"))
    of = at.groupBy(episode).agg(F.sum("_n").alias("_members"), F.max(F.col(moment).isNotNull() & (F.col("_n") > 1)).alias("_same"), F.max("_wrong").alias("_wrong"))
    both = candidates.select(episode, F.coalesce("reasons", F.array()).alias("_r")).join(of, episode, "left")
    several = F.coalesce(F.col("_members") > 1, F.lit(False))
    only = F.array(*[F.lit(x) for x in LINEAGE_ONLY])
    more = F.array_compact(F.array(F.when(several & F.col("_same"), "same_frame_merge_risk"), F.when(several & F.col("_wrong"), "box_wrong_participates_in_grouping")))
    out = both.select(episode, F.array_sort(F.array_union(F.array_except("_r", only), more)).alias("grouping_reasons"), F.array_sort(F.array_intersect("_r", only)).alias("lineage_reasons"))
    risk = F.size("grouping_reasons") > 0
    return out.select("*", risk.alias("grouping_risk"), (~risk & (F.size("lineage_reasons") > 0)).alias("lineage_only"))


def to_media_time(rows: DataFrame, mapping: DataFrame, keys: list[str], ts: str, order: str, duration: float, block: Column) -> DataFrame:
    """Rows on the clock of their recording: ``media_s`` = ``ts`` + ``offset_s`` of their ``keys`` in ``mapping``, and ``fault``.

    A fault is 'unmapped', 'ambiguous' (a key mapped more than once), 'out of range' (not in [0, duration)) or 'not increasing'
    (at or before the row before it by ``order``); null rows are right. ``block`` rises with ``order`` and bounds a task.
    """
    one = mapping.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("offset_s").alias("_offset"))
    timed = rows.join(one, keys, "left").withColumn("media_s", F.when(F.col("_n") == 1, F.col(ts) + F.col("_offset")))
    seen = blocks.previous(timed, keys, [order], ["media_s"], block=block)
    media = F.col("media_s")
    fault = chain((F.col("_n").isNull(), "unmapped"), (F.col("_n") > 1, "ambiguous"), (~((media >= 0) & (media < duration)), "out of range"), (media <= F.col("prev1_media_s"), "not increasing"))
    return seen.select(*rows.columns, "media_s", fault.alias("fault"))


def fingerprints(rows: DataFrame, keys: list[str], parts: list[Column]) -> DataFrame:
    """Per key: ``n`` rows and ``fingerprint``, the sum of the first 64 bits of each row's MD5 over its ``parts`` (as text,
    joined by ``|``), which does not depend on the order of rows. Null parts are left out of the joined text."""
    piece = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(piece).cast("string").alias("fingerprint"))
