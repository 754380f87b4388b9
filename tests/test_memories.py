"""Memories, ledgers and selectors that carry decisions on: hand-made cases, order of input, nulls, empty tables, streams run again."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lynxframe.operators import blocks, events, joins, memory, scenes, selector, targets
from lynxframe.streaming import claims, health
from lynxframe.streaming import memory as stream_memory
from lynxframe.streaming.replay import replay_slices

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TICK = f"view string, ts_s double, n bigint, scanned boolean, judged boolean, seen array<struct<x0:double,y0:double,x1:double,y1:double,scan:boolean,prior:boolean>>, actors array<{BOX}>, blind array<{BOX}>, residue array<{BOX}>"
RULES = memory.Rules(warm_up=0.0)


def box(x, scan=None, prior=None, y=0.0, size=20.0):
    sides = (float(x), y, x + size, y + size)
    return sides if scan is None else (*sides, scan, prior)


def ticks(spark, rows):
    made = [(r.get("view", "v"), r["t"], k, r.get("scanned", True), r.get("judged", True), r.get("seen"), r.get("actors"), r.get("blind"), r.get("residue")) for k, r in enumerate(rows)]
    random.Random(1).shuffle(made)
    return spark.createDataFrame(made, TICK).repartition(3)


def states(changes):
    return [(r.ts_s, r.event, r.state, r.reason) for r in changes.orderBy("view", "ts_s", "event").collect()]


def test_an_event_is_confirmed_and_cleared_by_its_own_channel(spark):
    rows = [{"t": 4.0 * k, "judged": False, "seen": [box(0, True, False)] if k < 3 else None} for k in range(9)]
    assert states(memory.event_memory(ticks(spark, rows), ["view"], "n", RULES)) == [
        (0.0, 1, "PENDING", "awaiting_confirmation"), (4.0, 1, "SEMANTIC_VISIBLE", "semantic_confirmed"), (12.0, 1, "ABSENT_PENDING", "semantic_absent"), (20.0, 1, "CLEARED", "semantic_absent_confirmed"),
    ]
    rows = [{"t": 2.0 * k, "scanned": False, "seen": [box(0, False, True)] if k < 5 else None, "residue": [box(0)] if k < 5 else None} for k in range(10)]
    got = states(memory.event_memory(ticks(spark, rows), ["view"], "n", RULES))
    assert got[1:] == [(6.0, 1, "PRIOR_VISIBLE", "prior_confirmed"), (10.0, 1, "CLEAN_PENDING", "clean_reference_match"), (16.0, 1, "CLEARED", "clean_confirmed")]


def test_what_cannot_be_judged_is_not_cleared(spark):
    """A hidden place keeps its timers, residue ends a clean run, and an unjudged event expires without being called clean."""
    seen = [{"t": 2.0 * k, "scanned": False, "seen": [box(0, False, True)]} for k in range(5)]
    hidden = [{"t": 10.0 + 2 * k, "scanned": False, "actors": [box(0)]} for k in range(4)]
    dirty = [{"t": 18.0 + 2 * k, "scanned": False, "residue": [box(0)]} for k in range(4)]
    blind = [{"t": 26.0 + 2 * k, "scanned": False, "blind": [box(0)]} for k in range(4)]
    got = states(memory.event_memory(ticks(spark, seen + hidden + dirty + blind), ["view"], "n", RULES))
    assert [x[2] for x in got] == ["PENDING", "PRIOR_VISIBLE", "OCCLUDED", "CLEAN_PENDING"] or [x[2] for x in got][:3] == ["PENDING", "PRIOR_VISIBLE", "OCCLUDED"]
    assert not any(x[2] == "CLEARED" for x in got)
    unjudged = [{"t": 10.0 + 10 * k, "scanned": False, "judged": False} for k in range(14)]
    assert states(memory.event_memory(ticks(spark, seen + unjudged), ["view"], "n", RULES))[-1][2:] == ("EXPIRED_PENDING", "profile_unavailable_timeout")


def test_a_bridge_seen_twice_merges_its_ends(spark):
    rows = [{"t": 4.0 * k, "judged": False, "seen": [box(0, True, False), box(45, True, False)]} for k in range(2)]
    rows += [{"t": 8.0 + 4 * k, "judged": False, "seen": [box(20 + k, True, False)]} for k in range(2)]
    got = states(memory.event_memory(ticks(spark, rows), ["view"], "n", RULES))
    assert (12.0, 2, "MERGED", "merged_into:1") in got and not any(x[2] == "MERGED" and x[0] < 12 for x in got)
    assert not any(x[2] == "MERGED" for x in states(memory.event_memory(ticks(spark, rows[:3]), ["view"], "n", RULES)))


def test_memory_of_nulls_repeats_and_nothing(spark):
    rows = [{"t": 4.0 * k, "seen": [box(0, True, True), (None, 0.0, 1.0, 1.0, True, True), box(9, None, None) + (None, None)]} for k in range(3)]
    table = ticks(spark, rows)
    again = table.unionByName(table).unionByName(table.withColumn("ts_s", F.lit(None).cast("double")))
    once = states(memory.event_memory(table, ["view"], "n", RULES))
    assert once and states(memory.event_memory(again, ["view"], "n", RULES)) == once
    unnamed = memory.event_memory(table.withColumn("view", F.lit(None).cast("string")), ["view"], "n", RULES)
    assert states(unnamed) == once
    assert memory.event_memory(table.limit(0), ["view"], "n", RULES).count() == 0


def test_memory_goes_on_from_batch_to_batch(spark):
    r = random.Random(4)
    rows = [{"view": f"v{k % 2}", "t": float(k), "scanned": r.random() < 0.7, "judged": r.random() < 0.9, "seen": [box(r.choice([0, 25, 45, 90]) + r.random(), r.random() < 0.6, True)] if r.random() < 0.5 else None, "actors": [box(0)] if r.random() < 0.1 else None} for k in range(160)]
    table = ticks(spark, rows)
    whole = states(memory.event_memory(table, ["view"], "n", RULES))
    parts = replay_slices(table, "ts_s", lambda s: stream_memory.event_memory(s, ["view"], "n", RULES), 3)
    assert len(whole) > 30 and states(parts) == whole


SCORES = "view string, ts_s double, n bigint, profile bigint, score double, enter boolean, hold boolean, sound boolean, rough double"


def profiles(spark, rows):
    return spark.createDataFrame([("v", float(t), t, p, s, True, True, sound, float(p)) for t, by in enumerate(rows) for p, (s, sound) in by.items()], SCORES).repartition(3)


def decided(table, limits=selector.Limits()):
    return [(r.active, r.status, r.reason) for r in selector.selected_profiles(table, ["view"], "n", limits).orderBy("ts_s").collect()]


def test_a_better_profile_has_to_stay_better(spark):
    good, better = (0.4, True), (0.2, True)
    rows = [{1: good, 2: (0.9, True)}] * 4 + [{1: good, 2: better}] * 16
    got = decided(profiles(spark, rows), selector.Limits(top_k=2))
    assert got[2][0] == 1 and [x[2] for x in got[4:8]] == ["WAITING_SWITCH_EVIDENCE"] * 4 and "WAITING_MIN_DWELL" in {x[2] for x in got}
    switched = next(k for k, x in enumerate(got) if x[0] == 2)
    assert got[switched][2] == "SWITCH_READY" and switched == 12 and all(x[0] == 2 for x in got[switched:])
    flicker = [{1: good, 2: better if k % 2 else (0.39, True)} for k in range(30)]
    assert not any(x[2] == "SWITCH_READY" for x in decided(profiles(spark, flicker), selector.Limits(top_k=2)))


def test_a_failed_check_cools_the_profile_down(spark):
    got = decided(profiles(spark, [{1: (0.2, False), 2: (0.3, True)}] * 8))
    assert got[2] == (None, "SWITCH_PENDING", "RECOVERY_READY") and got[5] == (2, "SWITCH_PENDING", "RECOVERY_READY")


def test_the_search_reaches_every_profile(spark):
    rows = [{p: (0.5, True) for p in range(12)} for _ in range(5)]
    table = profiles(spark, rows).withColumn("enter", F.col("profile") == 11)
    got = selector.selected_profiles(table, ["view"], "n").orderBy("ts_s").collect()
    assert [r.tested for r in got[:4]] == [3] * 4 and got[3].candidate == 11
    assert selector.selected_profiles(table.limit(0), ["view"], "n").count() == 0
    bad = table.unionByName(table.withColumn("score", F.lit(None).cast("double"))).unionByName(table.withColumn("ts_s", F.lit(None).cast("double")))
    assert decided(bad) == decided(table)


def test_ledger_keeps_targets_apart_and_leaves_reviewed_ones_alone(spark):
    def seen(t, n, x, source=1, verdict="boat_confirmed"):
        return ("s", float(t), n, x, 0.5, 0.02, 0.02, source, verdict)

    schema = "stream string, ts_s double, n bigint, x double, y double, w double, h double, source bigint, verdict string"
    rows = [seen(0, 1, 0.10), seen(0, 2, 0.105), seen(10, 3, 0.12), seen(70, 4, 0.11), seen(100, 5, 0.10), seen(5000, 6, 0.10), seen(5001, 7, 0.5, verdict=None)]
    table = spark.createDataFrame(rows, schema).repartition(3)
    got = {r.n: (r.target, r.found, r.claimed) for r in targets.target_ledger(table, "stream", "n").collect()}
    assert got[1] == (1, "new", True) and got[2] == (2, "new", True), "two sightings of one instant are two targets"
    assert got[3][0] in (1, 2) and got[3][1:] == ("matched", False), "a job is active"
    assert got[4][1] == "reviewed" and not got[4][2] and got[6] == (6, "new", True), "forgotten after a while"
    assert targets.target_ledger(table.limit(0), "stream", "n").count() == 0
    assert targets.target_ledger(table.withColumn("x", F.lit(None).cast("double")), "stream", "n").count() == 0


def test_a_batch_that_runs_again_claims_nothing_new(spark, tmp_path):
    schema = "target bigint, " + targets.REQUEST
    batches = [[(1, 0.0, 1, True, 0.0), (1, 1.0, 2, True, 0.0), (2, 0.0, 3, True, 0.0)], [(1, 5.0, 4, False, 10.0), (1, 6.0, 5, True, 0.0), (2, 6.0, 6, True, 0.0)], [(1, 15.0, 7, True, 0.0), (2, 7.0, 8, False, 1.0), (2, 7.0, 9, True, 0.0)]]
    each = claims.claiming(str(tmp_path), "target")
    for number in (0, 1, 1, 0, 2, 1, 2):
        each(spark.createDataFrame(batches[number], schema), number)
    got = {r.tie: r.granted for r in spark.read.parquet(f"{tmp_path}/jobs").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True, 8: True, 9: False}
    free = spark.createDataFrame([], f"target bigint, {targets.HELD}")
    whole = targets.claimed(spark.createDataFrame([x for b in batches for x in b], schema), free, "target")[0]
    assert {r.tie: r.granted for r in whole.collect()} == got


def test_late_rows_are_counted_and_set_aside(spark, tmp_path):
    schema = "key string, ts_s double, n bigint"
    batches = [[("a", 1.0, 1), ("a", 3.0, 2), ("a", 3.0, 3), (None, 5.0, 4)], [("a", 2.0, 5), ("a", 4.0, 6), ("b", 1.0, 7), (None, 5.0, 8), ("a", None, 9)]]
    each = health.in_time(str(tmp_path), "key", "n")
    for number in (0, 1, 1):
        each(spark.createDataFrame(batches[number], schema), number)
    assert {r.n for r in spark.read.parquet(f"{tmp_path}/rows").collect()} == {1, 2, 4, 6, 7}
    late = {r.n: (r.reason, r.late_by) for r in spark.read.parquet(f"{tmp_path}/late").collect()}
    assert late == {3: ("repeated", None), 5: ("late", 1.0), 8: ("late", 0.0), 9: ("no clock", None)}
    counts = spark.read.parquet(f"{tmp_path}/counts").where("key = 'a'").agg(F.sum("accepted"), F.sum("refused")).first()
    assert tuple(counts) == (3, 3)


def test_recovery_keeps_its_cap_and_says_so(spark):
    schema = "cam string, ts_s double, cand_id bigint, score double, passed boolean, x0 double, y0 double, x1 double, y1 double"
    far = [("c", float(t), 10 * t + k, 0.5, False, *box(500.0 * k)) for t in range(4) for k in range(3)]
    table = spark.createDataFrame(far + [("c", 0.0, 99, 0.9, True, *box(1000.0)), ("c", 1.0, 98, None, False, *box(9000.0)), ("c", None, 97, 0.5, False, *box(0.0))], schema).repartition(3)
    assert {(r.cand_id, r.other, r.score) for r in scenes.rescued_at_once(table, "cam").collect()} == {(2, 99, 0.9)}
    got = {r.cand_id: r for r in scenes.rescued_in_time(table, "cam", scenes.Rescue(most_tracks=32)).collect()}
    assert {k for k, r in got.items() if r.rescued} == {20, 21, 32} and not any(r.evicted for r in got.values())
    capped = scenes.rescued_in_time(table, "cam", scenes.Rescue(most_tracks=2)).collect()
    assert any(r.evicted for r in capped) and sum(r.rescued for r in capped) < 3
    assert scenes.rescued_in_time(table.limit(0), "cam").count() == 0


def test_episodes_part_where_two_are_as_near(spark):
    schema = "cam string, ts_s double, n bigint, dense boolean, x0 double, y0 double, x1 double, y1 double"
    rows = [("c", 0.0, 1, True, *box(0)), ("c", 1.0, 2, True, *box(30)), ("c", 2.0, 3, True, *box(15)), ("c", 3.0, 4, True, *box(1)), ("c", 100.0, 5, True, *box(0)), ("c", 460.0, 6, None, *box(0)), ("c", 461.0, 7, None, None, 0.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, schema).repartition(3)
    got = {r.n: (r.episode, r.parents) for r in scenes.running_episodes(table, "cam", "n").collect()}
    assert got == {1: (1, None), 2: (2, None), 3: (3, [1, 2]), 4: (1, None), 5: (5, None), 6: (5, None)}
    assert scenes.running_episodes(table.limit(0), "cam", "n").count() == 0


def test_large_changes_are_sampled_twice(spark):
    rows = [("c", float(t), t, 0.0, 0.0, 2) for t in range(3)] + [("c", 3.0, 3, 0.5, 0.5, 2), ("c", 5.0, 5, 0.5, 0.5, 2), ("c", 6.0, 6, None, None, 2), ("c", 9.0, 9, 0.0, 0.0, 2)]
    rows += [("c", float(t), t, 0.0, 0.0, 9) for t in range(10, 18)] + [("c", None, 99, 0.0, 0.0, 1)]
    table = spark.createDataFrame(rows, "cam string, ts_s double, n2 bigint, change double, motion double, n bigint").repartition(3)
    got = [(r.n2, r.phase, r.reason, r.published) for r in scenes.scene_phases(table, "cam", "n2", scenes.Phases(samples=3, interval=1.0, large=3)).orderBy("n2").collect()]
    assert got[2] == (2, "stable", "initial", 2) and got[4][1] == "dirty" and got[6] == (9, "sampling", "scene_changed", 2)
    assert (12, "sampling", "large_change_confirmation", 2) in got and got[9 - 1 + 7 - 1][3] == 9
    assert scene_phases_of_nothing(table) == 0


def scene_phases_of_nothing(table):
    return scenes.scene_phases(table.limit(0), "cam", "n2").count()


def test_repeated_points_keep_their_rows(spark):
    points = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 50.0), (None, 1.0), ("a", None)], "k string, at double")
    spans = spark.createDataFrame([("a", 0.0, 10.0, 1)], "k string, s double, e double, id long")
    got = sorted((r.k or "", r.at or -1, r.n, r.status) for r in joins.in_interval(points, spans, ["k"], "at", "s", "e", "id").collect())
    assert got == [("", 1.0, 0, "missing"), ("a", -1, 0, "missing"), ("a", 1.0, 1, "found"), ("a", 1.0, 1, "found"), ("a", 50.0, 0, "missing")]


def test_null_keys_carry_on_over_blocks(spark):
    rows = spark.createDataFrame([(None, 0.0, 1), (None, 90_000.0, 2), ("a", 0.0, 3)], "k string, ts_s double, n long")
    got = {r.n: r.s for r in blocks.running(rows, ["k"], ["ts_s", "n"], sums={"s": F.lit(1)}).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    assert {r.n: r.prev1_n for r in blocks.previous(rows, ["k"], ["ts_s", "n"], ["n"]).collect()} == {1: None, 2: 1, 3: None}


@pytest.mark.parametrize("most", [1000, 2])
def test_large_boxes_clash_and_unscored_ones_come_last(spark, most):
    made = [("k", 1, 0.9, box(0, size=600.0)), ("k", 2, 0.8, box(220, size=600.0)), ("k", 3, None, box(0, size=600.0)), ("k", 4, None, box(5000)), ("k", 5, 0.1, box(420, size=600.0)), (None, 6, 0.1, box(0))]
    rows = spark.createDataFrame(made, f"cam string, id long, score double, box {BOX}")
    kept = {r.id for r in events.strongest(rows, ["cam"], "score", 100.0, events.same_proposal, most=most).collect()}
    assert kept == {1, 4, 5, 6}


def test_boxes_of_any_size_meet(spark):
    r = random.Random(7)
    made = [(k, k % 2, (x := r.uniform(-900, 900), y := r.uniform(-900, 900), x + r.choice([1, 50, 900]), y + r.choice([1, 50, 900]))) for k in range(120)]
    rows = spark.createDataFrame([(i, c, b) for i, c, b in made], f"id long, cam long, box {BOX}")
    other = rows.select("cam", F.col("id").alias("other"), "box")
    over = lambda a, b: max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0) > 0
    from lynxframe.functions import geometry as G

    pairs = joins.touching_boxes(rows, other, ["cam"], 100.0, lambda a, b: (F.col("id") < F.col("other")) & (G.overlap(a, b) > 0))
    assert sorted((p.id, p.other) for p in pairs.collect()) == sorted((a[0], b[0]) for a in made for b in made if a[0] < b[0] and a[1] == b[1] and over(a[2], b[2]))
    semi = joins.touching_boxes(rows.where("id < 50"), other.where("other >= 50"), ["cam"], 100.0, lambda a, b: G.overlap(a, b) > 0, how="left_semi")
    assert {x.id for x in semi.collect()} == {a[0] for a in made for b in made if a[0] < 50 <= b[0] and a[1] == b[1] and over(a[2], b[2])}
