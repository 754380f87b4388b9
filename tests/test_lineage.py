"""Lineage rules, events at one place, listings, frozen truth, evenly spaced rows and heads, against plain computations."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lynxframe.operators import events, learning, lineage, reports, selection, states
from lynxframe.sources import listing, truth, versions


def test_trainability_by_the_first_rule_that_holds(spark):
    card = "card string, file_id string, frame_id string, ts_s double, full_frame boolean, assets boolean, reachable boolean"
    cards = [
        ("whole", None, None, None, True, False, None), ("kept", "f", None, 50.0, None, True, True), ("unreached", "f", None, None, None, True, None), ("old", "f", "g", 5.0, None, True, True),
        ("crop", None, None, 50.0, None, True, None), ("frame", None, "g", 50.0, None, True, None), ("bare", "f", None, 50.0, None, None, None), ("nothing", None, "g", None, None, True, None),
    ]
    groups = {"e1": ["old", "whole"], "e2": ["kept"], "e3": ["unreached", "crop"], "e4": ["old", "crop"], "e5": ["crop", "frame"], "e6": ["frame", "bare"], "e7": ["bare"], "e8": ["unknown"], "e9": ["nothing"]}
    members = spark.createDataFrame([(e, c) for e, cs in groups.items() for c in cs], "episode string, card string")
    out = lineage.trainability(members, spark.createDataFrame(cards, card), "episode", "card", F.lit(10.0))
    said = {r.episode: (r.status[0], r.method[0], r.reason[:14]) for r in out.collect()}
    assert said == {
        "e1": ("T", "A", ""), "e2": ("T", "B", ""), "e3": ("T", "B", "ps_reachabilit"), "e4": ("R", "n", "recording_beyo"), "e5": ("R", "n", "only_derived_c"),
        "e6": ("L", "n", "source_file_id"), "e7": ("L", "n", "referenced_ass"), "e8": ("L", "n", "referenced_ass"), "e9": ("L", "n", "insufficient_l"),
    }
    assert {(r.status[0], r.n) for r in lineage.readiness(out).collect()} == {("T", 1), ("R", 1), ("L", 1), ("L", 2)}
    assert lineage.trainability(members.limit(0), spark.createDataFrame(cards, card), "episode", "card").count() == 0


def test_risk_needs_two_members(spark):
    only = lineage.LINEAGE_ONLY[0]
    candidates = spark.createDataFrame([("a", [only]), ("b", ["near", only, "near"]), ("c", None), ("d", [])], "episode string, reasons array<string>")
    members = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("c", 1, None), ("c", 1, True), ("d", None, False), ("d", None, None)], "episode string, at int, wrong boolean")
    out = {r.episode: r[1:] for r in lineage.grouping_risk(candidates, members, "episode", "at", F.col("wrong")).collect()}
    assert out["a"] == ([], [only], False, True)
    assert out["b"] == (["near"], [only], True, False)
    assert out["c"] == (["box_wrong_participates_in_grouping", "same_frame_merge_risk"], [], True, False)
    assert out["d"] == ([], [], False, False)


def test_media_time_faults(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 99.0), ("b", 4, 1.0), ("c", 5, 1.0), ("a", 6, None)], "run string, n int, ts double")
    mapping = spark.createDataFrame([("a", -5.0), ("b", 0.0), ("b", 1.0)], "run string, offset_s double")
    out = lineage.to_media_time(rows, mapping, ["run"], "ts", "n", 10, F.col("n")).orderBy("n").collect()
    assert [r.fault for r in out] == [None, "not increasing", "out of range", "ambiguous", "unmapped", None]
    assert [r.media_s for r in out] == [0.0, 0.0, 94.0, None, None, None]


def test_strongest_is_the_walk_from_the_highest_score(spark):
    seed = random.Random(5)
    rows = [(seed.randrange(2), i, seed.randrange(6) / 5, (x := seed.randrange(90)) * 1.0, (y := seed.randrange(60)) * 1.0, x + 8.0 + seed.randrange(9), y + 8.0 + seed.randrange(9)) for i in range(250)]

    def clash(a, b):
        w, h = max(0, min(a[5], b[5]) - max(a[3], b[3])), max(0, min(a[6], b[6]) - max(a[4], b[4]))
        return w * h > 20

    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if not any(k[0] == r[0] and clash(k, r) for k in kept):
            kept.append(r)
    table = spark.createDataFrame(rows, "camera int, id int, score double, x0 double, y0 double, x1 double, y1 double").withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    from lynxframe.functions import geometry as G

    out = events.strongest(table, ["camera"], "score", 17.0, lambda a, b: G.overlap(a, b) > 20)
    assert sorted(r.id for r in out.collect()) == sorted(k[1] for k in kept) and 0 < len(kept) < 250
    assert events.strongest(table.limit(0), ["camera"], "score", 17.0, lambda a, b: G.overlap(a, b) > 20).count() == 0


def test_evenly_spaced_takes_the_nearest_free_row(spark):
    seed = random.Random(3)
    rows = [("a", float(seed.randrange(40)), i) for i in range(30)] + [("b", 7.0, 100), ("b", 7.0, 101)] + [("c", 1.0, i) for i in range(200, 206)]
    want = set()
    for key in "abc":
        own = sorted((t, i) for k, t, i in rows if k == key)
        if len(own) <= 5:
            want |= {(key, i, None) for _, i in own}
            continue
        free, low, high = list(own), own[0][0], own[-1][0]
        for slot in range(5):
            best = min(free, key=lambda r: (abs(r[0] - (low + (slot + 0.5) * (high - low) / 5)), r))
            free.remove(best)
            want.add((key, best[1], slot))
    out = selection.evenly_spaced(spark.createDataFrame(rows, "k string, t double, i long"), "k", "t", "i", 5)
    assert {tuple(r) for r in out.collect()} == want


def test_listing_keeps_what_is_wrong_with_a_name(spark):
    ok = {"fileId": " 7 ", "recordStartTime": "2024-01-02T03:04:05", "recordEndTime": "2024-01-02 03:05:05", "fileSize": "12", "errorMessage": "broken"}
    bad = [ok | {"fileId": ""}, ok | {"fileSize": "-1"}, ok | {"urlExpireSeconds": 0}, ok | {"recordStartTime": "2024"}, ok | {"recordEndTime": None}]
    pages = [
        ("list", json.dumps({"code": 200, "data": [ok]})), ("rows", json.dumps({"code": 200, "data": {"total": 9, "rows": bad}})), ("empty", json.dumps({"code": 200, "data": []})),
        ("code", json.dumps({"code": 500, "data": [ok]})), ("none", json.dumps({"code": 200, "data": {"x": 1}})), ("text", "oops"), ("null", None),
    ]
    out = listing.parse_pages(spark.createDataFrame(pages, "page string, body string")).collect()
    by = {p: [r.fault for r in out if r.page == p] for p, _ in pages}
    assert by == {"list": [None], "rows": ["file_id", "file_size", "url_expires", "record_start", "record_end"], "empty": [], "code": ["code"], "none": ["no files"], "text": ["no object"], "null": ["no object"]}
    first = next(r for r in out if r.page == "list")
    assert (first.file_id, first.record_start, first.file_size, first.error_message, first.url_expires_s) == ("7", "2024-01-02 03:04:05", 12, "broken", 120.0)


def test_folders_of_events_and_files(spark, tmp_path):
    for stream, name, text in (("s1", "a", '{"event_id": "a",\n "stream_id": "s1"}'), ("s1", "b", "{broken"), ("s2", "c", '{"event_id": "c", "stream_id": "s2"}')):
        (tmp_path / stream).mkdir(exist_ok=True)
        (tmp_path / stream / f"{name}.json").write_text(text)
    assert sorted(r.event_id for r in listing.event_store(spark, str(tmp_path), "event_id string, stream_id string").collect()) == ["a", "c"]
    found = listing.inventory(spark, str(tmp_path), "*.json").collect()
    assert sorted((r.path[-6:], r.length) for r in found)[1] == ("b.json", 7) and len(found) == 3
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    listing.write_lines(rows, str(tmp_path / "lines"))
    assert sorted(map(tuple, listing.read_lines(spark, str(tmp_path / "lines"), "id int, t string").collect())) == [(1, "x"), (2, None)]


def test_truth_is_frozen_once_reviewed_and_corrected_beside(spark, tmp_path):
    root = str(tmp_path / "truth")
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, label string")
    decided = spark.createDataFrame([("a",)], "id string")
    errata = spark.createDataFrame([("a", "n", "5", "typo", False, 1), ("a", "n", "6", "again", True, 2), ("b", "label", None, "unknown", True, 1)], "truth_id string, column string, value string, reason string, after_inference boolean, s int")
    errata = errata.withColumn("at", F.timestamp_seconds("s"))
    with pytest.raises(ValueError, match="no frozen"):
        truth.add_errata(spark, errata, root)
    with pytest.raises(ValueError, match="not complete"):
        truth.freeze(spark, rows, decided, "id", root)
    assert truth.freeze(spark, rows, rows, "id", root) == 1
    with pytest.raises(ValueError, match="without a reason"):
        truth.add_errata(spark, errata.withColumn("reason", F.lit(" ")), root)
    truth.add_errata(spark, errata, root)
    frozen = versions.resolve(spark, root, verify=True)
    assert sorted(map(tuple, frozen.collect())) == [("a", 1, "x"), ("b", 2, "y")]
    assert sorted(map(tuple, truth.corrected(frozen, spark.read.parquet(f"{root}/errata"), "id", ["n", "label"]).collect())) == [("a", 6, "x"), ("b", 2, None)]


def test_heads_score_groups_that_they_never_saw(spark):
    seed = random.Random(9)
    rows = [(i, f"g{i % 4}", [(1.0 if i % 3 == 0 else -1.0) + seed.gauss(0, 0.6), seed.gauss(0, 1), 0.0], int(i % 3 == 0)) for i in range(400)] + [(900 + i, "alone", [0.1, 0.2, 0.0], 0) for i in range(3)] + [(999, "g0", [1.0, 0.0, 0.0], None)]
    out, heads = learning.held_out(spark.createDataFrame(rows, "id int, g string, v array<double>, label int"), "v", "label", "g")
    got = {r.id: r for r in out.collect()}
    assert len(heads) == 4 and all(got[900 + i].score is None for i in range(3)) and got[999].score > 0
    assert sum((got[i].score > 0) == (got[i].label == 1) for i in range(400)) > 340
    with pytest.raises(ValueError, match="needs labels"):
        learning.fit(out.where("label = 0"), "v", "label")
    with pytest.raises(ValueError, match="more than 2"):
        learning.held_out(out, "v", "label", "g", most_groups=2)
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(learning.linear_score(F.col("v"), learning.Head([2.0, 1.0], 0.5, [0.0, 1.0], [1.0, 0.0])).alias("s"))
    assert zero.first().s == pytest.approx(0.5 - 1000)


def test_phase_report_counts_nulls_and_all(spark):
    rows = spark.createDataFrame([("x", 1), (None, 1)], "k string, n int")
    out = {tuple(r) for r in reports.phase_report({"t": (rows, [["k", "n"]])}).collect()}
    assert out == {("t", "", "", 2), ("t", "k,n", "x|1", 1), ("t", "k,n", "-|1", 1)}


def test_one_alert_a_visit_and_none_in_the_cooldown(spark):
    rows = [("a", 1, 0.0, 50), ("a", 1, 1.0, 60), ("a", 1, 2.0, 99), ("a", 2, 5.0, 70), ("a", 2, 11.0, 70), ("a", 2, 40.0, 70), ("b", 1, 3.0, 60), ("b", 1, None, 90)]
    out = states.visit_alerts(spark.createDataFrame(rows, "k string, visit int, t double, score int"), ["k"], ["t"], "visit", "score", 60, 10.0)
    assert sorted((r.k, r.visit, r.t) for r in out.collect()) == [("a", 1, 1.0), ("a", 2, 11.0), ("b", 1, 3.0)]
