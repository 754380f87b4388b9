"""Operators that SQL cannot express, against plain computations, and the edges of sources and expressions."""

from __future__ import annotations

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from lynxframe.functions import text as T
from lynxframe.functions import rules as R
from lynxframe.operators import blocks, gates, graph, joins, metrics, selection, states, tracking
from lynxframe.plans import catalogue
from lynxframe.shared import hot_join, hot_keys, salted_join
from lynxframe.sources import logs, versions

BOXES = "stream_id string, ts_s double, frame_no long, x0 double, y0 double, x1 double, y1 double"


def like(a, b):
    """Score of two boxes, None if they cannot be one object."""
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    iou = w * h / union if union > 0 else 0
    side = max(a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1])
    far = (((a[0] + a[2] - b[0] - b[2]) ** 2 + (a[1] + a[3] - b[1] - b[3]) ** 2) ** 0.5 / 2 / side) if side > 0 else float("inf")
    return iou * 2 - far / 4 if iou >= 0.3 or far <= 0.5 else None


def plain_tracks(rows, hold):
    """The contract: at each instant the best pair of an open track and a free detection is joined until none is left."""
    names = {}
    usable = sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1], r[2]))
    members = {}  # (stream, number) -> its detections
    for stream, now in sorted({(r[0], r[1]) for r in usable}):
        free = [r for r in usable if r[:2] == (stream, now)]
        fresh = {k: m[-1] for k, m in members.items() if k[0] == stream and now - m[-1][1] <= hold}
        while pairs := [(s, k, free.index(r), r) for k, last in fresh.items() for r in free if r[2] not in names and (s := like(last[3:], r[3:])) is not None]:
            _, k, _, r = max(pairs)
            members[k].append(r)
            names[r[2]] = (k[1], len(members[k]))
            del fresh[k]
        for r in free:
            if r[2] not in names:
                k = (stream, sum(x[0] == stream for x in members) + 1)
                members[k] = [r]
                names[r[2]] = (k[1], 1)
    return {(r[0], r[2]): names[r[2]] for r in usable}


def test_sparse_tracks(spark):
    r = random.Random(1)
    rows = []
    for n in range(400):
        x, y = r.randrange(12), r.randrange(4)
        rows.append((f"s{r.randrange(3)}", float(r.randrange(150)), n, float(x), float(y), float(x + 2), float(y + 2)))
    rows += [("s0", None, 900, 0.0, 0.0, 1.0, 1.0), ("s0", 1.0, 901, None, 0.0, 1.0, 1.0), ("s1", 5.0, 902, 1.0, 1.0, 1.0, 1.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = tracking.sparse_tracks(spark.createDataFrame(rows, BOXES).withColumn("hits", F.lit(0)), hold_s=4.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(x.stream_id, x.frame_no): (x.object_id, x.hits) for x in out} == plain_tracks(rows, 4.0)
    assert len(out) == 401
    assert tracking.sparse_tracks(spark.createDataFrame([], BOXES), 4.0).count() == 0


def test_logs(spark, tmp_path):
    good = [{"sequence": n, "stream_id": "a", "level": "info" if n % 2 else "error", "event": "e", "details": {"k": "v"}} for n in range(6)]
    lines = [json.dumps(x) for x in good]
    (tmp_path / "clean.jsonl").write_text("\n".join(lines))
    (tmp_path / "torn.jsonl").write_text("\n".join([lines[0], lines[1][:20], "", "null", "[]", *lines[2:]]))
    assert logs.read_logs(spark, str(tmp_path / "clean.jsonl"), strict=True).count() == 6
    torn = logs.read_logs(spark, str(tmp_path / "torn.jsonl"))
    assert sorted(x.sequence for x in torn.collect()) == [0, 2, 3, 4, 5]
    assert [x.sequence for x in logs.after(torn, 2, level="error", event="e").collect()] == [4]
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED"):
        logs.read_logs(spark, str(tmp_path / "torn.jsonl"), strict=True).collect()


def test_versions(spark, tmp_path):
    root = str(tmp_path / "bank")
    assert versions.versions(spark, root).count() == 0
    with pytest.raises(ValueError):
        versions.resolve(spark, root)
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    b = spark.createDataFrame([(1, None), (2, "x")], "id long, name string")
    assert versions.publish(spark, a, root) == 1 and versions.publish(spark, b, root) == 2
    assert sorted(versions.resolve(spark, root, verify=True).collect()) == sorted(b.collect())
    assert sorted(x.id for x in versions.resolve(spark, root, 1, verify=True).collect()) == [1, 2]
    assert versions.fingerprint(a) == versions.fingerprint(a.select("name", "id").repartition(3)) != versions.fingerprint(b)
    folder = versions.versions(spark, root).where("version = 1").first().folder
    b.write.mode("overwrite").parquet(f"{root}/{folder}")
    with pytest.raises(ValueError):
        versions.resolve(spark, root, 1, verify=True)


def test_text_edges(spark):
    rows = spark.createDataFrame([("京a·123-45",), ("京I12345",), ("京A123456",), ("",), (None,)], "t string")
    assert [x[0] for x in rows.select(T.plate(F.col("t"))).collect()] == ["京A12345", None, "京A123456", None, None]
    said = spark.createDataFrame([("see rtsp://u:p@h/x and rtsps://v@h",), ("rtsp://h/a@b",), (None,)], "t string")
    assert [x[0] for x in said.select(T.redacted(F.col("t"))).collect()] == ["see rtsp://***@h/x and rtsps://***@h", "rtsp://h/a@b", None]
    turns = spark.sql("select T.* from values (1D, 0D, 0D, 1D), (0D, 0D, 1D, 1D), (1D, 0D, -1D, 0D) T(a, b, c, d)")
    assert [round(x[0], 6) for x in turns.select(T.turn_degrees(*[F.col(c) for c in "abcd"])).collect()] == [90.0, 0.0, 180.0]


def test_threshold_ties(spark):
    rows = [("a", 0.95, 1), ("a", 1.0, 1), ("a", 0.2, 0), ("b", 0.5, 0), ("c", 0.5, 1), ("c", 0.5, 0)]
    out = metrics.choose_threshold(spark.createDataFrame(rows, "g string, score double, label long"), "g", 10, 0.02).collect()
    assert sorted(map(tuple, out)) == [("a", 0.9, 1.0, 0.0), ("c", 0.5, 1.0, 50.0)]


def test_components(spark):
    r = random.Random(2)
    path = list(range(100, 160))
    r.shuffle(path)
    links = [*zip(path, path[1:], strict=False), (1, 1), (2, 3), (3, 2), (9, 4)]
    nodes = spark.createDataFrame([(n,) for n in [*path, 1, 2, 3, 4, 9, 50]], "id long")
    out = dict(map(tuple, graph.components(nodes, spark.createDataFrame(links, "a long, b long")).collect()))
    assert out == {**dict.fromkeys(path, 100), 1: 1, 2: 2, 3: 2, 4: 4, 9: 4, 50: 50}
    assert graph.components(nodes.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_streams_read_tables_of_several_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_tumbling_metrics", "stream_user_sessions", "stream_first_per_hour"):
        query = catalogue.QUERIES[name]
        one, parts = (sorted(map(tuple, query(spark, at).collect())) for at in ("/root/testdata/sf0.001", str(tmp_path)))
        assert one and parts == one


def test_blocks_are_windows(spark):
    """Rows before, running sums and maxima, ranks and medians in blocks equal plain windows, whatever the blocks."""
    r = random.Random(5)
    rows = [(r.choice("abc"), float(r.choice([1, 2, 3, 50, 51, 90, 300])) if r.random() < 0.95 else None, n, r.choice([None, 1, 5, 9])) for n in range(200)]
    df = spark.createDataFrame(rows, "k string, ts_s double, n long, v long")
    w = Window.partitionBy("k").orderBy("ts_s", "n")
    for length in (1.0, 40.0, 1e9):
        block = blocks.by_time("ts_s", length)
        got = blocks.previous(df, ["k"], ["ts_s", "n"], ["n", "v"], n=3, block=block).select("n", *[f"prev{i}_{c}" for i in (1, 2, 3) for c in "nv"]).collect()
        want = df.select("n", *[F.lag(c, i).over(w).alias(f"prev{i}_{c}") for i in (1, 2, 3) for c in "nv"]).collect()
        assert sorted(map(tuple, got), key=lambda x: x[0]) == sorted(map(tuple, want), key=lambda x: x[0])
        got = blocks.running(df, ["k"], ["ts_s", "n"], sums={"s": F.col("v")}, highs={"h": F.col("v")}, block=block).select("n", "s", "h").collect()
        want = df.select("n", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("h")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got = blocks.numbered(df.repartition(9), ["k"], [F.desc("ts_s"), F.col("n")], ["n"]).select("n", "place", "of", "sum_n").collect()
    down = Window.partitionBy("k").orderBy(F.desc("ts_s"), "n")
    want = df.select("n", F.row_number().over(down).alias("p"), F.count("*").over(Window.partitionBy("k")).alias("of"), F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got, want = dict(blocks.exact_median(df, ["k"], "v").collect()), dict(df.groupBy("k").agg(F.median("v")).collect())
    assert got == want and blocks.exact_median(df.limit(0), ["k"], "v").count() == 0


def test_hot_joins_lose_no_row(spark):
    rows = spark.createDataFrame([(1 if n % 3 else n, n) for n in range(3000)] + [(None, -1)], "k long, n long")
    other = spark.createDataFrame([(k, k * 2) for k in range(0, 3000, 2)] + [(1, 2)], "k long, v long")
    hot = hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")))
    assert [x.k for x in hot.collect()] == [1]
    want = sorted(map(tuple, rows.join(other, "k").select("k", "n", "v").collect()))
    assert sorted(map(tuple, hot_join(rows, other, ["k"], hot).select("k", "n", "v").collect())) == want
    assert sorted(map(tuple, salted_join(rows, other, ["k"], hot, ["n"]).select("k", "n", "v").collect())) == want
    assert hot_join(rows, other, ["k"], hot, "left").count() == 3001


def test_inventory(spark):
    """An item is created, seen, verified clean without pauses, cleared and made anew; a sighting restarts the clock."""
    box, far = (0.0, 0.0, 2.0, 2.0), (50.0, 0.0, 52.0, 2.0)
    said = [(0, box, False), (1, box, False), (2, box, True), (3, box, False), (4, box, True), (9, box, True), (10, box, True), (11, box, True), (13, box, True), (14, box, True), (15, box, False), (16, far, True)]
    rows = [("c", float(t), t, *b, clean) for t, b, clean in said]
    out = states.inventory(spark.createDataFrame(rows, "stream_id string, ts_s double, frame_no long, x0 double, y0 double, x1 double, y1 double, clean boolean"), "stream_id", ["ts_s", "frame_no"], clear_after=3.0, most_gap=2.0)
    assert [(x.item, x.outcome) for x in sorted(out.collect(), key=lambda x: x.ts_s)] == [
        (0, "created"), (0, "present"), (0, "verifying"), (0, "present"), (0, "verifying"), (0, "verifying"), (0, "verifying"), (0, "verifying"), (0, "cleared"), (None, "no item"), (15, "created"), (None, "no item"),
    ]


def test_ground_tracks(spark):
    """Confirmed once, after enough hits and time and little motion; a long pause or a far box is another object."""
    spots = [(0, 0.0), (2, 0.01), (4, 0.0), (5, 0.0), (6, 0.5), (20, 0.0), (21, 0.3)]
    rows = spark.createDataFrame([("c", float(t), n, x, 0.0) for n, (t, x) in enumerate(spots)], "s string, ts_s double, n long, cx double, cy double")
    out = sorted(states.ground_tracks(rows, "s", ["ts_s", "n"], lost=5.0, near=0.1, hold=4.0, least_hits=3, most_motion=0.05).collect(), key=lambda x: x.n)
    assert [(x.object, x.hits, x.confirmed) for x in out] == [(0, 1, False), (0, 2, False), (0, 3, True), (0, 4, False), (4, 1, False), (5, 1, False), (6, 1, False)]


def test_votes_and_budget(spark):
    reads = spark.createDataFrame([("t", n, v) for n, v in enumerate(["A", "A", "A", "B", None, "B", "B"])], "k string, n long, v string")
    out = sorted(states.majority_votes(reads, ["k"], ["n"], "v").collect(), key=lambda x: x.n)
    assert [(x.candidate, x.votes, x.confirmed) for x in out] == [("A", 1, None), ("A", 2, "A"), ("A", 3, "A"), ("A", 3, "A"), ("A", 3, "A"), ("B", 3, "B")]
    asked = spark.createDataFrame([("t", float(t), t) for t in (0, 10, 30, 40, 60, 90, 3600, 3601, 3640)], "k string, ts_s double, n long")
    out = sorted(states.hourly_budget(asked, "k", ["ts_s", "n"], most=3, interval=30.0).collect(), key=lambda x: x.n)
    assert [x.n for x in out if x.accepted] == [0, 30, 60, 3600, 3640]


def test_intervals_and_gates(spark):
    points = spark.createDataFrame([("c", t) for t in (-5.0, 0.0, 10.0, 15.0, 30.0, 99.0)], "k string, at double")
    spans = spark.createDataFrame([("c", 0.0, 10.0, 1), ("c", 12.0, 30.0, 2), ("c", 14.0, 20.0, 3)], "k string, a double, b double, id long")
    out = sorted(joins.in_interval(points, spans, ["k"], "at", "a", "b", "id", band=8.0).collect(), key=lambda x: x["at"])
    assert [(x.n, x.span, x.status) for x in out] == [(0, None, "expired"), (1, 1, "found"), (0, 1, "at end"), (2, 2, "several"), (0, 2, "at end"), (0, None, "missing")]
    gates.require(spans.where("b < a"), "interval")
    with pytest.raises(ValueError, match="interval"):
        gates.require(spans.where("id = 2"), "interval")
    ranks = spark.createDataFrame([(1,), (7,)], "r long")
    with pytest.raises(Exception, match="outside all bands"):
        ranks.select(R.rank_band(F.col("r"), [("top", 1, 5)])).collect()


def test_set_cover(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["d"]), (4, ["c", "d"])], "id long, b array<string>")
    assert selection.set_cover(rows, "id", "b", 3) == [2, 3, 1] and selection.set_cover(rows, "id", "b", 9) == [2, 3, 1, 4]
