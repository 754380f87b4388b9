"""Registered queries: evidence over time, plans of windows and tiles, tracking and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lynxframe.functions import text as T
from lynxframe.operators import blocks, records, samples, timeline, tracking
from lynxframe.plans.catalogue import query
from lynxframe.sources.fixtures import load
from lynxframe.streaming import replay as R


@query("""AS_ m AS (SELECT track_id, frame_no, ts_s, x0 - lag(x0) OVER w AS dx, y0 - lag(y0) OVER w AS dy FROM observations WINDOW w AS (PARTITION BY track_id ORDER BY ts_s, frame_no)), p AS (SELECT *, lag(dx) OVER w AS ex, lag(dy) OVER w AS ey FROM m WINDOW w AS (PARTITION BY track_id ORDER BY ts_s, frame_no))
SELECT track_id, frame_no, round(CASE WHEN sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey) <= 1e-12 THEN 0 ELSE degrees(acos(greatest(-1, least(1, (dx * ex + dy * ey) / (sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey)))))) END, 3) AS turn FROM p WHERE ex IS NOT NULL""", "observations")
def heading_turns(spark, sf_dir):
    w = Window.partitionBy("track_id").orderBy("ts_s", "frame_no")
    step = load(spark, sf_dir, "observations").select("track_id", "frame_no", "ts_s", *[(F.col(c) - F.lag(c).over(w)).alias(n) for c, n in (("x0", "dx"), ("y0", "dy"))])
    both = step.withColumn("ex", F.lag("dx").over(w)).withColumn("ey", F.lag("dy").over(w)).where("ex is not null")
    return both.select("track_id", "frame_no", F.round(T.turn_degrees(F.col("dx"), F.col("dy"), F.col("ex"), F.col("ey")), 3).alias("turn"))


@query("""SELECT track_id, frame_no, CASE WHEN max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER w = 1 THEN last_value(CASE WHEN kind = 'purchase' THEN value END IGNORE NULLS) OVER w END AS held FROM observations WINDOW w AS (PARTITION BY track_id ORDER BY ts_s, frame_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", "observations")
def hold_last_value(spark, sf_dir):
    rows = load(spark, sf_dir, "observations")
    return rows.select("track_id", "frame_no", records.held(rows, ["track_id"], ["ts_s", "frame_no"], F.when(F.col("kind") == "purchase", F.col("value")), 3).alias("held"))


@query("""AS_ c AS (SELECT track_id, frame_no, count(*) OVER w AS seen, sum(CASE WHEN kind IN ('click', 'view') THEN 1 ELSE 0 END) OVER w AS hits, ts_s - min(ts_s) OVER w AS span FROM observations WINDOW w AS (PARTITION BY track_id ORDER BY ts_s, frame_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT track_id, frame_no, hits, concat_ws(',', CASE WHEN hits < 3 THEN 'few hits' END, CASE WHEN span < 3600 THEN 'too short' END, CASE WHEN hits * 2 < seen THEN 'low share' END) AS reasons FROM c""", "observations")
def confirm_window(spark, sf_dir):
    out = samples.confirm_window(load(spark, sf_dir, "observations"), ["track_id"], ["ts_s", "frame_no"], F.col("kind").isin("click", "view"), 5, 3, 3600, 0.5)
    return out.select("track_id", "frame_no", "hits", "reasons")


@query("""SELECT stream_id, frame_no, count(*) OVER w = 3 AND min(kind) OVER w = max(kind) OVER w AND max(floor(ts_s / 3600)) OVER w = min(floor(ts_s / 3600)) OVER w AS frozen FROM observations WINDOW w AS (PARTITION BY stream_id ORDER BY ts_s, frame_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "observations")
def frozen_stream(spark, sf_dir):
    clock = F.floor(F.col("ts_s") / 3600)
    return timeline.frozen(load(spark, sf_dir, "observations"), ["stream_id"], ["ts_s", "frame_no"], "kind", clock, 3).select("stream_id", "frame_no", "frozen")


@query("SELECT track_id, count(DISTINCT CAST(floor(ts_s / 60) AS BIGINT)) * 60 AS visible_s FROM observations GROUP BY track_id", "observations")
def visible_seconds(spark, sf_dir):
    return samples.visible_seconds(load(spark, sf_dir, "observations"), ["track_id"], "ts_s", 60)


@query("SELECT file_id, CAST(unnest(range(CAST(start_s AS BIGINT), CAST(end_s AS BIGINT), 14400)) AS BIGINT) AS at_s FROM recordings", "recordings")
def interval_grid(spark, sf_dir):
    return samples.interval_grid(load(spark, sf_dir, "recordings"), "start_s", "end_s", 14400).select("file_id", "at_s")


@query("""AS_ t AS (SELECT DISTINCT camera, CAST(floor(start_s / 2592000) AS BIGINT) AS block FROM recordings), j AS (SELECT r.file_id, t.block, greatest(r.start_s, t.block * 2592000 + 432000) AS a, least(r.end_s, t.block * 2592000 + 2160000) AS b FROM recordings r JOIN t ON r.camera = t.camera AND t.block BETWEEN floor(r.start_s / 2592000) AND floor(r.end_s / 2592000))
SELECT file_id, block, round(greatest(b - a, 0), 3) AS usable_s, CASE WHEN b <= a THEN 'outside' WHEN b - a < 43200 THEN 'partial' ELSE 'whole' END AS state FROM j""", "recordings")
def usable_windows(spark, sf_dir):
    files = load(spark, sf_dir, "recordings")
    tasks = files.select("camera", F.floor(F.col("start_s") / 2592000).alias("block"))
    met = records.usable_windows(files, tasks, "camera", 2592000, 432000, 2160000, 43200)
    return met.select("file_id", "block", F.round("usable_s", 3).alias("usable_s"), "state")


@query("""AS_ s AS (SELECT c_custkey, 640 + (c_custkey % 7) * 200 AS w, 640 + (c_custkey % 5) * 150 AS h FROM customer), x AS (SELECT DISTINCT c_custkey, h, unnest(list_append(range(0, w - 639, 480), w - 640)) AS x FROM s) SELECT DISTINCT c_custkey, CAST(x AS BIGINT) AS x, CAST(unnest(list_append(range(0, h - 639, 480), h - 640)) AS BIGINT) AS y FROM x""", "scored")
def tile_plan(spark, sf_dir):
    starts = lambda n: F.explode(F.expr(f"array_distinct(concat(sequence(0L, {n} - 640, 480L), array({n} - 640)))"))
    sizes = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "640 + (c_custkey % 7) * 200 as w", "640 + (c_custkey % 5) * 150 as h")
    return sizes.select("c_custkey", "h", starts("w").alias("x")).select("c_custkey", "x", starts("h").alias("y"))


@query("AS_ b AS (SELECT camera, cell, frame_id % 4 AS block, median(gray) AS m FROM cells GROUP BY 1, 2, 3) SELECT camera, cell, round(median(m), 6) AS background FROM b GROUP BY 1, 2", "cells")
def two_level_median(spark, sf_dir):
    cells = load(spark, sf_dir, "cells").select("camera", "cell", (F.col("frame_id") % 4).alias("block"), "gray")
    inner = blocks.exact_median(cells, ["camera", "cell", "block"], "gray", "m")
    return blocks.exact_median(inner, ["camera", "cell"], "m", "background").withColumn("background", F.round("background", 6))


_TRK = "STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, seen DOUBLE, hits INTEGER)"
_BOTH = "(greatest(least(e.x1, s.x1) - greatest(e.x0, s.x0), 0) * greatest(least(e.y1, s.y1) - greatest(e.y0, s.y0), 0))"
_OVER = f"({_BOTH} / ((e.x1 - e.x0) * (e.y1 - e.y0) + (s.x1 - s.x0) * (s.y1 - s.y0) - {_BOTH}))"
_AWAY = "(sqrt((e.x0 + e.x1 - s.x0 - s.x1) * (e.x0 + e.x1 - s.x0 - s.x1) + (e.y0 + e.y1 - s.y0 - s.y1) * (e.y0 + e.y1 - s.y0 - s.y1)) / 2 / greatest(e.x1 - e.x0, e.y1 - e.y0, s.x1 - s.x0, s.y1 - s.y0))"


@query(f"""AS_ t AS MATERIALIZED (SELECT stream_id, ts_s, list({{'frame_no': frame_no, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY frame_no) AS seen, row_number() OVER (PARTITION BY stream_id ORDER BY ts_s) AS k FROM observations GROUP BY stream_id, ts_s),
m AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS made, CAST([] AS {_TRK}[]) AS tracks, CAST([] AS STRUCT(frame_no BIGINT, id BIGINT, hits INTEGER)[]) AS found FROM (SELECT DISTINCT stream_id FROM t)
UNION ALL SELECT m.stream_id, t.k, m.made + len(d.fresh), list_concat(list_transform(a.live, lambda e: coalesce(list_transform(list_filter(c.taken, lambda x: x.id = e.id), lambda x: {{'id': e.id, 'x0': t.seen[x.n].x0, 'y0': t.seen[x.n].y0, 'x1': t.seen[x.n].x1, 'y1': t.seen[x.n].y1, 'seen': t.ts_s, 'hits': e.hits + 1}})[1], e)), list_transform(d.fresh, lambda n, i: {{'id': m.made + i, 'x0': t.seen[n].x0, 'y0': t.seen[n].y0, 'x1': t.seen[n].x1, 'y1': t.seen[n].y1, 'seen': t.ts_s, 'hits': 1}}))::{_TRK}[],
list_transform(t.seen, lambda s, n: coalesce(list_transform(list_filter(c.taken, lambda x: x.n = n), lambda x: {{'frame_no': s.frame_no, 'id': x.id, 'hits': list_filter(a.live, lambda e: e.id = x.id)[1].hits + 1}})[1], {{'frame_no': s.frame_no, 'id': m.made + list_position(d.fresh, n), 'hits': 1}}))
FROM m JOIN t ON t.stream_id = m.stream_id AND t.k = m.k + 1, LATERAL (SELECT list_filter(m.tracks, lambda e: t.ts_s - e.seen <= 21600) AS live) a,
LATERAL (SELECT list_reverse_sort(list_filter(flatten(list_transform(a.live, lambda e: list_transform(t.seen, lambda s, n: {{'o': CASE WHEN {_OVER} >= 0.3 OR {_AWAY} <= 0.5 THEN {_OVER} * 2 - {_AWAY} / 4 END, 'id': e.id, 'n': n}}))), lambda x: x.o IS NOT NULL)) AS pairs) b,
LATERAL (SELECT CASE WHEN len(b.pairs) > 0 THEN list_reduce(list_transform(b.pairs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.id = x[1].id OR y.n = x[1].n)) > 0 THEN acc ELSE list_concat(acc, x) END) ELSE [] END AS taken) c,
LATERAL (SELECT list_filter(range(1, len(t.seen) + 1), lambda n: NOT list_contains(list_transform(c.taken, lambda x: x.n), n)) AS fresh) d),
f AS (SELECT m.stream_id, t.ts_s, unnest(found) AS f FROM m JOIN t USING (stream_id, k)) SELECT stream_id, f.frame_no, ts_s, f.id AS object_id, f.hits FROM f""", "observations")
def sparse_detection_tracks(spark, sf_dir):
    return tracking.sparse_tracks(load(spark, sf_dir, "observations"), hold_s=21600)


def _replay(spark, sf_dir, operator):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    seen = lambda rows: operator(rows.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value"))
    return R.replay(spark, sf_dir, "events.parquet", schema, seen)


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY 1, 2 HAVING epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) + 21600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events) - 3600000000")
def stream_tumbling_metrics(spark, sf_dir):
    out = _replay(spark, sf_dir, lambda rows: R.tumbling(rows, "ts", ["event_type"], "6 hours", "1 hour", n=F.count("*"), top=F.max("value")))
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("top", 6).alias("top"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), v AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS n FROM v GROUP BY user_id, k HAVING epoch_us(max(ts)) + 3600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events) - 3600000000""")
def stream_user_sessions(spark, sf_dir):
    out = _replay(spark, sf_dir, lambda rows: R.sessions(rows, "ts", ["user_id"], "1 hour", "1 hour", n=F.count("*")))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT DISTINCT user_id, event_type, epoch_us(date_trunc('hour', ts)) AS hour_us FROM events")
def stream_first_per_hour(spark, sf_dir):
    hourly = lambda rows: rows.select("user_id", "event_type", F.date_trunc("hour", "ts").alias("ts"))
    out = _replay(spark, sf_dir, lambda rows: R.once_per_key(hourly(rows), "ts", ["user_id", "event_type"], "1 day"))
    return out.select("user_id", "event_type", F.unix_micros("ts").alias("hour_us"))
