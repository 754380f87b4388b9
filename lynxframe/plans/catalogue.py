"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxframe.functions import geometry as G
from lynxframe.operators import blocks, frames, metrics, records, samples, selection, timeline
from lynxframe.sources.fixtures import duck, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Register a query; ``tables`` are the derived tables that its SQL reads."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (duck(*tables) + ("," if sql.lstrip().startswith("AS_") else " ") + sql.replace("AS_ ", " ", 1)) if tables else sql
        return f

    return add


def six(value) -> Column:
    """Six places after the point, halves upwards, in the arithmetic that both engines share (their ``round`` differs)."""
    c = F.col(value) if isinstance(value, str) else value
    return F.floor(c * 1e6 + 0.5) / 1e6


def six_sql(expression: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6"


def _box(prefix: str = ""):
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def _polygon() -> Column:
    """The zone as a polygon: 'diamond' is the rhombus in its box, the others are their boxes."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    return F.when(F.col("zone_id") == "diamond", F.array(point(mx, y0), point(x1, my), point(mx, y1), point(x0, my))).otherwise(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)))


def _in_zones(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    zones = load(spark, sf_dir, "zones").where(F.col("kind") == kind).select("stream_id", "zone_id", _polygon().alias("polygon"))
    seen = load(spark, sf_dir, "observations").withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    return timeline.zone_join(seen, zones, G.in_polygon(F.col("cx"), F.col("y1"), F.col("polygon")))


#: A point (cx, y1) in a zone z, as DuckDB conditions: the rhombus by the sum of its scaled distances.
_INSIDE = "CASE WHEN z.zone_id = 'diamond' THEN abs((o.x0 + o.x1) / 2 - (z.x0 + z.x1) / 2) / ((z.x1 - z.x0) / 2) + abs(o.y1 - (z.y0 + z.y1) / 2) / ((z.y1 - z.y0) / 2) <= 1 + 1e-9 ELSE (o.x0 + o.x1) / 2 BETWEEN z.x0 - 1e-9 AND z.x1 + 1e-9 AND o.y1 BETWEEN z.y0 - 1e-9 AND z.y1 + 1e-9 END"


@query(f"""AS_ seen AS (SELECT o.*, z.zone_id FROM observations o JOIN zones z ON o.stream_id = z.stream_id AND z.kind = 'roi' AND {_INSIDE}),
s AS (SELECT *, CASE WHEN ts_s - lag(ts_s) OVER w > 86400 THEN 1 ELSE 0 END AS fresh FROM seen WINDOW w AS (PARTITION BY stream_id, zone_id, track_id ORDER BY ts_s, frame_no)),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id, zone_id, track_id ORDER BY ts_s, frame_no) AS visit FROM s),
d AS (SELECT *, ts_s - min(ts_s) OVER (PARTITION BY stream_id, zone_id, track_id, visit) AS dwell FROM v),
a AS (SELECT *, row_number() OVER (PARTITION BY stream_id, zone_id, track_id, visit ORDER BY ts_s, frame_no) AS n FROM d WHERE dwell >= 43200)
SELECT stream_id, zone_id, track_id, CAST(visit AS BIGINT) AS visit, frame_no, round(dwell, 6) AS dwell_s FROM a WHERE n = 1""", "observations", "zones")
def zone_dwell_alerts(spark, sf_dir):
    alerts = timeline.dwell_alerts(_in_zones(spark, sf_dir, "roi"), ["stream_id", "zone_id", "track_id"], 86400, 43200, "frame_no")
    return alerts.select("stream_id", "zone_id", "track_id", F.col("session").cast("long").alias("visit"), "frame_no", F.round("dwell_s", 6).alias("dwell_s"))


@query(f"""SELECT o.stream_id, o.frame_no, z.zone_id FROM observations o JOIN zones z ON o.stream_id = z.stream_id AND z.kind = 'roi' AND {_INSIDE}
WHERE (o.x1 - o.x0) * (o.y1 - o.y0) <= 0.008 AND ((o.x1 - o.x0) * (o.y1 - o.y0) < 0.004 OR o.conf >= 0.25)""", "observations", "zones")
def roi_filter_gate(spark, sf_dir):
    size = G.area(_box())
    return _in_zones(spark, sf_dir, "roi").where((size <= 0.008) & ((size < 0.004) | (F.col("conf") >= 0.25))).select("stream_id", "frame_no", "zone_id")


@query(f"SELECT o.stream_id, o.frame_no FROM observations o WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE o.stream_id = z.stream_id AND z.kind = 'exclude' AND {_INSIDE})", "observations", "zones")
def exclusion_zone_anti(spark, sf_dir):
    zones = load(spark, sf_dir, "zones").where("kind = 'exclude'").select(F.col("stream_id").alias("of"), _polygon().alias("polygon"))
    seen = load(spark, sf_dir, "observations").select("stream_id", "frame_no", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), "y1")
    return seen.join(zones, (F.col("stream_id") == F.col("of")) & G.in_polygon(F.col("cx"), F.col("y1"), F.col("polygon")), "left_anti").select("stream_id", "frame_no")


_IOU = "(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))"
_UNION = f"((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IOU})"


_AREAS = ("((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))")


@query(f"""SELECT a.frame_id, a.det_id, b.det_id AS other_id, {six_sql(f"{_IOU} / {_UNION}")} AS iou, {six_sql(f"{_IOU} / least({_AREAS[0]}, {_AREAS[1]})")} AS over_smaller, {six_sql(f"{_IOU} / {_AREAS[0]}")} AS covered,
{six_sql("sqrt(greatest(a.x0 - b.x1, b.x0 - a.x1, 0) * greatest(a.x0 - b.x1, b.x0 - a.x1, 0) + greatest(a.y0 - b.y1, b.y0 - a.y1, 0) * greatest(a.y0 - b.y1, b.y0 - a.y1, 0))")} AS gap,
{six_sql("sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) * ((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) + ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) * ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2))")} AS distance,
{six_sql(f"greatest(8.0, least(32.0, 0.6 * sqrt({_AREAS[0]})))")} AS radius
FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.det_id < b.det_id AND a.x0 <= b.x1 + 8 AND b.x0 <= a.x1 + 8 AND a.y0 <= b.y1 + 8 AND b.y0 <= a.y1 + 8""", "detections")
def box_geometry(spark, sf_dir):
    """The pairs of a frame whose boxes are at most 8 apart on either axis."""
    rows = load(spark, sf_dir, "detections")
    a, b = rows.select("frame_id", "det_id", _box().alias("a")), rows.select("frame_id", F.col("det_id").alias("other_id"), _box().alias("b"))
    x, y = F.col("a"), F.col("b")
    both = a.join(b, "frame_id").where("det_id < other_id and a.x0 <= b.x1 + 8 and b.x0 <= a.x1 + 8 and a.y0 <= b.y1 + 8 and b.y0 <= a.y1 + 8")
    return both.select("frame_id", "det_id", "other_id", *[six(v).alias(n) for n, v in (("iou", G.iou(x, y)), ("over_smaller", G.over_smaller(x, y)), ("covered", G.covered(x, y)), ("gap", G.gap(x, y)), ("distance", G.distance(x, y)), ("radius", G.association_radius(x)))])


def _greedy(extra: str) -> str:
    """Greedy suppression in SQL, a rank at a time over all frames: a box falls to any kept, better box that it overlaps."""
    return f"""AS_ d AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC, det_id) AS k FROM detections),
e AS (SELECT a.frame_id, a.k AS ak, b.k AS bk FROM d a JOIN d b ON a.frame_id = b.frame_id AND a.k < b.k AND {_IOU} / {_UNION} >= 0.3 {extra}),
g AS (SELECT 0 AS step, frame_id, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT frame_id FROM d) UNION ALL
SELECT g.step + 1, g.frame_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.frame_id = g.frame_id AND e.bk = g.step + 1 AND list_contains(g.kept, e.ak)) THEN g.kept ELSE list_append(g.kept, CAST(g.step + 1 AS BIGINT)) END FROM g WHERE EXISTS (SELECT 1 FROM d WHERE d.frame_id = g.frame_id AND d.k = g.step + 1))
SELECT d.frame_id, d.det_id FROM d JOIN (SELECT frame_id, arg_max(kept, step) AS kept FROM g GROUP BY frame_id) r ON d.frame_id = r.frame_id AND list_contains(r.kept, d.k)"""


@query(_greedy(""), "detections")
def frame_nms(spark, sf_dir):
    return frames.suppress(load(spark, sf_dir, "detections"), "frame_id", 0.3).select("frame_id", "det_id")


@query(_greedy("AND a.class_id = b.class_id"), "detections")
def frame_nms_classwise(spark, sf_dir):
    return frames.suppress(load(spark, sf_dir, "detections"), "frame_id", 0.3, same_class=True).select("frame_id", "det_id")


@query("""AS_ f AS (SELECT start_s, end_s, camera, max(end_s) OVER (PARTITION BY camera ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM recordings)
SELECT camera, round(sum(greatest(0, end_s - greatest(start_s, coalesce(upto, start_s)))), 6) AS covered_s, max(end_s) - min(start_s) AS extent_s, count(*) FILTER (WHERE start_s > upto) AS gaps, max(greatest(start_s - coalesce(upto, start_s), 0)) AS max_gap_s FROM f GROUP BY camera""", "recordings")
def interval_coverage_gaps(spark, sf_dir):
    out = timeline.covered_intervals(load(spark, sf_dir, "recordings"), ["camera"], "start_s", "end_s")
    return out.select("camera", F.round("covered_s", 6).alias("covered_s"), "extent_s", "gaps", "max_gap_s")


@query("""AS_ asked AS (SELECT event_id, event_id % 8 AS camera, epoch_us(ts) / 1000000 - 788918400 + (event_id % 7) * 31557600 + 567993600 AS at_s FROM events)
SELECT a.event_id, a.camera, count(r.file_id) AS n, CASE WHEN count(r.file_id) = 0 THEN 'missing' WHEN count(r.file_id) = 1 THEN 'found' ELSE 'several' END AS status, min(r.file_id) AS file_id FROM asked a LEFT JOIN recordings r ON a.camera = r.camera AND a.at_s >= r.start_s AND a.at_s < r.end_s GROUP BY 1, 2""", "recordings")
def recording_lookup_status(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 - 788918400 + (F.col("event_id") % 7) * 31557600 + 567993600
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 8).alias("camera"), at.alias("at_s"))
    # Recordings are listed under each day that they touch, so the interval join has an equi key.
    day = lambda c: F.floor(c / 86400)
    files = load(spark, sf_dir, "recordings").withColumn("day", F.explode(F.sequence(day(F.col("start_s")), day(F.col("end_s")))))
    found = asked.withColumn("day", day(F.col("at_s"))).join(files, ["camera", "day"], "left").withColumn("hit", (F.col("at_s") >= F.col("start_s")) & (F.col("at_s") < F.col("end_s")))
    out = found.groupBy("event_id", "camera").agg(F.count_if("hit").alias("n"), F.min(F.when(F.col("hit"), F.col("file_id"))).alias("file_id"))
    return out.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "found").otherwise("several"))


@query("""AS_ s AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS step FROM observations)
SELECT stream_id, frame_no, round(sum(CASE WHEN step > 0 AND step <= 3600 THEN step ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no), 3) AS evidence_s FROM s""", "observations")
def elapsed_evidence(spark, sf_dir):
    out = timeline.elapsed_evidence(load(spark, sf_dir, "observations"), ["stream_id"], 3600, "frame_no")
    return out.select("stream_id", "frame_no", F.round("evidence_s", 3).alias("evidence_s"))


@query("""SELECT track_id, frame_no, sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) OVER w AS hits, sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) OVER w >= 2 AS confirmed FROM observations WINDOW w AS (PARTITION BY track_id ORDER BY ts_s, frame_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", "observations")
def m_of_n_confirm(spark, sf_dir):
    return timeline.m_of_n(load(spark, sf_dir, "observations"), ["track_id"], F.col("kind") == "click", 2, 4, "frame_no").select("track_id", "frame_no", "hits", "confirmed")


@query("""SELECT track_id, frame_no, round(sqrt(power(max((x0 + x1) / 2) OVER w - min((x0 + x1) / 2) OVER w, 2) + power(max((y0 + y1) / 2) OVER w - min((y0 + y1) / 2) OVER w, 2)), 6) AS span FROM observations WINDOW w AS (PARTITION BY track_id ORDER BY ts_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""", "observations")
def compact_span(spark, sf_dir):
    rows = load(spark, sf_dir, "observations")
    return rows.select("track_id", "frame_no", F.round(records.compact_span(rows, ["track_id"], "ts_s", _box(), 86400), 6).alias("span"))


@query("""AS_ a AS (SELECT stream_id, frame_no, ts_s, max(ts_s) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM observations)
SELECT stream_id, frame_no, ts_s IS NOT NULL AND (high IS NULL OR ts_s > high) AS accepted FROM a""", "observations")
def monotonic_timeline(spark, sf_dir):
    return timeline.monotonic(load(spark, sf_dir, "observations"), ["stream_id"], "frame_no").select("stream_id", "frame_no", "accepted")


_STEP = "c AS (SELECT *, captured - lag(captured) OVER w AS dc, published - lag(published) OVER w AS dp, corrupt - lag(corrupt) OVER w AS dx, ts_s - lag(ts_s) OVER w AS dt FROM metrics WINDOW w AS (PARTITION BY stream_id ORDER BY ts_s, frame_no))"


def _intervals(spark, sf_dir) -> DataFrame:
    rows = blocks.previous(load(spark, sf_dir, "metrics"), ["stream_id"], ["ts_s", "frame_no"], ["captured", "published", "corrupt", "ts_s"])
    delta = lambda c: F.col(c) - F.col(f"prev1_{c}")
    return rows.select("*", delta("captured").alias("dc"), delta("published").alias("dp"), delta("corrupt").alias("dx"), delta("ts_s").alias("dt"))


@query(f"AS_ {_STEP} SELECT stream_id, frame_no, CAST(dc AS BIGINT) AS captured, CAST(dp AS BIGINT) AS published, round(CASE WHEN dt > 0 THEN dc / dt END, 6) AS capture_rate, round(CASE WHEN dc > 0 THEN dp / dc END, 6) AS published_share FROM c", "metrics")
def interval_metrics(spark, sf_dir):
    return _intervals(spark, sf_dir).select("stream_id", "frame_no", F.col("dc").alias("captured"), F.col("dp").alias("published"), F.round(metrics.ratio(F.col("dc"), F.col("dt")), 6).alias("capture_rate"), F.round(metrics.ratio(F.col("dp"), F.col("dc")), 6).alias("published_share"))


_HEALTH = "CASE WHEN dt IS NULL THEN 'starting' WHEN dt > 7200 THEN 'stale' WHEN dp = 0 THEN 'stalled' WHEN dp / dc < 0.8 OR dx > 0 THEN 'degraded' ELSE 'healthy' END"


def _health(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("dt").isNull(), "starting").when(F.col("dt") > 7200, "stale").when(F.col("dp") == 0, "stalled").when((F.col("dp") / F.col("dc") < 0.8) | (F.col("dx") > 0), "degraded").otherwise("healthy")
    return _intervals(spark, sf_dir).withColumn("status", status)


@query(f"AS_ {_STEP} SELECT stream_id, {_HEALTH} AS status, count(*) AS n FROM c GROUP BY 1, 2", "metrics")
def stream_health(spark, sf_dir):
    return _health(spark, sf_dir).groupBy("stream_id", "status").agg(F.count("*").alias("n"))


@query(f"AS_ {_STEP}, h AS (SELECT *, {_HEALTH} AS status FROM c), l AS (SELECT *, lag(status) OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS before FROM h) SELECT stream_id, frame_no, before, status FROM l WHERE before IS DISTINCT FROM status", "metrics")
def health_changes(spark, sf_dir):
    rows = blocks.previous(_health(spark, sf_dir).select("stream_id", "ts_s", "frame_no", "status"), ["stream_id"], ["ts_s", "frame_no"], ["status"])
    return rows.where(~F.col("prev1_status").eqNullSafe(F.col("status"))).select("stream_id", "frame_no", F.col("prev1_status").alias("before"), "status")


@query("SELECT stream_id, count(*) AS n, count(DISTINCT track_id) AS tracks, count(*) FILTER (WHERE kind = 'error') AS errors, round(avg(value), 6) AS mean_value, max(frame_no) AS last_frame FROM observations GROUP BY ROLLUP (stream_id)", "observations")
def run_summary(spark, sf_dir):
    return load(spark, sf_dir, "observations").rollup("stream_id").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks"), F.count_if(F.col("kind") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("frame_no").alias("last_frame"))


@query("AS_ r AS (SELECT stream_id, value, row_number() OVER (PARTITION BY stream_id ORDER BY value) AS k, count(*) OVER (PARTITION BY stream_id) AS n FROM observations WHERE value IS NOT NULL) SELECT stream_id, value AS p95 FROM r WHERE k = CAST(ceil(n * 0.95) AS BIGINT)", "observations")
def nearest_rank_p95(spark, sf_dir):
    return metrics.nearest_rank(load(spark, sf_dir, "observations").where("value is not null"), "stream_id", "value", 0.95).withColumnRenamed("value", "p95")


@query("SELECT device, count(*) AS reviewed, sum(label) AS positive, round(sum(label) / count(*), 6) AS yield_ratio FROM scored GROUP BY device", "scored")
def source_yield(spark, sf_dir):
    return records.yields(load(spark, sf_dir, "scored"), ["device"], "label")


@query("""SELECT device, count(*) AS n, round(sum(CASE WHEN label = 1 AND passed THEN weight ELSE 0 END) / nullif(sum(CASE WHEN passed THEN weight ELSE 0 END), 0), 6) AS precision, round(sum(CASE WHEN label = 1 AND passed THEN weight ELSE 0 END) / nullif(sum(CASE WHEN label = 1 THEN weight ELSE 0 END), 0), 6) AS recall, round(sum(CASE WHEN label <> 1 AND NOT passed THEN weight ELSE 0 END) / nullif(sum(CASE WHEN label <> 1 THEN weight ELSE 0 END), 0), 6) AS negative_reduction FROM scored GROUP BY ROLLUP (device)""", "scored")
def weighted_precision_recall(spark, sf_dir):
    return metrics.weighted_scores(load(spark, sf_dir, "scored"), "device")


@query("""AS_ p AS (SELECT a.lang, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS won, count(*) AS pairs FROM scored a JOIN scored b ON a.lang = b.lang AND a.label = 1 AND b.label = 0 GROUP BY a.lang)
SELECT l.lang, round(p.won / p.pairs, 6) AS auc FROM (SELECT DISTINCT lang FROM scored) l LEFT JOIN p ON l.lang = p.lang""", "scored")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(load(spark, sf_dir, "scored"), "lang")


@query("AS_ r AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY lang) AS n FROM scored WHERE label = 1) SELECT lang, score AS threshold FROM r WHERE k = CAST(ceil(n * 0.9) AS BIGINT)", "scored")
def recall_threshold(spark, sf_dir):
    falling = load(spark, sf_dir, "scored").where("label = 1").withColumn("score", -F.col("score"))
    return metrics.nearest_rank(falling, "lang", "score", 0.9).select("lang", (-F.col("value")).alias("threshold"))


@query("AS_ g AS (SELECT device, CAST(sum(label) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY device) SELECT device, round(k / n, 6) AS share, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM g", "scored")
def wilson_ratio(spark, sf_dir):
    by = load(spark, sf_dir, "scored").groupBy("device").agg(F.sum("label").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return by.select("device", F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("AS_ r AS (SELECT *, row_number() OVER (PARTITION BY device, lang ORDER BY sha256('s1|' || CAST(sample_id AS VARCHAR))) AS k, count(*) OVER (PARTITION BY device, lang) AS n FROM scored) SELECT device, lang, sample_id, round(n / least(n, 3), 6) AS weight FROM r WHERE k <= 3", "scored")
def stratified_holdout(spark, sf_dir):
    out = selection.stratified(load(spark, sf_dir, "scored").drop("weight"), ["device", "lang"], 3, "s1", "sample_id")
    return out.select("device", "lang", "sample_id", F.round("weight", 6).alias("weight"))


@query("AS_ r AS (SELECT stream_id, frame_no, row_number() OVER (PARTITION BY stream_id ORDER BY conf DESC, frame_no) AS k FROM observations) SELECT stream_id, frame_no, k AS round FROM r WHERE k <= 5", "observations")
def round_robin_cap(spark, sf_dir):
    return selection.round_robin(load(spark, sf_dir, "observations"), "stream_id", [F.desc("conf"), F.col("frame_no")], 5).select("stream_id", "frame_no", F.col("round").cast("long").alias("round"))


@query("AS_ r AS (SELECT *, passed AND score > 0.9 AS forced, count(*) OVER (PARTITION BY device) AS n FROM scored), k AS (SELECT *, row_number() OVER (PARTITION BY device, forced ORDER BY sha256('h|' || CAST(sample_id AS VARCHAR))) AS k FROM r) SELECT sample_id, CASE WHEN forced THEN 'train' WHEN k <= floor(n * 0.2) THEN 'holdout' ELSE 'train' END AS split FROM k", "scored")
def train_holdout_split(spark, sf_dir):
    return selection.split_holdout(load(spark, sf_dir, "scored"), "device", "sample_id", 0.2, "h", F.col("passed") & (F.col("score") > 0.9)).select("sample_id", "split")


@query("SELECT stream_id, frame_no, kind FROM observations ORDER BY ts_s DESC, frame_no DESC LIMIT 100", "observations")
def latest_events(spark, sf_dir):
    return records.latest(load(spark, sf_dir, "observations"), ["ts_s", "frame_no"], 100).select("stream_id", "frame_no", "kind")


@query("SELECT frame_no, kind FROM observations WHERE frame_no > 200 AND kind = 'error' ORDER BY frame_no LIMIT 50", "observations")
def cursor_page(spark, sf_dir):
    return records.page_after(load(spark, sf_dir, "observations").where("kind = 'error'"), "frame_no", 200, 50).select("frame_no", "kind")


@query("SELECT sha256(coalesce(text, '')) AS content, count(*) AS n, min(doc_id) AS first_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY 1")
def exact_duplicate_collapse(spark, sf_dir):
    content = F.sha2(F.coalesce("text", F.lit("")), 256).alias("content")
    return records.collapsed(spark.read.parquet(f"{sf_dir}/documents.parquet"), [content], "doc_id", {"sources": F.col("source")})


@query("AS_ r AS (SELECT camera, file_id, start_s, row_number() OVER (PARTITION BY camera, start_s ORDER BY file_id) AS k FROM recordings) SELECT camera, start_s, file_id FROM r WHERE k = 1", "recordings")
def identity_dedupe(spark, sf_dir):
    return records.one_each(load(spark, sf_dir, "recordings"), ["camera", "start_s"], ["file_id"], ["file_id"])


@query("AS_ s AS (SELECT frame_id, camera, cell, gray FROM cells), m AS (SELECT camera, cell, median(gray) AS med FROM s GROUP BY 1, 2) SELECT m.camera, m.cell, round(med, 6) AS median_gray, round(greatest(1.4826 * median(abs(gray - med)), 0.01), 6) AS scale FROM s JOIN m ON s.camera = m.camera AND s.cell = m.cell GROUP BY m.camera, m.cell, med", "cells")
def robust_scale(spark, sf_dir):
    out = metrics.robust_scale(load(spark, sf_dir, "cells"), ["camera", "cell"], "gray", 0.01)
    return out.select("camera", "cell", F.round("median", 6).alias("median_gray"), F.round("scale", 6).alias("scale"))


@query("AS_ l AS (SELECT *, lag(kind) OVER (PARTITION BY track_id ORDER BY ts_s, frame_no) AS before FROM observations) SELECT track_id, frame_no, before, kind FROM l WHERE before IS NOT NULL AND before <> kind", "observations")
def state_transitions(spark, sf_dir):
    return samples.transitions(load(spark, sf_dir, "observations"), ["track_id"], ["ts_s", "frame_no"], "kind").select("track_id", "frame_no", "before", "kind")


@query("SELECT stream_id, CAST(floor(ts_s / 21600) AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (WHERE kind = 'error') AS errors, round(max(conf), 6) AS max_conf FROM observations GROUP BY 1, 2", "observations")
def tumbling_metrics(spark, sf_dir):
    return load(spark, sf_dir, "observations").groupBy("stream_id", F.floor(F.col("ts_s") / 21600).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("errors"), F.round(F.max("conf"), 6).alias("max_conf"))


@query("AS_ p AS (SELECT track_id, frame_no, ts_s, lag(ts_s) OVER w AS t0, lag(x0) OVER w AS px, lag(x0, 2) OVER w AS qx, lag(ts_s, 2) OVER w AS u0 FROM observations WINDOW w AS (PARTITION BY track_id ORDER BY ts_s, frame_no)) SELECT track_id, frame_no, round(CASE WHEN ts_s - t0 <= 86400 AND t0 > u0 THEN px + (px - qx) / (t0 - u0) * (ts_s - t0) END, 6) AS projected FROM p", "observations")
def asof_projection(spark, sf_dir):
    ahead = samples.projected(["track_id"], ["ts_s", "frame_no"], "x0", 86400)
    return load(spark, sf_dir, "observations").select("track_id", "frame_no", F.round(ahead, 6).alias("projected"))
