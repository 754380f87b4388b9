"""Registered queries: association of boxes and checks of interval tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynxframe.functions import geometry as G
from lynxframe.operators import frames, metrics, samples
from lynxframe.plans.catalogue import _IOU, _UNION, _box, query
from lynxframe.sources import logs
from lynxframe.sources.fixtures import load

#: One-to-one matches, an edge at a time over all frames, best first.
_MATCH = f"""AS_ e AS (SELECT a.frame_id, det_id, gt_id, {_IOU} / {_UNION} AS iou, row_number() OVER (PARTITION BY a.frame_id ORDER BY {_IOU} / {_UNION} DESC, conf DESC, det_id, gt_id) AS k FROM detections a JOIN truth_boxes b ON a.frame_id = b.frame_id AND {_IOU} / {_UNION} >= 0.3),
g AS (SELECT CAST(0 AS BIGINT) AS step, frame_id, CAST([] AS BIGINT[]) AS dets, CAST([] AS BIGINT[]) AS gts FROM (SELECT DISTINCT frame_id FROM e) UNION ALL
SELECT g.step + 1, g.frame_id, CASE WHEN list_contains(dets, det_id) OR list_contains(gts, gt_id) THEN dets ELSE list_append(dets, det_id) END, CASE WHEN list_contains(dets, det_id) OR list_contains(gts, gt_id) THEN gts ELSE list_append(gts, gt_id) END FROM g JOIN e ON g.frame_id = e.frame_id AND e.k = g.step + 1),
p AS (SELECT frame_id, unnest(arg_max(dets, step)) AS det_id, unnest(arg_max(gts, step)) AS gt_id FROM g GROUP BY frame_id),
m AS (SELECT p.frame_id, p.det_id, p.gt_id, round(e.iou, 6) AS iou FROM p JOIN e USING (frame_id, det_id, gt_id))"""


@query(f"{_MATCH} SELECT * FROM m", "detections", "truth_boxes")
def frame_match_truth(spark, sf_dir):
    out = frames.match(load(spark, sf_dir, "detections"), load(spark, sf_dir, "truth_boxes"), "frame_id", 0.3)
    return out.select("frame_id", "det_id", "gt_id", F.round("iou", 6).alias("iou"))


def _associated(spark, sf_dir):
    return frames.associate(load(spark, sf_dir, "detections"), load(spark, sf_dir, "truth_boxes"), "frame_id", 0.3)


@query(f"""{_MATCH} SELECT d.frame_id, d.det_id, m.gt_id, CASE WHEN m.gt_id IS NULL THEN 'left' ELSE 'both' END AS side FROM detections d LEFT JOIN m ON d.frame_id = m.frame_id AND d.det_id = m.det_id
UNION ALL SELECT t.frame_id, NULL, t.gt_id, 'right' FROM truth_boxes t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.frame_id = t.frame_id AND m.gt_id = t.gt_id)""", "detections", "truth_boxes")
def two_channel_association(spark, sf_dir):
    return _associated(spark, sf_dir).select("frame_id", "det_id", "gt_id", "side")


@query(f"""{_MATCH}, c AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM detections) AS d, (SELECT count(*) FROM truth_boxes) AS t) SELECT tp, d - tp AS fp, t - tp AS fn, round(tp / d, 6) AS precision, round(tp / t, 6) AS recall, round(2 * tp / (d + t), 6) AS f1 FROM c""", "detections", "truth_boxes")
def event_level_f1(spark, sf_dir):
    n = _associated(spark, sf_dir).agg(*[F.count_if(F.col("side") == s).alias(a) for s, a in (("both", "tp"), ("left", "fp"), ("right", "fn"))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = (("precision", tp, tp + fp), ("recall", tp, tp + fn), ("f1", 2 * tp, 2 * tp + fp + fn))
    return n.select("tp", "fp", "fn", *[F.round(metrics.ratio(a, b), 6).alias(s) for s, a, b in scores])


@query(f"SELECT b.frame_id, b.det_id FROM detections b WHERE b.class_id <> 0 AND NOT EXISTS (SELECT 1 FROM detections a WHERE a.frame_id = b.frame_id AND a.class_id = 0 AND {_IOU} / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.5) UNION ALL SELECT frame_id, det_id FROM detections WHERE class_id = 0", "detections")
def primary_suppresses_secondary(spark, sf_dir):
    rows = load(spark, sf_dir, "detections")
    first = rows.where("class_id = 0")
    rest = frames.uncovered(rows.where("class_id <> 0"), first, "frame_id", lambda b, a: G.over_smaller(a, b) >= 0.5)
    return first.select("frame_id", "det_id").unionByName(rest.select("frame_id", "det_id"))


@query(f"SELECT b.frame_id, b.det_id, round(coalesce(max({_IOU} / ((b.x1 - b.x0) * (b.y1 - b.y0))), 0), 6) AS occluded FROM detections b LEFT JOIN detections a ON a.frame_id = b.frame_id AND a.class_id = 0 WHERE b.class_id <> 0 GROUP BY 1, 2", "detections")
def actor_occlusion(spark, sf_dir):
    rows = load(spark, sf_dir, "detections")
    box = F.struct("x0", "y0", "x1", "y1")
    actors = rows.where("class_id = 0").select("frame_id", box.alias("a"))
    pairs = rows.where("class_id <> 0").select("frame_id", "det_id", box.alias("b")).join(actors, "frame_id", "left")
    return pairs.groupBy("frame_id", "det_id").agg(F.round(F.coalesce(F.max(G.covered(F.col("b"), F.col("a"))), F.lit(0.0)), 6).alias("occluded"))


@query("""AS_ m AS (SELECT track_id, frame_no, x0, x1, y0, y1, ts_s - lag(ts_s) OVER w AS dt, (x0 + x1) / 2 - lag((x0 + x1) / 2) OVER w AS dx, (y0 + y1) / 2 - lag((y0 + y1) / 2) OVER w AS dy FROM observations WINDOW w AS (PARTITION BY track_id ORDER BY ts_s, frame_no))
SELECT track_id, frame_no, round(least(CASE WHEN dx < 0 THEN x0 / (-dx / dt) WHEN dx > 0 THEN (1 - x1) / (dx / dt) END, CASE WHEN dy < 0 THEN y0 / (-dy / dt) WHEN dy > 0 THEN (1 - y1) / (dy / dt) END), 3) AS edge_s FROM m WHERE dt > 0""", "observations")
def time_to_edge(spark, sf_dir):
    out = samples.time_to_edge(load(spark, sf_dir, "observations"), ["track_id"], ["ts_s", "frame_no"], _box())
    return out.select("track_id", "frame_no", F.round("edge_s", 3).alias("edge_s"))


@query("""AS_ p AS (SELECT *, max(end_s) OVER (PARTITION BY camera ORDER BY start_s, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto, count(*) OVER (PARTITION BY file_id) AS same FROM recordings)
SELECT file_id, camera, 'empty interval' AS violation FROM p WHERE end_s <= start_s UNION ALL SELECT file_id, camera, 'overlaps an earlier one' FROM p WHERE start_s < upto UNION ALL SELECT file_id, camera, 'repeated id' FROM p WHERE same > 1""", "recordings")
def interval_violations(spark, sf_dir):
    return samples.interval_faults(load(spark, sf_dir, "recordings"), "camera", "file_id", "start_s", "end_s")


@query("SELECT stream_id, kind AS level, count(*) AS n, max(frame_no) AS last_sequence FROM observations WHERE frame_no % 7 <> 3 AND frame_no > 100 GROUP BY 1, 2", "observations")
def log_scan(spark, sf_dir):
    # Every seventh line is cut short, as in a file that was being written.
    entry = F.to_json(F.struct(F.col("ts_s").alias("timestamp_unix"), F.col("frame_no").alias("sequence"), "stream_id", F.col("kind").alias("level")))
    lines = load(spark, sf_dir, "observations").select(F.when(F.col("frame_no") % 7 == 3, F.substring(entry, 1, 20)).otherwise(entry).alias("value"))
    return logs.after(logs.parse(lines), 100).groupBy("stream_id", "level").agg(F.count("*").alias("n"), F.max("sequence").alias("last_sequence"))
