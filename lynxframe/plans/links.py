"""Registered queries: joins by place, time and decision."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lynxframe.functions import geometry as G
from lynxframe.operators import blocks, events, frames, graph, joins, records, samples, states
from lynxframe.plans.catalogue import _INSIDE, _IOU, _UNION, _box, _polygon, query
from lynxframe.sources.fixtures import load


def folded(edges: str) -> str:
    """Pairs m(frame_id, det_id, gt_id) taken one to one from edges e(frame_id, det_id, gt_id, k), an edge of all frames a step."""
    return f"""AS_ e AS ({edges}), g AS (SELECT CAST(0 AS BIGINT) AS step, frame_id, CAST([] AS BIGINT[]) AS dets, CAST([] AS BIGINT[]) AS gts FROM (SELECT DISTINCT frame_id FROM e) UNION ALL
SELECT g.step + 1, g.frame_id, CASE WHEN list_contains(dets, det_id) OR list_contains(gts, gt_id) THEN dets ELSE list_append(dets, det_id) END, CASE WHEN list_contains(dets, det_id) OR list_contains(gts, gt_id) THEN gts ELSE list_append(gts, gt_id) END FROM g JOIN e ON g.frame_id = e.frame_id AND e.k = g.step + 1),
m AS (SELECT frame_id, unnest(arg_max(dets, step)) AS det_id, unnest(arg_max(gts, step)) AS gt_id FROM g GROUP BY frame_id)"""


@query(folded("SELECT d.frame_id, det_id, gt_id, row_number() OVER (PARTITION BY d.frame_id ORDER BY conf DESC, gt_id, det_id) AS k FROM detections d JOIN truth_boxes t ON d.frame_id = t.frame_id AND (t.x0 + t.x1) / 2 BETWEEN d.x0 AND d.x1 AND (t.y0 + t.y1) / 2 BETWEEN d.y0 AND d.y1") + " SELECT t.frame_id, t.gt_id, m.det_id FROM truth_boxes t LEFT JOIN m ON m.frame_id = t.frame_id AND m.gt_id = t.gt_id", "detections", "truth_boxes")
def point_matches(spark, sf_dir):
    inside = lambda x, y: (G.contains(x.box, G.centre_x(y.box), G.centre_y(y.box)), [-x.conf, y.gt_id])
    out = frames.associate(load(spark, sf_dir, "detections"), load(spark, sf_dir, "truth_boxes"), "frame_id", edge=inside)
    return out.where("gt_id is not null").select("frame_id", "gt_id", "det_id")


@query(folded(f"SELECT a.frame_id * 10 + b.class_id AS frame_id, a.det_id, b.det_id AS gt_id, row_number() OVER (PARTITION BY a.frame_id * 10 + b.class_id ORDER BY {_IOU} / {_UNION} DESC, a.conf DESC, a.det_id, b.det_id) AS k FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.class_id = 0 AND b.class_id > 0 AND {_IOU} / {_UNION} >= 0.3") + " SELECT b.frame_id, b.class_id AS source, b.det_id AS other_id, m.det_id AS primary_id FROM detections b LEFT JOIN m ON m.frame_id = b.frame_id * 10 + b.class_id AND m.gt_id = b.det_id WHERE b.class_id > 0 UNION ALL SELECT frame_id, 0, NULL, det_id FROM detections WHERE class_id = 0", "detections")
def merged_sources(spark, sf_dir):
    rows = load(spark, sf_dir, "detections")
    key = lambda c: (F.col("frame_id") * 10 + c).alias("fk")
    box = ["x0", "y0", "x1", "y1"]
    first = rows.where("class_id = 0").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("source")).select(key(F.col("source")), "det_id", "conf", *box)
    rest = rows.where("class_id > 0").select(key(F.col("class_id")), F.col("det_id").alias("gt_id"), *box)
    out = frames.associate(first, rest, "fk", 0.3).where("gt_id is not null")
    found = out.select(F.floor(F.col("fk") / 10).alias("frame_id"), (F.col("fk") % 10).alias("source"), F.col("gt_id").alias("other_id"), F.col("det_id").alias("primary_id"))
    alone = rows.where("class_id = 0").select("frame_id", F.lit(0).cast("long").alias("source"), F.lit(None).cast("long").alias("other_id"), F.col("det_id").alias("primary_id"))
    return found.unionByName(alone)


_RANK = "ORDER BY class_id = 2, conf DESC, det_id"


@query(f"""AS_ d AS (SELECT *, row_number() OVER (PARTITION BY frame_id {_RANK}) AS k FROM detections), e AS (SELECT a.frame_id, a.k AS ak, b.k AS bk FROM d a JOIN d b ON a.frame_id = b.frame_id AND a.k < b.k AND ({_IOU} / {_UNION} >= 0.3 OR {_IOU} / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.8)),
g AS (SELECT 0 AS step, frame_id, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT frame_id FROM d) UNION ALL SELECT g.step + 1, g.frame_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.frame_id = g.frame_id AND e.bk = g.step + 1 AND list_contains(g.kept, e.ak)) THEN g.kept ELSE list_append(g.kept, CAST(g.step + 1 AS BIGINT)) END FROM g WHERE EXISTS (SELECT 1 FROM d WHERE d.frame_id = g.frame_id AND d.k = g.step + 1))
SELECT d.frame_id, d.det_id FROM d JOIN (SELECT frame_id, arg_max(kept, step)[1:3] AS kept FROM g GROUP BY frame_id) r ON d.frame_id = r.frame_id AND list_contains(r.kept, d.k)""", "detections")
def frame_nms_priority(spark, sf_dir):
    clash = lambda k, b: (G.iou(k.box, b.box) >= 0.3) | (G.over_smaller(k.box, b.box) >= 0.8)
    return frames.suppress(load(spark, sf_dir, "detections"), "frame_id", 0.3, conflict=clash, last=F.col("class_id") == 2, limit=3).select("frame_id", "det_id")


@query("SELECT frame_id, det_id, k AS place FROM (SELECT frame_id, det_id, row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC, det_id) AS k FROM detections) WHERE k <= 3", "detections")
def display_boxes(spark, sf_dir):
    kept = frames.suppress(load(spark, sf_dir, "detections"), "frame_id", 0.0, conflict=lambda k, b: F.lit(False), limit=3)
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("conf"), "det_id"))
    return kept.select("frame_id", "det_id", place.cast("long").alias("place"))


@query(f"""AS_ d AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY det_id) AS k FROM detections), e AS (SELECT a.frame_id, a.k AS ak, b.k AS bk FROM d a JOIN d b ON a.frame_id = b.frame_id AND a.k < b.k AND {_IOU} / {_UNION} >= 0.3),
g AS (SELECT CAST(0 AS BIGINT) AS k, frame_id, CAST([] AS STRUCT(head BIGINT, k BIGINT)[]) AS made FROM (SELECT DISTINCT frame_id FROM d) UNION ALL
SELECT g.k + 1, g.frame_id, list_append(g.made, {{'head': coalesce((SELECT min(e.ak) FROM e WHERE e.frame_id = g.frame_id AND e.bk = g.k + 1 AND list_contains(list_transform(g.made, lambda x: x.head), e.ak)), g.k + 1), 'k': g.k + 1}}) FROM g WHERE EXISTS (SELECT 1 FROM d WHERE d.frame_id = g.frame_id AND d.k = g.k + 1)),
r AS (SELECT frame_id, unnest(arg_max(made, k)) AS x FROM g GROUP BY frame_id)
SELECT r.frame_id, h.det_id, count(*) AS labels, max(d.det_id) AS last_id FROM r JOIN d h ON h.frame_id = r.frame_id AND h.k = r.x.head JOIN d ON d.frame_id = r.frame_id AND d.k = r.x.k GROUP BY 1, 2""", "detections")
def label_iou_merge(spark, sf_dir):
    out = frames.merge_labels(load(spark, sf_dir, "detections"), "frame_id", 0.3)
    return out.select("frame_id", "det_id", F.size("ids").cast("long").alias("labels"), F.array_max("ids").alias("last_id"))


@query("""AS_ p AS (SELECT event_id, event_id % 8 AS camera, CAST(epoch_us(ts) // 1000000 - 788918400 + (event_id % 7) * 31557600 + 567993600 AS DOUBLE) // 43200 * 43200 AS at_s FROM events), o AS (SELECT camera, min(start_s) AS oldest FROM recordings GROUP BY 1),
j AS (SELECT p.event_id, p.camera, p.at_s, count(r.file_id) FILTER (WHERE p.at_s < r.end_s) AS n, min(r.file_id) FILTER (WHERE p.at_s < r.end_s) AS inside, min(r.file_id) FILTER (WHERE p.at_s = r.end_s) AS ends FROM p LEFT JOIN recordings r ON p.camera = r.camera AND p.at_s >= r.start_s AND p.at_s <= r.end_s GROUP BY 1, 2, 3)
SELECT event_id, n, coalesce(inside, ends) AS span, CASE WHEN n = 1 THEN 'found' WHEN n > 1 THEN 'several' WHEN ends IS NOT NULL THEN 'at end' WHEN at_s < oldest THEN 'expired' ELSE 'missing' END AS status FROM j LEFT JOIN o USING (camera)""", "recordings")
def recording_at_instant(spark, sf_dir):
    at = F.floor((F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000) - 788918400 + (F.col("event_id") % 7) * 31557600 + 567993600) / 43200).cast("double") * 43200
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 8).alias("camera"), at.alias("at_s"))
    return joins.in_interval(points, load(spark, sf_dir, "recordings"), ["camera"], "at_s", "start_s", "end_s", "file_id").select("event_id", "n", "span", "status")


@query("""AS_ f AS (SELECT stream_id, ts_s, frame_no, value FROM observations WHERE kind = 'purchase'), p AS (SELECT stream_id, ts_s, frame_no FROM observations WHERE kind <> 'purchase'), a AS (SELECT p.frame_no, max(f.ts_s) AS t, arg_max(f.value, (f.ts_s, f.frame_no)) AS v, any_value(p.ts_s) AS ts_s FROM p LEFT JOIN f ON p.stream_id = f.stream_id AND f.ts_s <= p.ts_s GROUP BY 1)
SELECT frame_no, CASE WHEN ts_s - t <= 43200 THEN v END AS value FROM a""", "observations")
def held_value(spark, sf_dir):
    rows = load(spark, sf_dir, "observations").select("stream_id", "ts_s", "frame_no", "kind", "value")
    facts, points = rows.where("kind = 'purchase'"), rows.where("kind <> 'purchase'").select("stream_id", "ts_s", F.col("frame_no").alias("asked"))
    out = joins.latest_before(points, facts, ["stream_id"], "ts_s", "frame_no", ["value"], 43200.0)
    return out.select(F.col("asked").alias("frame_no"), "value")


@query("AS_ d AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY decided_s DESC, decision_id DESC) AS k, count(*) OVER (PARTITION BY card_id) AS n FROM decisions) SELECT c.obs_id, coalesce(d.decision, 'pending') AS decision, coalesce(d.n, 0) AS n_decisions FROM sourced c LEFT JOIN d ON d.card_id = c.obs_id AND d.k = 1", "sourced", "decisions")
def reviews_applied(spark, sf_dir):
    last = joins.latest_decision(load(spark, sf_dir, "decisions"), "card_id", "decided_s", "decision_id", ["decision"])
    out = load(spark, sf_dir, "sourced").select(F.col("obs_id").alias("card_id")).join(last, "card_id", "left")
    return out.select(F.col("card_id").alias("obs_id"), F.coalesce("decision", F.lit("pending")).alias("decision"), F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"))


@query("""AS_ s AS (SELECT camera, ts_s, obs_id FROM sourced WHERE kind <> 'error'), p AS (SELECT *, lag(ts_s) OVER w AS t0, lag(obs_id) OVER w AS o0 FROM s WINDOW w AS (PARTITION BY camera ORDER BY ts_s, obs_id))
SELECT obs_id, o0 AS previous, EXISTS (SELECT 1 FROM sourced e WHERE e.camera = p.camera AND e.kind = 'error' AND (e.ts_s, e.obs_id) > (p.t0, p.o0) AND (e.ts_s, e.obs_id) < (p.ts_s, p.obs_id)) AS crossed FROM p WHERE o0 IS NOT NULL""", "sourced")
def clean_gaps(spark, sf_dir):
    out = joins.between_marks(load(spark, sf_dir, "sourced").select("camera", "ts_s", "obs_id", "kind"), ["camera"], ["ts_s", "obs_id"], F.col("kind") == "error")
    return out.where("prev1_obs_id is not null").select("obs_id", F.col("prev1_obs_id").alias("previous"), "crossed")


@query("SELECT c_nationkey AS short_id, CASE WHEN min(code) = max(code) THEN min(code) END AS code, min(code) <> max(code) AS conflict FROM (SELECT c_nationkey, c_mktsegment AS code FROM customer UNION ALL SELECT s_nationkey, 'SUPPLIER' FROM supplier) GROUP BY 1")
def camera_codes(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("short_id"), F.col("c_mktsegment").alias("code"))
    b = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("short_id"), F.lit("SUPPLIER").alias("code"))
    return joins.conflicting(a.unionByName(b), "short_id", "code")


@query("SELECT o_orderkey AS job_id, count(l.l_orderkey) AS images, coalesce(array_to_string(list_sort(list(DISTINCT l.l_returnflag) FILTER (WHERE l.l_orderkey IS NOT NULL)), ','), '') AS flags, date_diff('day', o_orderdate, max(l.l_shipdate)) AS latency_days FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o_orderkey, o_orderdate")
def jobs_with_images(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "job_id")
    jobs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("job_id"), "o_orderdate")
    whole = records.with_nested(jobs, lines, "job_id", ["l_returnflag", "l_shipdate"], "l_shipdate")
    flags = F.array_join(F.array_distinct(F.transform("parts", lambda p: p.l_returnflag)), ",")
    days = F.datediff(F.col("done").cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    return whole.select("job_id", F.size("parts").cast("long").alias("images"), flags.alias("flags"), days.alias("latency_days"))


_OVER = _IOU.replace("a.", "s.").replace("b.", "t.")
_OVER_U = _UNION.replace("a.", "s.").replace("b.", "t.")


@query(f"SELECT s.obs_id FROM sourced s WHERE CAST(floor(s.ts_s / 86400) AS BIGINT) % 2 = 1 AND NOT EXISTS (SELECT 1 FROM sourced t WHERE t.camera = s.camera AND CAST(floor(t.ts_s / 86400) AS BIGINT) % 2 = 0 AND {_OVER} / {_OVER_U} >= 0.3)", "sourced")
def cross_day_overlap(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").select("camera", "obs_id", _box().alias("box"), (F.floor(F.col("ts_s") / 86400) % 2).alias("odd"))
    test = rows.where("odd = 1")
    places, train = test.select("camera", "box").distinct(), rows.where("odd = 0").select("camera", "box").distinct()
    met = joins.touching_boxes(places, train, ["camera"], 100.0, lambda a, b: G.iou(a, b) >= 0.3, how="left_semi").distinct()
    return test.join(met, ["camera", "box"], "left_anti").select("obs_id")


@query(f"SELECT s.obs_id, EXISTS (SELECT 1 FROM sourced t WHERE t.camera = s.camera AND t.kind = 'purchase' AND t.obs_id <> s.obs_id AND sqrt(power((s.x0 + s.x1 - t.x0 - t.x1) / 2, 2) + power((s.y0 + s.y1 - t.y0 - t.y1) / 2, 2)) <= 60) AS seen_before FROM sourced s", "sourced")
def reviewed_position_flag(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").select("camera", "obs_id", "kind", _box().alias("box"))
    known = rows.where("kind = 'purchase'").select("camera", "box", F.col("obs_id").alias("known_id"))
    return samples.seen_places(rows, known, "camera", "obs_id", "known_id", 60.0)


@query("SELECT sha256(coalesce(d.text, '')) AS content, count(*) FILTER (WHERE l.quality = 1) AS positives, count(*) FILTER (WHERE l.quality = 0) AS negatives, count(*) FILTER (WHERE l.quality = 1) > 0 AND count(*) FILTER (WHERE l.quality = 0) > 0 AS conflict FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def polarity_conflicts(spark, sf_dir):
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("content")).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id")
    return samples.polarity_conflicts(rows, ["content"], "quality")


@query(f"""SELECT s.obs_id, CASE WHEN count(*) FILTER (WHERE abs(s.ts_s - t.ts_s) <= 3600) > 0 THEN 'exclude' ELSE 'warn' END AS verdict, count(*) AS required FROM sourced s JOIN sourced t ON s.camera = t.camera AND s.kind <> 'purchase' AND t.kind = 'purchase' AND abs(s.ts_s - t.ts_s) <= 345600 AND {_OVER} > 0 GROUP BY 1""", "sourced")
def near_required_boxes(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").select("camera", "obs_id", "kind", "ts_s", _box().alias("box"))
    known = rows.where("kind = 'purchase'").select("camera", "box", F.col("ts_s").alias("t"))
    return samples.near_required(rows.where("kind <> 'purchase'"), known, "camera", "obs_id", 100.0, 345600, 3600)


@query("""AS_ r AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY frame_id ORDER BY class_id = 2, conf DESC, det_id) AS k FROM detections),
e AS (SELECT a.frame_id, a.k AS ak, b.k AS bk FROM r a JOIN r b ON a.frame_id = b.frame_id AND a.k < b.k AND b.class_id = 2 AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= 15),
g AS (SELECT 0 AS step, frame_id, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT frame_id FROM r) UNION ALL SELECT g.step + 1, g.frame_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.frame_id = g.frame_id AND e.bk = g.step + 1 AND list_contains(g.kept, e.ak)) THEN g.kept ELSE list_append(g.kept, CAST(g.step + 1 AS BIGINT)) END FROM g WHERE EXISTS (SELECT 1 FROM r WHERE r.frame_id = g.frame_id AND r.k = g.step + 1))
SELECT r.frame_id, r.det_id FROM r JOIN (SELECT frame_id, arg_max(kept, step) AS kept FROM g GROUP BY frame_id) x ON r.frame_id = x.frame_id AND list_contains(x.kept, r.k)""", "detections")
def fragment_suppression(spark, sf_dir):
    fragment = lambda k, b: (b.class_id == 2) & (G.distance(k.box, b.box) <= 15)
    return frames.suppress(load(spark, sf_dir, "detections"), "frame_id", 0.0, conflict=fragment, last=F.col("class_id") == 2).select("frame_id", "det_id")


@query(f"SELECT a.vec_id, 1 - coalesce(round(max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5), 0) AS novelty FROM embeddings a LEFT JOIN embeddings b ON a.vec_id % 8 = b.vec_id % 8 AND b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY 1")
def novelty(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 8).alias("camera"), "embedding")
    best = records.novelty(rows, rows.where("vec_id % 50 = 0"), "camera", "vec_id", "embedding")
    return best.select("vec_id", (1 - F.coalesce(F.round("best", 5), F.lit(0.0))).alias("novelty"))


@query("SELECT c.obs_id, arg_max(a.track_id, (a.ts_s, a.frame_no)) AS actor, count(*) AS steps FROM sourced c JOIN observations a ON a.stream_id = 'cam_' || CAST(c.camera AS VARCHAR) AND a.ts_s < c.ts_s AND a.ts_s >= c.ts_s - 86400 AND (a.x0 + a.x1) / 2 BETWEEN c.x0 / 1920 - 0.12 AND c.x1 / 1920 + 0.12 AND a.y1 BETWEEN c.y0 / 1080 - 0.12 AND c.y1 / 1080 + 0.12 WHERE c.kind = 'purchase' GROUP BY 1", "sourced", "observations")
def actor_trails(spark, sf_dir):
    stream = F.concat(F.lit("cam_"), F.col("camera").cast("string")).alias("stream_id")
    changes = load(spark, sf_dir, "sourced").where("kind = 'purchase'").select("obs_id", stream, F.col("ts_s").alias("at"), *[(F.col(c) / n).alias(c) for c, n in (("x0", 1920), ("y0", 1080), ("x1", 1920), ("y1", 1080))])
    trail = load(spark, sf_dir, "observations").select("stream_id", "track_id", "frame_no", "ts_s", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("y"))
    return records.latest_visitor(changes, trail, "stream_id", "obs_id", "track_id", "frame_no", 86400, 0.12)


@query(f"SELECT t.gt_id AS prior_id, count(d.det_id) AS results, count(*) FILTER (WHERE {_IOU.replace('a.', 't.').replace('b.', 'd.')} / {_UNION.replace('a.', 't.').replace('b.', 'd.')} >= 0.3) AS matched FROM truth_boxes t LEFT JOIN detections d ON d.frame_id = t.frame_id GROUP BY 1", "detections", "truth_boxes")
def prior_crop_results(spark, sf_dir):
    priors = load(spark, sf_dir, "truth_boxes").select("frame_id", F.col("gt_id").alias("prior_id"), _box().alias("p"))
    found = load(spark, sf_dir, "detections").select("frame_id", "det_id", _box().alias("d"))
    return samples.crop_results(priors, found, "frame_id", "prior_id", 0.3)[1]


_ALL_ZONES = f"SELECT o.frame_no, o.stream_id, count(*) FILTER (WHERE z.kind = 'roi') AS n, count(*) FILTER (WHERE z.kind = 'exclude') AS out, min(z.zone_id) FILTER (WHERE z.kind = 'roi' AND (o.x1 - o.x0) * (o.y1 - o.y0) >= 0.004) AS zone FROM observations o JOIN zones z ON o.stream_id = z.stream_id AND {_INSIDE} GROUP BY 1, 2"


@query(f"SELECT o.stream_id, o.frame_no, coalesce(m.n, 0) AS n_zones, CASE WHEN m.n = 1 AND m.out = 0 THEN m.zone END AS region FROM observations o LEFT JOIN ({_ALL_ZONES}) m ON m.frame_no = o.frame_no", "observations", "zones")
def zone_assignment(spark, sf_dir):
    zones = load(spark, sf_dir, "zones").select("stream_id", "zone_id", "kind", _polygon().alias("polygon"))
    seen = load(spark, sf_dir, "observations").select("stream_id", "frame_no", _box().alias("b"))
    inside = G.in_polygon(G.centre_x(F.col("b")), F.col("b.y1"), F.col("polygon"))
    return joins.only_zone(seen, zones, "stream_id", "frame_no", inside, F.col("kind") == "exclude", G.area(F.col("b")) >= 0.004)


@query(f"""AS_ p AS (SELECT s.obs_id AS a, t.obs_id AS b, abs(s.ts_s - t.ts_s) <= 3600 AS together FROM sourced s JOIN sourced t ON s.camera = t.camera AND s.obs_id < t.obs_id AND {_OVER} / {_OVER_U} >= 0.15) SELECT a, b, together FROM p""", "sourced")
def shared_boxes(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").select("camera", "obs_id", "ts_s", _box().alias("box"))
    met = joins.box_pairs(rows, ["camera"], "obs_id", ["ts_s"], 100.0, lambda x, y: G.iou(x, y) >= 0.15)
    return met.select("a", "b", (F.abs(F.col("a_ts_s") - F.col("b_ts_s")) <= 3600).alias("together"))


@query(f"""AS_ p AS (SELECT s.obs_id AS a, t.obs_id AS b FROM sourced s JOIN sourced t ON s.camera = t.camera AND s.scene = t.scene AND s.obs_id <> t.obs_id AND s.kind = 'purchase' AND t.kind = 'purchase' AND sqrt(power((s.x0 + s.x1 - t.x0 - t.x1) / 2, 2) + power((s.y0 + s.y1 - t.y0 - t.y1) / 2, 2)) <= 120),
r AS (SELECT obs_id AS a, obs_id AS b FROM sourced WHERE kind = 'purchase' UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a) SELECT a AS obs_id, min(b) AS review_group FROM r GROUP BY a""", "sourced")
def review_groups(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").where("kind = 'purchase'").select("camera", "scene", F.col("obs_id").alias("id"), _box().alias("box"))
    out = events.at_one_place(rows, ["camera", "scene"], 120.0, most_ratio=None)
    return out.select(F.col("id").alias("obs_id"), F.col("component").alias("review_group"))


@query("""AS_ e AS (SELECT card_id AS a, decision_id % 97 AS b, decision FROM decisions), p AS (SELECT a, b FROM e WHERE decision = 'confirmed' UNION SELECT b, a FROM e WHERE decision = 'confirmed'), n AS (SELECT a FROM p UNION SELECT b FROM p), r AS (SELECT a, a AS b FROM n UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a), c AS (SELECT a AS id, min(b) AS grp FROM r GROUP BY a)
SELECT e.a AS card_id, e.b AS other_id, x.grp AS merged FROM (SELECT DISTINCT a, b FROM e WHERE decision = 'rejected') e JOIN c x ON x.id = e.a JOIN c y ON y.id = e.b WHERE x.grp = y.grp""", "decisions")
def merge_conflicts(spark, sf_dir):
    said = load(spark, sf_dir, "decisions").select(F.col("card_id").alias("a"), (F.col("decision_id") % 97).alias("b"), "decision")
    return graph.decided_groups(said, "confirmed", "rejected")[1].select(F.col("a").alias("card_id"), F.col("b").alias("other_id"), F.col("root").alias("merged"))


@query("""AS_ p AS (SELECT obs_id, camera, scene, ts_s, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, lag(obs_id) OVER w AS o0, lag(ts_s) OVER w AS t0, lag((x0 + x1) / 2) OVER w AS px, lag((y0 + y1) / 2) OVER w AS py, lag(scene) OVER w AS s0 FROM sourced WINDOW w AS (PARTITION BY camera ORDER BY ts_s, obs_id))
SELECT obs_id, o0 AS previous, coalesce(s0 = scene AND ts_s - t0 <= 14400 AND sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) <= 600, false) AS same_episode FROM p""", "sourced")
def same_episode_suggestions(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").select("camera", "scene", "ts_s", "obs_id", _box().alias("box"))
    rows = blocks.previous(rows, ["camera"], ["ts_s", "obs_id"], ["obs_id", "ts_s", "scene", "box"])
    close = (F.col("prev1_scene") == F.col("scene")) & (F.col("ts_s") - F.col("prev1_ts_s") <= 14400) & (G.distance(F.col("prev1_box"), F.col("box")) <= 600)
    return rows.select("obs_id", F.col("prev1_obs_id").alias("previous"), F.coalesce(close, F.lit(False)).alias("same_episode"))


@query("""AS_ o AS (SELECT camera, obs_id, ts_s, x0, x1, y0, y1, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY camera ORDER BY ts_s, obs_id) AS k FROM sourced),
s AS (SELECT camera, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS obs_id, NULL::BIGINT AS cluster, CAST([] AS STRUCT(t DOUBLE, id BIGINT, x DOUBLE, y DOUBLE)[]) AS live FROM (SELECT DISTINCT camera FROM o)
UNION ALL SELECT n.camera, n.k, n.obs_id, coalesce(a.hit.id, n.obs_id), CASE WHEN a.hit IS NULL THEN list_append(a.live, {'t': n.ts_s, 'id': n.obs_id, 'x': n.cx, 'y': n.cy}) ELSE a.live END FROM s JOIN o n ON n.camera = s.camera AND n.k = s.k + 1,
LATERAL (SELECT list_filter(s.live, lambda c: n.ts_s - c.t <= 86400) AS live, list_filter(s.live, lambda c: n.ts_s - c.t <= 86400 AND sqrt((n.cx - c.x) * (n.cx - c.x) + (n.cy - c.y) * (n.cy - c.y)) <= 250)[1] AS hit) a)
SELECT s.cluster, count(*) AS members, arg_min(s.obs_id, (o.ts_s, s.obs_id)) AS first_id, arg_max(s.obs_id, (least(o.x1 - o.x0, o.y1 - o.y0), -o.ts_s, s.obs_id)) AS largest_id FROM s JOIN o USING (obs_id) WHERE s.k > 0 GROUP BY 1""", "sourced")
def near_duplicate_keeps(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").select("camera", "ts_s", "obs_id", _box().alias("b")).withColumn("cx", G.centre_x(F.col("b"))).withColumn("cy", G.centre_y(F.col("b")))
    found = states.first_sighting_clusters(rows, "camera", ["ts_s", "obs_id"], 250.0, 86400.0).select("obs_id", "cluster").join(rows, "obs_id")
    largest = F.max_by("obs_id", F.struct(G.short_side(F.col("b")), -F.col("ts_s"), F.col("obs_id")))
    return found.groupBy("cluster").agg(F.count("*").alias("members"), F.min_by("obs_id", F.struct("ts_s", "obs_id")).alias("first_id"), largest.alias("largest_id"))
