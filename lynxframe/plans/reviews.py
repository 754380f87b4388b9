"""Registered queries: item clusters, review coverage, time formats and label maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynxframe.functions import geometry as G
from lynxframe.operators import frames, graph, metrics, records, samples
from lynxframe.plans.boxes import _MATCH
from lynxframe.plans.catalogue import _IOU, _UNION, _greedy, query
from lynxframe.sources.fixtures import load

_PLACES = "SELECT stream_id, CAST(round((x0 + x1) * 100) AS BIGINT) AS x, CAST(round((y0 + y1) * 100) AS BIGINT) AS y, min(frame_no) AS id, count(*) AS n FROM {t} GROUP BY 1, 2, 3"


@query(f"""AS_ p AS ({_PLACES.format(t="observations")}), l AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.stream_id = b.stream_id AND a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1),
r AS (SELECT id AS a, id AS b FROM p UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS item FROM r GROUP BY a)
SELECT p.stream_id, c.item, count(*) AS places, CAST(sum(p.n) AS BIGINT) AS sightings FROM p JOIN c ON p.id = c.a GROUP BY 1, 2""", "observations")
def item_clusters(spark, sf_dir):
    places = spark.sql(_PLACES.format(t="{seen}"), seen=load(spark, sf_dir, "observations"))
    items = graph.components(places, graph.near_pairs(places, ["stream_id"], 1))
    return places.join(items, "id").groupBy("stream_id", F.col("component").alias("item")).agg(F.count("*").alias("places"), F.sum("n").alias("sightings"))


@query(_greedy("").replace(f"{_IOU} / {_UNION} >= 0.3", "sqrt(power((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, 2) + power((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2, 2)) <= 12.25"), "detections")
def same_position_collapse(spark, sf_dir):
    kept = frames.suppress(load(spark, sf_dir, "detections"), "frame_id", 0.0, conflict=lambda k, b: G.distance(k.box, b.box) <= 12.25)
    return kept.select("frame_id", "det_id")


@query(f"""{_MATCH}, f AS (SELECT frame_id, count(*) AS d FROM detections GROUP BY 1), t AS (SELECT frame_id, count(*) AS t FROM truth_boxes GROUP BY 1), h AS (SELECT frame_id, count(*) AS h FROM m GROUP BY 1), q AS (SELECT f.frame_id % 8 AS camera, d, coalesce(t, 0) AS t, coalesce(h, 0) AS h FROM f LEFT JOIN t USING (frame_id) LEFT JOIN h USING (frame_id))
SELECT camera, count(*) AS frames, round(sum(h) / nullif(sum(t), 0), 6) AS hit_rate, round(100.0 * sum(d - h) / count(*), 6) AS fp_per_100, round(count(*) FILTER (WHERE t > 0 AND h > 0) / nullif(count(*) FILTER (WHERE t > 0), 0), 6) AS frame_hit_rate FROM q GROUP BY ROLLUP (camera)""", "detections", "truth_boxes")
def frame_metrics(spark, sf_dir):
    out = frames.associate(load(spark, sf_dir, "detections"), load(spark, sf_dir, "truth_boxes"), "frame_id", 0.3)
    per = out.groupBy("frame_id").agg(F.count("det_id").alias("d"), F.count("gt_id").alias("t"), F.count_if(F.col("side") == "both").alias("h")).withColumn("camera", F.col("frame_id") % 8)
    n, held = F.count("*"), F.count_if(F.col("t") > 0)
    return per.rollup("camera").agg(n.alias("frames"), F.round(metrics.ratio(F.sum("h"), F.sum("t")), 6).alias("hit_rate"), F.round(100.0 * F.sum(F.col("d") - F.col("h")) / n, 6).alias("fp_per_100"), F.round(metrics.ratio(F.count_if((F.col("t") > 0) & (F.col("h") > 0)), held), 6).alias("frame_hit_rate"))


@query("SELECT d.source, count(*) AS documents, count(l.doc_id) AS reviewed, round(count(l.doc_id) / count(*), 6) AS share, count(*) = count(l.doc_id) AS complete FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (d.source)")
def review_coverage(spark, sf_dir):
    return records.coverage(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "source")[0]


_WRITTEN = {"spark": ("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"), "duck": ("strftime(ts, '%Y-%m-%d %H:%M:%S')", "strftime(ts, '%Y-%m-%dT%H:%M:%S')")}
_SAID = "CASE event_id % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE 'soon' END"


@query(f"SELECT event_id, epoch_us(coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%dT%H:%M:%S'))) AS at_us FROM (SELECT event_id, {_SAID.format(*_WRITTEN['duck'])} AS s FROM events)")
def tolerant_timestamps(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_SAID.format(*_WRITTEN["spark"])).alias("s"))
    at = samples.parsed_time(F.col("s"), ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"])
    return said.select("event_id", F.unix_micros(at).alias("at_us"))


@query("SELECT c.c_custkey, coalesce(n.n_name, 'class-' || CAST(c.c_nationkey + c.c_custkey % 3 AS VARCHAR)) AS label FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey + c.c_custkey % 3")
def class_labels(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("class_id"), "n_name")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_nationkey") + F.col("c_custkey") % 3).alias("class_id"))
    return samples.class_labels(rows, names, "class_id", "n_name").select("c_custkey", "label")


@query("AS_ g AS (SELECT track_id, frame_no, kind, ts_s - lag(ts_s) OVER w AS gap, lag(kind) OVER w AS before FROM observations WINDOW w AS (PARTITION BY track_id ORDER BY ts_s, frame_no)) SELECT track_id, frame_no, CASE WHEN gap IS NULL THEN 'first' WHEN before = kind THEN 'same kind' WHEN gap <= 3600 THEN 'close' ELSE 'no' END AS copy FROM g", "observations")
def copy_eligibility(spark, sf_dir):
    return load(spark, sf_dir, "observations").select("track_id", "frame_no", samples.copy_reason(["track_id"], ["ts_s", "frame_no"], "kind", 3600).alias("copy"))


@query("AS_ d AS (SELECT camera, file_id, start_s, CAST(floor(start_s / 604800) AS BIGINT) AS week, CAST(floor(start_s / 86400) AS BIGINT) % 7 AS day FROM recordings) SELECT camera, week, day, arg_min(file_id, (start_s, file_id)) AS file_id FROM d GROUP BY 1, 2, 3", "recordings")
def earliest_per_slot(spark, sf_dir):
    week, day = F.floor(F.col("start_s") / 604800), F.floor(F.col("start_s") / 86400) % 7
    return load(spark, sf_dir, "recordings").groupBy("camera", week.alias("week"), day.alias("day")).agg(F.min_by("file_id", F.struct("start_s", "file_id")).alias("file_id"))


@query("SELECT file_id, offset_no, CAST(start_s + CASE WHEN offset_no < 3 THEN (offset_no + 1) * 10800 ELSE CAST('0x' || substr(md5('s|' || CAST(file_id AS VARCHAR)), 1, 8) AS BIGINT) % 43200 END AS BIGINT) AS at_s FROM recordings CROSS JOIN (VALUES (0), (1), (2), (3)) AS o(offset_no)", "recordings")
def seeded_offsets(spark, sf_dir):
    out = samples.seeded_offsets(load(spark, sf_dir, "recordings"), "file_id", "start_s", [10800, 21600, 32400], 43200, "s")
    return out.select("file_id", "offset_no", "at_s")
