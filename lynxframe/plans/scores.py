"""Registered queries: quality at thresholds, reports, envelopes, cell tables and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynxframe.functions import geometry as G
from lynxframe.functions import rules as R
from lynxframe.operators import frames, graph, metrics, records, reports, samples
from lynxframe.plans.catalogue import _IOU, _UNION, _box, query, six, six_sql
from lynxframe.plans.links import folded
from lynxframe.shared import Scratch
from lynxframe.sources.fixtures import load

_BAND = "CASE WHEN least({0}x1 - {0}x0, {0}y1 - {0}y0) < 25 THEN 'small' WHEN least({0}x1 - {0}x0, {0}y1 - {0}y0) < 32 THEN 'middle' ELSE 'large' END"
_T = "(VALUES (0.1::DOUBLE), (0.4::DOUBLE), (0.7::DOUBLE)) AS t(t)"


@query(folded(f"SELECT a.frame_id * 10 + CAST(t * 10 AS BIGINT) AS frame_id, det_id, gt_id, row_number() OVER (PARTITION BY a.frame_id, t ORDER BY {_IOU} / {_UNION} DESC, conf DESC, det_id, gt_id) AS k FROM detections a JOIN truth_boxes b ON a.frame_id = b.frame_id AND {_IOU} / {_UNION} >= 0.3 JOIN {_T} ON a.conf >= t") + f""",
h AS (SELECT t AS threshold, {_BAND.format('b.')} AS size, count(*) AS required, count(m.gt_id) AS hit FROM truth_boxes b CROSS JOIN {_T} LEFT JOIN m ON m.frame_id = b.frame_id * 10 + CAST(t * 10 AS BIGINT) AND m.gt_id = b.gt_id GROUP BY 1, 2),
f AS (SELECT t AS threshold, {_BAND.format('a.')} AS size, count(*) AS fp FROM detections a JOIN {_T} ON a.conf >= t LEFT JOIN m ON m.frame_id = a.frame_id * 10 + CAST(t * 10 AS BIGINT) AND m.det_id = a.det_id WHERE m.det_id IS NULL GROUP BY 1, 2)
SELECT coalesce(h.threshold, f.threshold) AS threshold, coalesce(h.size, f.size) AS size, coalesce(required, 0) AS required, coalesce(hit, 0) AS hit, coalesce(fp, 0) AS fp FROM h FULL JOIN f ON h.threshold = f.threshold AND h.size = f.size""", "detections", "truth_boxes")
def detection_quality(spark, sf_dir):
    size = F.when(G.short_side(_box()) < 25, "small").when(G.short_side(_box()) < 32, "middle").otherwise("large")
    return reports.quality_by_threshold(load(spark, sf_dir, "detections"), load(spark, sf_dir, "truth_boxes"), "frame_id", [0.1, 0.4, 0.7], size)


_EPISODES = """AS_ o AS (SELECT *, camera * 100000 + CAST(floor(ts_s / 86400) AS BIGINT) AS episode FROM sourced)"""


@query(f"""{_EPISODES}, s AS (SELECT *, min(ts_s) OVER w AS a, max(ts_s) OVER w AS z FROM o WINDOW w AS (PARTITION BY episode))
SELECT episode, a AS first_s, z AS last_s, count(*) AS members, count(DISTINCT scene) AS scenes, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, bool_or(kind = 'purchase') AS required, arg_min(obs_id, (abs(ts_s - (a + z) / 2), obs_id)) AS representative, median(x0) AS median_x0, median(y0) AS median_y0, median(x1) AS median_x1, median(y1) AS median_y1 FROM s GROUP BY episode, a, z""", "sourced")
def episode_records(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").withColumn("episode", F.col("camera") * 100000 + F.floor(F.col("ts_s") / 86400))
    out = reports.episodes(rows, "episode", "obs_id", "ts_s", F.col("kind") == "purchase")
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT camera, kind, count(*) AS n, grouping(camera, kind) AS grouping FROM sourced GROUP BY GROUPING SETS ((camera), (kind), (camera, kind), ())", "sourced")
def stage_summary(spark, sf_dir):
    return reports.histograms(load(spark, sf_dir, "sourced"), [["camera"], ["kind"], ["camera", "kind"], []])


@query("SELECT scene, CASE WHEN x1 > 1700 OR y1 > 950 THEN 'unresolved' WHEN first_conf IS NULL THEN 'proposed' ELSE 'localised' END AS state, count(*) AS n, min(obs_id) AS first_id FROM sourced GROUP BY 1, 2", "sourced")
def localisation_counts(spark, sf_dir):
    state = R.chain(((F.col("x1") > 1700) | (F.col("y1") > 950), "unresolved"), (F.col("first_conf").isNull(), "proposed"), other="localised")
    return records.state_counts(load(spark, sf_dir, "sourced"), ["scene"], state, "obs_id", "unresolved")[0]


@query("AS_ r AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS k, count(*) OVER (PARTITION BY kind) AS n FROM observations WHERE value IS NOT NULL), p AS (SELECT kind, n, value FROM r WHERE k = CAST(ceil(n * 0.95) AS BIGINT)), l AS (SELECT DISTINCT kind, CASE kind WHEN 'click' THEN 60.0::DOUBLE ELSE 200.0::DOUBLE END AS lim FROM observations) SELECT l.kind, coalesce(n, 0) AS n, value AS percentile, CASE WHEN coalesce(n, 0) < 200 THEN 'insufficient' WHEN value <= lim THEN 'pass' ELSE 'fail' END AS verdict FROM l LEFT JOIN p USING (kind)", "observations")
def latency_budget(spark, sf_dir):
    rows = load(spark, sf_dir, "observations").select("kind", "value")
    limits = rows.select("kind").distinct().withColumn("limit", F.when(F.col("kind") == "click", 60.0).otherwise(200.0))
    return reports.percentiles_within(rows, "kind", "value", 0.95, limits, 200)


@query("SELECT camera, cell, count(gray) AS n, round(CASE WHEN count(gray) < 60 THEN 0.5::DOUBLE ELSE quantile_cont(gray, 0.9) + 0.02 END, 5) AS lim FROM cells GROUP BY 1, 2", "cells")
def enter_envelopes(spark, sf_dir):
    return reports.envelope(load(spark, sf_dir, "cells"), ["camera", "cell"], "gray", 0.9, 0.02, 60, 0.5).select("camera", "cell", "n", F.round("limit", 5).alias("lim"))


@query("SELECT class_id, frame_id % 5 AS scene, count(*) AS n, CASE WHEN count(*) < 385 THEN 30.0::DOUBLE ELSE median(x1 - x0) END AS width, CASE WHEN count(*) < 385 THEN 28.0::DOUBLE ELSE median(y1 - y0) END AS height FROM detections GROUP BY 1, 2", "detections")
def size_priors(spark, sf_dir):
    return reports.size_prior(load(spark, sf_dir, "detections").withColumn("scene", F.col("frame_id") % 5), ["class_id", "scene"], 385, (30.0, 28.0))


@query(f"AS_ f AS (SELECT frame_id, median(gray) AS mid FROM cells GROUP BY 1), c AS (SELECT c.frame_id, c.cell, abs(gray - mid) >= 0.15 AS changed FROM cells c JOIN f USING (frame_id)), n AS (SELECT frame_id, cell, cell % 8 AS x, cell // 8 AS y FROM c WHERE changed), k AS (SELECT a.frame_id, a.cell, count(b.cell) AS around FROM n a LEFT JOIN n b ON a.frame_id = b.frame_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.cell <> b.cell GROUP BY 1, 2), s AS (SELECT frame_id, count(*) AS cells FROM c GROUP BY 1) SELECT s.frame_id, {six_sql('CAST(count(k.cell) FILTER (WHERE around > 1) AS DOUBLE) / any_value(cells)')} AS ratio FROM s LEFT JOIN k USING (frame_id) GROUP BY 1", "cells")
def scene_change(spark, sf_dir):
    cells = load(spark, sf_dir, "cells").select("frame_id", "cell", "gray")
    mid = cells.groupBy("frame_id").agg(F.percentile("gray", F.lit(0.5)).alias("mid"), F.count("*").alias("cells"))
    changed = cells.join(mid, "frame_id").where(F.abs(F.col("gray") - F.col("mid")) >= 0.15)
    lasting = reports.isolated(changed, "frame_id", 8).where("around > 1").groupBy("frame_id").agg(F.count("*").alias("n"))
    return mid.join(lasting, "frame_id", "left").select("frame_id", six(F.coalesce("n", F.lit(0)) / F.col("cells")).alias("ratio"))


_REF = "AS_ d AS (SELECT a.vec_id AS frame_id, b.vec_id AS reference, median(abs(a.gray::DOUBLE - b.gray::DOUBLE)) AS distance FROM (SELECT vec_id, unnest(embedding) AS gray, generate_subscripts(embedding, 1) AS i FROM embeddings) a JOIN (SELECT vec_id, unnest(embedding) AS gray, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 100 = 0) b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY distance, reference) AS k FROM d)"


def _nearest(spark, sf_dir, k):
    """Every frame against the references (every hundredth vector), by the median of the cells' residuals."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"), "embedding")
    return reports.nearest_references(rows, rows.where("frame_id % 100 = 0"), "frame_id", "embedding", k)


@query(f"{_REF} SELECT frame_id, reference, round(distance, 5) AS distance, k AS place FROM r WHERE k <= 3", "cells")
def reference_ranks(spark, sf_dir):
    return _nearest(spark, sf_dir, 3).withColumn("distance", F.round("distance", 5))


@query(f"{_REF} SELECT reference, count(*) AS frames, count(*) FILTER (WHERE distance <= 0.11) AS covered FROM r WHERE k = 1 GROUP BY 1", "cells")
def reference_coverage(spark, sf_dir):
    return _nearest(spark, sf_dir, 1).groupBy("reference").agg(F.count("*").alias("frames"), F.count_if(F.col("distance") <= 0.11).alias("covered"))


_TOL = "m AS (SELECT camera, cell, median(gray) AS mid FROM cells GROUP BY 1, 2), t AS (SELECT c.camera, c.cell, any_value(mid) AS mid, median(abs(gray - mid)) AS mad FROM cells c JOIN m ON c.camera = m.camera AND c.cell = m.cell GROUP BY 1, 2), b AS (SELECT camera, cell, least(greatest(0.1, abs(mid) + greatest(3 * mad, 0.01)), 0.27) AS tolerance, abs(mid) + greatest(3 * mad, 0.01) > 0.27 AS biased FROM t)"


def _tolerances(spark, sf_dir):
    return samples.cell_tolerances(load(spark, sf_dir, "cells"), ["camera", "cell"], "gray", 0.1, 3, 0.01, 0.27)


@query(f"AS_ {_TOL} SELECT camera, cell, round(tolerance, 5) AS tolerance, biased FROM b", "cells")
def cell_tolerances(spark, sf_dir):
    return _tolerances(spark, sf_dir).withColumn("tolerance", F.round("tolerance", 5))


@query(f"AS_ {_TOL}, n AS (SELECT camera, cell, camera * 1000 + cell AS id, cell % 8 AS x, cell // 8 AS y FROM b WHERE biased), p AS (SELECT a.id AS a, c.id AS b FROM n a JOIN n c ON a.camera = c.camera AND abs(a.x - c.x) + abs(a.y - c.y) = 1), r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a), g AS (SELECT a AS id, min(b) AS region FROM r GROUP BY a) SELECT region, count(*) AS cells, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM g JOIN n USING (id) GROUP BY region HAVING count(*) >= 2", "cells")
def bias_regions(spark, sf_dir):
    flagged = _tolerances(spark, sf_dir).where("biased").select("camera", (F.col("camera") * 1000 + F.col("cell")).alias("id"), (F.col("cell") % 8).cast("long").alias("x"), F.floor(F.col("cell") / 8).alias("y"))
    flagged = Scratch(spark, "bias").save(flagged)
    regions = graph.components(flagged, graph.near_pairs(flagged, ["camera"], 1))
    return flagged.join(regions, "id").groupBy(F.col("component").alias("region")).agg(F.count("*").alias("cells"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).where("cells >= 2")


@query(f"SELECT camera, cell, {six_sql('CAST(count(*) FILTER (WHERE gray > 0) AS DOUBLE) / count(*)')} AS share, count(*) FILTER (WHERE gray > 0) * 2 >= count(*) AS in_mask FROM cells GROUP BY 1, 2", "cells")
def consensus_mask(spark, sf_dir):
    return records.voted(load(spark, sf_dir, "cells"), ["camera", "cell"], F.col("gray") > 0).withColumn("share", six("share"))


@query("AS_ t AS (SELECT track_id, count(*) AS n, max(ts_s) - min(ts_s) AS life FROM observations GROUP BY 1) SELECT count(*) AS tracks, CAST(sum(n) AS BIGINT) AS raw_rows, count(*) FILTER (WHERE life >= 86400) AS day, count(*) FILTER (WHERE life >= 604800) AS week, count(*) FILTER (WHERE life >= 2000000) AS long FROM t", "observations")
def track_funnel(spark, sf_dir):
    return records.funnel(load(spark, sf_dir, "observations"), "track_id", "ts_s", {"day": 86400, "week": 604800, "long": 2000000})


@query(f"SELECT device, lang, count(*) AS n, count(*) FILTER (WHERE passed AND label = 0) AS fp, {six_sql('CAST(count(*) FILTER (WHERE passed AND label = 0) AS DOUBLE) / count(*)')} AS fp_share FROM scored GROUP BY 1, 2", "scored")
def fp_by_stage(spark, sf_dir):
    out = records.false_positives(load(spark, sf_dir, "scored"), ["device", "lang"], F.col("passed"), F.col("label") != 0)
    return out.withColumn("fp_share", six("fp_share"))


@query("SELECT device, count(*) AS frames, count(*) FILTER (WHERE score >= 0.4) AS first_kept, count(*) FILTER (WHERE weight >= 3) AS second_kept, count(*) FILTER (WHERE score >= 0.4 AND weight >= 3) AS both_kept, count(*) FILTER (WHERE label = 1 AND score >= 0.4) - count(*) FILTER (WHERE label = 1 AND weight >= 3) AS gain FROM scored GROUP BY 1", "scored")
def regime_comparison(spark, sf_dir):
    return samples.policies_compared(load(spark, sf_dir, "scored"), ["device"], F.col("score") >= 0.4, F.col("weight") >= 3, F.col("label") == 1)


@query("SELECT CASE WHEN first_conf IS NULL THEN 'second' WHEN second_conf IS NULL THEN 'first' ELSE 'both' END AS method, count(*) AS n, round(avg(coalesce(first_conf, second_conf)), 5) AS mean_conf, max((x1 - x0) * (y1 - y0)) AS largest FROM sourced GROUP BY 1", "sourced")
def proposal_statistics(spark, sf_dir):
    out = records.by_method(load(spark, sf_dir, "sourced"), {"first": "first_conf", "second": "second_conf"}, "both", G.area(_box()))
    return out.withColumn("mean_conf", F.round("mean_conf", 5))


_ROI = "(VALUES ('west', 0.0::DOUBLE, 50.0::DOUBLE), ('east', 50.0::DOUBLE, 100.0::DOUBLE)) AS r(roi, low, high)"


@query(f"""AS_ d AS (SELECT d.*, roi, row_number() OVER (PARTITION BY frame_id, roi ORDER BY conf DESC, det_id) AS k FROM detections d JOIN {_ROI} ON (x0 + x1) / 2 >= low AND (x0 + x1) / 2 < high),
e AS (SELECT a.frame_id, a.roi, a.k AS ak, b.k AS bk FROM d a JOIN d b ON a.frame_id = b.frame_id AND a.roi = b.roi AND a.k < b.k AND {_IOU} / {_UNION} >= 0.3),
g AS (SELECT 0 AS step, frame_id, roi, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT frame_id, roi FROM d) UNION ALL SELECT g.step + 1, g.frame_id, g.roi, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.frame_id = g.frame_id AND e.roi = g.roi AND e.bk = g.step + 1 AND list_contains(g.kept, e.ak)) THEN g.kept ELSE list_append(g.kept, CAST(g.step + 1 AS BIGINT)) END FROM g WHERE EXISTS (SELECT 1 FROM d WHERE d.frame_id = g.frame_id AND d.roi = g.roi AND d.k = g.step + 1)),
k AS (SELECT d.* FROM d JOIN (SELECT frame_id, roi, arg_max(kept, step) AS kept FROM g GROUP BY 1, 2) x ON d.frame_id = x.frame_id AND d.roi = x.roi AND list_contains(x.kept, d.k)), f AS (SELECT DISTINCT frame_id, roi FROM detections CROSS JOIN {_ROI})
SELECT f.frame_id, f.roi, count(k.det_id) AS boxes, {six_sql('least(1, coalesce(sum((k.x1 - k.x0) * (k.y1 - k.y0)), 0) / 5000)')} AS area_ratio, max(k.conf) AS top_conf, arg_max(k.class_id, (k.conf, -k.det_id)) AS top_class FROM f LEFT JOIN k ON k.frame_id = f.frame_id AND k.roi = f.roi GROUP BY 1, 2""", "detections")
def roi_snapshots(spark, sf_dir):
    rows = load(spark, sf_dir, "detections")
    rois = F.array(*[F.struct(F.lit(n).alias("roi"), F.lit(low).alias("low"), F.lit(high).alias("high")) for n, low, high in (("west", 0.0, 50.0), ("east", 50.0, 100.0))])
    inside = F.filter(rois, lambda r: (G.centre_x(_box()) >= r.low) & (G.centre_x(_box()) < r.high))
    placed = rows.withColumn("roi", F.explode(F.transform(inside, lambda r: r.roi))).withColumn("fr", F.struct("frame_id", "roi"))
    kept = frames.suppress(placed, "fr", 0.3)
    out = kept.groupBy("fr").agg(F.count("*").alias("boxes"), F.least(F.lit(1.0), F.sum(G.area(_box())) / 5000).alias("area_ratio"), F.max("conf").alias("top_conf"), F.max_by("class_id", F.struct(F.col("conf"), -F.col("det_id"))).alias("top_class")).select("fr.*", "boxes", "area_ratio", "top_conf", "top_class")
    every = rows.select("frame_id").distinct().select("frame_id", F.explode(F.transform(rois, lambda r: r.roi)).alias("roi"))
    return every.join(out, ["frame_id", "roi"], "left").select("frame_id", "roi", F.coalesce("boxes", F.lit(0)).alias("boxes"), six(F.coalesce("area_ratio", F.lit(0.0))).alias("area_ratio"), "top_conf", "top_class")


@query("AS_ c AS (SELECT camera, CAST(floor(ts_s / 3600) AS BIGINT) AS tick, kind = 'purchase' AS created, kind = 'error' AS cleared, obs_id FROM sourced) SELECT camera, count(*) AS records, count(*) FILTER (WHERE created) AS new_records, round(count(*) FILTER (WHERE created AND obs_id % 3 > 0)::DOUBLE / nullif(count(*) FILTER (WHERE created), 0), 6) AS record_precision, round(count(*) FILTER (WHERE created AND obs_id % 3 = 0) / ((max(tick) - min(tick) + 1)::DOUBLE), 6) AS false_per_hour FROM c GROUP BY 1", "sourced")
def record_precision(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").withColumn("tick", F.floor(F.col("ts_s") / 3600))
    new, false_ = F.count_if(F.col("kind") == "purchase"), F.count_if((F.col("kind") == "purchase") & (F.col("obs_id") % 3 == 0))
    hours = F.max("tick") - F.min("tick") + 1
    return rows.groupBy("camera").agg(F.count("*").alias("records"), new.alias("new_records"), F.round(metrics.ratio(new - false_, new), 6).alias("record_precision"), F.round(false_ / hours, 6).alias("false_per_hour"))


@query("""AS_ t AS (SELECT camera, obs_id, ts_s FROM sourced WHERE kind = 'view'), v AS (SELECT camera, CAST(floor(ts_s / 86400) AS BIGINT) AS episode, min(ts_s) AS start_s, max(ts_s) AS end_s FROM sourced WHERE kind IN ('click', 'purchase') GROUP BY 1, 2)
SELECT v.camera, v.episode, count(t.obs_id) AS sightings, round(min(t.ts_s) - any_value(v.start_s), 3) AS delay_s FROM v LEFT JOIN t ON t.camera = v.camera AND t.ts_s >= v.start_s AND t.ts_s < v.end_s GROUP BY 1, 2""", "sourced")
def visible_sightings(spark, sf_dir):
    # Episodes lie within a day here, so the day is a key of the join.
    rows = load(spark, sf_dir, "sourced").withColumn("episode", F.floor(F.col("ts_s") / 86400))
    visible = rows.where("kind in ('click', 'purchase')").groupBy("camera", "episode").agg(F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s"))
    out = samples.sightings(visible, rows.where("kind = 'view'"), ["camera", "episode"])
    return out.select("camera", "episode", "sightings", F.round("delay_s", 3).alias("delay_s"))
