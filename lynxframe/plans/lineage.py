"""Registered queries: lineage of episodes, events at one place, listings, evenly spaced files and linear heads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lynxframe.functions import geometry as G
from lynxframe.functions import rules as R
from lynxframe.operators import events, frames, learning, lineage, reports, selection, states, timeline
from lynxframe.plans.catalogue import _INSIDE, _IOU, _UNION, _box, _in_zones, query, six, six_sql
from lynxframe.plans.links import folded
from lynxframe.sources import listing
from lynxframe.sources.fixtures import load

_EPISODE = "concat_ws('-', CAST(camera AS {text}), kind, CAST(CAST(floor(ts_s / 86400) AS BIGINT) AS {text})) AS episode"
_EPISODE_DUCK, _EPISODE_SPARK = _EPISODE.format(text="VARCHAR"), _EPISODE.format(text="STRING")


def _sourced(spark, sf_dir):
    return load(spark, sf_dir, "sourced").selectExpr("*", _EPISODE_SPARK)


_AUDIT = f"""AS_ l AS (SELECT obs_id, CASE WHEN r >= 128 THEN obs_id END AS file_id, second_conf IS NOT NULL AS framed, ts_s < max(ts_s) OVER (PARTITION BY camera) - 864000 AS old, r + g >= 480 AS whole, b < 200 AS assets, seen_place AS reach FROM sourced WHERE NOT (seen_look AND seen_place)),
m AS (SELECT {_EPISODE_DUCK}, l.* FROM sourced s LEFT JOIN l ON l.obs_id = s.obs_id),
e AS (SELECT episode, bool_or(coalesce(whole, false)) AS a, bool_or(coalesce(file_id IS NOT NULL AND NOT old AND assets, false)) AS b, bool_or(coalesce(file_id IS NOT NULL AND reach, false)) AS reach, bool_or(coalesce(file_id IS NOT NULL AND old, false)) AS old, bool_or(coalesce(file_id IS NULL AND NOT framed AND assets, false)) AS crop, bool_or(coalesce(file_id IS NULL AND framed, false)) AS recover, bool_or(coalesce(NOT assets, true)) AS gone FROM m GROUP BY 1),
t AS (SELECT episode, CASE WHEN a OR b THEN 'TRAINABLE_SOURCE_NATIVE' WHEN old OR crop THEN 'REVIEW_ONLY' ELSE 'LINEAGE_UNRESOLVED' END AS status, CASE WHEN a THEN 'A_source_resolution_frame_asset' WHEN b THEN 'B_ps_file_id_plus_timestamp' ELSE 'none' END AS method,
CASE WHEN a OR (b AND reach) THEN '' WHEN b THEN 'ps_reachability_unverified_requires_refetch' WHEN old THEN 'recording_beyond_declared_retention_window' WHEN crop THEN 'only_derived_crop_or_context_no_source_route' WHEN recover THEN 'source_file_id_missing_may_recover_via_frame_id_timestamp' WHEN gone THEN 'referenced_asset_missing' ELSE 'insufficient_lineage_evidence' END AS reason FROM e)"""


@query(f"{_AUDIT} SELECT * FROM t", "sourced")
def episode_trainability(spark, sf_dir):
    rows = _sourced(spark, sf_dir)
    known = rows.where("not (seen_look and seen_place)").selectExpr("obs_id", "camera", "case when r >= 128 then obs_id end as file_id", "case when second_conf is not null then obs_id end as frame_id", "ts_s", "r + g >= 480 as full_frame", "b < 200 as assets", "seen_place as reachable")
    newest = known.groupBy("camera").agg((F.max("ts_s") - 864000).alias("oldest_s"))
    return lineage.trainability(rows, known.join(newest, "camera"), "episode", "obs_id", F.col("oldest_s"))


@query(f"{_AUDIT} SELECT status, CASE WHEN reason <> '' THEN reason ELSE method END AS why, count(*) AS n FROM t GROUP BY 1, 2", "sourced")
def lineage_readiness(spark, sf_dir):
    return lineage.readiness(episode_trainability(spark, sf_dir))


@query(f"""AS_ m AS (SELECT {_EPISODE_DUCK}, CASE WHEN r >= 20 THEN floor(ts_s / 3600) END AS moment, seen_place AND seen_look AS wrong, first_conf, second_conf FROM sourced),
c AS (SELECT episode, bool_or(first_conf IS NULL) AS nofile, coalesce(min(least(coalesce(first_conf, 1), coalesce(second_conf, 1))) < 0.1, false) AS near, count(*) > 1 AS several, count(moment) > count(DISTINCT moment) AS same, bool_or(wrong) AS wrong FROM m GROUP BY 1),
g AS (SELECT episode, concat_ws(',', CASE WHEN several AND wrong THEN 'box_wrong_participates_in_grouping' END, CASE WHEN near THEN 'near_threshold' END, CASE WHEN several AND same THEN 'same_frame_merge_risk' END) AS grouping_reasons, CASE WHEN nofile THEN 'lineage_source_file_id_unavailable' ELSE '' END AS lineage_reasons FROM c)
SELECT *, grouping_reasons <> '' AS grouping_risk, grouping_reasons = '' AND lineage_reasons <> '' AS lineage_only FROM g""", "sourced")
def episode_risk(spark, sf_dir):
    rows = _sourced(spark, sf_dir)
    low = F.least(F.coalesce("first_conf", F.lit(1.0)), F.coalesce("second_conf", F.lit(1.0)))
    why = R.reasons((F.max(F.col("first_conf").isNull()), "lineage_source_file_id_unavailable"), (F.min(low) < 0.1, "near_threshold"))
    candidates = rows.groupBy("episode").agg(why.alias("reasons"))
    members = rows.withColumn("moment", F.when(F.col("r") >= 20, F.floor(F.col("ts_s") / 3600)))
    out = lineage.grouping_risk(candidates, members, "episode", "moment", F.col("seen_place") & F.col("seen_look"))
    return out.withColumns({c: F.concat_ws(",", c) for c in ("grouping_reasons", "lineage_reasons")})


@query(f"""AS_ o AS (SELECT stream_id, CAST(floor(ts_s / 864000) AS BIGINT) AS generation, frame_no, ts_s FROM observations), k AS (SELECT stream_id, generation, -min(ts_s) AS off FROM o GROUP BY 1, 2 HAVING count(*) >= 50),
t AS (SELECT o.stream_id, o.generation, frame_no, off, ts_s + off AS media_s FROM o LEFT JOIN k ON o.stream_id = k.stream_id AND o.generation = k.generation)
SELECT stream_id, generation, frame_no, {six_sql('media_s')} AS media_s, CASE WHEN off IS NULL THEN 'unmapped' WHEN NOT (media_s >= 0 AND media_s < 777600) THEN 'out of range' WHEN media_s <= lag(media_s) OVER (PARTITION BY stream_id, generation ORDER BY frame_no) THEN 'not increasing' END AS fault FROM t""", "observations")
def media_times(spark, sf_dir):
    rows = load(spark, sf_dir, "observations").select("stream_id", F.floor(F.col("ts_s") / 864000).alias("generation"), "frame_no", "ts_s")
    mapping = rows.groupBy("stream_id", "generation").agg((-F.min("ts_s")).alias("offset_s"), F.count("*").alias("n")).where("n >= 50")
    out = lineage.to_media_time(rows, mapping, ["stream_id", "generation"], "ts_s", "frame_no", 777600, F.floor(F.col("frame_no") / 100_000))
    return out.select("stream_id", "generation", "frame_no", six("media_s").alias("media_s"), "fault")


_CENTRES = "sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) * ((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) + ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) * ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2))"
_SHORT = "least({0}.x1 - {0}.x0, {0}.y1 - {0}.y0)"
_SAME_PLACE = f"({_CENTRES} <= 300 AND greatest({_SHORT.format('a')}, {_SHORT.format('b')}) / least({_SHORT.format('a')}, {_SHORT.format('b')}) <= 5)"


@query(folded(f"SELECT a.run AS frame_id, a.obs_id AS det_id, b.obs_id AS gt_id, row_number() OVER (PARTITION BY a.run ORDER BY a.obs_id, {_CENTRES}, b.obs_id) AS k FROM ev a JOIN ev b ON a.run = b.run AND a.online AND NOT b.online AND {_SAME_PLACE}").replace("AS_ ", "AS_ ev AS (SELECT *, concat_ws('-', CAST(camera AS VARCHAR), CAST(CAST(floor(ts_s / 86400) AS BIGINT) AS VARCHAR)) AS run, kind IN ('purchase', 'click') AS online FROM sourced), ", 1) + f"""
SELECT a.run, a.obs_id AS det_id, m.gt_id, {six_sql(_CENTRES)} AS distance FROM ev a LEFT JOIN m ON m.frame_id = a.run AND m.det_id = a.obs_id LEFT JOIN ev b ON b.obs_id = m.gt_id WHERE a.online""", "sourced")
def reviewed_event_pairs(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").withColumn("run", F.concat_ws("-", "camera", F.floor(F.col("ts_s") / 86400)))
    online = F.col("kind").isin("purchase", "click")
    box = ["x0", "y0", "x1", "y1"]
    ours = rows.where(online).select("run", F.col("obs_id").alias("det_id"), F.lit(0.0).alias("conf"), *box)
    out = events.nearest_reviewed(ours, rows.where(~online).select("run", F.col("obs_id").alias("gt_id"), *box), "run", 300.0)
    return out.withColumn("distance", six("distance"))


@query(f"""AS_ ev AS (SELECT *, {_EPISODE_DUCK} FROM sourced), l AS (SELECT a.obs_id AS a, b.obs_id AS b FROM ev a JOIN ev b ON a.episode = b.episode AND a.obs_id <> b.obs_id AND {_SAME_PLACE}),
c AS (SELECT obs_id AS id, obs_id AS root FROM sourced UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id), g AS (SELECT id, min(root) AS component FROM c GROUP BY 1),
r AS (SELECT component, id, ts_s, r, row_number() OVER (PARTITION BY component ORDER BY ts_s, id) AS k FROM g JOIN ev ON obs_id = id)
SELECT component, min(CASE WHEN k = 1 THEN id END) AS event_id, min(ts_s) AS first_s, max(ts_s) AS last_s, CAST(sum(r) AS BIGINT) AS total, count(*) - 1 AS absorbed FROM r GROUP BY 1""", "sourced")
def absorbed_events(spark, sf_dir):
    rows = _sourced(spark, sf_dir).select("episode", F.col("obs_id").alias("id"), _box().alias("box"), F.col("ts_s").alias("first_s"), F.col("ts_s").alias("last_s"), F.col("r").cast("long").alias("total"))
    return events.absorbed(rows, events.at_one_place(rows, ["episode"], 300.0), ["total"], "first_s", "last_s")


_DIAGONAL = "sqrt(({0}.x1 - {0}.x0) * ({0}.x1 - {0}.x0) + ({0}.y1 - {0}.y0) * ({0}.y1 - {0}.y0))"
_DA, _DB = _DIAGONAL.format("a"), _DIAGONAL.format("b")


@query(f"""AS_ d AS (SELECT *, camera * 100 + scene AS grp, row_number() OVER (PARTITION BY camera, scene ORDER BY coalesce(first_conf, second_conf) DESC, obs_id) AS k FROM sourced WHERE kind <> 'error'),
e AS (SELECT a.grp, a.k AS ak, b.k AS bk FROM d a JOIN d b ON a.grp = b.grp AND a.k < b.k AND ({_IOU} / {_UNION} >= 0.45 OR ({_DB} / greatest(1, {_DA}) BETWEEN 0.65 AND 1.55 AND {_CENTRES} <= 0.18 * greatest({_DA}, {_DB})))),
g AS (SELECT 0 AS step, grp, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT grp FROM d) UNION ALL SELECT g.step + 1, g.grp, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.grp = g.grp AND e.bk = g.step + 1 AND list_contains(g.kept, e.ak)) THEN g.kept ELSE list_append(g.kept, CAST(g.step + 1 AS BIGINT)) END FROM g WHERE EXISTS (SELECT 1 FROM d WHERE d.grp = g.grp AND d.k = g.step + 1))
SELECT camera, scene, obs_id FROM d JOIN (SELECT grp, arg_max(kept, step) AS kept FROM g GROUP BY grp) r ON d.grp = r.grp AND list_contains(r.kept, d.k) UNION ALL SELECT camera, scene, obs_id FROM sourced WHERE kind = 'error'""", "sourced")
def lasting_proposals(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").select("camera", "scene", "kind", F.col("obs_id").alias("id"), F.coalesce("first_conf", "second_conf").alias("score"), _box().alias("box"))
    kept = events.strongest(rows.where("kind <> 'error'"), ["camera", "scene"], "score", 100.0, events.same_proposal)
    return kept.unionByName(rows.where("kind = 'error'")).select("camera", "scene", F.col("id").alias("obs_id"))


@query(f"SELECT a.camera, a.kind, a.obs_id AS id, b.obs_id AS other, {six_sql('sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0))')} AS distance FROM sourced a JOIN sourced b ON a.camera = b.camera AND a.kind = b.kind AND a.obs_id > b.obs_id AND sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)) < 36", "sourced")
def near_clicks(spark, sf_dir):
    clicks = load(spark, sf_dir, "sourced").select("camera", "kind", F.col("obs_id").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return events.near_clicks(clicks, ["camera", "kind"], 1800, 1000).withColumn("distance", six("distance"))


_HELD = "{0}.x0 + {0}.x1 BETWEEN 2 * {1}.x0 AND 2 * {1}.x1 AND {0}.y0 + {0}.y1 BETWEEN 2 * {1}.y0 AND 2 * {1}.y1"


@query(f"SELECT b.frame_id, b.det_id FROM detections b WHERE class_id > 0 AND NOT EXISTS (SELECT 1 FROM detections a WHERE a.frame_id = b.frame_id AND a.class_id = 0 AND ({_IOU} > 0 OR ({_HELD.format('a', 'b')}) OR ({_HELD.format('b', 'a')})))", "detections")
def event_overrides(spark, sf_dir):
    rows = load(spark, sf_dir, "detections")
    return frames.uncovered(rows.where("class_id > 0"), rows.where("class_id = 0"), "frame_id", lambda b, event: G.overrides(event, b)).select("frame_id", "det_id")


@query("AS_ n AS (SELECT *, (floor(ts_s / 3600) + 1) * 3600 AS now FROM sourced) SELECT obs_id, scene = camera % 3 AND kind <> 'error' AND ts_s <= now + 0.05 AND now - ts_s <= 1800 AND coalesce(first_conf, second_conf) > 0 AS usable FROM n", "sourced")
def usable_observations(spark, sf_dir):
    now = (F.floor(F.col("ts_s") / 3600) + 1) * 3600
    ok = R.usable(F.col("ts_s"), now, F.col("scene"), F.col("camera") % 3, F.col("kind") == "error", F.coalesce("first_conf", "second_conf"), 1800)
    return load(spark, sf_dir, "sourced").select("obs_id", ok.alias("usable"))


@query(folded("SELECT camera AS frame_id, slot AS det_id, file_id AS gt_id, row_number() OVER (PARTITION BY camera ORDER BY slot, r) AS k FROM (SELECT *, row_number() OVER (PARTITION BY camera, slot ORDER BY off, start_s, file_id) AS r FROM w) WHERE r <= 6").replace("AS_ ", "AS_ f AS (SELECT camera, start_s, file_id, min(start_s) OVER v AS low, max(start_s) OVER v AS high FROM recordings WINDOW v AS (PARTITION BY camera)), w AS (SELECT camera, start_s, file_id, slot, abs(start_s - (low + (CAST(slot AS DOUBLE) + CAST(0.5 AS DOUBLE)) * (high - low) / 6)) AS off FROM f CROSS JOIN range(6) s(slot)), ", 1) + " SELECT frame_id AS camera, gt_id AS file_id, CAST(det_id AS INT) AS slot FROM m", "recordings")
def evenly_spaced_files(spark, sf_dir):
    return selection.evenly_spaced(load(spark, sf_dir, "recordings"), "camera", "start_s", "file_id", 6)


@query("""WITH p AS (SELECT o_custkey AS page, min(o_totalprice) < 2000 AS bad FROM orders GROUP BY 1)
SELECT page, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS file_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS record_start, CAST(floor(o_totalprice) AS BIGINT) AS file_size, CASE WHEN o_orderstatus = 'P' THEN 'file_id' END AS fault FROM orders JOIN p ON o_custkey = page AND NOT bad
UNION ALL SELECT page, NULL, NULL, NULL, 'code' FROM p WHERE bad""")
def listing_files(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    file = F.struct(F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderkey").cast("string")).alias("fileId"), at.alias("recordStartTime"), at.alias("recordEndTime"), F.floor("o_totalprice").alias("fileSize"))
    answer = F.struct(F.when(F.min("o_totalprice") < 2000, 500).otherwise(200).alias("code"), F.struct(F.collect_list(file).alias("records")).alias("data"))
    pages = orders.groupBy(F.col("o_custkey").alias("page")).agg(F.to_json(answer).alias("body"))
    return listing.parse_pages(pages).select("page", "file_id", "record_start", "file_size", "fault")


@query("""AS_ n AS (SELECT 'recordings' AS artifact, 'camera' AS "by", CAST(camera AS VARCHAR) AS value FROM recordings UNION ALL SELECT 'recordings', '', '' FROM recordings UNION ALL SELECT 'decisions', 'decision', decision FROM decisions UNION ALL SELECT 'decisions', '', '' FROM decisions
UNION ALL SELECT 'sourced', '', '' FROM sourced UNION ALL SELECT 'sourced', 'kind', kind FROM sourced UNION ALL SELECT 'sourced', 'camera,scene', CAST(camera AS VARCHAR) || '|' || CAST(scene AS VARCHAR) FROM sourced) SELECT artifact, "by", value, count(*) AS n FROM n GROUP BY 1, 2, 3""", "recordings", "decisions", "sourced")
def phase_report(spark, sf_dir):
    sets = {"recordings": [["camera"]], "decisions": [["decision"]], "sourced": [["kind"], ["camera", "scene"]]}
    return reports.phase_report({name: (load(spark, sf_dir, name), by) for name, by in sets.items()})


@query(f"""AS_ f AS (SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [r, g, b]) AS v FROM embeddings JOIN sourced ON obs_id = vec_id), u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM f),
n AS (SELECT vec_id, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-6) AS x FROM u), s AS (SELECT i, avg(x) AS m, greatest(stddev_pop(x), 1e-3) AS s FROM n GROUP BY 1)
SELECT vec_id, {six_sql("(CAST(-0.1 AS DOUBLE) + sum((x - m) / s * (CAST(1 AS DOUBLE) / (i + 1) + CASE WHEN i % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END))) / 2")} AS score FROM n JOIN s USING (i) GROUP BY 1""", "sourced")
def linear_head_scores(spark, sf_dir):
    colours = load(spark, sf_dir, "sourced").select(F.col("obs_id").alias("vec_id"), F.array("r", "g", "b").alias("rgb"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = learning.features([(vectors, "embedding"), (colours, "rgb")], "vec_id")
    mean, std = learning.moments(rows, "features")
    heads = [learning.Head([1 / (i + 1) for i in range(len(mean))], 0.1, mean, std), learning.Head([0.5 if i % 2 == 0 else -0.5 for i in range(len(mean))], -0.2, mean, std)]
    return rows.select("vec_id", six(learning.linear_score(F.col("features"), *heads)).alias("score"))


@query()
def held_out_scores(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), "embedding")
    rows = load(spark, sf_dir, "scored").drop("score").join(vectors, "sample_id")
    return learning.held_out(rows, "embedding", "label", "lang")[0].select("sample_id", "lang", "label", F.round("score", 4).alias("score"))


_VISITS = f"""AS_ seen AS (SELECT o.*, z.zone_id FROM observations o JOIN zones z ON o.stream_id = z.stream_id AND z.kind = 'roi' AND {_INSIDE}),
s AS (SELECT *, CASE WHEN ts_s - lag(ts_s) OVER w > 86400 THEN 1 ELSE 0 END AS fresh FROM seen WINDOW w AS (PARTITION BY stream_id, zone_id, track_id ORDER BY ts_s, frame_no)),
v AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY stream_id, zone_id, track_id ORDER BY ts_s, frame_no) AS BIGINT) AS visit FROM s),
p AS (SELECT *, ts_s - min(ts_s) OVER (PARTITION BY stream_id, zone_id, track_id, visit) AS dwell, max(x0) OVER w - min(x0) OVER w AS span FROM v WINDOW w AS (PARTITION BY stream_id, zone_id, track_id, visit ORDER BY ts_s, frame_no))"""


@query(f"""{_VISITS}, h AS (SELECT *, row_number() OVER (PARTITION BY stream_id, zone_id, track_id ORDER BY ts_s, frame_no) AS k FROM p WHERE CASE WHEN dwell >= 3600 THEN 40 ELSE 0 END + CASE WHEN dwell >= 21600 AND span <= 0.3 THEN 20 ELSE 0 END + CASE WHEN conf >= 0.5 THEN 20 ELSE 0 END >= 60),
g AS (SELECT stream_id, zone_id, track_id, k, frame_no, visit, CAST(-1 AS BIGINT) AS done, CAST(NULL AS DOUBLE) AS last, true AS alert, ts_s FROM h WHERE k = 1 UNION ALL
SELECT h.stream_id, h.zone_id, h.track_id, h.k, h.frame_no, h.visit, CASE WHEN g.alert THEN g.visit ELSE g.done END, CASE WHEN g.alert THEN g.ts_s ELSE g.last END, h.visit <> CASE WHEN g.alert THEN g.visit ELSE g.done END AND h.ts_s - CASE WHEN g.alert THEN g.ts_s ELSE g.last END >= 259200, h.ts_s
FROM g JOIN h ON h.stream_id = g.stream_id AND h.zone_id = g.zone_id AND h.track_id = g.track_id AND h.k = g.k + 1)
SELECT stream_id, zone_id, track_id, visit, frame_no FROM g WHERE alert""", "observations", "zones")
def visit_risk_alerts(spark, sf_dir):
    keys = ["stream_id", "zone_id", "track_id"]
    visits = timeline.sessions(_in_zones(spark, sf_dir, "roi"), keys, "ts_s", 86400, "frame_no").withColumn("visit", F.col("session").cast("long"))
    so_far = Window.partitionBy(*keys, "visit").orderBy("ts_s", "frame_no").rowsBetween(Window.unboundedPreceding, 0)
    dwell, span = F.col("ts_s") - F.min("ts_s").over(so_far), F.max("x0").over(so_far) - F.min("x0").over(so_far)
    rows = visits.select("*", dwell.alias("dwell"), span.alias("span"))
    score = R.capped_score((F.col("dwell") >= 3600, 40), ((F.col("dwell") >= 21600) & (F.col("span") <= 0.3), 20), (F.col("conf") >= 0.5, 20))
    out = states.visit_alerts(rows.withColumn("score", score), keys, ["ts_s", "frame_no"], "visit", "score", 60, 259200)
    return out.select(*keys, "visit", "frame_no")
