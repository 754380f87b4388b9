"""Registered queries: box measures, tiers, buckets, states and verdicts that look at one row or one small group."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynxframe.functions import geometry as G
from lynxframe.functions import rules as R
from lynxframe.functions import text as T
from lynxframe.operators import blocks, samples
from lynxframe.plans.catalogue import _AREAS, _INSIDE, _IOU, _UNION, _box, _polygon, query, six, six_sql
from lynxframe.sources.fixtures import load



def _sources():
    """Confidence by source, without the sources that saw nothing."""
    return F.map_filter(F.create_map(F.lit("first"), F.col("first_conf"), F.lit("second"), F.col("second_conf")), lambda k, v: v.isNotNull())


_DIST = "sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) * ((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) + ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) * ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2))"
_SHORT = ("least(a.x1 - a.x0, a.y1 - a.y0)", "least(b.x1 - b.x0, b.y1 - b.y0)")


@query(f"SELECT det_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, y1 AS bottom, (x1 - x0) * (y1 - y0) AS area, {six_sql('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))')} AS diagonal, least(x1 - x0, y1 - y0) AS short_side FROM detections", "detections")
def box_measures(spark, sf_dir):
    return load(spark, sf_dir, "detections").select("det_id", G.centre_x(_box()).alias("cx"), G.centre_y(_box()).alias("cy"), F.col("y1").alias("bottom"), G.area(_box()).alias("area"), six(G.diagonal(_box())).alias("diagonal"), G.short_side(_box()).alias("short_side"))


@query(f"SELECT frame_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, {six_sql('sum((x0 + x1) / 2) / count(*)')} AS cx, {six_sql('sum((y0 + y1) / 2) / count(*)')} AS cy FROM detections GROUP BY frame_id", "detections")
def frame_extents(spark, sf_dir):
    out = load(spark, sf_dir, "detections").groupBy("frame_id").agg(*G.extent())
    return out.select("frame_id", "x0", "y0", "x1", "y1", six("cx").alias("cx"), six("cy").alias("cy"))


@query(f"""AS_ p AS (SELECT a.frame_id, a.det_id, b.det_id AS other_id, {_DIST} <= 30 AND greatest({_SHORT[0]}, {_SHORT[1]}) / least({_SHORT[0]}, {_SHORT[1]}) <= 1.2 AS same_target,
{_IOU} / {_UNION} >= 0.5 OR (abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) <= (b.x1 - b.x0) * 0.2 AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= (b.y1 - b.y0) * 0.2) OR ({_DIST} <= greatest(8.0, 0.5 * greatest({_SHORT[0]}, {_SHORT[1]})) AND greatest({_AREAS[0]}, {_AREAS[1]}) / least({_AREAS[0]}, {_AREAS[1]}) <= 1.5) AS matching
FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.det_id < b.det_id) SELECT * FROM p WHERE same_target OR matching""", "detections")
def same_target_pairs(spark, sf_dir):
    rows = load(spark, sf_dir, "detections")
    a, b = rows.select("frame_id", "det_id", _box().alias("a")), rows.select("frame_id", F.col("det_id").alias("other_id"), _box().alias("b"))
    x, y = F.col("a"), F.col("b")
    flags = [G.same_target(x, y, 30.0, 1.2).alias("same_target"), G.channels_match(x, y, 0.5, 0.4, 8.0, 1.5).alias("matching")]
    return a.join(b, "frame_id").where("det_id < other_id").select("frame_id", "det_id", "other_id", *flags).where("same_target or matching")


_STRICT = "CASE WHEN z.zone_id = 'diamond' THEN abs((o.x0 + o.x1) / 2 - (z.x0 + z.x1) / 2) / ((z.x1 - z.x0) / 2) + abs(o.y1 - (z.y0 + z.y1) / 2) / ((z.y1 - z.y0) / 2) < 1 - 1e-8 ELSE (o.x0 + o.x1) / 2 > z.x0 + 1e-9 AND (o.x0 + o.x1) / 2 < z.x1 - 1e-9 AND o.y1 > z.y0 + 1e-9 AND o.y1 < z.y1 - 1e-9 END"


@query(f"SELECT z.stream_id, z.zone_id, count(*) FILTER (WHERE {_INSIDE}) AS inside, count(*) FILTER (WHERE {_STRICT}) AS strictly FROM observations o JOIN zones z ON o.stream_id = z.stream_id GROUP BY 1, 2", "observations", "zones")
def zone_edges(spark, sf_dir):
    zones = load(spark, sf_dir, "zones").select("stream_id", "zone_id", _polygon().alias("polygon"))
    seen = load(spark, sf_dir, "observations").select("stream_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), "y1")
    args = (F.col("cx"), F.col("y1"), F.col("polygon"))
    return seen.join(zones, "stream_id").groupBy("stream_id", "zone_id").agg(F.count_if(G.in_polygon(*args)).alias("inside"), F.count_if(G.in_polygon(*args, edge_inside=False)).alias("strictly"))


@query(f"""AS_ t AS (SELECT *, floor((x0 + x1) / 2 / 25) * 25 AS ox, floor((y0 + y1) / 2 / 25) * 25 AS oy FROM detections), m AS (SELECT *, least(x0 - ox, y0 - oy, 25 - (x1 - ox), 25 - (y1 - oy)) AS margin FROM t)
SELECT det_id, x0 - ox AS tile_x0, y0 - oy AS tile_y0, {six_sql('(x1 - ox) / 25')} AS share_x1, margin, margin < 0 AS truncated, margin >= 0 AND margin < 2 AS near_edge FROM m""", "detections")
def tile_coordinates(spark, sf_dir):
    origin = lambda c: (F.floor(c / 25) * 25).cast("double")
    rows = load(spark, sf_dir, "detections").select("det_id", _box().alias("b"), origin(G.centre_x(_box())).alias("ox"), origin(G.centre_y(_box())).alias("oy"))
    rows = rows.withColumn("t", G.to_tile(F.col("b"), F.col("ox"), F.col("oy"))).withColumn("n", G.normalised(F.col("t"), F.lit(25.0), F.lit(25.0))).withColumn("margin", G.edge_margin(F.col("t"), 25.0, 25.0))
    return rows.select("det_id", F.col("t.x0").alias("tile_x0"), F.col("t.y0").alias("tile_y0"), six("n.x1").alias("share_x1"), "margin", (F.col("margin") < 0).alias("truncated"), ((F.col("margin") >= 0) & (F.col("margin") < 2)).alias("near_edge"))


@query("""AS_ w AS (SELECT *, CASE WHEN x1 > 90 OR y1 > 90 THEN 'outside canvas' WHEN greatest(x1 - x0, y1 - y0) + 4 > 36 THEN 'target too large' ELSE 'ok' END AS status, greatest(0, least(54, (x0 + x1) / 2 - 18)) AS wx, greatest(0, least(54, (y0 + y1) / 2 - 18)) AS wy FROM detections)
SELECT w.det_id, w.status, CASE WHEN w.status = 'ok' THEN wx END AS x, CASE WHEN w.status = 'ok' THEN wy END AS y, (SELECT count(*) FROM detections d WHERE d.frame_id = w.frame_id AND d.det_id <> w.det_id AND w.status = 'ok' AND d.x0 >= wx AND d.y0 >= wy AND d.x1 <= wx + 36 AND d.y1 <= wy + 36) AS neighbours FROM w""", "detections")
def crop_plans(spark, sf_dir):
    rows = load(spark, sf_dir, "detections").select("frame_id", "det_id", _box().alias("b")).withColumn("w", G.crop_window(F.col("b"), 36.0, 90.0, 90.0, 2.0))
    mates = rows.groupBy("frame_id").agg(F.collect_list(F.struct("det_id", "b")).alias("mates"))
    inside = F.filter("mates", lambda m: (m.det_id != F.col("det_id")) & (m.b.x0 >= F.col("w.x")) & (m.b.y0 >= F.col("w.y")) & (m.b.x1 <= F.col("w.x") + 36) & (m.b.y1 <= F.col("w.y") + 36))
    return rows.join(mates, "frame_id").select("det_id", F.col("w.status").alias("status"), F.col("w.x").alias("x"), F.col("w.y").alias("y"), F.size(inside).cast("long").alias("neighbours"))


@query("""SELECT obs_id, CASE WHEN first_conf IS NOT NULL AND second_conf IS NULL AND first_conf BETWEEN 0.1 AND 0.5 THEN 'P2' WHEN first_conf IS NOT NULL AND second_conf IS NULL THEN 'P3' WHEN first_conf IS NOT NULL AND NOT (seen_place AND seen_look) THEN 'P3' WHEN first_conf IS NOT NULL THEN 'P3b' WHEN second_conf < 0.15 THEN 'LOW' WHEN second_conf >= 0.3 AND NOT seen_place THEN 'P1' ELSE 'P3' END AS tier,
greatest(coalesce(first_conf, 0), coalesce(second_conf, 0)) >= 0.15 AS above_floor FROM sourced""", "sourced")
def candidate_tiers(spark, sf_dir):
    return load(spark, sf_dir, "sourced").select("obs_id", R.review_tier(_sources(), F.col("seen_place"), F.col("seen_look"), "first", "second").alias("tier"), R.above_floor(_sources()).alias("above_floor"))


@query("""SELECT camera, array_to_string(list_sort(['camera:' || camera, 'colour:' || least(3, floor(r / (r + g + b + 1e-6) * 4))::BIGINT || least(3, floor(g / (r + g + b + 1e-6) * 4))::BIGINT || least(3, floor(b / (r + g + b + 1e-6) * 4))::BIGINT, 'place:' || floor(least(0.999, (y0 + y1) / 2 / 1080) * 3)::BIGINT || floor(least(0.999, (x0 + x1) / 2 / 1920) * 4)::BIGINT, 'source:' || CASE WHEN first_conf IS NULL THEN 'second_only' WHEN second_conf IS NULL THEN 'first_only' ELSE 'both' END]), ' ') AS buckets, count(*) AS n FROM sourced GROUP BY 1, 2""", "sourced")
def coverage_sets(spark, sf_dir):
    cell = T.grid_cell(G.centre_x(_box()) / 1920, G.centre_y(_box()) / 1080)
    found = R.coverage_set(camera=F.col("camera"), colour=R.colour_bin(F.array("r", "g", "b")), place=cell, source=R.source_label(_sources(), "first", "second"))
    return load(spark, sf_dir, "sourced").groupBy("camera", F.array_join(found, " ").alias("buckets")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN class_id = 0 THEN 'person' WHEN class_id = 2 THEN 'vehicle' ELSE 'ignored' END AS actor, count(*) AS n FROM detections GROUP BY 1", "detections")
def actor_kinds(spark, sf_dir):
    return load(spark, sf_dir, "detections").groupBy(R.actor_kind(F.col("class_id"), (0,), (2,)).alias("actor")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(regexp_full_match(source || '-' || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/x' ELSE repeat('y', CAST(doc_id % 80 AS INT)) END, '[A-Za-z0-9_-]{1,64}'), false) AS safe FROM documents")
def safe_identifiers(spark, sf_dir):
    name = F.expr("source || '-' || cast(doc_id as string) || case doc_id % 3 when 0 then '' when 1 then '/x' else repeat('y', cast(doc_id % 80 as int)) end")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", R.safe_identifier(name).alias("safe"))


@query("SELECT event_id, hour(ts + INTERVAL 8 HOUR) AS local_hour, (epoch_us(ts) // 1000000) % 86400 BETWEEN 21600 AND 36000 AS active FROM events")
def schedule_activity(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    second = F.floor(F.unix_micros(at) / 1000000) % 86400
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.hour(F.from_utc_timestamp(at, "Asia/Shanghai")).cast("long").alias("local_hour"), R.in_schedule(second, F.lit(21600), F.lit(36000)).alias("active"))


@query("SELECT c_custkey, sha256('{\"enabled\":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ',\"name\":\"' || c_name || '\",\"nation\":' || CAST(c_nationkey AS VARCHAR) || '}') AS digest, true AS round_trip FROM customer")
def canonical_options(spark, sf_dir):
    options = F.struct((F.col("c_custkey") % 2 == 0).alias("enabled"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", options.alias("o"), T.canonical(options).alias("j"))
    return rows.select("c_custkey", F.sha2("j", 256).alias("digest"), (F.from_json("j", "enabled boolean, name string, nation long") == F.col("o")).alias("round_trip"))


@query("""AS_ p AS (SELECT *, lag(area) OVER w AS pa, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM snapshots WINDOW w AS (PARTITION BY stream_id ORDER BY tick))
SELECT stream_id, tick, CASE WHEN area - pa >= 0.004 AND visual >= 0.001 THEN 'added' WHEN area - pa <= -0.004 AND visual >= 0.001 THEN 'removed' WHEN sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) >= 0.05 AND greatest(area, pa) > 0 AND visual >= 0.001 THEN 'moved' WHEN visual >= 0.004 THEN 'uncertain' ELSE 'unchanged' END AS change FROM p WHERE pa IS NOT NULL""", "snapshots")
def change_kinds(spark, sf_dir):
    rows = blocks.previous(load(spark, sf_dir, "snapshots"), ["stream_id"], ["tick"], ["area", "cx", "cy"], block=F.floor(F.col("tick") / 24)).where("prev1_area is not null")
    before = F.struct(F.col("prev1_area").alias("area"), F.col("prev1_cx").alias("cx"), F.col("prev1_cy").alias("cy"))
    return rows.withColumn("b", before).withColumn("a", F.struct("area", "cx", "cy", "visual")).select("stream_id", "tick", R.change_kind(F.col("b"), F.col("a"), 0.004).alias("change"))


@query("AS_ g AS (SELECT scene, kind, count(DISTINCT camera * 1000 + CAST(floor(ts_s / 86400) AS BIGINT) % 1000) AS episodes, count(DISTINCT camera) AS cameras FROM sourced GROUP BY 1, 2) SELECT scene, kind, episodes, cameras, CASE WHEN episodes < 20 THEN 'exploratory' WHEN episodes < 50 THEN 'directional' WHEN cameras >= 3 THEN 'stronger' ELSE 'directional' END AS strength FROM g", "sourced")
def evidence_strength(spark, sf_dir):
    out = load(spark, sf_dir, "sourced").groupBy("scene", "kind").agg(F.countDistinct(F.col("camera") * 1000 + F.floor(F.col("ts_s") / 86400) % 1000).alias("episodes"), F.countDistinct("camera").alias("cameras"))
    return out.select("*", R.evidence_strength(F.col("episodes"), F.col("cameras")).alias("strength"))


@query("""AS_ g AS (SELECT device, CAST(count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS DOUBLE) / nullif(count(*) FILTER (WHERE label = 1), 0) AS a, CAST(count(*) FILTER (WHERE label = 1 AND score >= 0.4) AS DOUBLE) / nullif(count(*) FILTER (WHERE label = 1), 0) AS b, 100.0::DOUBLE * count(*) FILTER (WHERE label = 0 AND score >= 0.5) / count(*) AS fa, 100.0::DOUBLE * count(*) FILTER (WHERE label = 0 AND score >= 0.4) / count(*) AS fb FROM scored GROUP BY 1)
SELECT device, CASE WHEN (coalesce(b, 0) - coalesce(a, 0)) * 100.0::DOUBLE < -3.0 OR (fa > 0 AND fb > fa * 2 AND fb - fa > 20) THEN 'regression' WHEN (coalesce(b, 0) - coalesce(a, 0)) * 100.0::DOUBLE >= 10 AND fb <= greatest(fa + 20, fa * 2) THEN 'positive' WHEN (coalesce(b, 0) - coalesce(a, 0)) * 100.0::DOUBLE < 5 THEN 'no change' ELSE 'inconclusive' END AS verdict FROM g""", "scored")
def run_verdicts(spark, sf_dir):
    pos, n = F.col("label") == 1, F.count("*")
    rate = lambda t: F.count_if(pos & (F.col("score") >= t)) / F.nullif(F.count_if(pos), F.lit(0))
    fp = lambda t: 100.0 * F.count_if(~pos & (F.col("score") >= t)) / n
    out = load(spark, sf_dir, "scored").groupBy("device").agg(rate(0.5).alias("a"), rate(0.4).alias("b"), fp(0.5).alias("fa"), fp(0.4).alias("fb"))
    return out.select("device", R.compare_verdict(F.col("b"), F.col("a"), F.col("fb"), F.col("fa")).alias("verdict"))


@query(f"SELECT a.vec_id, {six_sql('list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / len(a.embedding)')} AS difference, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_steps(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    both = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return both.select("vec_id", six(R.mean_difference(F.col("embedding"), F.col("next"), 1.0)).alias("difference"), F.round(R.cosine(F.col("embedding"), F.col("next")), 5).alias("cosine"))


_LIGHT = "f AS (SELECT frame_id, camera, CAST(count(*) FILTER (WHERE abs(gray) >= 0.2) AS DOUBLE) / count(*) AS saturated, quantile_cont(gray, 0.95) - quantile_cont(gray, 0.05) AS extent FROM cells GROUP BY 1, 2), e AS (SELECT *, CASE WHEN saturated >= 0.2 THEN 'glare' WHEN extent < 0.35 THEN 'flat' ELSE 'normal' END AS state FROM f)"


def _light(spark, sf_dir):
    """A frame's cells are bounded by its grid, so a frame is one small group."""
    out = load(spark, sf_dir, "cells").groupBy("frame_id", "camera").agg((F.count_if(F.abs("gray") >= 0.2) / F.count("*")).alias("saturated"), (F.percentile("gray", F.lit(0.95)) - F.percentile("gray", F.lit(0.05))).alias("extent"))
    return out.withColumn("state", R.chain((F.col("saturated") >= 0.2, "glare"), (F.col("extent") < 0.35, "flat"), other="normal"))


@query(f"AS_ {_LIGHT} SELECT frame_id, {six_sql('saturated')} AS saturated, round(extent, 5) AS extent, state FROM e", "cells")
def environment_states(spark, sf_dir):
    return _light(spark, sf_dir).select("frame_id", six("saturated").alias("saturated"), F.round("extent", 5).alias("extent"), "state")


@query(f"AS_ {_LIGHT} SELECT camera, count(*) AS frames, count(*) FILTER (WHERE state = 'normal') AS kept, min(frame_id) FILTER (WHERE state = 'normal') AS first_kept FROM e GROUP BY camera", "cells")
def normal_frames(spark, sf_dir):
    normal = F.col("state") == "normal"
    return _light(spark, sf_dir).groupBy("camera").agg(F.count("*").alias("frames"), F.count_if(normal).alias("kept"), F.min(F.when(normal, F.col("frame_id"))).alias("first_kept"))


@query("AS_ f AS (SELECT frame_id, max(gray) AS hi, min(gray) AS lo, count(*) FILTER (WHERE gray > 0) AS pos, count(*) AS n FROM cells GROUP BY 1) SELECT frame_id, concat_ws(',', CASE WHEN hi - lo < 0.45 THEN 'low contrast' END, CASE WHEN pos * 5 > n * 3 THEN 'bright' END, CASE WHEN pos * 5 < n * 2 THEN 'dark' END) AS faults, hi - lo >= 0.45 AND pos * 5 <= n * 3 AND pos * 5 >= n * 2 AS usable FROM f", "cells")
def frame_quality(spark, sf_dir):
    return samples.frame_faults(load(spark, sf_dir, "cells"), "frame_id", "gray", 0.45, 0.6, 0.4)


@query("SELECT e.event_id, CASE WHEN e.event_id % 5 > 0 THEN epoch_us(o.o_orderdate) + (e.event_id % 400) * 1000000 END AS at_us FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id")
def frame_times(spark, sf_dir):
    starts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("start"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").join(starts, "event_id", "left")
    offset = F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 400)
    return rows.select("event_id", F.unix_micros(T.at_offset(F.col("start"), offset)).alias("at_us"))


@query("SELECT d.source, CASE WHEN l.quality IS NULL OR l.quality <> 1 THEN 'truth not confirmed' WHEN coalesce(d.n_chars, 0) < 40 THEN 'source missing' WHEN l.toxic <> 0 THEN 'not localised' ELSE 'eligible' END AS outcome, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def training_eligibility(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars").join(known, "doc_id", "left")
    outcome = R.eligibility(F.col("quality") == 1, F.coalesce("n_chars", F.lit(0)) >= 40, F.col("toxic") == 0)
    return rows.groupBy("source", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT obs_id, CASE WHEN kind IN ('error', 'purchase') THEN 'hard' WHEN kind = 'click' THEN 'medium' ELSE 'easy' END AS hardness, CASE WHEN scene = 0 THEN 'mined' ELSE 'sampled' END AS origin FROM sourced", "sourced")
def source_tags(spark, sf_dir):
    kind = F.col("kind")
    return load(spark, sf_dir, "sourced").select("obs_id", R.chain((kind.isin("error", "purchase"), "hard"), (kind == "click", "medium"), other="easy").alias("hardness"), R.chain((F.col("scene") == 0, "mined"), other="sampled").alias("origin"))


@query("AS_ r AS (SELECT device, sample_id, row_number() OVER (PARTITION BY device ORDER BY score DESC, sample_id) AS k FROM scored) SELECT device, CASE WHEN k <= 5 THEN 'top' WHEN k <= 50 THEN 'middle' ELSE 'rest' END AS band, count(*) AS n, min(k) AS first_rank FROM r GROUP BY 1, 2", "scored")
def rank_bands(spark, sf_dir):
    ranked = blocks.numbered(load(spark, sf_dir, "scored").select("device", "sample_id", "score"), ["device"], [F.desc("score"), F.col("sample_id")])
    band = R.rank_band(F.col("place"), [("top", 1, 5), ("middle", 6, 50), ("rest", 51, 1 << 62)])
    return ranked.groupBy("device", band.alias("band")).agg(F.count("*").alias("n"), F.min("place").alias("first_rank"))


@query("SELECT det_id, concat_ws(',', CASE WHEN x1 - 25 <= x0 OR y1 - 25 <= y0 THEN 'not ordered' END, CASE WHEN x1 - 25 > 50 OR y1 - 25 > 50 THEN 'outside' END, CASE WHEN least(x1 - x0, y1 - y0) - 25 < 4 THEN 'too small' END) AS faults FROM detections WHERE x1 - 25 <= x0 OR y1 - 25 <= y0 OR x1 - 25 > 50 OR y1 - 25 > 50 OR least(x1 - x0, y1 - y0) - 25 < 4", "detections")
def box_faults(spark, sf_dir):
    shrunk = F.struct("x0", "y0", (F.col("x1") - 25).alias("x1"), (F.col("y1") - 25).alias("y1"))
    return load(spark, sf_dir, "detections").select("det_id", shrunk.alias("b")).select("det_id", F.array_join(R.box_faults(F.col("b"), 50.0, 50.0, 4.0), ",").alias("faults")).where("faults <> ''")


@query(f"""SELECT o.stream_id, z.zone_id, count(*) AS n, count(*) FILTER (WHERE least(o.x1 - o.x0, o.y1 - o.y0) >= CASE z.zone_id WHEN 'left' THEN 0.055 ELSE 0.065 END AND o.conf >= CASE WHEN CAST(floor(o.ts_s / 3600) AS BIGINT) % 24 BETWEEN 6 AND 18 THEN 0.2 ELSE 0.4 END) AS passed
FROM observations o JOIN zones z ON o.stream_id = z.stream_id AND z.kind = 'roi' AND {_INSIDE} GROUP BY 1, 2""", "observations", "zones")
def zone_minimums(spark, sf_dir):
    least = F.when(F.col("zone_id") == "left", 0.055).otherwise(0.065)
    zones = load(spark, sf_dir, "zones").where("kind = 'roi'").select("stream_id", "zone_id", _polygon().alias("polygon"), least.alias("least_side"), F.lit(0.2).alias("day_conf"), F.lit(0.4).alias("night_conf"))
    seen = load(spark, sf_dir, "observations").select("stream_id", _box().alias("b"), "conf", (F.floor(F.col("ts_s") / 3600) % 24).alias("hour"))
    inside = seen.join(zones, "stream_id").where(G.in_polygon(G.centre_x(F.col("b")), F.col("b.y1"), F.col("polygon")))
    conf = F.when(F.col("hour").between(6, 18), F.col("day_conf")).otherwise(F.col("night_conf"))
    return inside.groupBy("stream_id", "zone_id").agg(F.count("*").alias("n"), F.count_if((G.short_side(F.col("b")) >= F.col("least_side")) & (F.col("conf") >= conf)).alias("passed"))
