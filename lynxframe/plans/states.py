"""Registered queries: decisions over time that depend on earlier decisions, with recursive SQL, a row of each key a step."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynxframe.functions import geometry as G
from lynxframe.operators import samples, states
from lynxframe.plans.catalogue import _box, query, six, six_sql
from lynxframe.sources.fixtures import load

_VOTES = """AS_ v AS (SELECT track_id, frame_no, ts_s, 'R' || CAST((frame_no * 7) % 4 AS VARCHAR) AS said FROM observations WHERE frame_no % 11 <> 5), k AS (SELECT *, list(said) OVER (PARTITION BY track_id ORDER BY ts_s, frame_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last FROM v),
u AS (SELECT track_id, frame_no, ts_s, last, unnest(last) AS x, generate_subscripts(last, 1) AS i FROM k), c AS (SELECT track_id, frame_no, ts_s, x, count(*) AS n, min(i) AS i FROM u GROUP BY 1, 2, 3, 4), b AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame_no ORDER BY n DESC, i) AS r FROM c)"""


def _votes(spark, sf_dir):
    rows = load(spark, sf_dir, "observations").withColumn("said", F.when(F.col("frame_no") % 11 != 5, F.concat(F.lit("R"), ((F.col("frame_no") * 7) % 4).cast("string"))))
    return states.majority_votes(rows, ["track_id"], ["ts_s", "frame_no"], "said", 5, 2)


@query(f"{_VOTES} SELECT track_id, frame_no, x AS candidate, n AS votes, n >= 2 AS enough FROM b WHERE r = 1", "observations")
def plate_vote_consensus(spark, sf_dir):
    return _votes(spark, sf_dir).select("track_id", "frame_no", "candidate", F.col("votes").cast("long").alias("votes"), (F.col("votes") >= 2).alias("enough"))


@query(f"{_VOTES} SELECT track_id, frame_no, last_value(CASE WHEN n >= 2 THEN x END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY ts_s, frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS confirmed FROM b WHERE r = 1", "observations")
def sticky_confirmation(spark, sf_dir):
    return _votes(spark, sf_dir).select("track_id", "frame_no", "confirmed")


@query("""AS_ r AS (SELECT stream_id, frame_no, ts_s, row_number() OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS k FROM observations),
w AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_no, CAST([] AS DOUBLE[]) AS times, false AS accepted FROM (SELECT DISTINCT stream_id FROM r)
UNION ALL SELECT w.stream_id, r.k, r.frame_no, CASE WHEN o.free THEN list_append(o.kept, r.ts_s) ELSE o.kept END, o.free FROM w JOIN r ON r.stream_id = w.stream_id AND r.k = w.k + 1,
LATERAL (SELECT list_filter(w.times, lambda t: t > r.ts_s - 21600) AS kept, len(list_filter(w.times, lambda t: t > r.ts_s - 21600)) < 3 AND (len(list_filter(w.times, lambda t: t > r.ts_s - 21600)) = 0 OR r.ts_s - list_last(w.times) >= 1800) AS free) o)
SELECT stream_id, frame_no, accepted FROM w WHERE k > 0""", "observations")
def hourly_budget(spark, sf_dir):
    out = states.hourly_budget(load(spark, sf_dir, "observations"), "stream_id", ["ts_s", "frame_no"], most=3, interval=1800.0, window=21600.0)
    return out.select("stream_id", "frame_no", "accepted")


_KIND = "CASE WHEN n.area - s.area >= 0.004 AND n.visual >= 0.001 THEN 'added' WHEN n.area - s.area <= -0.004 AND n.visual >= 0.001 THEN 'removed' WHEN sqrt((n.cx - s.cx) * (n.cx - s.cx) + (n.cy - s.cy) * (n.cy - s.cy)) >= 0.05 AND greatest(n.area, s.area) > 0 AND n.visual >= 0.001 THEN 'moved' WHEN n.visual >= 0.002 THEN 'uncertain' ELSE 'unchanged' END"


@query(f"""AS_ n0 AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY tick) AS k FROM snapshots),
s AS (SELECT stream_id, k, tick, tick AS began, area, cx, cy, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS BIGINT) AS since, 'baseline' AS kind, 0.0::DOUBLE AS elapsed, false AS emitted FROM n0 WHERE k = 1
UNION ALL SELECT n.stream_id, n.k, n.tick, s.began, CASE WHEN o.moves THEN n.area ELSE s.area END, CASE WHEN o.moves THEN n.cx ELSE s.cx END, CASE WHEN o.moves THEN n.cy ELSE s.cy END, CASE WHEN o.moves OR o.kind = 'warm-up' THEN NULL ELSE o.kind END, CASE WHEN o.moves OR o.kind = 'warm-up' THEN NULL ELSE o.since END, o.kind, o.elapsed, o.emitted
FROM s JOIN n0 n ON n.stream_id = s.stream_id AND n.k = s.k + 1,
LATERAL (SELECT CASE WHEN n.tick - s.began < 3 THEN 'warm-up' ELSE {_KIND} END AS kind) a,
LATERAL (SELECT CASE WHEN a.kind = s.held THEN s.since ELSE n.tick END AS since) b,
LATERAL (SELECT a.kind, b.since, CASE WHEN a.kind IN ('warm-up', 'unchanged') THEN 0.0 ELSE n.tick - b.since END::DOUBLE AS elapsed, a.kind NOT IN ('warm-up', 'unchanged') AND n.tick - b.since >= 2 AS emitted,
a.kind = 'unchanged' OR (a.kind = 'warm-up' AND n.area >= s.area) OR (a.kind NOT IN ('warm-up', 'unchanged') AND n.tick - b.since >= 2) AS moves) o)
SELECT stream_id, tick, kind, elapsed, emitted FROM s""", "snapshots")
def persistent_changes(spark, sf_dir):
    return states.persistent_changes(load(spark, sf_dir, "snapshots"), "stream_id", "tick", states.change_of(0.004, uncertain=0.002), hold=2, warm_up=3)


@query("""AS_ o AS (SELECT track_id, frame_no, ts_s, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY track_id ORDER BY ts_s, frame_no) AS k FROM observations),
s AS (SELECT track_id, k, frame_no, cx AS sx, cy AS sy, NULL::DOUBLE AS hx, NULL::DOUBLE AS hy, NULL::DOUBLE AS last, CAST([] AS DOUBLE[]) AS times FROM o WHERE k = 1
UNION ALL SELECT n.track_id, n.k, n.frame_no, CASE WHEN a.steps THEN n.cx ELSE s.sx END, CASE WHEN a.steps THEN n.cy ELSE s.sy END, CASE WHEN a.steps AND (s.hx IS NULL OR c.turns OR b.angle <= 45) THEN n.cx - s.sx ELSE s.hx END, CASE WHEN a.steps AND (s.hx IS NULL OR c.turns OR b.angle <= 45) THEN n.cy - s.sy ELSE s.hy END, CASE WHEN c.turns THEN n.ts_s ELSE s.last END, list_filter(CASE WHEN c.turns THEN list_append(s.times, n.ts_s) ELSE s.times END, lambda t: t >= n.ts_s - 604800)
FROM s JOIN o n ON n.track_id = s.track_id AND n.k = s.k + 1,
LATERAL (SELECT sqrt((n.cx - s.sx) * (n.cx - s.sx) + (n.cy - s.sy) * (n.cy - s.sy)) >= 0.5 * 0.2 AS steps) a,
LATERAL (SELECT degrees(acos(greatest(-1, least(1, (s.hx * (n.cx - s.sx) + s.hy * (n.cy - s.sy)) / (sqrt(s.hx * s.hx + s.hy * s.hy) * sqrt((n.cx - s.sx) * (n.cx - s.sx) + (n.cy - s.sy) * (n.cy - s.sy))))))) AS angle) b,
LATERAL (SELECT coalesce(a.steps AND s.hx IS NOT NULL AND b.angle >= 120 AND (s.last IS NULL OR n.ts_s - s.last >= 3600), false) AS turns) c)
SELECT track_id, frame_no, CAST(len(times) AS BIGINT) AS reversals FROM s""", "observations")
def heading_reversals(spark, sf_dir):
    rows = load(spark, sf_dir, "observations").select("track_id", "ts_s", "frame_no", G.centre_x(_box()).alias("cx"), G.centre_y(_box()).alias("cy"), F.lit(0.2).alias("scale"))
    return states.reversals(rows, ["track_id"], ["ts_s", "frame_no"], 120.0, 0.5, 3600.0, 604800.0).select("track_id", "frame_no", "reversals")


@query(f"""AS_ o AS (SELECT track_id, frame_no, ts_s, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY track_id ORDER BY ts_s, frame_no) AS k FROM observations),
s AS (SELECT track_id, k, frame_no, ts_s, cx, cy, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM o WHERE k = 1 UNION ALL SELECT n.track_id, n.k, n.frame_no, n.ts_s, n.cx, n.cy, CASE WHEN n.ts_s > s.ts_s THEN 0.7::DOUBLE * s.vx + (1 - 0.7::DOUBLE) * ((n.cx - s.cx) / (n.ts_s - s.ts_s)) ELSE s.vx END, CASE WHEN n.ts_s > s.ts_s THEN 0.7::DOUBLE * s.vy + (1 - 0.7::DOUBLE) * ((n.cy - s.cy) / (n.ts_s - s.ts_s)) ELSE s.vy END FROM s JOIN o n ON n.track_id = s.track_id AND n.k = s.k + 1)
SELECT track_id, frame_no, {six_sql("vx * 3600")} AS vx, {six_sql("vy * 3600")} AS vy FROM s""", "observations")
def smoothed_velocity(spark, sf_dir):
    rows = load(spark, sf_dir, "observations").select("track_id", "ts_s", "frame_no", G.centre_x(_box()).alias("cx"), G.centre_y(_box()).alias("cy"))
    out = states.ewma_velocity(rows, ["track_id"], ["ts_s", "frame_no"], 0.7)
    return out.select("track_id", "frame_no", six(F.col("vx") * 3600).alias("vx"), six(F.col("vy") * 3600).alias("vy"))


@query("""AS_ o AS (SELECT camera, obs_id, ts_s, row_number() OVER (PARTITION BY camera ORDER BY ts_s, obs_id) AS k FROM sourced),
s AS (SELECT camera, k, obs_id, ts_s AS anchor FROM o WHERE k = 1 UNION ALL SELECT n.camera, n.k, n.obs_id, CASE WHEN n.ts_s - s.anchor > 7200 THEN n.ts_s ELSE s.anchor END FROM s JOIN o n ON n.camera = s.camera AND n.k = s.k + 1) SELECT camera, obs_id, anchor FROM s""", "sourced")
def same_instant_groups(spark, sf_dir):
    return states.anchored_groups(load(spark, sf_dir, "sourced"), ["camera"], ["ts_s", "obs_id"], 7200.0).select("camera", "obs_id", "anchor")


@query("""AS_ o AS (SELECT camera, obs_id, ts_s, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY camera ORDER BY ts_s, obs_id) AS k FROM sourced),
s AS (SELECT camera, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS obs_id, NULL::BIGINT AS cluster, CAST([] AS STRUCT(t DOUBLE, id BIGINT, x DOUBLE, y DOUBLE)[]) AS live FROM (SELECT DISTINCT camera FROM o)
UNION ALL SELECT n.camera, n.k, n.obs_id, coalesce(a.hit.id, n.obs_id), CASE WHEN a.hit IS NULL THEN list_append(a.live, {'t': n.ts_s, 'id': n.obs_id, 'x': n.cx, 'y': n.cy}) ELSE a.live END FROM s JOIN o n ON n.camera = s.camera AND n.k = s.k + 1,
LATERAL (SELECT list_filter(s.live, lambda c: n.ts_s - c.t <= 86400) AS live, list_filter(s.live, lambda c: n.ts_s - c.t <= 86400 AND sqrt((n.cx - c.x) * (n.cx - c.x) + (n.cy - c.y) * (n.cy - c.y)) <= 250)[1] AS hit) a)
SELECT camera, obs_id, cluster FROM s WHERE k > 0""", "sourced")
def near_duplicate_clusters(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").select("camera", "ts_s", "obs_id", G.centre_x(_box()).alias("cx"), G.centre_y(_box()).alias("cy"))
    return states.first_sighting_clusters(rows, "camera", ["ts_s", "obs_id"], 250.0, 86400.0).select("camera", "obs_id", "cluster")


_PLACED = "sqrt(power((m.x0 + m.x1 - n.x0 - n.x1) / 2, 2) + power((m.y0 + m.y1 - n.y0 - n.y1) / 2, 2))"
_DIAG = ("sqrt((m.x1 - m.x0) * (m.x1 - m.x0) + (m.y1 - m.y0) * (m.y1 - m.y0))", "sqrt((n.x1 - n.x0) * (n.x1 - n.x0) + (n.y1 - n.y0) * (n.y1 - n.y0))")


@query(f"""AS_ o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY camera, scene ORDER BY ts_s, obs_id) AS k FROM sourced WHERE kind <> 'error'),
f AS MATERIALIZED (SELECT n.obs_id AS a, m.obs_id AS b FROM o n JOIN o m ON n.camera = m.camera AND n.scene = m.scene AND m.k < n.k AND n.ts_s - m.ts_s <= 172800 AND {_PLACED} <= greatest(400, 0.75 * ({_DIAG[0]} + {_DIAG[1]}) / 2) AND greatest({_DIAG[0]}, {_DIAG[1]}) <= 3 * least({_DIAG[0]}, {_DIAG[1]})),
p AS MATERIALIZED (SELECT a, list(b) AS fits FROM f GROUP BY a), g AS (SELECT camera, scene, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS obs_id, NULL::BIGINT AS episode, CAST([] AS STRUCT(id BIGINT, t DOUBLE, members BIGINT[])[]) AS made FROM (SELECT DISTINCT camera, scene FROM o)
UNION ALL SELECT n.camera, n.scene, n.k, n.obs_id, coalesce(h.hit, n.obs_id), CASE WHEN h.hit IS NULL THEN list_append(h.live, {{'id': n.obs_id, 't': n.ts_s, 'members': [n.obs_id]}}) ELSE list_transform(h.live, lambda x: CASE WHEN x.id = h.hit THEN {{'id': x.id, 't': x.t, 'members': list_append(x.members, n.obs_id)}} ELSE x END) END
FROM g JOIN o n ON n.camera = g.camera AND n.scene = g.scene AND n.k = g.k + 1 LEFT JOIN p ON p.a = n.obs_id,
LATERAL (SELECT list_filter(g.made, lambda x: n.ts_s - x.t <= 172800) AS live, list_filter(g.made, lambda x: len(list_filter(x.members, lambda y: NOT list_contains(coalesce(p.fits, CAST([] AS BIGINT[])), y))) = 0)[1].id AS hit) h)
SELECT camera, scene, obs_id, episode FROM g WHERE k > 0""", "sourced")
def episode_candidates(spark, sf_dir):
    rows = load(spark, sf_dir, "sourced").where("kind <> 'error'")
    return states.complete_linkage(rows, ["camera", "scene"], ["ts_s", "obs_id"], 172800.0, 400.0, 0.75, 3.0).select("camera", "scene", "obs_id", "episode")


_NEAR = "sqrt((t.cx - e.x) * (t.cx - e.x) + (t.cy - e.y) * (t.cy - e.y))"
_MOVED = "greatest(e.moved, sqrt((t.cx - e.fx) * (t.cx - e.fx) + (t.cy - e.fy) * (t.cy - e.fy)))"
_SURE = f"NOT e.done AND t.ts_s - e.first >= 7200 AND e.hits + 1 >= 3 AND {_MOVED} <= 0.2"


@query(f"""AS_ t AS MATERIALIZED (SELECT stream_id, frame_no, ts_s, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS k FROM observations WHERE conf >= 0.2),
m AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS ts_s, CAST(NULL AS BIGINT) AS frame_no, CAST([] AS STRUCT(id BIGINT, first DOUBLE, fx DOUBLE, fy DOUBLE, hits BIGINT, done BOOLEAN, moved DOUBLE, seen DOUBLE, x DOUBLE, y DOUBLE)[]) AS live, CAST(NULL AS BIGINT) AS object, CAST(0 AS BIGINT) AS hits, false AS confirmed FROM (SELECT DISTINCT stream_id FROM t)
UNION ALL SELECT m.stream_id, t.k, t.ts_s, t.frame_no, CASE WHEN b.id IS NULL THEN list_append(a.live, {{'id': t.frame_no, 'first': t.ts_s, 'fx': t.cx, 'fy': t.cy, 'hits': 1, 'done': false, 'moved': 0.0, 'seen': t.ts_s, 'x': t.cx, 'y': t.cy}}) ELSE list_transform(a.live, lambda e: CASE WHEN e.id = b.id THEN {{'id': e.id, 'first': e.first, 'fx': e.fx, 'fy': e.fy, 'hits': e.hits + 1, 'done': e.done OR ({_SURE}), 'moved': {_MOVED}, 'seen': t.ts_s, 'x': t.cx, 'y': t.cy}} ELSE e END) END,
coalesce(b.id, t.frame_no), coalesce(list_filter(a.live, lambda e: e.id = b.id)[1].hits, 0) + 1, coalesce(list_transform(list_filter(a.live, lambda e: e.id = b.id), lambda e: {_SURE})[1], false)
FROM m JOIN t ON t.stream_id = m.stream_id AND t.k = m.k + 1, LATERAL (SELECT list_filter(m.live, lambda e: t.ts_s - e.seen <= 43200) AS live) a, LATERAL (SELECT list_filter(list_sort(list_transform(a.live, lambda e, i: {{'d': {_NEAR}, 'i': i, 'id': e.id}}))[1:1], lambda x: x.d <= 0.12)[1].id AS id) b)
SELECT stream_id, ts_s, frame_no, object, hits, confirmed FROM m WHERE k > 0""", "observations")
def ground_candidates(spark, sf_dir):
    rows = load(spark, sf_dir, "observations").where("conf >= 0.2").select("stream_id", "ts_s", "frame_no", G.centre_x(_box()).alias("cx"), G.centre_y(_box()).alias("cy"))
    return states.ground_tracks(rows, "stream_id", ["ts_s", "frame_no"], lost=43200.0, near=0.12, hold=7200.0, least_hits=3, most_motion=0.2).drop("session")


_DX, _DY = "(t.x0 + t.x1 - e.x0 - e.x1) / 2", "(t.y0 + t.y1 - e.y0 - e.y1) / 2"
_W, _H, _U, _V = "(t.x1 - t.x0)", "(t.y1 - t.y0)", "(e.x1 - e.x0)", "(e.y1 - e.y0)"
_THERE = f"greatest({_W} / {_U}, {_U} / {_W}, {_H} / {_V}, {_V} / {_H}) <= 3 AND power({_DX} / least({_W}, {_U}), 2) + power({_DY} / least({_H}, {_V}), 2) <= 0.25"
_SINCE = "CASE WHEN e.last IS NULL OR t.ts_s - e.last > 604800 THEN t.ts_s ELSE e.since END"
_ITEM = "STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, since DOUBLE, last DOUBLE)"


@query(f"""AS_ t AS MATERIALIZED (SELECT stream_id, frame_no, ts_s, x0, y0, x1, y1, kind IN ('error', 'view') AS clean, row_number() OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS k FROM observations),
m AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS ts_s, CAST(NULL AS BIGINT) AS frame_no, CAST([] AS {_ITEM}[]) AS items, CAST(NULL AS BIGINT) AS item, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT stream_id FROM t)
UNION ALL SELECT m.stream_id, t.k, t.ts_s, t.frame_no, CASE c.outcome WHEN 'no item' THEN m.items WHEN 'created' THEN list_append(m.items, {{'id': t.frame_no, 'x0': t.x0, 'y0': t.y0, 'x1': t.x1, 'y1': t.y1, 'since': CAST(NULL AS DOUBLE), 'last': CAST(NULL AS DOUBLE)}}) WHEN 'cleared' THEN list_filter(m.items, lambda e: e.id <> b.id)
ELSE list_transform(m.items, lambda e: CASE WHEN e.id = b.id THEN {{'id': e.id, 'x0': e.x0, 'y0': e.y0, 'x1': e.x1, 'y1': e.y1, 'since': CASE WHEN t.clean THEN {_SINCE} END, 'last': CASE WHEN t.clean THEN t.ts_s END}} ELSE e END) END, CASE WHEN c.outcome = 'created' THEN t.frame_no ELSE b.id END, c.outcome
FROM m JOIN t ON t.stream_id = m.stream_id AND t.k = m.k + 1,
LATERAL (SELECT list_sort(list_filter(list_transform(m.items, lambda e, i: {{'d': {_DX} * {_DX} + {_DY} * {_DY}, 'i': i, 'id': e.id, 'ok': {_THERE}}}), lambda x: x.ok))[1].id AS id) b,
LATERAL (SELECT CASE WHEN b.id IS NULL THEN CASE WHEN t.clean THEN 'no item' ELSE 'created' END WHEN NOT t.clean THEN 'present' WHEN list_transform(list_filter(m.items, lambda e: e.id = b.id), lambda e: t.ts_s - ({_SINCE}))[1] >= 86400 THEN 'cleared' ELSE 'verifying' END AS outcome) c)
SELECT stream_id, ts_s, frame_no, item, outcome FROM m WHERE k > 0""", "observations")
def item_inventory(spark, sf_dir):
    rows = load(spark, sf_dir, "observations").withColumn("clean", F.col("kind").isin("error", "view"))
    return states.inventory(rows, "stream_id", ["ts_s", "frame_no"], clear_after=86400.0, most_gap=604800.0)


_LEDGER = "STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, since DOUBLE, last DOUBLE, state VARCHAR, said VARCHAR)"
_CLEAN = _THERE.replace("t.x0", "t.cx0").replace("t.x1", "t.cx1").replace("t.y0", "t.cy0").replace("t.y1", "t.cy1")
_AGAIN = "CASE WHEN e.last IS NULL OR t.ts_s - e.last > 259200 THEN t.ts_s ELSE e.since END"


@query(f"""AS_ t AS MATERIALIZED (SELECT stream_id, view, ts_s, by_scan AS shows, has_actor OR has_residue OR frame_no % 3 = 0 AS empties, judged AS observable, sx0 AS x0, sy0 AS y0, sx1 AS x1, sy1 AS y1, ax0 AS cx0, 32.0::DOUBLE AS cy0, ax0 + 24 AS cx1, 56.0::DOUBLE AS cy1, row_number() OVER (PARTITION BY stream_id, view ORDER BY ts_s, frame_no) AS k FROM view_ticks),
m AS (SELECT stream_id, view, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS ts_s, CAST(1 AS BIGINT) AS nxt, CAST([] AS {_LEDGER}[]) AS items FROM (SELECT DISTINCT stream_id, view FROM t)
UNION ALL SELECT m.stream_id, m.view, t.k, t.ts_s, m.nxt + CASE WHEN a.here AND b.id IS NULL THEN 1 ELSE 0 END, list_transform(CASE WHEN a.here AND b.id IS NULL THEN list_append(a.items, {{'id': m.nxt, 'x0': t.x0, 'y0': t.y0, 'x1': t.x1, 'y1': t.y1, 'since': NULL, 'last': NULL, 'state': NULL, 'said': NULL}}) ELSE a.items END,
lambda e: {{'id': e.id, 'x0': e.x0, 'y0': e.y0, 'x1': e.x1, 'y1': e.y1, 'since': CASE WHEN a.here AND e.id = coalesce(b.id, m.nxt) THEN NULL WHEN a.gone AND {_CLEAN} THEN {_AGAIN} END, 'last': CASE WHEN a.here AND e.id = coalesce(b.id, m.nxt) THEN NULL WHEN a.gone AND {_CLEAN} THEN t.ts_s END,
'state': CASE WHEN a.here AND e.id = coalesce(b.id, m.nxt) THEN 'present' WHEN a.gone AND {_CLEAN} THEN CASE WHEN t.ts_s - ({_AGAIN}) >= 172800 THEN 'cleared' ELSE 'verifying' END ELSE 'unobserved' END, 'said': e.state}})
FROM m JOIN t ON t.stream_id = m.stream_id AND t.view = m.view AND t.k = m.k + 1,
LATERAL (SELECT t.observable AND t.shows AS here, t.observable AND t.empties AS gone, list_filter(m.items, lambda e: e.state <> 'cleared') AS items) a,
LATERAL (SELECT list_sort(list_filter(list_transform(a.items, lambda e: {{'d': {_DX} * {_DX} + {_DY} * {_DY}, 'id': e.id, 'ok': a.here AND {_THERE}}}), lambda x: x.ok))[1].id AS id) b),
o AS (SELECT stream_id, view, ts_s, unnest(items) AS e FROM m) SELECT stream_id, view, round(ts_s, 3) AS ts_s, e.id AS item, e.state FROM o WHERE e.state IS DISTINCT FROM e.said""", "view_ticks")
def item_ledger(spark, sf_dir):
    rows = load(spark, sf_dir, "view_ticks")
    box = lambda *sides: F.array(F.struct(*[c.alias(n) for c, n in zip(sides, ("x0", "y0", "x1", "y1"), strict=True)]))
    seen = F.when(F.col("by_scan"), box(*[F.col(f"s{c}") for c in ("x0", "y0", "x1", "y1")]))
    clean = F.when(F.col("has_actor") | F.col("has_residue") | (F.col("frame_no") % 3 == 0), box(F.col("ax0"), F.lit(32.0), F.col("ax0") + 24, F.lit(56.0)))
    ticks = rows.select("stream_id", "view", "ts_s", "frame_no", F.col("judged").alias("observable"), seen.alias("seen"), clean.alias("clean"))
    return states.item_ledger(ticks, ["stream_id", "view"], "frame_no", clear_after=172800.0, most_gap=259200.0).withColumn("ts_s", F.round("ts_s", 3))


_ABOUT = "tick % 7 = 0"


@query(f"""AS_ n0 AS MATERIALIZED (SELECT *, CASE WHEN {_ABOUT} THEN [tick % 5, 9] ELSE CAST([] AS BIGINT[]) END AS about, row_number() OVER (PARTITION BY stream_id ORDER BY tick) AS k FROM snapshots),
s AS (SELECT stream_id, k, tick, tick AS began, area, cx, cy, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS BIGINT) AS since, about AS known, CASE WHEN len(about) > 0 THEN tick END AS last, 'baseline' AS kind, 0.0::DOUBLE AS elapsed, false AS emitted, CAST([] AS BIGINT[]) AS actors FROM n0 WHERE k = 1
UNION ALL SELECT n.stream_id, n.k, n.tick, s.began, CASE WHEN o.moves THEN n.area ELSE s.area END, CASE WHEN o.moves THEN n.cx ELSE s.cx END, CASE WHEN o.moves THEN n.cy ELSE s.cy END, CASE WHEN o.says IN ('warm-up', 'observing') THEN s.held WHEN o.emits OR o.says = 'unchanged' THEN NULL ELSE o.says END, CASE WHEN o.says IN ('warm-up', 'observing') THEN s.since WHEN o.emits OR o.says = 'unchanged' THEN NULL ELSE o.since END,
CASE WHEN o.emits THEN CAST([] AS BIGINT[]) ELSE b.known END, CASE WHEN NOT o.emits THEN b.last END, o.says, CASE WHEN o.says = 'observing' THEN n.tick - b.last WHEN o.says IN ('warm-up', 'unchanged') THEN 0 ELSE n.tick - o.since END, o.emits, CASE WHEN o.emits THEN list_sort(b.known) ELSE CAST([] AS BIGINT[]) END
FROM s JOIN n0 n ON n.stream_id = s.stream_id AND n.k = s.k + 1,
LATERAL (SELECT list_distinct(list_concat(s.known, n.about)) AS known, CASE WHEN len(n.about) > 0 THEN n.tick ELSE s.last END AS last, n.tick - s.began < 3 AS warm) a,
LATERAL (SELECT NOT a.warm AND a.last IS NOT NULL AND n.tick - a.last < 2 AS waits, CASE WHEN NOT a.warm AND n.tick - a.last > 5 THEN CAST([] AS BIGINT[]) ELSE a.known END AS known, CASE WHEN NOT a.warm AND n.tick - a.last > 5 THEN NULL ELSE a.last END AS last) b,
LATERAL (SELECT CASE WHEN a.warm THEN 'warm-up' WHEN b.waits THEN 'observing' ELSE {_KIND} END AS says) c,
LATERAL (SELECT c.says, CASE WHEN c.says = s.held THEN s.since ELSE n.tick END AS since, c.says NOT IN ('warm-up', 'observing', 'unchanged') AND n.tick - CASE WHEN c.says = s.held THEN s.since ELSE n.tick END >= 2 AS emits) d,
LATERAL (SELECT d.says, d.since, d.emits, d.emits OR (d.says = 'unchanged' AND len(b.known) = 0) OR (d.says = 'warm-up' AND n.area >= s.area) AS moves) o)
SELECT stream_id, tick, kind, elapsed, emitted, array_to_string(actors, ',') AS actors FROM s""", "snapshots")
def attended_changes(spark, sf_dir):
    about = F.when(F.expr(_ABOUT), F.array(F.col("tick") % 5, F.lit(9).cast("bigint")))
    rows = load(spark, sf_dir, "snapshots").withColumn("actors", about)
    out = states.attended_changes(rows, "stream_id", "tick", states.change_of(0.004, uncertain=0.002), hold=2, warm_up=3, grace=2, memory=5)
    return out.withColumn("actors", F.array_join(F.col("actors").cast("array<string>"), ","))


@query("AS_ p AS (SELECT stream_id, ts_s - lag(ts_s) OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS gap, kind FROM observations) SELECT stream_id, count(*) AS frames, count(*) FILTER (WHERE kind = 'error') AS corrupt, count(*) FILTER (WHERE gap > 7200) AS long_gaps, round(max(gap), 3) AS max_gap_s FROM p GROUP BY stream_id", "observations")
def live_counters(spark, sf_dir):
    rows = load(spark, sf_dir, "observations").select("stream_id", "ts_s", "frame_no", "kind")
    return samples.live_counters(rows, "stream_id", ["ts_s", "frame_no"], F.col("kind") == "error", 7200).withColumn("max_gap_s", F.round("max_gap_s", 3))
