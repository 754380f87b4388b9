"""Registered queries: rescued candidates, episodes, phases of scenes and consensus of samples, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynxframe.operators import frames, scenes, tracking
from lynxframe.plans.catalogue import _IOU, _UNION, query, six, six_sql
from lynxframe.sources.fixtures import load

_DAY = 86400.0
RESCUE = scenes.Rescue(ttl=1.5 * _DAY, least_hits=2, most_tracks=3)
_CANDIDATES = "c AS MATERIALIZED (SELECT stream_id, floor(ts_s / 21600) * 21600 AS ts_s, frame_no AS cand_id, CAST((frame_no * 31) % 100 AS DOUBLE) / 100 AS score, frame_no % 5 = 0 AS passed, sx0 AS x0, sy0 AS y0, sx1 AS x1, sy1 AS y1 FROM view_ticks)"


def _candidates(spark, sf_dir):
    rows = load(spark, sf_dir, "view_ticks")
    return rows.select("stream_id", (F.floor(F.col("ts_s") / 21600) * 21600).cast("double").alias("ts_s"), F.col("frame_no").alias("cand_id"), ((F.col("frame_no") * 31) % 100 / 100).alias("score"), (F.col("frame_no") % 5 == 0).alias("passed"), *[F.col(f"s{s}").alias(s) for s in scenes.SIDES])


def _area(b: str) -> str:
    return f"((({b}).x1 - ({b}).x0) * (({b}).y1 - ({b}).y0))"


def _far(a: str, b: str) -> str:
    return f"sqrt((({a}.x0 + {a}.x1 - {b}.x0 - {b}.x1) / 2) * (({a}.x0 + {a}.x1 - {b}.x0 - {b}.x1) / 2) + (({a}.y0 + {a}.y1 - {b}.y0 - {b}.y1) / 2) * (({a}.y0 + {a}.y1 - {b}.y0 - {b}.y1) / 2))"


def _over(a: str, b: str) -> str:
    return (_IOU + " / " + _UNION).replace("a.", "\0").replace("b.", f"{b}.").replace("\0", f"{a}.")


def _same(a: str, b: str, r: scenes.Rescue) -> str:
    diagonal = lambda x: f"sqrt(({x}.x1 - {x}.x0) * ({x}.x1 - {x}.x0) + ({x}.y1 - {x}.y0) * ({x}.y1 - {x}.y0))"
    return f"({_over(a, b)} >= {r.least_iou} OR (least({_area(a)}, {_area(b)}) / greatest({_area(a)}, {_area(b)}) >= {r.least_ratio} AND {_far(a, b)} <= {r.most_distance} * greatest({diagonal(a)}, {diagonal(b)})))"


_AT_ONCE = f"r AS MATERIALIZED (SELECT a.stream_id, a.ts_s, a.cand_id, min(b.cand_id) AS other FROM c a JOIN c b ON a.stream_id = b.stream_id AND a.ts_s = b.ts_s AND NOT a.passed AND b.passed AND {_same('a', 'b', RESCUE)} GROUP BY ALL)"


@query(f"AS_ {_CANDIDATES}, {_AT_ONCE} SELECT r.stream_id, r.cand_id, r.other, greatest(a.score, b.score) AS score, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1 FROM r JOIN c a ON a.cand_id = r.cand_id JOIN c b ON b.cand_id = r.other", "view_ticks")
def rescued_at_once(spark, sf_dir):
    return scenes.rescued_at_once(_candidates(spark, sf_dir), "stream_id", RESCUE).drop("ts_s")


_TRACK = "STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, seen DOUBLE, hits BIGINT, best DOUBLE, taken BOOLEAN)"


def _track(**new: str) -> str:
    fields = [f.split() for f in _TRACK[7:-1].split(", ")]
    return "{" + ", ".join(f"'{f}': CAST({new.get(f, 'e.' + f)} AS {kind})" for f, kind in fields) + "}"


_BOX = {s: f"t.{s}" for s in scenes.SIDES}
_FULL = f"e.taken OR (e.hits >= {RESCUE.least_hits} AND e.best >= {RESCUE.least_score})"


@query(f"""AS_ {_CANDIDATES}, {_AT_ONCE}, t AS MATERIALIZED (SELECT c.*, row_number() OVER (PARTITION BY stream_id ORDER BY ts_s, score DESC, cand_id) AS k FROM c WHERE NOT passed AND cand_id NOT IN (SELECT cand_id FROM r)),
m AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS at, CAST([] AS BIGINT[]) AS used, CAST([] AS {_TRACK}[]) AS tracks, CAST(NULL AS BIGINT) AS cand_id, CAST(NULL AS BIGINT) AS track, CAST(0 AS BIGINT) AS hits, false AS rescued, false AS active, false AS evicted FROM (SELECT DISTINCT stream_id FROM t)
UNION ALL SELECT m.stream_id, t.k, t.ts_s, list_append(a.used, d.track.id), list_transform(c2.tracks, lambda e: CASE WHEN e.id = b.id THEN {_track(taken=_FULL)} ELSE e END), t.cand_id, d.track.id, d.track.hits, list_transform([d.track], lambda e: ({_FULL}) AND NOT e.taken)[1], list_transform([d.track], lambda e: {_FULL})[1], b.id = t.cand_id AND b.full_
FROM m JOIN t ON t.stream_id = m.stream_id AND t.k = m.k + 1,
LATERAL (SELECT CASE WHEN t.ts_s = m.at THEN m.used ELSE CAST([] AS BIGINT[]) END AS used, CASE WHEN t.ts_s = m.at THEN m.tracks ELSE list_filter(m.tracks, lambda e: t.ts_s - e.seen <= {RESCUE.ttl}) END AS live) a,
LATERAL (SELECT coalesce(list_sort(list_transform(list_filter(list_transform(a.live, lambda e, i: {{'e': e, 'i': i}}), lambda x: NOT list_contains(a.used, x.e.id) AND {_same('x.e', 't', RESCUE)}), lambda x: {{'o': -({_over('x.e', 't')}), 'd': {_far('x.e', 't')}, 'i': x.i, 'id': x.e.id}}))[1].id, t.cand_id) AS id, len(a.live) >= {RESCUE.most_tracks} AS full_) b,
LATERAL (SELECT CASE WHEN b.id = t.cand_id AND b.full_ THEN list_filter(a.live, lambda e, i: i <> list_sort(list_transform(a.live, lambda f, j: {{'s': f.seen, 'h': f.hits, 'j': j}}))[1].j) ELSE a.live END AS live) c1,
LATERAL (SELECT CASE WHEN b.id = t.cand_id THEN list_append(c1.live, {_track(id="t.cand_id", seen="t.ts_s", hits="1", best="t.score", taken="false", **_BOX)}) ELSE list_transform(c1.live, lambda e: CASE WHEN e.id = b.id THEN {_track(seen="t.ts_s", hits="e.hits + 1", best="greatest(e.best, t.score)", **_BOX)} ELSE e END) END AS tracks) c2,
LATERAL (SELECT list_filter(c2.tracks, lambda e: e.id = b.id)[1] AS track) d)
SELECT stream_id, cand_id, track, hits, rescued, active, evicted FROM m WHERE k > 0""", "view_ticks")
def rescued_in_time(spark, sf_dir):
    return scenes.rescued_in_time(_candidates(spark, sf_dir), "stream_id", RESCUE).drop("ts_s")


EPISODES = scenes.Episodes(dense=0.5 * _DAY, coarse=1.5 * _DAY)


def _episodes_sql(r: scenes.Episodes) -> str:
    kind = "STRUCT(id BIGINT, ended DOUBLE, dense BOOLEAN, boxes DOUBLE[][], x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)"
    scale, low, high = r.radius
    radius = f"greatest({low}, least({high}, {scale} * sqrt((e.x1 - e.x0) * (e.y1 - e.y0))))"
    fits = lambda a, b: f"abs(t.{b} - t.{a}) / abs(e.{b} - e.{a}) BETWEEN {1 / r.most_ratio!r} AND {r.most_ratio}"
    near = f"t.ts_s - e.ended <= CASE WHEN t.dense AND e.dense THEN {r.dense} ELSE {r.coarse} END AND {fits('x0', 'x1')} AND {fits('y0', 'y1')} AND ({_far('e', 't')} <= {radius} OR {_over('e', 't')} >= {r.least_iou})"
    middle = lambda i: f"list_aggregate(list_transform(f.boxes, lambda x: x[{i}]), 'median')"
    box = "[t.x0, t.y0, t.x1, t.y1]"
    grown = f"list_transform([{{'id': e.id, 'dense': e.dense AND t.dense, 'boxes': list_append(e.boxes, {box})}}], lambda f: {{'id': f.id, 'ended': t.ts_s, 'dense': f.dense, 'boxes': f.boxes, 'x0': {middle(1)}, 'y0': {middle(2)}, 'x1': {middle(3)}, 'y1': {middle(4)}}})[1]"
    return f"""AS_ t AS MATERIALIZED (SELECT stream_id, ts_s, frame_no, frame_no % 3 > 0 AS dense, sx0 AS x0, sy0 AS y0, sx1 AS x1, sy1 AS y1, row_number() OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS k FROM view_ticks),
m AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_no, CAST([] AS {kind}[]) AS open_, CAST(NULL AS BIGINT) AS episode, CAST(NULL AS BIGINT[]) AS parents FROM (SELECT DISTINCT stream_id FROM t)
UNION ALL SELECT m.stream_id, t.k, t.frame_no, list_filter(CASE WHEN c.id IS NULL THEN list_append(m.open_, {{'id': t.frame_no, 'ended': t.ts_s, 'dense': t.dense, 'boxes': [{box}], 'x0': t.x0, 'y0': t.y0, 'x1': t.x1, 'y1': t.y1}}) ELSE list_transform(m.open_, lambda e: CASE WHEN e.id = c.id THEN {grown} ELSE e END) END, lambda e: t.ts_s - e.ended <= {r.coarse}), coalesce(c.id, t.frame_no), CASE WHEN b.torn THEN [a.near[1].id, a.near[2].id] END
FROM m JOIN t ON t.stream_id = m.stream_id AND t.k = m.k + 1,
LATERAL (SELECT list_sort(list_transform(list_filter(list_transform(m.open_, lambda e, i: {{'e': e, 'i': i}}), lambda x: list_transform([x.e], lambda e: {near})[1]), lambda x: {{'d': list_transform([x.e], lambda e: {_far('e', 't')} / {radius})[1], 'i': x.i, 'id': x.e.id}})) AS near) a,
LATERAL (SELECT coalesce(len(a.near) > 1 AND a.near[1].d > 0 AND a.near[2].d / a.near[1].d < {1 / r.ambiguity!r}, false) AS torn) b,
LATERAL (SELECT CASE WHEN NOT b.torn THEN a.near[1].id END AS id) c)
SELECT stream_id, frame_no, episode, array_to_string(parents, ',') AS parents FROM m WHERE k > 0"""


@query(_episodes_sql(EPISODES), "view_ticks")
def running_episodes(spark, sf_dir):
    rows = load(spark, sf_dir, "view_ticks").select("stream_id", "ts_s", "frame_no", (F.col("frame_no") % 3 > 0).alias("dense"), *[F.col(f"s{s}").alias(s) for s in scenes.SIDES])
    out = scenes.running_episodes(rows, "stream_id", "frame_no", EPISODES)
    return out.select("stream_id", "frame_no", "episode", F.array_join(F.col("parents").cast("array<string>"), ",").alias("parents"))


PHASES = scenes.Phases(interval=3600.0, samples=3, forced=6 * _DAY, change=0.5, confirm=0.2 * _DAY, motion=0.6, still=0.2 * _DAY, large=3, retry=0.2 * _DAY)
_SCENE = "stream_id, ts_s, frame_no, CAST((frame_no * 7 + CAST(floor(ts_s / 172800) AS BIGINT) * 13) % 10 AS DOUBLE) / 10 AS change, CAST((frame_no * 3) % 10 AS DOUBLE) / 10 AS motion, CASE WHEN frame_no % 23 <> 0 THEN (CAST(floor(ts_s / 432000) AS BIGINT) * 5) % 13 + frame_no % 2 END AS n"


def _phases_sql(p: scenes.Phases) -> str:
    return f"""AS_ t AS MATERIALIZED (SELECT {_SCENE}, row_number() OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS k FROM observations),
m AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_no, 'sampling' AS phase, CAST([] AS BIGINT[]) AS samples, CAST('-infinity' AS DOUBLE) AS due, 'initial' AS reason, CAST(NULL AS DOUBLE) AS refreshed, CAST(NULL AS DOUBLE) AS changed, CAST(NULL AS DOUBLE) AS quiet, CAST(NULL AS DOUBLE) AS retry, CAST(NULL AS BIGINT) AS pending, CAST(NULL AS BIGINT) AS published, CAST(0 AS BIGINT) AS version FROM (SELECT DISTINCT stream_id FROM t)
UNION ALL SELECT m.stream_id, t.k, t.frame_no,
CASE c.act WHEN 'fail' THEN 'error' WHEN 'publish' THEN 'stable' WHEN 'dirty' THEN 'dirty' WHEN 'periodic' THEN 'sampling' WHEN 'scene_changed' THEN 'sampling' ELSE a.phase END,
CASE WHEN c.act = 'sample' THEN b.samples WHEN c.act IN ('publish', 'large', 'periodic', 'scene_changed') THEN CAST([] AS BIGINT[]) ELSE a.samples END,
CASE WHEN c.act IN ('sample', 'publish') THEN t.ts_s + {p.interval} WHEN c.act IN ('large', 'periodic', 'scene_changed') THEN t.ts_s ELSE a.due END,
CASE c.act WHEN 'large' THEN 'large_change_confirmation' WHEN 'periodic' THEN 'periodic' WHEN 'scene_changed' THEN 'scene_changed' ELSE a.reason END,
CASE WHEN c.act = 'publish' THEN t.ts_s ELSE m.refreshed END, CASE WHEN c.act = 'publish' OR c.act = 'calm' THEN NULL WHEN c.act = 'moved' THEN t.ts_s ELSE m.changed END,
CASE WHEN c.act IN ('publish', 'dirty', 'noisy') THEN NULL WHEN c.act = 'hush' THEN t.ts_s ELSE m.quiet END, CASE WHEN c.act = 'fail' THEN t.ts_s + {p.retry} ELSE m.retry END,
CASE c.act WHEN 'publish' THEN NULL WHEN 'large' THEN b.found ELSE m.pending END, CASE WHEN c.act = 'publish' THEN b.found ELSE m.published END, m.version + CASE WHEN c.act = 'publish' THEN 1 ELSE 0 END
FROM m JOIN t ON t.stream_id = m.stream_id AND t.k = m.k + 1,
LATERAL (SELECT m.phase = 'error' AND t.ts_s >= m.retry AS again) z,
LATERAL (SELECT CASE WHEN z.again THEN 'sampling' ELSE m.phase END AS phase, CASE WHEN z.again THEN CAST([] AS BIGINT[]) ELSE m.samples END AS samples, CASE WHEN z.again THEN t.ts_s ELSE m.due END AS due, CASE WHEN z.again THEN 'retry' ELSE m.reason END AS reason) a,
LATERAL (SELECT list_append(a.samples, t.n) AS samples, list_sort(list_append(a.samples, t.n))[(len(a.samples) // 2) + 1] AS found) b,
LATERAL (SELECT CASE WHEN a.phase = 'sampling' AND t.ts_s < a.due THEN 'wait' WHEN a.phase = 'sampling' AND t.n IS NULL THEN 'fail' WHEN a.phase = 'sampling' AND len(b.samples) < {p.samples} THEN 'sample'
WHEN a.phase = 'sampling' AND m.version > 0 AND abs(b.found - m.published) > {p.large} AND (m.pending IS NULL OR abs(b.found - m.pending) > 1) THEN 'large' WHEN a.phase = 'sampling' THEN 'publish'
WHEN a.phase = 'stable' AND t.ts_s - m.refreshed >= {p.forced} THEN 'periodic' WHEN a.phase = 'stable' AND t.change < {p.change} THEN 'calm' WHEN a.phase = 'stable' AND m.changed IS NULL THEN 'moved' WHEN a.phase = 'stable' AND t.ts_s - m.changed >= {p.confirm} THEN 'dirty'
WHEN a.phase = 'dirty' AND t.motion > {p.motion} THEN 'noisy' WHEN a.phase = 'dirty' AND m.quiet IS NULL THEN 'hush' WHEN a.phase = 'dirty' AND t.ts_s - m.quiet >= {p.still} THEN 'scene_changed' ELSE 'wait' END AS act) c)
SELECT stream_id, frame_no, phase, reason, published, version FROM m WHERE k > 0"""


@query(_phases_sql(PHASES), "observations")
def scene_phases(spark, sf_dir):
    rows = load(spark, sf_dir, "observations").selectExpr(*[x.strip() for x in _SCENE.replace("% 10 AS DOUBLE", "% 10 AS double").split(", ")])
    return scenes.scene_phases(rows, "stream_id", "frame_no", PHASES)


def _thinned(source: str, frame: str, order: str, limit: float, name: str) -> str:
    """CTEs: greedy suppression of ``source`` a rank at a time; ``name`` has the rows that are kept."""
    return f"""{name}d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {frame} ORDER BY {order}) AS k FROM {source}), {name}e AS MATERIALIZED (SELECT a.{frame}, a.k AS ak, b.k AS bk FROM {name}d a JOIN {name}d b ON a.{frame} = b.{frame} AND a.k < b.k AND {_IOU} / {_UNION} >= {limit}),
{name}g AS (SELECT 0 AS step, {frame}, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT {frame} FROM {name}d) UNION ALL SELECT g.step + 1, g.{frame}, CASE WHEN EXISTS (SELECT 1 FROM {name}e e WHERE e.{frame} = g.{frame} AND e.bk = g.step + 1 AND list_contains(g.kept, e.ak)) THEN g.kept ELSE list_append(g.kept, CAST(g.step + 1 AS BIGINT)) END FROM {name}g g WHERE EXISTS (SELECT 1 FROM {name}d d WHERE d.{frame} = g.{frame} AND d.k = g.step + 1)),
{name} AS MATERIALIZED (SELECT d.* FROM {name}d d JOIN (SELECT {frame}, arg_max(kept, step) AS kept FROM {name}g GROUP BY {frame}) r ON d.{frame} = r.{frame} AND list_contains(r.kept, d.k))"""


_CLUSTER = "STRUCT(head BIGINT, last BIGINT, boxes STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[], confs DOUBLE[])"
_ONE = "{'x0': t.x0, 'y0': t.y0, 'x1': t.x1, 'y1': t.y1}"
_MIDDLE = ", ".join(f"list_aggregate(list_transform(u.boxes, lambda b: b.{s}), 'median') AS {s}" for s in scenes.SIDES)


@query(f"""AS_ {_thinned("detections", "frame_id", "conf DESC, det_id", 0.5, "n")}, t AS MATERIALIZED (SELECT frame_id // 20 AS batch, frame_id AS sample, det_id, conf, x0, y0, x1, y1, row_number() OVER (PARTITION BY frame_id // 20 ORDER BY frame_id, conf DESC, det_id) AS k FROM n),
m AS (SELECT batch, CAST(0 AS BIGINT) AS k, CAST([] AS {_CLUSTER}[]) AS made FROM (SELECT DISTINCT batch FROM t)
UNION ALL SELECT m.batch, t.k, CASE WHEN b.i IS NULL THEN list_append(m.made, {{'head': t.det_id, 'last': t.sample, 'boxes': [{_ONE}], 'confs': [t.conf]}}) ELSE list_transform(m.made, lambda c, i: CASE WHEN i = b.i THEN {{'head': c.head, 'last': t.sample, 'boxes': list_append(c.boxes, {_ONE}), 'confs': list_append(c.confs, t.conf)}} ELSE c END) END
FROM m JOIN t ON t.batch = m.batch AND t.k = m.k + 1,
LATERAL (SELECT list_sort(list_filter(list_transform(m.made, lambda c, i: {{'o': CASE WHEN c.last = t.sample THEN 1.0 ELSE -list_max(list_transform(c.boxes, lambda x: {_over('t', 'x')})) END, 'i': i}}), lambda x: x.o <= -0.3))[1].i AS i) b),
l AS (SELECT batch, unnest(arg_max(made, k)) AS u FROM m GROUP BY batch), q AS (SELECT batch, u.head AS head, len(u.confs) AS support, list_sum(u.confs) / len(u.confs) AS conf, {_MIDDLE} FROM l WHERE len(u.confs) >= 2),
{_thinned("q", "batch", "conf DESC, head", 0.5, "s")} SELECT batch, head AS first, CAST(support AS INTEGER) AS support, {six_sql("conf")} AS conf, x0, y0, x1, y1 FROM s""", "detections")
def sample_consensus(spark, sf_dir):
    rows = load(spark, sf_dir, "detections").withColumn("batch", F.floor(F.col("frame_id") / 20)).withColumnRenamed("frame_id", "sample")
    return scenes.consensus(rows, "batch", "sample", 2, 0.3, 0.5).withColumn("conf", six("conf"))


_PILE = "STRUCT(det_id BIGINT, n INTEGER, conf DOUBLE, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)"
_APART = "greatest(m.items[{0}].{2}0 - m.items[{1}].{2}1, m.items[{1}].{2}0 - m.items[{0}].{2}1, 0)"
_GAP = " + ".join(f"{_APART.format('i', 'j', c)} * {_APART.format('i', 'j', c)}" for c in "xy")
_BOTH = ", ".join(f"'{s}': {f}(m.items[p.i].{s}, m.items[p.j].{s})" for s, f in (("det_id", "least"), ("conf", "greatest"), ("x0", "least"), ("y0", "least"), ("x1", "greatest"), ("y1", "greatest")))


@query(f"""AS_ m AS (SELECT frame_id, 0 AS step, list({{'det_id': det_id, 'n': 1, 'conf': conf, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY det_id)::{_PILE}[] AS items FROM detections GROUP BY frame_id
UNION ALL SELECT m.frame_id, m.step + 1, list_append(list_filter(m.items, lambda x, i: i <> p.i AND i <> p.j), {{'det_id': b.u.det_id, 'n': m.items[p.i].n + m.items[p.j].n, 'conf': b.u.conf, 'x0': b.u.x0, 'y0': b.u.y0, 'x1': b.u.x1, 'y1': b.u.y1}})
FROM m, LATERAL (SELECT list_filter(flatten(list_transform(range(1, len(m.items) + 1), lambda i: list_transform(range(i + 1, len(m.items) + 1), lambda j: {{'i': i, 'j': j, 'near': sqrt({_GAP}) <= 4}}))), lambda x: x.near)[1] AS q) f, LATERAL (SELECT f.q.i AS i, f.q.j AS j) p, LATERAL (SELECT {{{_BOTH}}} AS u) b WHERE f.q IS NOT NULL),
l AS (SELECT frame_id, unnest(arg_max(items, step)) AS x FROM m GROUP BY frame_id) SELECT frame_id, x.det_id, x.n, x.conf, greatest(x.x0 - 2, 0) AS x0, greatest(x.y0 - 2, 0) AS y0, least(x.x1 + 2, 100) AS x1, least(x.y1 + 2, 100) AS y1 FROM l WHERE x.n >= 2""", "detections")
def frame_piles(spark, sf_dir):
    return frames.piles(load(spark, sf_dir, "detections"), "frame_id", 4.0, 2, 2.0, 100.0, 100.0)


_HIDES = "frame_no % 11 = 0"
_SEEN = f"SELECT stream_id, floor(ts_s / 21600) * 21600 AS ts_s, frame_no AS det_id, sx0 AS x0, sy0 AS y0, sx1 AS x1, sy1 AS y1, {_HIDES} AS hides, ax0, ay0, ax1, ay1 FROM view_ticks"
_OPEN = "STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, seen DOUBLE, hits INTEGER, hidden INTEGER)"


def _cost_sql(a: str, b: str) -> str:
    size = lambda x: f"greatest(({x}.x1 - {x}.x0) * ({x}.y1 - {x}.y0), 1)"
    diagonal = lambda x: f"sqrt(({x}.x1 - {x}.x0) * ({x}.x1 - {x}.x0) + ({x}.y1 - {x}.y0) * ({x}.y1 - {x}.y0))"
    ratio, limit = f"(greatest({size(a)}, {size(b)}) / least({size(a)}, {size(b)}))", f"greatest(18, 2 * greatest({diagonal(a)}, {diagonal(b)}))"
    return f"CASE WHEN {ratio} <= 5 AND ({_over(a, b)} > 0 OR {_far(a, b)} <= {limit}) THEN {_far(a, b)} / {limit} + 0.15::DOUBLE * ln({ratio}) - 0.25::DOUBLE * ({_over(a, b)}) END"


@query(f"""AS_ r AS ({_SEEN}), t AS MATERIALIZED (SELECT stream_id, ts_s, list({{'det_id': det_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY det_id) AS seen, max(CASE WHEN hides THEN [{{'x0': ax0, 'y0': ay0, 'x1': ax1, 'y1': ay1}}] ELSE [] END) AS hides, row_number() OVER (PARTITION BY stream_id ORDER BY ts_s) AS k FROM r GROUP BY stream_id, ts_s),
m AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST([] AS {_OPEN}[]) AS tracks, CAST([] AS STRUCT(det_id BIGINT, track BIGINT, hits INTEGER, cost DOUBLE, hidden INTEGER)[]) AS found FROM (SELECT DISTINCT stream_id FROM t)
UNION ALL SELECT m.stream_id, t.k, list_concat(list_transform(a.live, lambda e, i: coalesce(list_filter(list_transform(c.taken, lambda x: {{'id': e.id, 'x0': t.seen[x.n].x0, 'y0': t.seen[x.n].y0, 'x1': t.seen[x.n].x1, 'y1': t.seen[x.n].y1, 'seen': t.ts_s, 'hits': e.hits + 1, 'hidden': e.hidden, 'i': x.k}}), lambda x: x.i = i)[1], {{'id': e.id, 'x0': e.x0, 'y0': e.y0, 'x1': e.x1, 'y1': e.y1, 'seen': e.seen, 'hits': e.hits, 'hidden': e.hidden, 'i': i}}))::{_OPEN}[],
list_transform(list_filter(t.seen, lambda s, n: NOT list_contains(list_transform(c.taken, lambda x: x.n), n)), lambda s: {{'id': s.det_id, 'x0': s.x0, 'y0': s.y0, 'x1': s.x1, 'y1': s.y1, 'seen': t.ts_s, 'hits': 1, 'hidden': 0}})::{_OPEN}[]),
list_transform(t.seen, lambda s, n: coalesce(list_transform(list_filter(c.taken, lambda x: x.n = n), lambda x: {{'det_id': s.det_id, 'track': a.live[x.k].id, 'hits': a.live[x.k].hits + 1, 'cost': x.c, 'hidden': a.live[x.k].hidden}})[1], {{'det_id': s.det_id, 'track': s.det_id, 'hits': 1, 'cost': NULL, 'hidden': 0}}))
FROM m JOIN t ON t.stream_id = m.stream_id AND t.k = m.k + 1,
LATERAL (SELECT list_transform(list_filter(list_transform(m.tracks, lambda e: {{'e': e, 'covered': len(list_filter(t.hides, lambda o: (e.x0 + e.x1) / 2 BETWEEN o.x0 AND o.x1 AND (e.y0 + e.y1) / 2 BETWEEN o.y0 AND o.y1)) > 0}}), lambda x: x.covered OR t.ts_s - x.e.seen <= 45360), lambda x: {{'id': x.e.id, 'x0': x.e.x0, 'y0': x.e.y0, 'x1': x.e.x1, 'y1': x.e.y1, 'seen': x.e.seen, 'hits': x.e.hits, 'hidden': x.e.hidden + CASE WHEN x.covered THEN 1 ELSE 0 END}}) AS live) a,
LATERAL (SELECT list_sort(list_filter(flatten(list_transform(a.live, lambda e, k: list_transform(t.seen, lambda s, n: {{'c': {_cost_sql('e', 's')}, 'k': k, 'n': n}}))), lambda x: x.c IS NOT NULL)) AS pairs) b,
LATERAL (SELECT CASE WHEN len(b.pairs) > 0 THEN list_reduce(list_transform(b.pairs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.k = x[1].k OR y.n = x[1].n)) > 0 THEN acc ELSE list_concat(acc, x) END) ELSE [] END AS taken) c),
f AS (SELECT stream_id, unnest(found) AS f FROM m) SELECT stream_id, f.det_id, f.track, f.hits, {six_sql("f.cost")} AS cost, f.hidden FROM f""", "view_ticks")
def cheapest_tracks(spark, sf_dir):
    rows = load(spark, sf_dir, "view_ticks")
    hides = F.when(F.expr(_HIDES), F.array(F.struct(*[F.col(f"a{s}").alias(s) for s in scenes.SIDES])))
    seen = rows.select("stream_id", (F.floor(F.col("ts_s") / 21600) * 21600).cast("double").alias("ts_s"), F.col("frame_no").alias("det_id"), *[F.col(f"s{s}").alias(s) for s in scenes.SIDES], hides.alias("occluders"))
    return tracking.cheapest_tracks(seen, "stream_id", 21600.0).drop("ts_s").withColumn("cost", six("cost"))
