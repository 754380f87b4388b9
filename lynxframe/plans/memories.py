"""Registered queries: memories of places that live until evidence closes them, with recursive SQL, a tick of each view a step."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lynxframe.operators import memory, selection, selector, targets
from lynxframe.plans.catalogue import query
from lynxframe.sources.fixtures import load
from lynxframe.streaming import claims, health
from lynxframe.streaming import memory as stream_memory
from lynxframe.streaming.replay import replay_batches, replay_slices

#: One second of the rules is ten minutes and more of the tables, which span a month.
_DAY = 86400.0
RULES = memory.Rules(scan=(2, 3, 14400.0), prior=(2, 6, 21600.0), both=(2, 4, 7200.0), warm_up=43200.0, pending=2 * _DAY, clear_after=1.5 * _DAY, absent_after=_DAY, unjudged=1.2 * _DAY, most_gap=0.7 * _DAY, bridge_gap=2 * _DAY)


def ticks(spark, sf_dir):
    """One tick an event: at most one box seen, hidden, blind or different from the reference."""
    t = load(spark, sf_dir, "view_ticks")
    box = lambda p, *more: F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], *more)
    seen = F.when(F.col("by_scan") | F.col("by_prior"), F.array(box("s", F.col("by_scan").alias("scan"), F.col("by_prior").alias("prior"))))
    return t.select("stream_id", "view", "ts_s", "frame_no", "scanned", "judged", seen.alias("seen"), F.when(F.col("has_actor"), F.array(box("a"))).alias("actors"), F.when(F.col("has_blind"), F.array(box("a"))).alias("blind"), F.when(F.col("has_residue"), F.array(box("r"))).alias("residue"))


_FIELDS = {
    "id": "BIGINT", "first": "DOUBLE", "boxes": "DOUBLE[][]", "x0": "DOUBLE", "y0": "DOUBLE", "x1": "DOUBLE", "y1": "DOUBLE", "scan": "STRUCT(t DOUBLE, h BOOLEAN)[]", "prior": "STRUCT(t DOUBLE, h BOOLEAN)[]", "fused": "STRUCT(t DOUBLE, h BOOLEAN)[]",
    "scan_at": "DOUBLE", "prior_at": "DOUBLE", "clean": "DOUBLE", "clean_at": "DOUBLE", "absent": "DOUBLE", "absent_at": "DOUBLE", "misses": "BIGINT", "since": "DOUBLE", "here": "DOUBLE", "confirmed": "DOUBLE",
    "state": "VARCHAR", "reason": "VARCHAR", "told": "VARCHAR", "hidden": "BOOLEAN", "valid": "BOOLEAN", "rest": "DOUBLE", "s_ok": "BOOLEAN", "p_ok": "BOOLEAN", "f_ok": "BOOLEAN",
}


def _event(old: str = "e", **new: str) -> str:
    """A struct of all fields: those of ``old`` but for the new ones."""
    return "{" + ", ".join(f"'{f}': CAST({new[f] if f in new else f'{old}.{f}'} AS {kind})" for f, kind in _FIELDS.items()) + "}"


def _sql(r: memory.Rules) -> str:
    far = "sqrt(((e.x0 + e.x1 - t.sx0 - t.sx1) / 2) * ((e.x0 + e.x1 - t.sx0 - t.sx1) / 2) + ((e.y0 + e.y1 - t.sy0 - t.sy1) / 2) * ((e.y0 + e.y1 - t.sy0 - t.sy1) / 2))"
    short_e, short_t = "greatest(least(e.x1 - e.x0, e.y1 - e.y0), 1e-6)", "greatest(least(t.sx1 - t.sx0, t.sy1 - t.sy0), 1e-6)"
    fits = f"{far} <= {r.near} AND greatest({short_e}, {short_t}) <= {r.most_ratio} * least({short_e}, {short_t})"
    common = lambda p: f"(greatest(least(e.x1, t.{p}x1) - greatest(e.x0, t.{p}x0), 0) * greatest(least(e.y1, t.{p}y1) - greatest(e.y0, t.{p}y0), 0))"
    size = "((e.x1 - e.x0) * (e.y1 - e.y0))"
    middle = lambda boxes, i: f"list_aggregate(list_transform({boxes}, lambda b: b[{i}]), 'median')"
    # The main event takes in the parts' evidence, then the box.
    boxes = f"(list_concat(list_concat(e.boxes, flatten(list_transform(g.parts, lambda p: p.boxes))), [[t.sx0, t.sy0, t.sx1, t.sy1]]))[-{r.most_boxes}:]"
    both = lambda w: f"list_sort(list_distinct(list_concat(e.{w}, flatten(list_transform(g.parts, lambda p: p.{w})))))"
    ever = lambda c: f"CASE WHEN t.by_{c} THEN t.ts_s ELSE coalesce(e.{c}_at, CASE WHEN len(list_filter(g.parts, lambda p: p.{c}_at IS NOT NULL)) > 0 THEN CAST('-infinity' AS DOUBLE) END) END"
    least = lambda f: f"list_min(list_append(list_transform(g.parts, lambda p: p.{f}), e.{f}))"
    unseen = {"clean": "0", "clean_at": "NULL", "absent": "0", "absent_at": "NULL", "since": "NULL", "here": "t.ts_s"}
    taken = _event(boxes=boxes, first=least("first"), confirmed=least("confirmed"), scan=both("scan"), prior=both("prior"), fused=both("fused"), scan_at=ever("scan"), prior_at=ever("prior"), **unseen)
    placed = _event(x0=middle("e.boxes", 1), y0=middle("e.boxes", 2), x1=middle("e.boxes", 3), y1=middle("e.boxes", 4))
    fresh = _event(id="m.nxt", first="t.ts_s", boxes="[[t.sx0, t.sy0, t.sx1, t.sy1]]", x0="t.sx0", y0="t.sy0", x1="t.sx1", y1="t.sy1", scan="[]", prior="[]", fused="[]", scan_at="CASE WHEN t.by_scan THEN t.ts_s END", prior_at="CASE WHEN t.by_prior THEN t.ts_s END", misses="0", confirmed="NULL", state="'PENDING'", reason="'awaiting_confirmation'", told="NULL", **{f: "NULL" for f in ("hidden", "valid", "rest", "s_ok", "p_ok", "f_ok")}, **unseen)
    mark = lambda w, due, hit, n: f"(CASE WHEN {due} THEN list_append(e.{w}, {{'t': t.ts_s, 'h': {hit}}}) ELSE e.{w} END)[-{n}:]"
    by = lambda c: f"coalesce(e.{c}_at = t.ts_s, false)"
    seen = _event(
        scan=mark("scan", "t.scanned", by("scan"), r.scan[1]), prior=mark("prior", "t.judged", by("prior"), r.prior[1]), fused=mark("fused", "true", f"({by('scan')} AND {by('prior')})", r.both[1]),
        hidden=f"t.has_actor AND {common('a')} / {size} > {r.hidden}", valid=f"CASE WHEN t.has_blind THEN 1 - least(1.0, {common('a')} / {size}) ELSE 1.0 END >= {r.valid}", rest=f"CASE WHEN t.has_residue THEN {common('r')} ELSE 0 END",
    )
    step = lambda at: f"CASE WHEN t.ts_s - e.{at} > 0 AND t.ts_s - e.{at} <= {r.most_gap} THEN t.ts_s - e.{at} ELSE 0 END"
    judge, still = "e.prior_at IS NOT NULL AND t.judged AND NOT e.hidden", f"e.valid AND e.rest <= {max(1.0, r.residue)}"
    missed = f"e.scan_at IS NOT NULL AND NOT {by('scan')} AND t.scanned AND NOT e.hidden AND e.valid"
    enough = lambda w, rule: f"len(list_filter(e.{w}, lambda x: x.h)) >= {rule[0]} AND list_max(list_transform(list_filter(e.{w}, lambda x: x.h), lambda x: x.t)) - list_min(list_transform(list_filter(e.{w}, lambda x: x.h), lambda x: x.t)) >= {rule[2]}"
    weighed = _event(
        clean=f"CASE WHEN NOT ({judge}) THEN e.clean WHEN {still} THEN e.clean + {step('clean_at')} ELSE 0 END", clean_at=f"CASE WHEN NOT ({judge}) THEN e.clean_at WHEN {still} THEN t.ts_s END",
        misses=f"e.misses + CASE WHEN {missed} THEN 1 ELSE 0 END", absent=f"CASE WHEN {missed} THEN e.absent + {step('absent_at')} ELSE e.absent END", absent_at=f"CASE WHEN {missed} THEN t.ts_s ELSE e.absent_at END",
        since="CASE WHEN NOT t.judged THEN coalesce(e.since, t.ts_s) END", s_ok=enough("scan", r.scan), p_ok=enough("prior", r.prior), f_ok=enough("fused", r.both),
    )
    sure = "(e.s_ok OR e.p_ok OR e.f_ok)"
    waits = "(e.confirmed IS NULL AND e.state <> 'PENDING')"
    confirmed = _event(
        confirmed=f"CASE WHEN NOT e.hidden AND {sure} THEN coalesce(e.confirmed, t.ts_s) ELSE e.confirmed END",
        state=f"CASE WHEN e.hidden THEN 'OCCLUDED' WHEN e.f_ok OR (e.s_ok AND e.p_ok) THEN 'FUSED_VISIBLE' WHEN e.s_ok THEN 'SEMANTIC_VISIBLE' WHEN e.p_ok THEN 'PRIOR_VISIBLE' WHEN {waits} OR e.state = 'OCCLUDED' THEN 'PENDING' ELSE e.state END",
        reason=f"CASE WHEN e.hidden THEN 'actor_or_context_occluded' WHEN e.f_ok OR (e.s_ok AND e.p_ok) THEN 'fused_confirmed' WHEN e.s_ok THEN 'semantic_confirmed' WHEN e.p_ok THEN 'prior_confirmed' WHEN e.state = 'OCCLUDED' THEN 'occlusion_cleared' WHEN {waits} THEN 'awaiting_confirmation' ELSE e.reason END",
    )
    helped = "(e.here = t.ts_s AND NOT e.hidden)"
    ends = [
        ("e.confirmed IS NULL", f"CASE WHEN t.ts_s - e.first >= {r.pending} THEN 'EXPIRED_PENDING pending_timeout' END"),
        ("e.state = 'OCCLUDED'", "NULL"),
        (f"NOT t.judged AND t.ts_s - e.since >= {r.unjudged}", "'EXPIRED_PENDING profile_unavailable_timeout'"),
        (f"e.prior_at IS NULL AND e.misses >= {r.least_misses} AND e.absent >= {r.absent_after}", "'CLEARED semantic_absent_confirmed'"),
        ("e.prior_at IS NULL", f"CASE WHEN NOT {helped} THEN 'ABSENT_PENDING semantic_absent' END"),
        (f"e.clean >= {r.clear_after}", "'CLEARED clean_confirmed'"),
        ("true", f"CASE WHEN NOT {helped} THEN 'CLEAN_PENDING clean_reference_match' END"),
    ]
    end = "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in ends) + " END"
    closed = _event(state=f"coalesce(split_part({end}, ' ', 1), e.state)", reason=f"coalesce(split_part({end}, ' ', 2), e.reason)")
    merged = _event("e", state="'MERGED'", reason="'merged_into:' || g.main")
    kept = "list_filter(z.all_, lambda e: e.state NOT IN ('CLEARED', 'EXPIRED_PENDING', 'MERGED'))"
    of = lambda f, x: f"list_transform({x}, lambda e: {f})"
    struct = "STRUCT(" + ", ".join(f"{f} {kind}" for f, kind in _FIELDS.items()) + ")[]"
    bridge = "STRUCT(a BIGINT, b BIGINT, t DOUBLE)[]"
    return f"""AS_ t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, view ORDER BY ts_s, frame_no) AS k FROM view_ticks),
m AS (SELECT stream_id, view, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS began, CAST(1 AS BIGINT) AS nxt, CAST([] AS {struct}) AS events, CAST([] AS {bridge}) AS bridges, CAST([] AS {struct}) AS told FROM (SELECT DISTINCT stream_id, view FROM t)
UNION ALL SELECT m.stream_id, m.view, t.k, CASE WHEN a.stale THEN m.last ELSE t.ts_s END, a.began, CASE WHEN a.skip OR g.main IS NOT NULL OR NOT (t.by_scan OR t.by_prior) THEN m.nxt ELSE m.nxt + 1 END,
CASE WHEN a.stale THEN m.events WHEN a.skip THEN [] ELSE {of(_event(told="e.state"), kept)} END, CASE WHEN a.skip THEN m.bridges ELSE g.bridges END,
CASE WHEN a.skip THEN [] ELSE list_concat({of(merged, "g.parts")}, list_filter(z.all_, lambda e: e.state IS DISTINCT FROM e.told)) END
FROM m JOIN t ON t.stream_id = m.stream_id AND t.view = m.view AND t.k = m.k + 1,
LATERAL (SELECT coalesce(t.ts_s <= m.last, false) AS stale, coalesce(m.began, t.ts_s) AS began, coalesce(t.ts_s <= m.last, false) OR t.ts_s - coalesce(m.began, t.ts_s) < {r.warm_up} AS skip) a,
LATERAL (SELECT list_transform(list_sort(list_transform(list_filter(m.events, lambda e: (t.by_scan OR t.by_prior) AND {fits}), lambda e: {{'d': {far}, 'id': e.id}})), lambda x: x.id) AS near) c,
LATERAL (SELECT list_filter(c.near[2:], lambda o: len(list_filter(m.bridges, lambda b: b.a = least(o, c.near[1]) AND b.b = greatest(o, c.near[1]) AND t.ts_s - b.t <= {r.bridge_gap})) > 0) AS joined) d,
LATERAL (SELECT CASE WHEN len(d.joined) > 0 THEN list_min(list_append(d.joined, c.near[1])) ELSE c.near[1] END AS main) f,
LATERAL (SELECT f.main AS main, list_filter(m.events, lambda e: len(d.joined) > 0 AND e.id <> f.main AND list_contains(list_append(d.joined, c.near[1]), e.id)) AS parts, list_concat(m.bridges, list_transform(c.near[2:], lambda o: {{'a': least(o, c.near[1]), 'b': greatest(o, c.near[1]), 't': t.ts_s}})) AS bridges) g,
LATERAL (SELECT list_transform(list_transform(list_filter(m.events, lambda e: NOT list_contains(list_transform(g.parts, lambda p: p.id), e.id)), lambda e: CASE WHEN e.id = g.main THEN {taken} ELSE e END), lambda e: CASE WHEN e.id = g.main THEN {placed} ELSE e END) AS old) u,
LATERAL (SELECT CASE WHEN g.main IS NULL AND (t.by_scan OR t.by_prior) THEN list_append(u.old, {fresh}) ELSE u.old END AS there) v,
LATERAL (SELECT {of(seen, "v.there")} AS there) w, LATERAL (SELECT {of(weighed, "w.there")} AS there) x, LATERAL (SELECT {of(confirmed, "x.there")} AS there) y, LATERAL (SELECT {of(closed, "y.there")} AS all_) z),
o AS (SELECT m.stream_id, m.view, t.ts_s, unnest(told) AS e FROM m JOIN t USING (stream_id, view, k))
SELECT stream_id, view, round(ts_s, 3) AS ts_s, e.id AS event, e.state, e.reason, CASE WHEN e.scan_at IS NULL THEN 'prior_only' WHEN e.prior_at IS NULL THEN 'semantic_only' ELSE 'semantic_and_prior' END AS kind, round(e.confirmed, 3) AS confirmed_s, e.x0, e.y0, e.x1, e.y1 FROM o"""


def _shown(changes):
    return changes.withColumn("ts_s", F.round("ts_s", 3)).withColumn("confirmed_s", F.round("confirmed_s", 3))


@query(_sql(RULES), "view_ticks")
def event_memory(spark, sf_dir):
    return _shown(memory.event_memory(ticks(spark, sf_dir), ["stream_id", "view"], "frame_no", RULES))


@query(_sql(RULES), "view_ticks")
def event_memory_stream(spark, sf_dir):
    """The same as keyed state over a stream of the ticks, in three slices of their time."""
    return _shown(replay_slices(ticks(spark, sf_dir), "ts_s", lambda s: stream_memory.event_memory(s, ["stream_id", "view"], "frame_no", RULES)))


LIMITS = selector.Limits(switch=(3, 0.5 * _DAY), recovery=(2, 0.1 * _DAY), dwell=1.5 * _DAY, cooldown=0.7 * _DAY, most_gap=_DAY, join_gap=2 * _DAY)


def _selector_sql(r: selector.Limits) -> str:
    pick = lambda scores, of: f"list_filter({scores}, lambda s: s.profile = {of})[1]"
    times = lambda kind: f"CASE WHEN m.{kind} = d.best AND NOT a.broken AND t.ts_s - list_last(m.{kind}_at) > 0 AND t.ts_s - list_last(m.{kind}_at) <= {r.most_gap} THEN list_append(m.{kind}_at, t.ts_s) ELSE [t.ts_s] END"
    enough = lambda rule: f"len(e.times) >= {rule[0]} AND list_last(e.times) - e.times[1] >= {rule[1]}"
    wipe = "g.ask IS NOT NULL AND (g.sound OR {0} = g.ask)"
    switch, recovery = "CASE WHEN b.hold THEN d.best END", "CASE WHEN NOT b.hold AND d.best IS NOT NULL THEN d.best WHEN NOT a.broken THEN m.recovery END"
    return f"""AS_ t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS k FROM (SELECT stream_id, ts_s, frame_no, list({{'profile': profile, 'score': score, 'enter': enter, 'hold': hold, 'sound': sound, 'rough': rough}} ORDER BY profile) AS scores FROM profile_scores GROUP BY stream_id, ts_s, frame_no)),
m AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS ts_s, CAST(NULL AS BIGINT) AS frame_no, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS BIGINT) AS active, CAST(NULL AS DOUBLE) AS since, CAST(NULL AS BIGINT) AS switch, CAST([] AS DOUBLE[]) AS switch_at, CAST(NULL AS BIGINT) AS recovery, CAST([] AS DOUBLE[]) AS recovery_at, CAST([] AS STRUCT(p BIGINT, until DOUBLE)[]) AS cool, CAST(-1 AS BIGINT) AS cursor_, CAST(0 AS BIGINT) AS generation, CAST(0 AS BIGINT) AS switches, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS candidate, 0 AS tested, CAST(NULL AS DOUBLE) AS improvement FROM (SELECT DISTINCT stream_id FROM t)
UNION ALL SELECT m.stream_id, t.k, t.ts_s, t.frame_no, t.ts_s, CASE WHEN g.sound THEN g.ask ELSE m.active END, CASE WHEN g.sound THEN t.ts_s ELSE m.since END,
CASE WHEN {wipe.format('d.best')} THEN NULL ELSE {switch} END, CASE WHEN b.hold AND d.best IS NOT NULL AND NOT coalesce({wipe.format('d.best')}, false) THEN e.times ELSE [] END,
CASE WHEN {wipe.format(f'({recovery})')} THEN NULL ELSE {recovery} END, CASE WHEN coalesce({wipe.format(f'({recovery})')}, false) THEN [] WHEN NOT b.hold AND d.best IS NOT NULL THEN e.times WHEN NOT a.broken THEN m.recovery_at ELSE [] END,
CASE WHEN g.ask IS NOT NULL AND NOT g.sound THEN list_append(a.cool, {{'p': g.ask, 'until': t.ts_s + {r.cooldown}}}) ELSE a.cool END, CASE WHEN NOT b.hold AND len(c.fresh) > 0 THEN list_last(c.fresh) ELSE m.cursor_ END,
m.generation + CASE WHEN g.sound THEN 1 ELSE 0 END, m.switches + CASE WHEN g.sound AND g.ask IS DISTINCT FROM m.active THEN 1 ELSE 0 END, split_part(f.says, ' ', 1), split_part(f.says, ' ', 2), d.best, CAST(len(d.tested) AS INTEGER), CASE WHEN b.hold THEN (b.score - {pick('t.scores', 'd.best')}.score) / greatest(b.score, {r.floor}) END
FROM m JOIN t ON t.stream_id = m.stream_id AND t.k = m.k + 1,
LATERAL (SELECT coalesce(t.ts_s < m.last OR t.ts_s - m.last > {r.join_gap}, false) AS broken, list_filter(m.cool, lambda x: x.until > t.ts_s) AS cool) a,
LATERAL (SELECT coalesce({pick('t.scores', 'm.active')}.hold, false) AS hold, {pick('t.scores', 'm.active')}.score AS score, list_transform(a.cool, lambda x: x.p) AS cold, CASE WHEN a.broken THEN NULL ELSE coalesce(m.recovery, m.switch) END AS going) b,
LATERAL (SELECT list_filter([b.going], lambda p: p IS NOT NULL AND NOT list_contains(b.cold, p)) AS going, list_filter(list_transform(list_concat(list_filter(t.scores, lambda s: s.profile > m.cursor_), list_filter(t.scores, lambda s: s.profile <= m.cursor_)), lambda s: s.profile), lambda p: p IS DISTINCT FROM b.going AND NOT list_contains(b.cold, p))[1:{r.fresh} - len(list_filter([b.going], lambda p: p IS NOT NULL AND NOT list_contains(b.cold, p)))] AS fresh) c,
LATERAL (SELECT CASE WHEN b.hold THEN list_distinct(list_append(list_transform(list_sort(list_transform(t.scores, lambda s: {{'r': s.rough, 'p': s.profile}}))[1:{r.top_k}], lambda x: x.p), m.active)) ELSE list_concat(c.going, c.fresh) END AS tested) c2,
LATERAL (SELECT c2.tested, list_sort(list_transform(list_filter(t.scores, lambda s: list_contains(c2.tested, s.profile) AND s.enter AND NOT list_contains(b.cold, s.profile) AND (NOT b.hold OR (s.profile <> m.active AND (b.score - s.score) / greatest(b.score, {r.floor}) >= {r.improvement}))), lambda s: {{'s': s.score, 'p': s.profile}}))[1].p AS best) d,
LATERAL (SELECT CASE WHEN d.best IS NULL THEN CAST([] AS DOUBLE[]) WHEN b.hold THEN {times('switch')} ELSE {times('recovery')} END AS times) e,
LATERAL (SELECT CASE WHEN b.hold AND d.best IS NULL THEN 'MATCHED OK' WHEN b.hold AND NOT ({enough(r.switch)}) THEN 'MATCHED WAITING_SWITCH_EVIDENCE' WHEN b.hold AND t.ts_s - coalesce(m.since, t.ts_s) < {r.dwell} THEN 'MATCHED WAITING_MIN_DWELL' WHEN b.hold THEN 'SWITCH_PENDING SWITCH_READY' WHEN d.best IS NULL THEN 'UNKNOWN NO_ELIGIBLE_PROFILE' WHEN NOT ({enough(r.recovery)}) THEN 'UNKNOWN WAITING_RECOVERY_SPAN' ELSE 'SWITCH_PENDING RECOVERY_READY' END AS says) f,
LATERAL (SELECT CASE WHEN f.says LIKE 'SWITCH%' THEN d.best END AS ask, f.says LIKE 'SWITCH%' AND {pick('t.scores', 'd.best')}.sound AS sound) g)
SELECT stream_id, frame_no, active, status, reason, candidate, tested, round(improvement, 6) AS improvement, generation, switches FROM m WHERE k > 0"""


@query(_selector_sql(LIMITS), "profile_scores")
def profile_selection(spark, sf_dir):
    out = selector.selected_profiles(load(spark, sf_dir, "profile_scores"), ["stream_id"], "frame_no", LIMITS)
    return out.withColumn("improvement", F.round("improvement", 6)).drop("ts_s")


REACH = targets.Reach(recent=1.5 * _DAY, reviewed=0.15, base=0.1, per_second=0.1 / _DAY, most=0.3, cooldown={"boat_confirmed": _DAY, "candidate_not_confirmed": 2 * _DAY, "target_lost": 20000.0}, busy=7200.0)
_VERDICT = {0: "boat_confirmed", 1: "candidate_not_confirmed", 2: "target_lost"}


def _ledger_sql(r: targets.Reach) -> str:
    struct = "STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, vx DOUBLE, vy DOUBLE, seen DOUBLE, n BIGINT, src BIGINT, cool DOUBLE, until DOUBLE, verdict VARCHAR, jx DOUBLE, jy DOUBLE)"
    fields = [f.strip().split() for f in struct[7:-1].split(",")]

    def put(old: str = "e", **new: str) -> str:
        return "{" + ", ".join(f"'{f}': CAST({new.get(f, f'{old}.{f}')} AS {kind})" for f, kind in fields) + "}"

    rest = "CASE e.verdict " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in r.cooldown.items()) + " END"
    done = put(cool=f"e.until + {rest}", x="e.jx", y="e.jy", vx="0", vy="0", until="NULL")
    size = "0.5 * greatest(t.w, t.h, e.w, e.h)"
    here = "sqrt((t.x - e.x) * (t.x - e.x) + (t.y - e.y) * (t.y - e.y))"
    gone = "greatest(t.ts_s - e.seen, 0)"
    ahead = f"sqrt((t.x - (e.x + e.vx * {gone})) * (t.x - (e.x + e.vx * {gone})) + (t.y - (e.y + e.vy * {gone})) * (t.y - (e.y + e.vy * {gone})))"
    plain = f"least({r.base} + least({r.per_second} * {gone}, {r.most - r.base}) + least({size}, {r.most / 2}), {r.most})"
    radius = f"CASE WHEN e.src = t.track_id THEN least({plain} * {r.same_source}, {r.most}) ELSE {plain} END"
    speed = lambda v, c: f"CASE WHEN {gone} >= 0.05 THEN CASE WHEN e.n <= 1 THEN (t.{c} - e.{c}) / {gone} ELSE 0.7::DOUBLE * e.{v} + (1 - 0.7::DOUBLE) * ((t.{c} - e.{c}) / {gone}) END ELSE e.{v} END"
    moved = put(src="t.track_id", seen="t.ts_s", n="e.n + 1", x="t.x", y="t.y", w="t.w", h="t.h", vx=speed("vx", "x"), vy=speed("vy", "y"))
    counted = put(src="t.track_id", seen="t.ts_s", n="e.n + 1")
    fresh = put(id="t.frame_no", x="t.x", y="t.y", w="t.w", h="t.h", vx="0", vy="0", seen="t.ts_s", n="1", src="t.track_id", cool="0", until="NULL", verdict="NULL", jx="0", jy="0")
    begun = put(until=f"t.ts_s + {r.busy}", verdict="t.verdict", jx="t.x", jy="t.y")
    first = lambda far, test: f"list_sort(list_transform(list_filter(a.live, lambda e: {test}), lambda e: {{'d': {far}, 'id': e.id}}))[1].id"
    return f"""AS_ t AS MATERIALIZED (SELECT stream_id, ts_s, frame_no, track_id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, x1 - x0 AS w, y1 - y0 AS h, CASE frame_no % 3 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _VERDICT.items())} END AS verdict, row_number() OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS k FROM observations),
m AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_no, CAST(NULL AS DOUBLE) AS at, CAST([] AS BIGINT[]) AS taken, CAST([] AS {struct}[]) AS targets, CAST(NULL AS {struct}) AS target, CAST(NULL AS VARCHAR) AS found, false AS claimed FROM (SELECT DISTINCT stream_id FROM t)
UNION ALL SELECT m.stream_id, t.k, t.frame_no, t.ts_s, CASE WHEN c.found = 'reviewed' THEN a.taken ELSE list_append(a.taken, d.target.id) END, list_transform(d.all_, lambda e: CASE WHEN e.id = d.target.id AND f.claims THEN {begun} ELSE e END), d.target, c.found, f.claims
FROM m JOIN t ON t.stream_id = m.stream_id AND t.k = m.k + 1,
LATERAL (SELECT CASE WHEN t.ts_s = m.at THEN m.taken ELSE CAST([] AS BIGINT[]) END AS taken, list_filter(list_transform(m.targets, lambda e: CASE WHEN e.until <= t.ts_s THEN {done} ELSE e END), lambda e: e.seen >= t.ts_s - {r.recent}) AS live) a,
LATERAL (SELECT {first(here, f"e.cool > t.ts_s AND {here} <= least(greatest({r.reviewed}, least({size}, {r.reviewed})), {r.most})")} AS old, {first(ahead, f"e.cool <= t.ts_s AND NOT list_contains(a.taken, e.id) AND {ahead} <= {radius}")} AS near) b,
LATERAL (SELECT coalesce(b.old, b.near) AS id, CASE WHEN b.old IS NOT NULL THEN 'reviewed' WHEN b.near IS NOT NULL THEN 'matched' ELSE 'new' END AS found) c,
LATERAL (SELECT CASE WHEN c.id IS NULL THEN list_append(a.live, {fresh}) ELSE list_transform(a.live, lambda e: CASE WHEN e.id <> c.id THEN e WHEN c.found = 'reviewed' THEN {counted} ELSE {moved} END) END AS all_) x,
LATERAL (SELECT x.all_, list_filter(x.all_, lambda e: e.id = coalesce(c.id, t.frame_no))[1] AS target) d,
LATERAL (SELECT d.target.cool <= t.ts_s AND d.target.until IS NULL AS claims) f)
SELECT stream_id, frame_no, target.id AS target, found, target.n AS observations, round(target.x, 6) AS x, round(target.y, 6) AS y, claimed, round(target.cool, 3) AS cooldown_until FROM m WHERE k > 0"""


@query(_ledger_sql(REACH), "observations")
def target_ledger(spark, sf_dir):
    rows = load(spark, sf_dir, "observations")
    verdict = F.expr("CASE frame_no % 3 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _VERDICT.items()) + " END")
    seen = rows.select("stream_id", "ts_s", "frame_no", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), F.col("track_id").alias("source"), verdict.alias("verdict"))
    out = targets.target_ledger(seen, "stream_id", "frame_no", REACH).drop("ts_s")
    return out.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6)).withColumn("cooldown_until", F.round("cooldown_until", 3))


_CLAIMS = """AS_ t AS MATERIALIZED (SELECT track_id, ts_s, frame_no AS tie, kind <> 'error' AS asks, CASE frame_no % 2 WHEN 0 THEN 86400 ELSE 7200 END AS rest, row_number() OVER (PARTITION BY track_id ORDER BY ts_s, frame_no) AS k FROM observations),
m AS (SELECT track_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS tie, false AS asks, false AS active, CAST('-infinity' AS DOUBLE) AS until, false AS granted FROM (SELECT DISTINCT track_id FROM t)
UNION ALL SELECT m.track_id, t.k, t.tie, t.asks, CASE WHEN g.ok THEN t.asks ELSE m.active END, CASE WHEN g.ok AND NOT t.asks THEN t.ts_s + t.rest ELSE m.until END, g.ok FROM m JOIN t ON t.track_id = m.track_id AND t.k = m.k + 1, LATERAL (SELECT CASE WHEN t.asks THEN NOT m.active AND m.until <= t.ts_s ELSE m.active END AS ok) g)
SELECT track_id, tie, asks, granted FROM m WHERE k > 0"""


def _requests(spark, sf_dir):
    rest = F.when(F.col("frame_no") % 2 == 0, 86400.0).otherwise(7200.0)
    return load(spark, sf_dir, "observations").select("track_id", "ts_s", F.col("frame_no").alias("tie"), (F.col("kind") != "error").alias("asks"), rest.alias("rest"))


@query(_CLAIMS, "observations")
def job_claims(spark, sf_dir):
    """All requests as one batch: at most one active job a track, and a rest after each."""
    free = spark.createDataFrame([], f"track_id bigint, {targets.HELD}")
    return targets.claimed(_requests(spark, sf_dir), free, "track_id")[0].select("track_id", "tie", "asks", "granted")


@query(_CLAIMS, "observations")
def job_claims_stream(spark, sf_dir):
    """The same from a stream in three batches, against one table of jobs."""
    folder = replay_batches(_requests(spark, sf_dir), "ts_s", lambda root: claims.claiming(root, "track_id"))
    return spark.read.schema("track_id bigint, ts_s double, tie bigint, asks boolean, granted boolean, batch bigint").parquet(f"{folder}/jobs").select("track_id", "tie", "asks", "granted")


_HEALTH = "CASE WHEN kind = 'error' THEN 'mosaic_risk' WHEN value > 80 THEN 'degraded' ELSE 'healthy' END"


@query(f"""AS_ o AS (SELECT stream_id, ts_s, frame_no, {_HEALTH} AS health, lead(ts_s) OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS next_s FROM observations),
e AS (SELECT stream_id, ts_s, frame_no AS tie, health FROM o UNION ALL SELECT stream_id, ts_s + 36000, frame_no, 'stalled' FROM o WHERE next_s - ts_s > 36000 OR (next_s IS NULL AND ts_s + 36000 < (SELECT max(ts_s) FROM observations) - 3600)),
c AS (SELECT *, lag(health) OVER (PARTITION BY stream_id ORDER BY ts_s, tie) AS before FROM e) SELECT stream_id, round(ts_s, 3) AS ts_s, health, before FROM c WHERE health IS DISTINCT FROM before""", "observations")
def live_health(spark, sf_dir):
    """Changes of health from a stream in three slices of time; ten hours of silence stall a stream."""
    rows = load(spark, sf_dir, "observations").select("stream_id", F.timestamp_micros(F.round(F.col("ts_s") * 1e6).cast("long")).alias("at"), "ts_s", "frame_no", F.expr(_HEALTH).alias("health"))
    return replay_slices(rows, "ts_s", lambda s: health.changes(s, "stream_id", "at", "frame_no", 36000.0, "1 hour")).withColumn("ts_s", F.round("ts_s", 3))


#: Rows arrive in four batches by when they come, every seventh two days after its time, and every fifth one twice.
_ARRIVALS = [1704067200.0 + d * _DAY for d in (8, 15, 22)]
_COMES = "CASE WHEN frame_no % 7 = 0 THEN ts_s + 172800 ELSE ts_s END"


@query(f"""AS_ a AS (SELECT stream_id, floor(ts_s / 600) * 600 AS ts_s, frame_no, {_COMES} AS comes FROM observations), b AS (SELECT *, CASE {" ".join(f"WHEN comes <= {x} THEN {k}" for k, x in enumerate(_ARRIVALS))} ELSE {len(_ARRIVALS)} END AS batch FROM a),
h AS (SELECT stream_id, batch, max(max(ts_s)) OVER (PARTITION BY stream_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM b GROUP BY stream_id, batch),
m AS (SELECT b.*, high, row_number() OVER (PARTITION BY b.stream_id, b.batch, b.ts_s ORDER BY frame_no) AS r FROM b JOIN h ON h.stream_id = b.stream_id AND h.batch = b.batch)
SELECT stream_id, frame_no, CASE WHEN ts_s <= high THEN 'late' ELSE 'repeated' END AS reason, round(high - ts_s, 3) AS late_by FROM m WHERE ts_s <= high OR r > 1""", "observations")
def late_rows(spark, sf_dir):
    """The side table of rows whose clock does not rise, from a stream in four batches."""
    rows = load(spark, sf_dir, "observations").select("stream_id", (F.floor(F.col("ts_s") / 600) * 600).cast("double").alias("ts_s"), "frame_no", F.expr(_COMES).alias("comes"))
    folder = replay_batches(rows, "comes", lambda root: health.in_time(root, "stream_id", "frame_no"), _ARRIVALS)
    late = spark.read.schema("stream_id string, frame_no bigint, late_by double, reason string").parquet(f"{folder}/late")
    return late.select("stream_id", "frame_no", "reason", F.round("late_by", 3).alias("late_by"))


_HOLDERS = "SELECT stream_id, profile, hold, dense_rank() OVER (PARTITION BY stream_id ORDER BY ts_s, frame_no) AS k FROM profile_scores"


def _prune_sql(items: int, most_loss: float, most_pause: int) -> str:
    """As many rounds as there can be, one CTE after the other: what is left, who covers alone, stretches, the pick."""
    out = [f"AS_ t AS MATERIALIZED (SELECT stream_id, k, list(profile) FILTER (WHERE hold) AS fit FROM ({_HOLDERS}) GROUP BY stream_id, k), r0 AS (SELECT list(DISTINCT profile ORDER BY profile) AS kept, 0 AS round, CAST(NULL AS BIGINT) AS item, CAST(NULL AS DOUBLE) AS loss, CAST(NULL AS BIGINT) AS pause FROM profile_scores)"]
    for i in range(1, items):
        out.append(f"""o{i} AS MATERIALIZED (SELECT stream_id, k, unnest(CASE WHEN len(f) = 0 THEN list_append(kept, -1) ELSE f END) AS item, len(f) = 1 AS alone FROM (SELECT t.stream_id, t.k, r.kept, list_filter(coalesce(t.fit, []), lambda p: list_contains(r.kept, p)) AS f FROM t CROSS JOIN r{i - 1} r WHERE r.kept IS NOT NULL) WHERE len(f) <= 1),
s{i} AS (SELECT item, sum(alone) AS alone, max(run) AS run FROM (SELECT stream_id, item, count(*) AS run, count(*) FILTER (WHERE alone) AS alone FROM (SELECT *, k - row_number() OVER (PARTITION BY stream_id, item ORDER BY k) AS i FROM o{i}) GROUP BY stream_id, item, i) GROUP BY item),
c{i} AS (SELECT p.item, coalesce(s.alone, 0)::DOUBLE / (SELECT count(*) FROM t) AS loss, coalesce(s.run, b.run) - b.run AS pause FROM (SELECT unnest(kept) AS item FROM r{i - 1}) p LEFT JOIN s{i} s ON s.item = p.item CROSS JOIN (SELECT coalesce(max(run), 0) AS run FROM s{i} WHERE item = -1) b),
r{i} AS MATERIALIZED (SELECT CASE WHEN x.item IS NOT NULL THEN list_filter(r.kept, lambda p: p <> x.item) END AS kept, {i} AS round, x.item, x.loss, x.pause FROM r{i - 1} r LEFT JOIN (SELECT * FROM c{i} WHERE loss <= {most_loss} AND pause <= {most_pause} ORDER BY loss, pause, item LIMIT 1) x ON true)""")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT round, item, round(loss, 6) AS loss, CAST(pause AS BIGINT) AS pause FROM r{i} WHERE item IS NOT NULL" for i in range(1, items))


@query(_prune_sql(8, 0.06, 40), "profile_scores")
def pruned_profiles(spark, sf_dir):
    w = Window.partitionBy("stream_id").orderBy("ts_s", "frame_no")
    rows = load(spark, sf_dir, "profile_scores").select("stream_id", "profile", "hold", F.dense_rank().over(w).alias("k"))
    return selection.prune(rows, "stream_id", "k", "profile", "hold", 0.06, 40).withColumn("loss", F.round("loss", 6))


PLACES = memory.Places(period=0.3 * _DAY, confirm=0.6 * _DAY, clear_after=0.6 * _DAY, pending=1.5 * _DAY, gap_factor=4.0, residue=60.0, outside=700.0)
_PLACE = {
    "id": "BIGINT", "boxes": "DOUBLE[][]", "x0": "DOUBLE", "y0": "DOUBLE", "x1": "DOUBLE", "y1": "DOUBLE", "times": "DOUBLE[]", "clean": "DOUBLE", "clean_at": "DOUBLE", "lost": "DOUBLE", "confirmed": "DOUBLE", "state": "VARCHAR", "reason": "VARCHAR", "told": "VARCHAR",
    "here": "BOOLEAN", "ate": "BIGINT[]",
}


def _place(old: str = "e", **new: str) -> str:
    return "{" + ", ".join(f"'{f}': CAST({new[f] if f in new else f'{old}.{f}'} AS {kind})" for f, kind in _PLACE.items()) + "}"


def _places_sql(r: memory.Places) -> str:
    far = lambda a, b: f"sqrt((({a}x0 + {a}x1 - {b}x0 - {b}x1) / 2) * (({a}x0 + {a}x1 - {b}x0 - {b}x1) / 2) + (({a}y0 + {a}y1 - {b}y0 - {b}y1) / 2) * (({a}y0 + {a}y1 - {b}y0 - {b}y1) / 2))"
    size = lambda a: f"greatest(({a}x1 - {a}x0) * ({a}y1 - {a}y0), 1)"
    one = lambda a, b, ratio: f"({far(a, b)} <= {r.near} AND greatest({size(a)}, {size(b)}) <= {ratio} * least({size(a)}, {size(b)}))"
    common = lambda a, b, by=0.0: f"(greatest(least({a}x1 + {by}, {b}x1) - greatest({a}x0 - {by}, {b}x0), 0) * greatest(least({a}y1 + {by}, {b}y1) - greatest({a}y0 - {by}, {b}y0), 0))"
    spills = lambda a: f"(t.has_residue AND {common(a, 't.r', r.touch)} > 0 AND (t.rx1 - t.rx0) * (t.ry1 - t.ry0) - {common(a, 't.r', r.guard)} >= {r.outside})"
    hidden = lambda a: f"(t.has_actor AND {common(a, 't.a')} / (({a}x1 - {a}x0) * ({a}y1 - {a}y0)) > {r.hidden})"
    middle = lambda boxes, i: f"list_aggregate(list_transform({boxes}, lambda b: b[{i}]), 'median')"
    anchor = {"x0": middle("e.boxes", 1), "y0": middle("e.boxes", 2), "x1": middle("e.boxes", 3), "y1": middle("e.boxes", 4)}
    box = "[t.sx0, t.sy0, t.sx1, t.sy1]"
    seen = {"lost": "0", "clean": "0", "clean_at": "NULL", "state": "'VISIBLE_ANOMALY'", "reason": "'candidate_visible'", "here": "true"}
    sure = lambda times: f"CASE WHEN e.confirmed IS NULL AND len({times}) * {r.period!r}::DOUBLE >= {r.confirm!r}::DOUBLE THEN t.ts_s ELSE e.confirmed END"
    taken = _place(boxes=f"list_append(e.boxes, {box})[-{r.most_boxes}:]", times="list_append(e.times, t.ts_s)", confirmed=sure("list_append(e.times, t.ts_s)"), **seen)
    fresh = _place(id="m.nxt", boxes=f"[{box}]", x0="t.sx0", y0="t.sy0", x1="t.sx1", y1="t.sy1", times="[t.ts_s]", confirmed=f"CASE WHEN {r.period!r} >= {r.confirm!r} THEN t.ts_s END", told="NULL", ate="[]", **seen)
    valid = f"CASE WHEN t.has_blind THEN 1 - least(1.0, {common('e.', 't.a')} / ((e.x1 - e.x0) * (e.y1 - e.y0))) ELSE 1.0 END"
    rest = f"CASE WHEN t.has_residue THEN {common('e.', 't.r', r.pad)} ELSE 0 END"
    lost = f"e.lost + CASE WHEN e.confirmed IS NULL THEN {r.period!r}::DOUBLE ELSE 0 END"
    clean = f"CASE WHEN e.clean_at IS NOT NULL AND t.ts_s - e.clean_at <= {r.gap_factor * r.period!r}::DOUBLE THEN e.clean + {r.period!r}::DOUBLE ELSE {r.period!r}::DOUBLE END"
    says = f"""CASE WHEN NOT a.usable THEN 'ENVIRONMENT_CHANGE frame_unavailable' WHEN e.here THEN e.state || ' ' || e.reason WHEN {spills('e.')} THEN 'OCCLUDED context_occluded' WHEN {hidden('e.')} THEN 'OCCLUDED actor_occluded' WHEN {valid} < {r.valid} THEN 'GROUND_UNAVAILABLE insufficient_valid_ground'
WHEN e.confirmed IS NULL AND {lost} >= {r.pending!r}::DOUBLE THEN 'EXPIRED_PENDING pending_timeout' WHEN {rest} <= {max(1.0, r.residue)} THEN CASE WHEN {clean} >= {r.clear_after!r}::DOUBLE THEN 'CLEARED clean_confirmed' ELSE 'CLEAN_PENDING clean_reference_match' END ELSE 'ANOMALY_PENDING residual_without_candidate' END"""
    judged = _place(state=f"split_part({says}, ' ', 1)", reason=f"split_part({says}, ' ', 2)", lost=f"CASE WHEN split_part({says}, ' ', 1) IN ('EXPIRED_PENDING', 'CLEARED', 'CLEAN_PENDING', 'ANOMALY_PENDING') THEN {lost} ELSE e.lost END", clean=f"CASE WHEN split_part({says}, ' ', 1) IN ('CLEARED', 'CLEAN_PENDING') THEN {clean} ELSE 0 END", clean_at=f"CASE WHEN split_part({says}, ' ', 1) IN ('CLEARED', 'CLEAN_PENDING') THEN t.ts_s END")
    all_boxes = f"list_concat(e.boxes, x[1].boxes)[-{r.most_merged}:]"
    both = "list_distinct(list_concat(e.times, x[1].times))"
    eaten = f"list_transform([{_place(boxes=all_boxes, times=both, confirmed='list_min([e.confirmed, x[1].confirmed])', clean='0', clean_at='NULL', ate='list_append(e.ate, x[1].id)')}], lambda e: {_place(confirmed=sure('e.times'), **anchor)})[1]"
    joins_ = one("e.", "x[1].", r.merge_ratio)
    struct = "STRUCT(" + ", ".join(f"{f} {kind}" for f, kind in _PLACE.items()) + ")[]"
    return f"""AS_ t AS MATERIALIZED (SELECT *, frame_no % 10 <> 7 AS usable, row_number() OVER (PARTITION BY stream_id, view ORDER BY ts_s, frame_no) AS k FROM view_ticks),
m AS (SELECT stream_id, view, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS last, CAST(1 AS BIGINT) AS nxt, CAST([] AS {struct}) AS events, CAST([] AS {struct}) AS told FROM (SELECT DISTINCT stream_id, view FROM t)
UNION ALL SELECT m.stream_id, m.view, t.k, t.ts_s, m.nxt + CASE WHEN a.shows AND b.id IS NULL THEN 1 ELSE 0 END, list_transform(list_filter(z.kept, lambda e: e.state NOT IN ('CLEARED', 'EXPIRED_PENDING')), lambda e: {_place(told="e.state", here="false", ate="[]")}),
list_concat(list_transform(list_filter(y.there, lambda e: len(list_filter(z.kept, lambda f: list_contains(f.ate, e.id))) > 0), lambda e: {_place(state="'MERGED'", reason="'merged_into:' || list_filter(z.kept, lambda f: list_contains(f.ate, e.id))[1].id")}), list_filter(z.kept, lambda e: e.state IS DISTINCT FROM e.told))
FROM m JOIN t ON t.stream_id = m.stream_id AND t.view = m.view AND t.k = m.k + 1,
LATERAL (SELECT t.usable AS usable, t.usable AND t.by_scan AND NOT {spills('t.s')} AND NOT {hidden('t.s')} AS shows) a,
LATERAL (SELECT list_sort(list_transform(list_filter(m.events, lambda e: a.shows AND {one('e.', 't.s', r.most_ratio)}), lambda e: {{'d': {far('e.', 't.s')}, 'id': e.id}}))[1].id AS id) b,
LATERAL (SELECT list_transform(list_transform(m.events, lambda e: CASE WHEN e.id = b.id THEN {taken} ELSE e END), lambda e: CASE WHEN e.id = b.id THEN {_place(**anchor)} ELSE e END) AS there) v,
LATERAL (SELECT list_transform(CASE WHEN a.shows AND b.id IS NULL THEN list_append(v.there, {fresh}) ELSE v.there END, lambda e: {judged}) AS there) y,
LATERAL (SELECT list_filter(y.there, lambda e: e.state NOT IN ('CLEARED', 'EXPIRED_PENDING')) AS open_) w,
LATERAL (SELECT list_concat(CASE WHEN a.usable AND len(w.open_) > 0 THEN list_reduce(list_transform(w.open_, lambda e: [e]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda e: {joins_})) > 0 THEN list_transform(acc, lambda e: CASE WHEN e.id = list_filter(acc, lambda e: {joins_})[1].id THEN {eaten} ELSE e END) ELSE list_concat(acc, x) END) ELSE w.open_ END, list_filter(y.there, lambda e: e.state IN ('CLEARED', 'EXPIRED_PENDING'))) AS kept) z),
o AS (SELECT m.stream_id, m.view, t.ts_s, unnest(told) AS e FROM m JOIN t USING (stream_id, view, k)) SELECT stream_id, view, round(ts_s, 3) AS ts_s, e.id AS event, e.state, e.reason, round(e.confirmed, 3) AS confirmed_s, e.x0, e.y0, e.x1, e.y1 FROM o"""


@query(_places_sql(PLACES), "view_ticks")
def place_memory(spark, sf_dir):
    """The memory of one channel: what a scan sees."""
    t = load(spark, sf_dir, "view_ticks")
    box = lambda p: F.array(F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]))
    rows = t.select("stream_id", "view", "ts_s", "frame_no", (F.col("frame_no") % 10 != 7).alias("usable"), F.when(F.col("by_scan"), box("s")).alias("seen"), F.when(F.col("has_actor"), box("a")).alias("actors"), F.when(F.col("has_blind"), box("a")).alias("blind"), F.when(F.col("has_residue"), box("r")).alias("residue"))
    return _shown(memory.place_memory(rows, ["stream_id", "view"], "frame_no", PLACES))
