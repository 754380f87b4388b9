"""Steps whose cost once grew faster than their input: the same results as by plain rules, and how much they look at."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from lynxframe.operators import frames, reports, scenes, states, tracking


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def overlap(a, b):
    both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def taken(dets, gts, least):
    """One-to-one pairs of a frame, best first."""
    edges = sorted((-overlap(d[3:], g[2:]), -d[2], d[1], g[1]) for d in dets for g in gts if overlap(d[3:], g[2:]) >= least)
    pairs, used = [], set()
    for _, _, d, g in edges:
        if ("d", d) not in used and ("g", g) not in used:
            pairs.append((d, g))
            used |= {("d", d), ("g", g)}
    return pairs


def test_association_holds_no_frame_in_a_row(spark):
    rng = random.Random(4)
    box = lambda: (x := float(rng.randrange(20)), y := float(rng.randrange(20)), x + rng.randrange(4, 12), y + rng.randrange(4, 12))
    dets = [(f, 1000 * f + n, rng.randrange(10) / 10, *box()) for f in range(40) for n in range(rng.randrange(12))]
    gts = [(f, 1000 * f + n, *box()) for f in range(5, 45) for n in range(rng.randrange(12))]
    left = spark.createDataFrame([*dets, (None, 7, 0.5, 0.0, 0.0, 5.0, 5.0)], "f long, det_id long, conf double, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame(gts, "f long, gt_id long, x0 double, y0 double, x1 double, y1 double")
    out = frames.associate(left, right, "f")
    want = [p for f in range(45) for p in taken([d for d in dets if d[0] == f], [g for g in gts if g[0] == f], 0.3)]
    got = [(r.det_id, r.gt_id) for r in out.collect()]
    alone = [(d[1], None) for d in dets if d[1] not in {a for a, _ in want}] + [(None, g[1]) for g in gts if g[1] not in {b for _, b in want}]
    assert sorted(got, key=str) == sorted([*want, *alone, (7, None)], key=str)
    band = F.when(F.col("x1") - F.col("x0") < 8, "small").otherwise("large")
    quality = reports.quality_by_threshold(left, right, "f", [0.0, 0.5, 0.95], band)
    of = {d[1]: "small" if d[5] - d[3] < 8 else "large" for d in dets} | {7: "small"}
    wide = {g[1]: "small" if g[4] - g[2] < 8 else "large" for g in gts}
    expect = set()
    for t in (0.0, 0.5, 0.95):
        passing = [d for d in dets if d[2] >= t]
        pairs = [p for f in range(45) for p in taken([d for d in passing if d[0] == f], [g for g in gts if g[0] == f], 0.3)]
        for size in ("small", "large"):
            false = sum(of[d[1]] == size for d in passing) - sum(of[d] == size for d, _ in pairs) + (t <= 0.5 and size == "small")
            expect.add((t, size, sum(s == size for s in wide.values()), sum(wide[g] == size for _, g in pairs), false))
    assert {tuple(r) for r in quality.collect()} == expect
    assert "collect_list" not in plan(out) and "collect_list" not in plan(quality)


class Walked(Exception):
    """Holds the start and the step that an operator hands to ``walk``."""


def step_of(monkeypatch, module, operator):
    """The start and step of a walk, without Spark."""

    def walk(rows, keys, order, columns, start, step, schema):
        raise Walked(start, step)

    with monkeypatch.context() as m:
        m.setattr(module, "walk", walk)
        with pytest.raises(Walked) as caught:
            operator()
    return caught.value.args


class Side(float):
    """A side of a box that counts how often it is subtracted."""

    count = 0

    def __sub__(self, other):
        Side.count += 1
        return float(self) - other


def test_inventory_looks_at_near_items_only(spark, monkeypatch):
    table = spark.createDataFrame([], "s string, ts_s double, n long, x0 double, y0 double, x1 double, y1 double, clean boolean")
    start, step = step_of(monkeypatch, states, lambda: states.inventory(table, "s", ["ts_s", "n"], clear_after=3.0, most_gap=2.0))

    def run(boxes):
        state, out = start(), []
        for n, (*box, clean) in enumerate(boxes):
            state, made = step(state, (float(n), n, *box, clean))
            out.append(made[2:])
        return out

    def work(n):
        Side.count = 0
        run([*[(Side(9 * k), Side(0), Side(9 * k + 4), Side(4), False) for k in range(n)]] * 2)
        return Side.count

    assert work(400) < 2.2 * work(200)

    def plainly(boxes):
        items, out = [], []
        for at, (a, b, c, d, clean) in enumerate(boxes):
            near = []
            for n, (name, (e, f, g, h), *_) in enumerate(items):
                w, y, u, v = c - a, d - b, g - e, h - f
                dx, dy = (a + c - e - g) / 2, (b + d - f - h) / 2
                if min(w, y, u, v) > 0 and max(w / u, u / w, y / v, v / y) <= 3 and (dx / min(w, u)) ** 2 + (dy / min(y, v)) ** 2 <= 0.25:
                    near.append((dx * dx + dy * dy, n))
            if not near:
                out.append((None, "no item") if clean else (at, "created"))
                if not clean:
                    items.append([at, (a, b, c, d), None, None])
                continue
            item = items[min(near)[1]]
            if not clean:
                item[2:] = None, None
                out.append((item[0], "present"))
                continue
            if item[3] is None or at - item[3] > 2.0:
                item[2] = at
            item[3] = at
            gone = at - item[2] >= 3.0
            out.append((item[0], "cleared" if gone else "verifying"))
            items = [i for i in items if not (gone and i is item)]
        return out

    rng = random.Random(2)
    size = lambda: rng.choice([0.0, 0.3, 1.0, 1.9, 2.0, 4.0, 7.5, 8.0])
    boxes = [((x := rng.randrange(-3, 3) / 2), (y := rng.randrange(-3, 3) / 2), x + size(), y + size(), rng.random() < 0.9) for _ in range(4000)]
    got = run(boxes)
    assert got == plainly(boxes) and {o for _, o in got} == {"created", "present", "verifying", "cleared", "no item"}


def test_tracks_are_scored_near_a_detection_only(spark, monkeypatch):
    table = spark.createDataFrame([], "stream_id string, ts_s double, frame_no long, x0 double, y0 double, x1 double, y1 double")
    start, step = step_of(monkeypatch, tracking, lambda: tracking.sparse_tracks(table, 100.0))
    calls = []
    score = tracking._score
    monkeypatch.setattr(tracking, "_score", lambda *a: calls.append(a) or score(*a))
    state = start()
    for n in range(300):
        x = 10.0 * (n % 150)
        state, made = step(state, (n, n / 10, x, 0.0, x + 4, 4.0, True))
        assert made[2] == [{"frame_no": n, "id": n % 150 + 1, "hits": n // 150 + 1}]
    assert len(calls) == 150
    # Boxes without extent, and limits that hold for any pair.
    dot, box = (5.0, 5.0, 5.0, 5.0), (5.0, 5.0, 6.0, 6.0)
    for least, most in ((0.3, 0.5), (0.0, 0.5), (0.3, 100.0)):
        tracks = [dot, box, (50.0, 50.0, 51.0, 51.0)]
        for seen in tracks:
            near = set(tracking._may_match(tracking.np.array(tracks), seen, least, most).tolist())
            assert {k for k, t in enumerate(tracks) if score(t, seen, least, most) is not None} <= near


def test_medians_hold_different_numbers_only(spark, monkeypatch):
    rng = random.Random(9)
    for distinct in (1, 2, 7, 400):
        xs = [float(rng.randrange(distinct)) for _ in range(400)]
        middle = None
        for n, x in enumerate(xs):
            if middle is None:
                middle = scenes.Middle(x)
            else:
                middle.add(x)
            assert middle.value() == median(xs[: n + 1])
        assert middle.values == sorted(set(xs))
    rows = spark.createDataFrame([("a", float(n), n, True, 10.0 * (n % 2), 0.0, 20.0, 10.0) for n in range(4)], "s string, ts_s double, n long, dense boolean, x0 double, y0 double, x1 double, y1 double")
    start, step = step_of(monkeypatch, scenes, lambda: scenes.running_episodes(rows, "s", "n"))
    state = start()
    for n in range(1000):
        state, _ = step(state, (float(n), n, True, float(n % 3), 0.0, 20.0, 10.0))
    (episode,) = state
    assert [len(m.values) for m in episode["sides"]] == [3, 1, 1, 1] and episode["own"] == [1.0, 0.0, 20.0, 10.0]
