"""A ledger of moving targets, and the jobs that look at them more closely: at most one active job a target."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynxframe.operators import timeline
from lynxframe.operators.walks import walk


@dataclass(frozen=True)
class Reach:
    """How far a sighting may be from a target, in shares of the picture, and for how many seconds targets are remembered
    and left alone. Defaults and the names of results are fixed values of the rule."""

    recent: float = 1200.0
    reviewed: float = 0.04
    base: float = 0.018
    per_second: float = 0.0015
    most: float = 0.08
    same_source: float = 1.5
    cooldown: dict = field(default_factory=lambda: {"boat_confirmed": 1200.0, "candidate_not_confirmed": 3600.0, "recovery_failed": 3600.0, "target_lost": 180.0})
    busy: float = 60.0


LEDGER = "target bigint, found string, observations bigint, x double, y double, claimed boolean, cooldown_until double"


def _free(target: dict, at: float) -> bool:
    return target["cool"] <= at


def _settle(targets: list[dict], at: float, reach: Reach) -> None:
    """Jobs that are done by now: the target is left alone for as long as the result says, back where the job began."""
    for t in targets:
        if t["until"] is not None and t["until"] <= at:
            t.update(cool=t["until"] + reach.cooldown.get(t["verdict"], reach.cooldown["target_lost"]), x=t["jx"], y=t["jy"], vx=0.0, vy=0.0, until=None)


def _nearest(targets: list[dict], at: float, seen: tuple, taken: set, reach: Reach) -> tuple[dict | None, str]:
    """A target that is left alone and lies here, else the free one whose predicted place is nearest (ties: the older)."""
    x, y, w, h, source = seen
    best = (math.inf, math.inf, None)
    for t in targets:
        if not _free(t, at):
            far = math.hypot(x - t["x"], y - t["y"])
            radius = min(max(reach.reviewed, min(0.5 * max(w, h, t["w"], t["h"]), reach.reviewed)), reach.most)
            if far <= radius:
                best = min(best, (far, t["id"], t), key=lambda b: b[:2])
    if best[2] is not None:
        return best[2], "reviewed"
    for t in targets:
        if _free(t, at) and t["id"] not in taken:
            gone = max(at - t["seen"], 0.0)
            far = math.hypot(x - (t["x"] + t["vx"] * gone), y - (t["y"] + t["vy"] * gone))
            unsure = min(reach.per_second * gone, reach.most - reach.base)
            radius = min(reach.base + unsure + min(0.5 * max(w, h, t["w"], t["h"]), reach.most / 2), reach.most)
            radius = min(radius * reach.same_source, reach.most) if source == t["source"] else radius
            if far <= radius:
                best = min(best, (far, t["id"], t), key=lambda b: b[:2])
    return best[2], "matched" if best[2] else "new"


def sighted(state: dict, at: float, name: int, seen: tuple, verdict: str, reach: Reach) -> tuple:
    """One sighting (x, y, w, h, source) at ``at``: which target it is of, and whether it begins a job."""
    if at != state["at"]:
        state.update(at=at, taken=set())
    _settle(state["targets"], at, reach)
    state["targets"] = [t for t in state["targets"] if t["seen"] >= at - reach.recent]
    target, how = _nearest(state["targets"], at, seen, state["taken"], reach)
    x, y, w, h, source = seen
    if target is None:
        target = {"id": name, "x": x, "y": y, "w": w, "h": h, "vx": 0.0, "vy": 0.0, "n": 0, "cool": 0.0, "until": None, "verdict": None, "jx": 0.0, "jy": 0.0}
        state["targets"].append(target)
    elif how == "matched":
        gone = max(at - target["seen"], 0.0)
        if gone >= 0.05:
            new = (x - target["x"]) / gone, (y - target["y"]) / gone
            keep = 0.0 if target["n"] <= 1 else 0.7
            target.update(vx=keep * target["vx"] + (1 - keep) * new[0], vy=keep * target["vy"] + (1 - keep) * new[1])
        target.update(x=x, y=y, w=w, h=h)
    target.update(source=source, seen=at, n=target["n"] + 1)
    if how != "reviewed":
        state["taken"].add(target["id"])
    claimed = _free(target, at) and target["until"] is None
    if claimed:
        target.update(until=at + reach.busy, verdict=verdict, jx=x, jy=y)
    return target["id"], how, target["n"], target["x"], target["y"], claimed, target["cool"]


def target_ledger(sightings: DataFrame, key: str, tie: str, reach: Reach = Reach()) -> DataFrame:
    """Each sighting with its target (the ``tie`` of its first sighting) and whether it claims a job: ``LEDGER``.

    sightings: key, ts_s, ``tie`` (unique), x, y (centre), w, h, source, verdict (the result that a job begun here will
    have after ``busy`` seconds). Targets that are left alone after a job are a fixed memory: a sighting at one only counts.
    Any other goes to the nearest predicted place, within a radius that grows with the time unseen; sightings of one instant
    go to different targets. A target is claimed if it is not left alone and has no active job.

    What was not seen for ``recent`` seconds is forgotten, so keys are cut at such pauses and their pieces run in parallel;
    a task holds the targets of that time. Sightings without a clock or place are left out; unknown results count as lost.
    """
    rows = sightings.dropna(subset=["ts_s", "x", "y", "w", "h"])

    def step(state, row):
        at, name, *seen, verdict = row
        return state, (at, name, *sighted(state, at, name, tuple(seen), verdict, reach))

    cut = timeline.sessions(rows, [key], "ts_s", reach.recent, tie)
    kind = rows.schema[tie].dataType.simpleString()
    return walk(cut, [key, "session"], ["ts_s", tie], ["ts_s", tie, "x", "y", "w", "h", "source", "verdict"], lambda: {"at": None, "taken": set(), "targets": []}, step, f"ts_s double, {tie} {kind}, {LEDGER}").drop("session")


#: Of a job's request: when (with ``tie``), whether it asks for the target or gives it back, and for how long it then rests.
REQUEST = "ts_s double, tie bigint, asks boolean, rest double"
HELD = "active boolean, until double"


def claimed(requests: DataFrame, held: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Compare and set, for all targets at once: (requests with ``granted``, the new ``HELD`` of the targets they touch).

    requests: target and ``REQUEST``; a row that asks is granted if no job is active and the target does not rest; one that
    gives back ends the active job, if there is one, and lets the target rest. ``held``: target and ``HELD``, one row a
    target; others are free. A target's requests meet in one array, so hand in a batch of them, not a history.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ts_s", "tie", "asks", "rest"))).alias("all")
    rows = requests.groupBy(target).agg(ordered).join(held, target, "left")
    out = "array<struct<ts_s:double,tie:bigint,asks:boolean,granted:boolean>>"
    zero = F.struct(F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("until", F.lit(float("-inf"))).alias("until"), F.expr("array()").cast(out).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        granted = F.when(r.asks, ~acc.active & (acc.until <= r.ts_s)).otherwise(acc.active)
        row = F.struct(r.ts_s.alias("ts_s"), r.tie.alias("tie"), r.asks.alias("asks"), granted.alias("granted"))
        active = F.when(granted, r.asks).otherwise(acc.active)
        until = F.when(granted & ~r.asks, r.ts_s + r.rest).otherwise(acc.until)
        return F.struct(active.alias("active"), until.alias("until"), F.concat(acc.out, F.array(row)).alias("out"))

    done = rows.select(target, F.aggregate("all", zero, step).alias("a"))
    return done.select(target, F.explode("a.out").alias("o")).select(target, "o.*"), done.select(target, "a.active", "a.until")
