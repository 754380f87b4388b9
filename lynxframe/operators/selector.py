"""Which of several references a view uses: switching with hysteresis, and a search that widens when none fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxframe.operators.walks import walk

DECISION = "active bigint, status string, reason string, candidate bigint, tested int, improvement double, generation bigint, switches bigint"


@dataclass(frozen=True)
class Limits:
    """Seconds, counts and ratios of the rule; defaults and the names of states and reasons are fixed values."""

    top_k: int = 3
    improvement: float = 0.15
    switch: tuple[int, float] = (3, 4.0)
    recovery: tuple[int, float] = (2, 2.0)
    dwell: float = 10.0
    cooldown: float = 10.0
    most_gap: float = 4.0
    join_gap: float = 300.0
    floor: float = 0.25
    fresh: int = 3


def _seen_again(evidence: tuple | None, profile: int, at: float, most_gap: float) -> tuple:
    """The ledger of a candidate with one more sample; another candidate, or a pause, begins a new one."""
    times = evidence[1] if evidence and evidence[0] == profile and 0 < at - evidence[1][-1] <= most_gap else ()
    return profile, (*times, at)


def _enough(evidence: tuple, rule: tuple[int, float]) -> bool:
    return len(evidence[1]) >= rule[0] and evidence[1][-1] - evidence[1][0] >= rule[1]


def _to_test(state: dict, scores: dict, hold: bool, at: float, limits: Limits) -> set:
    """While the active reference holds: it and the nearest ``top_k`` by rough distance. Else up to ``fresh``: first the one
    whose evidence is under way, then the next ones in the order of ids from where the search last stood; what cools down
    is passed by."""
    if hold:
        near = sorted(scores, key=lambda p: (scores[p]["rough"], p))[: limits.top_k]
        return {*near, state["active"]}
    under_way = [e[0] for e in (state["recovery"] or state["switch"],) if e and e[0] in scores and e[0] not in state["cool"]]
    ids = sorted(scores)
    turned = [p for p in ids if p > state["cursor"]] + [p for p in ids if p <= state["cursor"]]
    new = [p for p in turned if p not in under_way and p not in state["cool"]][: limits.fresh - len(under_way)]
    if new:
        state["cursor"] = new[-1]
    return {*under_way, *new}


def decide(state: dict, at: float, scores: dict, limits: Limits) -> tuple:
    """One tick: the decision, and the state after it in place. ``scores``: profile -> score (less is better), enter, hold,
    sound (what a full check of the profile would say now) and rough."""
    if state["last"] is not None and (at < state["last"] or at - state["last"] > limits.join_gap):
        state["switch"] = state["recovery"] = None
    state["last"] = at
    state["cool"] = {p: until for p, until in state["cool"].items() if until > at}
    current = scores.get(state["active"])
    hold = bool(current and current["hold"])
    tested = _to_test(state, scores, hold, at, limits)
    fit = {p: scores[p]["score"] for p in tested if p in scores and scores[p]["enter"] and p not in state["cool"]}
    better, ask = None, None
    if hold:
        gains = {p: (current["score"] - s) / max(current["score"], limits.floor) for p, s in fit.items() if p != state["active"]}
        best = min((p for p, g in gains.items() if g >= limits.improvement), key=lambda p: (fit[p], p), default=None)
        state["switch"] = None if best is None else _seen_again(state["switch"], best, at, limits.most_gap)
        status, reason = "MATCHED", "OK"
        if best is not None:
            better = gains[best]
            if not _enough(state["switch"], limits.switch):
                reason = "WAITING_SWITCH_EVIDENCE"
            elif at - (at if state["since"] is None else state["since"]) < limits.dwell:
                reason = "WAITING_MIN_DWELL"
            else:
                status, reason, ask = "SWITCH_PENDING", "SWITCH_READY", best
    else:
        state["switch"] = None
        best = min(fit, key=lambda p: (fit[p], p), default=None)
        status, reason = "UNKNOWN", "NO_ELIGIBLE_PROFILE"
        if best is not None:
            state["recovery"] = _seen_again(state["recovery"], best, at, limits.most_gap)
            reason = "WAITING_RECOVERY_SPAN"
            if _enough(state["recovery"], limits.recovery):
                status, reason, ask = "SWITCH_PENDING", "RECOVERY_READY", best
    if ask is not None and scores[ask]["sound"]:
        state["switches"] += ask != state["active"]
        state["generation"] += 1
        state.update(active=ask, since=at, switch=None, recovery=None)
    elif ask is not None:
        state["cool"][ask] = at + limits.cooldown
        for name in ("switch", "recovery"):
            if state[name] and state[name][0] == ask:
                state[name] = None
    return state["active"], status, reason, best, len(tested), better, state["generation"], state["switches"]


def start() -> dict:
    return {"last": None, "active": None, "since": None, "switch": None, "recovery": None, "cool": {}, "cursor": -(1 << 62), "generation": 0, "switches": 0}


def selected_profiles(scores: DataFrame, keys: list[str], tie: str, limits: Limits = Limits()) -> DataFrame:
    """The reference that each tick of a key ends with, and why: keys, ts_s, ``tie``, then ``DECISION``.

    scores: keys, ts_s, ``tie``, profile (bigint), score (less is better), enter and hold (whether the profile may become,
    or stay, the active one), sound (the verdict of the full check that a change asks for) and rough (a coarse distance);
    a row per tick and profile. Only profiles that are tested at a tick count. While the active one holds, another takes
    its place once it has been better by the ratio ``improvement`` for ``switch`` (samples, seconds) in a row and the
    active one has been there for ``dwell``; when it does not hold, one that may enter does after ``recovery``. A change
    whose check fails cools the profile down. Pauses over ``most_gap`` begin a ledger anew.

    The state of a key is one profile, two ledgers and what cools down; decisions rest on all before, so a key is one walk.
    A tick's profiles meet in one array. Rows without a clock, profile or score are left out; null flags are false, a null
    rough distance comes last.
    """
    row = F.struct("profile", "score", F.coalesce("enter", F.lit(False)).alias("enter"), F.coalesce("hold", F.lit(False)).alias("hold"), F.coalesce("sound", F.lit(False)).alias("sound"), F.coalesce("rough", F.lit(float("inf"))).alias("rough"))
    ticks = scores.dropna(subset=["ts_s", "profile", "score"]).groupBy(*keys, "ts_s", tie).agg(F.collect_list(row).alias("scores"))

    def step(state, given):
        by = {x["profile"]: x for x in (r if isinstance(r, dict) else r.asDict() for r in given[2])}
        return state, (given[0], given[1], *decide(state, given[0], by, limits))

    types = f"ts_s double, {tie} {scores.schema[tie].dataType.simpleString()}"
    return walk(ticks, keys, ["ts_s", tie], ["ts_s", tie, "scores"], start, step, f"{types}, {DECISION}")
