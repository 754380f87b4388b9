"""Keyed state over streams with typed state variables: the memory of events at fixed places."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lynxframe.operators import memory

_WINDOW = "array<struct<at:double,hit:boolean>>"
CLOCK = "last double, began double, next bigint, late bigint"
EVENT = (
    f"id bigint, first double, boxes array<array<double>>, box array<double>, scan {_WINDOW}, prior {_WINDOW}, both {_WINDOW}, scan_at double, prior_at double, "
    "clean double, clean_at double, absent double, absent_at double, misses bigint, since double, here double, confirmed double, state string, reason string, told string"
)
_FIELDS = [c.split()[0] for c in EVENT.split(", ")]
_WINDOWS = ("scan", "prior", "both")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EventMemory(StatefulProcessor):
    """``memory.advance`` over a stream of ticks: the clock is a value, the open events a list and the bridges between them
    a map, so a restart goes on where the last batch ended. Ticks of a batch are put in order; one that is not later than
    all before it, in this batch or an earlier one, counts as late and changes nothing."""

    def __init__(self, rules: memory.Rules, keys: list[str], tie: str):
        self.rules, self.keys, self.tie = rules, keys, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", CLOCK)
        self.events = handle.getListState("events", EVENT)
        self.bridges = handle.getMapState("bridges", "a bigint, b bigint", "times array<double>")

    def _load(self) -> dict:
        out = memory.start()
        if self.clock.exists():
            out |= dict(zip(("last", "began", "next", "late"), self.clock.get(), strict=True))
        for row in self.events.get():
            event = dict(zip(_FIELDS, row, strict=True))
            event |= {w: [tuple(x) for x in event[w]] for w in _WINDOWS} | {"boxes": [list(b) for b in event["boxes"]], "box": list(event["box"])}
            out["events"].append(event)
        out["bridges"] = [[a, b, at] for (a, b), (times,) in self.bridges.iterator() for at in times]
        return out

    def _save(self, held: dict) -> None:
        self.clock.update((held["last"], held["began"], held["next"], held["late"]))
        self.events.clear()
        if held["events"]:
            self.events.put([tuple(e[f] for f in _FIELDS) for e in held["events"]])
        self.bridges.clear()
        for pair in {tuple(b[:2]) for b in held["bridges"]}:
            self.bridges.updateValue(pair, ([b[2] for b in held["bridges"] if tuple(b[:2]) == pair],))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._load()
        ordered = sorted((r for r in rows if r["ts_s"] is not None), key=lambda r: (r["ts_s"], r[self.tie]))
        made = Row(*self.keys, "ts_s", *[c.split()[0] for c in memory.CHANGE.split(", ")])
        for row in ordered:
            for change in memory.advance(held, memory.plain_tick(tuple(row[c] for c in memory.TICK)), self.rules):
                yield made(*key, row["ts_s"], *change)
        self._save(held)

    def close(self) -> None:
        pass


def event_memory(ticks: DataFrame, keys: list[str], tie: str, rules: memory.Rules = memory.Rules()) -> DataFrame:
    """``memory.event_memory`` of a stream of ticks, appended as they happen. State is kept by view: its open events, whose
    windows and boxes are bounded, and which end or expire; the session must keep state in RocksDB (``PROVIDER``)."""
    types = ", ".join(f"{k} {ticks.schema[k].dataType.simpleString()}" for k in keys)
    return ticks.groupBy(*keys).transformWithState(EventMemory(rules, keys, tie), f"{types}, ts_s double, {memory.CHANGE}", "Append", "None")
