"""Live health of many streams: a row as a stream's health changes, also when it falls silent; and rows that come too late."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGE = "ts_s double, health string, before string"
LATE = "late_by double, reason string"


class _Monitor(StatefulProcessor):
    """State of a stream: its last health and when it was last heard of; a timer waits for the silence that stalls it."""

    def __init__(self, key: str, tie: str, silence: float, stalled: str):
        self.key, self.tie, self.silence, self.stalled = key, tie, silence, stalled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "heard double, health string")

    def _move(self, made, key, state: list, at: float, health: str) -> Iterator[Row]:
        if health != state[1]:
            yield made(*key, at, health, state[1])
            state[1] = health

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        made = Row(self.key, *[c.split()[0] for c in CHANGE.split(", ")])
        state = list(self.last.get()) if self.last.exists() else [None, None]
        for row in sorted(rows, key=lambda r: (r["ts_s"], r[self.tie])):
            if state[0] is not None and row["ts_s"] - state[0] > self.silence:
                yield from self._move(made, key, state, state[0] + self.silence, self.stalled)
            state[0] = row["ts_s"] if state[0] is None else max(state[0], row["ts_s"])
            yield from self._move(made, key, state, row["ts_s"], row["health"])
        self.last.update(tuple(state))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((state[0] + self.silence) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        made = Row(self.key, *[c.split()[0] for c in CHANGE.split(", ")])
        state = list(self.last.get())
        if expiredTimerInfo.getExpiryTimeInMs() > (state[0] + self.silence) * 1000:
            yield from self._move(made, key, state, state[0] + self.silence, self.stalled)
            self.last.update(tuple(state))

    def close(self) -> None:
        pass


def changes(rows: DataFrame, key: str, ts: str, tie: str, silence: float, late: str, stalled: str = "stalled") -> DataFrame:
    """``CHANGE`` of each key of a stream of rows (key, the timestamp ``ts``, ts_s, ``tie``, health): a row whenever the
    health differs from the one before, and one called ``stalled`` when nothing has come for ``silence`` seconds, by the
    rows' own clock: at once if a later row shows it, else as the watermark (``late`` behind the newest row of all) passes
    that time. A key's state is two values and a timer."""
    kind = rows.schema[key].dataType.simpleString()
    seen = rows.where(F.col("ts_s").isNotNull() & F.col("health").isNotNull()).withWatermark(ts, late)
    return seen.groupBy(key).transformWithState(_Monitor(key, tie, silence, stalled), f"{key} {kind}, {CHANGE}", "Append", "EventTime")


def in_time(root: str, key: str, tie: str, kind: str = "string") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows of each key whose clock ts_s rises over all batches go to ``root/rows``; the others to
    ``root/late`` with how far behind they are and why (late, repeated, no clock), and their number to ``root/counts``.

    Each is written as the partition of its batch and only read by later ones, so a batch that is run again changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = f"{key} {kind}, high double, batch bigint"
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/clocks")
        there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
        clocks = spark.read.schema(schema).parquet(f"{root}/clocks") if there else spark.createDataFrame([], schema)
        high = clocks.where(F.col("batch") < number).groupBy(F.col(key).alias("_key")).agg(F.max("high").alias("_high"))
        first = F.min(F.struct(tie)).alias("_first")
        firsts = batch.groupBy(F.col(key).alias("_k"), F.col("ts_s").alias("_t")).agg(first)
        met = batch.join(high, F.col(key).eqNullSafe(F.col("_key")), "left").join(firsts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("ts_s") == F.col("_t")), "left")
        reason = F.when(F.col("ts_s").isNull(), "no clock").when(F.col("ts_s") <= F.col("_high"), "late").when(F.col(tie) != F.col(f"_first.{tie}"), "repeated")
        marked = met.select(*batch.columns, (F.col("_high") - F.col("ts_s")).alias("late_by"), reason.alias("reason"))
        now = batch.groupBy(key).agg(F.max("ts_s").alias("high")).where("high is not null")
        now.write.mode("overwrite").parquet(f"{root}/clocks/batch={number}")
        marked.where("reason is null").drop("late_by", "reason").write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        marked.where("reason is not null").write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        marked.groupBy(key).agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("refused")).write.mode("overwrite").parquet(f"{root}/counts/batch={number}")

    return run
