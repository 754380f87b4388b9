"""Structured Streaming operators, and their replay over a table that is there already."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxframe.shared import Scratch
from lynxframe.streaming.memory import PROVIDER


def tumbling(rows: DataFrame, ts: str, keys: list[str], length: str, late: str, **aggregates: Column) -> DataFrame:
    """Aggregates per key and window, emitted once the watermark has passed the window's end."""
    out = rows.withWatermark(ts, late).groupBy(*keys, F.window(ts, length)).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("window.start").alias("start"), *aggregates)


def sessions(rows: DataFrame, ts: str, keys: list[str], gap: str, late: str, **aggregates: Column) -> DataFrame:
    """Aggregates per key and session (a pause of ``gap`` ends it), emitted once the watermark has passed its end."""
    out = rows.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("window")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *aggregates)


def once_per_key(rows: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Keys as they first occur; ``ts`` is one of them, so state older than the watermark goes."""
    return rows.withWatermark(ts, late).dropDuplicates([ts, *keys])


def replay(spark: SparkSession, folder: str, files: str, schema, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a streaming operator over a table until it is used up, and return what it appended.

    The table: the files of ``folder`` whose names match ``files``, or all part files below it if ``files`` is a folder there.
    """
    root = Scratch(spark, "stream").root
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{files}")
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at) or []
    if any(x.isDirectory() for x in found):
        source = spark.readStream.schema(schema).parquet(f"{folder}/{files}")
    else:
        source = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    out = operator(source)
    sink = out.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode("append")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


def _slices(rows: DataFrame, ts: str, slices: int | list[float]) -> Iterator[DataFrame]:
    """Rows by ``ts``: so many slices of like size, or those that end at the given values."""
    if isinstance(slices, int):
        shares = [k / slices for k in range(1, slices)]
        slices = rows.agg(F.percentile_approx(ts, shares, 1000)).first()[0] if shares else []
    edges = [None, *(slices or []), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows if low is None else rows.where(F.col(ts) > low)
        if high is not None:
            part = part.where((F.col(ts) <= high) | (F.col(ts).isNull() if low is None else F.lit(False)))
        yield part


def replay_slices(rows: DataFrame, ts: str, operator: Callable[[DataFrame], DataFrame], slices: int | list[float] = 3) -> DataFrame:
    """Run a streaming operator over ``rows`` as if they arrived by time: one slice of their time after the other is put
    into the folder that the stream reads, and each run goes on from the checkpoint of the one before. Returns what it
    appended in all. Null times come with the first slice."""
    spark = rows.sparkSession
    root = Scratch(spark, "slices").root
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    out = None
    for part in _slices(rows, ts, slices):
        part.write.mode("append").parquet(f"{root}/given")
        out = operator(spark.readStream.schema(rows.schema).parquet(f"{root}/given"))
        sink = out.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode("append")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


def replay_batches(rows: DataFrame, ts: str, each: Callable[[str], Callable[[DataFrame, int], None]], slices: int | list[float] = 3) -> str:
    """As ``replay_slices`` for ``foreachBatch``: ``each(folder)`` handles the batches; returns the folder."""
    spark = rows.sparkSession
    root = Scratch(spark, "batches").root
    for part in _slices(rows, ts, slices):
        part.write.mode("append").parquet(f"{root}/given")
        sink = spark.readStream.schema(rows.schema).parquet(f"{root}/given").writeStream.foreachBatch(each(f"{root}/out")).option("checkpointLocation", f"{root}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    return f"{root}/out"
