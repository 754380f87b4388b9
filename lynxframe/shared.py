"""The folder that a cluster shares, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local session may go without naming one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.gettempdir()
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


class Scratch:
    """Written tables that cut lineage: what an executor loses is read again, not computed again.

    What ``drop`` has not deleted goes when the driver's process ends, as results read these tables until then. ``tidy``:
    let go of the shuffle files of a step as soon as its table is written, for steps that shuffle whole texts.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = True):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark)}/lynxframe/{name}-{uuid.uuid4().hex}"
        self.count = 0
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        atexit.register(_delete, files, at)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` to the shared folder and return the table read back."""
        path, schema = self.path(), df.schema
        df.write.option("compression", "zstd").parquet(path)
        if self.tidy:
            self.release()
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``save`` that nothing reads any more."""
        jvm = self.spark._jvm
        for table in tables:
            at = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files of finished steps; it acts when the driver's heap is collected."""
        gc.collect()
        self.spark._jvm.System.gc()


def _delete(files, at) -> None:
    with contextlib.suppress(Exception):  # the session, or its JVM, may have ended before
        files.delete(at, True)


#: A key is hot if it has more than one in HOT of all rows, so there are fewer than HOT hot keys.
HOT = 1000


def hot_keys(counts: DataFrame, n: str = "n") -> DataFrame:
    """Of a row per key with its number of rows ``n``: the keys that hold more than one in HOT of all rows."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > max(1, total // HOT))


def hot_join(rows: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other`` (a short row a key) where few keys may hold most rows.

    ``hot``: keys from ``hot_keys``, fewer than HOT. Rows of hot keys stay where they are and get the broadcast rows of
    these keys; the others meet in a plain merge join. Null keys join nothing.
    """
    few = F.broadcast(hot.select(*keys).distinct())
    cold = rows.join(few, keys, "left_anti").join(other.hint("merge"), keys, how)
    warm = rows.join(few, keys, "left_semi").join(F.broadcast(other.join(few, keys, "left_semi")), keys, how)
    return cold.unionByName(warm)


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame, by: list[str], salts: int = 64) -> DataFrame:
    """As ``hot_join``, for an ``other`` whose rows are too long to broadcast: rows of a hot key are dealt over ``salts``
    places by the columns ``by``, and the key's row of ``other`` is sent to each of them."""
    few = F.broadcast(hot.select(*keys).distinct().withColumn("_hot", F.lit(True)))
    dealt = rows.join(few, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    copies = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    sent = other.join(few, keys, "left").withColumn("_salt", copies).drop("_hot")
    return dealt.join(sent.hint("merge"), [*keys, "_salt"]).drop("_salt")
