"""Jobs claimed from a stream: each micro-batch compares and sets the state of its targets in one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxframe.operators import targets


def claiming(root: str, target: str, kind: str = "bigint") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes the batch's requests with ``granted`` to ``root/jobs`` and what the targets are then to
    ``root/held``, each as the partition of its batch.

    A batch reads what earlier batches have held and overwrites its own partitions, so a batch that is run again, after a
    failure or by a restart, changes nothing, and no target ever has two active jobs.
    """
    schema = f"{target} {kind}, {targets.HELD}, batch bigint"

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/held")
        there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
        held = spark.read.schema(schema).parquet(f"{root}/held") if there else spark.createDataFrame([], schema)
        last = held.where(F.col("batch") < number).groupBy(target).agg(F.max_by(F.struct("active", "until"), "batch").alias("h")).select(target, "h.*")
        jobs, after = targets.claimed(batch, last, target)
        # The state first: a batch that broke off between the two is run again over the same state.
        after.write.mode("overwrite").parquet(f"{root}/held/batch={number}")
        jobs.write.mode("overwrite").parquet(f"{root}/jobs/batch={number}")

    return run
