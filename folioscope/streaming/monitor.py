"""The monitor as a stream: findings that arrive as files are folded into the history run by run.

An extension: the checks themselves are batch jobs. `Trigger.AvailableNow` makes a scheduled job of it, and the checkpoint remembers
which files were folded in, so that a restart counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.runs import fingerprint


def fold(spark: SparkSession, findings_dir: str, schema: str, out: str, checkpoint: str) -> None:
    """Adds each new run's distinct fingerprints, with their worst level, to the table at `out`, partitioned by `epoch` and run.

    A batch is a partition of its own, which a repeated batch writes anew, so a restart between the write and the stream's own
    commit counts nothing twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
        rows = batch.groupBy("run_id", fingerprint().alias("fingerprint")).agg(F.min(rank).alias("worst"), F.count("*").alias("n"))
        rows.write.mode("overwrite").partitionBy("run_id").parquet(f"{out}/epoch={epoch}")

    stream = spark.readStream.schema(schema).parquet(findings_dir)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Findings by check in windows of their run's time, for a stream with `run_ts`; later ones than the watermark are left out."""
    return events.withWatermark("run_ts", late).groupBy(F.window("run_ts", width), "check_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "check_id", "n")
