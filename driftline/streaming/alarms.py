"""Alarm load while events still arrive.

Each micro-batch adds to one small cell per key, run and window of event time. A cell is kept in the state
store until the watermark has passed its window, so state is bounded by runs and lateness and not by events.
Cells that a batch changed are written under the number of the batch: a batch that is repeated after a failure
replaces its own folder, and readers take each cell from the last batch that wrote it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.episodes import load_of_runs

BATCH = "batch"


def alarm_cells(stream: DataFrame, keys: Sequence[str], window: str, lateness: str) -> DataFrame:
    """Alarms, first and last stamp of each run and window. Rows without a stamp belong to no window and take
    no part; rows more than ``lateness`` behind the latest stamp may be dropped."""
    stamped = stream.withColumn("_at", F.timestamp_micros("t_us")).withWatermark("_at", lateness)
    return stamped.groupBy(F.window("_at", window).alias("_w"), *keys, "run_id").agg(
        F.sum("pred").alias("alarms"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")
    ).select(F.col("_w.start").alias("window_start"), *keys, "run_id", "alarms", "first_us", "last_us")


def follow(cells: DataFrame, folder: str, state: str) -> None:
    """Take in all that has arrived, write the changed cells below ``folder``, and stop. The next call goes on
    where this one ended, as recorded in ``state``. Both folders must be shared by all executors."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{BATCH}={number}")

    writer = cells.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()


def latest_cells(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Each cell as the last batch left it."""
    written = spark.read.option("basePath", folder).parquet(f"{folder}/{BATCH}=*")
    values = F.struct("alarms", "first_us", "last_us")
    last = written.groupBy("window_start", *keys, "run_id").agg(F.max_by(values, F.col(BATCH)).alias("_v"))
    return last.select("window_start", *keys, "run_id", "_v.*")


def live_alarm_load(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The alarm load so far, in the columns of ``episodes.alarm_load``."""
    per_run = cells.groupBy(*keys, "run_id").agg(
        F.sum("alarms").alias("_alarms"), (F.max("last_us") - F.min("first_us")).alias("_span")
    )
    return load_of_runs(per_run, keys)
