"""Event counts by period, as a batch and as a stream, and a poll-and-process loop over a status column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions.numbers import floor_period

# The states of a suggestion.
WAITING, RUNNING, DONE, FAILED = "ATRAITER", "ENCOURS", "SUCCES", "ERREUR"


def batch_kpis(events: DataFrame, period: str = "day") -> DataFrame:
    return events.groupBy(floor_period(F.col("ts"), period).alias("period"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def stream_kpis(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Tumbling windows with a watermark; the state of a window is dropped once it is ``late`` behind."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("period"), "event_type", "n", "users")


def process_waiting(pending: DataFrame, apply: Callable[[DataFrame], DataFrame], key: str, status: str = "status") -> DataFrame:
    """One poll: waiting rows get the verdict of ``apply`` (key, ok); others keep their status. The next snapshot of the queue."""
    verdicts = apply(pending.filter(F.col(status) == WAITING)).select(key, F.when(F.col("ok"), DONE).otherwise(FAILED).alias("__pl_s"))
    return pending.join(verdicts, key, "left").withColumn(status, F.coalesce("__pl_s", status)).drop("__pl_s")
