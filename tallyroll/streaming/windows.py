"""Counts per time window, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyroll.plans.staging import read_batches, write_batch

# Reasons reported by name; every other reason is reported as UNKNOWN.
NAMED_REASONS = ("SOLD_OUT", "ALREADY_ISSUED", "EVENT_NOT_OPEN")
COUNTS = T.StructType([
    T.StructField("window_start", T.TimestampNTZType()), T.StructField("campaign_id", T.LongType()), T.StructField("reason", T.StringType()),
    T.StructField("failures", T.LongType())])


def failure_windows(failed: DataFrame, width: str = "5 seconds") -> DataFrame:
    """Refused requests per window, campaign and reason. ``failed``: campaign_id, at, reason."""
    reason = F.when(F.col("reason").isin(*NAMED_REASONS), F.col("reason")).otherwise("UNKNOWN")
    return (
        failed.withColumn("reason", reason)
        .groupBy(F.window("at", width).alias("w"), "campaign_id", "reason").agg(F.count(F.lit(1)).alias("failures"))
        .select(F.col("w.start").alias("window_start"), "campaign_id", "reason", "failures")
    )


def failure_windows_query(failed: DataFrame, folder: str, width: str = "5 seconds") -> StreamingQuery:
    """Each micro-batch writes its own counts; ``window_totals`` adds them up.

    Counts add, so a row may come as late as it likes, and no window has to be kept open or given up.
    """

    def run(batch: DataFrame, number: int) -> None:
        write_batch(failure_windows(batch, width).select(COUNTS.fieldNames()), f"{folder}/counts", number)

    return failed.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/position").trigger(availableNow=True).start()


def window_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of everything read so far: the batch result over the same rows."""
    return read_batches(spark, f"{folder}/counts", COUNTS).groupBy("window_start", "campaign_id", "reason").agg(F.sum("failures").alias("failures"))
