"""Dropping entries delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyroll.plans.staging import cut, read_batches, write_batch
from tallyroll.streaming.state import BUCKETS, MERGE_EVERY, KeyedState

SEEN = T.StructType([T.StructField("message_id", T.StringType()), T.StructField("at", T.TimestampNTZType())])
_LATE = T.StructType([T.StructField("message_id", T.StringType()), T.StructField("at", T.TimestampNTZType())])


def drop_redelivered(entries: DataFrame) -> DataFrame:
    """One row per message id."""
    return entries.dropDuplicates(["message_id"])


def drop_redelivered_query(
    entries: DataFrame, folder: str, at: str | None = None, retention: str | None = None, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """First deliveries into ``folder``/out; a micro-batch looks its ids up in their buckets only.

    Without ``retention`` ids are remembered for good. With it (an interval such as "168 HOURS" on the time column ``at``), new snapshots
    leave out ids older than that, seen from the newest one. No delivery is dropped for being late: one that comes so late that its
    id may be forgotten is passed on, and listed in ``folder``/late.
    """
    spark = entries.sparkSession
    state = KeyedState(spark, f"{folder}/state/ids", SEEN, ("message_id",), buckets, merge_every)
    state.start()
    time = F.col(at) if at else F.lit(None).cast("timestamp_ntz")

    def run(batch: DataFrame, number: int) -> None:
        oldest = None
        if retention:
            newest = read_batches(spark, f"{folder}/newest", SEEN, number).agg(F.max("at")).first()[0]
            oldest = None if newest is None else F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {retention}")
        state.merge(number, None if oldest is None else F.coalesce(F.col("at") >= oldest, F.lit(True)))
        seen = cut(state.of(batch.select(F.col("message_id").cast("string").alias("message_id")), number))
        ids = F.col("message_id").cast("string")
        fresh = drop_redelivered(batch).join(seen.select(F.col("message_id").alias("_seen")), ids.eqNullSafe(F.col("_seen")), "left_anti").select(batch.columns)
        write_batch(fresh, f"{folder}/out", number)
        kept = spark.read.schema(fresh.schema).parquet(f"{folder}/out/batch={number}").select(ids.alias("message_id"), time.alias("at"))
        state.update(kept, number)
        if retention:
            write_batch(kept.agg(F.lit(None).cast("string").alias("message_id"), F.max("at").alias("at")), f"{folder}/newest", number)
            write_batch(kept.filter(F.lit(False) if oldest is None else F.col("at") < oldest), f"{folder}/late", number)

    return entries.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/position").trigger(availableNow=True).start()


def first_deliveries(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return read_batches(spark, f"{folder}/out", schema).drop("batch")


def late_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries passed on although an earlier one of theirs may have been forgotten."""
    return read_batches(spark, f"{folder}/late", _LATE)
