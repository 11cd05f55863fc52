"""Accepted entries that do not show up in the store in time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyroll.functions.times import ts
from tallyroll.plans.staging import cut, read_batches, write_batch
from tallyroll.streaming.state import BUCKETS, MERGE_EVERY, KeyedState

_KEY = [T.StructField("event_id", T.LongType()), T.StructField("issue_sequence", T.LongType())]
_TIME = T.TimestampNTZType()
#: Rows of the stream: ENTRY with the time of its decision, or STORED with the time at which it was stored.
SIGHTING = T.StructType([T.StructField("kind", T.StringType()), *_KEY, T.StructField("at", _TIME)])
_ENTRY = T.StructType([*_KEY, T.StructField("decided_at", _TIME), T.StructField("open", T.BooleanType())])
_STORED = T.StructType([*_KEY, T.StructField("created_at", _TIME)])
ENTRY, STORED = "ENTRY", "STORED"


def unstored_entries(entries: DataFrame, stored: DataFrame, wait: str = "10 minutes", as_of: datetime | None = None) -> DataFrame:
    """Entries without a stored row from their decision to ``wait`` later.

    ``entries``: event_id, issue_sequence, decided_at. ``stored``: event_id, issue_sequence, created_at. With ``as_of``
    only entries whose waiting time has passed by then; otherwise all.
    """
    span = F.expr(f"INTERVAL {wait}")
    e, s = entries.alias("e"), stored.alias("s")
    within = (
        (F.col("e.event_id") == F.col("s.event_id")) & (F.col("e.issue_sequence") == F.col("s.issue_sequence"))
        & (F.col("s.created_at") >= F.col("e.decided_at")) & (F.col("s.created_at") <= F.col("e.decided_at") + span)
    )
    out = e.join(s, within, "left_anti").select("event_id", "issue_sequence", "decided_at")
    return out if as_of is None else out.filter(F.col("decided_at") + span < ts(as_of))


def _states(spark: SparkSession, folder: str, buckets: int, merge_every: int) -> tuple[KeyedState, KeyedState]:
    by = ("event_id", "issue_sequence")
    return (
        KeyedState(spark, f"{folder}/state/entries", _ENTRY, (*by, "decided_at"), buckets, merge_every, by),
        KeyedState(spark, f"{folder}/state/stored", _STORED, (*by, "created_at"), buckets, merge_every, by))


def track_query(
    rows: DataFrame, folder: str, wait: str = "10 minutes", buckets: int = BUCKETS, merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Keep the entries that still wait, whatever order entries and stored rows (:data:`SIGHTING`) come in.

    A micro-batch compares its entries with the stored rows seen so far, and its stored rows with the open entries, each in
    their buckets. An entry is closed when a stored row in its time is seen, and new snapshots leave closed entries out.
    """
    spark = rows.sparkSession
    entries, stored = _states(spark, folder, buckets, merge_every)
    entries.start()
    stored.start()

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            entries.merge(number, F.col("open"))
            stored.merge(number)
            came = batch.filter(F.col("kind") == ENTRY).select("event_id", "issue_sequence", F.col("at").alias("decided_at")).distinct()
            kept = batch.filter(F.col("kind") == STORED).select("event_id", "issue_sequence", F.col("at").alias("created_at")).distinct()
            waiting = entries.of(kept, number).filter("open").drop("open").unionByName(came).distinct()
            waiting = cut(waiting)
            seen = stored.of(came, number).unionByName(kept)
            left = unstored_entries(waiting, seen, wait).withColumn("left", F.lit(True))
            same = [F.col(f"w.{k}").eqNullSafe(F.col(f"l.{k}")) for k in ("event_id", "issue_sequence", "decided_at")]
            judged = waiting.alias("w").join(left.alias("l"), same[0] & same[1] & same[2], "left").select("w.*", F.col("l.left").isNotNull().alias("open"))
            entries.update(judged, number)
            stored.update(kept, number)
            write_batch(spark.range(1).select(F.lit(number).cast("long").alias("number")), f"{folder}/done", number)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/position").trigger(availableNow=True).start()


def unstored_so_far(
    spark: SparkSession, folder: str, wait: str = "10 minutes", as_of: datetime | None = None, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY,
) -> DataFrame:
    """The entries that wait after everything the stream has brought; reads open entries, not stored rows."""
    done = read_batches(spark, f"{folder}/done", T.StructType([T.StructField("number", T.LongType())])).agg(F.max("batch")).first()[0]
    entries, _ = _states(spark, folder, buckets, merge_every)
    out = entries.all(0 if done is None else done + 1).filter("open").drop("open")
    return out if as_of is None else out.filter(F.col("decided_at") + F.expr(f"INTERVAL {wait}") < ts(as_of))
