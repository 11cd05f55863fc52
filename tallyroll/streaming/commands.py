"""Coupon commands as a stream, applied in order against the coupons as they stand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyroll.operators.commands import run_commands
from tallyroll.operators.recovery import apply_changes
from tallyroll.plans.staging import kept, read_batches, write_batch
from tallyroll.streaming.state import BUCKETS, MERGE_EVERY, KeyedState

_L, _S, _T = T.LongType(), T.StringType(), T.TimestampNTZType()


def _schema(*columns):
    return T.StructType([T.StructField(n, t) for n, t in columns])


COMMAND = _schema(
    ("command_no", _L), ("event_uid", _S), ("issue_id", _L), ("user_id", _L), ("target_status", _S), ("reason", _S), ("at", _T))
_COUPON = _schema(
    ("issue_id", _L), ("event_id", _L), ("user_id", _L), ("status", _S), ("valid_from", _T), ("valid_to", _T), ("used_at", _T), ("canceled_at", _T))
_DONE = _schema(("event_uid", _S), ("issue_id", _L), ("user_id", _L), ("target_status", _S), ("from_status", _S), ("occurred_at", _T))
_RESULT = _schema(
    ("command_no", _L), ("event_uid", _S), ("issue_id", _L), ("event_id", _L), ("user_id", _L), ("target_status", _S), ("reason", _S),
    ("at", _T), ("previous_status", _S), ("result", _S))


@dataclass(frozen=True)
class CommandState:
    """Coupons as they stand, and the commands that succeeded by key."""

    coupons: KeyedState
    done: KeyedState

    @classmethod
    def below(cls, spark: SparkSession, folder: str, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY) -> CommandState:
        return cls(
            KeyedState(spark, f"{folder}/state/coupons", _COUPON, ("issue_id",), buckets, merge_every),
            KeyedState(spark, f"{folder}/state/done", _DONE, ("event_uid",), buckets, merge_every))


def command_batch(cmds: DataFrame, number: int, folder: str, state: CommandState) -> None:
    """Apply one micro-batch; only commands that succeeded are remembered by key.

    Read are the buckets of the coupons and keys that the micro-batch names.
    """
    spark = cmds.sparkSession
    state.coupons.merge(number)
    state.done.merge(number)
    coupons = kept(state.coupons.of(cmds, number), "coupons")
    done = state.done.all(number, state.done.touched(cmds))
    updates, history, results, repeats = run_commands(coupons, cmds, done)
    write_batch(results, f"{folder}/result", number)
    write_batch(history, f"{folder}/history", number)
    write_batch(repeats.select("command_no", "event_uid", "replay"), f"{folder}/replayed", number)
    updates = kept(updates, "updates")
    state.coupons.update(apply_changes(coupons.join(updates.select("issue_id"), "issue_id", "left_semi"), "issue_id", updates), number)
    mine = spark.read.schema(_RESULT).parquet(f"{folder}/result/batch={number}").filter(F.col("result") == "SUCCESS")
    state.done.update(mine.select(
        "event_uid", "issue_id", "user_id", "target_status", F.col("previous_status").alias("from_status"), F.col("at").alias("occurred_at")), number)


def command_query(
    stream: DataFrame, folder: str, issue: DataFrame, available_now: bool = True, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Start the command stream; ``issue`` is read once, when it starts for the first time."""
    state = CommandState.below(stream.sparkSession, folder, buckets, merge_every)
    state.coupons.start(issue.select(_COUPON.fieldNames()))
    state.done.start()

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            command_batch(batch, number, folder, state)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/position")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_coupons(spark: SparkSession, folder: str, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY) -> DataFrame:
    """All coupons as the stream has left them so far."""
    last = read_batches(spark, f"{folder}/result", _RESULT).agg(F.max("batch")).first()[0]
    return CommandState.below(spark, folder, buckets, merge_every).coupons.all(0 if last is None else last + 1)


def results(spark, folder: str) -> DataFrame:
    return read_batches(spark, f"{folder}/result", _RESULT).drop("batch")


def repeats(spark, folder: str) -> DataFrame:
    """Commands that an earlier one with their key answers."""
    return read_batches(spark, f"{folder}/replayed", _schema(("command_no", _L), ("event_uid", _S), ("replay", _S))).drop("batch")
