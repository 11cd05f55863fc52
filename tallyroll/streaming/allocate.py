"""Continuous first-come allocation with give-back.

Each micro-batch runs the distributed batch operators against what earlier micro-batches left: request records, holders
and counters as bucketed key state, of which it reads the buckets of its own requests, users and campaigns. Answers equal a
sequential replay in arrival order, wherever micro-batches end: a request before a give-back does not see it, one after
it does. Campaigns without give-backs in a micro-batch take the closed form, the others the composed one; both spread
a campaign over tasks by segments of the log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyroll.constants import COMPENSATED, DECISION_ACCEPTED, DECISION_PERSISTENCE_FAILED
from tallyroll.operators.allocation import allocate, to_request_state
from tallyroll.operators.give_back import GIVE_BACK_KIND, REQUEST_KIND, answer_commands
from tallyroll.plans.segments import SEGMENT_ROWS
from tallyroll.plans.staging import cut, if_small, read_batches, write_batch
from tallyroll.schemas import REQUEST
from tallyroll.streaming.state import BUCKETS, MERGE_EVERY, KeyedState

# Stream rows: kind (REQUEST or COMPENSATE) and the request columns.
COMMAND = T.StructType([T.StructField("kind", T.StringType()), *REQUEST.fields])

_L, _I, _S, _T = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()
_DECISION = T.StructType([
    T.StructField(n, t) for n, t in (
        ("campaign_id", _L), ("user_id", _L), ("request_id", _S), ("arrived_at", _T), ("arrival_no", _L), ("code", _I),
        ("issue_sequence", _L), ("remaining", _L), ("decided_at", _T), ("repeated", T.BooleanType()))
])
_RECORD = T.StructType([
    T.StructField(n, t) for n, t in (
        ("campaign_id", _L), ("request_id", _S), ("user_id", _L), ("code", _I), ("lifecycle", _I), ("issue_sequence", _L),
        ("remaining", _L), ("decided_at", _T), ("updated_at", _T))
])
_HOLDER = T.StructType([T.StructField("campaign_id", _L), T.StructField("user_id", _L), T.StructField("holds", T.BooleanType())])
_COUNTER = T.StructType([T.StructField("campaign_id", _L), T.StructField("drawn", _L), T.StructField("returned", _L)])
_GIVEN_BACK = T.StructType([
    T.StructField("campaign_id", _L), T.StructField("request_id", _S), T.StructField("arrival_no", _L), T.StructField("result", _S),
    T.StructField("restored", _L), T.StructField("arrived_at", _T),
])


@dataclass(frozen=True)
class AllocationState:
    """What an allocation stream remembers."""

    records: KeyedState
    holders: KeyedState
    counters: KeyedState

    @classmethod
    def below(cls, spark: SparkSession, folder: str, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY) -> AllocationState:
        def state(name: str, schema: T.StructType, *keys: str) -> KeyedState:
            return KeyedState(spark, f"{folder}/state/{name}", schema, keys, buckets, merge_every)

        return cls(
            state("records", _RECORD, "campaign_id", "request_id"), state("holders", _HOLDER, "campaign_id", "user_id"),
            state("counters", _COUNTER, "campaign_id"))

    def each(self) -> tuple[KeyedState, ...]:
        return self.records, self.holders, self.counters


def _given_back(records: DataFrame, back: DataFrame) -> DataFrame:
    """Records after the give-backs that took place."""
    keys = ["campaign_id", "request_id"]
    done = back.filter(F.col("result") == "COMPENSATED").select(
        *keys, F.col("restored").alias("_restored"), F.col("arrived_at").alias("_at"), F.lit(True).alias("_back"))
    b = F.coalesce(F.col("_back"), F.lit(False))
    return records.join(done, keys, "left").withColumn(
        "code", F.when(b, DECISION_PERSISTENCE_FAILED).otherwise(F.col("code"))
    ).withColumn("lifecycle", F.when(b, COMPENSATED).otherwise(F.col("lifecycle"))).withColumn(
        "remaining", F.when(b, F.col("_restored")).otherwise(F.col("remaining"))).withColumn(
        "updated_at", F.when(b, F.col("_at")).otherwise(F.col("updated_at"))).withColumn("returned", b).drop("_back", "_restored", "_at")


def allocate_micro_batch(
    commands: DataFrame, number: int, folder: str, campaigns: DataFrame, state: AllocationState, segment_rows: int = SEGMENT_ROWS,
) -> None:
    """Answer one micro-batch and write what the next ones need to know."""
    spark = commands.sparkSession
    c = F.col
    for part in state.each():
        part.merge(number)
    records = cut(state.records.of(commands, number))
    holders = cut(state.holders.of(commands, number).filter("holds"))
    campaigns = cut(campaigns)
    counters = cut(state.counters.of(campaigns, number))
    standing = if_small(cut(
        campaigns.join(counters, "campaign_id", "left").fillna(0, ["drawn", "returned"])
        .withColumn("stock", c("total_stock") - c("drawn") + c("returned")).withColumn("sequence", c("drawn")).drop("drawn", "returned")
    ))
    # Rows are told apart by a broadcast where campaigns are few; a shuffle would gather a campaign in one task.
    mixed = if_small(cut(commands.filter(c("kind") == GIVE_BACK_KIND).select("campaign_id").distinct()))
    requests = cut(commands.filter(c("kind") == REQUEST_KIND).join(mixed, "campaign_id", "left_anti").select(REQUEST.fieldNames()))
    decided = allocate(requests, standing, records.drop("lifecycle", "updated_at"), holders, segment_rows)
    answered = cut(answer_commands(commands.join(mixed, "campaign_id", "left_semi"), standing, records, holders, segment_rows))
    decided = decided.unionByName(answered.filter(c("result").isNull()).select(_DECISION.fieldNames()))
    write_batch(decided, f"{folder}/decision", number)
    write_batch(answered.filter(c("result").isNotNull()).select(_GIVEN_BACK.fieldNames()), f"{folder}/give_back", number)

    mine = spark.read.schema(_DECISION).parquet(f"{folder}/decision/batch={number}")
    back = spark.read.schema(_GIVEN_BACK).parquet(f"{folder}/give_back/batch={number}")
    fresh = to_request_state(mine).select(_RECORD.fieldNames()).withColumn("fresh", F.lit(True))
    now = cut(_given_back(fresh.unionByName(records.withColumn("fresh", F.lit(False))), back).filter("fresh or returned"))
    state.records.update(now, number)
    served = c("code") == DECISION_ACCEPTED
    state.holders.update(now.filter(served | c("returned")).groupBy("campaign_id", "user_id").agg(F.bool_or(served).alias("holds")), number)
    moves = now.groupBy("campaign_id").agg(
        F.count(F.when(c("fresh") & (served | c("returned")), 1)).alias("drawn"), F.count(F.when(c("returned"), 1)).alias("returned"))
    totals = counters.join(moves.select("campaign_id"), "campaign_id", "left_semi").unionByName(moves).groupBy("campaign_id").agg(
        F.sum("drawn").alias("drawn"), F.sum("returned").alias("returned"))
    state.counters.update(totals, number)


def allocate_query(
    stream: DataFrame, folder: str, campaigns: DataFrame, available_now: bool = True, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY,
    segment_rows: int = SEGMENT_ROWS,
) -> StreamingQuery:
    """Start continuous allocation over a stream of :data:`COMMAND` rows."""
    state = AllocationState.below(stream.sparkSession, folder, buckets, merge_every)
    for part in state.each():
        part.start()

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            allocate_micro_batch(batch, number, folder, campaigns, state, segment_rows)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/position")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def decisions(spark, folder: str) -> DataFrame:
    """All answers given so far."""
    return read_batches(spark, f"{folder}/decision", _DECISION).drop("batch")


def give_backs(spark, folder: str) -> DataFrame:
    return read_batches(spark, f"{folder}/give_back", _GIVEN_BACK).drop("batch")
