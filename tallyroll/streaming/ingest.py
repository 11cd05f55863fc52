"""Stream -> store -> confirm -> acknowledge, with redelivery: at-least-once input, exactly-once effect.

A micro-batch consults what the ledger held at the start and what earlier ones stored, as bucketed key state: it reads
the buckets of its own keys only. Stored entries are confirmed: request records and campaign counters move on. Entries that
can't be stored are left to be delivered again until the limit of deliveries; then, if a probe finds their request absent,
they are given back and acknowledged. A repeated micro-batch computes the same rows and replaces its own output.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyroll.constants import MAX_DELIVERY_ATTEMPTS
from tallyroll.functions.ids import message_id, packed, unpacked
from tallyroll.operators.persistence import (
    apply_answers, classify_against, classify_delivery, compensate, confirm, counter_deltas, key_rows, persist_issues, probe, stored_requests,
    taken_keys,
)
from tallyroll.plans.staging import kept, read_batches, write_batch
from tallyroll.schemas import ISSUE, STREAM_ENTRY
from tallyroll.sources.stream import parse_issue_entries
from tallyroll.streaming.state import BUCKETS, MERGE_EVERY, KeyedState

_L, _I, _S, _T = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


IDENTITY = ("entry_id", "event_id", "request_id", "user_id", "issue_sequence")
STORED_REQUEST = _schema(request_id=_S, event_id=_L, user_id=_L, issue_sequence=_L)
TAKEN_KEY = _schema(key=_S)
RECORD = _schema(campaign_id=_L, request_id=_S, user_id=_L, code=_I, lifecycle=_I, remaining=_L, updated_at=_T)
ATTEMPT = _schema(entry_id=_S, event_id=_L, request_id=_S, user_id=_L, issue_sequence=_L, attempts=_L)
COUNTER = _schema(campaign_id=_L, confirmed=_L, returned=_L)
#: One row for each entry of a micro-batch: outcome, deliveries so far if it can't be stored, what is done, and the answer to that.
OUTCOME = _schema(entry_id=_S, event_id=_L, request_id=_S, user_id=_L, issue_sequence=_L, outcome=_S, attempts=_L, action=_S, answer=_S)
STORED = ("INSERT", "ABSORBED")
CONFIRMED_ANSWERS = ("CONFIRMED_NOW", "ALREADY_CONFIRMED")


@dataclass(frozen=True)
class StoreState:
    """What a storing stream remembers."""

    requests: KeyedState
    keys: KeyedState
    records: KeyedState
    attempts: KeyedState
    counters: KeyedState

    @classmethod
    def below(cls, spark: SparkSession, folder: str, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY) -> StoreState:
        def state(name: str, schema: T.StructType, *keys: str, once: bool = False) -> KeyedState:
            return KeyedState(spark, f"{folder}/state/{name}", schema, keys, buckets, merge_every, once=once)

        return cls(
            state("requests", STORED_REQUEST, "request_id", once=True), state("keys", TAKEN_KEY, "key", once=True),
            state("records", RECORD, "campaign_id", "request_id"), state("attempts", ATTEMPT, *IDENTITY), state("counters", COUNTER, "campaign_id"))

    def start(self, issue: DataFrame | None, records: DataFrame | None) -> None:
        """The state before the stream: an existing ledger's keys and the request records as they stand."""
        self.requests.start(None if issue is None else stored_requests(issue))
        self.keys.start(None if issue is None else taken_keys(issue))
        self.records.start(records)
        self.attempts.start()
        self.counters.start()

    def merge(self, batch: int) -> None:
        for state in (self.requests, self.keys, self.records, self.attempts, self.counters):
            state.merge(batch)


def place(entry_id: str = "entry_id", event_id: str = "event_id", issue_sequence: str = "issue_sequence") -> Column:
    """An entry's place in the stream: milliseconds, number in the millisecond, content.

    A struct, so it orders as the stream does and needs no global numbering.
    """
    parts = F.split(F.col(entry_id), "-")
    return F.struct(
        parts[0].try_cast("bigint").alias("ms"), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("n"),
        F.col(event_id).alias("event_id"), "request_id", "user_id", F.col(issue_sequence).alias("issue_sequence"))


def with_arrival(entries: DataFrame) -> DataFrame:
    """Distinct entries, and how often they came. A request's entries lie together, so that its rows can be told apart without a shuffle."""
    return entries.select(*IDENTITY, "decided_at").repartition("request_id").groupBy(*IDENTITY).agg(
        F.min("decided_at").alias("decided_at"), F.count("*").alias("deliveries"))


def with_place(entries: DataFrame) -> DataFrame:
    """Entries with what follows from their other columns: the place in the stream and the message's id."""
    return entries.withColumn("arrival_no", place()).withColumn("message_id", message_id(F.col("event_id"), F.col("entry_id")))


def _readable(rows: DataFrame) -> DataFrame:
    """Rows with their request id as text; inside of a micro-batch it is packed."""
    return rows.withColumn("request_id", unpacked(F.col("request_id")))


def _failed(judged: DataFrame, state: StoreState, batch: int, limit: int) -> DataFrame:
    """Entries that couldn't be stored, with their deliveries so far, what to do and whether that is due in this micro-batch."""
    rows = judged.filter(~F.col("outcome").isin(*STORED)).select(*IDENTITY, "outcome", "deliveries", "stored")
    # As one column, in which a missing part is a part like others.
    me = F.struct(*IDENTITY).alias("_me")
    before = state.attempts.near(_readable(rows), batch, "request_id").select(me, F.col("attempts").alias("_attempts"))
    earlier = F.coalesce("_attempts", F.lit(0))
    counted = rows.drop("stored").withColumn("_me", me).join(before, "_me", "left").drop("_me").withColumn("earlier", earlier).withColumn(
        "attempts", earlier + F.col("deliveries")).drop("_attempts")
    # What is stored of their requests: by the ledger before, or by this micro-batch.
    requests = rows.filter(F.col("stored").isNotNull()).select("request_id", "stored.*").distinct()
    mine = judged.filter(F.col("outcome") == "INSERT").select(requests.columns)
    probed = probe(counted, requests.unionByName(mine)).withColumn("stage", F.lit("RELAY"))
    decided = classify_delivery(probed, limit)
    # Acknowledged at the limit: what comes after that is not acted on again.
    return decided.withColumn("action", F.when(F.col("earlier") >= limit, "IGNORE").otherwise(F.col("action")))


def persist_batch(
    entries: DataFrame, batch: int, folder: str, event: DataFrame, coupon: DataFrame, now: datetime, state: StoreState | None = None,
    limit: int = MAX_DELIVERY_ATTEMPTS,
) -> None:
    """Store one micro-batch: new issues, first history rows, answers to requests, redeliveries, malformed entries.

    Confirmations of a micro-batch come before its give-backs.
    """
    spark = entries.sparkSession
    if state is None:
        state = StoreState.below(spark, folder)
        state.start(None, None)
    state.merge(batch)
    good, bad = parse_issue_entries(entries.select([f.name for f in STREAM_ENTRY.fields]))
    # What is stored of the entries' requests, and which keys of entries that could be new are taken: joined as found, by the key.
    requests = state.requests.near(good, batch, "request_id")
    issues, history, judged = persist_issues(
        with_arrival(good.withColumn("request_id", packed(F.col("request_id")))), None, event, coupon, now,
        lambda rows: kept(classify_against(rows, requests, lambda keys: state.keys.near(keys, batch), with_place, True), "judged"), with_place)
    write_batch(_readable(issues).select(ISSUE.fieldNames()), f"{folder}/issue", batch)
    mine = spark.read.schema(ISSUE).parquet(f"{folder}/issue/batch={batch}")
    write_batch(history.withColumn("event_uid", unpacked(F.col("event_uid"))), f"{folder}/history", batch)
    state.requests.update(mine.select(STORED_REQUEST.fieldNames()), batch)
    # What was stored just now shares no key.
    state.keys.update(key_rows(mine), batch)

    failed = kept(_failed(judged, state, batch, limit), "failed")
    state.attempts.update(_readable(failed).select(*IDENTITY, "attempts"), batch)

    command = [F.col("event_id").alias("campaign_id"), "request_id", "user_id", *[F.col(c).alias(f"_{c}") for c in ("entry_id", "issue_sequence")]]
    order = place("_entry_id", "campaign_id", "_issue_sequence")
    stored = judged.filter(F.col("outcome").isin(*STORED)).select(*command, "outcome")
    given_up = failed.filter(F.col("action") == "COMPENSATE_AND_ACK").select(*command, "outcome", "attempts")
    confirmed = kept(confirm(state.records.near(_readable(stored), batch, "request_id"), stored, order, carry=True), "confirmed")
    # Give-backs meet the records as confirmations leave them.
    after = apply_answers(state.records.near(_readable(given_up), batch, "request_id"), confirmed, "confirm_result", now)
    returned = kept(compensate(after, given_up, order, carry=True), "returned")

    def moved(answers: DataFrame, result: str, done: str) -> DataFrame:
        acted = answers.filter(F.col(result) == done).select("campaign_id", "request_id", "record.*")
        return apply_answers(acted, answers, result, now).select(RECORD.fieldNames())

    state.records.update(
        _readable(moved(confirmed, "confirm_result", "CONFIRMED_NOW").unionByName(moved(returned, "compensate_result", "COMPENSATED"))), batch)
    moves = counter_deltas(confirmed, returned)
    totals = state.counters.of(moves, batch).unionByName(moves).groupBy("campaign_id").agg(
        F.sum("confirmed").alias("confirmed"), F.sum("returned").alias("returned"))
    state.counters.update(totals, batch)

    back = [F.col("_entry_id").alias("entry_id"), F.col("campaign_id").alias("event_id"), "request_id", "user_id", F.col("_issue_sequence").alias("issue_sequence"), "outcome"]
    left = failed.filter(F.col("action") != "COMPENSATE_AND_ACK")
    skipped = F.when(F.col("action") == "ACK", "SKIPPED_PERSISTED").when(F.col("action") == "KEEP", "SKIPPED_UNVERIFIED")
    rows = (
        confirmed.select(*back, F.lit(None).cast("long").alias("attempts"), F.lit("ACK").alias("action"), F.col("confirm_result").alias("answer"))
        .unionByName(returned.select(*back, "attempts", F.lit("COMPENSATE_AND_ACK").alias("action"), F.col("compensate_result").alias("answer")))
        .unionByName(left.select(*IDENTITY, "outcome", "attempts", "action", skipped.alias("answer")))
    )
    write_batch(_readable(rows).select(OUTCOME.fieldNames()), f"{folder}/outcome", batch)
    write_batch(bad, f"{folder}/malformed", batch)


def persist_query(
    stream: DataFrame, folder: str, event: DataFrame, coupon: DataFrame, now: datetime, available_now: bool = True,
    issue: DataFrame | None = None, records: DataFrame | None = None, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY,
    limit: int = MAX_DELIVERY_ATTEMPTS,
) -> StreamingQuery:
    """Start the storing query; its checkpoint below ``folder`` is the read position.

    ``issue`` is the ledger as it stands, ``records`` the request records (:data:`RECORD`); both are read once, when the
    stream starts for the first time.
    """
    state = StoreState.below(stream.sparkSession, folder, buckets, merge_every)
    state.start(issue, records)

    def run(batch: DataFrame, number: int) -> None:
        # Read from its source each time: the raw text would take more room than all that is made of it.
        persist_batch(batch, number, folder, event, coupon, now, state, limit)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/position")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What was done with every entry, micro-batch by micro-batch."""
    return read_batches(spark, f"{folder}/outcome", OUTCOME)


def batches_done(spark: SparkSession, folder: str) -> int:
    """Number of the next micro-batch."""
    last = outcomes(spark, folder).agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """Rows for the failure ledger: rejected confirmations, and entries whose deliveries came to an end."""
    o = outcomes(spark, folder)
    ended = F.col("action").isin("COMPENSATE_AND_ACK", "KEEP") | (F.col("attempts").isNotNull() & (F.col("action") == "ACK"))
    return o.filter(ended | (F.col("outcome").isin(*STORED) & ~F.col("answer").isin(*CONFIRMED_ANSWERS))).select(
        F.col("event_id"), "user_id", "request_id", "issue_sequence", F.when(F.col("outcome").isin(*STORED), "CONFIRM").otherwise("RELAY").alias("failure_stage"),
        F.col("answer").alias("compensation_result"), "batch")
