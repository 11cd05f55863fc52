"""Storing accepted requests once, confirming and giving back, and probing what was stored."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroll.constants import (
    ACTOR_SYSTEM, CLAIM_IDLE_SECONDS, COMPENSATED, CONFIRMED, DECISION_ACCEPTED,
    DECISION_PERSISTENCE_FAILED, ISSUED, MAX_DELIVERY_ATTEMPTS, PENDING, REASON_ISSUE_CONFIRMED, RETENTION_HOURS,
)
from tallyroll.functions.ids import packed
from tallyroll.functions.times import hours, plus, ts
from tallyroll.plans.segments import number_segment, ranked
from tallyroll.plans.staging import cut, if_small, kept, matching


# Sequences stay below this number, so ids of different campaigns never meet.
ISSUE_ID_SPAN = 1 << 32
# Issue sequences are 32-bit numbers.
MAX_SEQUENCE = (1 << 31) - 1


def with_valid_to(entries: DataFrame, event: DataFrame, coupon: DataFrame) -> DataFrame:
    """End of validity: decision time plus the coupon's valid hours."""
    rules = if_small(event.select("event_id", "coupon_id").join(coupon.select("coupon_id", "valid_hours"), "coupon_id").drop("coupon_id"))
    return entries.join(rules, "event_id", "left").withColumn(
        "valid_to", plus(F.col("valid_from"), F.col("valid_hours"), "HOUR")
    ).drop("valid_hours")


UNIQUE_KEYS = (("event_id", "user_id"), ("event_id", "issue_sequence"), ("message_id",))


def key_rows(rows: DataFrame, *extra: str) -> DataFrame:
    """One row per unique key a row holds; keys with a missing part hold nothing."""
    keys = [
        F.when(
            reduce(and_, [F.col(c).isNotNull() for c in columns]),
            F.concat_ws(":", F.lit(str(i)), *[F.col(c).cast("string") for c in columns]),
        )
        for i, columns in enumerate(UNIQUE_KEYS)
    ]
    return rows.select(*extra, F.explode(F.array_compact(F.array(*keys))).alias("key"))


def _jumped(links: DataFrame) -> DataFrame:
    """node, root, flips: each link followed to an entry that has none; the way seen doubles with every join."""
    links = kept(links)
    while True:
        further = links.select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("flips").alias("_flips"))
        if links.join(further, "root", "left_semi").isEmpty():
            return links
        links = kept(links.join(further, "root", "left").select(
            "node", F.coalesce("_root", "root").alias("root"), F.col("flips").bitwiseXOR(F.coalesce("_flips", F.lit(0))).alias("flips")))


def _greedy_winners(contested: DataFrame) -> DataFrame:
    """Entries stored when contested ones are tried one by one in arrival order.

    An entry that is first on all its keys is stored; whoever shares a key with it is not. An entry with a single earlier
    rival on all its keys is stored exactly if that one isn't: such dependences form chains, which are followed to their
    ends by pointer jumping, so a chain takes rounds by the logarithm of its length. Entries with several earlier rivals
    are looked at again when these are decided; rounds end when nothing is left.
    """
    c = F.col
    left = contested
    winners = left.filter(F.lit(False))
    while not left.isEmpty():
        keys = kept(key_rows(left, "arrival_no"))
        first = keys.groupBy("key").agg(F.min("arrival_no").alias("first"))
        behind = keys.join(first, "key").filter(c("arrival_no") > c("first"))
        second = behind.groupBy("key").agg(F.min("arrival_no").alias("second"))
        rivals = behind.join(second, "key").groupBy(c("arrival_no").alias("node")).agg(
            F.min("first").alias("root"), F.max("first").alias("other"), F.bool_and(c("arrival_no") == c("second")).alias("single"))
        ahead = kept(keys.select(c("arrival_no").alias("node")).distinct().join(rivals, "node", "left"))
        firsts = ahead.filter(c("root").isNull()).select("node")
        links = _jumped(ahead.filter(c("single") & (c("root") == c("other"))).select("node", "root", F.lit(1).alias("flips")))
        # An odd number of steps from an entry that is stored ends at one that isn't.
        ends = links.filter("flips = 0").join(firsts.select(c("node").alias("root")), "root", "left_semi").select("node")
        won = kept(left.join(firsts.unionByName(ends).select(c("node").alias("arrival_no")), "arrival_no", "left_semi"))
        winners = winners.unionByName(won)
        taken = key_rows(won).distinct()
        lost = keys.join(taken, "key", "left_semi").select("arrival_no").distinct()
        left = kept(left.join(lost, "arrival_no", "left_anti"))
    return winners


def stored_requests(rows: DataFrame) -> DataFrame:
    """request_id, event_id, user_id, issue_sequence: one row for each request that stored rows hold."""
    return rows.filter(F.col("request_id").isNotNull()).groupBy("request_id").agg(
        F.min(F.struct("event_id", "user_id", "issue_sequence")).alias("row")).select("request_id", "row.*")


def taken_keys(rows: DataFrame) -> DataFrame:
    """key: the unique keys that stored rows hold, each once."""
    return key_rows(rows).distinct()


def stored_keys(rows: DataFrame) -> DataFrame:
    """key, request_id, event_id, user_id, issue_sequence: one row for each unique key and each request that stored rows hold.

    What is stored is told with the request only; of the other keys it matters that they are taken.
    """
    requests = stored_requests(rows).withColumn("key", F.concat(F.lit("r:"), F.col("request_id")))
    return requests.unionByName(taken_keys(rows), allowMissingColumns=True).select("key", "request_id", "event_id", "user_id", "issue_sequence")


def classify_entries(entries: DataFrame, issue: DataFrame) -> DataFrame:
    """Outcome of storing each entry: INSERT, ABSORBED (same request again) or CONFLICT.

    ``entries``: request_id, event_id, user_id, issue_sequence, message_id, arrival_no and
    whatever else is stored. The outcome is that of trying entries in arrival order against the
    stored rows and the rows stored before them, on every unique key.
    """
    entries = cut(entries)
    requests = matching(issue.select("request_id", "event_id", "user_id", "issue_sequence"), entries, ["request_id"])
    return classify_against(entries, requests, lambda keys: matching(key_rows(issue), keys, ["key"]))


def _as_it_is(rows: DataFrame) -> DataFrame:
    return rows


def classify_against(
    entries: DataFrame, requests: DataFrame, held_of: Callable[[DataFrame], DataFrame],
    complete: Callable[[DataFrame], DataFrame] = _as_it_is, tell_stored: bool = False,
) -> DataFrame:
    """As :func:`classify_entries`, given the stored rows of the entries' requests, and of some keys those that stored rows hold.

    Both may come with further rows. Rows with a ``_refusal`` end with it and take part in nothing else. ``complete`` adds those of
    the named columns that follow from others, so that they needn't be shuffled. ``tell_stored`` adds what the ledger holds under the
    request of an entry that isn't absorbed.
    """
    c = F.col
    columns = [n for n in entries.columns if n != "_refusal"]
    refusal = c("_refusal") if "_refusal" in entries.columns else F.lit(None).cast("string")
    identity = F.struct("event_id", "user_id", "issue_sequence")
    unique = sorted({n for key in UNIQUE_KEYS for n in key})
    stored = requests.groupBy("request_id").agg(F.min(identity).alias("stored"))
    # Refused rows don't count among a request's entries; the rest is worked out where a request's rows lie together.
    first = F.min(F.when(refusal.isNull(), F.struct("arrival_no", identity.alias("identity")))).over(Window.partitionBy("request_id"))
    known = F.coalesce(c("stored"), c("_first.identity"))
    is_first = c("stored").isNull() & (c("arrival_no") == c("_first.arrival_no"))
    outcome = F.when(is_first, "INSERT").when(known == identity, "ABSORBED").otherwise("CONFLICT")
    told = [*columns, *([F.when(c("outcome") != "ABSORBED", c("stored")).alias("stored")] if tell_stored else [])]
    out = kept(
        complete(entries.filter(c("request_id").isNotNull() | refusal.isNotNull())).withColumn("_first", first).join(stored, "request_id", "left")
        .withColumn("outcome", F.coalesce(refusal, outcome))
        .withColumn("_leans", refusal.isNull() & c("stored").isNull() & (c("outcome") == "ABSORBED"))
        # Given with the last step, so that a row has one number wherever the rows kept here are read.
        .select(*told, "outcome", "_leans", F.monotonically_increasing_id().alias("_ref")), "classified")
    fresh = out.filter(c("outcome") == "INSERT").select(*columns, "_ref")
    keys = key_rows(complete(fresh), "_ref")
    held = held_of(keys.select("key")).select(packed(c("key")).alias("key")).distinct().withColumn("_held", F.lit(True))
    keys = keys.withColumn("key", packed(c("key")))
    # Entries to look at: those with a key that a stored row holds, and those that share one.
    marks = keys.join(held, "key", "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter(
        c("_held") | (c("_n") > 1)).groupBy("_ref").agg(F.coalesce(F.bool_or("_held"), F.lit(False)).alias("_blocked"))
    met = kept(complete(fresh.join(marks, "_ref")).select("arrival_no", "request_id", *unique, "_blocked"), "met")
    # Numbers in place of arrivals, which may be wide; equal arrivals lie together and get the same.
    contested = kept(
        met.filter(~c("_blocked")).repartitionByRange("arrival_no").sortWithinPartitions("arrival_no").withColumn("_no", F.monotonically_increasing_id())
        .withColumn("_no", F.min("_no").over(Window.partitionBy("arrival_no"))).select(c("_no").alias("arrival_no"), "request_id", *unique), "contested")
    lost = contested.join(_greedy_winners(contested.drop("request_id")), "arrival_no", "left_anti")
    # A refused first entry takes the repeats that lean on it along.
    refused = met.filter("_blocked").select("request_id").unionByName(lost.select("request_id")).distinct().withColumn("_refused", F.lit(True))
    falls = (c("outcome") == "INSERT") | c("_leans")
    return out.drop("_ref").join(refused, "request_id", "left").withColumn(
        "outcome", F.when(falls & c("_refused"), "CONFLICT").otherwise(c("outcome"))
    ).drop("_refused", "_leans")


def persist_issues(
    entries: DataFrame, issue: DataFrame | None, event: DataFrame, coupon: DataFrame, now: datetime,
    classify: Callable[[DataFrame], DataFrame] | None = None, complete: Callable[[DataFrame], DataFrame] = _as_it_is,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New issue rows, their first history rows, and the classified entries.

    Entries of a campaign that isn't there (NO_CAMPAIGN) and sequences that don't fit an issue id (BAD_SEQUENCE) are refused
    before anything else; they take no key from others.

    A campaign gives out each sequence once, so campaign and sequence make up the issue id: unique,
    the same on every retry, and without numbering all rows in one task. Streams pass ``classify`` in place of the ledger, which gets
    refused entries too, told by ``_refusal``; ``complete`` is that of :func:`classify_against`.
    """
    classify = classify or (lambda rows: classify_entries(rows, issue))
    event = kept(event.select("event_id", "coupon_id"), "campaigns")
    # A shuffle by campaign would gather a campaign's entries in one task.
    known = if_small(event.select("event_id", F.lit(True).alias("_known")).distinct())
    entries = entries.join(known, "event_id", "left").withColumn(
        "_refusal",
        F.when(F.col("_known").isNull(), "NO_CAMPAIGN").when(~F.col("issue_sequence").between(1, MAX_SEQUENCE), "BAD_SEQUENCE"),
    ).drop("_known")
    judged = classify(entries)
    fresh = complete(judged.filter(F.col("outcome") == "INSERT")).withColumn("valid_from", F.col("decided_at"))
    fresh = with_valid_to(fresh, event, coupon)
    new_issue = fresh.select(
        (F.col("event_id") * F.lit(ISSUE_ID_SPAN) + F.col("issue_sequence")).alias("issue_id"), "event_id", "user_id", "issue_sequence", "request_id",
        "message_id", F.lit(ISSUED).alias("status"), F.col("decided_at").alias("issued_at"), "valid_from", "valid_to",
        F.lit(None).cast("timestamp_ntz").alias("used_at"), F.lit(None).cast("timestamp_ntz").alias("canceled_at"),
        ts(now).alias("created_at"),
    )
    new_history = new_issue.select(
        "issue_id", F.lit(None).cast("string").alias("from_status"), F.lit(ISSUED).alias("to_status"),
        F.lit(ACTOR_SYSTEM).alias("actor"), F.lit(REASON_ISSUE_CONFIRMED).alias("reason"),
        F.col("issued_at").alias("occurred_at"), F.col("created_at").alias("recorded_at"),
        F.col("request_id").alias("event_uid"),
    )
    return new_issue, new_history, judged


def probe(failures: DataFrame, issue: DataFrame) -> DataFrame:
    """PERSISTED when the stored row of the request has the same identity, else ABSENT.

    A failure without a sequence is compared by campaign and user only.
    """
    wanted = matching(issue.select("request_id", "event_id", "user_id", "issue_sequence"), failures, ["request_id"])
    stored = wanted.groupBy("request_id").agg(F.min(F.struct("event_id", "user_id", "issue_sequence")).alias("stored"))
    c = F.col
    same = (
        (c("stored.event_id") == c("event_id")) & (c("stored.user_id") == c("user_id"))
        & (c("issue_sequence").isNull() | (c("stored.issue_sequence") == c("issue_sequence")))
    )
    return failures.join(stored, "request_id", "left").withColumn(
        "probe_result", F.when(F.coalesce(same, F.lit(False)), "PERSISTED").otherwise("ABSENT")
    ).drop("stored")


def _answer(
    state: DataFrame, cmds: DataFrame, order: str | Column, result: str, already, done_now: str, refused: str, already_name: str, carry: bool,
):
    """Answer commands against request records; the first of several on one request acts."""
    c = F.col
    key = ("campaign_id", "request_id")
    order = c(order) if isinstance(order, str) else order
    record = state.select(*key, F.struct(*[n for n in state.columns if carry and n not in key] or ("user_id", "code", "lifecycle")).alias("_record"))
    open_record = (c("_record.code") == DECISION_ACCEPTED) & (c("_record.lifecycle") == PENDING)
    judged = cmds.join(record, ["campaign_id", "request_id"], "left").withColumn(
        result,
        F.when(c("_record").isNull(), "REQUEST_NOT_FOUND")
        .when(c("_record.user_id") != c("user_id"), "INVALID_ARGUMENT")
        .when(already, already_name)
        .when(~open_record, refused)
        .otherwise(done_now),
    )
    acting = F.min(F.when(c(result) == done_now, order)).over(Window.partitionBy(*key))
    judged = judged.withColumn("_first", acting).withColumn(
        result, F.when((c(result) == done_now) & (order > c("_first")), already_name).otherwise(c(result))).drop("_first")
    return judged.withColumnRenamed("_record", "record") if carry else judged.drop("_record")


def confirm(state: DataFrame, cmds: DataFrame, order: str | Column = "command_no", carry: bool = False) -> DataFrame:
    """Confirm accepted, pending requests once. Adds ``confirm_result``; ``carry``: and ``record``, the request's record but for its key."""
    already = (F.col("_record.code") == DECISION_ACCEPTED) & (F.col("_record.lifecycle") == CONFIRMED)
    return _answer(state, cmds, order, "confirm_result", already, "CONFIRMED_NOW", "NOT_CONFIRMABLE", "ALREADY_CONFIRMED", carry)


def compensate(state: DataFrame, cmds: DataFrame, order: str | Column = "command_no", carry: bool = False) -> DataFrame:
    """Give accepted, pending requests back once. Adds ``compensate_result``; ``carry``: and ``record``, the request's record but for its key."""
    already = (F.col("_record.code") == DECISION_PERSISTENCE_FAILED) & (F.col("_record.lifecycle") == COMPENSATED)
    return _answer(state, cmds, order, "compensate_result", already, "COMPENSATED", "NOT_COMPENSABLE", "ALREADY_COMPENSATED", carry)


def apply_answers(
    state: DataFrame, answers: DataFrame, result: str, now: datetime, stock: DataFrame | None = None, order: str = "command_no",
) -> DataFrame:
    """Request records after the acting commands: life cycle moved on, counters left to :func:`counter_deltas`.

    With ``stock`` (campaign_id, stock before the commands) a compensated record holds the stock it restored: one more
    for each command of its campaign up to its own.
    """
    done = "CONFIRMED_NOW" if result == "confirm_result" else "COMPENSATED"
    code, stage = (DECISION_ACCEPTED, CONFIRMED) if done == "CONFIRMED_NOW" else (DECISION_PERSISTENCE_FAILED, COMPENSATED)
    acted = answers.filter(F.col(result) == done)
    moved = acted.select("campaign_id", "request_id").distinct().withColumn("_moved", F.lit(True))
    restored = F.lit(None).cast("long")
    if stock is not None and done == "COMPENSATED":
        moved = acted.groupBy("campaign_id", "request_id").agg(F.min(order).alias("_at"), F.lit(True).alias("_moved"))
        moved = ranked(moved, ["campaign_id"], number_segment(F.col("_at")), [F.col("_at").asc()], name="_place").join(
            stock.select("campaign_id", F.col("stock").alias("_stock")), "campaign_id", "left")
        restored = F.col("_stock") + F.col("_place")
    m = F.coalesce(F.col("_moved"), F.lit(False))
    return state.join(moved, ["campaign_id", "request_id"], "left").select(
        *[
            F.when(m, F.lit(code)).otherwise(F.col(c)).alias(c) if c == "code"
            else F.when(m, F.lit(stage)).otherwise(F.col(c)).alias(c) if c == "lifecycle"
            else F.when(m, ts(now)).otherwise(F.col(c)).alias(c) if c == "updated_at"
            else F.when(m, F.coalesce(restored, F.col(c))).otherwise(F.col(c)).alias(c) if c == "remaining"
            else F.col(c)
            for c in state.columns
        ]
    )


def counter_deltas(confirmed: DataFrame | None, compensated: DataFrame | None) -> DataFrame:
    """Confirmed quantity to add and stock to return, per campaign."""
    parts = []
    if confirmed is not None:
        parts.append(confirmed.filter(F.col("confirm_result") == "CONFIRMED_NOW").select(
            "campaign_id", F.lit(1).alias("confirmed"), F.lit(0).alias("returned")))
    if compensated is not None:
        parts.append(compensated.filter(F.col("compensate_result") == "COMPENSATED").select(
            "campaign_id", F.lit(0).alias("confirmed"), F.lit(1).alias("returned")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("campaign_id").agg(F.sum("confirmed").alias("confirmed"), F.sum("returned").alias("returned"))


def classify_delivery(deliveries: DataFrame, limit: int = MAX_DELIVERY_ATTEMPTS) -> DataFrame:
    """What to do with a failed delivery.

    ``deliveries``: stage (RELAY or CONFIRM), attempts, probe_result (NULL when not probed).
    Below the limit: RETRY. A failed confirmation is never given back: logged once at the
    limit, then kept. A failed store is probed: absent rows are given back and acknowledged,
    stored ones only acknowledged, unverified ones kept.
    """
    c = F.col
    at_limit = c("attempts") >= limit
    return deliveries.withColumn(
        "action",
        F.when(~at_limit, "RETRY")
        .when((c("stage") == "CONFIRM") & (c("attempts") == limit), "LOG_AND_KEEP")
        .when(c("stage") == "CONFIRM", "KEEP")
        .when(c("probe_result") == "ABSENT", "COMPENSATE_AND_ACK")
        .when(c("probe_result") == "PERSISTED", "ACK")
        .otherwise("KEEP"),
    )


def reclaimable(pending: DataFrame, now: datetime, idle_seconds: int = CLAIM_IDLE_SECONDS) -> DataFrame:
    """Entries delivered but not acknowledged for long enough, with the next delivery number."""
    idle = F.timestamp_diff("SECOND", F.col("delivered_at"), ts(now)) >= idle_seconds
    return pending.filter(idle).withColumn("deliveries", F.col("deliveries") + 1)


def relay_targets(event: DataFrame, state: DataFrame, now: datetime, retention_hours: int = RETENTION_HOURS) -> DataFrame:
    """Campaigns whose entries may still have to be stored."""
    live = (F.col("open_at") <= ts(now)) & (F.col("close_at") >= ts(now) - hours(retention_hours))
    return event.filter(live).join(state.select("event_id"), "event_id", "left_semi").select("event_id")


def pending_entries(entries: DataFrame, issue: DataFrame, after: int = 0, limit: int | None = None) -> DataFrame:
    """Accepted entries of each campaign that are not stored yet, above a sequence."""
    stored = issue.select("event_id", "issue_sequence").dropna()
    out = entries.filter(F.col("issue_sequence") > after).join(stored, ["event_id", "issue_sequence"], "left_anti")
    return out.orderBy("event_id", "issue_sequence").limit(limit) if limit else out


def trimmable(entries: DataFrame, acks: DataFrame) -> DataFrame:
    """Entries every consumer group has acknowledged; the newest entry of a campaign always stays.

    ``entries``: campaign_id, entry_no. ``acks``: campaign_id, consumer, entry_no.
    """
    groups = acks.select("campaign_id", "consumer").distinct().groupBy("campaign_id").agg(F.count(F.lit(1)).alias("_groups"))
    acked = acks.dropDuplicates(["campaign_id", "consumer", "entry_no"]).groupBy("campaign_id", "entry_no").agg(
        F.count(F.lit(1)).alias("_acks"))
    newest = entries.groupBy("campaign_id").agg(F.max("entry_no").alias("_newest"))
    return (
        entries.join(acked, ["campaign_id", "entry_no"]).join(groups, "campaign_id").join(newest, "campaign_id")
        .filter((F.col("_acks") == F.col("_groups")) & (F.col("entry_no") < F.col("_newest")))
        .drop("_acks", "_groups", "_newest")
    )


def issued_bitmap(issue: DataFrame) -> DataFrame:
    """Distinct users per campaign as fixed-size bitmaps with their bit counts."""
    users = issue.dropna(subset=["user_id"])
    return (
        users.groupBy("event_id", F.bitmap_bucket_number("user_id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("bits"))
        .withColumn("users", F.bitmap_count("bits"))
    )


def issued_users(issue: DataFrame) -> DataFrame:
    """Bit count per campaign; equals the number of distinct users."""
    return issued_bitmap(issue).groupBy("event_id").agg(F.sum("users").alias("users"))
