"""Time-driven changes of campaign rounds and coupons, as projections of the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroll.constants import (
    ACTOR_SYSTEM, CLOSED, EXPIRE_UID_PREFIX, EXPIRED, ISSUED, OPEN, REASON_SCHEDULED_EXPIRATION, SCHEDULED, SOLD_OUT,
)
from tallyroll.functions.times import ts
from tallyroll.operators.checks import active_counts

APPLIED, ALREADY_APPLIED, REJECTED, NO_STATE, UNREADABLE = "APPLIED", "ALREADY_APPLIED", "REJECTED", "NO_STATE", "UNREADABLE"


def campaign_stats(state: DataFrame, observed_at: datetime) -> DataFrame:
    """Live numbers per campaign; ``code`` is CORRUPTED_STATE when the counters contradict each other."""
    c = F.col
    at = ts(observed_at)
    confirmed = F.coalesce(c("confirmed_quantity"), F.lit(0))
    allocated = c("total_stock") - c("remaining_stock")
    sound = (
        (c("total_stock") > 0) & (c("open_at") < c("close_at")) & (c("remaining_stock") >= 0)
        & (c("remaining_stock") <= c("total_stock")) & (confirmed >= 0) & (confirmed <= allocated)
    )
    ok = F.coalesce(sound, F.lit(False))
    status = (
        F.when(at < c("open_at"), SCHEDULED).when(at >= c("close_at"), CLOSED)
        .when(c("remaining_stock") == 0, SOLD_OUT).otherwise(OPEN)
    )
    keep = lambda col: F.when(ok, col)
    return state.select(
        "event_id",
        F.when(ok, "SUCCESS").otherwise("CORRUPTED_STATE").alias("code"),
        keep(c("total_stock")).alias("stat_total"), keep(allocated).alias("stat_allocated"),
        keep(c("remaining_stock")).alias("stat_remaining"), keep(status).alias("stat_status"),
        keep(confirmed).alias("stat_confirmed"), keep(allocated - confirmed).alias("stat_pending"),
    )


def _snapshot_outcome() -> Column:
    c = F.col
    same_total = c("total_stock") == c("stat_total")
    return (
        F.when(c("code").isNull(), NO_STATE)
        .when(c("code") != "SUCCESS", UNREADABLE)
        .when(same_total & (c("issued_quantity") <= c("stat_confirmed")), APPLIED)
        .when(
            same_total & (c("issued_quantity") == c("stat_confirmed"))
            & (c("remaining_stock") == c("stat_total") - c("stat_confirmed")),
            ALREADY_APPLIED,
        )
        .otherwise(REJECTED)
    )


def apply_snapshot(event: DataFrame, stats: DataFrame, now: datetime) -> DataFrame:
    """Counters of open rounds taken from the live numbers, with the outcome per round."""
    live = event.filter((F.col("status") == OPEN) & (F.col("close_at") > ts(now)))
    return live.join(stats, "event_id", "left").withColumn("outcome", _snapshot_outcome()).select(
        "event_id", "outcome",
        F.when(F.col("outcome") == APPLIED, F.col("stat_confirmed")).otherwise(F.col("issued_quantity")).alias("issued_quantity"),
        F.when(F.col("outcome") == APPLIED, F.col("total_stock") - F.col("stat_confirmed"))
        .otherwise(F.col("remaining_stock")).alias("remaining_stock"),
    )


def sweep_counts(outcomes: DataFrame) -> DataFrame:
    """Rows per outcome; rows without one were looked at and left alone."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("rounds"))


def open_due(event: DataFrame, now: datetime) -> DataFrame:
    """Rounds whose opening time has come."""
    at = ts(now)
    due = (F.col("status") == SCHEDULED) & (F.col("open_at") <= at) & (F.col("close_at") > at)
    return event.filter(due).select("event_id", F.lit(OPEN).alias("status"), at.alias("updated_at"))


def mark_sold_out(event: DataFrame, stats: DataFrame, now: datetime) -> DataFrame:
    """Open rounds without stock: SOLD_OUT when all is stored, else what they wait for."""
    c = F.col
    live = event.filter((c("status") == OPEN) & (c("close_at") > ts(now)))
    final = _snapshot_outcome().isin(APPLIED, ALREADY_APPLIED)
    outcome = (
        F.when(c("code").isNull() | (c("code") != "SUCCESS"), "UNRESOLVED")
        .when(c("stat_remaining") != 0, "IN_STOCK")
        .when(c("stat_pending") != 0, "WAITING_FOR_DRAIN")
        .when(final & (c("stat_total") - c("stat_confirmed") == 0), SOLD_OUT)
        .otherwise("NOT_FINAL")
    )
    return live.join(stats, "event_id", "left").select("event_id", outcome.alias("outcome"), "stat_remaining", "stat_pending")


def close_drained(event: DataFrame, stats: DataFrame, now: datetime) -> DataFrame:
    """Rounds past their end: CLOSED when all is stored and the counters agree."""
    c = F.col
    due = event.filter(c("status").isin(OPEN, SOLD_OUT) & (c("close_at") <= ts(now)))
    snapshot = _snapshot_outcome()
    outcome = (
        F.when(c("code").isNull() | (c("code") != "SUCCESS"), "UNRESOLVED")
        .when(c("stat_pending") != 0, "WAITING_FOR_DRAIN")
        .when(snapshot.isin(APPLIED, ALREADY_APPLIED), CLOSED)
        .otherwise("UNRESOLVED")
    )
    return due.join(stats, "event_id", "left").withColumn("outcome", outcome).select(
        "event_id", "outcome",
        F.when(c("outcome") == CLOSED, c("stat_confirmed")).otherwise(c("issued_quantity")).alias("issued_quantity"),
        F.when(c("outcome") == CLOSED, c("stat_total") - c("stat_confirmed")).otherwise(c("remaining_stock")).alias("remaining_stock"),
    )


def close_never_opened(event: DataFrame, now: datetime) -> DataFrame:
    """Scheduled rounds whose end has passed."""
    due = (F.col("status") == SCHEDULED) & (F.col("close_at") <= ts(now))
    return event.filter(due).select("event_id", F.lit(CLOSED).alias("status"), ts(now).alias("updated_at"))


def advance_close(event: DataFrame, state: DataFrame, cmds: DataFrame) -> DataFrame:
    """Early manual close. ``cmds``: event_id, closed_at.

    Stops allocation at the command time and pulls the round's end forward; the round
    itself becomes CLOSED only through :func:`close_drained`.
    """
    c = F.col
    live = state.select(
        "event_id", c("open_at").alias("s_open"), c("close_at").alias("s_close"), c("expire_at").alias("s_expire"),
        c("total_stock").alias("s_total"),
    )
    at = c("closed_at")
    sound = (c("s_total") > 0) & (c("s_open") < c("s_close")) & (c("s_close") < c("s_expire")) & (at < c("s_expire"))
    outcome = (
        F.when(c("status") == CLOSED, "ALREADY_CLOSED")
        .when(~c("status").isin(OPEN, SOLD_OUT), "INVALID_STATE")
        .when(c("s_total").isNull(), "NOT_INITIALIZED")
        .when(~F.coalesce(sound, F.lit(False)), "CORRUPTED_STATE")
        .when(at <= c("s_open"), "INVALID_STATE")
        .when(at >= c("s_close"), "ALREADY_CLOSED")
        .otherwise("CLOSED")
    )
    stop = F.when(c("outcome") == "CLOSED", at).when(c("outcome") == "ALREADY_CLOSED", F.coalesce(c("s_close"), c("close_at")))
    moves = c("status").isin(OPEN, SOLD_OUT) & c("outcome").isin("CLOSED", "ALREADY_CLOSED") & (c("close_at") > c("stop"))
    return (
        event.join(cmds, "event_id").join(live, "event_id", "left")
        .withColumn("outcome", outcome).withColumn("stop", stop)
        .withColumn("advanced", F.coalesce(moves, F.lit(False)))
        .select("event_id", "outcome", "advanced", F.when(c("advanced"), c("stop")).otherwise(c("close_at")).alias("close_at"))
    )


def expire_due(issue: DataFrame, history: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Coupons whose validity has ended: status changes and the history rows to append.

    A coupon that already carries its expiry history row gets no second one.
    """
    c = F.col
    due = issue.filter((c("status") == ISSUED) & (c("valid_to") < ts(now))).select("issue_id", "event_id")
    uid = F.concat(F.lit(EXPIRE_UID_PREFIX), c("issue_id").cast("string"))
    rows = due.select(
        "issue_id", F.lit(ISSUED).alias("from_status"), F.lit(EXPIRED).alias("to_status"),
        F.lit(ACTOR_SYSTEM).alias("actor"), F.lit(REASON_SCHEDULED_EXPIRATION).alias("reason"),
        ts(now).alias("occurred_at"), ts(now).alias("recorded_at"), uid.alias("event_uid"),
    )
    written = history.filter(c("event_uid").startswith(EXPIRE_UID_PREFIX)).select("event_uid")
    return (
        due.withColumn("status", F.lit(EXPIRED)),
        rows.join(written, "event_uid", "left_anti"),
    )


def rebuild_counters(event: DataFrame, issue: DataFrame) -> DataFrame:
    """Counters of every round that has issues, set from the issues."""
    return event.join(active_counts(issue), "event_id").select(
        "event_id", F.col("actual_active_count").alias("issued_quantity"),
        (F.col("total_stock") - F.col("actual_active_count")).alias("remaining_stock"),
    )


def fold_init(log: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Initialization ledger per round from its attempt log.

    ``log``: event_id, seq, kind (ATTEMPT, SUCCESS, FAILURE), at, error_code, error_message.
    INITIALIZED is final; a failure after it is ignored. Error messages stay whole unless ``max_chars`` is given.
    """
    c = F.col
    row = F.struct("seq", "at", "kind", "error_code", "error_message")
    pick = lambda cond: F.max(F.when(cond, row))
    folded = log.groupBy("event_id").agg(
        F.count(F.when(c("kind") == "ATTEMPT", 1)).alias("attempt_count"),
        pick(c("kind") == "ATTEMPT").alias("attempt"),
        pick(c("kind") == "SUCCESS").alias("success"),
        pick(c("kind") != "FAILURE").alias("calm"),
        F.max(row).alias("latest"),
    )
    done = c("success").isNotNull()
    failed = ~done & (c("latest.kind") == "FAILURE")
    message = c("latest.error_message") if max_chars is None else F.substring(c("latest.error_message"), 1, max_chars)
    return folded.select(
        "event_id",
        F.when(done, "INITIALIZED").when(failed, "FAILED").otherwise("PENDING").alias("status"),
        "attempt_count",
        c("attempt.at").alias("last_attempted_at"),
        c("success.at").alias("initialized_at"),
        F.when(failed, c("latest.error_code")).alias("last_error_code"),
        F.when(failed, message).alias("last_error_message"),
        F.when(done, c("calm.at")).otherwise(c("latest.at")).alias("updated_at"),
    )


def init_candidates(event: DataFrame, init: DataFrame, now: datetime, limit: int | None = None) -> DataFrame:
    """Rounds still to be initialized: all, or the ``limit`` least tried."""
    c = F.col
    ledger = init.select("event_id", c("status").alias("init_status"), "attempt_count")
    rows = (
        event.filter(c("status").isin(SCHEDULED, OPEN) & (c("close_at") > ts(now))).select("event_id", "status")
        .join(ledger, "event_id", "left")
        .filter(c("init_status").isNull() | (c("init_status") != "INITIALIZED"))
        .select("event_id", "status", F.coalesce(c("attempt_count"), F.lit(0)).cast("long").alias("attempt_count"))
    )
    return rows if limit is None else rows.orderBy("attempt_count", "event_id").limit(limit)
