"""Repairs. Each returns proposed rows; the tables change only when a new snapshot is written."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroll.constants import (
    ACTIVE_STATUSES, ACTOR_STOCK_RECOVERY, ACTOR_SYSTEM, CANCELED, EXPIRATION_DELAY_MILLIS, EXPIRED,
    ISSUED, REASON_ISSUE_CONFIRMED, REASON_RECOVERY_EXPIRATION, REASON_REVOKED, TIME_SYNC_TOLERANCE_SECONDS,
    USED,
)
from tallyroll.functions.ids import is_uuid, uuid_from_name
from tallyroll.functions.times import micros_between, millis, ts
from tallyroll.operators.checks import active_counts
from tallyroll.operators.chains import chain_breaks, latest_history
from tallyroll.plans.segments import number_segment, ranked


@dataclass(frozen=True)
class Proposal:
    """Outcome per target, changed rows of one table by key, new history rows, history keys to drop."""

    outcomes: DataFrame
    event_updates: DataFrame | None = None
    issue_updates: DataFrame | None = None
    history_inserts: DataFrame | None = None
    history_deletes: DataFrame | None = None


def _only(df: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    return df if ids is None else df.join(ids.select(key), key, "left_semi")


def _with_unknown(outcomes: DataFrame, ids: DataFrame | None, table: DataFrame, key: str) -> DataFrame:
    """Outcomes with one NOT_FOUND row for each target that the table doesn't have."""
    if ids is None:
        return outcomes
    unknown = ids.select(key).distinct().join(table.select(key), key, "left_anti").withColumn("outcome", F.lit("NOT_FOUND"))
    return outcomes.unionByName(unknown, allowMissingColumns=True)


def reconcile_stock(event: DataFrame, issue: DataFrame, now: datetime, ids: DataFrame | None = None) -> Proposal:
    """Set the counters from the issues; refused while more issues are active than the stock allows."""
    active = F.coalesce(F.col("actual_active_count"), F.lit(0))
    rows = _only(event, ids, "event_id").join(active_counts(_only(issue, ids, "event_id")), "event_id", "left")
    rows = rows.withColumn("actual_active_count", active).withColumn(
        "outcome", F.when(F.col("actual_active_count") > F.col("total_stock"), "FAIL").otherwise("SUCCESS")
    )
    outcomes = rows.select(
        "event_id", "outcome", F.col("issued_quantity").alias("before_issued_quantity"),
        F.col("remaining_stock").alias("before_remaining_stock"), "actual_active_count",
    )
    updates = rows.filter(F.col("outcome") == "SUCCESS").select(
        "event_id",
        F.col("actual_active_count").alias("issued_quantity"),
        (F.col("total_stock") - F.col("actual_active_count")).alias("remaining_stock"),
        ts(now).alias("updated_at"),
    )
    return Proposal(_with_unknown(outcomes, ids, event, "event_id"), event_updates=updates)


# More segments than issue ids can fill.
NO_SEQUENCE = 1 << 50


def excess_issues(event: DataFrame, issue: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Active issues beyond the stock, newest sequence first, one row each."""
    active = _only(issue, ids, "event_id").filter(F.col("status").isin(*ACTIVE_STATUSES))
    over = (
        _only(event, ids, "event_id").select("event_id", "total_stock")
        .join(active_counts(active), "event_id")
        .withColumn("excess", F.col("actual_active_count") - F.col("total_stock"))
        .filter(F.col("excess") > 0)
    )
    sequence = F.coalesce(F.col("issue_sequence"), F.lit(-1))
    # Coupons without a sequence come last; their segments follow the issue id, which orders them.
    segment = F.when(F.col("issue_sequence").isNull(), number_segment(F.col("issue_id")) - NO_SEQUENCE).otherwise(number_segment(F.col("sequence")))
    return ranked(
        active.join(over, "event_id").withColumn("sequence", sequence),
        ["event_id"], segment, [F.col("sequence").desc(), F.col("issue_id").desc()],
        limit="excess", descending=True, name="excess_rank",
    )


def revoke_excess(event: DataFrame, issue: DataFrame, now: datetime, ids: DataFrame | None = None) -> Proposal:
    """Cancel over-issued coupons that are still unused; used or expired ones need a person.

    ``outcomes`` has one row per campaign; the affected coupons are rows of
    ``issue_updates`` and of :func:`excess_issues`, never a list in one cell.
    """
    excess = excess_issues(event, issue, ids)
    revoked = excess.filter(F.col("status") == ISSUED)
    at = ts(now)
    totals = excess.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("excess_count"),
        F.count(F.when(F.col("status") == ISSUED, 1)).alias("revoked_count"),
        F.first("total_stock").alias("total_stock"),
        F.first("actual_active_count").alias("active"),
    )
    left = F.col("active") - F.col("revoked_count")
    outcomes = (
        _only(event, ids, "event_id").select("event_id").join(totals, "event_id", "left")
        .select(
            "event_id",
            F.coalesce(F.col("excess_count"), F.lit(0)).alias("excess_count"),
            F.coalesce(F.col("revoked_count"), F.lit(0)).alias("revoked_count"),
            F.coalesce(F.col("excess_count") - F.col("revoked_count"), F.lit(0)).alias("unrevokable_count"),
            F.when(F.col("excess_count") == F.col("revoked_count"), "SUCCESS").otherwise("FAIL").alias("outcome"),
        )
    )
    events = totals.filter(F.col("revoked_count") > 0).select(
        "event_id", left.alias("issued_quantity"), (F.col("total_stock") - left).alias("remaining_stock"),
        at.alias("updated_at"),
    )
    issues = revoked.select("issue_id", F.lit(CANCELED).alias("status"), at.alias("canceled_at"))
    history = _history_rows(revoked, F.lit(ISSUED), CANCELED, ACTOR_STOCK_RECOVERY, REASON_REVOKED, at, at, "revoke", now)
    return Proposal(_with_unknown(outcomes, ids, event, "event_id"), event_updates=events, issue_updates=issues, history_inserts=history)


def _history_rows(rows, from_status, to_status, actor, reason, occurred, recorded, operation, now, uid=None):
    """New history rows; the uid is derived from the operation, the issue and the run time."""
    name = F.concat(F.lit(f"{operation}:"), F.col("issue_id").cast("string"), F.lit(f":{now.isoformat()}"))
    return rows.select(
        "issue_id",
        from_status.cast("string").alias("from_status"),
        F.lit(to_status).alias("to_status"),
        F.lit(actor).alias("actor"),
        F.lit(reason).alias("reason"),
        occurred.alias("occurred_at"),
        recorded.alias("recorded_at"),
        (uid if uid is not None else uuid_from_name(name)).alias("event_uid"),
    )


def restore_chain(issue: DataFrame, history: DataFrame, ids: DataFrame | None = None) -> Proposal:
    """Cut a broken chain at its first break and restore the issue from the rows before it.

    Not eligible: a broken first row, or a cut-off tail that used or expired the coupon.
    """
    c = F.col
    rows = _only(history, ids, "issue_id")
    order = lambda at, n: F.struct(F.coalesce(at, ts("0001-01-01 00:00:00")).alias("at"), n.alias("n"))
    position = order(c("occurred_at"), c("history_id"))
    breaks = chain_breaks(rows).groupBy("issue_id").agg(
        F.min(position).alias("cut"), F.max(c("is_first").cast("int")).alias("bad_start")
    )
    chain = rows.join(breaks, "issue_id").withColumn("position", position)
    in_tail = c("position") >= c("cut")
    to, frm = c("to_status"), c("from_status")
    uses = F.coalesce(to == USED, F.lit(False))
    undoes = F.coalesce((to == ISSUED) & (frm == USED), F.lit(False))
    cancels = F.coalesce(to == CANCELED, F.lit(False))
    starts = F.coalesce((to == ISSUED) & frm.isNull(), F.lit(False))

    def last_of(kind, value):
        return F.max(F.when(~in_tail & kind, F.struct("position", value.alias("value"))))["value"]

    def at_if(cond):
        return F.when(cond, c("occurred_at"))

    verdict = chain.groupBy("issue_id").agg(
        F.max("bad_start").alias("bad_start"),
        F.max(F.when(in_tail & to.isin(USED, EXPIRED), 1).otherwise(0)).alias("spent_tail"),
        F.max(F.when(~in_tail, F.struct("position", "to_status")))["to_status"].alias("status"),
        last_of(uses | undoes | starts, at_if(uses)).alias("used_at"),
        last_of(uses | undoes | cancels | starts, at_if(undoes | cancels)).alias("canceled_at"),
    )
    eligible = (c("bad_start") == 0) & (c("spent_tail") == 0)
    verdict = verdict.join(issue.select("issue_id", "event_id"), "issue_id").withColumn(
        "outcome", F.when(eligible, "RECOVERED").otherwise("NOT_ELIGIBLE")
    )
    fixed = verdict.filter(c("outcome") == "RECOVERED")
    deletes = chain.filter(in_tail).join(fixed.select("issue_id"), "issue_id", "left_semi").select("history_id", "issue_id")
    return Proposal(
        _with_unknown(verdict.select("issue_id", "event_id", "outcome"), ids, issue, "issue_id"),
        issue_updates=fixed.select("issue_id", "status", "used_at", "canceled_at"),
        history_deletes=deletes,
    )


def sync_times(
    issue: DataFrame, history: DataFrame, ids: DataFrame | None = None,
    tolerance_seconds: int = TIME_SYNC_TOLERANCE_SECONDS,
) -> Proposal:
    """Move issued_at / used_at to the latest history time; re-issued coupons are left to a person."""
    c = F.col
    rows = _only(issue, ids, "event_id").filter(c("status").isin(ISSUED, USED)).select(
        "issue_id", "event_id", "status", "issued_at", "used_at",
        F.when(c("status") == USED, c("used_at")).otherwise(c("issued_at")).alias("issue_time"),
    )
    latest = latest_history(history if ids is None else history.join(rows.select("issue_id"), "issue_id", "left_semi"), "from_status")
    reentry = (c("status") == ISSUED) & c("from_status").isNotNull()
    apart = c("issue_time").isNull() | (
        F.abs(micros_between(c("issue_time"), c("occurred_at"))) > tolerance_seconds * 1_000_000
    )
    judged = rows.join(latest, "issue_id").withColumn(
        "outcome", F.when(reentry, "NOT_ELIGIBLE").when(apart, "PATCHED")
    ).filter(c("outcome").isNotNull())
    patched = judged.filter(c("outcome") == "PATCHED").select(
        "issue_id",
        F.when(c("status") == ISSUED, c("occurred_at")).otherwise(c("issued_at")).alias("issued_at"),
        F.when(c("status") == USED, c("occurred_at")).otherwise(c("used_at")).alias("used_at"),
    )
    return Proposal(_with_unknown(judged.select("issue_id", "event_id", "outcome"), ids, issue, "event_id"), issue_updates=patched)


def restore_initial_history(
    issue: DataFrame, history: DataFrame, now: datetime, ids: DataFrame | None = None
) -> Proposal:
    """Write the missing first history row of an untouched issue."""
    c = F.col
    targets = _only(issue, ids, "issue_id").select(
        "issue_id", "event_id", "status", "request_id", "issued_at", "used_at", "canceled_at"
    )
    mine = history.join(targets.select("issue_id", "request_id"), "issue_id").groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("history_count"),
        F.count(F.when(
            c("from_status").isNull() & (c("to_status") == ISSUED) & (c("event_uid") == c("request_id")), 1
        )).alias("restored_rows"),
    )
    wanted = targets.select(c("request_id").alias("event_uid"))
    taken = history.select("event_uid").join(wanted, "event_uid", "left_semi").select(c("event_uid").alias("request_id")).distinct().withColumn("taken", F.lit(True))
    judged = (
        targets.join(mine, "issue_id", "left").join(taken, "request_id", "left")
        .fillna(0, ["history_count", "restored_rows"])
        .withColumn(
            "outcome",
            F.when(~F.coalesce(is_uuid(c("request_id")), F.lit(False)) | c("issued_at").isNull(), "INVALID_SOURCE")
            .when(
                (c("status") == ISSUED) & c("used_at").isNull() & c("canceled_at").isNull() & (c("restored_rows") == 1),
                "ALREADY_RESOLVED",
            )
            .when(~F.coalesce(c("status") == ISSUED, F.lit(False)) | (c("history_count") != 0), "NOT_VIOLATING")
            .when(c("used_at").isNotNull() | c("canceled_at").isNotNull(), "TOUCHED")
            .when(c("taken"), "UID_TAKEN")
            .otherwise("RESTORED"),
        )
    )
    inserts = _history_rows(
        judged.filter(c("outcome") == "RESTORED"), F.lit(None), ISSUED, ACTOR_SYSTEM, REASON_ISSUE_CONFIRMED,
        c("issued_at"), ts(now), "restore", now, uid=c("request_id"),
    )
    return Proposal(_with_unknown(judged.select("issue_id", "event_id", "history_count", "outcome"), ids, issue, "issue_id"), history_inserts=inserts)


def expire_delayed(
    issue: DataFrame, history: DataFrame, now: datetime, ids: DataFrame | None = None,
    delay_millis: int = EXPIRATION_DELAY_MILLIS,
) -> Proposal:
    """Expire coupons the regular sweep missed, after checking each again (no skew tolerance here)."""
    c = F.col
    at = ts(now)
    targets = _only(issue, ids, "issue_id")
    done = (
        history.filter(
            (c("from_status") == ISSUED) & (c("to_status") == EXPIRED) & (c("actor") == ACTOR_SYSTEM)
            & (c("reason") == REASON_RECOVERY_EXPIRATION)
        ).select("issue_id").distinct().withColumn("recovered_before", F.lit(True))
    )
    sound = (
        c("user_id").isNotNull() & (c("issue_sequence") > 0) & is_uuid(c("request_id"))
        & (c("message_id").isNull() | is_uuid(c("message_id")))
        & (c("issued_at") <= c("valid_from")) & (c("valid_from") < c("valid_to")) & (c("created_at") >= c("issued_at"))
    )
    no = F.lit(False)
    judged = targets.join(done, "issue_id", "left").withColumn(
        "outcome",
        F.when((c("status") == EXPIRED) & c("used_at").isNull() & c("recovered_before"), "ALREADY_RESOLVED")
        .when(
            ~F.coalesce(c("status") == ISSUED, no) | c("used_at").isNotNull() | c("valid_to").isNull(), "NOT_VIOLATING"
        )
        .when(~(c("valid_to") + millis(delay_millis) < at), "NOT_DUE")
        .when(c("created_at").isNull() | (c("created_at") > at), "NOT_CREATED_YET")
        .when(~F.coalesce(sound, no), "INVALID_STRUCTURE")
        .otherwise("EXPIRED"),
    )
    expired = judged.filter(c("outcome") == "EXPIRED")
    return Proposal(
        _with_unknown(judged.select("issue_id", "event_id", "outcome"), ids, issue, "issue_id"),
        issue_updates=expired.select("issue_id", F.lit(EXPIRED).alias("status")),
        history_inserts=_history_rows(
            expired, F.lit(ISSUED), EXPIRED, ACTOR_SYSTEM, REASON_RECOVERY_EXPIRATION, c("valid_to"), at, "expire", now
        ),
    )


# Rules whose repair takes only one kind of violation.
REPAIRABLE_TYPES = {"issue_history_state": ("NO_HISTORY",), "expiration_lag": ("EXPIRATION_BATCH_DELAY",)}

# Rules repaired campaign by campaign; the others go issue by issue.
EVENT_WISE = ("stock", "state_chain", "time_sync")

ACTIONS = {
    "stock": ("STOCK_RECONCILE_COUNTER", "STOCK_REVOKE_EXCESS_ISSUANCE"),
    "state_chain": ("RESTORE_STATE_MACHINE",),
    "time_sync": ("SYNC_TIME_TO_HISTORY",),
    "issue_history_state": ("RESTORE_INITIAL_ISSUE_HISTORY",),
    "expiration_lag": ("EXPIRE_DELAYED_ISSUE",),
}


def recovery_targets(violations: DataFrame, issue: DataFrame, check: str, event_id: int | None = None) -> DataFrame:
    """Distinct campaigns or issues a repair of ``check`` has to visit."""
    rows = violations.filter(F.col("check_name") == check)
    if check in REPAIRABLE_TYPES:
        rows = rows.filter(F.col("violation_type").isin(*REPAIRABLE_TYPES[check]))
        return rows.select(F.col("target_id").alias("issue_id")).distinct()
    if event_id is not None:
        return issue.sparkSession.createDataFrame([(event_id,)], "event_id long")
    if check == "stock":
        return rows.select(F.col("target_id").alias("event_id")).distinct()
    return (
        issue.join(rows.select(F.col("target_id").alias("issue_id")), "issue_id", "left_semi")
        .select("event_id").distinct()
    )


def recovery_actions(results: DataFrame) -> DataFrame:
    """Actions offered per result; rules without a repair list none."""
    spark: SparkSession = results.sparkSession
    rows = [(check, action) for check, actions in ACTIONS.items() for action in actions]
    offered = spark.createDataFrame(rows, "check_name string, action string")
    return results.select("result_id", "check_name").join(F.broadcast(offered), "check_name", "left")


def apply_changes(
    base: DataFrame, key: str, updates: DataFrame | None = None, deletes: DataFrame | None = None,
    inserts: DataFrame | None = None,
) -> DataFrame:
    """Next state of a table: column updates by key, then deletes, then new rows.

    ``updates`` holds the key and the columns to overwrite (one row per key). The result
    goes to a new folder; the base is never overwritten in place.
    """
    out = base
    if updates is not None:
        columns = [c for c in updates.columns if c != key]
        patch = updates.select(key, F.struct(*columns).alias("_patch"))
        out = out.join(patch, key, "left").select(
            *[
                (F.when(F.col("_patch").isNotNull(), F.col(f"_patch.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
                for c in base.columns
            ]
        )
    if deletes is not None:
        out = out.join(deletes.select(key), key, "left_anti")
    if inserts is not None:
        out = out.unionByName(inserts, allowMissingColumns=True)
    return out


def recovery_status(outcomes: DataFrame, recheck: DataFrame) -> DataFrame:
    """RECOVERED when every outcome succeeded and the repeated audit passed, else RECOVERY_FAILED.

    ``outcomes``: result_id, event_id, succeeded. ``recheck``: event_id, passed (EVENT scope).
    """
    judged = outcomes.join(recheck, "event_id", "left").withColumn(
        "ok", F.col("succeeded") & F.coalesce(F.col("passed"), F.lit(False))
    )
    return judged.groupBy("result_id").agg(
        F.when(F.bool_and("ok"), "RECOVERED").otherwise("RECOVERY_FAILED").alias("recovery_status"),
        F.count(F.lit(1)).alias("outcomes"),
        F.count(F.when(F.col("ok"), 1)).alias("recovered"),
    )


def repairable(results: DataFrame) -> DataFrame:
    """Results a repair may start from: failed ones, of rules that have a repair."""
    return results.filter((F.col("status") == "FAIL") & F.col("check_name").isin(*ACTIONS))
