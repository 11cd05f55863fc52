"""The audit rules. Each takes the tables and a scope and returns its violating rows with typed columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroll.constants import (
    ACTIVE_STATUSES, CANCELED, CLOCK_SKEW_SECONDS, CLOSED, EXPIRATION_DELAY_MILLIS, EXPIRED,
    HISTORY_TRANSITIONS, ISSUE_STATUSES, ISSUED, MAX_BATCH_LAG_SECONDS, REASON_MANUAL_EXPIRED, SOLD_OUT,
    TIME_SYNC_TOLERANCE_SECONDS, USED,
)
from tallyroll.functions.ids import is_uuid
from tallyroll.functions.times import micros_between, millis, seconds, seconds_between, ts
from tallyroll.operators.chains import chain_breaks, continued_breaks, latest_history
from tallyroll.plans.scope import ALL, AS_OF_RANGE, EVENT, Scope
from tallyroll.sources.ledger import Tables


def _scoped_issue(issue: DataFrame, scope: Scope) -> DataFrame:
    """Issues of a campaign or of an ALL audit; a campaign set also brings the creation cut-off."""
    rows = scope.keep_events(issue)
    if scope.kind == ALL and scope.event_set is not None:
        rows = rows.filter(F.col("created_at") < ts(scope.end))
    return rows


def _created_issue(issue: DataFrame, scope: Scope) -> DataFrame:
    """Issues by campaign or creation time; an ALL scope without a campaign set holds nothing."""
    if scope.kind == EVENT:
        return scope.keep_events(issue)
    if scope.kind == AS_OF_RANGE:
        return issue.filter(scope.within(F.col("created_at")))
    if scope.event_set is None:
        return issue.filter(F.lit(False))
    return scope.keep_events(issue).filter(F.col("created_at") < ts(scope.end))


def active_counts(issue: DataFrame) -> DataFrame:
    """Issues that hold stock, per campaign."""
    return (
        issue.filter(F.col("status").isin(*ACTIVE_STATUSES))
        .groupBy("event_id").agg(F.count(F.lit(1)).alias("actual_active_count"))
    )


def stock(tables: Tables, scope: Scope) -> DataFrame:
    """Campaign counters against the issues that hold stock."""
    events = scope.keep_events(tables.event)
    issues = tables.issue.select("event_id", "status")
    if scope.kind == ALL:
        events = events.filter(F.col("status").isin(SOLD_OUT, CLOSED))
    else:
        issues = scope.keep_events(issues)
    active = F.coalesce(F.col("actual_active_count"), F.lit(0))
    return (
        events.select("event_id", "total_stock", "issued_quantity", "remaining_stock")
        .join(active_counts(issues), "event_id", "left")
        .withColumn("actual_active_count", active)
        .filter(
            (F.col("total_stock") != F.col("actual_active_count") + F.col("remaining_stock"))
            | (F.col("issued_quantity") != F.col("actual_active_count"))
        )
        .withColumn("violation_type", F.lit("STOCK_MISMATCH"))
    )


def loss_outcomes(tables: Tables, scope: Scope) -> DataFrame:
    """Expected against stored issues per campaign, with the outcome of comparing them."""
    stored = (
        scope.keep_events(tables.issue).filter(F.col("issue_sequence").isNotNull())
        .groupBy("event_id").agg(F.count(F.lit(1)).alias("actual_count"))
    )
    state = tables.state.select(
        "event_id", F.col("remaining_stock").alias("state_remaining"), F.coalesce(F.col("pending"), F.lit(0)).alias("pending")
    )
    actual = F.coalesce(F.col("actual_count"), F.lit(0))
    remaining = F.coalesce(F.col("state_remaining"), F.col("total_stock"))
    expected = F.col("total_stock") - remaining
    outcome = (
        F.when(F.coalesce(F.col("pending"), F.lit(0)) > 0, "POSTPONED")
        .when(F.col("state_remaining").isNull() & (actual > 0), "IMPOSSIBLE")
        .when(expected == actual, "PASS")
        .otherwise("FAIL")
    )
    return (
        scope.keep_events(tables.event).select("event_id", "total_stock")
        .join(stored, "event_id", "left").join(state, "event_id", "left")
        .select(
            "event_id", "total_stock", remaining.alias("remaining_stock"), expected.alias("expected_count"),
            actual.alias("actual_count"), (expected - actual).alias("lost_count"), outcome.alias("outcome"),
        )
    )


def loss(tables: Tables, scope: Scope) -> DataFrame:
    """Campaigns whose accepted count and stored count differ."""
    return (
        loss_outcomes(tables, scope).filter(F.col("outcome") == "FAIL").drop("outcome")
        .withColumn("violation_type", F.lit("ISSUE_LOSS"))
    )


def loss_errors(tables: Tables, scope: Scope) -> DataFrame:
    """Campaigns the loss audit cannot judge: entries in flight, or no live state left."""
    return loss_outcomes(tables, scope).filter(F.col("outcome").isin("POSTPONED", "IMPOSSIBLE"))


def state_chain(tables: Tables, scope: Scope) -> DataFrame:
    """Broken status chains, one row per history row that does not continue."""
    issues = _created_issue(tables.issue, scope).select("issue_id", "event_id")
    history = tables.history
    if scope.kind != ALL:
        # A narrow scope shrinks the history before it is sorted; an ALL scope would not.
        history = history.join(issues.select("issue_id"), "issue_id", "left_semi")
    return _broken(chain_breaks(history), issues)


def _broken(breaks: DataFrame, issues: DataFrame) -> DataFrame:
    return (
        breaks.join(issues, "issue_id").withColumn("violation_type", F.lit("BROKEN_CHAIN"))
        .select("issue_id", "event_id", "history_id", "prev_to_status", "from_status", "to_status", "violation_type")
    )


def state_chain_since(issue: DataFrame, heads: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """Broken chains that ``new`` history brings to ledgers audited up to ``heads`` (``chains.chain_heads`` of ``old``).

    Old history is read only for issues that a late row reaches back into; they are reported whole, others by their
    new rows.
    """
    return _broken(continued_breaks(heads, new, old), issue.select("issue_id", "event_id"))


def issue_structure(tables: Tables, scope: Scope, skew_seconds: int = CLOCK_SKEW_SECONDS) -> DataFrame:
    """Faulty fields of one issue row; the first rule that fails names the violation."""
    c = F.col
    no = F.lit(False)
    used_conflict = (
        (c("status").isin(ISSUED, EXPIRED, CANCELED) & c("used_at").isNotNull())
        | ((c("status") == USED) & (c("used_at").isNull() | (c("used_at") < c("valid_from"))))
    )
    rule = (
        F.when(c("user_id").isNull(), "MISSING_USER_ID")
        .when(c("issue_sequence").isNull() | (c("issue_sequence") <= 0), "INVALID_ISSUE_SEQUENCE")
        .when(~F.coalesce(is_uuid(c("request_id")), no), "INVALID_REQUEST_ID")
        .when(c("message_id").isNotNull() & ~is_uuid(c("message_id")), "INVALID_MESSAGE_ID_FORMAT")
        .when(~F.coalesce(c("status").isin(*ISSUE_STATUSES), no), "INVALID_STATUS")
        .when(
            c("issued_at").isNull() | c("valid_from").isNull() | c("valid_to").isNull() | c("created_at").isNull(),
            "MISSING_TIMESTAMP",
        )
        .when(
            (c("issued_at") > c("valid_from")) | (c("valid_from") >= c("valid_to"))
            | (c("issued_at") > c("created_at") + seconds(skew_seconds)),
            "INVALID_TIMESTAMP_ORDER",
        )
        .when((c("status") == CANCELED) & c("canceled_at").isNull(), "MISSING_CANCELED_AT")
        .when(used_conflict, "INVALID_STATUS_FIELDS")
    )
    return (
        _scoped_issue(tables.issue, scope).withColumn("violation_type", rule)
        .filter(c("violation_type").isNotNull())
        .select(
            "issue_id", "event_id", "user_id", "status", "issued_at", "valid_from", "valid_to", "used_at",
            "canceled_at", "violation_type",
        )
    )


def history_structure(tables: Tables, scope: Scope, skew_seconds: int = CLOCK_SKEW_SECONDS) -> DataFrame:
    """Faulty fields of one history row, or a status pair that may not occur."""
    c = F.col
    legal = F.lit(False)
    for before, after in HISTORY_TRANSITIONS:
        legal = legal | ((c("from_status") == before) & (c("to_status") == after))
    rule = (
        F.when(c("to_status").isNull(), "MISSING_TO_STATUS")
        .when(c("occurred_at").isNull() | c("recorded_at").isNull(), "MISSING_TIMESTAMP")
        .when(c("occurred_at") > c("recorded_at") + seconds(skew_seconds), "INVALID_TIMESTAMP_ORDER")
        .when(~c("to_status").isin(*ISSUE_STATUSES), "INVALID_TO_STATUS")
        .when(c("from_status").isNull() & (c("to_status") != ISSUED), "INVALID_INITIAL_TRANSITION")
        .when(c("from_status").isNotNull() & ~legal, "INVALID_STATUS_TRANSITION")
    )
    rows = tables.history
    if scope.kind == AS_OF_RANGE:
        rows = rows.filter(c("recorded_at").isNull() | scope.within(c("recorded_at")))
    bad = (
        rows.withColumn("violation_type", rule).filter(c("violation_type").isNotNull())
        .select("history_id", "issue_id", "from_status", "to_status", "occurred_at", "recorded_at", "violation_type")
    )
    narrowed = scope.kind == EVENT or (scope.kind == ALL and scope.event_set is not None)
    if not narrowed:
        # Nothing of the issue is needed, so the issue table is not read at all.
        return bad.withColumn("event_id", F.lit(None).cast("long"))
    # The owner is looked up after filtering, so only violating rows take part in the join.
    return bad.join(_scoped_issue(tables.issue, scope).select("issue_id", "event_id"), "issue_id")


def _latest_of(tables: Tables, issues: DataFrame, narrow: bool) -> DataFrame:
    history = tables.history
    if narrow:
        history = history.join(issues.select("issue_id"), "issue_id", "left_semi")
    return latest_history(history, "from_status", "to_status", "reason")


def _state_rule() -> Column:
    """Issue status (``status``) against the newest history row."""
    return F.when(F.col("history_id").isNull(), "NO_HISTORY").when(
        ~F.col("to_status").eqNullSafe(F.col("status")), "LATEST_STATUS_MISMATCH"
    )


def _issue_time() -> Column:
    c = F.col
    return F.when(c("status") == USED, c("used_at")).when(c("status") == ISSUED, c("issued_at")).when(c("status") == EXPIRED, c("valid_to"))


def _time_rule(max_lag_seconds: int, tolerance_seconds: int) -> Column:
    """Issue time (``issue_time``) against the newest history row's time, where the statuses agree."""
    c = F.col
    gap = micros_between(c("issue_time"), c("occurred_at"))
    first_hand = (c("status") == USED) | ((c("status") == ISSUED) & c("from_status").isNull())
    swept = (c("status") == EXPIRED) & (c("reason").isNull() | (c("reason") != REASON_MANUAL_EXPIRED))
    wrong = (
        c("issue_time").isNull()
        | (first_hand & (F.abs(gap) > tolerance_seconds * 1_000_000))
        | (swept & ((c("occurred_at") < c("issue_time"))
                    | (seconds_between(c("issue_time"), c("occurred_at")) > max_lag_seconds)))
    )
    agree = c("status").isin(ISSUED, USED, EXPIRED) & (c("status") == c("to_status"))
    return F.when(agree & wrong, "TIME_MISMATCH")


_STATE_COLUMNS = ("current_status", "history_id", "from_status", "to_status", "occurred_at")
_TIME_COLUMNS = ("status", "issue_time", "history_time", "time_diff_micros")


def issue_history_state(tables: Tables, scope: Scope) -> DataFrame:
    """Issue status against the newest history row."""
    issues = _scoped_issue(tables.issue, scope).select("issue_id", "event_id", "status")
    return (
        issues.join(_latest_of(tables, issues, scope.kind == EVENT), "issue_id", "left").withColumn("violation_type", _state_rule())
        .filter(F.col("violation_type").isNotNull())
        .withColumnRenamed("status", "current_status").select("issue_id", "event_id", *_STATE_COLUMNS, "violation_type")
    )


def time_sync(
    tables: Tables, scope: Scope, max_lag_seconds: int = MAX_BATCH_LAG_SECONDS,
    tolerance_seconds: int = TIME_SYNC_TOLERANCE_SECONDS,
) -> DataFrame:
    """Issue times against the newest history row's time."""
    issues = _created_issue(tables.issue, scope).filter(F.col("status").isin(ISSUED, USED, EXPIRED)).select(
        "issue_id", "event_id", "status", _issue_time().alias("issue_time")
    )
    return (
        issues.join(_latest_of(tables, issues, scope.kind != ALL), "issue_id")
        .withColumn("violation_type", _time_rule(max_lag_seconds, tolerance_seconds))
        .filter(F.col("violation_type").isNotNull())
        .select(
            "issue_id", "event_id", "status", "issue_time", F.col("occurred_at").alias("history_time"),
            F.abs(micros_between(F.col("issue_time"), F.col("occurred_at"))).alias("time_diff_micros"), "violation_type",
        )
    )


def latest_row_rules(
    tables: Tables, scope: Scope, max_lag_seconds: int = MAX_BATCH_LAG_SECONDS,
    tolerance_seconds: int = TIME_SYNC_TOLERANCE_SECONDS,
) -> DataFrame:
    """Both rules on the newest history row in one pass over the history.

    An issue breaks at most one of them: the time rule only looks at issues whose status
    agrees. ``detail`` is the JSON each rule would give on its own. For campaign scopes.
    """
    c = F.col
    issues = _scoped_issue(tables.issue, scope).select("issue_id", "event_id", "status", _issue_time().alias("issue_time"))
    rows = issues.join(_latest_of(tables, issues, scope.kind == EVENT), "issue_id", "left")
    state = _state_rule()
    rows = rows.withColumn("violation_type", F.coalesce(state, _time_rule(max_lag_seconds, tolerance_seconds))).filter(
        c("violation_type").isNotNull()
    )
    timed = c("violation_type") == "TIME_MISMATCH"
    gap = F.abs(micros_between(c("issue_time"), c("occurred_at")))
    time_detail = dict(zip(_TIME_COLUMNS, (c("status"), c("issue_time"), c("occurred_at"), gap)))
    state_detail = dict(zip(_STATE_COLUMNS, (c("status"), c("history_id"), c("from_status"), c("to_status"), c("occurred_at"))))
    pack = lambda fields: F.to_json(F.struct(c("issue_id"), *[v.alias(k) for k, v in fields.items()]))
    return rows.select(
        F.when(timed, "time_sync").otherwise("issue_history_state").alias("check_name"), "issue_id", "event_id", "violation_type",
        F.when(timed, pack(time_detail)).otherwise(pack(state_detail)).alias("detail"),
    )


def expiration_lag(
    tables: Tables, scope: Scope, checked_at: datetime | None = None, delay_millis: int = EXPIRATION_DELAY_MILLIS
) -> DataFrame:
    """Coupons still open after their end plus the allowed delay, and coupons used after their end."""
    c = F.col
    issues = tables.issue
    if scope.kind == AS_OF_RANGE:
        issues = issues.filter(scope.within(c("valid_to")))
    else:
        issues = scope.keep_events(issues)
    at = ts(scope.end if scope.kind == ALL else checked_at)
    known = (lambda col: col < at) if scope.kind == ALL else (lambda col: col <= at)
    late = (c("status") == ISSUED) & (c("valid_to") + millis(delay_millis) < at) & known(c("created_at"))
    used_late = (c("status") == USED) & (c("used_at") > c("valid_to")) & known(c("used_at"))
    return (
        issues.filter(late | used_late)
        .select(
            "issue_id", "event_id", "status", "valid_to", "used_at",
            F.when(c("status") == ISSUED, "EXPIRATION_BATCH_DELAY").otherwise("USED_AFTER_EXPIRATION").alias("violation_type"),
        )
    )


# --- uniqueness and accuracy audits -------------------------------------------------


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values held by more than one row; rows with a missing key part are ignored."""
    return df.dropna(subset=columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def duplicate_users(issue: DataFrame) -> DataFrame:
    """Users holding more than one issue of a campaign."""
    return duplicate_keys(issue, ["event_id", "user_id"])


def sequence_density(issue: DataFrame) -> DataFrame:
    """Highest sequence against the number of stored rows per campaign."""
    return (
        issue.groupBy("event_id")
        .agg(F.max("issue_sequence").alias("max_sequence"), F.count(F.lit(1)).alias("rows"))
        .withColumn("dense", F.col("max_sequence").eqNullSafe(F.col("rows")))
    )


def sequence_gaps(issue: DataFrame) -> DataFrame:
    """Sequences whose predecessor is missing, found by an equi-join on (campaign, sequence)."""
    have = issue.filter(F.col("issue_sequence") > 0).select("event_id", "issue_sequence").distinct()
    before = have.select("event_id", (F.col("issue_sequence") + 1).alias("issue_sequence"))
    return have.filter(F.col("issue_sequence") > 1).join(before, ["event_id", "issue_sequence"], "left_anti")


def accuracy_summary(tables: Tables, decisions: DataFrame | None = None) -> DataFrame:
    """One row per campaign: stored issues, first history rows, ids present, failures, decision counts."""
    c = F.col
    count_if = lambda cond: F.count(F.when(cond, 1))
    stored = tables.issue.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("issue_rows"),
        F.max("issue_sequence").alias("max_sequence"),
        count_if(c("message_id").isNotNull()).alias("message_ids"),
    )
    first_rows = tables.history.filter(c("from_status").isNull()).select("issue_id")
    firsts = (
        first_rows.join(tables.issue.select("issue_id", "event_id"), "issue_id")
        .groupBy("event_id").agg(F.count(F.lit(1)).alias("history_rows"))
    )
    failed = tables.failure.groupBy("event_id").agg(F.count(F.lit(1)).alias("failures"))
    out = (
        tables.event.select("event_id", "total_stock").join(stored, "event_id", "left")
        .join(firsts, "event_id", "left").join(failed, "event_id", "left")
    )
    if decisions is not None:
        made = decisions.groupBy(c("campaign_id").alias("event_id")).agg(
            F.count(F.lit(1)).alias("requests"),
            count_if(c("code") == 0).alias("accepted"),
            count_if(c("code") == 1).alias("sold_out"),
        )
        out = out.join(made, "event_id", "left").fillna(0, ["requests", "accepted", "sold_out"])
    out = out.fillna(0, ["issue_rows", "history_rows", "message_ids", "failures"])
    accurate = (
        (c("issue_rows") == c("history_rows")) & (c("issue_rows") == c("total_stock"))
        & c("max_sequence").eqNullSafe(c("issue_rows")) & (c("failures") == 0)
        & (c("message_ids") == c("issue_rows"))
    )
    if decisions is not None:
        accurate = accurate & (c("accepted") == c("total_stock")) & (c("sold_out") == c("requests") - c("total_stock"))
    return out.withColumn("accurate", accurate)
