"""Listings, lookups and time series, with personal data masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroll.constants import ISSUED
from tallyroll.functions.text import mask_email, mask_name, mask_phone
from tallyroll.functions.times import local_to_offset_text, micros_between, plus
from tallyroll.operators.failures import page
from tallyroll.plans.segments import number_segment, spread


def masked_users(user: DataFrame) -> DataFrame:
    return user.select(
        "user_id", mask_name(F.col("name")).alias("name"), mask_email(F.col("email")).alias("email"),
        mask_phone(F.col("phone")).alias("phone"),
    )


def issuance_log(
    pending: DataFrame, issue: DataFrame, user: DataFrame, event_id: int, after: int, size: int, zone: str = "Asia/Seoul"
) -> DataFrame:
    """Issues of a campaign after a sequence, stored rows before those still being stored.

    One row more than ``size`` is returned as the last row with ``is_extra`` set, which tells that
    more follow. ``pending``: event_id, user_id, issue_sequence, decided_at.
    """
    c = F.col
    mine = (c("event_id") == event_id) & (c("issue_sequence") > after)
    blank = F.lit(None).cast("timestamp_ntz")
    stored = issue.filter(mine).select(
        "user_id", "issue_sequence", "status", "issued_at", c("created_at").alias("persisted_at"), F.lit(0).alias("source"), "issue_id"
    )
    flying = pending.filter(mine).select(
        "user_id", "issue_sequence", F.lit("PROCESSING").alias("status"), c("decided_at").alias("issued_at"),
        blank.alias("persisted_at"), F.lit(1).alias("source"), F.lit(0).cast("long").alias("issue_id"),
    )
    row = F.struct("source", "issue_id", "user_id", "status", "issued_at", "persisted_at")
    top = (
        stored.unionByName(flying).groupBy("issue_sequence").agg(F.min(row).alias("row"))
        .orderBy("issue_sequence").limit(size + 1)
    )
    rows = top.select("issue_sequence", "row.*").join(masked_users(user), "user_id", "left")
    # At most size + 1 rows are left here, so counting the earlier ones is a bounded window.
    position = F.row_number().over(Window.partitionBy(F.lit(event_id)).orderBy("issue_sequence"))
    return rows.select(
        "issue_sequence", "user_id", "name", "email", "phone", "status",
        local_to_offset_text(c("issued_at"), zone).alias("issued_at"),
        local_to_offset_text(c("persisted_at"), zone).alias("persisted_at"),
        (position > size).alias("is_extra"),
    )


def recent_events(event: DataFrame, coupon: DataFrame, status: str | None = None, size: int | None = None) -> DataFrame:
    """Rounds with their coupon: all, or the ``size`` newest."""
    rows = event if status is None else event.filter(F.col("status") == status)
    newest = rows if size is None else rows.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(size)
    return newest.join(coupon.select("coupon_id", "coupon_name", "type", "value"), "coupon_id").select(
        "event_id", "coupon_id", "coupon_name", "type", "value", "round", "status", "total_stock", "remaining_stock", "created_at"
    )


def search_coupons(coupon: DataFrame, keyword: str | None = None, size: int | None = None) -> DataFrame:
    """Coupons whose name contains the keyword, case ignored and wildcards literal: all, or the ``size`` newest."""
    rows = coupon
    if keyword and keyword.strip():
        rows = rows.filter(F.contains(F.lower(F.col("coupon_name")), F.lit(keyword.strip().lower())))
    return rows if size is None else rows.orderBy(F.col("created_at").desc(), F.col("coupon_id").desc()).limit(size)


def results_page(results: DataFrame, number: int, size: int, status: str | None = None) -> DataFrame:
    rows = results if status is None else results.filter(F.col("status") == status)
    return page(rows, [F.col("executed_at").desc(), F.col("result_id").desc()], number, size)


def violations_page(violations: DataFrame, result_id: int, number: int, size: int) -> DataFrame:
    rows = violations.filter(F.col("result_id") == result_id)
    return page(rows, [F.col("violation_id").desc()], number, size)


def recoveries_page(recoveries: DataFrame, number: int, size: int) -> DataFrame:
    return page(recoveries, [F.col("created_at").desc(), F.col("recovery_id").desc()], number, size)


def lookup_issue(
    issue: DataFrame, event_id: int | None = None, user_id: int | None = None, request_id: str | None = None,
    message_id: str | None = None,
) -> DataFrame:
    """Issues by (campaign, user), request id or message id."""
    if request_id is not None:
        return issue.filter(F.col("request_id") == request_id)
    if message_id is not None:
        return issue.filter(F.col("message_id") == message_id)
    return issue.filter((F.col("event_id") == event_id) & (F.col("user_id") == user_id))


def user_issues(issue: DataFrame, user_id: int) -> DataFrame:
    return issue.filter(F.col("user_id") == user_id)


def issue_counts(issue: DataFrame, statuses: tuple[str, ...] | None = None) -> DataFrame:
    rows = issue if statuses is None else issue.filter(F.col("status").isin(*statuses))
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("rows"))


def rounds_of(event: DataFrame, coupon_id: int | None = None, status: str | None = None) -> DataFrame:
    rows = event
    if coupon_id is not None:
        rows = rows.filter(F.col("coupon_id") == coupon_id)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows


def eligible_users(user: DataFrame, issue: DataFrame, event_id: int) -> DataFrame:
    """Users who hold no coupon of the round yet."""
    holders = issue.filter((F.col("event_id") == event_id) & F.col("user_id").isNotNull()).select("user_id")
    return user.select("user_id").join(holders, "user_id", "left_anti")


def _bucket(at: Column, interval: str) -> Column:
    return F.window(at, interval)["start"].alias("bucket")


def verification_series(results: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Audit outcomes per time bucket, rule, status and scope, placed at their end time."""
    ended = plus(F.col("executed_at"), F.col("duration_millis"), "MILLISECOND")
    return (
        results.withColumn("ended_at", ended)
        .groupBy(_bucket(F.col("ended_at"), interval), "check_name", "status", "scope_type")
        .agg(F.count(F.lit(1)).alias("runs"))
    )


def issue_series(decisions: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Allocation answers per time bucket and reason."""
    reason = F.when(F.col("code") == 0, "ACCEPTED").when(F.col("code") == 1, "SOLD_OUT").when(
        F.col("code") == 2, "ALREADY_ISSUED").when(F.col("code").isin(3, 4), "EVENT_NOT_OPEN").otherwise("OTHER")
    return (
        decisions.withColumn("reason", reason).groupBy(_bucket(F.col("arrived_at"), interval), "reason")
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def relay_series(issue: DataFrame, failures: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Stored issues and given-up deliveries per time bucket and reason."""
    stored = issue.select(F.col("created_at").alias("at"), F.lit("success").alias("result"), F.lit("STORED").alias("reason"))
    reason = F.when(F.col("failure_stage") == "CONFIRM", "CONFIRM_ABANDONED").otherwise("PERSIST_ABANDONED")
    lost = failures.select(F.col("occurred_at").alias("at"), F.lit("fail").alias("result"), reason.alias("reason"))
    counts = lambda df: df.groupBy(_bucket(F.col("at"), interval), "result", "reason").agg(F.count(F.lit(1)).alias("entries"))
    return counts(stored.filter(F.col("at").isNotNull())).unionByName(counts(lost))


def transition_series(history: DataFrame, interval: str = "1 day") -> DataFrame:
    """Status changes per time bucket and transition; first issues are not changes."""
    moves = history.filter(F.col("from_status").isNotNull() & F.col("occurred_at").isNotNull())
    return moves.groupBy(_bucket(F.col("occurred_at"), interval), "from_status", "to_status").agg(
        F.count(F.lit(1)).alias("changes"))


def transition_failures(results: DataFrame, interval: str = "1 day") -> DataFrame:
    """Refused commands per time bucket, target and reason."""
    bad = results.filter(F.col("result") != "SUCCESS")
    return bad.groupBy(_bucket(F.col("at"), interval), "target_status", "result").agg(F.count(F.lit(1)).alias("commands"))


def storage_lag(history: DataFrame, issue: DataFrame, exact: bool = False) -> DataFrame:
    """Time from the decision to the stored row per campaign, in microseconds; negative means clock skew."""
    lag = micros_between(F.col("occurred_at"), F.col("recorded_at"))
    rows = (
        history.filter((F.col("to_status") == ISSUED) & F.col("from_status").isNull()).select("issue_id", lag.alias("lag"))
        .filter(F.col("lag").isNotNull()).join(issue.select("issue_id", "event_id"), "issue_id")
    )
    quantiles = [] if exact else [F.percentile_approx("lag", p, 10_000).cast("double").alias(n) for n, p in LAG_QUANTILES.items()]
    out = rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("lag").alias("min_lag"), F.avg("lag").alias("avg_lag"), *quantiles, F.max("lag").alias("max_lag"),
        F.count(F.when(F.col("lag") < 0, 1)).alias("reversals"),
    )
    if exact:
        out = out.join(exact_quantiles(rows, "event_id", "lag", LAG_QUANTILES), "event_id")
    return out.select("event_id", "rows", "min_lag", "avg_lag", *LAG_QUANTILES, "max_lag", "reversals")


LAG_QUANTILES = {"p50_lag": 0.5, "p99_lag": 0.99}


def exact_quantiles(rows: DataFrame, key: str, value: str, quantiles: dict[str, float], width: int = 1000) -> DataFrame:
    """Interpolated quantiles of whole numbers per key, without a key's values meeting in one place.

    Values are counted first, so equal ones are one row. Counts run up inside segments of ``width`` values; only one row a
    segment is carried over them.
    """
    c = F.col
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_segment", number_segment(c(value), width))
    segments = counted.groupBy(key, "_segment").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = segments.select(key, "_segment", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_segment").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spread(counted.join(carried, [key, "_segment"]), key, "_segment").withColumn("_end", c("_before") + F.sum("_n").over(inside))
    placed = placed.join(segments.groupBy(key).agg(F.sum("_sum").alias("_all")), key)

    def at(rank):
        return F.max(F.when((c("_end") - c("_n") <= rank) & (rank < c("_end")), c(value))).cast("double")

    places = {name: (c("_all") - 1) * F.lit(q) for name, q in quantiles.items()}
    ends = placed.groupBy(key).agg(
        F.first("_all").alias("_all"), *[at(F.floor(p)).alias(f"_{n}_low") for n, p in places.items()], *[at(F.ceil(p)).alias(f"_{n}_high") for n, p in places.items()])
    return ends.select(
        key, *[(c(f"_{n}_low") + (c(f"_{n}_high") - c(f"_{n}_low")) * (p - F.floor(p))).alias(n) for n, p in places.items()])


def decision_histogram(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("campaign_id", "code").agg(F.count(F.lit(1)).alias("requests"))
