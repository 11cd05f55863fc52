"""Failure ledger: triage, listings, summaries and retry planning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroll.constants import (
    STAGE_GROUPS,
)
from tallyroll.functions.text import mask_text, truncate
from tallyroll.functions.times import convert_local, ts
from tallyroll.operators.persistence import compensate, confirm, probe

SETTLED, RETRYABLE, UNRECOVERABLE = "SETTLED", "RETRYABLE", "UNRECOVERABLE"


def stage_group(stage: Column) -> Column:
    """CONFIRM stands alone; every other stage is a persistence failure."""
    return F.when(stage == "CONFIRM", "CONFIRM").otherwise("PERSIST")


def _result_in(kind: str) -> Column:
    """Is the result in its own group's set? NULL for a NULL result."""
    result, group = F.col("compensation_result"), stage_group(F.col("failure_stage"))
    return F.when(group == "CONFIRM", result.isin(*STAGE_GROUPS["CONFIRM"][kind])).otherwise(
        result.isin(*STAGE_GROUPS["PERSIST"][kind])
    )


def failure_status() -> Column:
    no = F.lit(False)
    return (
        F.when(F.col("resolved_at").isNotNull(), SETTLED)
        .when(F.coalesce(_result_in("settled"), no), SETTLED)
        .when(F.coalesce(_result_in("retryable"), no), RETRYABLE)
        .otherwise(UNRECOVERABLE)
    )


def with_group(df: DataFrame) -> DataFrame:
    return df.withColumn("stage_group", stage_group(F.col("failure_stage")))


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", failure_status())


def with_actions(df: DataFrame) -> DataFrame:
    """Actions a person may take: none, RETRY, or RETRY and (after an attempt) RESOLVE."""
    status = failure_status()
    return df.withColumn(
        "actions",
        F.when(status == SETTLED, "")
        .when((status == UNRECOVERABLE) & (F.col("attempt_count") > 0), "RETRY,RESOLVE")
        .otherwise("RETRY"),
    )


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page, as a bounded top-k followed by an offset."""
    return df.orderBy(*order).offset(number * size).limit(size)


def failures_page(
    df: DataFrame, number: int, size: int, event_id: int | None = None, stage: str | None = None,
    status: str | None = None, request_id: str | None = None,
) -> DataFrame:
    """Listing by last attempt (never tried first), then id; a request id overrides the other filters."""
    if request_id and request_id.strip():
        df = df.filter(F.col("request_id") == request_id.strip())
    else:
        if event_id is not None:
            df = df.filter(F.col("event_id") == event_id)
        if stage is not None:
            df = df.filter(F.col("failure_stage") == stage)
        if status is not None:
            df = df.filter(failure_status() == status)
    order = [F.col("last_attempt_at").asc_nulls_first(), F.col("failure_id").asc()]
    return page(with_status(df), order, number, size)


def failure_detail(df: DataFrame, failure_id: int) -> DataFrame:
    return with_actions(with_status(df.filter(F.col("failure_id") == failure_id)))


def failure_summary(df: DataFrame) -> DataFrame:
    """Settled, retryable and unrecoverable counts per stage group; missing results count as unrecoverable."""
    count_if = lambda s: F.count(F.when(F.col("status") == s, 1))
    return with_status(with_group(df)).groupBy("stage_group").agg(
        count_if(SETTLED).alias("settled"), count_if(RETRYABLE).alias("retryable"),
        count_if(UNRECOVERABLE).alias("unrecoverable"),
    )


def blocked_events(df: DataFrame, per_group: int | None = None) -> DataFrame:
    """Campaigns held up by unresolved failures; missing results do not hold a campaign up.

    All of them, or the first ``per_group`` campaigns of each stage group.
    """
    open_rows = with_group(df).filter(F.col("resolved_at").isNull() & ~_result_in("settled"))
    pairs = open_rows.select("stage_group", "event_id").distinct()
    if per_group is not None:
        w = Window.partitionBy("stage_group").orderBy("event_id")
        pairs = pairs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_group)
    return pairs.select("event_id").distinct()


def retry_targets(df: DataFrame, group: str, limit: int | None = None) -> DataFrame:
    """Failures to retry: all, or the next ``limit``, never tried first, then the longest untried."""
    rules = STAGE_GROUPS[group]
    rows = df.filter(
        F.col("failure_stage").isin(*rules["stages"]) & F.col("resolved_at").isNull()
        & F.col("compensation_result").isin(*rules["retryable"])
    )
    if limit is None:
        return rows
    return rows.orderBy(F.col("last_attempt_at").asc_nulls_first(), F.col("failure_id").asc()).limit(limit)


def sweep_unrecoverable(df: DataFrame, group: str) -> DataFrame:
    """Failures a sweep reports as beyond retry; rows without a result are not among them."""
    rules = STAGE_GROUPS[group]
    return df.filter(
        F.col("failure_stage").isin(*rules["stages"]) & F.col("resolved_at").isNull()
        & ~F.col("compensation_result").isin(*rules["retryable"])
        & ~F.col("compensation_result").isin(*rules["settled"])
    ).agg(F.count(F.lit(1)).alias("unrecoverable"))


def new_failures(df: DataFrame, zone: str = "Asia/Seoul", max_chars: int | None = None) -> DataFrame:
    """Rows ready to append: error text masked, whole unless ``max_chars`` is given, UTC time turned into wall-clock time."""
    message = mask_text(F.col("error_message"))
    return df.withColumn(
        "error_message", message if max_chars is None else truncate(message, max_chars)
    ).withColumn("occurred_at", convert_local(F.col("occurred_at"), zone))


def append_failures(df: DataFrame, folder: str, zone: str = "Asia/Seoul") -> None:
    new_failures(df, zone).write.mode("append").parquet(folder)


def _attempted(rows: DataFrame, now: datetime) -> DataFrame:
    return rows.withColumn("attempt_count", F.col("attempt_count") + 1).withColumn("last_attempt_at", ts(now))


def _close(rows: DataFrame, now: datetime, outcomes: tuple[str, ...]) -> DataFrame:
    done = F.col("outcome").isin(*outcomes)
    return rows.withColumn("resolved_at", F.when(done, F.coalesce(F.col("resolved_at"), ts(now))).otherwise(F.col("resolved_at")))


def retry_confirms(df: DataFrame, state: DataFrame, now: datetime, limit: int | None = None) -> DataFrame:
    """One sweep over failed confirmations: attempted rows with their outcome and new columns."""
    rows = _attempted(retry_targets(df, "CONFIRM", limit), now)
    answered = confirm(state, rows.select("failure_id", F.col("event_id").alias("campaign_id"), "user_id", "request_id"), "failure_id")
    result = F.col("confirm_result")
    outcome = (
        F.when(result == "CONFIRMED_NOW", "RESOLVED").when(result == "ALREADY_CONFIRMED", "ALREADY_RESOLVED")
        .when(result == "REQUEST_NOT_FOUND", "EXPIRED")
        .when(result.isin("NOT_CONFIRMABLE", "CORRUPTED_STATE", "INVALID_ARGUMENT"), "NOT_RETRYABLE")
        .otherwise("RETRY_FAILED")
    )
    out = rows.join(answered.select("failure_id", "confirm_result"), "failure_id").withColumn("outcome", outcome)
    out = out.withColumn(
        "compensation_result",
        F.when(F.col("outcome").isin("EXPIRED", "NOT_RETRYABLE"), result).otherwise(F.col("compensation_result")),
    )
    return _close(out, now, ("RESOLVED", "ALREADY_RESOLVED"))


def retry_compensations(
    df: DataFrame, issue: DataFrame, state: DataFrame, now: datetime, limit: int | None = None
) -> DataFrame:
    """One sweep over failed stores: stored ones are confirmed, absent ones are given back."""
    rows = _attempted(retry_targets(df, "PERSIST", limit), now)
    probed = rows.join(probe(rows, issue).select("failure_id", "probe_result"), "failure_id")
    cmds = probed.select("failure_id", F.col("event_id").alias("campaign_id"), "user_id", "request_id", "probe_result")
    confirmed = confirm(state, cmds.filter(F.col("probe_result") == "PERSISTED"), "failure_id")
    returned = compensate(state, cmds.filter(F.col("probe_result") == "ABSENT"), "failure_id")
    c = F.col
    joined = (
        probed.join(confirmed.select("failure_id", "confirm_result"), "failure_id", "left")
        .join(returned.select("failure_id", "compensate_result"), "failure_id", "left")
    )
    answer = F.coalesce(c("confirm_result"), c("compensate_result"))
    outcome = (
        F.when(c("confirm_result").isin("CONFIRMED_NOW", "ALREADY_CONFIRMED"), "SKIPPED_PERSISTED")
        .when(c("compensate_result") == "COMPENSATED", "RESOLVED")
        .when(c("compensate_result") == "ALREADY_COMPENSATED", "ALREADY_RESOLVED")
        .when(answer == "REQUEST_NOT_FOUND", "EXPIRED")
        .when(answer.isin("NOT_CONFIRMABLE", "NOT_COMPENSABLE", "CORRUPTED_STATE", "INVALID_ARGUMENT"), "NOT_RETRYABLE")
        .otherwise("RETRY_FAILED")
    )
    out = joined.withColumn("outcome", outcome).withColumn(
        "compensation_result", F.when(c("outcome") != "RETRY_FAILED", answer).otherwise(c("compensation_result"))
    )
    return _close(out, now, ("SKIPPED_PERSISTED", "RESOLVED", "ALREADY_RESOLVED"))


def sweep_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


def resolve_manually(df: DataFrame, cmds: DataFrame, issue: DataFrame, now: datetime) -> DataFrame:
    """Close failures by hand. ``cmds``: failure_id, reason, operator. A blank reason is refused.

    The storage probe at closing time is kept with the reason.
    """
    rows = df.join(cmds, "failure_id")
    probed = probe(rows, issue).select("failure_id", "probe_result")
    has_reason = F.coalesce(F.length(F.trim(F.col("reason"))) > 0, F.lit(False))
    operator = F.when(F.coalesce(F.length(F.trim(F.col("operator"))) > 0, F.lit(False)), F.trim(F.col("operator"))).otherwise("unknown")
    return rows.join(probed, "failure_id").select(
        "failure_id",
        F.when(has_reason, "RESOLVED").otherwise("REASON_REQUIRED").alias("outcome"),
        F.when(has_reason, F.coalesce(F.col("resolved_at"), ts(now))).otherwise(F.col("resolved_at")).alias("resolved_at"),
        F.when(has_reason, operator).alias("resolved_by"),
        F.when(has_reason, F.trim(F.col("reason"))).alias("resolve_reason"),
        F.when(has_reason, F.col("probe_result")).alias("resolve_probe_result"),
    )
