"""Failure ledger queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqlviews import EMAIL, PHONE, with_views
from tallyroll.operators import failures, persistence
from tallyroll.sources import derived

NOW = datetime(2024, 2, 10)
PERSIST_RETRY = "('CALL_FAILED', 'SKIPPED_UNVERIFIED', 'SKIPPED_PERSISTED', 'INTERNAL_WRITE_ERROR')"
PERSIST_DONE = "('COMPENSATED', 'ALREADY_COMPENSATED', 'CONFIRMED_NOW', 'ALREADY_CONFIRMED')"
CONFIRM_RETRY = "('CALL_FAILED', 'INTERNAL_WRITE_ERROR')"
CONFIRM_DONE = "('CONFIRMED_NOW', 'ALREADY_CONFIRMED')"
STATUS = f"""CASE WHEN resolved_at IS NOT NULL THEN 'SETTLED'
  WHEN compensation_result IS NULL THEN 'UNRECOVERABLE'
  WHEN failure_stage = 'CONFIRM' AND compensation_result IN {CONFIRM_DONE} THEN 'SETTLED'
  WHEN failure_stage <> 'CONFIRM' AND compensation_result IN {PERSIST_DONE} THEN 'SETTLED'
  WHEN failure_stage = 'CONFIRM' AND compensation_result IN {CONFIRM_RETRY} THEN 'RETRYABLE'
  WHEN failure_stage <> 'CONFIRM' AND compensation_result IN {PERSIST_RETRY} THEN 'RETRYABLE'
  ELSE 'UNRECOVERABLE' END"""
GROUP = "CASE WHEN failure_stage = 'CONFIRM' THEN 'CONFIRM' ELSE 'PERSIST' END"


def _f(spark, sf_dir):
    return derived.failure(spark, sf_dir)


@query("failure_triage", with_views(f"""
    SELECT failure_id, {GROUP} AS stage_group, {STATUS} AS status,
      CASE {STATUS} WHEN 'SETTLED' THEN '' WHEN 'RETRYABLE' THEN 'RETRY'
        ELSE CASE WHEN attempt_count > 0 THEN 'RETRY,RESOLVE' ELSE 'RETRY' END END AS actions
    FROM d_failure""", "d_failure"))
def failure_triage(spark, sf_dir):
    return failures.with_actions(failures.with_status(failures.with_group(_f(spark, sf_dir)))).select(
        "failure_id", "stage_group", "status", "actions")


@query("failure_page", with_views(f"""
    SELECT failure_id, event_id, failure_stage, compensation_result, last_attempt_at, {STATUS} AS status
    FROM d_failure WHERE failure_stage = 'RELAY' AND {STATUS} = 'RETRYABLE'
    ORDER BY last_attempt_at ASC NULLS FIRST, failure_id LIMIT 20 OFFSET 40""", "d_failure"))
def failure_page(spark, sf_dir):
    return failures.failures_page(_f(spark, sf_dir), 2, 20, stage="RELAY", status="RETRYABLE").select(
        "failure_id", "event_id", "failure_stage", "compensation_result", "last_attempt_at", "status")


@query("failure_by_request", with_views(f"""
    SELECT failure_id, request_id, {STATUS} AS status FROM d_failure
    WHERE request_id = (SELECT request_id FROM d_failure ORDER BY failure_id LIMIT 1)""", "d_failure"))
def failure_by_request(spark, sf_dir):
    f = _f(spark, sf_dir)
    first = f.orderBy("failure_id").select("request_id").limit(1)
    return failures.with_status(f.join(first, "request_id", "left_semi")).select("failure_id", "request_id", "status")


@query("failure_detail", with_views(f"""
    SELECT failure_id, {STATUS} AS status, attempt_count FROM d_failure WHERE failure_id = (SELECT min(failure_id) FROM d_failure WHERE failure_id % 9 = 7)""", "d_failure"))
def failure_detail(spark, sf_dir):
    f = _f(spark, sf_dir)
    wanted = f.filter(F.col("failure_id") % 9 == 7).agg(F.min("failure_id").alias("failure_id"))
    return failures.with_actions(failures.with_status(f.join(wanted, "failure_id", "left_semi"))).select("failure_id", "status", "attempt_count")


@query("failure_summary", with_views(f"""
    SELECT {GROUP} AS stage_group, count(*) FILTER ({STATUS} = 'SETTLED') AS settled, count(*) FILTER ({STATUS} = 'RETRYABLE') AS retryable,
      count(*) FILTER ({STATUS} = 'UNRECOVERABLE') AS unrecoverable FROM d_failure GROUP BY 1""", "d_failure"))
def failure_summary(spark, sf_dir):
    return failures.failure_summary(_f(spark, sf_dir))


@query("failure_blocked_events", with_views(f"""
    WITH o AS (SELECT DISTINCT {GROUP} AS g, event_id FROM d_failure WHERE resolved_at IS NULL
      AND ((failure_stage = 'CONFIRM' AND compensation_result NOT IN {CONFIRM_DONE}) OR (failure_stage <> 'CONFIRM' AND compensation_result NOT IN {PERSIST_DONE})))
    SELECT DISTINCT event_id FROM o""", "d_failure"))
def failure_blocked_events(spark, sf_dir):
    return failures.blocked_events(_f(spark, sf_dir))


for _group, _stages, _retry, _done in (
    ("PERSIST", "('DB_INSERT', 'RELAY', 'COMPENSATE')", PERSIST_RETRY, PERSIST_DONE),
    ("CONFIRM", "('CONFIRM')", CONFIRM_RETRY, CONFIRM_DONE),
):
    query(f"failure_retry_targets_{_group.lower()}", with_views(f"""
        SELECT failure_id, event_id, request_id, last_attempt_at FROM d_failure
        WHERE failure_stage IN {_stages} AND resolved_at IS NULL AND compensation_result IN {_retry}""", "d_failure"))(
        lambda s, d, g=_group: failures.retry_targets(_f(s, d), g).select("failure_id", "event_id", "request_id", "last_attempt_at"))
    query(f"failure_sweep_unrecoverable_{_group.lower()}", with_views(f"""
        SELECT count(*) AS unrecoverable FROM d_failure WHERE failure_stage IN {_stages} AND resolved_at IS NULL
          AND compensation_result NOT IN {_retry} AND compensation_result NOT IN {_done}""", "d_failure"))(
        lambda s, d, g=_group: failures.sweep_unrecoverable(_f(s, d), g))


@query("failure_append_rows", with_views(f"""
    SELECT failure_id, regexp_replace(regexp_replace(error_message, {EMAIL}), {PHONE}) AS error_message,
      occurred_at + INTERVAL 9 HOUR AS occurred_at
    FROM d_failure""", "d_failure"))
def failure_append_rows(spark, sf_dir):
    return failures.new_failures(_f(spark, sf_dir)).select("failure_id", "error_message", "occurred_at")


_PROBE = """
  stored AS (SELECT request_id, any_value(event_id) AS e, any_value(user_id) AS u, any_value(issue_sequence) AS s FROM d_issue GROUP BY request_id),
  probed AS (SELECT f.*, CASE WHEN e = f.event_id AND u = f.user_id AND (f.issue_sequence IS NULL OR f.issue_sequence = s) THEN 'PERSISTED' ELSE 'ABSENT' END AS probe_result
    FROM d_failure f LEFT JOIN stored ON stored.request_id = f.request_id)"""


@query("failure_probe", with_views(f"WITH {_PROBE} SELECT failure_id, probe_result FROM probed", "d_failure", "d_issue"))
def failure_probe(spark, sf_dir):
    return persistence.probe(_f(spark, sf_dir), derived.issue(spark, sf_dir)).select("failure_id", "probe_result")


_CONFIRM = """CASE WHEN r.request_id IS NULL THEN 'REQUEST_NOT_FOUND' WHEN r.user_id <> t.user_id THEN 'INVALID_ARGUMENT'
  WHEN r.code = 0 AND r.lifecycle = 1 THEN 'ALREADY_CONFIRMED' WHEN r.code = 0 AND r.lifecycle = 0 THEN 'CONFIRMED_NOW' ELSE 'NOT_CONFIRMABLE' END"""
_COMP = """CASE WHEN r.request_id IS NULL THEN 'REQUEST_NOT_FOUND' WHEN r.user_id <> t.user_id THEN 'INVALID_ARGUMENT'
  WHEN r.code = 8 AND r.lifecycle = 2 THEN 'ALREADY_COMPENSATED' WHEN r.code = 0 AND r.lifecycle = 0 THEN 'COMPENSATED' ELSE 'NOT_COMPENSABLE' END"""


@query("request_confirm", with_views(f"""
    SELECT failure_id, {_CONFIRM} AS confirm_result FROM d_failure t LEFT JOIN d_request_state r
      ON r.request_id = t.request_id AND r.campaign_id = t.event_id""", "d_failure", "d_request_state"))
def request_confirm(spark, sf_dir):
    f = _f(spark, sf_dir)
    cmds = f.select("failure_id", F.col("event_id").alias("campaign_id"), "user_id", "request_id")
    return persistence.confirm(derived.request_state(f), cmds, "failure_id").select("failure_id", "confirm_result")


@query("request_compensate", with_views(f"""
    SELECT failure_id, {_COMP} AS compensate_result FROM d_failure t LEFT JOIN d_request_state r
      ON r.request_id = t.request_id AND r.campaign_id = t.event_id""", "d_failure", "d_request_state"))
def request_compensate(spark, sf_dir):
    f = _f(spark, sf_dir)
    cmds = f.select("failure_id", F.col("event_id").alias("campaign_id"), "user_id", "request_id")
    return persistence.compensate(derived.request_state(f), cmds, "failure_id").select("failure_id", "compensate_result")


@query("request_counter_deltas", with_views(f"""
    WITH c AS (SELECT event_id AS campaign_id, {_CONFIRM} AS r1, {_COMP} AS r2, failure_stage FROM (SELECT * FROM d_failure) t LEFT JOIN d_request_state r
      ON r.request_id = t.request_id AND r.campaign_id = t.event_id)
    SELECT campaign_id, count(*) FILTER (failure_stage = 'CONFIRM' AND r1 = 'CONFIRMED_NOW') AS confirmed,
      count(*) FILTER (failure_stage <> 'CONFIRM' AND r2 = 'COMPENSATED') AS returned
    FROM c WHERE (failure_stage = 'CONFIRM' AND r1 = 'CONFIRMED_NOW') OR (failure_stage <> 'CONFIRM' AND r2 = 'COMPENSATED') GROUP BY campaign_id""", "d_failure", "d_request_state"))
def request_counter_deltas(spark, sf_dir):
    f = _f(spark, sf_dir)
    state = derived.request_state(f)
    cmds = f.select("failure_id", F.col("event_id").alias("campaign_id"), "user_id", "request_id", "failure_stage")
    late = F.col("failure_stage") == "CONFIRM"
    return persistence.counter_deltas(
        persistence.confirm(state, cmds.filter(late), "failure_id"), persistence.compensate(state, cmds.filter(~late), "failure_id"))


_CONFIRM_SWEEP = f"""
  WITH t AS (SELECT * FROM d_failure WHERE failure_stage = 'CONFIRM' AND resolved_at IS NULL AND compensation_result IN {CONFIRM_RETRY}),
  a AS (SELECT t.*, {_CONFIRM} AS res FROM t LEFT JOIN d_request_state r ON r.request_id = t.request_id AND r.campaign_id = t.event_id)
  SELECT failure_id, attempt_count + 1 AS attempt_count, TIMESTAMP '2024-02-10' AS last_attempt_at,
    CASE WHEN res = 'CONFIRMED_NOW' THEN 'RESOLVED' WHEN res = 'ALREADY_CONFIRMED' THEN 'ALREADY_RESOLVED'
      WHEN res = 'REQUEST_NOT_FOUND' THEN 'EXPIRED' ELSE 'NOT_RETRYABLE' END AS outcome,
    CASE WHEN res IN ('CONFIRMED_NOW', 'ALREADY_CONFIRMED') THEN compensation_result ELSE res END AS compensation_result,
    CASE WHEN res IN ('CONFIRMED_NOW', 'ALREADY_CONFIRMED') THEN TIMESTAMP '2024-02-10' END AS resolved_at
  FROM a"""


@query("failure_retry_confirms", with_views(_CONFIRM_SWEEP, "d_failure", "d_request_state"))
def failure_retry_confirms(spark, sf_dir):
    f = _f(spark, sf_dir)
    return failures.retry_confirms(f, derived.request_state(f), NOW).select(
        "failure_id", "attempt_count", "last_attempt_at", "outcome", "compensation_result", "resolved_at")


@query("failure_retry_confirm_counts", with_views(
    f"SELECT outcome, count(*) AS rows FROM ({_CONFIRM_SWEEP}) GROUP BY outcome", "d_failure", "d_request_state"))
def failure_retry_confirm_counts(spark, sf_dir):
    f = _f(spark, sf_dir)
    return failures.sweep_counts(failures.retry_confirms(f, derived.request_state(f), NOW))


@query("failure_retry_compensations", with_views(f"""
  WITH {_PROBE},
  t AS (SELECT * FROM probed WHERE failure_stage <> 'CONFIRM' AND resolved_at IS NULL AND compensation_result IN {PERSIST_RETRY}),
  a AS (SELECT t.*, CASE WHEN t.probe_result = 'PERSISTED' THEN {_CONFIRM} ELSE {_COMP} END AS res
    FROM t LEFT JOIN d_request_state r ON r.request_id = t.request_id AND r.campaign_id = t.event_id)
  SELECT failure_id, attempt_count + 1 AS attempt_count, res AS compensation_result,
    CASE WHEN probe_result = 'PERSISTED' AND res IN ('CONFIRMED_NOW', 'ALREADY_CONFIRMED') THEN 'SKIPPED_PERSISTED'
      WHEN res = 'COMPENSATED' THEN 'RESOLVED' WHEN res = 'ALREADY_COMPENSATED' THEN 'ALREADY_RESOLVED'
      WHEN res = 'REQUEST_NOT_FOUND' THEN 'EXPIRED' ELSE 'NOT_RETRYABLE' END AS outcome,
    CASE WHEN res IN ('CONFIRMED_NOW', 'ALREADY_CONFIRMED', 'COMPENSATED', 'ALREADY_COMPENSATED') THEN TIMESTAMP '2024-02-10' END AS resolved_at
  FROM a""", "d_failure", "d_issue", "d_request_state"))
def failure_retry_compensations(spark, sf_dir):
    f = _f(spark, sf_dir)
    return failures.retry_compensations(f, derived.issue(spark, sf_dir), derived.request_state(f), NOW).select(
        "failure_id", "attempt_count", "compensation_result", "outcome", "resolved_at")


@query("failure_resolve_manually", with_views(f"""
  WITH {_PROBE}
  SELECT failure_id, CASE WHEN failure_id % 4 = 0 THEN 'REASON_REQUIRED' ELSE 'RESOLVED' END AS outcome,
    CASE WHEN failure_id % 4 = 0 THEN resolved_at ELSE coalesce(resolved_at, TIMESTAMP '2024-02-10') END AS resolved_at,
    CASE WHEN failure_id % 4 = 0 THEN NULL WHEN failure_id % 3 = 0 THEN 'unknown' ELSE 'kim' END AS resolved_by,
    CASE WHEN failure_id % 4 <> 0 THEN 'checked by hand' END AS resolve_reason,
    CASE WHEN failure_id % 4 <> 0 THEN probe_result END AS resolve_probe_result
  FROM probed""", "d_failure", "d_issue"))
def failure_resolve_manually(spark, sf_dir):
    f = _f(spark, sf_dir)
    n = F.col("failure_id")
    cmds = f.select(
        "failure_id", F.when(n % 4 == 0, "  ").otherwise(" checked by hand ").alias("reason"),
        F.when(n % 3 == 0, F.lit(None)).otherwise(" kim ").alias("operator"))
    return failures.resolve_manually(f, cmds, derived.issue(spark, sf_dir), NOW)


@query("failure_reason_windows", with_views("""
  SELECT time_bucket(INTERVAL 5 SECOND, ts) AS window_start, event_id % 25 + 1 AS campaign_id,
    CASE event_id % 5 WHEN 0 THEN 'SOLD_OUT' WHEN 1 THEN 'ALREADY_ISSUED' WHEN 2 THEN 'EVENT_NOT_OPEN' ELSE 'UNKNOWN' END AS reason, count(*) AS failures
  FROM events WHERE event_type = 'error' GROUP BY ALL"""))
def failure_reason_windows(spark, sf_dir):
    from tallyroll.streaming.windows import failure_windows

    e = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type") == "error").select(
        (e % 25 + 1).alias("campaign_id"), F.col("ts").cast("timestamp_ntz").alias("at"),
        F.when(e % 5 == 0, "SOLD_OUT").when(e % 5 == 1, "ALREADY_ISSUED").when(e % 5 == 2, "EVENT_NOT_OPEN")
        .when(e % 5 == 3, "EVENT_CLOSED").otherwise("IDEMPOTENCY_CONFLICT").alias("reason"))
    return failure_windows(rows)
