"""Fixed table schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _T = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()


def _schema(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


USER = _schema(("user_id", _L), ("email", _S), ("name", _S), ("phone", _S), ("created_at", _T))

COUPON = _schema(
    ("coupon_id", _L), ("coupon_name", _S), ("type", _S), ("value", _L), ("valid_hours", _I),
    ("created_at", _T),
)

EVENT = _schema(
    ("event_id", _L), ("coupon_id", _L), ("round", _I), ("open_at", _T), ("close_at", _T),
    ("total_stock", _L), ("remaining_stock", _L), ("issued_quantity", _L), ("per_user_limit", _I),
    ("status", _S), ("created_at", _T), ("updated_at", _T),
)

ISSUE = _schema(
    ("issue_id", _L), ("event_id", _L), ("user_id", _L), ("issue_sequence", _L), ("request_id", _S),
    ("message_id", _S), ("status", _S), ("issued_at", _T), ("valid_from", _T), ("valid_to", _T),
    ("used_at", _T), ("canceled_at", _T), ("created_at", _T),
)

HISTORY = _schema(
    ("history_id", _L), ("issue_id", _L), ("from_status", _S), ("to_status", _S), ("actor", _S),
    ("reason", _S), ("occurred_at", _T), ("recorded_at", _T), ("event_uid", _S),
)

IDEMPOTENCY = _schema(
    ("event_uid", _S), ("issue_id", _L), ("user_id", _L), ("target_status", _S), ("from_status", _S),
    ("event_id", _L), ("occurred_at", _T), ("created_at", _T),
)

FAILURE = _schema(
    ("failure_id", _L), ("event_id", _L), ("user_id", _L), ("request_id", _S), ("issue_sequence", _L),
    ("failure_stage", _S), ("compensation_result", _S), ("error_message", _S), ("incident_id", _S),
    ("occurred_at", _T), ("last_attempt_at", _T), ("attempt_count", _I), ("resolved_at", _T),
    ("resolved_by", _S), ("resolve_reason", _S), ("resolve_probe_result", _S),
)

INITIALIZATION = _schema(
    ("event_id", _L), ("status", _S), ("attempt_count", _I), ("last_attempted_at", _T),
    ("initialized_at", _T), ("last_error_code", _S), ("last_error_message", _S), ("updated_at", _T),
)

RESULT = _schema(
    ("result_id", _L), ("check_name", _S), ("trigger_type", _S), ("scope_type", _S), ("event_id", _L),
    ("scope_from", _T), ("scope_to", _T), ("status", _S), ("violation_count", _L),
    ("diff_detail", _S), ("error_message", _S), ("executed_at", _T), ("duration_millis", _L),
    ("recovery_status", _S),
)

VIOLATION = _schema(
    ("check_name", _S), ("target_type", _S), ("target_id", _L), ("event_id", _L),
    ("violation_type", _S), ("detail", _S),
)

STORED_VIOLATION = _schema(*[(f.name, f.dataType) for f in VIOLATION.fields], ("result_id", _L), ("violation_id", _L))

RECOVERY = _schema(
    ("recovery_id", _L), ("result_id", _L), ("check_name", _S), ("action", _S), ("detail", _S),
    ("message", _S), ("status", _S), ("created_at", _T),
)

# Stream entries arrive as text only.
STREAM_ENTRY = _schema(
    ("entry_id", _S), ("type", _S), ("requestId", _S), ("campaignId", _S), ("userId", _S),
    ("bitmapSegmentId", _S), ("bitOffset", _S), ("issueSequence", _S), ("decidedAt", _S),
)

REQUEST = _schema(
    ("campaign_id", _L), ("user_id", _L), ("request_id", _S), ("arrived_at", _T), ("arrival_no", _L),
)

TABLES = {
    "user": USER, "coupon": COUPON, "event": EVENT, "issue": ISSUE, "history": HISTORY,
    "idempotency": IDEMPOTENCY, "failure": FAILURE, "initialization": INITIALIZATION,
    "result": RESULT, "recovery": RECOVERY,
}
