"""Fixed values of the ledger domain: statuses, codes, thresholds, labels."""

# Coupon statuses.
ISSUED, USED, EXPIRED, CANCELED = "ISSUED", "USED", "EXPIRED", "CANCELED"
ISSUE_STATUSES = (ISSUED, USED, EXPIRED, CANCELED)
ACTIVE_STATUSES = (ISSUED, USED, EXPIRED)

# Status pairs a history row may carry (the first row has no from_status).
HISTORY_TRANSITIONS = (
    (ISSUED, USED),
    (ISSUED, EXPIRED),
    (ISSUED, CANCELED),
    (USED, ISSUED),
)

# Campaign round statuses.
SCHEDULED, OPEN, SOLD_OUT, CLOSED = "SCHEDULED", "OPEN", "SOLD_OUT", "CLOSED"

# Allocation decision codes.
DECISION_ACCEPTED = 0
DECISION_SOLD_OUT = 1
DECISION_ALREADY_ISSUED = 2
DECISION_NOT_OPEN = 3
DECISION_CLOSED = 4
DECISION_NOT_INITIALIZED = 5
DECISION_IDEMPOTENCY_CONFLICT = 6
DECISION_CORRUPTED_STATE = 7
DECISION_PERSISTENCE_FAILED = 8
DECISION_INVALID_ARGUMENT = 9
DECISION_INTERNAL_WRITE_ERROR = 10

# Request life cycle stages.
PENDING, CONFIRMED, COMPENSATED, TERMINAL = 0, 1, 2, 3
RECORD_VERSION = "v2"

# Decision code -> request status shown to the user.
REQUEST_STATUS_BY_CODE = {
    DECISION_SOLD_OUT: "REJECTED_SOLD_OUT",
    DECISION_ALREADY_ISSUED: "REJECTED_DUPLICATE",
    DECISION_NOT_OPEN: "REJECTED_NOT_OPEN",
    DECISION_CLOSED: "REJECTED_CLOSED",
}

# Identifier formats and bitmap geometry.
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
MESSAGE_ID_NAMESPACE = "coupon-issue-stream:"
BITMAP_SEGMENT_BITS = 8_388_608

# Audit thresholds.
CLOCK_SKEW_SECONDS = 5
TIME_SYNC_TOLERANCE_SECONDS = 1
MAX_BATCH_LAG_SECONDS = 1800
EXPIRATION_DELAY_MILLIS = 120_000
LOOKBACK_HOURS = 24
SAFETY_MARGIN_SECONDS = 10
ORPHAN_THRESHOLD_MINUTES = 30

# History actors and reasons.
ACTOR_SYSTEM = "SYSTEM"
ACTOR_STOCK_RECOVERY = "SYSTEM_STOCK_RECOVERY"
REASON_REVOKED = "STOCK_OVER_ISSUANCE_AUTO_REVOKE"
REASON_ISSUE_CONFIRMED = "ISSUE_CONFIRMED"
REASON_RECOVERY_EXPIRATION = "CONSISTENCY_RECOVERY_EXPIRATION"
REASON_SCHEDULED_EXPIRATION = "EXPIRED_BY_SCHEDULE"
REASON_MANUAL_EXPIRED = "MANUAL_EXPIRED"
EXPIRE_UID_PREFIX = "EXPIRE:"

# Failure stages and the result names each stage group retries or treats as settled.
FAILURE_STAGES = ("DB_INSERT", "RELAY", "COMPENSATE", "CONFIRM")
STAGE_GROUPS = {
    "PERSIST": {
        "stages": ("DB_INSERT", "RELAY", "COMPENSATE"),
        "retryable": ("CALL_FAILED", "SKIPPED_UNVERIFIED", "SKIPPED_PERSISTED", "INTERNAL_WRITE_ERROR"),
        "settled": ("COMPENSATED", "ALREADY_COMPENSATED", "CONFIRMED_NOW", "ALREADY_CONFIRMED"),
    },
    "CONFIRM": {
        "stages": ("CONFIRM",),
        "retryable": ("CALL_FAILED", "INTERNAL_WRITE_ERROR"),
        "settled": ("CONFIRMED_NOW", "ALREADY_CONFIRMED"),
    },
}
MAX_DELIVERY_ATTEMPTS = 3
CLAIM_IDLE_SECONDS = 30
RETENTION_HOURS = 168
