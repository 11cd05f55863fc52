"""The coupon-shaped views as SQL text for the reference side of each comparison."""

from __future__ import annotations


def _uuid(prefix: str, key: str) -> str:
    h = f"md5(concat('{prefix}', CAST({key} AS VARCHAR)))"
    return (
        f"concat(substr({h},1,8),'-',substr({h},9,4),'-',substr({h},13,4),'-',substr({h},17,4),'-',substr({h},21,12))"
    )


def request_uuid(key: str) -> str:
    return _uuid("req:", key)


# Masking of personal data as arguments of regexp_replace (fixed values).
EMAIL = r"'([\w.+-]{1,3})[\w.+-]*(@[\w.-]+\.[A-Za-z]{2,})', '\1****\2', 'g'"
PHONE = r"'\b(0\d{1,2})[-.\s]?(\d{3,4})[-.\s]?(\d{4})\b', '\1-****-\3', 'g'"

# name -> (views it reads, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["d_issue"] = ((), f"""
  SELECT key + 1 AS issue_id, key % 25 + 1 AS event_id,
    CASE WHEN k = 7 THEN NULL ELSE o_custkey + 1 END AS user_id,
    CASE WHEN k = 8 THEN 0 ELSE key // 25 + 1 END AS issue_sequence,
    CASE WHEN k = 1 THEN concat('INVALID-REQUEST-ID-', CAST(key + 1 AS VARCHAR)) ELSE {_uuid('req:', 'key')} END AS request_id,
    CASE WHEN k = 10 THEN '13:1755000000000-0' WHEN key % 3 = 0 THEN NULL ELSE {_uuid('msg:', 'key')} END AS message_id,
    status,
    CASE WHEN k <> 11 THEN ia END AS issued_at,
    ia AS valid_from,
    CASE WHEN k = 3 THEN ia ELSE ia + INTERVAL 24 HOUR END AS valid_to,
    CASE WHEN k = 9 THEN NULL WHEN k = 12 THEN ia + INTERVAL 25 HOUR
         WHEN status = 'USED' THEN ia + (key % 20 + 1) * INTERVAL 1 HOUR END AS used_at,
    CASE WHEN k = 6 THEN NULL WHEN status = 'CANCELED' THEN ia + (key % 5 + 1) * INTERVAL 1 HOUR END AS canceled_at,
    CASE WHEN k = 4 THEN ia - INTERVAL 6 SECOND WHEN k = 5 THEN ia - INTERVAL 5 SECOND ELSE ia + INTERVAL 1 SECOND END AS created_at
  FROM (
    SELECT o_orderkey AS key, o_orderkey % 101 AS k, o_custkey,
      o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND AS ia,
      CASE WHEN o_orderkey % 101 = 2 THEN 'UNKNOWN' WHEN o_orderkey % 101 = 6 THEN 'CANCELED'
           WHEN o_orderkey % 101 IN (9, 12) THEN 'USED'
           WHEN o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0 THEN 'CANCELED'
           WHEN o_orderstatus = 'F' THEN 'USED' WHEN o_orderstatus = 'P' THEN 'EXPIRED' ELSE 'ISSUED' END AS status
    FROM orders)
""")

VIEWS["d_history"] = (("d_issue",), """
  SELECT issue_id * 10 + slot AS history_id, issue_id, from_status,
    CASE WHEN from_status IS NOT NULL AND q = 3 THEN 'INVALID_STATUS'
         WHEN from_status IS NOT NULL AND q = 6 THEN NULL ELSE to_status END AS to_status,
    'SYSTEM' AS actor, reason, occurred_at,
    CASE WHEN q = 5 THEN occurred_at - INTERVAL 6 SECOND WHEN q = 11 THEN NULL ELSE occurred_at + INTERVAL 1 SECOND END AS recorded_at,
    concat('uid-', CAST(issue_id * 10 + slot AS VARCHAR)) AS event_uid
  FROM (
    SELECT issue_id, q, slot, from_status, to_status, reason,
      CASE WHEN q = 4 THEN moved_at + INTERVAL 5 SECOND ELSE moved_at END AS occurred_at
    FROM (
      SELECT issue_id, issue_id % 103 AS q, 1 AS slot, CAST(NULL AS VARCHAR) AS from_status,
        CASE WHEN issue_id % 103 = 12 THEN 'USED' ELSE 'ISSUED' END AS to_status, 'ISSUE_CONFIRMED' AS reason, valid_from AS moved_at
      FROM d_issue WHERE issue_id % 103 <> 1
      UNION ALL
      SELECT issue_id, issue_id % 103, 2, 'ISSUED', status,
        CASE WHEN status = 'EXPIRED' AND issue_id % 103 = 8 THEN 'MANUAL_EXPIRED' END,
        CASE WHEN status = 'USED' THEN coalesce(used_at, valid_from + INTERVAL 1 HOUR)
             WHEN status = 'CANCELED' THEN coalesce(canceled_at, valid_from + INTERVAL 1 HOUR)
             WHEN issue_id % 103 = 7 THEN valid_to + INTERVAL 1801 SECOND
             WHEN issue_id % 103 = 8 THEN valid_to - INTERVAL 1 HOUR
             WHEN issue_id % 103 = 10 THEN valid_to - INTERVAL 1 SECOND
             ELSE valid_to + INTERVAL 60 SECOND END
      FROM d_issue WHERE status IN ('USED', 'EXPIRED', 'CANCELED')
      UNION ALL
      SELECT issue_id, 9, 3, 'USED', 'ISSUED', 'USE_CANCELED', used_at + INTERVAL 10 MINUTE FROM d_issue WHERE status = 'USED' AND issue_id % 103 = 9
      UNION ALL
      SELECT issue_id, 9, 4, 'ISSUED', 'USED', NULL, used_at + INTERVAL 20 MINUTE FROM d_issue WHERE status = 'USED' AND issue_id % 103 = 9
      UNION ALL
      SELECT issue_id, 2, 5, 'ISSUED', 'USED', NULL, valid_from + INTERVAL 30 HOUR FROM d_issue WHERE status = 'USED' AND issue_id % 103 = 2
      UNION ALL
      SELECT issue_id, 13, 6, 'USED', 'EXPIRED', NULL, valid_from + INTERVAL 40 HOUR FROM d_issue WHERE status = 'USED' AND issue_id % 103 = 13
      UNION ALL
      SELECT issue_id, 14, 7, 'USED', 'ISSUED', NULL, valid_from + INTERVAL 2 HOUR FROM d_issue WHERE status = 'ISSUED' AND issue_id % 103 = 14
    ))
""")

VIEWS["d_event"] = (("d_issue",), """
  SELECT n + 1 AS event_id, region + 1 AS coupon_id, CAST(n // 5 + 1 AS INTEGER) AS round,
    TIMESTAMP '1995-01-01 00:00:00' AS open_at, TIMESTAMP '2001-08-02 00:00:00' + n * INTERVAL 24 HOUR AS close_at,
    act + n % 3 AS total_stock, n % 3 - CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS remaining_stock,
    act + CASE WHEN n = 7 THEN 1 ELSE 0 END AS issued_quantity, 1 AS per_user_limit,
    CASE n % 4 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'SOLD_OUT' WHEN 2 THEN 'OPEN' ELSE 'SCHEDULED' END AS status,
    TIMESTAMP '1994-12-01 00:00:00' + n * INTERVAL 24 HOUR AS created_at,
    TIMESTAMP '1994-12-01 00:00:00' + n * INTERVAL 24 HOUR AS updated_at
  FROM (
    SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS region, coalesce(a.active, 0) AS act
    FROM nation LEFT JOIN (
      SELECT event_id, count(*) AS active FROM d_issue WHERE status IN ('ISSUED', 'USED', 'EXPIRED') GROUP BY event_id
    ) a ON a.event_id = n_nationkey + 1)
""")

VIEWS["d_coupon"] = ((), """
  SELECT CAST(r_regionkey AS BIGINT) + 1 AS coupon_id, r_name AS coupon_name,
    CASE WHEN r_regionkey % 2 = 0 THEN 'FIXED' ELSE 'RATE' END AS type,
    (CAST(r_regionkey AS BIGINT) + 1) * 1000 AS value, 24 AS valid_hours,
    TIMESTAMP '1994-11-01 00:00:00' + r_regionkey * INTERVAL 24 HOUR AS created_at
  FROM region
""")

VIEWS["d_user"] = ((), """
  SELECT c_custkey + 1 AS user_id, concat(replace(lower(c_name), '#', ''), '@test.com') AS email, c_name AS name,
    concat('010-', substr(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 1, 4), '-', substr(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 5, 4)) AS phone,
    TIMESTAMP '1994-01-01 00:00:00' AS created_at
  FROM customer
""")

VIEWS["d_state"] = (("d_event",), """
  SELECT event_id, total_stock,
    total_stock - issued_quantity + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END - CASE WHEN event_id % 6 = 0 THEN 2 ELSE 0 END AS remaining_stock,
    issued_quantity - CASE WHEN event_id % 11 = 0 THEN 3 ELSE 0 END AS confirmed_quantity,
    CAST(CASE WHEN event_id % 9 = 0 THEN 4 ELSE 0 END AS BIGINT) AS pending,
    open_at, close_at, close_at + INTERVAL 168 HOUR AS expire_at
  FROM d_event WHERE event_id % 5 <> 0
""")

VIEWS["d_request"] = ((), f"""
  SELECT event_id % 6 + 1 AS campaign_id, user_id + 1 AS user_id,
    {_uuid('req:', '(CASE WHEN event_id % 24 = 23 THEN event_id - 6 ELSE event_id END)')} AS request_id,
    ts AS arrived_at, event_id + 1 AS arrival_no
  FROM events
""")

VIEWS["d_campaign"] = ((), """
  SELECT CAST(r_regionkey AS BIGINT) + 1 AS campaign_id, coalesce(s.c, 0) // 5 + 1 AS total_stock,
    TIMESTAMP '2024-01-02 00:00:00' AS open_at, TIMESTAMP '2024-01-29 00:00:00' AS close_at,
    TIMESTAMP '2024-02-05 00:00:00' AS expire_at
  FROM region LEFT JOIN (
    SELECT n_regionkey, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey
  ) s ON s.n_regionkey = r_regionkey
""")

VIEWS["d_failure"] = ((), f"""
  SELECT event_id AS failure_id, event_id * 3 % 25 + 1 AS event_id, user_id + 1 AS user_id,
    {_uuid('req:', 'event_id * 3')} AS request_id,
    CASE WHEN event_id % 2 = 0 THEN event_id * 3 // 25 + 1 END AS issue_sequence,
    CASE event_id % 4 WHEN 0 THEN 'DB_INSERT' WHEN 1 THEN 'RELAY' WHEN 2 THEN 'COMPENSATE' ELSE 'CONFIRM' END AS failure_stage,
    CASE event_id % 9 WHEN 1 THEN 'CALL_FAILED' WHEN 2 THEN 'SKIPPED_UNVERIFIED' WHEN 3 THEN 'SKIPPED_PERSISTED'
      WHEN 4 THEN 'INTERNAL_WRITE_ERROR' WHEN 5 THEN 'COMPENSATED' WHEN 6 THEN 'CONFIRMED_NOW'
      WHEN 7 THEN 'REQUEST_NOT_FOUND' WHEN 8 THEN 'ALREADY_CONFIRMED' END AS compensation_result,
    concat('call by user', CAST(user_id AS VARCHAR), '@test.com failed: ', props) AS error_message,
    ts AS occurred_at,
    CASE WHEN event_id % 6 <> 0 THEN ts + INTERVAL 1 HOUR END AS last_attempt_at,
    CAST(event_id % 3 AS INTEGER) AS attempt_count,
    CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 2 HOUR END AS resolved_at
  FROM events WHERE event_type = 'error'
""")

VIEWS["d_request_state"] = (("d_failure",), """
  SELECT event_id AS campaign_id, request_id,
    CASE WHEN failure_id % 13 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
    CASE WHEN failure_id % 5 = 4 THEN 8 WHEN failure_id % 10 = 3 THEN 1 ELSE 0 END AS code,
    CASE WHEN failure_id % 5 = 4 THEN 2 WHEN failure_id % 10 = 3 THEN 3 WHEN failure_id % 5 = 1 THEN 1 ELSE 0 END AS lifecycle,
    coalesce(issue_sequence, 1) AS issue_sequence, CAST(0 AS BIGINT) AS remaining,
    occurred_at AS decided_at, occurred_at AS updated_at
  FROM d_failure WHERE failure_id % 7 <> 0
""")


VIEWS["d_entry"] = ((), f"""
  SELECT concat(CAST(1755000000000 + CASE WHEN k % 20 = 19 THEN k - 1 ELSE k END AS VARCHAR), '-0') AS entry_id,
    CASE WHEN k % 17 = 0 THEN 'COMPENSATE' ELSE 'ISSUE' END AS "type",
    CASE WHEN k % 31 = 1 THEN 'not-a-uuid' WHEN k % 20 = 19 THEN {_uuid('req:', '(k - 1)')} ELSE {_uuid('req:', 'k')} END AS "requestId",
    CASE WHEN k % 31 = 2 THEN 'abc' WHEN k % 17 = 0 THEN NULL WHEN k % 20 = 19 THEN CAST((k - 1) % 25 + 1 AS VARCHAR)
         ELSE CAST(k % 25 + 1 AS VARCHAR) END AS "campaignId",
    CASE WHEN k % 31 = 3 THEN '-4' ELSE CAST(u AS VARCHAR) END AS "userId",
    CAST((u - 1) // 8388608 AS VARCHAR) AS "bitmapSegmentId",
    CASE WHEN k % 31 = 4 THEN '-1' ELSE CAST((u - 1) % 8388608 AS VARCHAR) END AS "bitOffset",
    CASE WHEN k % 31 = 5 THEN '0' WHEN k % 20 = 19 THEN CAST((k - 1) // 25 + 1 AS VARCHAR) ELSE CAST(k // 25 + 1 AS VARCHAR) END AS "issueSequence",
    CASE WHEN k % 31 = 6 THEN ' ' ELSE CAST(1755000000000 + k * 7 AS VARCHAR) END AS "decidedAt"
  FROM (SELECT o_orderkey AS k, o_custkey + 1 AS u FROM orders
        UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 20 = 18)
""")


def with_views(body: str, *names: str) -> str:
    """``body`` preceded by the views it names and those they read."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    inner = body.strip()
    if inner[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join(parts)}, {inner[15:]}"
    if inner[:5].upper() == "WITH ":
        return f"WITH {', '.join(parts)}, {inner[5:]}"
    return f"WITH {', '.join(parts)} {inner}" if parts else inner
