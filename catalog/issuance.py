"""Allocation, stream entries, storing and delivery."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqlviews import EMAIL, PHONE, VIEWS, request_uuid, with_views
from tallyroll.functions.times import ts
from tallyroll.operators import allocation, checks, persistence, reports
from tallyroll.sources import derived
from tallyroll.sources.stream import pack_request_state, parse_issue_entries, parse_request_state
from tallyroll.streaming.dedup import drop_redelivered

NOW = datetime(2024, 2, 10)
UUID = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"


def uuid3(name: str) -> str:
    """Name-based UUID of a SQL string expression."""
    h = f"md5({name})"
    nibble = f"CAST(('0x' || substr({h}, 17, 1)) AS INTEGER)"
    return (
        f"concat(substr({h},1,8),'-',substr({h},9,4),'-3',substr({h},14,3),'-',"
        f"substr('89ab', {nibble} % 4 + 1, 1),substr({h},18,3),'-',substr({h},21,12))"
    )


VIEWS["d_decision"] = (("d_request", "d_campaign"), """
  WITH r AS (SELECT q.*, row_number() OVER w AS nth, first_value(user_id) OVER w AS fu, first_value(arrival_no) OVER w AS fno
      FROM d_request q WINDOW w AS (PARTITION BY campaign_id, request_id ORDER BY arrival_no)),
  f AS (SELECT r.*, c.total_stock, c.open_at, c.close_at FROM r LEFT JOIN d_campaign c ON c.campaign_id = r.campaign_id WHERE nth = 1),
  u AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, user_id ORDER BY arrival_no) AS m FROM f WHERE arrived_at >= open_at AND arrived_at < close_at),
  p AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY arrival_no) AS place FROM u WHERE m = 1),
  win AS (SELECT * FROM p WHERE place <= total_stock),
  d AS (SELECT f.*, win.place, win.arrival_no AS won_at,
      CASE WHEN f.total_stock IS NULL THEN 5 WHEN f.arrived_at < f.open_at THEN 3 WHEN f.arrived_at >= f.close_at THEN 4
        WHEN win.arrival_no = f.arrival_no THEN 0 WHEN win.arrival_no IS NOT NULL THEN 2 ELSE 1 END AS code
      FROM f LEFT JOIN win ON win.campaign_id = f.campaign_id AND win.user_id = f.user_id),
  a AS (SELECT campaign_id, request_id, code, CASE WHEN code = 0 THEN place END AS issue_sequence,
      CASE WHEN code <> 5 THEN total_stock - count(*) FILTER (code = 0) OVER (PARTITION BY campaign_id ORDER BY arrival_no) END AS remaining,
      CASE WHEN code <> 5 THEN arrived_at END AS decided_at FROM d)
  SELECT r.campaign_id, r.user_id, r.request_id, r.arrived_at, r.arrival_no,
    CAST(CASE WHEN a.code <> 5 AND r.fu <> r.user_id THEN 6 ELSE a.code END AS INTEGER) AS code,
    CASE WHEN a.code = 5 OR r.fu = r.user_id THEN a.issue_sequence END AS issue_sequence,
    CASE WHEN a.code = 5 OR r.fu = r.user_id THEN a.remaining END AS remaining,
    a.decided_at, a.code <> 5 AND r.nth > 1 AS repeated
  FROM r JOIN a ON a.campaign_id = r.campaign_id AND a.request_id = r.request_id
""")


def decisions(spark, sf_dir):
    return allocation.allocate(derived.request(spark, sf_dir), derived.campaign(spark, sf_dir))


@query("allocate_batch", with_views("SELECT * FROM d_decision", "d_decision"))
def allocate_batch(spark, sf_dir):
    return decisions(spark, sf_dir)


@query("allocate_small_segments", with_views("SELECT * FROM d_decision", "d_decision"))
def allocate_small_segments(spark, sf_dir):
    """The same answers when the log is cut into many segments."""
    return allocation.allocate(derived.request(spark, sf_dir), derived.campaign(spark, sf_dir), segment_rows=500)


@query("allocate_plain_windows", with_views("SELECT arrival_no, code, issue_sequence FROM d_decision", "d_decision"))
def allocate_plain_windows(spark, sf_dir):
    return allocation.allocate_plain(derived.request(spark, sf_dir), derived.campaign(spark, sf_dir))


@query("decision_histogram", with_views("SELECT campaign_id, code, count(*) AS requests FROM d_decision GROUP BY ALL", "d_decision"))
def decision_histogram(spark, sf_dir):
    return reports.decision_histogram(decisions(spark, sf_dir))


@query("validate_requests", with_views("""
    SELECT arrival_no, coalesce(user_id > 0 AND length(request_id) BETWEEN 1 AND 128 AND strpos(request_id, '|') = 0, false) AS valid
    FROM (SELECT arrival_no, CASE WHEN arrival_no % 10 = 1 THEN 0 ELSE user_id END AS user_id,
      CASE WHEN arrival_no % 10 = 2 THEN 'a|b' WHEN arrival_no % 10 = 3 THEN '' WHEN arrival_no % 10 = 4 THEN NULL ELSE request_id END AS request_id FROM d_request)""", "d_request"))
def validate_requests(spark, sf_dir):
    n = F.col("arrival_no") % 10
    rows = derived.request(spark, sf_dir).withColumn("user_id", F.when(n == 1, 0).otherwise(F.col("user_id"))).withColumn(
        "request_id", F.when(n == 2, "a|b").when(n == 3, "").when(n == 4, F.lit(None)).otherwise(F.col("request_id")))
    return allocation.validate_requests(rows).select("arrival_no", "valid")


@query("allocate_corrupted_campaign", with_views("""
    SELECT campaign_id, CASE WHEN campaign_id = 2 THEN 7 WHEN campaign_id = 6 THEN 5 ELSE code END AS code, count(*) AS requests FROM d_decision GROUP BY ALL""", "d_decision"))
def allocate_corrupted_campaign(spark, sf_dir):
    c = derived.campaign(spark, sf_dir)
    broken = c.withColumn("close_at", F.when(F.col("campaign_id") == 2, F.col("open_at")).otherwise(F.col("close_at")))
    return reports.decision_histogram(allocation.allocate(derived.request(spark, sf_dir), broken))


@query("audit_accuracy_decisions", with_views("""
    WITH s AS (SELECT event_id, count(*) AS issue_rows, max(issue_sequence) AS max_sequence, count(message_id) AS message_ids FROM d_issue GROUP BY event_id),
    h AS (SELECT i.event_id, count(*) AS history_rows FROM d_history x JOIN d_issue i ON i.issue_id = x.issue_id WHERE x.from_status IS NULL GROUP BY i.event_id),
    f AS (SELECT event_id, count(*) AS failures FROM d_failure GROUP BY event_id),
    m AS (SELECT campaign_id AS event_id, count(*) AS requests, count(*) FILTER (code = 0) AS accepted, count(*) FILTER (code = 1) AS sold_out FROM d_decision GROUP BY campaign_id)
    SELECT event_id, total_stock, coalesce(issue_rows, 0) AS issue_rows, coalesce(requests, 0) AS requests, coalesce(accepted, 0) AS accepted, coalesce(sold_out, 0) AS sold_out,
      coalesce(issue_rows, 0) = coalesce(history_rows, 0) AND coalesce(issue_rows, 0) = total_stock AND max_sequence IS NOT DISTINCT FROM coalesce(issue_rows, 0)
        AND coalesce(failures, 0) = 0 AND coalesce(message_ids, 0) = coalesce(issue_rows, 0)
        AND coalesce(accepted, 0) = total_stock AND coalesce(sold_out, 0) = coalesce(requests, 0) - total_stock AS accurate
    FROM d_event LEFT JOIN s USING (event_id) LEFT JOIN h USING (event_id) LEFT JOIN f USING (event_id) LEFT JOIN m USING (event_id)""",
    "d_event", "d_history", "d_failure", "d_decision"))
def audit_accuracy_decisions(spark, sf_dir):
    """Stored rows held against the decisions of the request log."""
    return checks.accuracy_summary(derived.tables(spark, sf_dir), decisions(spark, sf_dir)).select(
        "event_id", "total_stock", "issue_rows", "requests", "accepted", "sold_out", "accurate")


@query("request_status", with_views(f"""
    SELECT d.campaign_id, d.request_id, d.user_id, issue_sequence, remaining,
      CASE code WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'REJECTED_SOLD_OUT' WHEN 2 THEN 'REJECTED_DUPLICATE' WHEN 3 THEN 'REJECTED_NOT_OPEN' ELSE 'REJECTED_CLOSED' END AS status,
      decided_at,
      CASE WHEN length(name) > 2 THEN concat(substr(name, 1, 1), repeat('*', length(name) - 2), substr(name, length(name), 1)) ELSE name END AS name,
      regexp_replace(email, {EMAIL}) AS email,
      regexp_replace(phone, {PHONE}) AS phone
    FROM d_decision d LEFT JOIN d_user u ON u.user_id = d.user_id WHERE NOT repeated AND code < 5
    UNION ALL SELECT DISTINCT campaign_id, request_id, CAST(NULL AS BIGINT), NULL, NULL, 'NOT_FOUND', NULL, NULL, NULL, NULL FROM d_decision WHERE code = 5""", "d_decision", "d_user"))
def request_status(spark, sf_dir):
    d = decisions(spark, sf_dir)
    lookups = derived.request(spark, sf_dir).select("campaign_id", "request_id").distinct()
    return allocation.request_status(lookups, allocation.to_request_state(d), derived.user(spark, sf_dir))


@query("stream_entries_from_decisions", with_views("""
    SELECT concat(CAST(arrival_no AS VARCHAR), '-0') AS entry_id, 'ISSUE' AS "type", request_id AS "requestId", CAST(campaign_id AS VARCHAR) AS "campaignId",
      CAST(user_id AS VARCHAR) AS "userId", CAST((user_id - 1) // 8388608 AS VARCHAR) AS "bitmapSegmentId", CAST((user_id - 1) % 8388608 AS VARCHAR) AS "bitOffset",
      CAST(issue_sequence AS VARCHAR) AS "issueSequence", CAST(epoch_us(decided_at) // 1000 AS VARCHAR) AS "decidedAt"
    FROM d_decision WHERE code = 0 AND NOT repeated""", "d_decision"))
def stream_entries_from_decisions(spark, sf_dir):
    return allocation.to_stream_entries(decisions(spark, sf_dir))


@query("request_state_round_trip", with_views("""
    SELECT campaign_id, request_id, true AS valid, user_id,
      CASE code WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'REJECTED_SOLD_OUT' WHEN 2 THEN 'REJECTED_DUPLICATE' WHEN 3 THEN 'REJECTED_NOT_OPEN' ELSE 'REJECTED_CLOSED' END AS status,
      issue_sequence, remaining, epoch_us(decided_at) // 1000 AS decided_ms,
      concat_ws('|', 'v2', user_id, (user_id - 1) // 8388608, (user_id - 1) % 8388608, code, CASE WHEN code = 0 THEN 0 ELSE 3 END,
        coalesce(issue_sequence, -1), coalesce(remaining, -1), epoch_us(decided_at) // 1000, epoch_us(decided_at) // 1000) AS record
    FROM d_decision WHERE NOT repeated AND code < 5""", "d_decision"))
def request_state_round_trip(spark, sf_dir):
    return parse_request_state(pack_request_state(allocation.to_request_state(decisions(spark, sf_dir))))


@query("request_state_faults", with_views("""
    SELECT failure_id, failure_id % 8 IN (0, 1, 6) AS valid,
      CASE failure_id % 8 WHEN 0 THEN 'ISSUED' WHEN 1 THEN 'REJECTED_SOLD_OUT' WHEN 6 THEN 'COMPENSATED' END AS status
    FROM d_failure""", "d_failure"))
def request_state_faults(spark, sf_dir):
    n = F.col("failure_id") % 8
    record = (
        F.when(n == 0, "v2|7|0|6|0|1|3|9|1000|1001").when(n == 1, "7|x|REJECTED_SOLD_OUT|-1|0|1000")
        .when(n == 2, "v1|7|0|6|0|1|3|9|1000|1001").when(n == 3, "v2|7|0|6|0|3|3|9|1000|1001")
        .when(n == 4, "v2|7|0|6|0|1|3|9|1000|999").when(n == 5, "v2|7|0|6|0|1|3|9|0|5")
        .when(n == 6, "7|x|4|3|9|1000|z").otherwise("7|x|ISSUED")
    )
    rows = derived.failure(spark, sf_dir).select("failure_id", record.alias("record"))
    return parse_request_state(rows).select("failure_id", "valid", "status")


_FAULT = f"""CASE WHEN "type" <> 'ISSUE' THEN 'SKIPPED'
  WHEN NOT regexp_matches("requestId", {UUID}) THEN 'requestId'
  WHEN NOT coalesce(try_cast("campaignId" AS BIGINT) > 0, false) THEN 'campaignId' WHEN NOT coalesce(try_cast("userId" AS BIGINT) > 0, false) THEN 'userId'
  WHEN NOT coalesce(try_cast("bitmapSegmentId" AS BIGINT) >= 0, false) THEN 'bitmapSegmentId' WHEN NOT coalesce(try_cast("bitOffset" AS BIGINT) >= 0, false) THEN 'bitOffset'
  WHEN NOT coalesce(try_cast("issueSequence" AS BIGINT) > 0, false) THEN 'issueSequence' WHEN try_cast("decidedAt" AS BIGINT) IS NULL THEN 'decidedAt' END"""

VIEWS["d_parsed"] = (("d_entry",), f"""
  SELECT entry_id, "requestId" AS request_id, CAST("campaignId" AS BIGINT) AS event_id, CAST("userId" AS BIGINT) AS user_id,
    CAST("bitmapSegmentId" AS BIGINT) AS segment_id, CAST("bitOffset" AS BIGINT) AS bit_offset, CAST("issueSequence" AS BIGINT) AS issue_sequence,
    make_timestamp(CAST("decidedAt" AS BIGINT) * 1000) + INTERVAL 9 HOUR AS decided_at,
    {uuid3("concat('coupon-issue-stream:', \"campaignId\", ':', entry_id)")} AS message_id
  FROM d_entry WHERE {_FAULT} IS NULL
""")


@query("stream_parse_good", with_views("SELECT * FROM d_parsed", "d_parsed"))
def stream_parse_good(spark, sf_dir):
    return parse_issue_entries(derived.stream_entry(spark, sf_dir))[0]


@query("stream_parse_malformed", with_views(f"""
    SELECT entry_id, "userId", fault FROM (SELECT *, {_FAULT} AS fault FROM d_entry) WHERE fault <> 'SKIPPED'""", "d_entry"))
def stream_parse_malformed(spark, sf_dir):
    return parse_issue_entries(derived.stream_entry(spark, sf_dir))[1].select("entry_id", "userId", "fault")


@query("stream_dedup", with_views("SELECT DISTINCT ON (message_id) message_id, event_id, issue_sequence FROM d_parsed", "d_parsed"))
def stream_dedup(spark, sf_dir):
    good, _ = parse_issue_entries(derived.stream_entry(spark, sf_dir))
    return drop_redelivered(good).select("message_id", "event_id", "issue_sequence")


def _arrivals(spark, sf_dir):
    """Good entries, one per entry id and user, with an arrival number taken from the entry id.

    Two users under one entry id arrive one after the other.
    """
    good, _ = parse_issue_entries(derived.stream_entry(spark, sf_dir))
    keys = ["entry_id", "user_id"]
    rest = [c for c in good.columns if c not in ("decided_at", *keys)]
    once = good.groupBy(*keys).agg(F.min(F.struct("decided_at", *rest)).alias("e")).select(*keys, "e.*")
    lowest = once.groupBy("entry_id").agg(F.min("user_id").alias("lowest"))
    n = F.split(F.col("entry_id"), "-")[0].cast("long") - F.lit(1755000000000)
    later = F.when(F.col("user_id") == F.col("lowest"), 0).otherwise(1)
    return once.join(lowest, "entry_id").withColumn("arrival_no", n * 3 + later).drop("lowest")


_ARRIVALS = """
  arr AS (SELECT *, CAST(split_part(entry_id, '-', 1) AS BIGINT) - 1755000000000 AS n,
      min(user_id) OVER (PARTITION BY entry_id) AS fu FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, user_id ORDER BY decided_at) AS k FROM d_parsed) WHERE k = 1),
  arrivals AS (SELECT * EXCLUDE (n, fu, k), n * 3 + CASE WHEN user_id = fu THEN 0 ELSE 1 END AS arrival_no FROM arr)"""

# Stored already: what the ledger held at the start of 1997.
_PERSIST = f"""{_ARRIVALS},
  old AS (SELECT * FROM d_issue WHERE created_at < TIMESTAMP '1997-01-01'),
  s AS (SELECT request_id, any_value(event_id) AS e, any_value(user_id) AS u, any_value(issue_sequence) AS q FROM old GROUP BY request_id),
  a1 AS (SELECT x.*, s.request_id AS have, s.e, s.u, s.q, row_number() OVER w AS nth, first_value(x.event_id) OVER w AS fe, first_value(x.user_id) OVER w AS fu,
      first_value(x.issue_sequence) OVER w AS fs FROM arrivals x LEFT JOIN s ON s.request_id = x.request_id WINDOW w AS (PARTITION BY x.request_id ORDER BY arrival_no)),
  a2 AS (SELECT *, CASE WHEN have IS NULL AND nth = 1 THEN 'INSERT'
      WHEN coalesce(e, fe) IS NOT DISTINCT FROM event_id AND CASE WHEN have IS NULL THEN fu ELSE u END IS NOT DISTINCT FROM user_id
       AND CASE WHEN have IS NULL THEN fs ELSE q END IS NOT DISTINCT FROM issue_sequence THEN 'ABSORBED' ELSE 'CONFLICT' END AS o FROM a1),
  a3 AS (SELECT *, CASE WHEN o = 'INSERT' AND (EXISTS (SELECT 1 FROM old WHERE old.event_id = a2.event_id AND old.user_id = a2.user_id)
      OR arrival_no > min(arrival_no) FILTER (o = 'INSERT') OVER (PARTITION BY event_id, user_id)) THEN 'CONFLICT' ELSE o END AS o2 FROM a2),
  a4 AS (SELECT *, CASE WHEN o2 = 'INSERT' AND (EXISTS (SELECT 1 FROM old WHERE old.event_id = a3.event_id AND old.issue_sequence = a3.issue_sequence)
      OR arrival_no > min(arrival_no) FILTER (o2 = 'INSERT') OVER (PARTITION BY event_id, issue_sequence)) THEN 'CONFLICT' ELSE o2 END AS o3 FROM a3),
  a5 AS (SELECT *, CASE WHEN o3 = 'INSERT' AND (EXISTS (SELECT 1 FROM old WHERE old.message_id = a4.message_id)
      OR arrival_no > min(arrival_no) FILTER (o3 = 'INSERT') OVER (PARTITION BY message_id)) THEN 'CONFLICT' ELSE o3 END AS outcome FROM a4)"""


@query("persist_classify", with_views(
    f"WITH {_PERSIST.strip()} SELECT arrival_no, request_id, event_id, user_id, outcome FROM a5", "d_parsed", "d_issue"))
def persist_classify(spark, sf_dir):
    stored = derived.issue(spark, sf_dir).filter(F.col("created_at") < ts("1997-01-01 00:00:00"))
    return persistence.classify_entries(_arrivals(spark, sf_dir), stored).select(
        "arrival_no", "request_id", "event_id", "user_id", "outcome")


@query("persist_new_issues", with_views(f"""WITH {_PERSIST.strip()}
    SELECT event_id * 4294967296 + issue_sequence AS issue_id, event_id, user_id, issue_sequence, request_id, message_id, 'ISSUED' AS status, decided_at AS issued_at,
      decided_at AS valid_from, decided_at + INTERVAL 24 HOUR AS valid_to, TIMESTAMP '2024-02-10' AS created_at
    FROM a5 WHERE outcome = 'INSERT'""", "d_parsed", "d_issue"))
def persist_new_issues(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    stored = t.issue.filter(F.col("created_at") < ts("1997-01-01 00:00:00"))
    return persistence.persist_issues(_arrivals(spark, sf_dir), stored, t.event, t.coupon, NOW)[0].drop("used_at", "canceled_at")


@query("persist_new_history", with_views(f"""WITH {_PERSIST.strip()}
    SELECT event_id * 4294967296 + issue_sequence AS issue_id, CAST(NULL AS VARCHAR) AS from_status, 'ISSUED' AS to_status, 'SYSTEM' AS actor, 'ISSUE_CONFIRMED' AS reason,
      decided_at AS occurred_at, TIMESTAMP '2024-02-10' AS recorded_at, request_id AS event_uid
    FROM a5 WHERE outcome = 'INSERT'""", "d_parsed", "d_issue"))
def persist_new_history(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    stored = t.issue.filter(F.col("created_at") < ts("1997-01-01 00:00:00"))
    return persistence.persist_issues(_arrivals(spark, sf_dir), stored, t.event, t.coupon, NOW)[1]


@query("issue_valid_to", with_views("""
    SELECT issue_id, event_id, valid_from, valid_from + INTERVAL 24 HOUR AS valid_to FROM d_issue""", "d_issue"))
def issue_valid_to(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return persistence.with_valid_to(t.issue.select("issue_id", "event_id", "valid_from"), t.event, t.coupon)


@query("delivery_actions", with_views("""
    WITH d AS (SELECT failure_id, failure_id % 5 + 1 AS attempts, CASE WHEN failure_stage = 'CONFIRM' THEN 'CONFIRM' ELSE 'RELAY' END AS stage,
      CASE failure_id % 3 WHEN 0 THEN 'PERSISTED' WHEN 1 THEN 'ABSENT' ELSE 'UNVERIFIED' END AS probe FROM d_failure)
    SELECT failure_id, CASE WHEN attempts < 3 THEN 'RETRY' WHEN stage = 'CONFIRM' AND attempts = 3 THEN 'LOG_AND_KEEP' WHEN stage = 'CONFIRM' THEN 'KEEP'
      WHEN probe = 'ABSENT' THEN 'COMPENSATE_AND_ACK' WHEN probe = 'PERSISTED' THEN 'ACK' ELSE 'KEEP' END AS action FROM d""", "d_failure"))
def delivery_actions(spark, sf_dir):
    n = F.col("failure_id")
    rows = derived.failure(spark, sf_dir).select(
        "failure_id", (n % 5 + 1).alias("attempts"), F.when(F.col("failure_stage") == "CONFIRM", "CONFIRM").otherwise("RELAY").alias("stage"),
        F.when(n % 3 == 0, "PERSISTED").when(n % 3 == 1, "ABSENT").otherwise("UNVERIFIED").alias("probe_result"))
    return persistence.classify_delivery(rows).select("failure_id", "action")


@query("delivery_reclaimable", with_views("""
    SELECT failure_id, attempt_count + 1 AS deliveries FROM d_failure WHERE date_sub('second', occurred_at, TIMESTAMP '2024-01-20') >= 30""", "d_failure"))
def delivery_reclaimable(spark, sf_dir):
    pending = derived.failure(spark, sf_dir).select(
        "failure_id", F.col("occurred_at").alias("delivered_at"), F.col("attempt_count").alias("deliveries"))
    return persistence.reclaimable(pending, datetime(2024, 1, 20)).select("failure_id", "deliveries")


@query("relay_targets", with_views("""
    SELECT event_id FROM d_event WHERE open_at <= TIMESTAMP '2001-08-20' AND close_at >= TIMESTAMP '2001-08-20' - INTERVAL 168 HOUR
      AND event_id IN (SELECT event_id FROM d_state)""", "d_event", "d_state"))
def relay_targets(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return persistence.relay_targets(t.event, t.state, datetime(2001, 8, 20))


@query("pending_entries", with_views("""
    SELECT entry_id, event_id, user_id, issue_sequence FROM d_parsed p WHERE issue_sequence > 10 AND NOT EXISTS (
      SELECT 1 FROM d_issue i WHERE i.event_id = p.event_id AND i.issue_sequence = p.issue_sequence AND i.created_at < TIMESTAMP '1997-01-01')""", "d_parsed", "d_issue"))
def pending_entries(spark, sf_dir):
    good, _ = parse_issue_entries(derived.stream_entry(spark, sf_dir))
    stored = derived.issue(spark, sf_dir).filter(F.col("created_at") < ts("1997-01-01 00:00:00"))
    return persistence.pending_entries(good, stored, 10).select("entry_id", "event_id", "user_id", "issue_sequence")


@query("stream_trimmable", with_views("""
    WITH e AS (SELECT campaign_id, arrival_no AS entry_no FROM d_request),
    k AS (SELECT campaign_id, entry_no, 'a' AS consumer FROM e WHERE entry_no % 7 <> 0 UNION ALL SELECT campaign_id, entry_no, 'b' FROM e WHERE entry_no % 11 <> 0)
    SELECT campaign_id, entry_no FROM e WHERE (SELECT count(DISTINCT consumer) FROM k WHERE k.campaign_id = e.campaign_id AND k.entry_no = e.entry_no) = 2
      AND entry_no < (SELECT max(entry_no) FROM e x WHERE x.campaign_id = e.campaign_id)""", "d_request"))
def stream_trimmable(spark, sf_dir):
    e = derived.request(spark, sf_dir).select("campaign_id", F.col("arrival_no").alias("entry_no"))
    acks = e.filter(F.col("entry_no") % 7 != 0).withColumn("consumer", F.lit("a")).unionByName(
        e.filter(F.col("entry_no") % 11 != 0).withColumn("consumer", F.lit("b")))
    return persistence.trimmable(e, acks)


@query("issued_users", with_views("SELECT event_id, count(DISTINCT user_id) AS users FROM d_issue GROUP BY event_id", "d_issue"))
def issued_users(spark, sf_dir):
    return persistence.issued_users(derived.issue(spark, sf_dir))


@query("issued_bitmap_bits", with_views("""
    SELECT event_id, (user_id - 1) // 32768 + 1 AS bucket, count(DISTINCT user_id) AS users FROM d_issue WHERE user_id IS NOT NULL GROUP BY ALL""", "d_issue"))
def issued_bitmap_bits(spark, sf_dir):
    return persistence.issued_bitmap(derived.issue(spark, sf_dir)).drop("bits")
