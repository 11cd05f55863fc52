"""Reports, lookups, time series and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.issuance import decisions, uuid3
from catalog.registry import query
from catalog.repairs import results_table, violations_table
from catalog.sqlviews import EMAIL, PHONE, with_views
from tallyroll.constants import ACTIVE_STATUSES
from tallyroll.functions import ids, text, times
from tallyroll.operators import persistence, reports
from tallyroll.operators.paging import PageIndex
from tallyroll.plans.runner import CHECKS, catalog
from tallyroll.sources import derived
from tallyroll.sources.stream import parse_issue_entries

def name_mask(col: str) -> str:
    t = f"trim({col})"
    return (
        f"CASE WHEN length({t}) = 0 THEN {col} WHEN length({t}) = 1 THEN {t} WHEN length({t}) = 2 THEN concat(substr({t}, 1, 1), '*') "
        f"WHEN {col} IS NOT NULL THEN concat(substr({t}, 1, 1), repeat('*', length({t}) - 2), substr({t}, length({t}), 1)) END"
    )


# --- listings -----------------------------------------------------------------------------


@query("report_issuance_log", with_views(f"""
    WITH m AS (
      SELECT issue_sequence, user_id, status, issued_at, created_at AS persisted_at, 0 AS src, issue_id FROM d_issue WHERE event_id = 3 AND issue_sequence > 100 AND created_at < TIMESTAMP '1997-01-01'
      UNION ALL SELECT issue_sequence, user_id, 'PROCESSING', decided_at, NULL, 1, 0 FROM d_parsed p WHERE event_id = 3 AND issue_sequence > 100
        AND NOT EXISTS (SELECT 1 FROM d_issue i WHERE i.event_id = p.event_id AND i.issue_sequence = p.issue_sequence AND i.created_at < TIMESTAMP '1997-01-01')),
    d AS (SELECT *, row_number() OVER (PARTITION BY issue_sequence ORDER BY src, issue_id, user_id) AS k FROM m),
    t AS (SELECT *, row_number() OVER (ORDER BY issue_sequence) AS pos FROM d WHERE k = 1 ORDER BY issue_sequence LIMIT 51)
    SELECT issue_sequence, t.user_id, {name_mask('u.name')} AS name, regexp_replace(u.email, {EMAIL}) AS email, regexp_replace(u.phone, {PHONE}) AS phone, status,
      concat(strftime(issued_at, '%Y-%m-%dT%H:%M:%S.%f'), '+09:00') AS issued_at,
      CASE WHEN persisted_at IS NOT NULL THEN concat(strftime(persisted_at, '%Y-%m-%dT%H:%M:%S.%f'), '+09:00') END AS persisted_at, pos > 50 AS is_extra
    FROM t LEFT JOIN d_user u ON u.user_id = t.user_id""", "d_issue", "d_parsed", "d_user"))
def report_issuance_log(spark, sf_dir):
    good, _ = parse_issue_entries(derived.stream_entry(spark, sf_dir))
    stored = derived.issue(spark, sf_dir).filter(F.col("created_at") < times.ts("1997-01-01 00:00:00"))
    return reports.issuance_log(persistence.pending_entries(good, stored), stored, derived.user(spark, sf_dir), 3, 100, 50)


@query("report_recent_events", with_views("""
    SELECT event_id, e.coupon_id, coupon_name, type, value, round, status, total_stock, remaining_stock, e.created_at FROM d_event e JOIN d_coupon c ON c.coupon_id = e.coupon_id""", "d_event", "d_coupon"))
def report_recent_events(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return reports.recent_events(t.event, t.coupon)


@query("report_recent_events_closed", with_views("""
    SELECT event_id, e.coupon_id, coupon_name, type, value, round, status, total_stock, remaining_stock, e.created_at FROM d_event e JOIN d_coupon c ON c.coupon_id = e.coupon_id
    WHERE status = 'CLOSED'""", "d_event", "d_coupon"))
def report_recent_events_closed(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return reports.recent_events(t.event, t.coupon, "CLOSED")


@query("report_search_coupons", """
    SELECT p_partkey AS coupon_id, p_name AS coupon_name, TIMESTAMP '2000-01-01' - p_size * INTERVAL 1 DAY AS created_at FROM part
    WHERE contains(lower(p_name), 'red')""")
def report_search_coupons(spark, sf_dir):
    coupons = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("coupon_id"), F.col("p_name").alias("coupon_name"),
        times.plus(times.ts("2000-01-01 00:00:00"), F.col("p_size") * -24, "HOUR").alias("created_at"))
    return reports.search_coupons(coupons, " RED ")


@query("report_results_page", with_views(
    "SELECT result_id, check_name, executed_at FROM d_result WHERE status = 'FAIL' ORDER BY executed_at DESC, result_id DESC LIMIT 25 OFFSET 75", "d_result"))
def report_results_page(spark, sf_dir):
    return reports.results_page(results_table(spark, sf_dir), 3, 25, "FAIL").select("result_id", "check_name", "executed_at")


@query("report_results_deep_page", with_views(
    "SELECT result_id, check_name, executed_at FROM d_result ORDER BY executed_at DESC, result_id DESC LIMIT 25 OFFSET 750", "d_result"))
def report_results_deep_page(spark, sf_dir):
    """A page far down, from an index of the listing: only the ranges it lies in are sorted."""
    index = PageIndex.of(results_table(spark, sf_dir).select("result_id", "check_name", "executed_at"), [("executed_at", True), ("result_id", True)])
    return index.page(30, 25)


@query("report_violations_by_result_page", with_views(
    "SELECT violation_id, result_id, check_name FROM d_violation ORDER BY result_id ASC NULLS FIRST, violation_id DESC LIMIT 40 OFFSET 400", "d_violation"))
def report_violations_by_result_page(spark, sf_dir):
    """Few values of the first key hold all rows: each is cut further by the second one."""
    index = PageIndex.of(violations_table(spark, sf_dir).select("violation_id", "result_id", "check_name"), [("result_id", False), ("violation_id", True)], most=100)
    return index.page(10, 40)


@query("report_violations_page", with_views(
    "SELECT violation_id, check_name, target_id FROM d_violation WHERE result_id = 7 ORDER BY violation_id DESC LIMIT 20 OFFSET 20", "d_violation"))
def report_violations_page(spark, sf_dir):
    return reports.violations_page(violations_table(spark, sf_dir), 7, 1, 20).select("violation_id", "check_name", "target_id")


@query("report_recoveries_page", with_views(
    "SELECT violation_id AS recovery_id, created_at FROM d_violation ORDER BY created_at DESC, violation_id DESC LIMIT 30 OFFSET 30", "d_violation"))
def report_recoveries_page(spark, sf_dir):
    rows = violations_table(spark, sf_dir).withColumnRenamed("violation_id", "recovery_id")
    return reports.recoveries_page(rows, 1, 30).select("recovery_id", "created_at")


@query("lookup_by_user", with_views("SELECT issue_id, status FROM d_issue WHERE event_id = 2 AND user_id = 770", "d_issue"))
def lookup_by_user(spark, sf_dir):
    return reports.lookup_issue(derived.issue(spark, sf_dir), event_id=2, user_id=770).select("issue_id", "status")


@query("lookup_by_request", with_views("SELECT issue_id, status FROM d_issue WHERE request_id = 'INVALID-REQUEST-ID-2'", "d_issue"))
def lookup_by_request(spark, sf_dir):
    wanted = "INVALID-REQUEST-ID-2"
    return reports.lookup_issue(derived.issue(spark, sf_dir), request_id=wanted).select("issue_id", "status")


@query("lookup_by_message", with_views("SELECT issue_id, status FROM d_issue WHERE message_id = '13:1755000000000-0'", "d_issue"))
def lookup_by_message(spark, sf_dir):
    return reports.lookup_issue(derived.issue(spark, sf_dir), message_id="13:1755000000000-0").select("issue_id", "status")


@query("user_issues", with_views("SELECT issue_id, event_id, status FROM d_issue WHERE user_id = 42", "d_issue"))
def user_issues(spark, sf_dir):
    return reports.user_issues(derived.issue(spark, sf_dir), 42).select("issue_id", "event_id", "status")


@query("issue_counts", with_views("SELECT event_id, count(*) AS rows FROM d_issue WHERE status IN ('ISSUED', 'USED', 'EXPIRED') GROUP BY event_id", "d_issue"))
def issue_counts(spark, sf_dir):
    return reports.issue_counts(derived.issue(spark, sf_dir), ACTIVE_STATUSES)


@query("rounds_of_coupon", with_views("SELECT event_id, round, status FROM d_event WHERE coupon_id = 2 AND status = 'OPEN'", "d_event"))
def rounds_of_coupon(spark, sf_dir):
    return reports.rounds_of(derived.tables(spark, sf_dir).event, 2, "OPEN").select("event_id", "round", "status")


@query("eligible_users", with_views(
    "SELECT user_id FROM d_user WHERE user_id NOT IN (SELECT user_id FROM d_issue WHERE event_id = 5 AND user_id IS NOT NULL)", "d_user", "d_issue"))
def eligible_users(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return reports.eligible_users(t.user, t.issue, 5)


# --- series ------------------------------------------------------------------------------


@query("series_verification", with_views("""
    SELECT time_bucket(INTERVAL 1 HOUR, executed_at + duration_millis * INTERVAL 1 MILLISECOND) AS bucket, check_name, status, scope_type, count(*) AS runs
    FROM d_result GROUP BY ALL""", "d_result"))
def series_verification(spark, sf_dir):
    return reports.verification_series(results_table(spark, sf_dir))


@query("series_issue", with_views("""
    SELECT time_bucket(INTERVAL 1 HOUR, arrived_at) AS bucket, CASE WHEN code = 0 THEN 'ACCEPTED' WHEN code = 1 THEN 'SOLD_OUT' WHEN code = 2 THEN 'ALREADY_ISSUED'
      WHEN code IN (3, 4) THEN 'EVENT_NOT_OPEN' ELSE 'OTHER' END AS reason, count(*) AS requests FROM d_decision GROUP BY ALL""", "d_decision"))
def series_issue(spark, sf_dir):
    return reports.issue_series(decisions(spark, sf_dir))


@query("series_relay", with_views("""
    SELECT time_bucket(INTERVAL 1 DAY, at_, TIMESTAMP '1970-01-01') AS bucket, result, reason, count(*) AS entries FROM (
      SELECT created_at AS at_, 'success' AS result, 'STORED' AS reason FROM d_issue
      UNION ALL SELECT occurred_at, 'fail', CASE WHEN failure_stage = 'CONFIRM' THEN 'CONFIRM_ABANDONED' ELSE 'PERSIST_ABANDONED' END FROM d_failure) GROUP BY ALL""", "d_issue", "d_failure"))
def series_relay(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return reports.relay_series(t.issue, t.failure, "1 day")


@query("series_transition", with_views("""
    SELECT time_bucket(INTERVAL 1 DAY, occurred_at, TIMESTAMP '1970-01-01') AS bucket, from_status, to_status, count(*) AS changes FROM d_history
    WHERE from_status IS NOT NULL AND occurred_at IS NOT NULL GROUP BY ALL""", "d_history"))
def series_transition(spark, sf_dir):
    return reports.transition_series(derived.tables(spark, sf_dir).history)


@query("series_transition_failures", with_views("""
    SELECT time_bucket(INTERVAL 1 DAY, "at", TIMESTAMP '1970-01-01') AS bucket, target_status, result, count(*) AS commands FROM d_walk WHERE result <> 'SUCCESS' GROUP BY ALL""", "d_walk"))
def series_transition_failures(spark, sf_dir):
    from catalog.campaigns import _commands
    from tallyroll.operators.commands import apply_commands

    return reports.transition_failures(apply_commands(derived.issue(spark, sf_dir), _commands(spark, sf_dir))[2])


@query("storage_lag", with_views("""
    SELECT event_id, count(*) AS rows, min(lag) AS min_lag, avg(lag) AS avg_lag, quantile_cont(lag, 0.5) AS p50_lag, quantile_cont(lag, 0.99) AS p99_lag, max(lag) AS max_lag,
      count(*) FILTER (lag < 0) AS reversals
    FROM (SELECT i.event_id, date_diff('microsecond', h.occurred_at, h.recorded_at) AS lag FROM d_history h JOIN d_issue i ON i.issue_id = h.issue_id
      WHERE h.to_status = 'ISSUED' AND h.from_status IS NULL AND h.recorded_at IS NOT NULL) GROUP BY event_id""", "d_history"))
def storage_lag(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return reports.storage_lag(t.history, t.issue, exact=True)


# --- scalar functions ------------------------------------------------------------------------


@query("fn_mask_documents", f"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(text, {EMAIL}), {PHONE})) AS masked_md5,
      regexp_replace(regexp_replace(text, {EMAIL}), {PHONE}) <> text AS changed FROM documents""")
def fn_mask_documents(spark, sf_dir):
    masked = text.mask_text(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.md5(masked.cast("binary")).alias("masked_md5"), (masked != F.col("text")).alias("changed"))


@query("fn_mask_conversations", f"""
    SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, {EMAIL}), {PHONE})) AS masked_md5 FROM conversations""")
def fn_mask_conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", F.md5(text.mask_text(F.col("text")).cast("binary")).alias("masked_md5"))


@query("fn_mask_users", with_views(f"""
    SELECT user_id, {name_mask('name')} AS name, regexp_replace(email, {EMAIL}) AS email, regexp_replace(phone, {PHONE}) AS phone FROM d_user""", "d_user"))
def fn_mask_users(spark, sf_dir):
    return reports.masked_users(derived.user(spark, sf_dir))


@query("fn_mask_names", f"""
    SELECT p_partkey, {name_mask('n')} AS masked FROM (SELECT p_partkey, concat(' ', substr(p_name, 1, CAST(p_partkey % 6 AS INTEGER)), ' ') AS n FROM part)""")
def fn_mask_names(spark, sf_dir):
    n = F.concat(F.lit(" "), F.substr(F.col("p_name"), F.lit(1), (F.col("p_partkey") % 6).cast("int")), F.lit(" "))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.mask_name(n).alias("masked"))


@query("fn_uuid_test", with_views("""
    SELECT issue_id, regexp_matches(request_id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AS request_ok,
      regexp_matches(message_id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AS message_ok FROM d_issue""", "d_issue"))
def fn_uuid_test(spark, sf_dir):
    return derived.issue(spark, sf_dir).select(
        "issue_id", ids.is_uuid(F.col("request_id")).alias("request_ok"), ids.is_uuid(F.col("message_id")).alias("message_ok"))


@query("fn_message_id", f"""
    SELECT o_orderkey, {uuid3("concat('coupon-issue-stream:', CAST(o_custkey AS VARCHAR), ':', CAST(o_orderkey AS VARCHAR), '-0')")} AS message_id FROM orders""")
def fn_message_id(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", ids.message_id(F.col("o_custkey"), F.concat(F.col("o_orderkey").cast("string"), F.lit("-0"))).alias("message_id"))


@query("fn_time_differences", with_views("""
    SELECT history_id, date_diff('microsecond', occurred_at, recorded_at) AS micros, date_sub('second', recorded_at, occurred_at) AS seconds,
      occurred_at + INTERVAL 1500 MILLISECOND AS later FROM d_history""", "d_history"))
def fn_time_differences(spark, sf_dir):
    o, r = F.col("occurred_at"), F.col("recorded_at")
    return derived.tables(spark, sf_dir).history.select(
        "history_id", times.micros_between(o, r).alias("micros"), times.seconds_between(r, o).alias("seconds"), (o + times.millis(1500)).alias("later"))


@query("fn_null_safe_equal", with_views(
    "SELECT history_id, from_status IS NOT DISTINCT FROM to_status AS same FROM d_history", "d_history"))
def fn_null_safe_equal(spark, sf_dir):
    return derived.tables(spark, sf_dir).history.select("history_id", F.col("from_status").eqNullSafe(F.col("to_status")).alias("same"))


@query("fn_epoch_millis", """
    SELECT event_id, ts - INTERVAL 0 SECOND AS utc, make_timestamp((epoch_us(ts) // 1000) * 1000) + INTERVAL 9 HOUR AS seoul,
      concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '+09:00') AS offset_text FROM events""")
def fn_epoch_millis(spark, sf_dir):
    at = F.col("ts").cast("timestamp_ntz")
    ms = F.timestamp_diff("MILLISECOND", times.ts("1970-01-01 00:00:00"), at)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", at.alias("utc"), times.epoch_millis_to_local(ms).alias("seoul"), times.local_to_offset_text(at).alias("offset_text"))


@query("fn_detail_json", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE concat('{"k":"', CAST(user_id AS VARCHAR), '"}') END AS encoded,
      CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events""")
def fn_detail_json(spark, sf_dir):
    e = F.col("event_id")
    detail = F.when(e % 3 != 0, F.create_map(F.lit("k"), F.col("user_id").cast("string")))
    raw = F.when(e % 4 == 0, F.lit(" ")).otherwise(F.col("props"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", text.encode_detail(detail).alias("encoded"), F.try_element_at(text.decode_detail(raw), F.lit("k")).alias("k"))


@query("fn_truncate", "SELECT doc_id, length(substr(text, 1, 500)) AS short, md5(substr(text, 1, 2000)) AS head FROM documents")
def fn_truncate(spark, sf_dir):
    t = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.length(text.truncate(t, 500)).cast("long").alias("short"), F.md5(text.truncate(t, 2000).cast("binary")).alias("head"))


@query("fn_labels", with_views("""
    SELECT result_id, CASE check_name WHEN 'stock' THEN 'stock counters' WHEN 'loss' THEN 'accepted but not stored' WHEN 'state_chain' THEN 'status chain continuity'
      WHEN 'issue_structure' THEN 'issue row structure' WHEN 'history_structure' THEN 'history row structure' WHEN 'issue_history_state' THEN 'issue against latest history'
      WHEN 'time_sync' THEN 'issue and history times' ELSE 'late expiry' END AS label FROM d_result""", "d_result"))
def fn_labels(spark, sf_dir):
    return results_table(spark, sf_dir).select("result_id", text.label(F.col("check_name"), {c.name: c.label for c in CHECKS.values()}).alias("label"))


@query("fn_bitmap_position", """
    SELECT o_orderkey, (u - 1) // 8388608 AS segment, (u - 1) % 8388608 AS bit FROM (SELECT o_orderkey, o_orderkey * 7919 + 1 AS u FROM orders)""")
def fn_bitmap_position(spark, sf_dir):
    u = F.col("o_orderkey") * 7919 + 1
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", ids.bitmap_segment(u).alias("segment"), ids.bitmap_offset(u).alias("bit"))


@query("audit_catalog_usage", with_views("""
    SELECT check_name, scope_type, count(*) AS results FROM d_result WHERE (check_name, scope_type) IN (
      ('stock', 'EVENT'), ('stock', 'ALL'), ('loss', 'EVENT'), ('state_chain', 'EVENT'), ('state_chain', 'AS_OF_RANGE'), ('state_chain', 'ALL'),
      ('issue_structure', 'EVENT'), ('issue_structure', 'ALL'), ('history_structure', 'EVENT'), ('history_structure', 'AS_OF_RANGE'), ('history_structure', 'ALL'),
      ('issue_history_state', 'EVENT'), ('issue_history_state', 'ALL'), ('time_sync', 'EVENT'), ('time_sync', 'AS_OF_RANGE'), ('time_sync', 'ALL'),
      ('expiration_lag', 'EVENT'), ('expiration_lag', 'AS_OF_RANGE'), ('expiration_lag', 'ALL')) GROUP BY ALL""", "d_result"))
def audit_catalog_usage(spark, sf_dir):
    """Stored results of rules and scopes the catalog knows."""
    known = catalog(spark).select("check_name", "scope_type")
    return results_table(spark, sf_dir).join(known, ["check_name", "scope_type"]).groupBy("check_name", "scope_type").agg(F.count(F.lit(1)).alias("results"))
