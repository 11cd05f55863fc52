"""Audit rules over the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqlviews import with_views
from tallyroll.operators import checks, reports
from tallyroll.operators.chains import chain_heads, moved_heads
from tallyroll.plans.runner import number_of, run_and_store, run_checks, stored_results, stored_violations
from tallyroll.plans.scope import Scope, all_cutoff, events_for_all
from tallyroll.plans.staging import work_folder
from tallyroll.sources import derived
from tallyroll.sources.ledger import load, read_history
from tallyroll.sources.sinks import write_history_by_month, write_history_snapshot, write_issue_snapshot

NOW = datetime(2000, 1, 1)
FROM, TO = datetime(1997, 1, 1), datetime(1999, 1, 1)
UUID = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"


def _all(t):
    return Scope.all(NOW, events_for_all(t.event, NOW))


def _selected(df, *columns):
    return df.select(*columns)


# --- derived views -------------------------------------------------------------------

for _name, _fn, _cols in (
    ("issue", lambda s, d: derived.issue(s, d), "*"),
    ("history", lambda s, d: derived.history(derived.issue(s, d)), "*"),
    ("event", lambda s, d: derived.tables(s, d).event, "*"),
    ("coupon", lambda s, d: derived.coupon(s, d), "*"),
    ("user", lambda s, d: derived.user(s, d), "*"),
    ("state", lambda s, d: derived.tables(s, d).state, "*"),
    ("request", lambda s, d: derived.request(s, d), "*"),
    ("campaign", lambda s, d: derived.campaign(s, d), "*"),
):
    query(f"view_{_name}", with_views(f"SELECT * FROM d_{_name}", f"d_{_name}"))(_fn)

# --- stock and loss --------------------------------------------------------------------

# Event and issue rows in one pile: what a campaign says of itself, and a one for each coupon that is out.
_STOCK = """
SELECT e.event_id, e.total_stock, e.issued_quantity, e.remaining_stock, e.actual_active_count, 'STOCK_MISMATCH' AS violation_type
FROM (
  SELECT event_id, CAST(sum(given) AS BIGINT) AS total_stock, CAST(sum(told) AS BIGINT) AS issued_quantity, CAST(sum(rest) AS BIGINT) AS remaining_stock,
    CAST(sum(out_) AS BIGINT) AS actual_active_count, max(stage) AS status, max(made) AS created_at
  FROM (SELECT event_id, total_stock AS given, issued_quantity AS told, remaining_stock AS rest, 0 AS out_, status AS stage, created_at AS made FROM d_event
    UNION ALL BY NAME SELECT event_id, 1 AS out_ FROM d_issue WHERE status IN ('EXPIRED', 'ISSUED', 'USED'))
  GROUP BY event_id HAVING count(stage) = 1) e
WHERE greatest(abs(e.total_stock - e.remaining_stock - e.actual_active_count), abs(e.issued_quantity - e.actual_active_count)) > 0
"""


@query("check_stock_all", with_views(
    _STOCK + " AND e.status IN ('SOLD_OUT', 'CLOSED') AND e.created_at < TIMESTAMP '2000-01-01'", "d_event", "d_issue"))
def check_stock_all(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return checks.stock(t, _all(t))


@query("check_stock_event", with_views(_STOCK + " AND e.event_id = 11", "d_event", "d_issue"))
def check_stock_event(spark, sf_dir):
    return checks.stock(derived.tables(spark, sf_dir), Scope.event(11))


_LOSS = """
WITH x AS (
  SELECT e.event_id, e.total_stock, s.event_id IS NULL AS missing, coalesce(s.remaining_stock, e.total_stock) AS remaining_stock,
    coalesce(s.pending, 0) AS pending, coalesce(a.n, 0) AS actual_count
  FROM d_event e LEFT JOIN d_state s ON s.event_id = e.event_id
  LEFT JOIN (SELECT event_id, count(*) AS n FROM d_issue WHERE issue_sequence IS NOT NULL GROUP BY event_id) a ON a.event_id = e.event_id)
SELECT event_id, total_stock, remaining_stock, total_stock - remaining_stock AS expected_count, actual_count,
  total_stock - remaining_stock - actual_count AS lost_count,
  CASE WHEN pending > 0 THEN 'POSTPONED' WHEN missing AND actual_count > 0 THEN 'IMPOSSIBLE'
       WHEN total_stock - remaining_stock = actual_count THEN 'PASS' ELSE 'FAIL' END AS outcome
FROM x
"""


@query("check_loss", with_views(_LOSS, "d_event", "d_state", "d_issue"))
def check_loss(spark, sf_dir):
    return checks.loss_outcomes(derived.tables(spark, sf_dir), Scope.all(NOW))


# --- state chain -----------------------------------------------------------------------

# Each row beside the one before it, which is none for the first: its own start must be that one's end.
_CHAIN = """
WITH n AS (
  SELECT history_id, issue_id, from_status, to_status,
    count(*) OVER (PARTITION BY issue_id ORDER BY coalesce(occurred_at, TIMESTAMP '0001-01-01'), history_id ROWS UNBOUNDED PRECEDING) AS k
  FROM d_history)
SELECT b.issue_id, i.event_id, b.history_id, a.to_status AS prev_to_status, b.from_status, b.to_status, 'BROKEN_CHAIN' AS violation_type
FROM n b LEFT JOIN n a ON a.issue_id = b.issue_id AND a.k + 1 = b.k JOIN d_issue i ON i.issue_id = b.issue_id
WHERE (b.from_status IS DISTINCT FROM a.to_status OR (b.k = 1 AND coalesce(b.to_status, '') <> 'ISSUED'))
"""


@query("check_state_chain_all", with_views(
    _CHAIN + """ AND created_at < TIMESTAMP '2000-01-01'
    AND event_id IN (SELECT event_id FROM d_event WHERE created_at < TIMESTAMP '2000-01-01')""", "d_history", "d_event"))
def check_state_chain_all(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return checks.state_chain(t, _all(t))


@query("check_state_chain_range", with_views(
    _CHAIN + " AND created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1999-01-01'", "d_history"))
def check_state_chain_range(spark, sf_dir):
    return checks.state_chain(derived.tables(spark, sf_dir), Scope.range(FROM, TO))


@query("check_state_chain_event", with_views(_CHAIN + " AND event_id = 3", "d_history"))
def check_state_chain_event(spark, sf_dir):
    return checks.state_chain(derived.tables(spark, sf_dir), Scope.event(3))


# Every seventh row arrives two days late, some of them behind later rows of their issue.
_ARRIVED = """
arrived AS (
  SELECT issue_id, history_id, coalesce(occurred_at, TIMESTAMP '0001-01-01') AS moment, to_status,
    coalesce(recorded_at + to_days(CASE WHEN history_id % 7 = 0 THEN 2 ELSE 0 END) >= TIMESTAMP '1996-01-01', true) AS fresh
  FROM d_history),
behind AS (
  SELECT issue_id FROM arrived GROUP BY issue_id
  HAVING min(CASE WHEN fresh THEN struct_pack(a := moment, b := history_id) END) < max(CASE WHEN NOT fresh THEN struct_pack(a := moment, b := history_id) END))
"""
SINCE = datetime(1996, 1, 1)


def _by_month(spark, sf_dir):
    """The issues, and a folder with their history by month of arrival."""
    t = derived.tables(spark, sf_dir)
    folder = work_folder(spark, "history")
    late = F.when(F.col("history_id") % 7 == 0, F.col("recorded_at") + F.expr("INTERVAL '2' DAY")).otherwise(F.col("recorded_at"))
    write_history_by_month(t.history.withColumn("recorded_at", late), f"{folder}/rows")
    chain_heads(read_history(spark, f"{folder}/rows", before=SINCE)).write.parquet(f"{folder}/heads")
    return t.issue, folder


@query("check_state_chain_since", with_views(f"""WITH {_ARRIVED}
SELECT f.* FROM ({_CHAIN}) f JOIN arrived a ON a.history_id = f.history_id
WHERE a.fresh OR f.issue_id IN (SELECT issue_id FROM behind)""", "d_history"))
def check_state_chain_since(spark, sf_dir):
    """Breaks that the history recorded from a time on brings, from stored chain heads; only its months are read, and late issues."""
    issue, folder = _by_month(spark, sf_dir)
    new, old = (read_history(spark, f"{folder}/rows", **span) for span in ({"since": SINCE}, {"before": SINCE}))
    return checks.state_chain_since(issue, spark.read.parquet(f"{folder}/heads"), new, old)


@query("chain_heads_moved", with_views("""
SELECT issue_id, history_id, occurred_at, to_status FROM (
  SELECT *, lead(history_id) OVER (PARTITION BY issue_id ORDER BY coalesce(occurred_at, TIMESTAMP '0001-01-01'), history_id) AS after FROM d_history)
WHERE after IS NULL""", "d_history"))
def chain_heads_moved(spark, sf_dir):
    """Stored chain heads, moved on by the history recorded since: the next audit starts from these."""
    _, folder = _by_month(spark, sf_dir)
    return moved_heads(spark.read.parquet(f"{folder}/heads"), read_history(spark, f"{folder}/rows", since=SINCE))


# --- structure -------------------------------------------------------------------------

# A statement for each fault; of an issue's faults the one of least number counts. Names and numbers are fixed values.
_ISSUE_STRUCTURE = f"""
WITH faults AS (
  SELECT issue_id, 1 AS number, 'MISSING_USER_ID' AS name FROM d_issue WHERE user_id IS NULL
  UNION ALL SELECT issue_id, 2, 'INVALID_ISSUE_SEQUENCE' FROM d_issue WHERE issue_sequence IS NULL OR issue_sequence <= 0
  UNION ALL SELECT issue_id, 3, 'INVALID_REQUEST_ID' FROM d_issue WHERE issue_id NOT IN (SELECT issue_id FROM d_issue WHERE regexp_full_match(request_id, {UUID}))
  UNION ALL SELECT issue_id, 4, 'INVALID_MESSAGE_ID_FORMAT' FROM d_issue WHERE NOT regexp_full_match(message_id, {UUID})
  UNION ALL SELECT issue_id, 5, 'INVALID_STATUS' FROM d_issue ANTI JOIN (VALUES ('ISSUED'), ('USED'), ('EXPIRED'), ('CANCELED')) known(s) ON s = status
  UNION ALL SELECT issue_id, 6, 'MISSING_TIMESTAMP' FROM (SELECT issue_id, unnest([issued_at, valid_from, valid_to, created_at]) AS moment FROM d_issue) WHERE moment IS NULL
  UNION ALL SELECT issue_id, 7, 'INVALID_TIMESTAMP_ORDER' FROM d_issue WHERE issued_at > least(valid_from, created_at + INTERVAL 5 SECOND) OR valid_to <= valid_from
  UNION ALL SELECT issue_id, 8, 'MISSING_CANCELED_AT' FROM d_issue WHERE canceled_at IS NULL AND status = 'CANCELED'
  UNION ALL SELECT issue_id, 9, 'INVALID_STATUS_FIELDS' FROM d_issue WHERE (status = 'USED') <> (used_at IS NOT NULL)
  UNION ALL SELECT issue_id, 9, 'INVALID_STATUS_FIELDS' FROM d_issue WHERE status = 'USED' AND used_at < valid_from),
worst AS (SELECT issue_id, arg_min(name, number) AS violation_type FROM faults GROUP BY issue_id)
SELECT issue_id, event_id, user_id, status, issued_at, valid_from, valid_to, used_at, canceled_at, violation_type
FROM worst JOIN d_issue USING (issue_id) WHERE violation_type IS NOT NULL
"""


@query("check_issue_structure_all", with_views(_ISSUE_STRUCTURE, "d_issue"))
def check_issue_structure_all(spark, sf_dir):
    return checks.issue_structure(derived.tables(spark, sf_dir), Scope.all(NOW))


@query("check_issue_structure_set", with_views(
    _ISSUE_STRUCTURE + """ AND created_at < TIMESTAMP '2000-01-01'
    AND event_id IN (SELECT event_id FROM d_event WHERE created_at < TIMESTAMP '2000-01-01')""", "d_issue", "d_event"))
def check_issue_structure_set(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return checks.issue_structure(t, _all(t))


# As above: a statement for each fault, the allowed moves as a table. Names and numbers are fixed values.
_HISTORY_FAULTS = """
WITH moves(a, b) AS (VALUES ('ISSUED', 'USED'), ('ISSUED', 'EXPIRED'), ('ISSUED', 'CANCELED'), ('USED', 'ISSUED')),
faults AS (
  SELECT history_id, 1 AS number, 'MISSING_TO_STATUS' AS name FROM d_history WHERE to_status IS NULL
  UNION ALL SELECT history_id, 2, 'MISSING_TIMESTAMP' FROM d_history WHERE occurred_at IS NULL OR recorded_at IS NULL
  UNION ALL SELECT history_id, 3, 'INVALID_TIMESTAMP_ORDER' FROM d_history WHERE occurred_at > recorded_at + INTERVAL 5 SECOND
  UNION ALL SELECT history_id, 4, 'INVALID_TO_STATUS' FROM d_history ANTI JOIN (SELECT a AS s FROM moves UNION SELECT b FROM moves) ON s = to_status
  UNION ALL SELECT history_id, 5, 'INVALID_INITIAL_TRANSITION' FROM d_history WHERE from_status IS NULL AND to_status <> 'ISSUED'
  UNION ALL SELECT history_id, 6, 'INVALID_STATUS_TRANSITION' FROM (SELECT * FROM d_history WHERE from_status IS NOT NULL) ANTI JOIN moves ON a = from_status AND b = to_status),
worst AS (SELECT history_id, arg_min(name, number) AS violation_type FROM faults GROUP BY history_id)
SELECT history_id, h.issue_id, from_status, to_status, occurred_at, recorded_at, violation_type, {event} AS event_id
FROM worst JOIN d_history h USING (history_id) LEFT JOIN d_issue i ON i.issue_id = h.issue_id WHERE violation_type IS NOT NULL
"""
_HISTORY_STRUCTURE = _HISTORY_FAULTS.format(event="i.event_id")
_HISTORY_STRUCTURE_BARE = _HISTORY_FAULTS.format(event="CAST(NULL AS BIGINT)")


@query("check_history_structure_all", with_views(_HISTORY_STRUCTURE_BARE, "d_history"))
def check_history_structure_all(spark, sf_dir):
    return checks.history_structure(derived.tables(spark, sf_dir), Scope.all(NOW))


@query("check_history_structure_range", with_views(
    _HISTORY_STRUCTURE_BARE + " AND (recorded_at IS NULL OR (recorded_at >= TIMESTAMP '1997-01-01' AND recorded_at < TIMESTAMP '1999-01-01'))", "d_history"))
def check_history_structure_range(spark, sf_dir):
    return checks.history_structure(derived.tables(spark, sf_dir), Scope.range(FROM, TO))


@query("check_history_structure_event", with_views(_HISTORY_STRUCTURE + " AND i.event_id = 5", "d_history"))
def check_history_structure_event(spark, sf_dir):
    return checks.history_structure(derived.tables(spark, sf_dir), Scope.event(5))


# --- issue against history ---------------------------------------------------------------

_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY occurred_at DESC NULLS LAST, history_id DESC) AS rn FROM d_history) WHERE rn = 1)"""
# What coupons say of themselves less what their last rows say; a last row is the largest (time, id) of a coupon.
_HISTORY_STATE = """
WITH ends AS (SELECT issue_id, max({'at': coalesce(occurred_at, TIMESTAMP '0001-01-01'), 'history_id': history_id, 'occurred_at': occurred_at, 'a': from_status, 'b': to_status}) AS e
    FROM d_history GROUP BY issue_id),
apart AS (SELECT issue_id, status FROM d_issue EXCEPT SELECT issue_id, e.b FROM ends)
SELECT i.issue_id, i.event_id, i.status AS current_status, e.history_id AS history_id, e.occurred_at AS occurred_at, e.a AS from_status, e.b AS to_status,
  if(e IS NULL, 'NO_HISTORY', 'LATEST_STATUS_MISMATCH') AS violation_type
FROM apart JOIN d_issue i ON i.issue_id = apart.issue_id LEFT JOIN ends ON ends.issue_id = i.issue_id WHERE true
"""


@query("check_issue_history_state_all", with_views(_HISTORY_STATE, "d_history"))
def check_issue_history_state_all(spark, sf_dir):
    return checks.issue_history_state(derived.tables(spark, sf_dir), Scope.all(NOW))


@query("check_issue_history_state_event", with_views(_HISTORY_STATE + " AND i.event_id = 2", "d_history"))
def check_issue_history_state_event(spark, sf_dir):
    return checks.issue_history_state(derived.tables(spark, sf_dir), Scope.event(2))


# One branch a status, each with the span that the history may be apart; no span, no judgement.
_TIME_SYNC = f"""
WITH {_LATEST}, j AS (SELECT i.*, l.occurred_at, l.from_status, l.reason FROM d_issue i JOIN latest l ON l.issue_id = i.issue_id AND l.to_status = i.status)
SELECT issue_id, event_id, status, issue_time, history_time, abs(apart) AS time_diff_micros, 'TIME_MISMATCH' AS violation_type
FROM (
  SELECT issue_id, event_id, created_at, status, used_at AS issue_time, occurred_at AS history_time, epoch_us(occurred_at) - epoch_us(used_at) AS apart,
    -1000000 AS low, 1000000 AS high FROM j WHERE status = 'USED'
  UNION ALL
  SELECT issue_id, event_id, created_at, status, issued_at, occurred_at, epoch_us(occurred_at) - epoch_us(issued_at),
    if(from_status IS NULL, -1000000, NULL), if(from_status IS NULL, 1000000, NULL) FROM j WHERE status = 'ISSUED'
  UNION ALL
  SELECT issue_id, event_id, created_at, status, valid_to, occurred_at, epoch_us(occurred_at) - epoch_us(valid_to),
    if(reason IS DISTINCT FROM 'MANUAL_EXPIRED', 0, NULL), if(reason IS DISTINCT FROM 'MANUAL_EXPIRED', 1800999999, NULL) FROM j WHERE status = 'EXPIRED')
WHERE (issue_time IS NULL OR NOT coalesce(apart BETWEEN low AND high, true))
"""


@query("check_time_sync_all", with_views(
    _TIME_SYNC + """ AND created_at < TIMESTAMP '2000-01-01'
    AND event_id IN (SELECT event_id FROM d_event WHERE created_at < TIMESTAMP '2000-01-01')""", "d_history", "d_event"))
def check_time_sync_all(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return checks.time_sync(t, _all(t))


@query("check_time_sync_range", with_views(
    _TIME_SYNC + " AND created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1999-01-01'", "d_history"))
def check_time_sync_range(spark, sf_dir):
    return checks.time_sync(derived.tables(spark, sf_dir), Scope.range(FROM, TO))


# One pass: what a coupon's status says it could be late with, if it is.
_LAG = """
SELECT * FROM (
  SELECT issue_id, event_id, status, valid_to, used_at, CASE
      WHEN status = 'USED' AND epoch_us(used_at) - epoch_us(valid_to) > 0 AND used_at {op} TIMESTAMP '2000-01-01' THEN 'USED_AFTER_EXPIRATION'
      WHEN status = 'ISSUED' AND epoch_us(TIMESTAMP '2000-01-01') - epoch_us(valid_to) > 120000000 AND created_at {op} TIMESTAMP '2000-01-01' THEN 'EXPIRATION_BATCH_DELAY'
    END AS violation_type FROM d_issue) WHERE violation_type IS NOT NULL
"""


@query("check_expiration_lag_all", with_views(
    _LAG.format(op="<") + " AND event_id IN (SELECT event_id FROM d_event WHERE created_at < TIMESTAMP '2000-01-01')", "d_issue", "d_event"))
def check_expiration_lag_all(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return checks.expiration_lag(t, _all(t))


@query("check_expiration_lag_range", with_views(
    _LAG.format(op="<=") + " AND valid_to >= TIMESTAMP '1997-01-01' AND valid_to < TIMESTAMP '1999-01-01'", "d_issue"))
def check_expiration_lag_range(spark, sf_dir):
    return checks.expiration_lag(derived.tables(spark, sf_dir), Scope.range(FROM, TO), checked_at=NOW)


# --- uniqueness and accuracy ---------------------------------------------------------------


@query("audit_duplicate_users", with_views(
    "SELECT event_id, user_id, count(*) AS rows FROM d_issue WHERE user_id IS NOT NULL GROUP BY event_id, user_id HAVING count(*) > 1", "d_issue"))
def audit_duplicate_users(spark, sf_dir):
    return checks.duplicate_users(derived.issue(spark, sf_dir))


@query("audit_duplicate_sequences", with_views(
    "SELECT event_id, issue_sequence, count(*) AS rows FROM d_issue GROUP BY event_id, issue_sequence HAVING count(*) > 1", "d_issue"))
def audit_duplicate_sequences(spark, sf_dir):
    return checks.duplicate_keys(derived.issue(spark, sf_dir), ["event_id", "issue_sequence"])


@query("audit_duplicate_message_ids", with_views(
    "SELECT message_id, count(*) AS rows FROM d_issue WHERE message_id IS NOT NULL GROUP BY message_id HAVING count(*) > 1", "d_issue"))
def audit_duplicate_message_ids(spark, sf_dir):
    return checks.duplicate_keys(derived.issue(spark, sf_dir), ["message_id"])


@query("audit_duplicate_event_uids", with_views("""
    SELECT event_uid, count(*) AS rows FROM (
      SELECT concat('uid-', CAST(history_id // 20 AS VARCHAR)) AS event_uid FROM d_history)
    GROUP BY event_uid HAVING count(*) > 1""", "d_history"))
def audit_duplicate_event_uids(spark, sf_dir):
    h = derived.tables(spark, sf_dir).history
    merged = h.withColumn("event_uid", F.concat(F.lit("uid-"), F.floor(F.col("history_id") / 20).cast("string")))
    return checks.duplicate_keys(merged, ["event_uid"])


@query("audit_sequence_density", with_views("""
    SELECT event_id, max(issue_sequence) AS max_sequence, count(*) AS rows, max(issue_sequence) IS NOT DISTINCT FROM count(*) AS dense
    FROM d_issue GROUP BY event_id""", "d_issue"))
def audit_sequence_density(spark, sf_dir):
    return checks.sequence_density(derived.issue(spark, sf_dir))


@query("audit_sequence_gaps", with_views("""
    SELECT event_id, issue_sequence FROM (
      SELECT event_id, issue_sequence, lag(issue_sequence) OVER (PARTITION BY event_id ORDER BY issue_sequence) AS before
      FROM (SELECT DISTINCT event_id, issue_sequence FROM d_issue WHERE issue_sequence > 0))
    WHERE issue_sequence > 1 AND before IS DISTINCT FROM issue_sequence - 1""", "d_issue"))
def audit_sequence_gaps(spark, sf_dir):
    return checks.sequence_gaps(derived.issue(spark, sf_dir))


@query("audit_accuracy_summary", with_views("""
    WITH s AS (SELECT event_id, count(*) AS issue_rows, max(issue_sequence) AS max_sequence, count(message_id) AS message_ids FROM d_issue GROUP BY event_id),
    h AS (SELECT i.event_id, count(*) AS history_rows FROM d_history x JOIN d_issue i ON i.issue_id = x.issue_id WHERE x.from_status IS NULL GROUP BY i.event_id),
    f AS (SELECT event_id, count(*) AS failures FROM d_failure GROUP BY event_id)
    SELECT event_id, total_stock, coalesce(issue_rows, 0) AS issue_rows, max_sequence, coalesce(message_ids, 0) AS message_ids,
      coalesce(history_rows, 0) AS history_rows, coalesce(failures, 0) AS failures,
      coalesce(issue_rows, 0) = coalesce(history_rows, 0) AND coalesce(issue_rows, 0) = total_stock
        AND max_sequence IS NOT DISTINCT FROM coalesce(issue_rows, 0) AND coalesce(failures, 0) = 0
        AND coalesce(message_ids, 0) = coalesce(issue_rows, 0) AS accurate
    FROM d_event LEFT JOIN s USING (event_id) LEFT JOIN h USING (event_id) LEFT JOIN f USING (event_id)""", "d_event", "d_history", "d_failure"))
def audit_accuracy_summary(spark, sf_dir):
    return checks.accuracy_summary(derived.tables(spark, sf_dir))


# --- running several rules -------------------------------------------------------------------

_ALL_SCOPE = """ AND created_at < TIMESTAMP '2000-01-01'"""


@query("run_all_results", with_views(f"""
    WITH bundle AS (
      SELECT 'stock' AS check_name FROM ({_STOCK} AND e.status IN ('SOLD_OUT', 'CLOSED'))
      UNION ALL SELECT 'state_chain' FROM ({_CHAIN} {_ALL_SCOPE})
      UNION ALL SELECT 'issue_structure' FROM ({_ISSUE_STRUCTURE} {_ALL_SCOPE})
      UNION ALL SELECT 'history_structure' FROM ({_HISTORY_STRUCTURE} {_ALL_SCOPE})
      UNION ALL SELECT 'issue_history_state' FROM ({_HISTORY_STATE} AND i.created_at < TIMESTAMP '2000-01-01')
      UNION ALL SELECT 'time_sync' FROM ({_TIME_SYNC} {_ALL_SCOPE})
      UNION ALL SELECT 'expiration_lag' FROM ({_LAG.format(op='<')}))
    SELECT check_name, 'MANUAL' AS trigger_type, 'ALL' AS scope_type,
      'FAIL' AS status, count(*) AS violation_count FROM bundle GROUP BY check_name""", "d_history", "d_event"))
def run_all_results(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    results, _ = run_checks(spark, t, _all(t), NOW)
    return results.select("check_name", "trigger_type", "scope_type", "status", "violation_count")


@query("run_violations_by_type", with_views(f"""
    SELECT 'issue_history_state' AS check_name, violation_type, count(*) AS rows, CAST(sum(issue_id) AS BIGINT) AS ids FROM ({_HISTORY_STATE}) GROUP BY violation_type
    UNION ALL SELECT 'time_sync', 'TIME_MISMATCH', count(*), CAST(sum(issue_id) AS BIGINT) FROM ({_TIME_SYNC})""", "d_history"))
def run_violations_by_type(spark, sf_dir):
    """The two rules that share one pass over the history, for all campaigns."""
    t = derived.tables(spark, sf_dir)
    _, violations = run_checks(spark, t, Scope.events(t.event), NOW, ["issue_history_state", "time_sync"])
    return violations.groupBy("check_name", "violation_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("target_id").alias("ids"))


@query("run_event_results", with_views(f"""
    WITH bundle AS (
      SELECT 'stock' AS check_name FROM ({_STOCK} AND e.event_id = 8)
      UNION ALL SELECT 'state_chain' FROM ({_CHAIN} AND event_id = 8)
      UNION ALL SELECT 'issue_structure' FROM ({_ISSUE_STRUCTURE} AND event_id = 8)
      UNION ALL SELECT 'loss' FROM (SELECT * FROM ({_LOSS}) WHERE event_id = 8 AND outcome = 'FAIL'))
    SELECT n.check_name, CAST(8 AS BIGINT) AS event_id, CASE WHEN count(b.check_name) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
      count(b.check_name) AS violation_count,
      CASE WHEN count(b.check_name) > 0 THEN 'NOT_RECOVERED' ELSE 'NOT_REQUIRED' END AS recovery_status
    FROM (VALUES ('stock'), ('state_chain'), ('issue_structure'), ('loss')) n(check_name)
    LEFT JOIN bundle b ON b.check_name = n.check_name GROUP BY n.check_name""", "d_history", "d_event", "d_state"))
def run_event_results(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    results, _ = run_checks(spark, t, Scope.event(8), NOW, ["stock", "state_chain", "issue_structure", "loss"])
    return results.select("check_name", "event_id", "status", "violation_count", "recovery_status")


# --- stored runs -----------------------------------------------------------------------------

_BUNDLE = f"""
      SELECT 'stock' AS check_name, event_id AS target_id FROM ({_STOCK} AND e.status IN ('SOLD_OUT', 'CLOSED'))
      UNION ALL SELECT 'state_chain', issue_id FROM ({_CHAIN} {_ALL_SCOPE})
      UNION ALL SELECT 'issue_structure', issue_id FROM ({_ISSUE_STRUCTURE} {_ALL_SCOPE})
      UNION ALL SELECT 'history_structure', history_id FROM ({_HISTORY_STRUCTURE} {_ALL_SCOPE})
      UNION ALL SELECT 'issue_history_state', issue_id FROM ({_HISTORY_STATE} AND i.created_at < TIMESTAMP '2000-01-01')
      UNION ALL SELECT 'time_sync', issue_id FROM ({_TIME_SYNC} {_ALL_SCOPE})
      UNION ALL SELECT 'expiration_lag', issue_id FROM ({_LAG.format(op='<')})"""
_RESULT_ID = "CAST('0x' || substr(md5(concat('night:', check_name)), 1, 15) AS BIGINT)"


def _stored(spark, sf_dir):
    """A folder with a run of all rules, stored twice, and an attempt of another run that never ended."""
    folder = work_folder(spark, "runs")
    t = derived.tables(spark, sf_dir)
    run_and_store(spark, t, _all(t), NOW, folder, ["stock"], run_id="night")
    run_and_store(spark, t, _all(t), NOW, folder, run_id="night")
    stored_results(spark, folder).withColumn("status", F.lit("PASS")).drop("run_id").write.parquet(f"{folder}/results/run_id=broken/attempt=one")
    return folder


@query("run_stored_results", with_views(f"""
    WITH bundle AS ({_BUNDLE})
    SELECT {_RESULT_ID} AS result_id, 'night' AS run_id, check_name, 'FAIL' AS status, count(*) AS violation_count, count(*) AS linked, count(DISTINCT target_id) AS targets
    FROM bundle GROUP BY check_name""", "d_history", "d_event"))
def run_stored_results(spark, sf_dir):
    """From the audit to the listing: results by page, each with the stored violations that bear its id."""
    folder = _stored(spark, sf_dir)
    v = stored_violations(spark, folder).groupBy("result_id").agg(F.countDistinct("violation_id").alias("linked"), F.countDistinct("target_id").alias("targets"))
    return reports.results_page(stored_results(spark, folder), 0, 50).join(v, "result_id").select(
        "result_id", "run_id", "check_name", "status", "violation_count", "linked", "targets")


@query("run_stored_pages", with_views(f"""
    WITH bundle AS ({_BUNDLE}), of AS (SELECT check_name, count(*) AS n FROM bundle GROUP BY check_name)
    SELECT TIMESTAMP '2000-01-01' AS bucket, check_name, 'FAIL' AS status, 'ALL' AS scope_type, CAST(1 AS BIGINT) AS runs,
      CASE WHEN check_name = 'state_chain' THEN least(20, greatest(0, n - 20)) END AS second_page, CASE WHEN check_name = 'state_chain' THEN CAST(0 AS BIGINT) END AS orphans
    FROM of""", "d_history", "d_event"))
def run_stored_pages(spark, sf_dir):
    """The series of the stored results by day, and of one result the second page of its violations; none is an orphan."""
    folder = _stored(spark, sf_dir)
    results = stored_results(spark, folder)
    chain = number_of(F.lit("night"), F.lit("state_chain"))
    linked = stored_violations(spark, folder).filter(F.col("result_id") == chain)
    page = reports.page(linked, [F.col("violation_id").desc()], 1, 20).agg(F.count("*").alias("second_page"))
    orphans = stored_violations(spark, folder).join(results.select("result_id"), "result_id", "left_anti").agg(F.count("*").alias("orphans"))
    counts = page.withColumn("check_name", F.lit("state_chain")).join(orphans.withColumn("check_name", F.lit("state_chain")), "check_name")
    return reports.verification_series(results, "1 day").join(counts, "check_name", "left")


@query("run_loaded_event", with_views(f"""
    SELECT 'state_chain' AS check_name, count(*) AS violations FROM ({_CHAIN} AND event_id = 8)
    UNION ALL SELECT 'issue_structure', count(*) FROM ({_ISSUE_STRUCTURE} AND event_id = 8)
    UNION ALL SELECT 'issue_history_state', count(*) FROM ({_HISTORY_STATE} AND i.event_id = 8)""", "d_history"))
def run_loaded_event(spark, sf_dir):
    """A campaign audit of tables that were written as snapshots, laid out by campaign, and loaded again."""
    folder = work_folder(spark, "ledger")
    t = derived.tables(spark, sf_dir)
    write_issue_snapshot(t.issue, f"{folder}/issue")
    write_history_snapshot(t.history, f"{folder}/history")
    for name in ("event", "coupon", "user", "failure"):
        getattr(t, name).write.parquet(f"{folder}/{name}")
    names = ["state_chain", "issue_structure", "issue_history_state"]
    results, _ = run_checks(spark, load(spark, folder), Scope.event(8), NOW, names)
    return results.select("check_name", F.col("violation_count").alias("violations"))


@query("run_all_up_to_margin", with_views(f"""
    SELECT 'issue_structure' AS check_name, count(*) AS violation_count FROM ({_ISSUE_STRUCTURE} AND created_at < TIMESTAMP '1997-06-01' - INTERVAL 10 SECOND
      AND event_id IN (SELECT event_id FROM d_event WHERE created_at < TIMESTAMP '1997-06-01' - INTERVAL 10 SECOND))""", "d_issue", "d_event"))
def run_all_up_to_margin(spark, sf_dir):
    """An audit of everything up to the safety margin before now, so that rows still being written are left out."""
    t = derived.tables(spark, sf_dir)
    end = all_cutoff(datetime(1997, 6, 1), 10)
    results, _ = run_checks(spark, t, Scope.all(end, events_for_all(t.event, end)), end, ["issue_structure"])
    return results.select("check_name", "violation_count")
