"""Repairs, planted faults, and keeping audit results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.audits import _CHAIN, _LAG, _LATEST, _STOCK, UUID
from catalog.issuance import uuid3
from catalog.registry import query
from catalog.sqlviews import VIEWS, with_views
from tallyroll.functions.times import hours, seconds, ts
from tallyroll.operators import checks, faults, recovery
from tallyroll.plans import runner
from tallyroll.plans.scope import Scope, events_for_all, next_range
from tallyroll.sources import derived

NOW = datetime(2002, 1, 1)
NOW_SQL = "TIMESTAMP '2002-01-01'"

VIEWS["d_tight"] = (("d_event",), "SELECT * REPLACE (CASE WHEN event_id % 4 = 0 THEN total_stock - 40 ELSE total_stock END AS total_stock) FROM d_event")
VIEWS["d_active"] = (("d_issue",), "SELECT event_id, count(*) AS n FROM d_issue WHERE status IN ('ISSUED', 'USED', 'EXPIRED') GROUP BY event_id")


def _tight(t):
    """Rounds of which every fourth gave out forty coupons too many."""
    return t.event.withColumn("total_stock", F.when(F.col("event_id") % 4 == 0, F.col("total_stock") - 40).otherwise(F.col("total_stock")))


@query("repair_stock_outcomes", with_views("""
    SELECT e.event_id, CASE WHEN coalesce(n, 0) > total_stock THEN 'FAIL' ELSE 'SUCCESS' END AS outcome, issued_quantity AS before_issued_quantity,
      remaining_stock AS before_remaining_stock, coalesce(n, 0) AS actual_active_count FROM d_tight e LEFT JOIN d_active a ON a.event_id = e.event_id""", "d_tight", "d_active"))
def repair_stock_outcomes(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.reconcile_stock(_tight(t), t.issue, NOW).outcomes


@query("repair_stock_applied", with_views("""
    SELECT e.event_id, total_stock, CASE WHEN coalesce(n, 0) > total_stock THEN remaining_stock ELSE total_stock - coalesce(n, 0) END AS remaining_stock,
      CASE WHEN coalesce(n, 0) > total_stock THEN issued_quantity ELSE coalesce(n, 0) END AS issued_quantity
    FROM d_tight e LEFT JOIN d_active a ON a.event_id = e.event_id""", "d_tight", "d_active"))
def repair_stock_applied(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    e = _tight(t)
    return recovery.apply_changes(e, "event_id", recovery.reconcile_stock(e, t.issue, NOW).event_updates).select(
        "event_id", "total_stock", "remaining_stock", "issued_quantity")


_EXCESS = """x AS (SELECT i.*, e.total_stock, a.n AS active, a.n - e.total_stock AS excess,
    row_number() OVER (PARTITION BY i.event_id ORDER BY issue_sequence DESC NULLS LAST, issue_id DESC) AS excess_rank
  FROM d_issue i JOIN d_tight e ON e.event_id = i.event_id JOIN d_active a ON a.event_id = i.event_id WHERE i.status IN ('ISSUED', 'USED', 'EXPIRED')),
  ex AS (SELECT * FROM x WHERE excess > 0 AND excess_rank <= excess)"""


@query("repair_excess_issues", with_views(
    f"WITH {_EXCESS} SELECT issue_id, event_id, status, excess_rank, CASE WHEN status = 'ISSUED' THEN 'REVOKED' ELSE 'UNREVOKABLE' END AS outcome FROM ex", "d_tight", "d_active"))
def repair_excess_issues(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.excess_issues(_tight(t), t.issue).select(
        "issue_id", "event_id", "status", "excess_rank", F.when(F.col("status") == "ISSUED", "REVOKED").otherwise("UNREVOKABLE").alias("outcome"))


@query("repair_revoke_outcomes", with_views(f"""WITH {_EXCESS},
    g AS (SELECT event_id, count(*) AS c, count(*) FILTER (status = 'ISSUED') AS r FROM ex GROUP BY event_id)
    SELECT e.event_id, coalesce(c, 0) AS excess_count, coalesce(r, 0) AS revoked_count, coalesce(c - r, 0) AS unrevokable_count,
      CASE WHEN c = r THEN 'SUCCESS' ELSE 'FAIL' END AS outcome FROM d_tight e LEFT JOIN g ON g.event_id = e.event_id""", "d_tight", "d_active"))
def repair_revoke_outcomes(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.revoke_excess(_tight(t), t.issue, NOW).outcomes


@query("repair_revoke_history", with_views(f"""WITH {_EXCESS}
    SELECT issue_id, 'ISSUED' AS from_status, 'CANCELED' AS to_status, 'SYSTEM_STOCK_RECOVERY' AS actor, 'STOCK_OVER_ISSUANCE_AUTO_REVOKE' AS reason,
      {NOW_SQL} AS occurred_at, {NOW_SQL} AS recorded_at, {uuid3("concat('revoke:', CAST(issue_id AS VARCHAR), ':2002-01-01T00:00:00')")} AS event_uid
    FROM ex WHERE status = 'ISSUED'""", "d_tight", "d_active"))
def repair_revoke_history(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.revoke_excess(_tight(t), t.issue, NOW).history_inserts


_RESTORE = """
  o AS (SELECT *, row_number() OVER w AS rn, lag(to_status) OVER w AS prev FROM d_history WINDOW w AS (PARTITION BY issue_id ORDER BY occurred_at NULLS FIRST, history_id)),
  b AS (SELECT issue_id, min(rn) AS cut FROM o WHERE (rn = 1 AND NOT (from_status IS NULL AND to_status IS NOT DISTINCT FROM 'ISSUED')) OR (rn > 1 AND from_status IS DISTINCT FROM prev) GROUP BY issue_id),
  c AS (SELECT o.*, b.cut FROM o JOIN b ON b.issue_id = o.issue_id),
  v AS (SELECT issue_id, any_value(cut) AS cut, count(*) FILTER (rn >= cut AND to_status IN ('USED', 'EXPIRED')) AS spent,
      max(CASE WHEN rn < cut AND (to_status = 'USED' OR (to_status = 'ISSUED' AND (from_status IS NULL OR from_status = 'USED'))) THEN rn END) AS ru,
      max(CASE WHEN rn < cut AND (to_status IN ('USED', 'CANCELED') OR (to_status = 'ISSUED' AND (from_status IS NULL OR from_status = 'USED'))) THEN rn END) AS rc
    FROM c GROUP BY issue_id),
  r AS (SELECT v.*, CASE WHEN cut > 1 AND spent = 0 THEN 'RECOVERED' ELSE 'NOT_ELIGIBLE' END AS outcome FROM v)"""


@query("repair_chain_outcomes", with_views(
    f"WITH {_RESTORE.strip()} SELECT r.issue_id, i.event_id, outcome FROM r JOIN d_issue i ON i.issue_id = r.issue_id", "d_history"))
def repair_chain_outcomes(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.restore_chain(t.issue, t.history).outcomes


@query("repair_chain_issues", with_views(f"""WITH {_RESTORE.strip()}
    SELECT r.issue_id, l.to_status AS status, CASE WHEN u.to_status = 'USED' THEN u.occurred_at END AS used_at,
      CASE WHEN k.to_status = 'CANCELED' OR (k.to_status = 'ISSUED' AND k.from_status = 'USED') THEN k.occurred_at END AS canceled_at
    FROM r JOIN c l ON l.issue_id = r.issue_id AND l.rn = r.cut - 1 LEFT JOIN c u ON u.issue_id = r.issue_id AND u.rn = r.ru
    LEFT JOIN c k ON k.issue_id = r.issue_id AND k.rn = r.rc WHERE outcome = 'RECOVERED'""", "d_history"))
def repair_chain_issues(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.restore_chain(t.issue, t.history).issue_updates


@query("repair_chain_deletes", with_views(f"""WITH {_RESTORE.strip()}
    SELECT c.history_id, c.issue_id FROM c JOIN r ON r.issue_id = c.issue_id WHERE r.outcome = 'RECOVERED' AND c.rn >= r.cut""", "d_history"))
def repair_chain_deletes(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.restore_chain(t.issue, t.history).history_deletes


_SYNC = f"""{_LATEST}, j AS (SELECT i.*, l.from_status, l.occurred_at, CASE WHEN i.status = 'USED' THEN i.used_at ELSE i.issued_at END AS it
    FROM d_issue i JOIN latest l ON l.issue_id = i.issue_id WHERE i.status IN ('ISSUED', 'USED')),
  k AS (SELECT *, CASE WHEN status = 'ISSUED' AND from_status IS NOT NULL THEN 'NOT_ELIGIBLE'
    WHEN it IS NULL OR abs(date_diff('microsecond', it, occurred_at)) > 1000000 THEN 'PATCHED' END AS outcome FROM j)"""


@query("repair_time_outcomes", with_views(f"WITH {_SYNC} SELECT issue_id, event_id, outcome FROM k WHERE outcome IS NOT NULL", "d_history"))
def repair_time_outcomes(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.sync_times(t.issue, t.history).outcomes


@query("repair_time_issues", with_views(f"""WITH {_SYNC} SELECT issue_id, CASE WHEN status = 'ISSUED' THEN occurred_at ELSE issued_at END AS issued_at,
    CASE WHEN status = 'USED' THEN occurred_at ELSE used_at END AS used_at FROM k WHERE outcome = 'PATCHED'""", "d_history"))
def repair_time_issues(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.sync_times(t.issue, t.history).issue_updates


# Planted so that every outcome occurs: some first rows were restored before, some uids are used elsewhere.
VIEWS["d_history_uid"] = (("d_history", "d_issue"), """
  SELECT h.* REPLACE (CASE WHEN h.from_status IS NULL AND h.issue_id % 5 = 0 THEN i.request_id
      WHEN h.from_status IS NULL AND h.issue_id % 5 = 2 THEN concat('uid-', h.issue_id) ELSE h.event_uid END AS event_uid)
  FROM d_history h JOIN d_issue i ON i.issue_id = h.issue_id
""")


def _history_uid(t):
    ids = t.issue.select("issue_id", "request_id")
    n, first = F.col("issue_id") % 5, F.col("from_status").isNull()
    return t.history.join(ids, "issue_id").withColumn(
        "event_uid", F.when(first & (n == 0), F.col("request_id")).when(first & (n == 2), F.concat(F.lit("uid-"), F.col("issue_id").cast("string")))
        .otherwise(F.col("event_uid"))).drop("request_id")


_INITIAL = f"""
  m AS (SELECT h.issue_id, count(*) AS c, count(*) FILTER (h.from_status IS NULL AND h.to_status = 'ISSUED' AND h.event_uid = i.request_id) AS r
    FROM d_history_uid h JOIN d_issue i ON i.issue_id = h.issue_id GROUP BY h.issue_id),
  k AS (SELECT i.*, coalesce(c, 0) AS history_count, CASE
      WHEN i.request_id IS NULL OR NOT regexp_matches(i.request_id, {UUID}) OR i.issued_at IS NULL THEN 'INVALID_SOURCE'
      WHEN i.status = 'ISSUED' AND i.used_at IS NULL AND i.canceled_at IS NULL AND coalesce(r, 0) = 1 THEN 'ALREADY_RESOLVED'
      WHEN i.status <> 'ISSUED' OR coalesce(c, 0) <> 0 THEN 'NOT_VIOLATING'
      WHEN i.used_at IS NOT NULL OR i.canceled_at IS NOT NULL THEN 'TOUCHED'
      WHEN i.request_id IN (SELECT event_uid FROM d_history_uid) THEN 'UID_TAKEN' ELSE 'RESTORED' END AS outcome
    FROM d_issue i LEFT JOIN m ON m.issue_id = i.issue_id)"""


@query("repair_initial_outcomes", with_views(
    f"WITH {_INITIAL.strip()} SELECT issue_id, event_id, history_count, outcome FROM k", "d_history_uid"))
def repair_initial_outcomes(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.restore_initial_history(t.issue, _history_uid(t), NOW).outcomes


@query("repair_initial_history", with_views(f"""WITH {_INITIAL.strip()}
    SELECT issue_id, CAST(NULL AS VARCHAR) AS from_status, 'ISSUED' AS to_status, 'SYSTEM' AS actor, 'ISSUE_CONFIRMED' AS reason, issued_at AS occurred_at,
      {NOW_SQL} AS recorded_at, request_id AS event_uid FROM k WHERE outcome = 'RESTORED'""", "d_history_uid"))
def repair_initial_history(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.restore_initial_history(t.issue, _history_uid(t), NOW).history_inserts


_EXPIRE = f"""k AS (SELECT *, CASE WHEN status <> 'ISSUED' OR used_at IS NOT NULL OR valid_to IS NULL THEN 'NOT_VIOLATING'
    WHEN NOT valid_to + INTERVAL 120 SECOND < TIMESTAMP '1999-01-01' THEN 'NOT_DUE'
    WHEN created_at > TIMESTAMP '1999-01-01' THEN 'NOT_CREATED_YET'
    WHEN NOT coalesce(user_id IS NOT NULL AND issue_sequence > 0 AND regexp_matches(request_id, {UUID}) AND (message_id IS NULL OR regexp_matches(message_id, {UUID}))
      AND issued_at <= valid_from AND valid_from < valid_to AND created_at >= issued_at, false) THEN 'INVALID_STRUCTURE' ELSE 'EXPIRED' END AS outcome FROM d_issue)"""


@query("repair_expire_outcomes", with_views(f"WITH {_EXPIRE} SELECT issue_id, event_id, outcome FROM k", "d_issue"))
def repair_expire_outcomes(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.expire_delayed(t.issue, t.history, datetime(1999, 1, 1)).outcomes


@query("repair_expire_history", with_views(f"""WITH {_EXPIRE} SELECT issue_id, 'ISSUED' AS from_status, 'EXPIRED' AS to_status, 'SYSTEM' AS actor,
    'CONSISTENCY_RECOVERY_EXPIRATION' AS reason, valid_to AS occurred_at, TIMESTAMP '1999-01-01' AS recorded_at,
    {uuid3("concat('expire:', CAST(issue_id AS VARCHAR), ':1999-01-01T00:00:00')")} AS event_uid FROM k WHERE outcome = 'EXPIRED'""", "d_issue"))
def repair_expire_history(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.expire_delayed(t.issue, t.history, datetime(1999, 1, 1)).history_inserts


@query("repair_expire_again", with_views(f"""WITH {_EXPIRE} SELECT issue_id, event_id,
    CASE WHEN outcome = 'EXPIRED' THEN 'ALREADY_RESOLVED' ELSE outcome END AS outcome FROM k""", "d_issue"))
def repair_expire_again(spark, sf_dir):
    """Applying the repair and running it again finds every repaired coupon resolved."""
    t = derived.tables(spark, sf_dir)
    at = datetime(1999, 1, 1)
    p = recovery.expire_delayed(t.issue, t.history, at)
    issue = recovery.apply_changes(t.issue, "issue_id", p.issue_updates)
    history = recovery.apply_changes(t.history, "history_id", inserts=p.history_inserts)
    return recovery.expire_delayed(issue, history, at).outcomes


def _violations(t, names):
    scope = Scope.all(NOW, events_for_all(t.event, NOW))
    frames = [runner.as_violations(runner.CHECKS[n].fn(t, scope), runner.CHECKS[n]) for n in names]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("repair_targets_events", with_views(f"""
    SELECT DISTINCT event_id FROM ({_CHAIN})""", "d_history"))
def repair_targets_events(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.recovery_targets(_violations(t, ["state_chain", "stock"]), t.issue, "state_chain")


@query("repair_targets_issues", with_views(
    f"SELECT DISTINCT issue_id FROM ({_LAG.format(op='<').replace('2000-01-01', '2002-01-01')}) WHERE violation_type = 'EXPIRATION_BATCH_DELAY'", "d_issue"))
def repair_targets_issues(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return recovery.recovery_targets(_violations(t, ["expiration_lag"]), t.issue, "expiration_lag")


VIEWS["d_result"] = ((), """
  SELECT event_id AS result_id, ['stock', 'loss', 'state_chain', 'issue_structure', 'history_structure', 'issue_history_state', 'time_sync', 'expiration_lag'][event_id % 8 + 1] AS check_name,
    CASE event_id % 3 WHEN 0 THEN 'EVENT' WHEN 1 THEN 'AS_OF_RANGE' ELSE 'ALL' END AS scope_type, user_id AS event_id, ts - INTERVAL 1 DAY AS scope_from, ts AS scope_to,
    CASE event_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'FAIL' ELSE 'ERROR' END AS status, event_id % 6 AS violation_count,
    ts + INTERVAL 1 SECOND AS executed_at, CAST(value * 100 AS BIGINT) AS duration_millis FROM events
""")


def results_table(spark, sf_dir):
    """Audit result rows from ``events``."""
    e, at = F.col("event_id"), F.col("ts").cast("timestamp_ntz")
    names = F.array(*[F.lit(n) for n in (
        "stock", "loss", "state_chain", "issue_structure", "history_structure", "issue_history_state", "time_sync", "expiration_lag")])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("result_id"), F.element_at(names, (e % 8 + 1).cast("int")).alias("check_name"),
        F.when(e % 3 == 0, "EVENT").when(e % 3 == 1, "AS_OF_RANGE").otherwise("ALL").alias("scope_type"), F.col("user_id").alias("event_id"),
        (at - hours(24)).alias("scope_from"), at.alias("scope_to"),
        F.when(e % 4 == 0, "PASS").when(e % 4 == 3, "ERROR").otherwise("FAIL").alias("status"), (e % 6).alias("violation_count"),
        (at + seconds(1)).alias("executed_at"), F.round(F.col("value") * 100).cast("long").alias("duration_millis"))


@query("repair_actions", with_views("""
    SELECT r.result_id, r.check_name, a.action FROM d_result r LEFT JOIN (VALUES ('stock', 'STOCK_RECONCILE_COUNTER'), ('stock', 'STOCK_REVOKE_EXCESS_ISSUANCE'),
      ('state_chain', 'RESTORE_STATE_MACHINE'), ('time_sync', 'SYNC_TIME_TO_HISTORY'), ('issue_history_state', 'RESTORE_INITIAL_ISSUE_HISTORY'),
      ('expiration_lag', 'EXPIRE_DELAYED_ISSUE')) a(check_name, action) ON a.check_name = r.check_name""", "d_result"))
def repair_actions(spark, sf_dir):
    return recovery.recovery_actions(results_table(spark, sf_dir))


@query("repair_allowed_results", with_views("""
    SELECT result_id FROM d_result WHERE status = 'FAIL' AND check_name IN ('stock', 'state_chain', 'time_sync', 'issue_history_state', 'expiration_lag')""", "d_result"))
def repair_allowed_results(spark, sf_dir):
    return recovery.repairable(results_table(spark, sf_dir)).select("result_id")


@query("repair_reverify_stock", with_views(f"""
    WITH v AS (SELECT e.event_id, e.event_id % 3 AS result_id, coalesce(n, 0) <= total_stock AS good FROM d_tight e LEFT JOIN d_active a ON a.event_id = e.event_id)
    SELECT CAST(result_id AS BIGINT) AS result_id, CASE WHEN bool_and(good) THEN 'RECOVERED' ELSE 'RECOVERY_FAILED' END AS recovery_status, count(*) AS outcomes,
      count(*) FILTER (good) AS recovered FROM v GROUP BY result_id""", "d_tight", "d_active"))
def repair_reverify_stock(spark, sf_dir):
    """Reconcile, apply, audit again, and judge each result by its campaigns."""
    t = derived.tables(spark, sf_dir)
    t = t.with_(event=_tight(t))
    p = recovery.reconcile_stock(t.event, t.issue, NOW)
    fixed = t.with_(event=recovery.apply_changes(t.event, "event_id", p.event_updates))
    outcomes = p.outcomes.select(
        (F.col("event_id") % 3).alias("result_id"), "event_id", (F.col("outcome") == "SUCCESS").alias("succeeded"))
    return recovery.recovery_status(outcomes, runner.recheck(fixed, "stock", outcomes))


# --- watermark and stored violations ------------------------------------------------------


@query("audit_next_range", with_views("""
    SELECT check_name, coalesce(max(scope_to) FILTER (scope_type = 'AS_OF_RANGE' AND status <> 'ERROR'), TIMESTAMP '2024-01-20' - INTERVAL 10 SECOND - INTERVAL 24 HOUR) AS scope_from,
      TIMESTAMP '2024-01-20' - INTERVAL 10 SECOND AS scope_to,
      coalesce(max(scope_to) FILTER (scope_type = 'AS_OF_RANGE' AND status <> 'ERROR'), TIMESTAMP '2024-01-20' - INTERVAL 10 SECOND - INTERVAL 24 HOUR) >= TIMESTAMP '2024-01-20' - INTERVAL 10 SECOND AS skip
    FROM d_result WHERE scope_to < TIMESTAMP '2024-01-18' OR check_name IN ('stock', 'loss') GROUP BY check_name""", "d_result"))
def audit_next_range(spark, sf_dir):
    r = results_table(spark, sf_dir).filter((F.col("scope_to") < ts("2024-01-18 00:00:00")) | F.col("check_name").isin("stock", "loss"))
    return next_range(r, datetime(2024, 1, 20))


VIEWS["d_violation"] = ((), """
  SELECT event_id AS violation_id, concat('run-', CAST(event_id % 50 AS VARCHAR)) AS run_id, CASE event_id % 2 WHEN 0 THEN 'stock' ELSE 'time_sync' END AS check_name,
    user_id AS target_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 50 END AS result_id, ts AS created_at FROM events
""")


def violations_table(spark, sf_dir):
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("violation_id"), F.concat(F.lit("run-"), (e % 50).cast("string")).alias("run_id"),
        F.when(e % 2 == 0, "stock").otherwise("time_sync").alias("check_name"), F.col("user_id").alias("target_id"),
        F.when(e % 5 != 0, e % 50).alias("result_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"))


@query("audit_link_mismatch", with_views("""
    WITH r AS (SELECT run_id, check_name, min(violation_id) AS result_id, count(*) - CASE WHEN min(violation_id) % 3 = 0 THEN 1 ELSE 0 END AS violation_count FROM d_violation GROUP BY run_id, check_name)
    SELECT r.result_id, r.violation_count, count(*) AS linked FROM r JOIN d_violation v ON v.run_id = r.run_id AND v.check_name = r.check_name
    GROUP BY ALL HAVING count(*) <> r.violation_count""", "d_violation"))
def audit_link_mismatch(spark, sf_dir):
    v = violations_table(spark, sf_dir).drop("result_id")
    r = v.groupBy("run_id", "check_name").agg(F.min("violation_id").alias("result_id"), F.count(F.lit(1)).alias("n")).select(
        "run_id", "check_name", "result_id", (F.col("n") - F.when(F.col("result_id") % 3 == 0, 1).otherwise(0)).alias("violation_count"))
    return runner.link_violations(v, r)[1]


@query("audit_orphan_violations", with_views("""
    WITH runs AS (SELECT run_id, check_name, max(created_at) AS last_updated FROM d_violation GROUP BY run_id, check_name)
    SELECT violation_id FROM d_violation v WHERE result_id IS NULL AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_id = v.run_id AND r.check_name = v.check_name
      AND r.last_updated >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 30 MINUTE)""", "d_violation"))
def audit_orphan_violations(spark, sf_dir):
    v = violations_table(spark, sf_dir)
    runs = v.groupBy("run_id", "check_name").agg(F.max("created_at").alias("last_updated"))
    return runner.orphan_violations(v, runs, datetime(2024, 1, 30, 23)).select("violation_id")


# --- planted faults -------------------------------------------------------------------------


def _changed(before, after, key, columns):
    """Rows that differ between two states of a table."""
    b = before.select(key, F.struct(*columns).alias("b"))
    return after.select(key, *columns, F.struct(*columns).alias("a")).join(b, key, "left").filter(~F.col("a").eqNullSafe(F.col("b"))).drop("a", "b")


_NEWEST = "row_number() OVER (PARTITION BY event_id ORDER BY created_at DESC NULLS LAST, issue_id DESC)"
_NEWEST_H = """hh AS (SELECT h.*, i.event_id, i.status, row_number() OVER (PARTITION BY i.event_id ORDER BY h.occurred_at DESC NULLS LAST, h.history_id DESC) AS rn
    FROM d_history h JOIN d_issue i ON i.issue_id = h.issue_id)"""


@query("plant_expiration_lag", with_views(f"""
    SELECT issue_id, {NOW_SQL} - INTERVAL 24 HOUR AS valid_to FROM (SELECT *, {_NEWEST} AS rn FROM d_issue WHERE status = 'ISSUED') WHERE rn = 1""", "d_issue"))
def plant_expiration_lag(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return _changed(t.issue, faults.expiration_lag(t, NOW).issue, "issue_id", ["valid_to"])


@query("plant_history_structure", with_views(
    f"WITH {_NEWEST_H} SELECT history_id, 'INVALID_STATUS' AS to_status FROM hh WHERE rn = 1 AND to_status IS DISTINCT FROM 'INVALID_STATUS'", "d_history"))
def plant_history_structure(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return _changed(t.history, faults.history_structure(t, NOW).history, "history_id", ["to_status"])


@query("plant_issue_history_state", with_views(f"""
    SELECT issue_id, CASE WHEN status = 'ISSUED' THEN 'USED' ELSE 'ISSUED' END AS status, CASE WHEN status = 'ISSUED' THEN {NOW_SQL} END AS used_at,
      CAST(NULL AS TIMESTAMP) AS canceled_at FROM (SELECT *, {_NEWEST} AS rn FROM d_issue) WHERE rn = 1""", "d_issue"))
def plant_issue_history_state(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return _changed(t.issue, faults.issue_history_state(t, NOW).issue, "issue_id", ["status", "used_at", "canceled_at"])


@query("plant_issue_structure", with_views(f"""
    SELECT issue_id, concat('INVALID-REQUEST-ID-', CAST(issue_id AS VARCHAR)) AS request_id FROM (SELECT *, {_NEWEST} AS rn FROM d_issue)
    WHERE rn = 1 AND request_id NOT LIKE 'INVALID%'""", "d_issue"))
def plant_issue_structure(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return _changed(t.issue, faults.issue_structure(t, NOW).issue, "issue_id", ["request_id"])


@query("plant_time_sync", with_views(f"""
    WITH {_LATEST}, j AS (SELECT i.*, row_number() OVER (PARTITION BY i.event_id ORDER BY CASE WHEN i.status = 'USED' THEN 0 ELSE 1 END,
        CASE WHEN i.status = 'USED' THEN i.used_at ELSE i.issued_at END DESC NULLS LAST, i.issue_id DESC) AS k
      FROM d_issue i JOIN latest l ON l.issue_id = i.issue_id
      WHERE (i.status = 'USED' AND l.to_status = 'USED') OR (i.status = 'ISSUED' AND l.to_status = 'ISSUED' AND l.from_status IS NULL))
    SELECT issue_id, CASE WHEN status = 'USED' THEN used_at + INTERVAL 5 SECOND ELSE used_at END AS used_at,
      CASE WHEN status = 'USED' THEN issued_at ELSE issued_at - INTERVAL 5 SECOND END AS issued_at FROM j WHERE k = 1""", "d_history"))
def plant_time_sync(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return _changed(t.issue, faults.time_sync(t, NOW).issue, "issue_id", ["used_at", "issued_at"])


@query("plant_loss", with_views("SELECT event_id, remaining_stock - 1 AS remaining_stock FROM d_state", "d_state"))
def plant_loss(spark, sf_dir):
    return faults.loss(derived.tables(spark, sf_dir), NOW).state.select("event_id", "remaining_stock")


@query("plant_state_chain", with_views(f"""WITH {_NEWEST_H}
    SELECT issue_id, CASE WHEN status = 'ISSUED' THEN 'USED' ELSE 'ISSUED' END AS from_status, status AS to_status, {NOW_SQL} AS occurred_at FROM hh WHERE rn = 1""", "d_history"))
def plant_state_chain(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return faults.state_chain(t, NOW).history.filter(F.col("actor") == "INJECTOR").select("issue_id", "from_status", "to_status", "occurred_at")


@query("plant_stock_found", with_views(_STOCK.replace("remaining_stock AS rest", "remaining_stock - 1 AS rest"), "d_event"))
def plant_stock_found(spark, sf_dir):
    """Rounds the stock audit reports once their remaining stock is off by one."""
    planted = faults.stock(derived.tables(spark, sf_dir), NOW)
    return checks.stock(planted, Scope.events(planted.event))
