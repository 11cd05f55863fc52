"""Composed repairs over all results of a rule, from audit to status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.audits import _CHAIN, _HISTORY_STATE, _LAG, _STOCK, _TIME_SYNC
from catalog.registry import query
from catalog.repairs import _EXCESS, _EXPIRE, _INITIAL, _RESTORE, _SYNC, _tight
from catalog.sqlviews import VIEWS, with_views
from tallyroll.plans import runner
from tallyroll.plans.recover import recover
from tallyroll.plans.scope import Scope
from tallyroll.plans.staging import cut
from tallyroll.sources import derived

NOW, EXPIRY = datetime(2002, 1, 1), datetime(1999, 1, 1)
#: In a third of the campaigns only faults that the rule's repair can mend are left, by remainder of 103 of the issue id.
MENDABLE = {"stock": (), "state_chain": (14, 4), "time_sync": (4,), "issue_history_state": (1,), "expiration_lag": (4, 5)}
FAULTS = range(1, 15)


def _without(check):
    """SQL: the issues that stay."""
    bad = ", ".join(str(q) for q in FAULTS if q not in MENDABLE[check])
    return f"NOT (event_id % 3 = 1 AND ((issue_id - 1) % 101 BETWEEN 1 AND 12 OR issue_id % 103 IN ({bad})))"


def _tables(spark, sf_dir, check):
    t = derived.tables(spark, sf_dir)
    issue = t.issue.filter(F.expr(_without(check)))
    return t.with_(issue=issue, history=t.history.join(issue.select("issue_id"), "issue_id", "left_semi"))


def _audited(t, check, now, issue_wise):
    """Results and violations: one a campaign, one of all campaigns, one that only ran into an error; coupon-wise also one a
    campaign that holds another campaign's violations and two time ranges, campaign-wise one of an unknown campaign."""
    rule = runner.CHECKS[check]
    found = rule.fn(t, Scope.events(t.event), **({"checked_at": now} if check == "expiration_lag" else {}))
    v = cut(runner.as_violations(found, rule))
    e = F.col("event_id")
    parts = [(e, "EVENT", e), (F.lit(100), "ALL", None)]
    if issue_wise:
        parts += [(e + 200, "EVENT", e % 25 + 1), (F.lit(300), "AS_OF_RANGE", None)]
    rows, linked = [], []
    for result, scope, event in parts:
        own = v if scope != "AS_OF_RANGE" else v.filter(e % 5 == 3)
        linked.append(own.select(result.cast("long").alias("result_id"), "check_name", "target_id", "violation_type"))
        ids = t.event if event is not None else t.event.limit(1)
        rows.append(ids.select(result.cast("long").alias("result_id"), F.lit(scope).alias("scope_type"), (F.lit(None) if event is None else event).cast("long").alias("event_id")))
    violations = linked[0]
    results = rows[0]
    for part in linked[1:]:
        violations = violations.unionByName(part)
    for part in rows[1:]:
        results = results.unionByName(part)
    counted = violations.select("result_id").distinct().withColumn("bad", F.lit(True))
    results = results.join(counted, "result_id", "left").select("*", F.when(F.col("bad"), "FAIL").otherwise("PASS").alias("status")).drop("bad")
    spark = t.event.sparkSession
    planted = [(500, "ALL", None, "ERROR")] + ([] if issue_wise else [(999, "EVENT", 999, "FAIL")])
    results = results.unionByName(spark.createDataFrame(planted, "result_id long, scope_type string, event_id long, status string"))
    return results.select(
        "*", F.lit(check).alias("check_name"), F.lit(datetime(1997, 1, 1)).cast("timestamp_ntz").alias("scope_from"),
        F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz").alias("scope_to")), violations


def _statuses(spark, sf_dir, check, action, now=NOW, tight=False, issue_wise=False):
    t = _tables(spark, sf_dir, check)
    t = t.with_(event=_tight(t)) if tight else t
    results, violations = _audited(t, check, now, issue_wise)
    return recover(t, results, violations, action, now).statuses


for _check in MENDABLE:
    VIEWS[f"p_issue_{_check}"] = (("d_issue",), f"SELECT * FROM d_issue WHERE {_without(_check)}")
    VIEWS[f"p_history_{_check}"] = (("d_history", f"p_issue_{_check}"), f"SELECT * FROM d_history WHERE issue_id IN (SELECT issue_id FROM p_issue_{_check})")


def _on(sql, check, event="d_event", issue=None, history=None):
    """The text over other tables."""
    return (sql.replace("d_event", event).replace("d_issue", issue or f"p_issue_{check}").replace("d_history_uid", "d_history")
            .replace("d_history", history or f"p_history_{check}"))


#: Statuses from: viol (target, event_id), good (target, ok), fails (campaigns that fail the rule afterwards), seen (result_id, target, event_id).
_JUDGE = """
  judged AS (SELECT s.result_id, s.ok AND s.event_id NOT IN (SELECT event_id FROM fails WHERE event_id IS NOT NULL) AS fine FROM seen s)
SELECT r.result_id, CASE WHEN count(j.result_id) = 0 THEN 'NOT_APPLICABLE' WHEN bool_and(fine) THEN 'RECOVERED' ELSE 'RECOVERY_FAILED' END AS recovery_status,
  count(j.result_id) AS outcomes, count(*) FILTER (fine) AS recovered
FROM asked r LEFT JOIN judged j ON j.result_id = r.result_id GROUP BY r.result_id
"""
_EVENT_WISE = """
  asked AS (SELECT event_id AS result_id FROM d_event UNION ALL VALUES (100), (500), (999)),
  visited AS (SELECT DISTINCT event_id FROM viol),
  seen AS (SELECT event_id AS result_id, event_id, ok FROM visited LEFT JOIN good USING (event_id)
    UNION ALL SELECT 100, event_id, ok FROM visited LEFT JOIN good USING (event_id) UNION ALL SELECT 999, 999, false)"""
_ISSUE_WISE = """
  asked AS (SELECT event_id AS result_id FROM d_event UNION ALL SELECT event_id + 200 FROM d_event UNION ALL VALUES (100), (300), (500)),
  seen AS (SELECT event_id AS result_id, event_id, ok FROM viol JOIN good USING (target) UNION ALL SELECT 100, event_id, ok FROM viol JOIN good USING (target)
    UNION ALL SELECT event_id + 200, event_id, false FROM viol
    UNION ALL SELECT 300, event_id, ok AND {inside} FROM viol JOIN good USING (target) WHERE event_id % 5 = 3)"""


@query("repair_recover_stock", with_views(f"""
    WITH viol AS (SELECT event_id FROM ({_on(_STOCK, 'stock', 'd_tight')})), active AS (SELECT event_id, count(*) AS n FROM p_issue_stock WHERE status IN ('ISSUED', 'USED', 'EXPIRED') GROUP BY event_id),
    good AS (SELECT e.event_id, coalesce(n, 0) <= total_stock AS ok FROM d_tight e LEFT JOIN active USING (event_id)), {_EVENT_WISE.strip()},
    n_event AS (SELECT e.* REPLACE (CASE WHEN ok AND event_id IN (SELECT event_id FROM visited) THEN coalesce(n, 0) ELSE issued_quantity END AS issued_quantity,
      CASE WHEN ok AND event_id IN (SELECT event_id FROM visited) THEN total_stock - coalesce(n, 0) ELSE remaining_stock END AS remaining_stock)
      FROM d_tight e LEFT JOIN good USING (event_id) LEFT JOIN active USING (event_id)),
    fails AS (SELECT event_id FROM ({_on(_STOCK, 'stock', 'n_event')})), {_JUDGE.strip()}""", "d_tight", "p_issue_stock"))
def repair_recover_stock(spark, sf_dir):
    return _statuses(spark, sf_dir, "stock", "STOCK_RECONCILE_COUNTER", tight=True)


_EX = _EXCESS.replace("d_issue", "p_issue_stock").replace("d_active", "active")


@query("repair_recover_revoke", with_views(f"""
    WITH viol AS (SELECT event_id FROM ({_on(_STOCK, 'stock', 'd_tight')})), active AS (SELECT event_id, count(*) AS n FROM p_issue_stock WHERE status IN ('ISSUED', 'USED', 'EXPIRED') GROUP BY event_id),
    {_EX}, cost AS (SELECT event_id, count(*) AS c, count(*) FILTER (status = 'ISSUED') AS r FROM ex GROUP BY event_id),
    good AS (SELECT e.event_id, coalesce(c = r, false) AS ok FROM d_tight e LEFT JOIN cost USING (event_id)), {_EVENT_WISE.strip()},
    hit AS (SELECT cost.*, n - r AS rest FROM cost JOIN active USING (event_id) WHERE r > 0 AND event_id IN (SELECT event_id FROM visited)),
    n_event AS (SELECT e.* REPLACE (coalesce(rest, issued_quantity) AS issued_quantity, coalesce(total_stock - rest, remaining_stock) AS remaining_stock) FROM d_tight e LEFT JOIN hit USING (event_id)),
    n_issue AS (SELECT * REPLACE (CASE WHEN issue_id IN (SELECT issue_id FROM ex WHERE status = 'ISSUED' AND event_id IN (SELECT event_id FROM hit)) THEN 'CANCELED' ELSE status END AS status) FROM p_issue_stock),
    fails AS (SELECT event_id FROM ({_on(_STOCK, 'stock', 'n_event', 'n_issue')})), {_JUDGE.strip()}""", "d_tight", "p_issue_stock"))
def repair_recover_revoke(spark, sf_dir):
    return _statuses(spark, sf_dir, "stock", "STOCK_REVOKE_EXCESS_ISSUANCE", tight=True)


@query("repair_recover_chain", with_views(f"""
    WITH viol AS (SELECT DISTINCT event_id FROM ({_on(_CHAIN, 'state_chain')})), {_on(_RESTORE.strip(), 'state_chain')},
    good AS (SELECT event_id, bool_and(outcome = 'RECOVERED') AS ok FROM r JOIN p_issue_state_chain USING (issue_id) GROUP BY event_id), {_EVENT_WISE.strip()},
    n_history AS (SELECT * FROM p_history_state_chain WHERE history_id NOT IN (SELECT c.history_id FROM c JOIN r ON r.issue_id = c.issue_id WHERE r.outcome = 'RECOVERED' AND c.rn >= r.cut)),
    fails AS (SELECT event_id FROM ({_on(_CHAIN, 'state_chain', history='n_history')})), {_JUDGE.strip()}""", "d_event", "p_history_state_chain"))
def repair_recover_chain(spark, sf_dir):
    return _statuses(spark, sf_dir, "state_chain", "RESTORE_STATE_MACHINE")


@query("repair_recover_time", with_views(f"""
    WITH viol AS (SELECT DISTINCT event_id FROM ({_on(_TIME_SYNC, 'time_sync')})), {_on(_SYNC, 'time_sync')},
    good AS (SELECT event_id, bool_and(outcome = 'PATCHED') AS ok FROM (SELECT event_id, 'PATCHED' AS outcome FROM viol UNION ALL SELECT event_id, outcome FROM k WHERE outcome IS NOT NULL) GROUP BY event_id),
    {_EVENT_WISE.strip()}, p AS (SELECT * FROM k WHERE outcome = 'PATCHED' AND event_id IN (SELECT event_id FROM visited)),
    n_issue AS (SELECT i.* REPLACE (CASE WHEN p.status = 'ISSUED' THEN p.occurred_at ELSE i.issued_at END AS issued_at, CASE WHEN p.status = 'USED' THEN p.occurred_at ELSE i.used_at END AS used_at)
      FROM p_issue_time_sync i LEFT JOIN p ON p.issue_id = i.issue_id),
    fails AS (SELECT event_id FROM ({_on(_TIME_SYNC, 'time_sync', issue='n_issue')})), {_JUDGE.strip()}""", "d_event", "p_history_time_sync"))
def repair_recover_time(spark, sf_dir):
    return _statuses(spark, sf_dir, "time_sync", "SYNC_TIME_TO_HISTORY")


@query("repair_recover_initial", with_views(f"""
    WITH found AS ({_on(_HISTORY_STATE, 'issue_history_state')}), viol AS (SELECT issue_id AS target, event_id FROM found WHERE violation_type = 'NO_HISTORY'),
    {_on(_INITIAL.strip(), 'issue_history_state')}, good AS (SELECT issue_id AS target, outcome IN ('RESTORED', 'ALREADY_RESOLVED') AS ok FROM k), {_ISSUE_WISE.format(inside='true').strip()},
    n_history AS (SELECT * FROM p_history_issue_history_state UNION ALL BY NAME SELECT 1000000000 + issue_id AS history_id, issue_id, 'ISSUED' AS to_status, issued_at AS occurred_at
      FROM k WHERE outcome = 'RESTORED' AND issue_id IN (SELECT target FROM viol)),
    fails AS (SELECT event_id FROM ({_on(_HISTORY_STATE, 'issue_history_state', history='n_history')})), {_JUDGE.strip()}""", "d_event", "p_history_issue_history_state"))
def repair_recover_initial(spark, sf_dir):
    return _statuses(spark, sf_dir, "issue_history_state", "RESTORE_INITIAL_ISSUE_HISTORY", issue_wise=True)


_LATE = _on(_LAG.format(op="<=").replace("2000-01-01", "1999-01-01"), "expiration_lag")


@query("repair_recover_expire", with_views(f"""
    WITH found AS ({_LATE}), viol AS (SELECT issue_id AS target, event_id, valid_to FROM found WHERE violation_type = 'EXPIRATION_BATCH_DELAY'),
    {_on(_EXPIRE, 'expiration_lag')}, good AS (SELECT issue_id AS target, outcome = 'EXPIRED' AS ok FROM k),
    {_ISSUE_WISE.format(inside="valid_to >= TIMESTAMP '1997-01-01' AND valid_to < TIMESTAMP '1998-01-01'").strip()},
    n_issue AS (SELECT i.* REPLACE (CASE WHEN k.outcome = 'EXPIRED' AND i.issue_id IN (SELECT target FROM viol) THEN 'EXPIRED' ELSE i.status END AS status) FROM p_issue_expiration_lag i JOIN k USING (issue_id)),
    fails AS (SELECT event_id FROM ({_LATE.replace('p_issue_expiration_lag', 'n_issue')})), {_JUDGE.strip()}""", "d_event", "p_issue_expiration_lag"))
def repair_recover_expire(spark, sf_dir):
    return _statuses(spark, sf_dir, "expiration_lag", "EXPIRE_DELAYED_ISSUE", now=EXPIRY, issue_wise=True)
