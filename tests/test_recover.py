"""Composed repairs: targets, scope, outcomes, the audit afterwards and each result's status."""

from datetime import datetime, timedelta

import pytest
from conftest import START, event_row, history_row, issue_row, uuid_of

from tallyroll.plans.recover import REPAIRS, recover
from tallyroll.sources.ledger import Tables

NOW = datetime(2026, 8, 20)
RESULT = "result_id long, check_name string, status string, scope_type string, event_id long, scope_from timestamp_ntz, scope_to timestamp_ntz"
VIOLATION = "result_id long, check_name string, target_id long, violation_type string"


def result(number, check, status="FAIL", scope="ALL", event=None, start=None, end=None):
    return number, check, status, scope, event, start, end


def run(spark, tables, check, action, results, violations):
    r = recover(
        tables, spark.createDataFrame(results, RESULT), spark.createDataFrame([(n, check, target, kind) for n, target, kind in violations], VIOLATION), action, NOW)
    statuses = {x["result_id"]: (x["recovery_status"], x["outcomes"], x["recovered"]) for x in r.statuses.collect()}
    outcomes = {(x["result_id"], x["target_id"]): x["outcome"] for x in r.outcomes.collect()}
    return r, statuses, outcomes


def test_expiry_checks_scope_and_targets(spark, make):
    late = datetime(2026, 8, 18, 10, 30)
    tables = Tables(
        issue=make.issue(issue_row(1), issue_row(2, event_id=2), issue_row(3, event_id=2, valid_to=NOW + timedelta(days=1)), issue_row(4, event_id=3, message_id="x")),
        history=make.history(history_row(1, 1, None, "ISSUED")), event=make.event(event_row(1), event_row(2), event_row(3)))
    c, kind = "expiration_lag", "EXPIRATION_BATCH_DELAY"
    results = [
        result(1, c, scope="EVENT", event=1), result(2, c, scope="EVENT", event=1), result(3, c), result(4, c, "PASS"), result(5, c), result(6, c),
        result(7, c, scope="AS_OF_RANGE", start=late, end=late + timedelta(seconds=1)), result(8, c, scope="AS_OF_RANGE", start=late - timedelta(hours=1), end=late),
        result(9, "stock"), result(10, c)]
    violations = [
        (1, 1, kind), (1, 1, kind), (2, 2, kind), (3, 1, kind), (3, 3, kind), (4, 1, kind), (5, 1, "USED_AFTER_EXPIRATION"), (6, 99, kind), (7, 1, kind), (8, 1, kind), (10, 4, kind)]
    r, statuses, outcomes = run(spark, tables, c, "EXPIRE_DELAYED_ISSUE", results, violations)
    assert outcomes == {
        (1, 1): "EXPIRED", (2, 2): "OUT_OF_SCOPE", (3, 1): "EXPIRED", (3, 3): "NOT_DUE", (6, 99): "NOT_FOUND", (7, 1): "EXPIRED", (8, 1): "OUT_OF_SCOPE", (10, 4): "INVALID_STRUCTURE"}
    assert statuses == {
        1: ("RECOVERED", 1, 1), 2: ("RECOVERY_FAILED", 1, 0), 3: ("RECOVERY_FAILED", 2, 1), 4: ("NOT_APPLICABLE", 0, 0), 5: ("NOT_APPLICABLE", 0, 0),
        6: ("RECOVERY_FAILED", 1, 0), 7: ("RECOVERED", 1, 1), 8: ("RECOVERY_FAILED", 1, 0), 10: ("RECOVERY_FAILED", 1, 0)}
    # Coupon 2 was only a target of another campaign's result: left as it is.
    assert {x["issue_id"]: x["status"] for x in r.tables.issue.collect()} == {1: "EXPIRED", 2: "ISSUED", 3: "ISSUED", 4: "ISSUED"}
    assert sorted(x["history_id"] for x in r.tables.history.collect()) == [1, 2]


def test_initial_history_out_of_scope_is_not_written(spark, make):
    tables = Tables(
        issue=make.issue(issue_row(1), issue_row(2, event_id=2), issue_row(3, event_id=2, request_id="x")),
        history=make.history(history_row(7, 9, None, "ISSUED")), event=make.event(event_row(1), event_row(2)))
    c, kind = "issue_history_state", "NO_HISTORY"
    results = [result(1, c, scope="EVENT", event=1), result(2, c, scope="EVENT", event=7), result(3, c)]
    r, statuses, outcomes = run(spark, tables, c, "RESTORE_INITIAL_ISSUE_HISTORY", results, [(1, 1, kind), (2, 2, kind), (3, 1, kind), (3, 3, kind), (3, 2, "LATEST_STATUS_MISMATCH")])
    assert outcomes == {(1, 1): "RESTORED", (2, 2): "OUT_OF_SCOPE", (3, 1): "RESTORED", (3, 3): "INVALID_SOURCE"}
    assert statuses == {1: ("RECOVERED", 1, 1), 2: ("RECOVERY_FAILED", 1, 0), 3: ("RECOVERY_FAILED", 2, 1)}
    rows = {x["issue_id"]: (x["history_id"], x["event_uid"]) for x in r.tables.history.collect()}
    assert rows == {9: (7, "uid-7"), 1: (8, uuid_of(1))}


def test_chains_are_judged_by_campaign(spark, make):
    h = [
        history_row(1, 1, None, "ISSUED"), history_row(2, 1, "USED", "ISSUED", START + timedelta(hours=1)),
        history_row(3, 2, None, "ISSUED"), history_row(4, 2, "ISSUED", "USED", START + timedelta(hours=1)), history_row(5, 2, "ISSUED", "USED", START + timedelta(hours=2)),
        history_row(6, 3, None, "ISSUED")]
    tables = Tables(
        issue=make.issue(issue_row(1), issue_row(2, event_id=2), issue_row(3, event_id=3)), history=make.history(*h),
        event=make.event(event_row(1), event_row(2), event_row(3)))
    c = "state_chain"
    results = [result(1, c, scope="EVENT", event=1), result(2, c, scope="EVENT", event=2), result(3, c, scope="EVENT", event=3), result(4, c), result(5, c, scope="EVENT", event=77), result(6, c)]
    r, statuses, outcomes = run(spark, tables, c, "RESTORE_STATE_MACHINE", results, [(4, 1, "BROKEN_CHAIN"), (4, 2, "BROKEN_CHAIN"), (6, 1, "BROKEN_CHAIN")])
    assert outcomes == {(1, 1): "RECOVERED", (2, 2): "NOT_ELIGIBLE", (3, 3): "NOT_VIOLATING", (4, 1): "RECOVERED", (4, 2): "NOT_ELIGIBLE", (5, 77): "NOT_FOUND", (6, 1): "RECOVERED"}
    assert statuses == {
        1: ("RECOVERED", 1, 1), 2: ("RECOVERY_FAILED", 1, 0), 3: ("RECOVERED", 1, 1), 4: ("RECOVERY_FAILED", 2, 1), 5: ("RECOVERY_FAILED", 1, 0), 6: ("RECOVERED", 1, 1)}
    assert sorted(x["history_id"] for x in r.tables.history.collect()) == [1, 3, 4, 5, 6]


def test_stock_repairs_and_the_audit_that_follows(spark, make):
    issues = [issue_row(n, event_id=1, issue_sequence=n) for n in (1, 2)] + [issue_row(n + 10, event_id=2, issue_sequence=n) for n in (1, 2, 3)] + [
        issue_row(n + 20, event_id=3, issue_sequence=n, status="USED") for n in (1, 2)]
    events = [event_row(1, remaining_stock=3), event_row(2, total_stock=2, remaining_stock=0), event_row(3, total_stock=1, remaining_stock=0)]
    tables = Tables(issue=make.issue(*issues), history=make.history(), event=make.event(*events))
    c = "stock"
    results = [result(n, c, scope="EVENT", event=n) for n in (1, 2, 3)] + [result(4, c)]
    bad = [(4, n, "STOCK_MISMATCH") for n in (1, 2)]
    _, statuses, outcomes = run(spark, tables, c, "STOCK_RECONCILE_COUNTER", results, bad)
    assert statuses == {1: ("RECOVERED", 1, 1), 2: ("RECOVERY_FAILED", 1, 0), 3: ("RECOVERY_FAILED", 1, 0), 4: ("RECOVERY_FAILED", 2, 1)}
    r, statuses, outcomes = run(spark, tables, c, "STOCK_REVOKE_EXCESS_ISSUANCE", results, bad)
    assert outcomes == {(1, 1): "FAIL", (2, 2): "SUCCESS", (3, 3): "FAIL", (4, 1): "FAIL", (4, 2): "SUCCESS"}
    assert statuses == {1: ("RECOVERY_FAILED", 1, 0), 2: ("RECOVERED", 1, 1), 3: ("RECOVERY_FAILED", 1, 0), 4: ("RECOVERY_FAILED", 2, 1)}
    assert {x["issue_id"] for x in r.tables.issue.filter("status = 'CANCELED'").collect()} == {13}


def test_nothing_asked(spark, make):
    tables = Tables(issue=make.issue(issue_row(1)), history=make.history(), event=make.event(event_row(1)))
    for action, repair in REPAIRS.items():
        r = recover(tables, spark.createDataFrame([], RESULT), spark.createDataFrame([], VIOLATION), action, NOW)
        assert r.statuses.collect() == [] and r.outcomes.collect() == [] and r.tables.issue.count() == 1, repair.check
    with pytest.raises(ValueError):
        recover(tables, spark.createDataFrame([], RESULT), spark.createDataFrame([], VIOLATION), "NO_SUCH_ACTION", NOW)
