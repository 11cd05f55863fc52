from datetime import datetime, timedelta

from conftest import CHECKED, START, event_row, history_row, issue_row, sec, uuid_of

from tallyroll.operators import checks, faults, recovery
from tallyroll.plans import runner
from tallyroll.plans.scope import Scope
from tallyroll.sources.ledger import Tables

NOW = datetime(2026, 8, 18, 13)


def outcome(df, key="issue_id"):
    return {r[key]: r["outcome"] for r in df.collect()}


def test_reconcile_and_revoke(make):
    event = make.event(event_row(1, total_stock=2), event_row(2, total_stock=5), event_row(3, total_stock=1))
    issue = make.issue(
        issue_row(1), issue_row(2, status="USED"), issue_row(3), issue_row(4, status="CANCELED"), issue_row(5, event_id=2),
        issue_row(6, event_id=3), issue_row(7, event_id=3, status="EXPIRED"))
    fixed = recovery.reconcile_stock(event, issue, NOW)
    assert outcome(fixed.outcomes, "event_id") == {1: "FAIL", 2: "SUCCESS", 3: "FAIL"}
    assert [(r["event_id"], r["issued_quantity"], r["remaining_stock"]) for r in fixed.event_updates.collect()] == [(2, 1, 4)]
    p = recovery.revoke_excess(event, issue, NOW)
    got = {r["event_id"]: (r["excess_count"], r["revoked_count"], r["outcome"]) for r in p.outcomes.collect()}
    assert got == {1: (1, 1, "SUCCESS"), 2: (0, 0, "FAIL"), 3: (1, 0, "FAIL")}
    assert [(r["issue_id"], r["status"]) for r in p.issue_updates.collect()] == [(3, "CANCELED")]
    assert [(r["event_id"], r["issued_quantity"], r["remaining_stock"]) for r in p.event_updates.collect()] == [(1, 2, 0)]
    row = p.history_inserts.collect()[0]
    assert (row["issue_id"], row["from_status"], row["to_status"], row["actor"]) == (3, "ISSUED", "CANCELED", "SYSTEM_STOCK_RECOVERY")


def test_restore_chain(make):
    d = timedelta(days=1)
    issue = make.issue(*[issue_row(i, status="USED", used_at=START) for i in range(1, 7)])
    history = make.history(
        history_row(1, 1, None, "ISSUED"), history_row(2, 1, "ISSUED", "USED", START + d),
        history_row(3, 2, None, "ISSUED"), history_row(4, 2, "USED", "ISSUED", START + d),
        history_row(5, 3, None, "ISSUED"), history_row(6, 3, "EXPIRED", "USED", START + d),
        history_row(7, 4, "ISSUED", "USED"), history_row(8, 5, None, "ISSUED"), history_row(9, 5, "ISSUED", "USED", START + d),
        history_row(10, 5, "USED", "ISSUED", START + 2 * d), history_row(11, 5, "CANCELED", "ISSUED", START + 3 * d),
        history_row(12, 6, None, "ISSUED"), history_row(13, 6, "ISSUED", "CANCELED", START + d), history_row(14, 6, "USED", "CANCELED", START + 2 * d))
    p = recovery.restore_chain(issue, history)
    assert outcome(p.outcomes) == {2: "RECOVERED", 3: "NOT_ELIGIBLE", 4: "NOT_ELIGIBLE", 5: "RECOVERED", 6: "RECOVERED"}
    assert {r["history_id"] for r in p.history_deletes.collect()} == {4, 11, 14}
    got = {r["issue_id"]: (r["status"], r["used_at"], r["canceled_at"]) for r in p.issue_updates.collect()}
    assert got == {2: ("ISSUED", None, None), 5: ("ISSUED", None, START + 2 * d), 6: ("CANCELED", None, START + d)}
    fixed = recovery.apply_changes(history, "history_id", deletes=p.history_deletes)
    t = Tables(issue=issue, history=fixed)
    assert {r["issue_id"] for r in checks.state_chain(t, Scope.event(1)).collect()} == {3, 4}


def test_sync_times(make):
    issue = make.issue(
        issue_row(1), issue_row(2), issue_row(3, status="USED", used_at=START), issue_row(4), issue_row(5, status="USED"), issue_row(6), issue_row(7))
    history = make.history(
        history_row(1, 1, None, "ISSUED", START + sec(2)), history_row(2, 2, None, "ISSUED", START - sec(2)),
        history_row(3, 3, "ISSUED", "USED", START + sec(1)), history_row(4, 4, "USED", "ISSUED", START + sec(50)),
        history_row(5, 5, "ISSUED", "USED", START + sec(9)), history_row(6, 6, None, "ISSUED", START + sec(1)))
    p = recovery.sync_times(issue, history)
    assert outcome(p.outcomes) == {1: "PATCHED", 2: "PATCHED", 4: "NOT_ELIGIBLE", 5: "PATCHED"}
    got = {r["issue_id"]: (r["issued_at"], r["used_at"]) for r in p.issue_updates.collect()}
    assert got == {1: (START + sec(2), None), 2: (START - sec(2), None), 5: (START, START + sec(9))}


def test_restore_initial_history(make):
    issue = make.issue(
        issue_row(1), issue_row(2), issue_row(3, status="USED"), issue_row(4, used_at=START), issue_row(5, request_id="bad"), issue_row(6, issued_at=None),
        issue_row(7), issue_row(8))
    history = make.history(
        history_row(1, 2, None, "ISSUED", event_uid=uuid_of(2)), history_row(2, 99, None, "ISSUED", event_uid=uuid_of(7)), history_row(3, 8, None, "ISSUED"))
    p = recovery.restore_initial_history(issue, history, NOW)
    assert outcome(p.outcomes) == {
        1: "RESTORED", 2: "ALREADY_RESOLVED", 3: "NOT_VIOLATING", 4: "TOUCHED", 5: "INVALID_SOURCE", 6: "INVALID_SOURCE", 7: "UID_TAKEN", 8: "NOT_VIOLATING"}
    row = p.history_inserts.collect()[0]
    assert (row["issue_id"], row["event_uid"], row["occurred_at"], row["recorded_at"]) == (1, uuid_of(1), START, NOW)


def test_expire_delayed_is_strict_about_skew(make):
    end = datetime(2026, 8, 18, 10, 30)
    issue = make.issue(
        issue_row(1), issue_row(2, created_at=START - sec(1)), issue_row(3, valid_to=NOW - sec(120)), issue_row(4, status="USED", used_at=START),
        issue_row(5, created_at=NOW + sec(1)), issue_row(6, status="EXPIRED"), issue_row(7, status="EXPIRED"))
    history = make.history(history_row(1, 6, "ISSUED", "EXPIRED", end, reason="CONSISTENCY_RECOVERY_EXPIRATION"))
    p = recovery.expire_delayed(issue, history, NOW)
    assert outcome(p.outcomes) == {
        1: "EXPIRED", 2: "INVALID_STRUCTURE", 3: "NOT_DUE", 4: "NOT_VIOLATING", 5: "NOT_CREATED_YET", 6: "ALREADY_RESOLVED", 7: "NOT_VIOLATING"}
    assert p.history_inserts.collect()[0]["occurred_at"] == end


def test_apply_changes_overwrites_with_null(make):
    issue = make.issue(issue_row(1, used_at=START), issue_row(2, used_at=START), issue_row(3))
    update = issue.filter("issue_id = 1").selectExpr("issue_id", "cast(null as timestamp_ntz) used_at", "'ISSUED' status")
    out = recovery.apply_changes(issue, "issue_id", update, issue.filter("issue_id = 3"), make.issue(issue_row(4)))
    assert {r["issue_id"]: r["used_at"] for r in out.collect()} == {1: None, 2: START, 4: None}
    assert out.columns == issue.columns


def test_reverify_needs_every_part(make, spark):
    event = make.event(event_row(1, total_stock=1, remaining_stock=5), event_row(2, total_stock=0), event_row(3, total_stock=1, remaining_stock=0))
    issue = make.issue(issue_row(1), issue_row(2, event_id=2))
    t = Tables(event=event, issue=issue)
    p = recovery.reconcile_stock(event, issue, NOW)
    fixed = t.with_(event=recovery.apply_changes(event, "event_id", p.event_updates))
    outcomes = p.outcomes.selectExpr("event_id as result_id", "event_id", "outcome = 'SUCCESS' as succeeded")
    got = recovery.recovery_status(outcomes, runner.recheck(fixed, "stock", outcomes)).collect()
    assert {r["result_id"]: r["recovery_status"] for r in got} == {1: "RECOVERED", 2: "RECOVERY_FAILED", 3: "RECOVERED"}


def clean(make, spark):
    issues, history = [], []
    for event in (1, 2):
        for n in range(1, 4):
            i = event * 10 + n
            used = START + sec(600 + n)
            kw = dict(event_id=event, issue_sequence=n, created_at=START + sec(n / 1000), valid_to=datetime(2026, 8, 19, 9))
            if n == 2:
                kw.update(status="USED", used_at=used)
            issues.append(issue_row(i, **kw))
            history.append(history_row(i * 10 + 1, i, None, "ISSUED"))
            if n == 2:
                history.append(history_row(i * 10 + 2, i, "ISSUED", "USED", used))
    return Tables(
        issue=make.issue(*issues), history=make.history(*history),
        event=make.event(*[event_row(e, total_stock=3, remaining_stock=0, issued_quantity=3, status="CLOSED") for e in (1, 2)]),
        state=spark.createDataFrame([(e, 3, 0, 3, 0) for e in (1, 2)],
                                    "event_id long, total_stock long, remaining_stock long, confirmed_quantity long, pending long"))


def test_each_planted_fault_is_found(make, spark):
    t = clean(make, spark)
    events = spark.createDataFrame([(1,)], "event_id long")
    params = {"expiration_lag": {"checked_at": CHECKED}}
    planted = {"none": t, **{name: plant(t, CHECKED - timedelta(minutes=10), events) for name, plant in faults.PLANTERS.items()}}
    for name, tables in planted.items():
        results, _ = runner.run_checks(spark, tables, Scope.event(1), CHECKED, params=params)
        found = {r["check_name"] for r in results.collect() if r["status"] == "FAIL"}
        if name == "expiration_lag":
            # An end in the past is before the start, which the structure rule reports as well.
            assert found == {"expiration_lag", "issue_structure"}, name
        elif name == "history_structure":
            # A latest row with an unknown status also differs from the issue.
            assert found == {"history_structure", "issue_history_state"}, name
        elif name == "state_chain":
            # The repeated use is written at planting time, so its time differs from the issue's.
            assert found == {"state_chain", "time_sync"}, name
        else:
            assert found == ({name} if name != "none" else set()), name
    other, _ = runner.run_checks(spark, planted["stock"], Scope.event(2), CHECKED, ["stock"])
    assert other.collect()[0]["status"] == "PASS"


def test_unknown_targets_are_outcomes(make, spark):
    event, issue, history = make.event(event_row(1)), make.issue(issue_row(1)), make.history(history_row(1, 1, None, "ISSUED"))
    events, issues = spark.createDataFrame([(1,), (404,)], "event_id long"), spark.createDataFrame([(1,), (404,)], "issue_id long")
    for p in (recovery.reconcile_stock(event, issue, NOW, events), recovery.revoke_excess(event, issue, NOW, events), recovery.sync_times(issue, history, events)):
        assert outcome(p.outcomes, "event_id")[404] == "NOT_FOUND"
    for p in (recovery.restore_chain(issue, history, issues), recovery.restore_initial_history(issue, history, NOW, issues), recovery.expire_delayed(issue, history, NOW, issues)):
        assert outcome(p.outcomes)[404] == "NOT_FOUND"


def test_coupons_without_a_sequence_are_revoked_last(make):
    event = make.event(event_row(1, total_stock=1))
    issue = make.issue(*[issue_row(i, issue_sequence=None) for i in range(1, 4)], issue_row(9, issue_sequence=7))
    ranks = {r["issue_id"]: r["excess_rank"] for r in recovery.excess_issues(event, issue).collect()}
    assert ranks == {9: 1, 3: 2, 2: 3}
