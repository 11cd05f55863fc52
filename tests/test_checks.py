from datetime import datetime, timedelta

import pytest
from conftest import CHECKED, START, event_row, history_row, issue_row, kinds, sec, uuid_of

from tallyroll.operators import checks
from tallyroll.plans.runner import CHECKS, catalog, register_check, run_and_store, run_checks, select_checks, stored_results, stored_runs, stored_violations
from tallyroll.plans.scope import Scope, all_cutoff, next_range
from tallyroll.sources.ledger import Tables

V3 = "3b5d5c37-12f8-3c4e-9d5a-6d2a6f0c7e11"


def test_issue_structure_boundaries(make):
    rows = {
        1: {}, 2: dict(status=None), 3: dict(issued_at=START, created_at=START - sec(5)),
        4: dict(created_at=START - sec(5) - timedelta(microseconds=1)), 5: dict(created_at=START - sec(4)),
        6: dict(message_id="1:1755000000000-0"), 7: dict(message_id=""), 8: dict(message_id=" "), 9: dict(message_id=V3),
        10: dict(request_id="x" * 36), 11: dict(status="CANCELED"), 12: dict(status="CANCELED", canceled_at=START),
        13: dict(user_id=None, issue_sequence=0), 14: dict(issue_sequence=0), 15: dict(used_at=START), 16: dict(status="USED"),
        17: dict(status="USED", used_at=START - sec(1)), 18: dict(status="USED", used_at=START), 19: dict(valid_to=START),
        20: dict(issued_at=None), 21: dict(request_id=None), 22: dict(issued_at=START + sec(1)), 23: dict(status="WRONG"),
    }
    t = Tables(issue=make.issue(*[issue_row(i, **c) for i, c in rows.items()]))
    found = kinds(checks.issue_structure(t, Scope.event(1)), "issue_id")
    assert found == {
        2: "INVALID_STATUS", 4: "INVALID_TIMESTAMP_ORDER", 6: "INVALID_MESSAGE_ID_FORMAT", 7: "INVALID_MESSAGE_ID_FORMAT",
        8: "INVALID_MESSAGE_ID_FORMAT", 10: "INVALID_REQUEST_ID", 11: "MISSING_CANCELED_AT", 13: "MISSING_USER_ID",
        14: "INVALID_ISSUE_SEQUENCE", 15: "INVALID_STATUS_FIELDS", 16: "INVALID_STATUS_FIELDS", 17: "INVALID_STATUS_FIELDS",
        19: "INVALID_TIMESTAMP_ORDER", 20: "MISSING_TIMESTAMP", 21: "INVALID_REQUEST_ID", 22: "INVALID_TIMESTAMP_ORDER", 23: "INVALID_STATUS"}


def test_issue_structure_all_scope_cuts_off(make, spark):
    t = Tables(issue=make.issue(
        issue_row(1, status="X"), issue_row(2, status="X", created_at=CHECKED), issue_row(3, status="X", event_id=2)))
    only = spark.createDataFrame([(1,)], "event_id long")
    assert set(kinds(checks.issue_structure(t, Scope.all(CHECKED, only)), "issue_id")) == {1}
    assert set(kinds(checks.issue_structure(t, Scope.all(CHECKED)), "issue_id")) == {1, 2, 3}


def test_history_structure_boundaries(make):
    rows = [
        history_row(1, 1, None, "ISSUED"), history_row(2, 1, "ISSUED", None), history_row(3, 1, "ISSUED", "USED", START, recorded_at=START - sec(5)),
        history_row(4, 1, "ISSUED", "USED", START, recorded_at=START - sec(6)), history_row(5, 1, "ISSUED", "NOPE"),
        history_row(6, 1, None, "USED"), history_row(7, 1, "USED", "ISSUED"), history_row(8, 1, "ISSUED", "CANCELED"),
        history_row(9, 1, "USED", "EXPIRED"), history_row(10, 1, "EXPIRED", "ISSUED"), history_row(11, 1, "ISSUED", "USED", recorded_at=None)]
    t = Tables(issue=make.issue(issue_row(1)), history=make.history(*rows))
    expected = {
        2: "MISSING_TO_STATUS", 4: "INVALID_TIMESTAMP_ORDER", 5: "INVALID_TO_STATUS", 6: "INVALID_INITIAL_TRANSITION",
        9: "INVALID_STATUS_TRANSITION", 10: "INVALID_STATUS_TRANSITION", 11: "MISSING_TIMESTAMP"}
    assert kinds(checks.history_structure(t, Scope.event(1)), "history_id") == expected
    assert kinds(checks.history_structure(t, Scope.event(2)), "history_id") == {}


def test_history_structure_range_edges(make):
    a, b = datetime(2026, 8, 1), datetime(2026, 8, 2)
    bad = lambda i, at: history_row(i, 1, "ISSUED", None, recorded_at=at)
    t = Tables(issue=make.issue(issue_row(1)), history=make.history(bad(1, a), bad(2, a - sec(1)), bad(3, b), bad(4, None)))
    assert set(kinds(checks.history_structure(t, Scope.range(a, b)), "history_id")) == {1, 4}


def test_state_chain(make, spark):
    day = timedelta(days=1)
    h = [
        history_row(1, 1, None, "ISSUED"), history_row(2, 1, "ISSUED", "USED", START + day), history_row(3, 1, "USED", "ISSUED", START + 40 * day),
        history_row(4, 1, "ISSUED", "USED", START + 41 * day),
        history_row(5, 2, None, "ISSUED"), history_row(6, 2, "ISSUED", "USED", START + sec(1)), history_row(7, 2, "ISSUED", "USED", START + 3 * day),
        history_row(8, 3, "ISSUED", "USED"), history_row(9, 4, None, "ISSUED"), history_row(10, 4, "ISSUED", "USED"),
        history_row(11, 5, None, "ISSUED"), history_row(12, 5, "ISSUED", "USED", None), history_row(13, 6, None, "ISSUED"),
        history_row(14, 6, None, "ISSUED", START + day), history_row(15, 7, None, None)]
    t = Tables(issue=make.issue(*[issue_row(i) for i in range(1, 8)]), history=make.history(*h))
    # Issue 5: the row without a time comes first, so both of its rows are broken.
    expected = {7: 2, 8: 3, 11: 5, 12: 5, 14: 6, 15: 7}
    for scope in (Scope.event(1), Scope.range(START, CHECKED), Scope.all(CHECKED, spark.createDataFrame([(1,)], "event_id long"))):
        got = {r["history_id"]: r["issue_id"] for r in checks.state_chain(t, scope).collect()}
        assert got == expected, scope.kind
    assert checks.state_chain(t, Scope.all(CHECKED)).isEmpty()


def test_chain_is_the_same_for_every_segment_width(make, spark, monkeypatch):
    import random

    from tallyroll.operators import chains
    from tallyroll.plans import segments

    rng = random.Random(5)
    states = [None, "ISSUED", "USED", "EXPIRED"]
    rows = []
    for n in range(400):
        at = None if rng.random() < 0.1 else START + sec(rng.randrange(0, 500_000))
        rows.append(history_row(n, rng.choice([1, 1, 1, 2, 3]), rng.choice(states), rng.choice(states), at))
    history = make.history(*rows)
    want = set()
    for issue in (1, 2, 3):
        mine = sorted((r for r in rows if r["issue_id"] == issue), key=lambda r: (r["occurred_at"] or datetime.min, r["history_id"]))
        for i, r in enumerate(mine):
            ok = (r["from_status"] is None and r["to_status"] == "ISSUED") if i == 0 else r["from_status"] == mine[i - 1]["to_status"]
            if not ok:
                want.add(r["history_id"])
    for width in (60, 86_400, 10_000_000):
        monkeypatch.setattr(chains, "time_segment", lambda at, tie, w=width: segments.time_segment(at, tie, w))
        assert {r["history_id"] for r in chains.chain_breaks(history).collect()} == want


def test_issue_history_state(make):
    t = Tables(
        issue=make.issue(issue_row(1), issue_row(2, status="USED"), issue_row(3), issue_row(4, status=None), issue_row(5)),
        history=make.history(
            history_row(1, 1, None, "ISSUED"), history_row(2, 2, None, "ISSUED"), history_row(3, 4, None, "ISSUED"), history_row(4, 5, None, None)))
    assert kinds(checks.issue_history_state(t, Scope.event(1)), "issue_id") == {
        2: "LATEST_STATUS_MISMATCH", 3: "NO_HISTORY", 4: "LATEST_STATUS_MISMATCH", 5: "LATEST_STATUS_MISMATCH"}


def test_time_sync(make):
    end = datetime(2026, 8, 18, 10, 30)
    used = START + sec(600)
    t = Tables(
        issue=make.issue(
            issue_row(1, status="USED", used_at=used), issue_row(2, status="USED", used_at=used), issue_row(3), issue_row(4),
            issue_row(5, status="EXPIRED"), issue_row(6, status="EXPIRED"), issue_row(7, status="EXPIRED"), issue_row(8, status="EXPIRED"),
            issue_row(9, status="USED"), issue_row(10)),
        history=make.history(
            history_row(1, 1, "ISSUED", "USED", used + sec(1)), history_row(2, 2, "ISSUED", "USED", used + sec(1) + timedelta(microseconds=1)),
            history_row(3, 3, None, "ISSUED", START + sec(2)), history_row(4, 4, "USED", "ISSUED", START + sec(900)),
            history_row(5, 5, "ISSUED", "EXPIRED", end - sec(10), reason="MANUAL_EXPIRED"), history_row(6, 6, "ISSUED", "EXPIRED", end - sec(1)),
            history_row(7, 7, "ISSUED", "EXPIRED", end + sec(1800) + timedelta(microseconds=900_000)),
            history_row(8, 8, "ISSUED", "EXPIRED", end + sec(1801)), history_row(9, 9, "ISSUED", "USED")))
    assert set(kinds(checks.time_sync(t, Scope.event(1)), "issue_id")) == {2, 3, 6, 8, 9}


def test_expiration_lag(make, spark):
    end = datetime(2026, 8, 18, 10, 30)
    t = Tables(issue=make.issue(
        issue_row(1), issue_row(2, valid_to=CHECKED - sec(120)), issue_row(3, valid_to=CHECKED - sec(121)),
        issue_row(4, status="USED", used_at=end + sec(1)), issue_row(5, status="USED", used_at=CHECKED + sec(1)), issue_row(6, created_at=CHECKED + sec(1)),
        issue_row(7, created_at=CHECKED)))
    got = kinds(checks.expiration_lag(t, Scope.event(1), checked_at=CHECKED), "issue_id")
    assert got == {1: "EXPIRATION_BATCH_DELAY", 3: "EXPIRATION_BATCH_DELAY", 4: "USED_AFTER_EXPIRATION", 7: "EXPIRATION_BATCH_DELAY"}
    some = spark.createDataFrame([(1,)], "event_id long")
    assert 7 not in kinds(checks.expiration_lag(t, Scope.all(CHECKED, some)), "issue_id")
    ranged = kinds(checks.expiration_lag(t, Scope.range(end, CHECKED - sec(121)), checked_at=CHECKED), "issue_id")
    assert set(ranged) == {1, 4, 7}


def test_stock_and_loss(make, spark):
    t = Tables(
        event=make.event(
            event_row(1, status="CLOSED", total_stock=2, remaining_stock=0, issued_quantity=2), event_row(2, status="OPEN", total_stock=5, remaining_stock=9),
            event_row(3, status="SOLD_OUT", total_stock=5, remaining_stock=4), event_row(4, status="CLOSED", total_stock=3, remaining_stock=3)),
        issue=make.issue(issue_row(1), issue_row(2, status="EXPIRED"), issue_row(3, status="CANCELED"), issue_row(4, event_id=2, issue_sequence=None)),
        state=spark.createDataFrame(
            [(1, 0, 0), (2, 5, 1), (3, 4, 0)], "event_id long, remaining_stock long, pending long"))
    every = Scope.all(CHECKED)
    assert {r["event_id"] for r in checks.stock(t, every).collect()} == {3}
    assert {r["event_id"] for r in checks.stock(t, Scope.event(2)).collect()} == {2}
    outcome = {r["event_id"]: (r["outcome"], r["lost_count"]) for r in checks.loss_outcomes(t, every).collect()}
    assert outcome == {1: ("FAIL", -1), 2: ("POSTPONED", 0), 3: ("FAIL", 1), 4: ("PASS", 0)}


def test_run_checks_isolates_failures(make, spark, tmp_path):
    t = Tables(
        event=make.event(event_row(1, total_stock=1, remaining_stock=0, issued_quantity=1)), issue=make.issue(issue_row(1, status="WRONG")),
        history=make.history(history_row(1, 1, None, "ISSUED")), state=spark.createDataFrame([], "event_id long, remaining_stock long, pending long"))

    def broken(tables, scope):
        raise RuntimeError("boom")

    register_check("broken_for_test", "x", "EVENT", "event_id", ("EVENT",), broken)
    try:
        names = ["stock", "state_chain", "issue_structure", "loss", "broken_for_test"]
        results, _ = run_checks(spark, t, Scope.event(1), CHECKED, names)
        got = {r["check_name"]: (r["status"], r["violation_count"], r["error_message"]) for r in results.collect()}
        assert got["state_chain"] == ("PASS", 0, None) and got["issue_structure"] == ("FAIL", 1, None)
        assert got["stock"][0] == "FAIL" and got["loss"] == ("ERROR", 0, "IMPOSSIBLE") and got["broken_for_test"] == ("ERROR", 0, "boom")
        stored, violations = run_and_store(spark, t, Scope.event(1), CHECKED, str(tmp_path), names, run_id="r1")
        assert {r["check_name"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/results").collect()} == {k: v[0] for k, v in got.items()}
        assert violations.filter("check_name = 'issue_structure'").count() == 1
        # A repeated run replaces itself, with the same ids; one that ends early is not seen.
        first = {(r["check_name"], r["result_id"]) for r in stored_results(spark, str(tmp_path)).collect()}
        ticks = iter(range(1000))
        run_and_store(spark, t, Scope.event(1), CHECKED, str(tmp_path), names, run_id="r1", clock=lambda: next(ticks))
        again = stored_results(spark, str(tmp_path)).collect()
        assert {(r["check_name"], r["result_id"]) for r in again} == first and len(again) == 5
        assert {r["check_name"]: r["duration_millis"] for r in again} == {"stock": 1000, "state_chain": 1000, "issue_structure": 1000, "loss": 1000, "broken_for_test": 0}
        assert {r["result_id"] for r in stored_violations(spark, str(tmp_path)).collect()} <= {i for _, i in first}

        def ends(*_, **__):
            raise KeyboardInterrupt

        with pytest.raises(KeyboardInterrupt):
            run_and_store(spark, t, Scope.event(1), CHECKED, str(tmp_path), names, run_id="r2", clock=ends)
        assert {r["run_id"] for r in stored_results(spark, str(tmp_path)).collect()} == {"r1"}
        assert stored_runs(spark, f"{tmp_path}/none").count() == 0
        with pytest.raises(ValueError):
            run_checks(spark, t, Scope.event(99), CHECKED, names)
        with pytest.raises(ValueError):
            register_check("broken_for_test", "x", "EVENT", "event_id", ("EVENT",), broken)
    finally:
        CHECKS.pop("broken_for_test")


def test_select_checks_and_catalog(spark):
    assert [c.name for c in select_checks(None, "AS_OF_RANGE")] == ["state_chain", "history_structure", "time_sync", "expiration_lag"]
    for names, scope in ((["stock", "stock"], "ALL"), (["nope"], "ALL"), (["loss"], "ALL")):
        with pytest.raises(ValueError):
            select_checks(names, scope)
    assert catalog(spark, "EVENT").count() == 8


def test_watermark(spark):
    now = datetime(2026, 8, 18, 12)
    rows = [
        ("a", "AS_OF_RANGE", "PASS", datetime(2026, 8, 18, 11)), ("a", "AS_OF_RANGE", "ERROR", datetime(2026, 8, 18, 11, 30)),
        ("a", "EVENT", "PASS", datetime(2026, 8, 18, 11, 50)), ("b", "ALL", "PASS", datetime(2026, 8, 18, 11)), ("c", "AS_OF_RANGE", "FAIL", now)]
    df = spark.createDataFrame(rows, "check_name string, scope_type string, status string, scope_to timestamp_ntz")
    got = {r["check_name"]: (r["scope_from"], r["scope_to"], r["skip"]) for r in next_range(df, now).collect()}
    end = now - sec(10)
    assert got == {"a": (datetime(2026, 8, 18, 11), end, False), "b": (end - timedelta(hours=24), end, False), "c": (now, end, True)}
    assert all_cutoff(now) == end
    with pytest.raises(ValueError):
        Scope.range(now, now)


def test_uniqueness(make):
    issue = make.issue(
        issue_row(1, user_id=5, issue_sequence=1), issue_row(2, user_id=5, issue_sequence=2), issue_row(3, user_id=None, issue_sequence=4),
        issue_row(4, user_id=None, issue_sequence=4, request_id=uuid_of(3)))
    assert [r["user_id"] for r in checks.duplicate_users(issue).collect()] == [5]
    assert [r["issue_sequence"] for r in checks.duplicate_keys(issue, ["event_id", "issue_sequence"]).collect()] == [4]
    assert [r["issue_sequence"] for r in checks.sequence_gaps(issue).collect()] == [4]
    assert checks.sequence_density(issue).collect()[0]["dense"] is True


def test_exact_quantiles(spark):
    import random

    from tallyroll.operators.reports import exact_quantiles

    draw = random.Random(4)
    values = {k: [draw.randrange(-3000, 3000) // 7 for _ in range(n)] for k, n in ((1, 1), (2, 2), (3, 501))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k long, v long")
    got = {r["k"]: (r["a"], r["b"]) for r in exact_quantiles(df, "k", "v", {"a": 0.5, "b": 0.99}, width=50).collect()}
    for k, vs in values.items():
        vs = sorted(vs)
        for p, found in zip((0.5, 0.99), got[k]):
            at = p * (len(vs) - 1)
            low = int(at)
            want = vs[low] + (vs[min(low + 1, len(vs) - 1)] - vs[low]) * (at - low)
            assert abs(found - want) < 1e-6
