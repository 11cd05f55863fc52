from datetime import datetime

from conftest import START, frame, issue_row

from tallyroll import schemas
from tallyroll.operators import failures, reports

NOW = datetime(2026, 8, 19)


def row(i, stage, result, **change):
    base = dict(
        failure_id=i, event_id=i % 3, user_id=i, request_id=f"r{i}", issue_sequence=None, failure_stage=stage, compensation_result=result,
        error_message=None, incident_id=None, occurred_at=START, last_attempt_at=None, attempt_count=0, resolved_at=None, resolved_by=None,
        resolve_reason=None, resolve_probe_result=None)
    base.update(change)
    return base


def test_triage_and_missing_results(spark):
    df = frame(spark, schemas.FAILURE, [
        row(1, "RELAY", "COMPENSATED"), row(2, "DB_INSERT", "SKIPPED_PERSISTED"), row(3, "CONFIRM", "SKIPPED_PERSISTED"), row(4, "CONFIRM", "REQUEST_NOT_FOUND"),
        row(5, "RELAY", None), row(6, "RELAY", "NOT_COMPENSABLE", attempt_count=1), row(7, "CONFIRM", "CALL_FAILED", resolved_at=START),
        row(8, "CONFIRM", "COMPENSATED")])
    got = {r["failure_id"]: (r["status"], r["actions"]) for r in failures.with_actions(failures.with_status(df)).collect()}
    assert got == {
        1: ("SETTLED", ""), 2: ("RETRYABLE", "RETRY"), 3: ("UNRECOVERABLE", "RETRY"), 4: ("UNRECOVERABLE", "RETRY"), 5: ("UNRECOVERABLE", "RETRY"),
        6: ("UNRECOVERABLE", "RETRY,RESOLVE"), 7: ("SETTLED", ""), 8: ("UNRECOVERABLE", "RETRY")}
    summary = {r["stage_group"]: (r["settled"], r["retryable"], r["unrecoverable"]) for r in failures.failure_summary(df).collect()}
    assert summary == {"PERSIST": (1, 1, 2), "CONFIRM": (1, 0, 3)}
    # The sweeps leave rows without a result out; the summary does not.
    assert failures.sweep_unrecoverable(df, "PERSIST").collect()[0]["unrecoverable"] == 1
    assert {r["event_id"] for r in failures.blocked_events(df).collect()} == {0, 1, 2}
    assert {r["event_id"] for r in failures.blocked_events(df.filter("failure_id = 5")).collect()} == set()


def test_append_masks_and_cuts_on_request_only(spark):
    df = frame(spark, schemas.FAILURE, [row(1, "RELAY", None, error_message="tester@test.com " + "x" * 3000)])
    out = failures.new_failures(df).collect()[0]
    assert out["error_message"].startswith("tes****@test.com") and out["error_message"].endswith("x" * 3000)
    assert len(failures.new_failures(df, max_chars=2000).collect()[0]["error_message"]) == 2000
    assert out["occurred_at"] == datetime(2026, 8, 18, 18)


def test_issuance_log_prefers_stored_rows(spark, make):
    issue = make.issue(issue_row(1, status="USED"), issue_row(3))
    pending = spark.createDataFrame(
        [(1, 1, 1, START), (1, 2, 2, START), (1, 4, 4, START), (2, 9, 5, START)], "event_id long, user_id long, issue_sequence long, decided_at timestamp_ntz")
    user = make.rows(schemas.USER, (1, "tester@test.com", "Tester", "010-1234-5678", START))
    got = reports.issuance_log(pending, issue, user, 1, 0, 3).orderBy("issue_sequence").collect()
    assert [(r["issue_sequence"], r["status"], r["is_extra"]) for r in got] == [
        (1, "USED", False), (2, "PROCESSING", False), (3, "ISSUED", False), (4, "PROCESSING", True)]
    assert (got[0]["name"], got[0]["email"], got[0]["phone"]) == ("T****r", "tes****@test.com", "010-****-5678")
    assert got[1]["persisted_at"] is None
