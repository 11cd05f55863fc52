"""Chain audits that go on from stored heads, against an audit of everything row by row."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import START, history_row, issue_row, sec

from tallyroll.operators import chains, checks
from tallyroll.sources.ledger import read_history
from tallyroll.sources.sinks import write_history_by_month

SINCE = START + timedelta(days=40)


def ordered(rows):
    return sorted(rows, key=lambda r: (r["occurred_at"] or datetime.min, r["history_id"]))


def expected(rows):
    """history_id of breaks at new rows and of all breaks of issues with a new row before an old one; the last row of each issue."""
    found, last = set(), {}
    for issue in {r["issue_id"] for r in rows}:
        mine = ordered([r for r in rows if r["issue_id"] == issue])
        fresh = [r["recorded_at"] is None or r["recorded_at"] >= SINCE for r in mine]
        behind = any(fresh[i] and not all(fresh[i:]) for i in range(len(mine)))
        for i, r in enumerate(mine):
            good = r["from_status"] == mine[i - 1]["to_status"] if i else (r["from_status"], r["to_status"]) == (None, "ISSUED")
            if not good and (fresh[i] or behind):
                found.add(r["history_id"])
        last[issue] = (mine[-1]["history_id"], mine[-1]["occurred_at"], mine[-1]["to_status"])
    return found, last


def ledger(seed):
    """A third of all rows belongs to issue 1; some times are missing, some rows arrive late."""
    draw = random.Random(seed)
    rows = []
    for n in range(600):
        at = None if draw.random() < 0.02 else START + sec(draw.randrange(80 * 86_400))
        seen = None if draw.random() < 0.03 else (at or START) + timedelta(days=draw.choice([0, 0, 0, 0, 0, 0, 45]))
        issue = 1 if draw.random() < 0.33 else draw.randrange(2, 150)
        rows.append(history_row(n, issue, draw.choice([None, "ISSUED", "USED"]), draw.choice(["ISSUED", "ISSUED", "USED", None]), at, recorded_at=seen))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_an_audit_of_everything(make, spark, tmp_path, seed):
    rows = ledger(seed)
    write_history_by_month(make.history(*rows), f"{tmp_path}/rows")
    new, old = read_history(spark, f"{tmp_path}/rows", since=SINCE), read_history(spark, f"{tmp_path}/rows", before=SINCE)
    assert new.count() + old.count() == len(rows)
    heads = chains.chain_heads(old)
    want, last = expected(rows)
    issue = make.issue(*[issue_row(i) for i in range(1, 150)])
    found = checks.state_chain_since(issue, heads, new, old).collect()
    assert {r["history_id"] for r in found} == want and len(found) == len(want)
    moved = {r["issue_id"]: (r["history_id"], r["occurred_at"], r["to_status"]) for r in chains.moved_heads(heads, new).collect()}
    assert moved == last


def test_nothing_new_and_nothing_old(make, spark):
    rows = make.history(*[history_row(n, n % 5, None, "USED") for n in range(20)])
    none = rows.limit(0)
    heads = chains.chain_heads(rows)
    assert chains.continued_breaks(heads, none, rows).isEmpty()
    whole = {r["history_id"] for r in chains.chain_breaks(rows).collect()}
    assert {r["history_id"] for r in chains.continued_breaks(chains.chain_heads(none), rows, none).collect()} == whole


def test_an_unbroken_ledger_reads_new_months_only(make, spark, tmp_path):
    # Ten issues, each with one row in every month of a year; issue 3 gets a row that was held back.
    rows, status = [], ["ISSUED", "USED"]
    for m in range(12):
        for i in range(10):
            at = datetime(2026, 1 + m, 3)
            rows.append(history_row(m * 10 + i, i, status[(m + 1) % 2] if m else None, status[m % 2], at))
    rows.append(history_row(999, 3, "USED", "USED", datetime(2026, 2, 20), recorded_at=datetime(2026, 12, 9)))
    write_history_by_month(make.history(*rows), f"{tmp_path}/rows")
    since = datetime(2026, 12, 1)
    new, old = read_history(spark, f"{tmp_path}/rows", since=since), read_history(spark, f"{tmp_path}/rows", before=since)
    assert {f.rsplit("recorded_in=")[1][:7] for f in new.inputFiles()} == {f"2026-{m:02}" for m in range(1, 13)}
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(recorded_in" in plan and "PushedFilters: [Or(IsNull(recorded_at)" in plan
    opened = {r[0].rsplit("recorded_in=")[1][:7] for r in new.selectExpr("input_file_name()").distinct().collect()}
    assert opened == {"2026-12"}
    heads = chains.chain_heads(old)
    assert chains.continued_breaks(heads, new, old).isEmpty()
    again = chains.matching(old, spark.createDataFrame([(3,)], "issue_id long"), ["issue_id"])
    assert again.count() == 11
