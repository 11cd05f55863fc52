import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyroll import schemas  # noqa: E402
from tallyroll.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


CHECKED = datetime(2026, 8, 18, 12)
START = datetime(2026, 8, 18, 9)


def sec(n):
    return timedelta(seconds=n)


def uuid_of(n):
    return f"00000000-0000-0000-0000-{n:012d}"


def issue_row(issue_id, **change):
    row = dict(
        issue_id=issue_id, event_id=1, user_id=issue_id, issue_sequence=issue_id, request_id=uuid_of(issue_id), message_id=None,
        status="ISSUED", issued_at=START, valid_from=START, valid_to=datetime(2026, 8, 18, 10, 30), used_at=None, canceled_at=None,
        created_at=START)
    row.update(change)
    return row


def history_row(history_id, issue_id, from_status, to_status, occurred_at=START, **change):
    row = dict(
        history_id=history_id, issue_id=issue_id, from_status=from_status, to_status=to_status, actor="SYSTEM", reason=None,
        occurred_at=occurred_at, recorded_at=occurred_at, event_uid=f"uid-{history_id}")
    row.update(change)
    return row


def event_row(event_id, **change):
    row = dict(
        event_id=event_id, coupon_id=1, round=event_id, open_at=datetime(2026, 8, 1), close_at=datetime(2026, 9, 1), total_stock=10,
        remaining_stock=10, issued_quantity=0, per_user_limit=1, status="OPEN", created_at=datetime(2026, 7, 1), updated_at=datetime(2026, 7, 1))
    row.update(change)
    return row


def frame(spark, schema, rows):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@pytest.fixture
def make(spark):
    class Make:
        @staticmethod
        def issue(*rows):
            return frame(spark, schemas.ISSUE, rows)

        @staticmethod
        def history(*rows):
            return frame(spark, schemas.HISTORY, rows)

        @staticmethod
        def event(*rows):
            return frame(spark, schemas.EVENT, rows)

        @staticmethod
        def rows(schema, *rows):
            return spark.createDataFrame(list(rows), schema)

    return Make


def kinds(df, key):
    return {r[key]: r["violation_type"] for r in df.select(key, "violation_type").collect()}
