"""What the storing stream leaves on disk, and the forms that keep it small."""

import time
from pathlib import Path

from conftest import START, event_row, issue_row, uuid_of

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroll import schemas
from tallyroll.functions.ids import packed, unpacked
from tallyroll.plans.staging import kept
from tallyroll.streaming import ingest
from tallyroll.streaming.state import KeyedState

MS = 1755000000000


def entry(n, ms, **change):
    row = dict(
        entry_id=f"{ms}-0", type="ISSUE", requestId=uuid_of(n), campaignId="1", userId=str(n), bitmapSegmentId="0", bitOffset=str(n - 1),
        issueSequence=str(n), decidedAt=str(ms))
    row.update(change)
    return tuple(row.values())


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")
    return {f for f in files.split("|") if "shuffle_" in f}


def test_packed_text_comes_back_and_differs(spark):
    full = "0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9"
    texts = [full, f"r:{full}", f"2:{full}", full.upper(), f"{full}\n", f"rr:{full}", full[:-1], "", "é", "\x01abcdefghijklmnop", "0:1:7", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("b", packed(F.col("t")))
    rows = df.select("t", "b", unpacked(F.col("b")).alias("back")).collect()
    assert [r["t"] for r in rows] == [r["back"] for r in rows]
    assert len({r["b"] if r["b"] is None else bytes(r["b"]) for r in rows}) == len(texts) and len(rows[0]["b"]) == 17 and len(rows[1]["b"]) == 18


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    before = shuffle_files(spark)
    kept(spark.range(20000).groupBy(F.col("id") % 7).count())
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before


def test_a_micro_batch_leaves_no_unpacked_rows(spark, make, tmp_path):
    """Neither checkpoints nor a cached copy of the raw entries, and the same rows as ever."""
    spark.range(1).checkpoint()
    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {f for f in top.rglob("*") if f.is_file()}
    event, coupon = make.event(event_row(1)), make.rows(schemas.COUPON, (1, "c", "FIXED", 100, 24, START))
    # 3 asks for a stored user, 4 for the sequence of 5, 6 for one that 3 would have had; one entry has no id.
    rows = [entry(2, MS), entry(3, MS + 1, userId="1"), entry(5, MS + 2), entry(4, MS + 3, issueSequence="5"), entry(6, MS + 4, issueSequence="3"), entry(1, MS + 5),
            entry(7, MS + 6, userId="6", entry_id=None)]
    for part in (rows, rows, rows):
        spark.createDataFrame(part, schemas.STREAM_ENTRY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schemas.STREAM_ENTRY).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    records = spark.createDataFrame([(1, uuid_of(n), n, 0, 0, 0, START) for n in range(1, 7)], ingest.RECORD)
    ingest.persist_query(
        stream, f"{tmp_path}/out", event, coupon, START, issue=make.issue(issue_row(1)), records=records, buckets=2, merge_every=2).awaitTermination()
    assert {f for f in top.rglob("*") if f.is_file()} == before
    got = {(r["request_id"], r["batch"]): (r["outcome"], r["attempts"], r["action"]) for r in ingest.outcomes(spark, f"{tmp_path}/out").collect()}
    for batch, action in enumerate(("RETRY", "RETRY", "COMPENSATE_AND_ACK")):
        assert {n: got[uuid_of(n), batch] for n in (3, 4)} == {n: ("CONFLICT", batch + 1, action) for n in (3, 4)}
        assert got[uuid_of(1), batch][0] == "ABSORBED" and got[uuid_of(2), batch][0] == got[uuid_of(5), batch][0] == ("ABSORBED" if batch else "INSERT")
    # The entry without an id is first in the stream's order and takes user 6.
    assert got[uuid_of(7), 0][0] == "INSERT" and got[uuid_of(6), 0] == ("CONFLICT", 1, "RETRY")
    assert {r["request_id"] for r in spark.read.parquet(f"{tmp_path}/out/issue").collect()} == {uuid_of(n) for n in (2, 5, 7)}
    assert {r["event_uid"] for r in spark.read.parquet(f"{tmp_path}/out/history").collect()} == {uuid_of(n) for n in (2, 5, 7)}
    state = ingest.StoreState.below(spark, f"{tmp_path}/out", 2, 2)
    # Request 3's record is user 3's, who didn't ask.
    assert {r["user_id"]: (r["code"], r["lifecycle"]) for r in state.records.all(3).collect()} == {
        1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (8, 2), 5: (0, 1), 6: (8, 2)}
    assert [(r["confirmed"], r["returned"]) for r in state.counters.all(3).collect()] == [(3, 2)]


def test_state_asked_for_many_keys_or_few(spark, tmp_path, monkeypatch):
    from tallyroll.streaming import state as module

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())])
    rows = lambda *values: spark.createDataFrame(list(values), schema)
    state = KeyedState(spark, f"{tmp_path}/s", schema, ("a", "b"), buckets=2, merge_every=3)
    state.start(rows((1, None, 1), (1, "x", 2), (None, "x", 3), (2, uuid_of(1), 4)))
    state.update(rows((1, None, 10), (3, "y", 5)), 0)
    asked = rows((1, None, 0), (2, uuid_of(1), 0), (1, None, 0), (9, "z", 0))
    want = {(1, None, 10), (2, uuid_of(1), 4)}
    for batch in range(1, 5):
        state.merge(batch)
        assert {tuple(r) for r in state.near(asked, batch).collect()} == want
        state.update(rows((1, "x", 20 + batch)), batch)
    back = state.near(asked, 5, "b").withColumn("b", unpacked(F.col("b")))
    assert {tuple(r) for r in back.collect()} == want
    # Where many are asked for, others of their buckets come too, each once and in its newest form.
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    found = [tuple(r) for r in state.near(asked, 5).collect()]
    assert want <= set(found) <= want | {(1, "x", 24), (None, "x", 3), (3, "y", 5)} and len(found) == len(set(found))
