import random
from datetime import datetime, timedelta

from conftest import START, event_row, issue_row, uuid_of

from pyspark.sql import types as T

from tallyroll import schemas
from tallyroll.operators import persistence
from tallyroll.sources.stream import read_issue_stream
from tallyroll.streaming import ingest
from tallyroll.streaming.state import KeyedState

ENTRY = ("request_id string, event_id long, user_id long, issue_sequence long, message_id string, arrival_no long, decided_at timestamp_ntz")
NOW = datetime(2026, 8, 18, 13)
KEYS = (("event_id", "user_id"), ("event_id", "issue_sequence"), ("message_id",))


def one_by_one(entries, stored):
    """Insert entries in order into plain sets of taken keys."""
    by_request = {s["request_id"]: (s["event_id"], s["user_id"], s["issue_sequence"]) for s in stored}
    taken = {(k, *[s[c] for c in k]) for s in stored for k in KEYS if all(s[c] is not None for c in k)}
    out, failed = {}, set()
    first_seen = {}
    for e in sorted(entries, key=lambda e: e["arrival_no"]):
        me = (e["event_id"], e["user_id"], e["issue_sequence"])
        rid = e["request_id"]
        if rid in by_request:
            out[e["arrival_no"]] = "ABSORBED" if by_request[rid] == me else "CONFLICT"
            continue
        if rid in first_seen:
            same = first_seen[rid] == me and rid not in failed
            out[e["arrival_no"]] = "ABSORBED" if same else "CONFLICT"
            continue
        first_seen[rid] = me
        mine = {(k, *[e[c] for c in k]) for k in KEYS if all(e[c] is not None for c in k)}
        if mine & taken:
            out[e["arrival_no"]] = "CONFLICT"
            failed.add(rid)
        else:
            taken |= mine
            out[e["arrival_no"]] = "INSERT"
    return out


def test_storing_equals_one_by_one(spark, make):
    rng = random.Random(11)
    stored = [issue_row(i, event_id=rng.randrange(1, 4), user_id=i, issue_sequence=i, message_id=f"m{i}") for i in range(1, 6)]
    entries = []
    for no in range(1, 160):
        n = rng.randrange(1, 60)
        entries.append(dict(
            request_id=uuid_of(rng.randrange(1, 90)), event_id=rng.randrange(1, 4), user_id=n, issue_sequence=rng.randrange(1, 60),
            message_id=None if rng.random() < 0.2 else f"m{rng.randrange(1, 120)}", arrival_no=no, decided_at=START))
        if rng.random() < 0.2:
            entries[-1] = {**rng.choice(entries), "arrival_no": no}
    df = spark.createDataFrame([tuple(e.values()) for e in entries], ENTRY)
    got = {r["arrival_no"]: r["outcome"] for r in persistence.classify_entries(df, make.issue(*stored)).collect()}
    want = one_by_one(entries, stored)
    # A repeat of a stored-in-batch request counts as absorbed or conflicting by identity.
    assert got == want
    assert {"INSERT", "ABSORBED", "CONFLICT"} <= set(got.values())


def test_chain_of_blocked_entries(spark, make):
    rows = [
        (uuid_of(1), 1, 1, 1, None, 1, START), (uuid_of(2), 1, 1, 2, None, 2, START), (uuid_of(3), 1, 3, 2, None, 3, START),
        (uuid_of(4), 1, 3, 4, None, 4, START), (uuid_of(5), 1, 5, 4, None, 5, START)]
    got = persistence.classify_entries(spark.createDataFrame(rows, ENTRY), make.issue(issue_row(99, event_id=9)))
    assert {r["arrival_no"]: r["outcome"] for r in got.collect()} == {1: "INSERT", 2: "CONFLICT", 3: "INSERT", 4: "CONFLICT", 5: "INSERT"}


def test_long_chains_take_logarithmic_rounds(spark, make, monkeypatch):
    """Every entry runs against the one before it; some chains meet in one entry, and some run against a stored row."""
    rows, no = [], 0
    for chain, length in enumerate((600, 7, 8), 1):
        for k in range(length):
            no += 1
            # Shares its user with the entry before it or its sequence with the one after it, in turn.
            rows.append((uuid_of(no), chain, k // 2 if k % 2 else k // 2 - 1000, (k + 1) // 2 + (5000 if k % 2 else 0), None, no, START))
    for k in range(400):
        no += 1
        rows.append((uuid_of(no), 9, (k + 1) // 2, 1 + k // 2, None, no, START))
    rows += [(uuid_of(no + 1), 9, 200, 1, None, no + 1, START), (uuid_of(no + 2), 9, 7000, 1, None, no + 2, START)]
    calls = []
    real = persistence.cut
    monkeypatch.setattr(persistence, "cut", lambda df: calls.append(1) or real(df))
    stored = [dict(request_id=uuid_of(90000), event_id=77, user_id=1, issue_sequence=1, message_id=None)]
    got = persistence.classify_entries(spark.createDataFrame(rows, ENTRY), make.issue(issue_row(90000, event_id=77)))
    got = {r["arrival_no"]: r["outcome"] for r in got.collect()}
    want = one_by_one([dict(zip(("request_id", "event_id", "user_id", "issue_sequence", "message_id", "arrival_no"), r)) for r in rows], stored)
    assert got == want and len(calls) < 60


def entry(n, ms, **change):
    row = dict(
        entry_id=f"{ms}-0", type="ISSUE", requestId=uuid_of(n), campaignId="1", userId=str(n), bitmapSegmentId="0", bitOffset=str(n - 1),
        issueSequence=str(n), decidedAt=str(ms))
    row.update(change)
    return tuple(row.values())


def test_stream_is_stored_once(spark, make, tmp_path):
    event = make.event(event_row(1))
    coupon = make.rows(schemas.COUPON, (1, "c", "FIXED", 100, 24, START))
    ms = 1755000000000
    files = [
        [entry(1, ms), entry(2, ms + 1), entry(3, ms + 2, userId="x"), entry(4, ms + 3, type="COMPENSATE", campaignId=None)],
        [entry(2, ms + 1), entry(5, ms + 4), entry(6, ms + 5, userId="1"), entry(1, ms, userId="77")],
        [entry(1, ms), entry(7, ms + 9, requestId=uuid_of(5))],
    ]

    def run():
        q = ingest.persist_query(read_issue_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", event, coupon, NOW)
        q.awaitTermination()

    for part in files:
        spark.createDataFrame(part, schemas.STREAM_ENTRY).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        run()
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    issues = {r["request_id"]: r for r in read("issue").collect()}
    assert set(issues) == {uuid_of(1), uuid_of(2), uuid_of(5)}
    one = issues[uuid_of(1)]
    assert one["valid_to"] - one["valid_from"] == timedelta(hours=24) and one["issued_at"] == datetime(2025, 8, 12, 21)
    assert one["issue_id"] == (1 << 32) + 1
    assert {r["event_uid"] for r in read("history").collect()} == set(issues) and read("history").count() == 3
    assert read("malformed").select("entry_id", "fault").collect() == [(f"{ms + 2}-0", "userId")]
    refused = ingest.outcomes(spark, f"{tmp_path}/out").filter("outcome = 'CONFLICT'").collect()
    assert {(r["entry_id"], r["attempts"], r["action"]) for r in refused} == {(f"{ms}-0", 1, "RETRY"), (f"{ms + 5}-0", 1, "RETRY"), (f"{ms + 9}-0", 1, "RETRY")}
    before = read("issue").count()
    # A micro-batch repeated after a failure replaces its own rows.
    again = spark.createDataFrame(files[1], schemas.STREAM_ENTRY)
    ingest.persist_batch(again, 1, f"{tmp_path}/out", event, coupon, NOW)
    assert read("issue").count() == before and read("history").count() == 3


def test_store_confirm_redeliver_from_an_existing_ledger(spark, make, tmp_path):
    """Stored rows of the ledger absorb or refuse; confirmations move records and counters; the third failed delivery is given back."""
    event, coupon = make.event(event_row(1)), make.rows(schemas.COUPON, (1, "c", "FIXED", 100, 24, START))
    ledger = make.issue(issue_row(1), issue_row(2, request_id=uuid_of(2)))
    ms = 1755000000000
    record = lambda n, user, code=0, stage=0: (1, uuid_of(n), user, code, stage, 0, START)
    records = spark.createDataFrame(
        [record(1, 1), record(3, 3), record(4, 4), record(5, 5, 0, 1), record(6, 66), record(7, 7, 8, 2), record(12, 12)], ingest.RECORD)
    # 4 takes a stored user's place, 8 a stored sequence's; 9 is of no campaign; 12 runs against the entry before it.
    bad = [entry(4, ms + 4, userId="1"), entry(8, ms + 8, issueSequence="2"), entry(9, ms + 9, campaignId="77"), entry(12, ms + 12, issueSequence="3")]
    files = [
        [entry(1, ms + 1), entry(3, ms + 3), entry(5, ms + 5), *bad], [entry(6, ms + 6), entry(7, ms + 7), *bad, entry(3, ms + 3)], bad, [], bad]
    for part in files:
        spark.createDataFrame(part, schemas.STREAM_ENTRY).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def run(folder, per_trigger, **sizes):
        stream = read_issue_stream(spark, f"{tmp_path}/in", per_trigger)
        ingest.persist_query(stream, folder, event, coupon, NOW, issue=ledger, records=records, **sizes).awaitTermination()
        state = ingest.StoreState.below(spark, folder, **sizes)
        last = ingest.batches_done(spark, folder)
        kept = {r["request_id"]: (r["code"], r["lifecycle"]) for r in state.records.all(last).collect()}
        counts = [(r["campaign_id"], r["confirmed"], r["returned"]) for r in state.counters.all(last).collect()]
        failed = sorted((r["request_id"], r["failure_stage"], r["compensation_result"]) for r in ingest.failures(spark, folder).collect())
        rows = {(r["request_id"], r["outcome"]) for r in ingest.outcomes(spark, folder).collect()}
        return kept, counts, failed, rows

    kept, counts, failed, rows = run(f"{tmp_path}/one", 1, buckets=4, merge_every=2)
    n = lambda k: uuid_of(k)
    assert {(n(1), "ABSORBED"), (n(3), "INSERT"), (n(3), "ABSORBED"), (n(4), "CONFLICT"), (n(8), "CONFLICT"), (n(9), "NO_CAMPAIGN"), (n(12), "CONFLICT")} <= rows
    # User 1 asked under request 4, whose record is user 4's: not given back. Request 12's is.
    assert kept == {n(1): (0, 1), n(3): (0, 1), n(4): (0, 0), n(5): (0, 1), n(6): (0, 0), n(7): (8, 2), n(12): (8, 2)}
    assert counts == [(1, 2, 1)]
    assert failed == sorted([
        (n(4), "RELAY", "INVALID_ARGUMENT"), (n(8), "RELAY", "REQUEST_NOT_FOUND"), (n(9), "RELAY", "REQUEST_NOT_FOUND"), (n(12), "RELAY", "COMPENSATED"),
        (n(6), "CONFIRM", "INVALID_ARGUMENT"), (n(7), "CONFIRM", "NOT_CONFIRMABLE")])
    again = run(f"{tmp_path}/two", 5)
    assert again[0] == kept and again[1] == counts and again[2] == failed


def test_key_state_reads_touched_buckets_only(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    rows = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    state = KeyedState(spark, f"{tmp_path}/s", schema, ("k",), buckets=8, merge_every=3)
    state.start(rows(*[(f"k{i}", i) for i in range(40)], (None, -1)))
    state.start(rows(("other", 0)))
    got = lambda batch: {r["k"]: r["n"] for r in state.all(batch).collect()}
    want = {f"k{i}": i for i in range(40)} | {None: -1}
    for batch in range(8):
        state.merge(batch)
        assert got(batch) == want
        changed = {f"k{batch}": 100 + batch, "k1": 200 + batch, f"new{batch}": batch}
        state.update(rows(*changed.items()), batch)
        if batch == 4:  # a repeated micro-batch replaces its own rows
            state.update(rows(*changed.items()), batch)
        want |= changed
    assert state.base(7) == 6 and state.base(5) == 3 and state.base(2) == 0
    one = rows(("k5", 0), (None, 0))
    found = state.of(one, 8)
    assert {r["k"]: r["n"] for r in found.collect()} == {"k5": 105, None: -1}
    # Only the two keys' buckets of the newest snapshot and the deltas since.
    files = [f for f in state.all(8, state.touched(one)).inputFiles()]
    assert all("version=6" in f or "version=7" in f for f in files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and len(state.touched(one)) <= 2
    assert {f.rsplit("=", 1)[1] for f in state.outdated(8) if "delta" in f} == {"0", "1", "2", "3", "4", "5"}


def test_probe_and_answers(spark, make):
    issue = make.issue(issue_row(1), issue_row(2))
    f = spark.createDataFrame(
        [(1, 1, 1, uuid_of(1), 1), (2, 1, 1, uuid_of(1), None), (3, 1, 1, uuid_of(1), 9), (4, 1, 5, uuid_of(2), None), (5, 1, 1, uuid_of(8), None)],
        "failure_id long, event_id long, user_id long, request_id string, issue_sequence long")
    got = {r["failure_id"]: r["probe_result"] for r in persistence.probe(f, issue).collect()}
    assert got == {1: "PERSISTED", 2: "PERSISTED", 3: "ABSENT", 4: "ABSENT", 5: "ABSENT"}
    state = spark.createDataFrame(
        [(1, "a", 1, 0, 0), (1, "b", 2, 0, 1), (1, "c", 3, 8, 2), (1, "d", 4, 1, 3)], "campaign_id long, request_id string, user_id long, code int, lifecycle int")
    cmds = spark.createDataFrame(
        [(1, 1, "a", 1), (2, 1, "a", 1), (3, 1, "b", 2), (4, 1, "c", 3), (5, 1, "d", 4), (6, 1, "a", 9), (7, 1, "z", 1)],
        "command_no long, campaign_id long, request_id string, user_id long")
    confirmed = {r["command_no"]: r["confirm_result"] for r in persistence.confirm(state, cmds).collect()}
    assert confirmed == {
        1: "CONFIRMED_NOW", 2: "ALREADY_CONFIRMED", 3: "ALREADY_CONFIRMED", 4: "NOT_CONFIRMABLE", 5: "NOT_CONFIRMABLE", 6: "INVALID_ARGUMENT", 7: "REQUEST_NOT_FOUND"}
    back = {r["command_no"]: r["compensate_result"] for r in persistence.compensate(state, cmds).collect()}
    assert back == {
        1: "COMPENSATED", 2: "ALREADY_COMPENSATED", 3: "NOT_COMPENSABLE", 4: "ALREADY_COMPENSATED", 5: "NOT_COMPENSABLE", 6: "INVALID_ARGUMENT", 7: "REQUEST_NOT_FOUND"}


def test_trimming_keeps_the_newest_and_the_unread(spark):
    entries = spark.createDataFrame([(1, n) for n in range(1, 6)], "campaign_id long, entry_no long")
    acks = spark.createDataFrame(
        [(1, "a", n) for n in (1, 2, 3, 4, 5)] + [(1, "b", n) for n in (1, 3, 5)], "campaign_id long, consumer string, entry_no long")
    assert {r["entry_no"] for r in persistence.trimmable(entries, acks).collect()} == {1, 3}


def test_unknown_campaigns_and_oversize_sequences_are_refused(spark, make):
    event, coupon = make.event(event_row(1)), make.rows(schemas.COUPON, (1, "x", "FIXED", 1, 24, START))
    rows = [(uuid_of(1), 1, 1, 1, "m1", 1, START), (uuid_of(2), 99, 1, 1, "m1", 0, START), (uuid_of(3), 1, 2, 1 << 31, "m3", 2, START), (uuid_of(4), 1, 2, 2, "m3", 3, START)]
    issues, history, judged = persistence.persist_issues(spark.createDataFrame(rows, ENTRY), make.issue(), event, coupon, NOW)
    assert {r["arrival_no"]: r["outcome"] for r in judged.collect()} == {0: "NO_CAMPAIGN", 1: "INSERT", 2: "BAD_SEQUENCE", 3: "INSERT"}
    assert {r["user_id"]: r["valid_to"] for r in issues.collect()} == {1: START + timedelta(hours=24), 2: START + timedelta(hours=24)}
    assert history.count() == 2


def test_a_compensated_record_holds_the_restored_stock(spark):
    schema = "campaign_id long, request_id string, user_id long, code int, lifecycle int, issue_sequence long, remaining long, updated_at timestamp_ntz"
    state = spark.createDataFrame([(1, r, u, 0, 0, u, 0, START) for u, r in enumerate("abc", 1)], schema)
    cmds = spark.createDataFrame([(5, 1, "c", 3), (7, 1, "a", 1), (9, 1, "a", 1)], "command_no long, campaign_id long, request_id string, user_id long")
    stock = spark.createDataFrame([(1, 4)], "campaign_id long, stock long")
    out = persistence.apply_answers(state, persistence.compensate(state, cmds), "compensate_result", NOW, stock)
    assert {r["request_id"]: (r["code"], r["remaining"], r["updated_at"]) for r in out.collect()} == {"a": (8, 6, NOW), "b": (0, 0, START), "c": (8, 5, NOW)}


def test_late_rows_count_and_order_does_not_matter(spark, tmp_path):
    from tallyroll.streaming import dedup, pending, windows

    at = lambda n: START + timedelta(seconds=n)
    failed = [(1, at(100), "SOLD_OUT"), (1, at(0), "SOLD_OUT"), (1, at(1), "X"), (1, at(101), "SOLD_OUT"), (1, at(2), "SOLD_OUT")]
    entries = [(1, 1, at(3600)), (1, 2, at(0)), (1, 3, at(1800))]
    stored = [(1, 1, at(3601)), (1, 3, at(1801))]
    seen = [("m1", 1), ("m2", 2), ("m1", 1), ("m3", 3), ("m2", 2)]

    def stream(name, rows, schema):
        for row in rows:  # a file a row, so a micro-batch a row
            spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/{name}")

    windows.failure_windows_query(stream("f", failed, "campaign_id long, at timestamp_ntz, reason string"), f"{tmp_path}/w").awaitTermination()
    got = sorted((r["window_start"], r["reason"], r["failures"]) for r in windows.window_totals(spark, f"{tmp_path}/w").collect())
    assert got == [(at(0), "SOLD_OUT", 2), (at(0), "UNKNOWN", 1), (at(100), "SOLD_OUT", 2)]
    sightings = [*[(pending.ENTRY, *e) for e in entries[:2]], *[(pending.STORED, *e) for e in stored], (pending.ENTRY, *entries[2]), (pending.STORED, 1, 2, at(601))]
    for order, every in ((sightings, 1), (sightings[::-1], 5)):
        folder = f"{tmp_path}/p{every}"
        pending.track_query(stream(f"s{every}", order, pending.SIGHTING), folder, buckets=4, merge_every=every).awaitTermination()
        assert [r["issue_sequence"] for r in pending.unstored_so_far(spark, folder, buckets=4, merge_every=every).collect()] == [2]
        assert pending.unstored_so_far(spark, folder, as_of=at(600), buckets=4, merge_every=every).count() == 0
    ids = stream("d", seen, "message_id string, n long")
    dedup.drop_redelivered_query(ids, f"{tmp_path}/d2", buckets=4).awaitTermination()
    assert sorted(r["n"] for r in dedup.first_deliveries(spark, f"{tmp_path}/d2", ids.schema).collect()) == [1, 2, 3]


def test_ids_are_forgotten_by_snapshots_after_the_retention(spark, tmp_path):
    from tallyroll.streaming import dedup

    at = lambda n: START + timedelta(hours=n)
    batches = [[("a", at(0)), ("b", at(0)), (None, at(0))], [("c", at(10)), ("a", at(1)), (None, at(1))], [("d", at(11)), ("b", at(0))], [("a", at(0)), ("c", at(10))]]
    for rows in batches:
        spark.createDataFrame(rows, "message_id string, at timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("message_id string, at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    dedup.drop_redelivered_query(stream, f"{tmp_path}/out", "at", "5 HOURS", buckets=2, merge_every=2).awaitTermination()
    got = [(r["message_id"], r["batch"]) for r in spark.read.parquet(f"{tmp_path}/out/out").collect()]
    # The snapshot before batch 2 forgets what is 5 hours older than c: b comes through again and is listed, as a is then.
    assert sorted(got, key=repr) == sorted([("a", 0), ("b", 0), (None, 0), ("c", 1), ("d", 2), ("b", 2), ("a", 3)], key=repr)
    assert sorted((r["message_id"], r["batch"]) for r in dedup.late_deliveries(spark, f"{tmp_path}/out").collect()) == [("a", 3), ("b", 2)]
    dedup.drop_redelivered_query(stream, f"{tmp_path}/all", buckets=2, merge_every=2).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/all/out").count() == 5


def test_only_requests_tell_what_is_stored(spark, make):
    got = {r["key"]: (r["request_id"], r["event_id"], r["user_id"], r["issue_sequence"]) for r in persistence.stored_keys(make.issue(issue_row(7, message_id="m"))).collect()}
    none = (None, None, None, None)
    assert got == {"0:1:7": none, "1:1:7": none, "2:m": none, f"r:{uuid_of(7)}": (uuid_of(7), 1, 7, 7)}


def test_entries_are_judged_once(spark, make, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def pass_on(value):
        seen.add(1)
        return value

    real = ingest.classify_against
    monkeypatch.setattr(ingest, "classify_against", lambda *a: real(*a).withColumn("outcome", F.udf(pass_on, "string").asNondeterministic()("outcome")))
    rows = spark.createDataFrame([entry(n, 1755000000000 + n) for n in range(1, 6)], schemas.STREAM_ENTRY)
    ingest.persist_batch(rows, 0, f"{tmp_path}/out", make.event(event_row(1)), make.rows(schemas.COUPON, (1, "c", "FIXED", 100, 24, START)), NOW)
    assert spark.read.parquet(f"{tmp_path}/out/issue").count() == 5 and seen.value == 5
