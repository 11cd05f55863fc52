import random
from datetime import datetime, timedelta

from conftest import CHECKED, START, event_row, issue_row, sec

from tallyroll import schemas
from tallyroll.operators import commands, lifecycle
from tallyroll.plans import segments
from tallyroll.streaming import commands as streaming

MOVES = {("ISSUED", "USED"), ("ISSUED", "EXPIRED"), ("USED", "ISSUED")}


def walk(issues, cmds):
    state = {i["issue_id"]: dict(i) for i in issues}
    out = {}
    for c in sorted(cmds, key=lambda c: c[0]):
        no, _, issue_id, user, target, _, at = c
        i = state.get(issue_id)
        if i is None:
            out[no] = (None, "ISSUE_NOT_FOUND")
        elif i["user_id"] != user:
            out[no] = (None, "INVALID_REQUEST")
        elif target == "USED" and i["valid_from"] > at:
            out[no] = (None, "EVENT_NOT_OPEN")
        elif target in ("USED", "ISSUED") and i["valid_to"] < at:
            out[no] = (None, "ALREADY_EXPIRED")
        else:
            prev = i["status"]
            if (prev, target) in MOVES:
                i["status"] = target
                if target != "EXPIRED":
                    i["used_at"], i["canceled_at"] = (at, None) if target == "USED" else (None, at)
                out[no] = (prev, "SUCCESS")
            else:
                same = {"USED": "ALREADY_USED", "ISSUED": "NOT_YET_USED", "EXPIRED": "ALREADY_EXPIRED"}
                out[no] = (prev, same[target] if prev == target else "INVALID_STATE_TRANSITION")
    return out, {k: (v["status"], v["used_at"], v["canceled_at"]) for k, v in state.items()}


def make_case(seed, n):
    rng = random.Random(seed)
    issues = [issue_row(i, status=rng.choice(["ISSUED", "ISSUED", "USED", "EXPIRED", "CANCELED"])) for i in range(1, 12)]
    cmds = []
    for no in range(1, n + 1):
        i = 1 if rng.random() < 0.4 else rng.randrange(1, 13)
        at = START + sec(rng.randrange(-600, 6000))
        cmds.append((no, f"c{no}", i, i if rng.random() < 0.95 else 99, rng.choice(["USED", "ISSUED", "USED", "ISSUED", "EXPIRED"]) if rng.random() < 0.9 else "EXPIRED", None, at))
    return issues, cmds


def test_commands_equal_a_walk(spark, make, monkeypatch):
    for seed, size in ((1, 7), (2, 50), (3, 1_000_000)):
        monkeypatch.setattr(commands, "number_segment", lambda c, s=size: segments.number_segment(c, s))
        issues, cmds = make_case(seed, 300)
        want, end = walk(issues, cmds)
        updates, history, results = commands.apply_commands(make.issue(*issues), make.rows(streaming.COMMAND, *cmds))
        assert {r["command_no"]: (r["previous_status"], r["result"]) for r in results.collect()} == want
        got = {r["issue_id"]: (r["status"], r["used_at"], r["canceled_at"]) for r in updates.collect()}
        assert got and all(end[k] == v for k, v in got.items())
        assert history.count() == sum(1 for v in want.values() if v[1] == "SUCCESS")


def test_commands_as_a_stream(spark, make, tmp_path):
    issues, cmds = make_case(4, 120)
    want, _ = walk(issues, cmds)
    for i in range(3):
        part = [c for c in cmds if i * 40 < c[0] <= (i + 1) * 40]
        if i == 2:
            done = [no for no, v in want.items() if v[1] == "SUCCESS" and no <= 40][0]
            repeat = cmds[done - 1]
            part += [(500, *repeat[1:]), (501, *repeat[1:4], "EXPIRED" if repeat[4] != "EXPIRED" else "USED", *repeat[5:])]
        make.rows(streaming.COMMAND, *part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(streaming.COMMAND).parquet(f"{tmp_path}/in")
        streaming.command_query(stream, f"{tmp_path}/out", make.issue(*issues), buckets=4).awaitTermination()
    got = {r["command_no"]: (r["previous_status"], r["result"]) for r in streaming.results(spark, f"{tmp_path}/out").collect()}
    assert got == want
    again = {r["command_no"]: r["replay"] for r in spark.read.parquet(f"{tmp_path}/out/replayed").collect()}
    assert again == {500: "REPLAY", 501: "IDEMPOTENCY_CONFLICT"}


def test_repeated_keys(spark):
    cmds = spark.createDataFrame(
        [("a", 1, 1, 1, "USED"), ("a", 2, 1, 1, "USED"), ("a", 3, 1, 1, "ISSUED"), ("b", 4, 1, 1, "USED"), ("c", 5, 1, 1, "USED"), ("d", 6, 1, 1, "USED")],
        "event_uid string, command_no long, issue_id long, user_id long, target_status string")
    idem = spark.createDataFrame(
        [("b", 1, 1, "USED", "ISSUED", START), ("c", 1, 1, "USED", None, None), ("d", 1, 2, "USED", "ISSUED", START)],
        "event_uid string, issue_id long, user_id long, target_status string, from_status string, occurred_at timestamp_ntz")
    got = {r["command_no"]: r["replay"] for r in commands.replay_commands(cmds, idem).collect()}
    assert got == {1: "NEW", 2: "NEW", 3: "NEW", 4: "REPLAY", 5: "DUPLICATE_REQUEST", 6: "IDEMPOTENCY_CONFLICT"}


def keyed_walk(issues, cmds):
    """One command after the other; a key is remembered when its command has succeeded."""
    status = {i["issue_id"]: i["status"] for i in issues}
    known = {i["issue_id"]: i for i in issues}
    memory, out = {}, {}
    for no, uid, issue, user, target, _, at in sorted(cmds):
        content = (issue, user, target)
        if uid in memory:
            out[no] = "REPLAY" if memory[uid] == content else "IDEMPOTENCY_CONFLICT"
            continue
        row = known[issue]
        if row["user_id"] != user:
            out[no] = "INVALID_REQUEST"
        elif target == "USED" and row["valid_from"] > at:
            out[no] = "EVENT_NOT_OPEN"
        elif target in ("USED", "ISSUED") and row["valid_to"] < at:
            out[no] = "ALREADY_EXPIRED"
        elif (status[issue], target) in (("ISSUED", "USED"), ("ISSUED", "EXPIRED"), ("USED", "ISSUED")):
            out[no], status[issue], memory[uid] = "SUCCESS", target, content
        else:
            out[no] = {("USED", "USED"): "ALREADY_USED", ("ISSUED", "ISSUED"): "NOT_YET_USED", ("EXPIRED", "EXPIRED"): "ALREADY_EXPIRED"}.get(
                (status[issue], target), "INVALID_STATE_TRANSITION")
    return out


def test_a_refused_command_leaves_its_key_free(spark, make, tmp_path):
    import random

    draw = random.Random(3)
    issues = [issue_row(i, user_id=1) for i in range(1, 4)]
    cmds = []
    for no in range(1, 31):
        at = START + timedelta(minutes=draw.choice([-30, 10, 20, 200]))
        cmds.append((no, f"k{draw.randrange(8)}", draw.randrange(1, 4), 1, draw.choice(["USED", "ISSUED", "USED", "EXPIRED"] if no > 20 else ["USED", "ISSUED"]), None, at))
    want = keyed_walk(issues, cmds)
    assert {"REPLAY", "IDEMPOTENCY_CONFLICT", "SUCCESS", "EVENT_NOT_OPEN"} <= set(want.values())
    df = make.rows(streaming.COMMAND, *cmds)
    empty = spark.createDataFrame([], "event_uid string, issue_id long, user_id long, target_status string, occurred_at timestamp_ntz")
    _, _, results, repeats = commands.run_commands(make.issue(*issues), df, empty)
    got = {r["command_no"]: r["result"] for r in results.collect()} | {r["command_no"]: r["replay"] for r in repeats.collect()}
    assert got == want
    # The same answers whatever the size of the micro-batches.
    for k in range(2):
        df.filter(f"command_no > {15 * k} and command_no <= {15 * k + 15}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(streaming.COMMAND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streaming.command_query(stream, f"{tmp_path}/out", make.issue(*issues), buckets=4).awaitTermination()
    got = {r["command_no"]: r["result"] for r in streaming.results(spark, f"{tmp_path}/out").collect()}
    got |= {r["command_no"]: r["replay"] for r in spark.read.parquet(f"{tmp_path}/out/replayed").collect()}
    assert got == want
    after = {r["issue_id"]: r["status"] for r in streaming.current_coupons(spark, f"{tmp_path}/out", buckets=4).collect()}
    moved = {i: [c[4] for c in cmds if c[2] == i and want[c[0]] == "SUCCESS"] for i in after}
    assert after == {i: (m[-1] if m else "ISSUED") for i, m in moved.items()}


def test_rounds(spark, make):
    o, c = datetime(2026, 9, 1), datetime(2026, 10, 1)
    event = make.event(event_row(1, round=1, total_stock=10, open_at=o, close_at=c), event_row(2, round=4, total_stock=20, open_at=o, close_at=c))
    coupon = make.rows(schemas.COUPON, (1, "x", "FIXED", 1, 24, START), (2, "y", "FIXED", 1, 24, START))
    cmds = spark.createDataFrame(
        [(1, 1, 1, 10, o, c), (2, 1, 1, 11, o, c), (3, 1, None, 20, o, c), (4, 1, None, 30, o, c), (5, 1, None, 30, o, c), (6, 1, None, 31, o, c),
         (7, 2, None, 5, datetime(2026, 8, 1), c), (8, 9, None, 5, o, c), (9, 1, None, 5, c, o), (10, 1, 6, 7, o, c), (11, 1, 6, 7, o, c), (12, 1, 6, 8, o, c)],
        "command_no long, coupon_id long, round int, total_stock long, open_at timestamp_ntz, close_at timestamp_ntz")
    got = {r["command_no"]: (r["outcome"], r["assigned_round"], r["status"]) for r in commands.create_rounds(event, coupon, cmds, CHECKED).collect()}
    assert got == {
        1: ("REUSED", 1, None), 2: ("CONFIGURATION_CONFLICT", None, None), 3: ("REUSED", 4, None), 4: ("CREATED", 7, "SCHEDULED"), 5: ("REUSED", 7, None),
        6: ("CREATED", 8, "SCHEDULED"), 7: ("CREATED", 1, "OPEN"), 8: ("COUPON_NOT_FOUND", None, None), 9: ("INVALID_REQUEST", None, None),
        10: ("CREATED", 6, "SCHEDULED"), 11: ("REUSED", 6, None), 12: ("CONFIGURATION_CONFLICT", None, None)}


def test_round_life_cycle(spark, make):
    now = datetime(2026, 8, 10)
    past, future = datetime(2026, 8, 5), datetime(2026, 9, 1)
    event = make.event(
        event_row(1, status="SCHEDULED"), event_row(2, status="SCHEDULED", close_at=past), event_row(3, total_stock=5, remaining_stock=5),
        event_row(4, total_stock=5, remaining_stock=5), event_row(5, status="SOLD_OUT", close_at=past, total_stock=5), event_row(6, close_at=past, total_stock=5),
        event_row(7, close_at=past, total_stock=5, issued_quantity=9), event_row(8, close_at=past))
    state = spark.createDataFrame(
        [(3, 5, 0, 5, future), (4, 5, 0, 3, future), (5, 5, 2, 3, past), (6, 5, 2, 1, past), (7, 5, 2, 3, past), (9, 5, 9, 0, future)],
        "event_id long, total_stock long, remaining_stock long, confirmed_quantity long, close_at timestamp_ntz").selectExpr(
            "*", "timestamp_ntz'2026-08-01' as open_at", "timestamp_ntz'2027-01-01' as expire_at")
    stats = lifecycle.campaign_stats(state, now)
    code = {r["event_id"]: (r["code"], r["stat_status"], r["stat_pending"]) for r in stats.collect()}
    assert code == {3: ("SUCCESS", "SOLD_OUT", 0), 4: ("SUCCESS", "SOLD_OUT", 2), 5: ("SUCCESS", "CLOSED", 0), 6: ("SUCCESS", "CLOSED", 2),
                    7: ("SUCCESS", "CLOSED", 0), 9: ("CORRUPTED_STATE", None, None)}
    assert [r["event_id"] for r in lifecycle.open_due(event, now).collect()] == [1]
    assert [r["event_id"] for r in lifecycle.close_never_opened(event, now).collect()] == [2]
    assert {r["event_id"]: r["outcome"] for r in lifecycle.mark_sold_out(event, stats, now).collect()} == {3: "SOLD_OUT", 4: "WAITING_FOR_DRAIN"}
    assert {r["event_id"]: r["outcome"] for r in lifecycle.close_drained(event, stats, now).collect()} == {
        5: "CLOSED", 6: "WAITING_FOR_DRAIN", 7: "UNRESOLVED", 8: "UNRESOLVED"}
    assert {r["event_id"]: r["outcome"] for r in lifecycle.apply_snapshot(event, stats, now).collect()} == {3: "APPLIED", 4: "APPLIED"}


def test_initialization_ledger(spark):
    at = lambda n: START + timedelta(minutes=n)
    log = spark.createDataFrame(
        [(1, 1, "ATTEMPT", at(1), None, None), (1, 2, "FAILURE", at(2), "E", "m"), (1, 3, "ATTEMPT", at(3), None, None), (1, 4, "SUCCESS", at(4), None, None),
         (1, 5, "FAILURE", at(5), "LATE", "m"), (2, 1, "ATTEMPT", at(1), None, None), (2, 2, "FAILURE", at(2), "E", "m" * 600),
         (3, 1, "FAILURE", at(1), "E", "m"), (3, 2, "ATTEMPT", at(2), None, None)],
        "event_id long, seq long, kind string, at timestamp_ntz, error_code string, error_message string")
    got = {r["event_id"]: r for r in lifecycle.fold_init(log).collect()}
    assert (got[1]["status"], got[1]["attempt_count"], got[1]["initialized_at"], got[1]["last_error_code"], got[1]["updated_at"]) == (
        "INITIALIZED", 2, at(4), None, at(4))
    assert (got[2]["status"], got[2]["last_error_code"], len(got[2]["last_error_message"])) == ("FAILED", "E", 600)
    assert (got[3]["status"], got[3]["last_error_code"], got[3]["updated_at"]) == ("PENDING", None, at(2))


def counted(spark, df, column):
    """The frame, and a counter of the rows of it that were worked out."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def pass_on(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(pass_on, df.schema[column].dataType).asNondeterministic()(column)), seen


def test_a_log_is_judged_and_tried_once(spark, make):
    issues, cmds = make_case(6, 90)
    log, seen = counted(spark, make.rows(streaming.COMMAND, *cmds), "event_uid")
    idem = spark.createDataFrame([], "event_uid string, issue_id long, user_id long, target_status string, occurred_at timestamp_ntz")
    updates, history, results, repeats = commands.run_commands(make.issue(*issues), log, idem)
    want, _ = walk(issues, cmds)
    assert {r["command_no"]: (r["previous_status"], r["result"]) for r in results.collect()} == want
    assert updates.count() and history.count() and not repeats.count()
    # Once to count the keys, once to judge.
    assert seen.value <= 2 * len(cmds)


def test_crowded_coupons_are_walked_in_segments(spark, make, monkeypatch):
    monkeypatch.setattr(commands, "CROWD_ROWS", 30)
    monkeypatch.setattr(commands, "number_segment", lambda c: segments.number_segment(c, 16))
    issues, cmds = make_case(7, 200)
    want, _ = walk(issues, cmds)
    got = commands.apply_commands(make.issue(*issues), make.rows(streaming.COMMAND, *cmds))[2]
    assert {r["command_no"]: (r["previous_status"], r["result"]) for r in got.collect()} == want
