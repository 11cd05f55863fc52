import random
from datetime import datetime, timedelta

from tallyroll.operators import allocation
from tallyroll.schemas import REQUEST
from tallyroll.streaming import allocate as streaming

OPEN, CLOSE = datetime(2026, 1, 1, 0, 1), datetime(2026, 1, 1, 0, 9)
CAMPAIGN = "campaign_id long, total_stock long, open_at timestamp_ntz, close_at timestamp_ntz"


def replay(rows, campaigns, back=None):
    """One request after the other, as plain state; ``back`` gives places back after a row number."""
    stock = {c[0]: c[1] for c in campaigns}
    seq = {c[0]: 0 for c in campaigns}
    held, seen, out = set(), {}, {}
    for campaign, user, rid, at, no in rows:
        key = (campaign, rid)
        if key in seen:
            first = seen[key]
            out[no] = (first[1], first[2], first[3]) if first[0] == user else (6, None, None)
            continue
        if campaign not in stock:
            out[no] = (5, None, None)
            continue
        if at < OPEN:
            ans = (3, None, stock[campaign])
        elif at >= CLOSE:
            ans = (4, None, stock[campaign])
        elif (campaign, user) in held:
            ans = (2, None, stock[campaign])
        elif stock[campaign] == 0:
            ans = (1, None, 0)
        else:
            stock[campaign] -= 1
            seq[campaign] += 1
            held.add((campaign, user))
            ans = (0, seq[campaign], stock[campaign])
        seen[key] = (user, *ans)
        out[no] = ans
    return out


def make_log(n, seed, hot=0.5):
    rng = random.Random(seed)
    rows, ids = [], []
    for no in range(1, n + 1):
        campaign = 1 if rng.random() < hot else rng.randrange(2, 5)
        user = rng.randrange(1, 120)
        if ids and rng.random() < 0.15:
            campaign, rid, owner = rng.choice(ids)
            user = owner if rng.random() < 0.6 else user
        else:
            rid = f"r{no}"
            ids.append((campaign, rid, user))
        rows.append((campaign, user, rid, datetime(2026, 1, 1) + timedelta(seconds=no), no))
    return rows


def test_allocation_equals_sequential_replay(spark):
    rows = make_log(600, 3)
    campaigns = [(1, 40, OPEN, CLOSE), (2, 5, OPEN, CLOSE), (3, 1000, OPEN, CLOSE)]
    want = replay(rows, campaigns)
    log = spark.createDataFrame(rows, REQUEST)
    table = spark.createDataFrame(campaigns, CAMPAIGN)
    for segment in (7, 1_000_000):
        got = {r["arrival_no"]: (r["code"], r["issue_sequence"], r["remaining"]) for r in allocation.allocate(log, table, segment_rows=segment).collect()}
        assert got == want
    plain = {r["arrival_no"]: (r["code"], r["issue_sequence"]) for r in allocation.allocate_plain(log, table).collect()}
    assert plain == {k: v[:2] for k, v in want.items()}


def test_one_user_and_one_request_many_times(spark):
    at = OPEN + timedelta(seconds=1)
    log = [(1, 7, f"a{i}", at, i) for i in range(1, 51)] + [(1, 8, "same", at, i) for i in range(51, 101)]
    got = allocation.allocate(spark.createDataFrame(log, REQUEST), spark.createDataFrame([(1, 10, OPEN, CLOSE)], CAMPAIGN)).collect()
    codes = [r["code"] for r in got if r["user_id"] == 7]
    assert codes.count(0) == 1 and codes.count(2) == 49
    assert {(r["code"], r["issue_sequence"]) for r in got if r["user_id"] == 8} == {(0, 2)}


def test_invalid_and_corrupted(spark):
    at = OPEN + timedelta(seconds=1)
    log = [(1, 0, "a", at, 1), (1, 5, "x|y", at, 2), (1, 5, None, at, 3), (2, 5, "b", at, 4), (3, 5, "c", at, 5), (3, 6, "c", at, 6)]
    campaigns = [(1, 10, OPEN, CLOSE), (2, 10, CLOSE, OPEN)]
    got = {r["arrival_no"]: r["code"] for r in allocation.allocate(spark.createDataFrame(log, REQUEST), spark.createDataFrame(campaigns, CAMPAIGN)).collect()}
    assert got == {1: 9, 2: 9, 3: 9, 4: 7, 5: 5, 6: 5}


def test_streaming_equals_batch_across_micro_batches(spark, tmp_path):
    rows = make_log(400, 9)
    campaigns = [(1, 30, OPEN, CLOSE), (2, 5, OPEN, CLOSE), (3, 1000, OPEN, CLOSE)]
    want = replay(rows, campaigns)
    table = spark.createDataFrame(campaigns, CAMPAIGN)
    for i in range(3):
        part = [("REQUEST", *r) for r in rows if i * 150 < r[4] <= (i + 1) * 150]
        spark.createDataFrame(part, streaming.COMMAND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(streaming.COMMAND).parquet(f"{tmp_path}/in")
        streaming.allocate_query(stream, f"{tmp_path}/out", table, buckets=4).awaitTermination()
    got = {r["arrival_no"]: (r["code"], r["issue_sequence"], r["remaining"]) for r in streaming.decisions(spark, f"{tmp_path}/out").collect()}
    assert got == want


def test_give_back_frees_the_place_and_the_user(spark, tmp_path):
    at = OPEN + timedelta(seconds=1)
    table = spark.createDataFrame([(1, 1, OPEN, CLOSE)], CAMPAIGN)
    parts = [
        [("REQUEST", 1, 7, "a", at, 1), ("REQUEST", 1, 8, "b", at, 2), ("COMPENSATE", 1, 7, "a", at, 3), ("COMPENSATE", 1, 8, "b", at, 4)],
        [("REQUEST", 1, 8, "c", at, 5), ("REQUEST", 1, 7, "a", at, 6), ("COMPENSATE", 1, 7, "a", at, 7), ("COMPENSATE", 1, 9, "zzz", at, 8)],
        [("REQUEST", 1, 7, "d", at, 9)],
    ]
    for part in parts:
        spark.createDataFrame(part, streaming.COMMAND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(streaming.COMMAND).parquet(f"{tmp_path}/in")
        streaming.allocate_query(stream, f"{tmp_path}/out", table, buckets=4).awaitTermination()
    codes = {r["arrival_no"]: (r["code"], r["issue_sequence"], r["remaining"]) for r in streaming.decisions(spark, f"{tmp_path}/out").collect()}
    assert codes == {1: (0, 1, 0), 2: (1, None, 0), 5: (0, 2, 0), 6: (8, 1, 1), 9: (1, None, 0)}
    back = {r["arrival_no"]: r["result"] for r in streaming.give_backs(spark, f"{tmp_path}/out").collect()}
    assert back == {3: "COMPENSATED", 4: "NOT_COMPENSABLE", 7: "ALREADY_COMPENSATED", 8: "REQUEST_NOT_FOUND"}


def replay_with_give_backs(rows, stocks):
    """One command after the other."""
    memory, holders, drawn, out = {}, set(), dict.fromkeys(stocks, 0), {}
    left = dict(stocks)
    for kind, campaign, user, request, at, no in rows:
        known = memory.get((campaign, request))
        if kind == "COMPENSATE":
            if known is None:
                out[no] = "REQUEST_NOT_FOUND"
            elif known[0] != user:
                out[no] = "INVALID_ARGUMENT"
            elif known[1] == 8:
                out[no] = "ALREADY_COMPENSATED"
            elif known[1] != 0:
                out[no] = "NOT_COMPENSABLE"
            else:
                left[campaign] += 1
                holders.discard((campaign, user))
                memory[campaign, request] = (user, 8, known[2], left[campaign])
                out[no] = "COMPENSATED"
        elif known is not None:
            out[no] = known[1:] if known[0] == user else (6, None, None)
        else:
            if (campaign, user) in holders:
                code, sequence = 2, None
            elif not left[campaign]:
                code, sequence = 1, None
            else:
                left[campaign] -= 1
                drawn[campaign] += 1
                holders.add((campaign, user))
                code, sequence = 0, drawn[campaign]
            memory[campaign, request] = (user, code, sequence, left[campaign])
            out[no] = memory[campaign, request][1:]
    return out


def test_answers_do_not_depend_on_micro_batches(spark, tmp_path):
    import random

    draw, at = random.Random(11), OPEN + timedelta(seconds=1)
    rows = []
    for no in range(1, 121):
        request = draw.randrange(9)
        user = request % 8 + 1 if draw.random() < 0.9 else 9
        rows.append(("COMPENSATE" if draw.random() < 0.4 else "REQUEST", draw.randrange(1, 4), user, f"r{request}", at, no))
    want = replay_with_give_backs(rows, {1: 3, 2: 1, 3: 1000})
    assert {"COMPENSATED", "NOT_COMPENSABLE", "ALREADY_COMPENSATED", "INVALID_ARGUMENT"} <= {v for v in want.values() if isinstance(v, str)}
    table = spark.createDataFrame([(1, 3, OPEN, CLOSE), (2, 1, OPEN, CLOSE), (3, 1000, OPEN, CLOSE)], CAMPAIGN)
    for k in range(0, 120, 60):
        spark.createDataFrame(rows[k : k + 60], streaming.COMMAND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for files in (2, 1):
        folder = f"{tmp_path}/out{files}"
        stream = spark.readStream.schema(streaming.COMMAND).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
        streaming.allocate_query(stream, folder, table, buckets=4, merge_every=1).awaitTermination()
        got = {r["arrival_no"]: (r["code"], r["issue_sequence"], r["remaining"]) for r in streaming.decisions(spark, folder).collect()}
        got |= {r["arrival_no"]: r["result"] for r in streaming.give_backs(spark, folder).collect()}
        assert got == want


def one_after_the_other(rows, campaigns, records, holders):
    """Requests and give-backs by plain rules; campaigns: (stock, drawn, open, close)."""
    memory, holding = {k: list(v) for k, v in records.items()}, set(holders)
    left, drawn, out = {c: v[0] for c, v in campaigns.items()}, {c: v[1] for c, v in campaigns.items()}, {}
    for kind, campaign, user, request, at, no in rows:
        known = memory.get((campaign, request))
        if kind == "COMPENSATE":
            if known is None:
                out[no] = ("REQUEST_NOT_FOUND", None)
            elif known[0] != user:
                out[no] = ("INVALID_ARGUMENT", None)
            elif known[1:3] == [8, 2]:
                out[no] = ("ALREADY_COMPENSATED", None)
            elif known[1:3] != [0, 0]:
                out[no] = ("NOT_COMPENSABLE", None)
            else:
                left[campaign] = left.get(campaign, 0) + 1
                known[1], known[2], known[4] = 8, 2, left[campaign]
                holding.discard((campaign, user))
                out[no] = ("COMPENSATED", left[campaign])
        elif not (user > 0 and 0 < len(request) < 129 and "|" not in request):
            out[no] = (7, None, None, False)
        elif known is not None:
            out[no] = (known[1], known[3], known[4], True) if known[0] == user else (6, None, None, True)
        elif campaign not in campaigns:
            out[no] = (5, None, None, False)
        elif campaigns[campaign][2] >= campaigns[campaign][3]:
            out[no] = (9, None, None, False)
        else:
            code, sequence = 2, None
            if at < campaigns[campaign][2]:
                code = 3
            elif at >= campaigns[campaign][3]:
                code = 4
            elif (campaign, user) not in holding:
                code = 1
                if left[campaign] > 0:
                    code, sequence = 0, drawn[campaign] + 1
                    left[campaign] -= 1
                    drawn[campaign] += 1
                    holding.add((campaign, user))
            memory[campaign, request] = [user, code, 0 if code == 0 else 3, sequence, left[campaign]]
            out[no] = (code, sequence, left[campaign], False)
    return out


def test_commands_in_segments_are_a_replay(spark):
    """Sold out, refilled, asked again, repeated, too early, too late, of broken and unknown campaigns, from a state before."""
    import random

    from tallyroll.constants import DECISION_CORRUPTED_STATE, DECISION_INVALID_ARGUMENT, DECISION_NOT_INITIALIZED
    from tallyroll.operators.give_back import answer_commands

    names = {7: DECISION_INVALID_ARGUMENT, 5: DECISION_NOT_INITIALIZED, 9: DECISION_CORRUPTED_STATE}
    seen = set()
    for seed, segment in ((1, 1_000_000), (2, 7), (3, 1)):
        draw = random.Random(seed)
        campaigns = {1: (2, 3, OPEN, CLOSE), 2: (0, 5, OPEN, CLOSE), 3: (500, 0, OPEN, CLOSE), 4: (5, 0, CLOSE, OPEN)}
        records = {(1, "r1"): (1, 0, 0, 1, 4), (1, "r2"): (2, 0, 1, 2, 3), (2, "r3"): (3, 0, 0, 5, 0), (2, "r4"): (4, 1, 3, None, 0), (3, "r5"): (5, 8, 2, 1, 9), (5, "r6"): (6, 0, 0, 1, 1)}
        holders = [(1, 1), (1, 2), (2, 3)]
        rows = []
        for no in range(1, 181):
            request = draw.randrange(10)
            user = request % 6 + 1 if draw.random() < 0.9 else draw.choice((7, 0))
            at = draw.choices((OPEN - timedelta(seconds=1), OPEN, CLOSE), (1, 20, 1))[0]
            name = f"r{request}" if draw.random() < 0.95 else draw.choice(("", "a|b"))
            rows.append(("COMPENSATE" if draw.random() < 0.45 else "REQUEST", draw.choices((1, 2, 3, 4, 5), (6, 4, 4, 1, 1))[0], user, name, at, no * 3))
        want = one_after_the_other(rows, campaigns, records, holders)
        state = spark.createDataFrame(
            [(c, stock + drawn, stock, drawn, a, b) for c, (stock, drawn, a, b) in campaigns.items()],
            "campaign_id long, total_stock long, stock long, sequence long, open_at timestamp_ntz, close_at timestamp_ntz")
        remembered = spark.createDataFrame(
            [(*k, *v, OPEN) for k, v in records.items()],
            "campaign_id long, request_id string, user_id long, code int, lifecycle int, issue_sequence long, remaining long, decided_at timestamp_ntz")
        answers = answer_commands(
            spark.createDataFrame(rows, streaming.COMMAND).repartition(3), state, remembered, spark.createDataFrame(holders, "campaign_id long, user_id long"), segment)
        got = {r["arrival_no"]: (r["result"], r["restored"]) if r["result"] else (r["code"], r["issue_sequence"], r["remaining"], r["repeated"]) for r in answers.collect()}
        assert got == {no: (names.get(v[0], v[0]), *v[1:]) if not isinstance(v[0], str) else v for no, v in want.items()}
        seen |= {v[0] for v in want.values()}
    assert {"COMPENSATED", "NOT_COMPENSABLE", "ALREADY_COMPENSATED", "INVALID_ARGUMENT", "REQUEST_NOT_FOUND", *range(10)} <= seen


def test_users_with_few_attempts_take_one_window_and_narrow_rows(spark, monkeypatch):
    """Passes carry no request ids, and a user's attempts are cut into segments only if there are more than one holds."""
    from tallyroll.operators import give_back

    used, moved, narrow = [], [], give_back._served

    def served(attempts, *rest):
        moved.append(set(attempts.columns))
        return narrow(attempts, *rest)

    real = give_back.running_max_before
    monkeypatch.setattr(give_back, "_served", served)
    monkeypatch.setattr(give_back, "running_max_before", lambda *a: used.append(1) or real(*a))
    rows = [("REQUEST", 1, 1, "a", OPEN, 1), ("COMPENSATE", 1, 1, "a", OPEN, 2), ("REQUEST", 1, 2, "b", OPEN, 3), ("REQUEST", 1, 3, "c", OPEN, 4), ("REQUEST", 1, 2, "d", OPEN, 5), ("REQUEST", 1, 2, "e", OPEN, 6)]
    state = spark.createDataFrame([(1, 1, 1, 0, OPEN, CLOSE)], "campaign_id long, total_stock long, stock long, sequence long, open_at timestamp_ntz, close_at timestamp_ntz")
    none = spark.createDataFrame([], "campaign_id long, request_id string, user_id long, code int, lifecycle int, issue_sequence long, remaining long, decided_at timestamp_ntz")
    for segment, segments_used in ((3, False), (2, True)):
        used.clear()
        got = give_back.answer_commands(spark.createDataFrame(rows, streaming.COMMAND), state, none, none.select("campaign_id", "user_id"), segment).collect()
        assert {r["arrival_no"]: r["result"] or r["code"] for r in got} == {1: 0, 2: "COMPENSATED", 3: 0, 4: 1, 5: 2, 6: 2} and bool(used) == segments_used
    assert not any({"request_id", "arrived_at"} & m for m in moved)


def test_a_sold_out_campaign_takes_few_passes(spark, monkeypatch):
    """Requests after the sell-out that would be given back aren't taken for served one after the other."""
    from tallyroll.operators import give_back

    passes, real = [], give_back.running_stock
    monkeypatch.setattr(give_back, "running_stock", lambda *a: passes.append(1) or real(*a))
    rows = [("REQUEST", 1, 1, "kept", OPEN, 1)]
    for user in range(2, 9):
        rows += [("REQUEST", 1, user, f"r{user}", OPEN, 2 * user), ("COMPENSATE", 1, user, f"r{user}", OPEN, 2 * user + 1)]
    state = spark.createDataFrame([(1, 1, 1, 0, OPEN, CLOSE)], "campaign_id long, total_stock long, stock long, sequence long, open_at timestamp_ntz, close_at timestamp_ntz")
    none = spark.createDataFrame([], "campaign_id long, request_id string, user_id long, code int, lifecycle int, issue_sequence long, remaining long, decided_at timestamp_ntz")
    got = give_back.answer_commands(spark.createDataFrame(rows, streaming.COMMAND), state, none, none.select("campaign_id", "user_id"), 2).collect()
    want = {1: 0} | {2 * user: 1 for user in range(2, 9)} | {2 * user + 1: "NOT_COMPENSABLE" for user in range(2, 9)}
    assert {r["arrival_no"]: r["result"] or r["code"] for r in got} == want and len(passes) < 3
