"""Streaming forms run to the end of the given tables; results must equal the batch forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

import catalog.campaigns  # noqa: F401  (defines the command views)
from catalog.issuance import _PERSIST
from catalog.registry import query
from catalog.sqlviews import VIEWS, request_uuid, with_views
from tallyroll.functions.times import ts
from tallyroll.plans.staging import work_folder
from tallyroll.schemas import ISSUE
from tallyroll.sources import derived
from tallyroll.sources.stream import parse_issue_entries
from tallyroll.streaming import allocate, commands, dedup, ingest, pending, windows

NOW = datetime(2024, 2, 10)

def _stage(df, folder, files=1000):
    """Write a derived frame so that a file stream can read it, and return that stream."""
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _run_in_order(df, folder, column, parts, files, run, numbers=None):
    """Run a stream over ``parts`` equal ranges of ``column`` in their order, ``files`` of them to a micro-batch.

    ``run`` starts the query on the stream it is given. It goes to the end of what is there before the next ranges are written, so
    a range may lie in as many files as its rows take. ``numbers``: a frame with the same or more numbers that is cheaper to read.
    """
    spark = df.sparkSession
    low, high = (df if numbers is None else numbers).agg(F.min(column), F.max(column)).first()
    step = max(1, -(-(high + 1 - low) // parts)) if low is not None else 1
    stream = spark.readStream.schema(df.schema).parquet
    for k in range(0, parts, files):
        part = df if low is None else df.filter(F.col(column).between(low + k * step, low + (k + files) * step - 1))
        part.write.mode("append").option("compression", "zstd").parquet(folder)
        run(stream(folder)).awaitTermination()
    return spark.read.schema(df.schema).parquet(folder)


@query("stream_failure_windows", """
    SELECT time_bucket(INTERVAL 5 SECOND, ts) AS window_start, event_id % 25 + 1 AS campaign_id,
      CASE event_id % 5 WHEN 0 THEN 'SOLD_OUT' WHEN 1 THEN 'ALREADY_ISSUED' WHEN 2 THEN 'EVENT_NOT_OPEN' ELSE 'UNKNOWN' END AS reason, count(*) AS failures
    FROM events WHERE event_type = 'error' GROUP BY ALL""")
def stream_failure_windows(spark, sf_dir):
    """Read in several micro-batches; equal to the batch form over all rows."""
    folder = work_folder(spark, "failure-windows")
    e = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type") == "error").select(
        (e % 25 + 1).alias("campaign_id"), F.col("ts").cast("timestamp_ntz").alias("at"),
        F.when(e % 5 == 0, "SOLD_OUT").when(e % 5 == 1, "ALREADY_ISSUED").when(e % 5 == 2, "EVENT_NOT_OPEN")
        .when(e % 5 == 3, "EVENT_CLOSED").otherwise("IDEMPOTENCY_CONFLICT").alias("reason"))
    windows.failure_windows_query(_stage(rows.repartition(4), f"{folder}/in", 2), folder).awaitTermination()
    return windows.window_totals(spark, folder)


@query("stream_dedup_entries", with_views("SELECT DISTINCT message_id, event_id, issue_sequence FROM d_parsed", "d_parsed"))
def stream_dedup_entries(spark, sf_dir):
    folder = work_folder(spark, "dedup")
    entries = derived.stream_entry(spark, sf_dir)
    good, _ = parse_issue_entries(_stage(entries.repartition(4), f"{folder}/in", 2))
    rows = good.select("message_id", "event_id", "issue_sequence")
    dedup.drop_redelivered_query(rows, folder, buckets=8).awaitTermination()
    return dedup.first_deliveries(spark, folder, rows.schema)


_STREAMED = _PERSIST.replace("old AS (SELECT * FROM d_issue WHERE created_at < TIMESTAMP '1997-01-01')", "old AS (SELECT * FROM d_issue WHERE false)")


@query("stream_persist_issues", with_views(f"""WITH {_STREAMED.strip()}
    SELECT event_id * 4294967296 + issue_sequence AS issue_id, event_id, user_id, issue_sequence, request_id, message_id, decided_at AS issued_at,
      decided_at + INTERVAL 24 HOUR AS valid_to FROM a5 WHERE outcome = 'INSERT'""", "d_parsed", "d_issue"))
def stream_persist_issues(spark, sf_dir):
    folder = work_folder(spark, "persist")
    t = derived.tables(spark, sf_dir)
    stream = _stage(derived.stream_entry(spark, sf_dir), f"{folder}/in")
    ingest.persist_query(stream, folder, t.event, t.coupon, NOW, buckets=8).awaitTermination()
    return spark.read.schema(ISSUE).parquet(f"{folder}/issue").select(
        "issue_id", "event_id", "user_id", "issue_sequence", "request_id", "message_id", "issued_at", "valid_to")


# --- storing against an existing ledger, with confirmations and redelivery -------------------

# The ledger holds what was stored before 1997; entries come up to three times; campaign 24 is unknown, some sequences don't fit.
_AGAIN = "(CAST(split_part(entry_id, '-', 1) AS BIGINT) - 1755000000000)"
_STORE = f"""{_PERSIST.strip().replace("FROM d_parsed", "FROM sent WHERE event_id <> 24 AND issue_sequence < 2147483648")},
  refused AS (SELECT entry_id, event_id, request_id, user_id, issue_sequence, CASE WHEN event_id = 24 THEN 'NO_CAMPAIGN' ELSE 'BAD_SEQUENCE' END AS outcome
    FROM (SELECT DISTINCT entry_id, event_id, request_id, user_id, issue_sequence FROM sent) WHERE event_id = 24 OR issue_sequence >= 2147483648),
  entries AS (SELECT entry_id, event_id, request_id, user_id, issue_sequence, outcome FROM a5 UNION ALL BY NAME SELECT * FROM refused),
  rows_ AS (SELECT request_id, event_id, user_id, issue_sequence FROM old UNION ALL SELECT request_id, event_id, user_id, issue_sequence FROM a5 WHERE outcome = 'INSERT'),
  times AS (SELECT entry_id, event_id, request_id, user_id, issue_sequence, count(*) AS n FROM (
      SELECT * FROM sent UNION ALL SELECT * FROM sent WHERE {_AGAIN} % 3 <> 0 UNION ALL SELECT * FROM sent WHERE {_AGAIN} % 3 = 1) GROUP BY ALL),
  ends AS (SELECT e.*, e.outcome IN ('INSERT', 'ABSORBED') AS stored, CASE WHEN e.outcome NOT IN ('INSERT', 'ABSORBED') THEN n END AS attempts,
      e.outcome NOT IN ('INSERT', 'ABSORBED') AND n >= 3 AND NOT EXISTS (SELECT 1 FROM rows_ r WHERE r.request_id = e.request_id AND r.event_id = e.event_id
        AND r.user_id = e.user_id AND r.issue_sequence = e.issue_sequence) AS given_up
    FROM entries e JOIN times t USING (entry_id, event_id, request_id, user_id, issue_sequence)),
  told AS (SELECT r.campaign_id, r.request_id, r.user_id, r.code, r.lifecycle, r.code = 0 AND r.lifecycle = 0 AND bool_or(coalesce(stored, false)) AS confirmed,
      r.code = 0 AND r.lifecycle = 0 AND NOT bool_or(coalesce(stored, false)) AND bool_or(coalesce(given_up, false)) AS returned
    FROM d_record r LEFT JOIN ends e ON e.event_id = r.campaign_id AND e.request_id = r.request_id AND e.user_id = r.user_id
    GROUP BY r.campaign_id, r.request_id, r.user_id, r.code, r.lifecycle)"""

VIEWS["d_sent"] = (("d_parsed",), f"SELECT * REPLACE (CASE WHEN {_AGAIN} % 41 = 5 THEN issue_sequence + 3000000000 ELSE issue_sequence END AS issue_sequence) FROM d_parsed")
VIEWS["d_record"] = ((), f"""
  SELECT o_orderkey % 25 + 1 AS campaign_id, {request_uuid('o_orderkey')} AS request_id, o_custkey + 1 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS user_id,
    CASE WHEN o_orderkey % 23 = 0 THEN 8 WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS code,
    CASE WHEN o_orderkey % 23 = 0 THEN 2 WHEN o_orderkey % 37 = 0 THEN 3 WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS lifecycle
  FROM orders WHERE o_orderkey % 29 <> 0
""")


def _records(spark, sf_dir):
    """Request records of the stream's requests: most accepted and pending, some of other users, settled or missing."""
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").filter(k % 29 != 0).select(
        (k % 25 + 1).alias("campaign_id"), derived.request_uuid(k).alias("request_id"), (F.col("o_custkey") + 1 + F.when(k % 13 == 0, 1).otherwise(0)).alias("user_id"),
        F.when(k % 23 == 0, 8).when(k % 37 == 0, 1).otherwise(0).alias("code"),
        F.when(k % 23 == 0, 2).when(k % 37 == 0, 3).when(k % 9 == 0, 1).otherwise(0).alias("lifecycle"),
        F.lit(0).cast("long").alias("remaining"), F.lit(NOW).cast("timestamp_ntz").alias("updated_at"))


def _store(spark, sf_dir):
    """Run the storing stream over all deliveries: the first ones, then the second, then the third. Its folder and state."""
    folder = work_folder(spark, "store")
    t = derived.tables(spark, sf_dir)
    n = F.split("entry_id", "-")[0].cast("long") - F.lit(1755000000000)
    grown = (F.col("issueSequence").cast("long") + F.lit(3000000000)).cast("string")
    sent = derived.stream_entry(spark, sf_dir).withColumn("issueSequence", F.when((n % 41 == 5) & (F.col("issueSequence") != "0"), grown).otherwise(F.col("issueSequence")))
    ledger = t.issue.filter(F.col("created_at") < ts("1997-01-01 00:00:00"))
    for wave in (sent, sent.filter(n % 3 != 0), sent.filter(n % 3 == 1)):
        # A micro-batch each: the stream goes to the end of what is there before the next is written, by as many tasks as its rows take.
        wave.write.mode("append").option("compression", "zstd").parquet(f"{folder}/in")
        ingest.persist_query(
            spark.readStream.schema(sent.schema).parquet(f"{folder}/in"), folder, t.event.filter("event_id <> 24"), t.coupon, NOW,
            issue=ledger, records=_records(spark, sf_dir), buckets=8, merge_every=2).awaitTermination()
    return folder, ingest.StoreState.below(spark, folder, 8, 2)


@query("stream_store_entries", with_views(f"""WITH sent AS (SELECT * FROM d_sent), {_STORE}
    SELECT entry_id, event_id, request_id, user_id, issue_sequence, stored, attempts, given_up FROM ends""", "d_sent", "d_issue", "d_record"))
def stream_store_entries(spark, sf_dir):
    """How every entry ended: stored, or failed so many times, or given up after a probe."""
    folder, _ = _store(spark, sf_dir)
    return ingest.outcomes(spark, folder).groupBy("entry_id", "event_id", "request_id", "user_id", "issue_sequence").agg(
        F.bool_or(F.col("outcome").isin("INSERT", "ABSORBED")).alias("stored"), F.max("attempts").alias("attempts"),
        F.bool_or(F.col("action") == "COMPENSATE_AND_ACK").alias("given_up"))


@query("stream_store_records", with_views(f"""WITH sent AS (SELECT * FROM d_sent), {_STORE}
    SELECT campaign_id, request_id, user_id, CASE WHEN returned THEN 8 ELSE code END AS code, CASE WHEN returned THEN 2 WHEN confirmed THEN 1 ELSE lifecycle END AS lifecycle
    FROM told""", "d_sent", "d_issue", "d_record"))
def stream_store_records(spark, sf_dir):
    """Every request record after the stream: confirmed, given back, or as before."""
    folder, state = _store(spark, sf_dir)
    return state.records.all(ingest.batches_done(spark, folder)).select("campaign_id", "request_id", "user_id", "code", "lifecycle")


@query("stream_store_counters", with_views(f"""WITH sent AS (SELECT * FROM d_sent), {_STORE}
    SELECT campaign_id, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (returned) AS returned FROM told WHERE confirmed OR returned GROUP BY campaign_id""",
    "d_sent", "d_issue", "d_record"))
def stream_store_counters(spark, sf_dir):
    """Confirmed quantity and stock given back of every campaign the stream moved."""
    folder, state = _store(spark, sf_dir)
    return state.counters.all(ingest.batches_done(spark, folder))


@query("stream_allocate", with_views("SELECT * FROM d_decision", "d_decision"))
def stream_allocate(spark, sf_dir):
    folder = work_folder(spark, "allocate")
    rows = derived.request(spark, sf_dir).withColumn("kind", F.lit("REQUEST")).select(allocate.COMMAND.fieldNames())
    allocate.allocate_query(_stage(rows, f"{folder}/in"), folder, derived.campaign(spark, sf_dir), buckets=8).awaitTermination()
    return allocate.decisions(spark, folder)


# Requests, and give-backs some requests later: of accepted and refused ones, repeated ones, by another user, of unknown ids.
VIEWS["d_command_log"] = (("d_request",), """
  SELECT 'REQUEST' AS kind, campaign_id, user_id, request_id, arrived_at, arrival_no * 4 AS arrival_no FROM d_request
  UNION ALL SELECT 'COMPENSATE', campaign_id, CASE WHEN arrival_no % 21 = 3 THEN user_id + 1 ELSE user_id END, request_id, arrived_at, (arrival_no + 50) * 4 + 1 FROM d_request WHERE arrival_no % 7 = 3
  UNION ALL SELECT 'COMPENSATE', campaign_id, user_id, request_id, arrived_at, (arrival_no + 90) * 4 + 2 FROM d_request WHERE arrival_no % 14 = 3
  UNION ALL SELECT 'COMPENSATE', campaign_id, user_id, concat('none-', arrival_no), arrived_at, arrival_no * 4 + 3 FROM d_request WHERE arrival_no % 35 = 1
""")


def _command_log(spark, sf_dir):
    n = F.col("arrival_no")
    r = derived.request(spark, sf_dir)
    back = r.withColumn("kind", F.lit("COMPENSATE"))
    parts = [
        r.withColumn("kind", F.lit("REQUEST")).withColumn("arrival_no", n * 4),
        back.filter(n % 7 == 3).withColumn("user_id", F.when(n % 21 == 3, F.col("user_id") + 1).otherwise(F.col("user_id"))).withColumn("arrival_no", (n + 50) * 4 + 1),
        back.filter(n % 14 == 3).withColumn("arrival_no", (n + 90) * 4 + 2),
        back.filter(n % 35 == 1).withColumn("request_id", F.concat(F.lit("none-"), n.cast("string"))).withColumn("arrival_no", n * 4 + 3),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.select(allocate.COMMAND.fieldNames())


@query("stream_allocate_give_backs", with_views("""
    WITH RECURSIVE told AS (
      SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY arrival_no) AS n, count(*) OVER (PARTITION BY campaign_id, request_id) > 1 AS again FROM d_command_log),
    step AS (
      SELECT campaign_id, CAST(0 AS BIGINT) AS n, total_stock AS stock, CAST(0 AS BIGINT) AS drawn, open_at, close_at,
        CAST(MAP {} AS MAP(BIGINT, BOOLEAN)) AS holds,
        CAST(MAP {} AS MAP(VARCHAR, STRUCT(u BIGINT, code INTEGER, seq BIGINT, remaining BIGINT, since TIMESTAMP))) AS mem,
        CAST(NULL AS BIGINT) AS arrival_no, CAST(NULL AS VARCHAR) AS answer, CAST(NULL AS STRUCT(u BIGINT, code INTEGER, seq BIGINT, remaining BIGINT, since TIMESTAMP)) AS k
      FROM d_campaign
      UNION ALL
      SELECT campaign_id, n, stock_, drawn_, open_at, close_at,
        CASE answer WHEN 'ACCEPT' THEN map_concat(holds, MAP {user_id: true}) WHEN 'COMPENSATED' THEN map_concat(holds, MAP {user_id: false}) ELSE holds END,
        CASE WHEN again AND answer IN ('ACCEPT', 'SOLD', 'HELD', 'EARLY', 'LATE') THEN map_concat(mem, MAP {request_id: k2}) WHEN answer = 'COMPENSATED' THEN map_concat(mem, MAP {request_id: k2}) ELSE mem END,
        arrival_no, answer, k2
      FROM (
        SELECT *, CASE WHEN answer = 'COMPENSATED' THEN {'u': k.u, 'code': 8, 'seq': k.seq, 'remaining': stock_, 'since': k.since}
            WHEN answer IN ('ACCEPT', 'SOLD', 'HELD', 'EARLY', 'LATE') THEN {'u': user_id, 'code': CASE answer WHEN 'ACCEPT' THEN 0 WHEN 'SOLD' THEN 1 WHEN 'HELD' THEN 2 WHEN 'EARLY' THEN 3 ELSE 4 END,
              'seq': CASE WHEN answer = 'ACCEPT' THEN drawn_ END, 'remaining': stock_, 'since': arrived_at} ELSE k END AS k2
        FROM (
          SELECT *, stock - CASE answer WHEN 'ACCEPT' THEN 1 WHEN 'COMPENSATED' THEN -1 ELSE 0 END AS stock_, drawn + CASE answer WHEN 'ACCEPT' THEN 1 ELSE 0 END AS drawn_
          FROM (
            SELECT *, CASE WHEN kind = 'COMPENSATE' THEN CASE WHEN k IS NULL THEN 'REQUEST_NOT_FOUND' WHEN k.u <> user_id THEN 'INVALID_ARGUMENT' WHEN k.code = 8 THEN 'ALREADY_COMPENSATED'
                  WHEN k.code <> 0 THEN 'NOT_COMPENSABLE' ELSE 'COMPENSATED' END
                WHEN k IS NOT NULL THEN CASE WHEN k.u = user_id THEN 'REPEAT' ELSE 'CLASH' END
                WHEN arrived_at < open_at THEN 'EARLY' WHEN arrived_at >= close_at THEN 'LATE' WHEN coalesce(holds[user_id], false) THEN 'HELD' WHEN stock <= 0 THEN 'SOLD' ELSE 'ACCEPT' END AS answer
            FROM (SELECT s.campaign_id, t.n, s.stock, s.drawn, s.open_at, s.close_at, s.holds, s.mem, t.kind, t.user_id, t.request_id, t.arrived_at, t.arrival_no, t.again, s.mem[t.request_id] AS k
                  FROM step s JOIN told t ON t.campaign_id = s.campaign_id AND t.n = s.n + 1)))))
    SELECT t.arrival_no, t.kind, t.campaign_id, CASE WHEN t.kind = 'COMPENSATE' THEN NULL WHEN s.answer IS NULL THEN 5 WHEN s.answer = 'CLASH' THEN 6 ELSE s.k.code END AS code,
      CASE WHEN t.kind = 'REQUEST' AND s.answer <> 'CLASH' THEN s.k.seq END AS issue_sequence, CASE WHEN t.kind = 'REQUEST' AND s.answer <> 'CLASH' THEN s.k.remaining END AS remaining,
      CASE WHEN t.kind = 'REQUEST' THEN s.k.since END AS decided_at, CASE WHEN t.kind = 'REQUEST' THEN coalesce(s.answer IN ('REPEAT', 'CLASH'), false) END AS repeated,
      CASE WHEN t.kind = 'COMPENSATE' THEN coalesce(s.answer, 'REQUEST_NOT_FOUND') END AS result, CASE WHEN s.answer = 'COMPENSATED' THEN s.k.remaining END AS restored
    FROM told t LEFT JOIN step s ON s.campaign_id = t.campaign_id AND s.n = t.n""", "d_command_log", "d_campaign"))
def stream_allocate_give_backs(spark, sf_dir):
    """Requests and give-backs in the order of the log, two files to a micro-batch, in segments of a few thousand numbers."""
    folder = work_folder(spark, "give-backs")
    _run_in_order(_command_log(spark, sf_dir), f"{folder}/in", "arrival_no", 4, 2, lambda stream: allocate.allocate_query(
        stream, folder, derived.campaign(spark, sf_dir), buckets=8, segment_rows=5000))
    answers = allocate.decisions(spark, folder).select(
        "arrival_no", F.lit("REQUEST").alias("kind"), "campaign_id", "code", "issue_sequence", "remaining", "decided_at", "repeated")
    return answers.unionByName(allocate.give_backs(spark, folder).select(
        "arrival_no", F.lit("COMPENSATE").alias("kind"), "campaign_id", "result", "restored"), allowMissingColumns=True)


@query("stream_commands", with_views("""
    SELECT command_no, issue_id, event_id, target_status, CASE WHEN refusal IS NULL THEN prev END AS previous_status, result FROM d_keyed WHERE replay = 'NEW'
    UNION ALL SELECT command_no, issue_id, NULL, target_status, NULL, replay FROM d_keyed WHERE replay <> 'NEW'""", "d_keyed"))
def stream_commands(spark, sf_dir):
    from catalog.campaigns import _commands

    folder = work_folder(spark, "commands")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("command_no"))
    # In the order of the log, several ranges to a micro-batch: answers don't depend on where micro-batches end.
    cmds = _run_in_order(
        _commands(spark, sf_dir), f"{folder}/in", "command_no", 4, 2,
        lambda stream: commands.command_query(stream, folder, derived.issue(spark, sf_dir), buckets=8), lines)
    columns = ("command_no", "issue_id", "event_id", "target_status", "previous_status", "result")
    repeats = commands.repeats(spark, folder).join(cmds.select("command_no", "issue_id", "target_status"), "command_no")
    return commands.results(spark, folder).select(*columns).unionByName(
        repeats.withColumn("result", F.col("replay")).select("command_no", "issue_id", "target_status", "result"), allowMissingColumns=True)


@query("stream_unstored_entries", with_views("""
    SELECT event_id, issue_sequence, issued_at AS decided_at FROM d_issue i WHERE issued_at IS NOT NULL AND issue_sequence > 0
      AND NOT EXISTS (SELECT 1 FROM d_issue s WHERE s.issued_at IS NOT NULL AND s.issue_sequence > 0 AND s.issue_sequence % 10 <> 3 AND s.event_id = i.event_id
        AND s.issue_sequence = i.issue_sequence AND s.created_at >= i.issued_at AND s.created_at <= i.issued_at + INTERVAL 10 MINUTE)""", "d_issue"))
def stream_unstored_entries(spark, sf_dir):
    folder = work_folder(spark, "unstored")
    i = derived.issue(spark, sf_dir).filter(F.col("issued_at").isNotNull() & (F.col("issue_sequence") > 0))
    entries = i.select(F.lit(pending.ENTRY).alias("kind"), "event_id", "issue_sequence", F.col("issued_at").alias("at"))
    stored = i.filter(F.col("issue_sequence") % 10 != 3).select(F.lit(pending.STORED).alias("kind"), "event_id", "issue_sequence", F.col("created_at").alias("at"))
    # Dealt at random over the files: a stored row may come before its entry or after it.
    stream = _stage(entries.unionByName(stored).repartition(4), f"{folder}/in", 2)
    pending.track_query(stream, folder, buckets=8, merge_every=1).awaitTermination()
    return pending.unstored_so_far(spark, folder, buckets=8, merge_every=1)
