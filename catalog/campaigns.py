"""Campaign rounds, coupon state commands and masters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqlviews import VIEWS, with_views
from tallyroll.functions.times import plus, ts
from tallyroll.operators import commands, lifecycle
from tallyroll.plans.staging import kept
from tallyroll.sources import derived

EARLY, MID = datetime(2001, 8, 1), datetime(2001, 8, 15)

VIEWS["d_stats"] = (("d_state",), """
  SELECT event_id, CASE WHEN ok THEN 'SUCCESS' ELSE 'CORRUPTED_STATE' END AS code, CASE WHEN ok THEN total_stock END AS stat_total,
    CASE WHEN ok THEN total_stock - remaining_stock END AS stat_allocated, CASE WHEN ok THEN remaining_stock END AS stat_remaining,
    CASE WHEN ok THEN CASE WHEN TIMESTAMP '2001-08-15' < open_at THEN 'SCHEDULED' WHEN TIMESTAMP '2001-08-15' >= close_at THEN 'CLOSED'
      WHEN remaining_stock = 0 THEN 'SOLD_OUT' ELSE 'OPEN' END END AS stat_status,
    CASE WHEN ok THEN confirmed_quantity END AS stat_confirmed, CASE WHEN ok THEN total_stock - remaining_stock - confirmed_quantity END AS stat_pending
  FROM (SELECT *, total_stock > 0 AND open_at < close_at AND remaining_stock >= 0 AND remaining_stock <= total_stock
      AND confirmed_quantity >= 0 AND confirmed_quantity <= total_stock - remaining_stock AS ok FROM d_state)
""")


def _stats(t, at=MID):
    return lifecycle.campaign_stats(t.state, at)


@query("campaign_stats", with_views("SELECT * FROM d_stats", "d_stats"))
def campaign_stats(spark, sf_dir):
    return _stats(derived.tables(spark, sf_dir))


_SNAPSHOT = """
  SELECT e.event_id, e.total_stock, e.issued_quantity, e.remaining_stock, e.status, e.close_at, s.code, s.stat_total, s.stat_confirmed, s.stat_remaining, s.stat_pending,
    CASE WHEN s.code IS NULL THEN 'NO_STATE' WHEN s.code <> 'SUCCESS' THEN 'UNREADABLE'
      WHEN e.total_stock = s.stat_total AND e.issued_quantity <= s.stat_confirmed THEN 'APPLIED' ELSE 'REJECTED' END AS snap
  FROM d_event e LEFT JOIN d_stats s ON s.event_id = e.event_id"""


@query("campaign_apply_snapshot", with_views(f"""
    SELECT event_id, snap AS outcome, CASE WHEN snap = 'APPLIED' THEN stat_confirmed ELSE issued_quantity END AS issued_quantity,
      CASE WHEN snap = 'APPLIED' THEN total_stock - stat_confirmed ELSE remaining_stock END AS remaining_stock
    FROM ({_SNAPSHOT}) WHERE status = 'OPEN' AND close_at > TIMESTAMP '2001-08-01'""", "d_event", "d_stats"))
def campaign_apply_snapshot(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return lifecycle.apply_snapshot(t.event, _stats(t), EARLY)


@query("campaign_snapshot_counts", with_views(f"""
    SELECT snap AS outcome, count(*) AS rounds FROM ({_SNAPSHOT}) WHERE status = 'OPEN' AND close_at > TIMESTAMP '2001-08-01' GROUP BY snap""", "d_event", "d_stats"))
def campaign_snapshot_counts(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return lifecycle.sweep_counts(lifecycle.apply_snapshot(t.event, _stats(t), EARLY))


@query("campaign_open_due", with_views("""
    SELECT event_id, 'OPEN' AS status, TIMESTAMP '2001-08-15' AS updated_at FROM d_event
    WHERE status = 'SCHEDULED' AND open_at <= TIMESTAMP '2001-08-15' AND close_at > TIMESTAMP '2001-08-15'""", "d_event"))
def campaign_open_due(spark, sf_dir):
    return lifecycle.open_due(derived.tables(spark, sf_dir).event, MID)


@query("campaign_sold_out", with_views(f"""
    SELECT event_id, stat_remaining, stat_pending, CASE WHEN code IS NULL OR code <> 'SUCCESS' THEN 'UNRESOLVED' WHEN stat_remaining <> 0 THEN 'IN_STOCK'
      WHEN stat_pending <> 0 THEN 'WAITING_FOR_DRAIN' WHEN snap = 'APPLIED' AND stat_total = stat_confirmed THEN 'SOLD_OUT' ELSE 'NOT_FINAL' END AS outcome
    FROM ({_SNAPSHOT}) WHERE status = 'OPEN' AND close_at > TIMESTAMP '2001-08-01'""", "d_event", "d_stats"))
def campaign_sold_out(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return lifecycle.mark_sold_out(t.event, _stats(t), EARLY)


@query("campaign_close_drained", with_views(f"""
    SELECT event_id, outcome, CASE WHEN outcome = 'CLOSED' THEN stat_confirmed ELSE issued_quantity END AS issued_quantity,
      CASE WHEN outcome = 'CLOSED' THEN stat_total - stat_confirmed ELSE remaining_stock END AS remaining_stock
    FROM (SELECT *, CASE WHEN code IS NULL OR code <> 'SUCCESS' THEN 'UNRESOLVED' WHEN stat_pending <> 0 THEN 'WAITING_FOR_DRAIN'
        WHEN snap = 'APPLIED' THEN 'CLOSED' ELSE 'UNRESOLVED' END AS outcome FROM ({_SNAPSHOT}))
    WHERE status IN ('OPEN', 'SOLD_OUT') AND close_at <= TIMESTAMP '2001-08-15'""", "d_event", "d_stats"))
def campaign_close_drained(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return lifecycle.close_drained(t.event, _stats(t), MID)


@query("campaign_close_never_opened", with_views("""
    SELECT event_id, 'CLOSED' AS status, TIMESTAMP '2001-08-15' AS updated_at FROM d_event WHERE status = 'SCHEDULED' AND close_at <= TIMESTAMP '2001-08-15'""", "d_event"))
def campaign_close_never_opened(spark, sf_dir):
    return lifecycle.close_never_opened(derived.tables(spark, sf_dir).event, MID)


@query("campaign_advance_close", with_views("""
    WITH j AS (SELECT e.event_id, e.status, e.close_at, s.open_at AS so, s.close_at AS sc, s.expire_at AS se, s.total_stock AS st,
      CASE WHEN e.event_id % 7 = 0 THEN TIMESTAMP '1994-06-01' ELSE TIMESTAMP '2001-08-15' END AS "at"
      FROM d_event e LEFT JOIN d_state s ON s.event_id = e.event_id),
    k AS (SELECT *, CASE WHEN status = 'CLOSED' THEN 'ALREADY_CLOSED' WHEN status = 'SCHEDULED' THEN 'INVALID_STATE' WHEN st IS NULL THEN 'NOT_INITIALIZED'
      WHEN NOT (st > 0 AND so < sc AND sc < se AND "at" < se) THEN 'CORRUPTED_STATE' WHEN "at" <= so THEN 'INVALID_STATE' WHEN "at" >= sc THEN 'ALREADY_CLOSED' ELSE 'CLOSED' END AS outcome FROM j),
    m AS (SELECT *, CASE outcome WHEN 'CLOSED' THEN "at" WHEN 'ALREADY_CLOSED' THEN coalesce(sc, close_at) END AS stop FROM k)
    SELECT event_id, outcome, coalesce(status IN ('OPEN', 'SOLD_OUT') AND outcome IN ('CLOSED', 'ALREADY_CLOSED') AND close_at > stop, false) AS advanced,
      CASE WHEN status IN ('OPEN', 'SOLD_OUT') AND outcome IN ('CLOSED', 'ALREADY_CLOSED') AND close_at > stop THEN stop ELSE close_at END AS close_at FROM m""", "d_event", "d_state"))
def campaign_advance_close(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    cmds = t.event.select("event_id", F.when(F.col("event_id") % 7 == 0, ts("1994-06-01 00:00:00")).otherwise(ts(MID)).alias("closed_at"))
    return lifecycle.advance_close(t.event, t.state, cmds)


@query("issue_expire_due", with_views("""
    SELECT issue_id, event_id, 'EXPIRED' AS status FROM d_issue WHERE status = 'ISSUED' AND valid_to < TIMESTAMP '1999-01-01'""", "d_issue"))
def issue_expire_due(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return lifecycle.expire_due(t.issue, t.history, datetime(1999, 1, 1))[0]


@query("issue_expire_due_history", with_views("""
    SELECT issue_id, 'ISSUED' AS from_status, 'EXPIRED' AS to_status, 'SYSTEM' AS actor, 'EXPIRED_BY_SCHEDULE' AS reason,
      TIMESTAMP '1999-01-01' AS occurred_at, TIMESTAMP '1999-01-01' AS recorded_at, concat('EXPIRE:', CAST(issue_id AS VARCHAR)) AS event_uid
    FROM d_issue WHERE status = 'ISSUED' AND valid_to < TIMESTAMP '1999-01-01' AND issue_id % 2 = 1""", "d_issue"))
def issue_expire_due_history(spark, sf_dir):
    """Half of the coupons already carry the expiry row of an earlier, interrupted run."""
    t = derived.tables(spark, sf_dir)
    half = t.history.withColumn("event_uid", F.when(
        F.col("issue_id") % 2 == 0, F.concat(F.lit("EXPIRE:"), F.col("issue_id").cast("string"))).otherwise(F.col("event_uid")))
    full = half.unionByName(t.issue.filter("issue_id % 2 = 0").select(
        F.concat(F.lit("EXPIRE:"), F.col("issue_id").cast("string")).alias("event_uid")), allowMissingColumns=True)
    return lifecycle.expire_due(t.issue, full, datetime(1999, 1, 1))[1]


@query("campaign_rebuild_counters", with_views("""
    SELECT e.event_id, n AS issued_quantity, total_stock - n AS remaining_stock FROM d_event e JOIN (
      SELECT event_id, count(*) AS n FROM d_issue WHERE status IN ('ISSUED', 'USED', 'EXPIRED') GROUP BY event_id) a ON a.event_id = e.event_id""", "d_event"))
def campaign_rebuild_counters(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    return lifecycle.rebuild_counters(t.event, t.issue)


VIEWS["d_initlog"] = ((), """
  SELECT user_id + 1 AS event_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'ATTEMPT' WHEN event_id % 31 = 1 THEN 'SUCCESS' ELSE 'FAILURE' END AS kind,
    ts AS "at", CASE WHEN event_id % 3 <> 0 AND event_id % 31 <> 1 THEN 'TIMEOUT' END AS error_code,
    CASE WHEN event_id % 3 <> 0 AND event_id % 31 <> 1 THEN props END AS error_message FROM events
""")
VIEWS["d_init"] = (("d_initlog",), """
  SELECT l.event_id, CASE WHEN s."at" IS NOT NULL THEN 'INITIALIZED' WHEN x.kind = 'FAILURE' THEN 'FAILED' ELSE 'PENDING' END AS status,
    l.attempt_count, t."at" AS last_attempted_at, s."at" AS initialized_at,
    CASE WHEN s."at" IS NULL AND x.kind = 'FAILURE' THEN x.error_code END AS last_error_code,
    CASE WHEN s."at" IS NULL AND x.kind = 'FAILURE' THEN x.error_message END AS last_error_message,
    CASE WHEN s."at" IS NOT NULL THEN c."at" ELSE x."at" END AS updated_at
  FROM (SELECT event_id, count(*) FILTER (kind = 'ATTEMPT') AS attempt_count, max(seq) AS m, max(seq) FILTER (kind = 'ATTEMPT') AS ma,
      max(seq) FILTER (kind = 'SUCCESS') AS ms, max(seq) FILTER (kind <> 'FAILURE') AS mc FROM d_initlog GROUP BY event_id) l
  LEFT JOIN d_initlog x ON x.event_id = l.event_id AND x.seq = l.m LEFT JOIN d_initlog t ON t.event_id = l.event_id AND t.seq = l.ma
  LEFT JOIN d_initlog s ON s.event_id = l.event_id AND s.seq = l.ms LEFT JOIN d_initlog c ON c.event_id = l.event_id AND c.seq = l.mc
""")


def _init(spark, sf_dir):
    e = F.col("event_id")
    failed = (e % 3 != 0) & (e % 31 != 1)
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") + 1).alias("event_id"), e.alias("seq"),
        F.when(e % 3 == 0, "ATTEMPT").when(e % 31 == 1, "SUCCESS").otherwise("FAILURE").alias("kind"),
        F.col("ts").cast("timestamp_ntz").alias("at"), F.when(failed, "TIMEOUT").alias("error_code"), F.when(failed, F.col("props")).alias("error_message"))
    return lifecycle.fold_init(log)


@query("init_fold", with_views("SELECT * FROM d_init", "d_init"))
def init_fold(spark, sf_dir):
    return _init(spark, sf_dir)


@query("init_candidates", with_views("""
    SELECT e.event_id, e.status, coalesce(i.attempt_count, 0) AS attempt_count FROM d_event e LEFT JOIN d_init i ON i.event_id = e.event_id
    WHERE e.status IN ('SCHEDULED', 'OPEN') AND e.close_at > TIMESTAMP '2001-08-01' AND (i.event_id IS NULL OR i.status <> 'INITIALIZED')
    """, "d_event", "d_init"))
def init_candidates(spark, sf_dir):
    return lifecycle.init_candidates(derived.tables(spark, sf_dir).event, _init(spark, sf_dir), EARLY)


# --- commands ---------------------------------------------------------------------------

VIEWS["d_command"] = ((), """
  SELECT l_orderkey * 8 + l_linenumber AS command_no, concat('cmd-', CAST(l_orderkey * 8 + CASE WHEN l_linenumber = 7 THEN 6 ELSE l_linenumber END AS VARCHAR)) AS event_uid,
    l_orderkey + 1 AS issue_id, o_custkey + CASE WHEN l_orderkey % 13 = 5 THEN 2 ELSE 1 END AS user_id,
    CASE l_linenumber WHEN 1 THEN 'USED' WHEN 2 THEN 'ISSUED' WHEN 3 THEN 'USED' WHEN 4 THEN 'EXPIRED' WHEN 5 THEN 'ISSUED' WHEN 6 THEN 'EXPIRED' ELSE 'USED' END AS target_status,
    CASE WHEN l_orderkey % 2 = 0 THEN 'asked' END AS reason,
    o_orderdate + (l_orderkey % 86400) * INTERVAL 1 SECOND + (l_linenumber * 4 - 5) * INTERVAL 1 HOUR AS "at"
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey
""")


def _commands(spark, sf_dir):
    """Commands from ``lineitem``: one per line, several per coupon."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    return lines.join(orders, "l_orderkey").select(
        (k * 8 + n).alias("command_no"),
        F.concat(F.lit("cmd-"), (k * 8 + F.when(n == 7, 6).otherwise(n)).cast("string")).alias("event_uid"),
        (k + 1).alias("issue_id"), (F.col("o_custkey") + F.when(k % 13 == 5, 2).otherwise(1)).alias("user_id"),
        F.when(n.isin(1, 3, 7), "USED").when(n.isin(2, 5), "ISSUED").otherwise("EXPIRED").alias("target_status"),
        F.when(k % 2 == 0, "asked").alias("reason"),
        plus(plus(F.col("o_orderdate").cast("timestamp_ntz"), k % 86400, "SECOND"), n * 4 - 5, "HOUR").alias("at"),
    )


# The reference walks each coupon's commands one after the other.
VIEWS["d_walk"] = (("d_command", "d_issue"), """
  SELECT * FROM (
    WITH RECURSIVE c AS (
      SELECT k.*, i.event_id, i.user_id AS owner, i.status AS s0, i.valid_from AS vf, i.valid_to AS vt, i.issue_id IS NOT NULL AS found,
        i.used_at AS u0, i.canceled_at AS c0, row_number() OVER (PARTITION BY k.issue_id ORDER BY command_no) AS step
      FROM d_command k LEFT JOIN d_issue i ON i.issue_id = k.issue_id),
    r AS (SELECT *, CASE WHEN NOT found THEN 'ISSUE_NOT_FOUND' WHEN owner IS NULL OR owner <> user_id THEN 'INVALID_REQUEST'
        WHEN target_status = 'USED' AND vf > "at" THEN 'EVENT_NOT_OPEN' WHEN target_status IN ('USED', 'ISSUED') AND vt < "at" THEN 'ALREADY_EXPIRED' END AS refusal FROM c),
    w AS (
      SELECT *, s0 AS prev, CASE WHEN refusal IS NULL AND concat(s0, '>', target_status) IN ('ISSUED>USED', 'ISSUED>EXPIRED', 'USED>ISSUED') THEN target_status ELSE s0 END AS state FROM r WHERE step = 1
      UNION ALL
      SELECT r.*, w.state, CASE WHEN r.refusal IS NULL AND concat(w.state, '>', r.target_status) IN ('ISSUED>USED', 'ISSUED>EXPIRED', 'USED>ISSUED') THEN r.target_status ELSE w.state END
      FROM w JOIN r ON r.issue_id = w.issue_id AND r.step = w.step + 1)
    SELECT *, CASE WHEN refusal IS NOT NULL THEN refusal WHEN concat(prev, '>', target_status) IN ('ISSUED>USED', 'ISSUED>EXPIRED', 'USED>ISSUED') THEN 'SUCCESS'
      WHEN target_status = 'USED' AND prev = 'USED' THEN 'ALREADY_USED' WHEN target_status = 'ISSUED' AND prev = 'ISSUED' THEN 'NOT_YET_USED'
      WHEN target_status = 'EXPIRED' AND prev = 'EXPIRED' THEN 'ALREADY_EXPIRED' ELSE 'INVALID_STATE_TRANSITION' END AS result FROM w)
""")


@query("command_results", with_views("""
    SELECT command_no, issue_id, event_id, target_status, CASE WHEN refusal IS NULL THEN prev END AS previous_status, result FROM d_walk""", "d_walk"))
def command_results(spark, sf_dir):
    return commands.apply_commands(derived.issue(spark, sf_dir), _commands(spark, sf_dir))[2].select(
        "command_no", "issue_id", "event_id", "target_status", "previous_status", "result")


@query("command_history", with_views("""
    SELECT issue_id, prev AS from_status, target_status AS to_status, concat('USER_', CAST(user_id AS VARCHAR)) AS actor,
      CASE WHEN target_status = 'EXPIRED' THEN 'MANUAL_EXPIRED' ELSE coalesce(reason, CASE WHEN target_status = 'ISSUED' THEN 'USE_CANCELED' ELSE 'USED' END) END AS reason,
      "at" AS occurred_at, "at" AS recorded_at, event_uid FROM d_walk WHERE result = 'SUCCESS'""", "d_walk"))
def command_history(spark, sf_dir):
    return commands.apply_commands(derived.issue(spark, sf_dir), _commands(spark, sf_dir))[1]


@query("command_issue_updates", with_views("""
    WITH s AS (SELECT * FROM d_walk WHERE result = 'SUCCESS'),
    l AS (SELECT issue_id, arg_max(target_status, command_no) AS status, any_value(u0) AS u0, any_value(c0) AS c0 FROM s GROUP BY issue_id),
    m AS (SELECT issue_id, arg_max(target_status, command_no) AS kind, arg_max("at", command_no) AS "at" FROM s WHERE target_status <> 'EXPIRED' GROUP BY issue_id)
    SELECT l.issue_id, l.status, CASE WHEN m.kind IS NULL THEN u0 WHEN m.kind = 'USED' THEN m."at" END AS used_at,
      CASE WHEN m.kind IS NULL THEN c0 WHEN m.kind = 'ISSUED' THEN m."at" END AS canceled_at FROM l LEFT JOIN m ON m.issue_id = l.issue_id""", "d_walk"))
def command_issue_updates(spark, sf_dir):
    return commands.apply_commands(derived.issue(spark, sf_dir), _commands(spark, sf_dir))[0]


# The same walk with remembered keys: what a key's first success said answers its repeats, and refusals leave it free.
def _keyed(idem: str) -> str:
    moves = "('ISSUED>USED', 'ISSUED>EXPIRED', 'USED>ISSUED')"
    step = f"""r.refusal IS NULL AND r.seen IS NULL AND NOT list_contains(list_transform({{m}}, lambda x: x[1]), r.event_uid) AND concat({{s}}, '>', r.target_status) IN {moves}"""
    keep = "CASE WHEN {c} THEN list_append({m}, [r.event_uid, r.target_status]) ELSE {m} END"
    first, later = step.format(m="CAST([] AS VARCHAR[][])", s="r.s0"), step.format(m="w.mem", s="w.state")
    return f"""
  SELECT * FROM (
    WITH RECURSIVE idem AS ({idem}),
    c AS (
      SELECT k.*, i.event_id, i.user_id AS owner, i.status AS s0, i.valid_from AS vf, i.valid_to AS vt, i.issue_id IS NOT NULL AS found,
        CASE WHEN m.event_uid IS NULL THEN NULL WHEN NOT (m.issue_id = k.issue_id AND m.user_id = k.user_id AND m.target_status = k.target_status) THEN 'IDEMPOTENCY_CONFLICT'
          WHEN m.occurred_at IS NULL THEN 'DUPLICATE_REQUEST' ELSE 'REPLAY' END AS seen,
        row_number() OVER (PARTITION BY k.issue_id ORDER BY command_no) AS step
      FROM d_command k LEFT JOIN d_issue i ON i.issue_id = k.issue_id LEFT JOIN idem m ON m.event_uid = k.event_uid),
    r AS (SELECT *, CASE WHEN NOT found THEN 'ISSUE_NOT_FOUND' WHEN owner IS NULL OR owner <> user_id THEN 'INVALID_REQUEST'
        WHEN target_status = 'USED' AND vf > "at" THEN 'EVENT_NOT_OPEN' WHEN target_status IN ('USED', 'ISSUED') AND vt < "at" THEN 'ALREADY_EXPIRED' END AS refusal FROM c),
    w AS (
      SELECT r.*, s0 AS prev, CAST([] AS VARCHAR[][]) AS before, CASE WHEN {first} THEN target_status ELSE s0 END AS state,
        {keep.format(c=first, m="CAST([] AS VARCHAR[][])")} AS mem FROM r WHERE step = 1
      UNION ALL
      SELECT r.*, w.state, w.mem, CASE WHEN {later} THEN r.target_status ELSE w.state END, {keep.format(c=later, m="w.mem")}
      FROM w JOIN r ON r.issue_id = w.issue_id AND r.step = w.step + 1)
    SELECT *, CASE WHEN seen IS NOT NULL THEN seen WHEN list_contains(before, [event_uid, target_status]) THEN 'REPLAY'
        WHEN list_contains(list_transform(before, lambda x: x[1]), event_uid) THEN 'IDEMPOTENCY_CONFLICT' ELSE 'NEW' END AS replay,
      CASE WHEN refusal IS NOT NULL THEN refusal WHEN concat(prev, '>', target_status) IN {moves} THEN 'SUCCESS'
      WHEN target_status = 'USED' AND prev = 'USED' THEN 'ALREADY_USED' WHEN target_status = 'ISSUED' AND prev = 'ISSUED' THEN 'NOT_YET_USED'
      WHEN target_status = 'EXPIRED' AND prev = 'EXPIRED' THEN 'ALREADY_EXPIRED' ELSE 'INVALID_STATE_TRANSITION' END AS result FROM w)
"""


# Repeats of a key concern the same coupon in these views, so a walk per coupon meets all of them.
VIEWS["d_keyed"] = (("d_command", "d_issue"), _keyed("SELECT event_uid, issue_id, user_id, target_status, \"at\" AS occurred_at FROM d_command WHERE false"))
VIEWS["d_keyed_memory"] = (("d_command", "d_issue"), _keyed("""
    SELECT event_uid, issue_id, user_id, CASE WHEN command_no % 40 = 2 THEN 'EXPIRED' ELSE target_status END AS target_status,
      CASE WHEN command_no % 50 <> 2 THEN "at" END AS occurred_at FROM d_command WHERE command_no % 10 = 2 AND command_no % 8 <> 7"""))


@query("command_replay", with_views("SELECT command_no, replay, CASE WHEN replay = 'NEW' THEN result END AS result FROM d_keyed_memory", "d_keyed_memory"))
def command_replay(spark, sf_dir):
    cmds = kept(_commands(spark, sf_dir), "commands")
    n = F.col("command_no")
    idem = cmds.filter((n % 10 == 2) & (n % 8 != 7)).select(
        "event_uid", "issue_id", "user_id", F.when(n % 40 == 2, "EXPIRED").otherwise(F.col("target_status")).alias("target_status"),
        F.lit(None).cast("string").alias("from_status"), F.when(n % 50 != 2, F.col("at")).alias("occurred_at"))
    _, _, results, repeats = commands.run_commands(derived.issue(spark, sf_dir), cmds, idem)
    return results.select("command_no", F.lit("NEW").alias("replay"), "result").unionByName(
        repeats.select("command_no", "replay", F.lit(None).cast("string").alias("result")))


# --- masters ---------------------------------------------------------------------------

_PART = """SELECT p_partkey + 100 AS coupon_id, CASE WHEN p_partkey % 9 = 0 THEN '  ' WHEN p_partkey % 9 = 1 THEN repeat('x', 101) ELSE concat(' ', p_name) END AS coupon_name,
  CASE WHEN p_partkey % 9 <> 2 THEN p_type END AS type, CASE WHEN p_partkey % 9 = 3 THEN -1 ELSE p_partkey END AS value, CASE WHEN p_partkey % 9 = 4 THEN 0 ELSE p_size END AS valid_hours FROM part"""


def _coupon_cmds(spark, sf_dir):
    p = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        p.alias("command_no"), (p + 100).alias("coupon_id"),
        F.when(p % 9 == 0, "  ").when(p % 9 == 1, F.repeat(F.lit("x"), 101)).otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("coupon_name"),
        F.when(p % 9 != 2, F.col("p_type")).alias("type"), F.when(p % 9 == 3, F.lit(-1).cast("long")).otherwise(p).alias("value"),
        F.when(p % 9 == 4, 0).otherwise(F.col("p_size")).alias("valid_hours"))


@query("coupon_create", with_views(f"""
    SELECT coupon_id, coupon_name, type, value, valid_hours FROM d_coupon UNION ALL
    SELECT coupon_id, trim(coupon_name), type, value, valid_hours FROM ({_PART}) WHERE length(trim(coupon_name)) BETWEEN 1 AND 100
      AND type IS NOT NULL AND value >= 0 AND valid_hours > 0""", "d_coupon"))
def coupon_create(spark, sf_dir):
    return commands.create_coupons(derived.coupon(spark, sf_dir), _coupon_cmds(spark, sf_dir), MID)[0].drop("created_at")


@query("coupon_create_refused", f"""
    SELECT coupon_id, CASE WHEN NOT length(trim(coupon_name)) BETWEEN 1 AND 100 THEN 'INVALID_NAME' WHEN type IS NULL THEN 'MISSING_TYPE'
      WHEN value < 0 THEN 'INVALID_VALUE' ELSE 'INVALID_VALID_HOURS' END AS fault
    FROM ({_PART}) WHERE NOT (length(trim(coupon_name)) BETWEEN 1 AND 100 AND type IS NOT NULL AND value >= 0 AND valid_hours > 0)""")
def coupon_create_refused(spark, sf_dir):
    return commands.create_coupons(derived.coupon(spark, sf_dir), _coupon_cmds(spark, sf_dir), MID)[1].select("coupon_id", "fault")


VIEWS["d_roundcmd"] = ((), """
  SELECT p_partkey AS command_no, p_partkey % 6 + 1 AS coupon_id, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_size % 12 + 1 END AS INTEGER) AS round,
    CAST(CASE WHEN p_partkey % 37 = 5 THEN 0 ELSE p_size * 10 + p_partkey // 400 END AS BIGINT) AS total_stock,
    TIMESTAMP '2001-08-01' + (p_size % 5) * INTERVAL 10 DAY AS open_at, TIMESTAMP '2001-10-01' + (p_size % 3) * INTERVAL 1 DAY AS close_at FROM part
""")


@query("round_create", with_views("""
    WITH j AS (SELECT c.*, CASE WHEN NOT (open_at < close_at AND close_at > TIMESTAMP '2001-08-15' AND total_stock > 0) THEN 'INVALID_REQUEST'
        WHEN coupon_id NOT IN (SELECT coupon_id FROM d_coupon) THEN 'COUPON_NOT_FOUND' END AS fault FROM d_roundcmd c),
    e AS (SELECT coupon_id, round, total_stock, open_at, close_at, event_id FROM d_event),
    g AS (SELECT j.*, e.event_id, e.total_stock AS es, e.open_at AS eo, e.close_at AS ec, row_number() OVER w AS nth, first_value(j.total_stock) OVER w AS fs,
        first_value(j.open_at) OVER w AS fo, first_value(j.close_at) OVER w AS fc
      FROM j LEFT JOIN e ON e.coupon_id = j.coupon_id AND e.round = j.round WHERE fault IS NULL AND j.round IS NOT NULL
      WINDOW w AS (PARTITION BY j.coupon_id, j.round ORDER BY command_no)),
    g2 AS (SELECT *, CASE WHEN event_id IS NULL AND nth = 1 THEN 'CREATED'
        WHEN event_id IS NOT NULL AND es = total_stock AND eo = open_at AND ec = close_at THEN 'REUSED'
        WHEN event_id IS NULL AND fs = total_stock AND fo = open_at AND fc = close_at THEN 'REUSED' ELSE 'CONFIGURATION_CONFLICT' END AS outcome FROM g),
    placed AS (SELECT coupon_id, round, total_stock, open_at, close_at, 0 AS p, event_id AS n FROM e
      UNION ALL SELECT coupon_id, round, total_stock, open_at, close_at, 1, command_no FROM g2 WHERE outcome = 'CREATED'),
    alike AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coupon_id, total_stock, open_at, close_at ORDER BY p, n) AS k FROM placed) WHERE k = 1),
    top AS (SELECT coupon_id, max(round) AS t FROM placed GROUP BY coupon_id),
    o AS (SELECT j.*, a.round AS ar, min(command_no) OVER (PARTITION BY j.coupon_id, j.total_stock, j.open_at, j.close_at) AS fno
      FROM j LEFT JOIN alike a ON a.coupon_id = j.coupon_id AND a.total_stock = j.total_stock AND a.open_at = j.open_at AND a.close_at = j.close_at WHERE fault IS NULL AND j.round IS NULL),
    o2 AS (SELECT o.*, dense_rank() OVER (PARTITION BY coupon_id, ar IS NULL ORDER BY fno) AS step FROM o),
    res AS (SELECT command_no, coupon_id, outcome, CASE WHEN outcome <> 'CONFIGURATION_CONFLICT' THEN round END AS assigned_round, open_at FROM g2
      UNION ALL SELECT command_no, o2.coupon_id, CASE WHEN ar IS NULL AND command_no = fno THEN 'CREATED' ELSE 'REUSED' END, coalesce(ar, coalesce(t, 0) + step), open_at
        FROM o2 LEFT JOIN top ON top.coupon_id = o2.coupon_id
      UNION ALL SELECT command_no, coupon_id, fault, NULL, open_at FROM j WHERE fault IS NOT NULL)
    SELECT command_no, coupon_id, outcome, CAST(assigned_round AS INTEGER) AS assigned_round,
      CASE WHEN outcome = 'CREATED' THEN CASE WHEN open_at > TIMESTAMP '2001-08-15' THEN 'SCHEDULED' ELSE 'OPEN' END END AS status FROM res""", "d_roundcmd", "d_event", "d_coupon"))
def round_create(spark, sf_dir):
    t = derived.tables(spark, sf_dir)
    p, size = F.col("p_partkey"), F.col("p_size")
    cmds = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        p.alias("command_no"), (p % 6 + 1).alias("coupon_id"), F.when(p % 4 == 0, size % 12 + 1).alias("round"),
        F.when(p % 37 == 5, 0).otherwise(size * 10 + F.floor(p / 400)).cast("long").alias("total_stock"),
        plus(ts("2001-08-01 00:00:00"), size % 5 * 240, "HOUR").alias("open_at"), plus(ts("2001-10-01 00:00:00"), size % 3 * 24, "HOUR").alias("close_at"))
    return commands.create_rounds(t.event, t.coupon, cmds, MID)
