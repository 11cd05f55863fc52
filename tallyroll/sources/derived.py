"""Coupon-shaped views over the general test tables.

Each view is a narrow projection of one table (the campaign view adds one small
aggregate), so nothing here shuffles the facts. Faults are planted by remainder
so that every audit rule has rows to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroll.constants import ACTIVE_STATUSES
from tallyroll.functions.times import hours, plus, seconds, ts
from tallyroll.sources.ledger import Tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hash_uuid(prefix: str, key):
    h = F.md5(F.concat(F.lit(prefix), key.cast("string")))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def request_uuid(key):
    return _hash_uuid("req:", key)


def issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issued coupons from ``orders``; remainders of 101 plant one fault each."""
    o = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    k = key % 101
    ia = plus(F.col("o_orderdate").cast("timestamp_ntz"), key % 86400, "SECOND")
    status = (
        F.when(k == 2, "UNKNOWN")
        .when(k == 6, "CANCELED")
        .when(k.isin(9, 12), "USED")
        .when((F.col("o_orderpriority") == "5-LOW") & (key % 7 == 0), "CANCELED")
        .when(F.col("o_orderstatus") == "F", "USED")
        .when(F.col("o_orderstatus") == "P", "EXPIRED")
        .otherwise("ISSUED")
    )
    base = o.select(key.alias("key"), k.alias("k"), ia.alias("ia"), status.alias("status"), "o_custkey")
    key, k, ia = F.col("key"), F.col("k"), F.col("ia")
    columns = [
        (key + 1).alias("issue_id"),
        (key % 25 + 1).alias("event_id"),
        F.when(k == 7, F.lit(None)).otherwise(F.col("o_custkey") + 1).alias("user_id"),
        F.when(k == 8, F.lit(0)).otherwise(F.floor(key / 25) + 1).cast("long").alias("issue_sequence"),
        F.when(k == 1, F.concat(F.lit("INVALID-REQUEST-ID-"), (key + 1).cast("string")))
        .otherwise(request_uuid(key))
        .alias("request_id"),
        F.when(k == 10, F.lit("13:1755000000000-0"))
        .when(key % 3 == 0, F.lit(None))
        .otherwise(_hash_uuid("msg:", key))
        .alias("message_id"),
        "status",
        F.when(k != 11, ia).alias("issued_at"),
        ia.alias("valid_from"),
        F.when(k == 3, ia).otherwise(ia + hours(24)).alias("valid_to"),
        F.when(k == 9, F.lit(None))
        .when(k == 12, ia + hours(25))
        .when(F.col("status") == "USED", plus(ia, key % 20 + 1, "HOUR"))
        .alias("used_at"),
        F.when(k == 6, F.lit(None))
        .when(F.col("status") == "CANCELED", plus(ia, key % 5 + 1, "HOUR"))
        .alias("canceled_at"),
        F.when(k == 4, ia - seconds(6)).when(k == 5, ia - seconds(5)).otherwise(ia + seconds(1)).alias("created_at"),
    ]
    return base.select(*columns)


def history(issues: DataFrame) -> DataFrame:
    """Append-only ledger of the issue view: up to four rows per issue from one scan."""
    q = F.col("issue_id") % 103
    used = F.col("status") == "USED"
    expired = F.col("status") == "EXPIRED"
    canceled = F.col("status") == "CANCELED"
    vf, vt, ua = F.col("valid_from"), F.col("valid_to"), F.col("used_at")

    def row(slot: int, keep, from_status, to_status, at, reason):
        return F.when(
            keep,
            F.struct(
                F.lit(slot).cast("long").alias("slot"),
                F.lit(from_status).cast("string").alias("from_status"),
                to_status.alias("to_status"),
                at.alias("at"),
                reason.cast("string").alias("reason"),
            ),
        )

    none = F.lit(None).cast("string")
    move_to = F.when(used, "USED").when(expired, "EXPIRED").otherwise("CANCELED")
    move_at = (
        F.when(used, F.coalesce(ua, vf + hours(1)))
        .when(
            expired,
            F.when(q == 7, vt + seconds(1801)).when(q == 8, vt - hours(1)).when(q == 10, vt - seconds(1))
            .otherwise(vt + seconds(60)),
        )
        .otherwise(F.coalesce(F.col("canceled_at"), vf + hours(1)))
    )
    rows = F.array(
        row(1, q != 1, None, F.when(q == 12, "USED").otherwise("ISSUED"), vf, F.lit("ISSUE_CONFIRMED")),
        row(2, used | expired | canceled, "ISSUED", move_to, move_at,
            F.when(expired & (q == 8), "MANUAL_EXPIRED")),
        row(3, used & (q == 9), "USED", F.lit("ISSUED"), ua + seconds(600), F.lit("USE_CANCELED")),
        row(4, used & (q == 9), "ISSUED", F.lit("USED"), ua + seconds(1200), none),
        row(5, used & (q == 2), "ISSUED", F.lit("USED"), vf + hours(30), none),
        row(6, used & (q == 13), "USED", F.lit("EXPIRED"), vf + hours(40), none),
        row(7, (F.col("status") == "ISSUED") & (q == 14), "USED", F.lit("ISSUED"), vf + hours(2), none),
    )
    r = issues.select("issue_id", q.alias("q"), F.explode(F.array_compact(rows)).alias("r")).select(
        "issue_id", "q", "r.*"
    )
    q = F.col("q")
    later = F.col("from_status").isNotNull()
    occurred = F.when(q == 4, F.col("at") + seconds(5)).otherwise(F.col("at"))
    return r.select(
        (F.col("issue_id") * 10 + F.col("slot")).alias("history_id"),
        "issue_id",
        "from_status",
        F.when(later & (q == 3), "INVALID_STATUS").when(later & (q == 6), F.lit(None))
        .otherwise(F.col("to_status")).alias("to_status"),
        F.lit("SYSTEM").alias("actor"),
        "reason",
        occurred.alias("occurred_at"),
        F.when(q == 5, occurred - seconds(6)).when(q == 11, F.lit(None)).otherwise(occurred + seconds(1))
        .alias("recorded_at"),
        F.concat(F.lit("uid-"), (F.col("issue_id") * 10 + F.col("slot")).cast("string")).alias("event_uid"),
    )


def event(spark: SparkSession, sf_dir: str, issues: DataFrame) -> DataFrame:
    """Campaign rounds from ``nation`` with counters taken from the issue view."""
    active = (
        issues.filter(F.col("status").isin(*ACTIVE_STATUSES))
        .groupBy("event_id").agg(F.count(F.lit(1)).alias("active"))
    )
    n = F.col("n_nationkey").cast("long")
    rounds = _table(spark, sf_dir, "nation").select(
        n.alias("n"), (n + 1).alias("event_id"), F.col("n_regionkey").cast("long").alias("region"),
    )
    n = F.col("n")
    act = F.coalesce(F.col("active"), F.lit(0))
    remaining = n % 3 - F.when(n % 5 == 0, 1).otherwise(0)
    return rounds.join(active, "event_id", "left").select(
        "event_id",
        (F.col("region") + 1).alias("coupon_id"),
        (F.floor(n / 5) + 1).cast("int").alias("round"),
        ts("1995-01-01 00:00:00").alias("open_at"),
        plus(ts("2001-08-02 00:00:00"), n * 24, "HOUR").alias("close_at"),
        (act + n % 3).cast("long").alias("total_stock"),
        remaining.cast("long").alias("remaining_stock"),
        (act + F.when(n == 7, 1).otherwise(0)).cast("long").alias("issued_quantity"),
        F.lit(1).alias("per_user_limit"),
        F.when(n % 4 == 0, "CLOSED").when(n % 4 == 1, "SOLD_OUT").when(n % 4 == 2, "OPEN")
        .otherwise("SCHEDULED").alias("status"),
        plus(ts("1994-12-01 00:00:00"), n * 24, "HOUR").alias("created_at"),
        plus(ts("1994-12-01 00:00:00"), n * 24, "HOUR").alias("updated_at"),
    )


def coupon(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r_regionkey").cast("long")
    return _table(spark, sf_dir, "region").select(
        (r + 1).alias("coupon_id"),
        F.col("r_name").alias("coupon_name"),
        F.when(r % 2 == 0, "FIXED").otherwise("RATE").alias("type"),
        ((r + 1) * 1000).alias("value"),
        F.lit(24).alias("valid_hours"),
        plus(ts("1994-11-01 00:00:00"), r * 24, "HOUR").alias("created_at"),
    )


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    digits = F.lpad(c.cast("string"), 8, "0")
    return _table(spark, sf_dir, "customer").select(
        (c + 1).alias("user_id"),
        F.concat(F.regexp_replace(F.lower(F.col("c_name")), "#", ""), F.lit("@test.com")).alias("email"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("010-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 4)).alias("phone"),
        ts("1994-01-01 00:00:00").alias("created_at"),
    )


def state(events: DataFrame) -> DataFrame:
    """Live counters per campaign: one in five is missing, some disagree with the ledger."""
    e = F.col("event_id")
    return events.filter(e % 5 != 0).select(
        "event_id",
        "total_stock",
        (F.col("total_stock") - F.col("issued_quantity") + F.when(e % 7 == 0, 1).otherwise(0)
         - F.when(e % 6 == 0, 2).otherwise(0)).alias("remaining_stock"),
        (F.col("issued_quantity") - F.when(e % 11 == 0, 3).otherwise(0)).alias("confirmed_quantity"),
        F.when(e % 9 == 0, 4).otherwise(0).cast("long").alias("pending"),
        "open_at",
        "close_at",
        (F.col("close_at") + hours(168)).alias("expire_at"),
    )


def request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log from ``events``; one in twenty-four repeats an earlier request id."""
    e = F.col("event_id")
    key = F.when(e % 24 == 23, e - 6).otherwise(e)
    return _table(spark, sf_dir, "events").select(
        (e % 6 + 1).alias("campaign_id"),
        (F.col("user_id") + 1).alias("user_id"),
        request_uuid(key).alias("request_id"),
        F.col("ts").cast("timestamp_ntz").alias("arrived_at"),
        (e + 1).alias("arrival_no"),
    )


def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns from ``region`` with stock growing with ``customer``; campaign 6 has none."""
    stock = (
        _table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
        .join(_table(spark, sf_dir, "nation"), "n_nationkey")
        .groupBy("n_regionkey").agg(F.sum("c").alias("c"))
    )
    return _table(spark, sf_dir, "region").join(
        stock, F.col("r_regionkey") == F.col("n_regionkey"), "left"
    ).select(
        (F.col("r_regionkey").cast("long") + 1).alias("campaign_id"),
        (F.floor(F.coalesce(F.col("c"), F.lit(0)) / 5) + 1).cast("long").alias("total_stock"),
        ts("2024-01-02 00:00:00").alias("open_at"),
        ts("2024-01-29 00:00:00").alias("close_at"),
        ts("2024-02-05 00:00:00").alias("expire_at"),
    )


# Result names planted by remainder of nine.
_RESULTS = ("CALL_FAILED", "SKIPPED_UNVERIFIED", "SKIPPED_PERSISTED", "INTERNAL_WRITE_ERROR",
            "COMPENSATED", "CONFIRMED_NOW", "REQUEST_NOT_FOUND", "ALREADY_CONFIRMED")


def failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure ledger from the ``error`` events; request ids point at issues where one exists."""
    e = F.col("event_id")
    result = F.when(e % 9 == 0, F.lit(None).cast("string"))
    for i, name in enumerate(_RESULTS, start=1):
        result = result.when(e % 9 == i, name)
    stage = F.when(e % 4 == 0, "DB_INSERT").when(e % 4 == 1, "RELAY").when(e % 4 == 2, "COMPENSATE").otherwise("CONFIRM")
    at = F.col("ts").cast("timestamp_ntz")
    order_key = e * 3
    return _table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select(
        e.alias("failure_id"),
        (order_key % 25 + 1).alias("event_id"),
        (F.col("user_id") + 1).alias("user_id"),
        request_uuid(order_key).alias("request_id"),
        F.when(e % 2 == 0, (F.floor(order_key / 25) + 1).cast("long")).alias("issue_sequence"),
        stage.alias("failure_stage"),
        result.alias("compensation_result"),
        F.concat(F.lit("call by user"), F.col("user_id").cast("string"), F.lit("@test.com failed: "), F.col("props")).alias("error_message"),
        F.lit(None).cast("string").alias("incident_id"),
        at.alias("occurred_at"),
        F.when(e % 6 != 0, at + hours(1)).alias("last_attempt_at"),
        (e % 3).cast("int").alias("attempt_count"),
        F.when(e % 11 == 0, at + hours(2)).alias("resolved_at"),
        F.lit(None).cast("string").alias("resolved_by"),
        F.lit(None).cast("string").alias("resolve_reason"),
        F.lit(None).cast("string").alias("resolve_probe_result"),
    )


def request_state(requests_like: DataFrame) -> DataFrame:
    """Request life-cycle rows for the failure ledger's requests, one per request id."""
    f = F.col("failure_id")
    return requests_like.filter(f % 7 != 0).select(
        F.col("event_id").alias("campaign_id"),
        "request_id",
        F.when(f % 13 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(f % 5 == 4, 8).when(f % 10 == 3, 1).otherwise(0).cast("int").alias("code"),
        F.when(f % 5 == 4, 2).when(f % 10 == 3, 3).when(f % 5 == 1, 1).otherwise(0).cast("int").alias("lifecycle"),
        F.coalesce(F.col("issue_sequence"), F.lit(1)).alias("issue_sequence"),
        F.lit(0).cast("long").alias("remaining"),
        F.col("occurred_at").alias("decided_at"),
        F.col("occurred_at").alias("updated_at"),
    )


def stream_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw issue-stream entries from ``orders``, text only, with malformed ones, redeliveries and id clashes."""
    key = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    user_id = F.col("o_custkey") + 1
    at_least_once = F.explode(F.sequence(F.lit(1), F.when(key % 20 == 18, 2).otherwise(1)))
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", at_least_once.alias("delivery")).select(
        F.concat(s(F.lit(1755000000000) + F.when(key % 20 == 19, key - 1).otherwise(key)), F.lit("-0")).alias("entry_id"),
        F.when(key % 17 == 0, "COMPENSATE").otherwise("ISSUE").alias("type"),
        F.when(key % 31 == 1, F.lit("not-a-uuid")).when(key % 20 == 19, request_uuid(key - 1))
        .otherwise(request_uuid(key)).alias("requestId"),
        F.when(key % 31 == 2, F.lit("abc")).when(key % 17 == 0, F.lit(None))
        .when(key % 20 == 19, s((key - 1) % 25 + 1)).otherwise(s(key % 25 + 1)).alias("campaignId"),
        F.when(key % 31 == 3, F.lit("-4")).otherwise(s(user_id)).alias("userId"),
        s(F.floor((user_id - 1) / 8388608)).alias("bitmapSegmentId"),
        F.when(key % 31 == 4, F.lit("-1")).otherwise(s((user_id - 1) % 8388608)).alias("bitOffset"),
        F.when(key % 31 == 5, F.lit("0")).when(key % 20 == 19, s(F.floor((key - 1) / 25) + 1))
        .otherwise(s(F.floor(key / 25) + 1)).alias("issueSequence"),
        F.when(key % 31 == 6, F.lit(" ")).otherwise(s(F.lit(1755000000000) + key * 7)).alias("decidedAt"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The audit tables of one test folder."""
    issues = issue(spark, sf_dir)
    events = event(spark, sf_dir, issues)
    return Tables(
        issue=issues, history=history(issues), event=events, coupon=coupon(spark, sf_dir),
        user=user(spark, sf_dir), state=state(events), failure=failure(spark, sf_dir),
    )
