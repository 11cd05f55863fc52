"""First-come allocation of a limited quantity over a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroll.constants import (
    COMPENSATED, CONFIRMED, DECISION_ACCEPTED, DECISION_ALREADY_ISSUED, DECISION_CLOSED,
    DECISION_CORRUPTED_STATE, DECISION_IDEMPOTENCY_CONFLICT, DECISION_INVALID_ARGUMENT,
    DECISION_NOT_INITIALIZED, DECISION_NOT_OPEN, DECISION_PERSISTENCE_FAILED, DECISION_SOLD_OUT, PENDING,
    REQUEST_STATUS_BY_CODE, TERMINAL,
)
from tallyroll.functions.ids import bitmap_offset, bitmap_segment
from tallyroll.functions.text import label
from tallyroll.operators.reports import masked_users
from tallyroll.plans.segments import SEGMENT_ROWS, number_segment, ranked

_NONE = -1


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds ``valid``: positive ids of at most 19 digits and a request id of 1..128 characters without ``|``."""
    c = F.col
    token = F.length(c("request_id")).between(1, 128) & ~F.contains(c("request_id"), F.lit("|"))
    ok = (c("user_id") > 0) & (c("campaign_id") > 0) & token
    return requests.withColumn("valid", F.coalesce(ok, F.lit(False)))


def campaign_limits(campaigns: DataFrame) -> DataFrame:
    """Campaign limits with defaults for a campaign nobody has drawn from yet."""
    c = F.col
    have = set(campaigns.columns)
    stock = c("stock") if "stock" in have else c("total_stock")
    sequence = c("sequence") if "sequence" in have else F.lit(0).cast("long")
    expire = c("expire_at") if "expire_at" in have else F.lit(None).cast("timestamp_ntz")
    corrupt = ~F.coalesce(
        (c("total_stock") > 0) & (c("open_at") < c("close_at")) & (expire.isNull() | (c("close_at") < expire))
        & (stock >= 0) & (stock <= c("total_stock")) & (sequence >= 0),
        F.lit(False),
    )
    return campaigns.select(
        "campaign_id", stock.alias("stock"), sequence.alias("base_sequence"), "open_at", "close_at",
        corrupt.alias("corrupt"), F.lit(True).alias("known"),
    )


def allocate(
    requests: DataFrame, campaigns: DataFrame, remembered: DataFrame | None = None, holders: DataFrame | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Decide every request of a log as if it were replayed in ``arrival_no`` order.

    ``requests``: campaign_id, user_id, request_id, arrived_at, arrival_no (the unique log
    position). ``campaigns``: campaign_id, total_stock, open_at, close_at and optionally
    stock, sequence, expire_at. ``remembered`` holds earlier decisions (campaign_id, request_id,
    user_id, code, issue_sequence, remaining, decided_at) and ``holders`` users already served
    (campaign_id, user_id).

    Without give-back the replay has a closed form: the first request per id counts, a
    user's first request in the open window takes a place while places last, and everything
    else follows from that. Ranking runs inside log segments, so a campaign holding most of
    the log is spread over tasks. Adds code, issue_sequence, remaining and decided_at.
    """
    c = F.col
    rows = validate_requests(requests)
    valid = rows.filter("valid").drop("valid")
    facts = ["campaign_id", "request_id"]

    # The first request of each id decides; partial aggregation absorbs a much repeated id.
    firsts = (
        valid.groupBy(*facts).agg(F.min(F.struct("arrival_no", "user_id", "arrived_at")).alias("f"))
        .select(*facts, "f.*")
    )
    if remembered is not None:
        firsts = firsts.join(remembered.select(*facts), facts, "left_anti")
    firsts = firsts.join(campaign_limits(campaigns), "campaign_id", "left").withColumn(
        "gate",
        F.when(c("known").isNull(), DECISION_NOT_INITIALIZED).when(c("corrupt"), DECISION_CORRUPTED_STATE)
        .when(c("arrived_at") < c("open_at"), DECISION_NOT_OPEN).when(c("arrived_at") >= c("close_at"), DECISION_CLOSED),
    )

    # Candidates: each user's first request in the window, unless served before.
    candidates = (
        firsts.filter(c("gate").isNull()).groupBy("campaign_id", "user_id")
        .agg(F.min("arrival_no").alias("arrival_no"), F.first("stock").alias("stock"), F.first("base_sequence").alias("base_sequence"))
    )
    if holders is not None:
        candidates = candidates.join(holders.select("campaign_id", "user_id").distinct(), ["campaign_id", "user_id"], "left_anti")
    winners = ranked(
        candidates, ["campaign_id"], number_segment(c("arrival_no"), segment_rows), [c("arrival_no")], limit="stock", name="place"
    ).select("campaign_id", "user_id", c("arrival_no").alias("won_at"), "place")

    decided = firsts.join(winners, ["campaign_id", "user_id"], "left")
    served = c("won_at") < c("arrival_no")
    if holders is not None:
        held = holders.select("campaign_id", "user_id").distinct().withColumn("held", F.lit(True))
        decided = decided.join(held, ["campaign_id", "user_id"], "left")
        served = F.coalesce(c("held"), F.lit(False)) | F.coalesce(served, F.lit(False))
    decided = decided.withColumn(
        "code",
        F.when(c("gate").isNotNull(), c("gate")).when(c("won_at") == c("arrival_no"), DECISION_ACCEPTED)
        .when(served, DECISION_ALREADY_ISSUED).otherwise(DECISION_SOLD_OUT).cast("int"),
    )
    segment = number_segment(c("arrival_no"), segment_rows)
    segments = firsts.select("campaign_id", segment.alias("segment")).distinct()
    answers = _with_remaining(decided.withColumn("segment", segment), segments, winners, segment_rows)

    answer = F.struct("arrival_no", "user_id", "code", "issue_sequence", "remaining", "decided_at")
    answers = answers.select(*facts, answer.alias("a"))
    if remembered is not None:
        before = F.struct(
            F.lit(_NONE).cast("long").alias("arrival_no"), "user_id", c("code").cast("int").alias("code"),
            "issue_sequence", "remaining", "decided_at",
        )
        answers = answers.unionByName(remembered.select(*facts, before.alias("a")))
    out = rows.join(answers, facts, "left")

    # Repeats of an id get the first answer; the same id from another user is a conflict.
    # Answers that are never remembered are worked out again, with the same outcome.
    forgotten = c("a.code").isin(DECISION_NOT_INITIALIZED, DECISION_CORRUPTED_STATE)
    conflict = ~forgotten & (c("a.user_id") != c("user_id"))
    code = (
        F.when(~c("valid"), DECISION_INVALID_ARGUMENT).when(conflict, DECISION_IDEMPOTENCY_CONFLICT).otherwise(c("a.code"))
    )
    return out.select(
        "campaign_id", "user_id", "request_id", "arrived_at", "arrival_no",
        code.cast("int").alias("code"),
        F.when(c("valid") & ~conflict, c("a.issue_sequence")).alias("issue_sequence"),
        F.when(c("valid") & ~conflict, c("a.remaining")).alias("remaining"),
        F.when(c("valid"), F.when(forgotten, F.when(c("a.code") == DECISION_CORRUPTED_STATE, c("arrived_at"))).otherwise(c("a.decided_at")))
        .alias("decided_at"),
        F.coalesce(c("valid") & ~forgotten & (c("a.arrival_no") != c("arrival_no")), F.lit(False)).alias("repeated"),
    )


def _with_remaining(decided: DataFrame, segments: DataFrame, winners: DataFrame, segment_rows: int) -> DataFrame:
    """Sequence, and the stock each first request left or met.

    Places taken before a request are whole earlier segments, by a carried total, plus a
    running sum inside its own segment. Only one small row per segment is carried.
    """
    c = F.col
    before = Window.partitionBy("campaign_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        winners.withColumn("segment", number_segment(c("won_at"), segment_rows))
        .groupBy("campaign_id", "segment").agg(F.count(F.lit(1)).alias("n"))
    )
    carried = segments.join(taken, ["campaign_id", "segment"], "left").select(
        "campaign_id", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry")
    )
    accepted = c("code") == DECISION_ACCEPTED
    gone = c("code").isin(DECISION_NOT_INITIALIZED, DECISION_CORRUPTED_STATE)
    inside = Window.partitionBy("campaign_id", "segment").orderBy("arrival_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        decided.join(carried, ["campaign_id", "segment"])
        .withColumn("inside", F.count(F.when(accepted, 1)).over(inside))
        .select(
            "campaign_id", "request_id", "arrival_no", "user_id", "code",
            F.when(accepted, c("base_sequence") + c("place")).alias("issue_sequence"),
            F.when(~gone, c("stock") - c("carry") - c("inside")).alias("remaining"),
            c("arrived_at").alias("decided_at"),
        )
    )


def allocate_plain(requests: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Codes and sequences by one window per campaign: the small-data twin of :func:`allocate`, used to check it."""
    c = F.col
    by_id = Window.partitionBy("campaign_id", "request_id").orderBy("arrival_no")
    rows = validate_requests(requests).filter("valid").select(
        "*", F.row_number().over(by_id).alias("nth"), F.first("user_id").over(by_id).alias("first_user"),
        F.first("arrival_no").over(by_id).alias("first_no"),
    ).join(campaign_limits(campaigns), "campaign_id", "left")
    open_ = (c("arrived_at") >= c("open_at")) & (c("arrived_at") < c("close_at")) & c("known") & ~c("corrupt")
    firsts = rows.filter((c("nth") == 1) & open_)
    by_user = Window.partitionBy("campaign_id", "user_id").orderBy("arrival_no")
    by_campaign = Window.partitionBy("campaign_id").orderBy("arrival_no")
    winners = (
        firsts.withColumn("mine", F.row_number().over(by_user)).filter(c("mine") == 1)
        .withColumn("place", F.row_number().over(by_campaign)).filter(c("place") <= c("stock"))
        .select("campaign_id", "user_id", c("arrival_no").alias("won_at"), (c("base_sequence") + c("place")).alias("place"))
    )
    first = (
        rows.filter(c("nth") == 1).join(winners, ["campaign_id", "user_id"], "left")
        .withColumn(
            "code",
            F.when(c("known").isNull(), DECISION_NOT_INITIALIZED).when(c("corrupt"), DECISION_CORRUPTED_STATE)
            .when(c("arrived_at") < c("open_at"), DECISION_NOT_OPEN).when(c("arrived_at") >= c("close_at"), DECISION_CLOSED)
            .when(c("won_at") == c("arrival_no"), DECISION_ACCEPTED).when(c("won_at") < c("arrival_no"), DECISION_ALREADY_ISSUED)
            .otherwise(DECISION_SOLD_OUT),
        ).select("campaign_id", "request_id", "code", F.when(c("code") == DECISION_ACCEPTED, c("place")).alias("issue_sequence"))
    )
    conflict = (c("first_user") != c("user_id")) & ~c("code").isin(DECISION_NOT_INITIALIZED, DECISION_CORRUPTED_STATE)
    return rows.join(first, ["campaign_id", "request_id"]).select(
        "arrival_no", F.when(conflict, DECISION_IDEMPOTENCY_CONFLICT).otherwise(c("code")).cast("int").alias("code"),
        F.when(~conflict, c("issue_sequence")).alias("issue_sequence"),
    )


def to_stream_entries(decisions: DataFrame) -> DataFrame:
    """Accepted decisions as the text-only entries the storing side reads."""
    text = lambda col: col.cast("string")
    c = F.col
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return decisions.filter((c("code") == DECISION_ACCEPTED) & ~c("repeated")).select(
        F.concat(text(c("arrival_no")), F.lit("-0")).alias("entry_id"),
        F.lit("ISSUE").alias("type"), c("request_id").alias("requestId"), text(c("campaign_id")).alias("campaignId"),
        text(c("user_id")).alias("userId"), text(bitmap_segment(c("user_id"))).alias("bitmapSegmentId"),
        text(bitmap_offset(c("user_id"))).alias("bitOffset"), text(c("issue_sequence")).alias("issueSequence"),
        text(F.timestamp_diff("MILLISECOND", epoch, c("decided_at"))).alias("decidedAt"),
    )


def to_request_state(decisions: DataFrame) -> DataFrame:
    """Remembered request records of a decided log, one per (campaign, request id)."""
    c = F.col
    kept = decisions.filter(~c("repeated") & (c("code") <= DECISION_CLOSED))
    return kept.select(
        "campaign_id", "request_id", "user_id", "code",
        F.when(c("code") == DECISION_ACCEPTED, PENDING).otherwise(TERMINAL).alias("lifecycle"),
        "issue_sequence", "remaining", "decided_at", c("decided_at").alias("updated_at"),
    )


def state_status(code: Column, lifecycle: Column) -> Column:
    """Status shown for a request record; NULL when the pair may not occur."""
    return (
        F.when((code == DECISION_ACCEPTED) & (lifecycle == PENDING), "ACCEPTED")
        .when((code == DECISION_ACCEPTED) & (lifecycle == CONFIRMED), "ISSUED")
        .when((code == DECISION_PERSISTENCE_FAILED) & (lifecycle == COMPENSATED), "COMPENSATED")
        .when(lifecycle == TERMINAL, label(code, REQUEST_STATUS_BY_CODE))
    )


def request_status(lookups: DataFrame, state: DataFrame, user: DataFrame) -> DataFrame:
    """Status of requests by (campaign, request id) with the user's data masked."""
    found = lookups.select("campaign_id", "request_id").join(state, ["campaign_id", "request_id"], "left")
    status = F.when(F.col("code").isNull(), "NOT_FOUND").otherwise(
        F.coalesce(state_status(F.col("code"), F.col("lifecycle")), F.lit("UNREADABLE"))
    )
    return found.withColumn("status", status).join(masked_users(user), "user_id", "left").select(
        "campaign_id", "request_id", "user_id", "issue_sequence", "remaining", "status", "decided_at", "name", "email", "phone"
    )


