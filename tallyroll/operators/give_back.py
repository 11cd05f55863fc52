"""Allocation with give-backs: requests and give-backs of a log answered as if replayed one by one.

A request that meets an open campaign is served if its user holds nothing and a place is left. Which user holds
something follows from the served requests before it, and the places left follow from served requests and give-backs: a
stock that never falls below zero, whose moves compose (:func:`tallyroll.plans.segments.running_stock`). Both are running
values over the log, cut into segments. So the served requests are the one assignment that reproduces itself; it is
found by working out holders and stock from an assumed one until nothing changes. Every pass settles the log at least up
to the first place where the assumption was wrong, hence to the next point where a sold-out campaign serves somebody
again or a user who was thought to be served isn't; requests before the first sell-out are right from the first pass on.
What is assumed first sets how many passes there are, not where they end: one settles the log's first place, the next one the
second, and so on, so that only one assignment reproduces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroll.constants import (
    COMPENSATED, DECISION_ACCEPTED, DECISION_ALREADY_ISSUED, DECISION_CLOSED, DECISION_CORRUPTED_STATE, DECISION_IDEMPOTENCY_CONFLICT,
    DECISION_INVALID_ARGUMENT, DECISION_NOT_INITIALIZED, DECISION_NOT_OPEN, DECISION_PERSISTENCE_FAILED, DECISION_SOLD_OUT, PENDING, TERMINAL,
)
from tallyroll.operators.allocation import campaign_limits, validate_requests
from tallyroll.plans.segments import SEGMENT_ROWS, number_segment, ranked, running_max_before, running_stock
from tallyroll.plans.staging import cut, if_small

REQUEST_KIND, GIVE_BACK_KIND = "REQUEST", "COMPENSATE"
#: Later than every log number; earlier than every log number.
NEVER, BEFORE = (1 << 63) - 1, -1
_KEY = ["campaign_id", "request_id"]


def _sold_out(asked: DataFrame, settled: DataFrame, start: DataFrame, segment_rows: int) -> DataFrame:
    """``sold_no`` of each campaign: the first segment that those who ask before it, less what they give back, leave no stock for."""
    c = F.col
    across = Window.partitionBy("campaign_id").orderBy("sold_no").rowsBetween(Window.unboundedPreceding, -1)
    asking = asked.filter("asks")
    moves = asking.select("campaign_id", c("no").alias("at"), F.lit(1).alias("taken")).unionByName(
        asking.filter("back_no is not null").select("campaign_id", c("back_no").alias("at"), F.lit(-1).alias("taken"))).unionByName(
        settled.select("campaign_id", c("back_no").alias("at"), F.lit(-1).alias("taken")))
    taken = moves.groupBy("campaign_id", number_segment(c("at"), segment_rows).alias("sold_no")).agg(F.sum("taken").alias("taken"))
    gone = taken.withColumn("gone", F.coalesce(F.sum("taken").over(across), F.lit(0))).join(start, "campaign_id").filter(c("gone") >= c("stock"))
    return if_small(cut(gone.groupBy("campaign_id").agg(F.min("sold_no").alias("sold_no"))))


def _served(attempts: DataFrame, settled: DataFrame, limits: DataFrame, segment_rows: int) -> DataFrame:
    """The stock's moves in log order: attempts with ``served``, and give-backs that took place.

    ``attempts``: campaign_id, user_id, no, gate (a code, where the answer doesn't hang on the stock), back_no (its give-back, if
    any), held_to (the user holds something from before, up to that number). ``settled``: give-backs of earlier requests.
    """
    c = F.col
    start = limits.select("campaign_id", "stock")
    user = ["campaign_id", "user_id"]
    # One user's attempts meet in a task, unless somebody made more than a segment holds.
    crowded = not attempts.groupBy(*user).agg(F.count(F.lit(1)).alias("n")).filter(c("n") > segment_rows).isEmpty()
    before = Window.partitionBy(*user).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)

    def asking(now: DataFrame) -> DataFrame:
        """Attempts with ``asks``: no gate, and the user holds nothing then if ``served`` is right."""
        busy = F.when(c("served"), F.coalesce("back_no", F.lit(NEVER)))
        if crowded:
            rows = running_max_before(now, user, "no", busy, "busy_to", segment_rows)
        else:
            rows = now.filter(c("no").isNotNull()).withColumn("busy_to", F.max(busy).over(before))
        free = ~(F.greatest(F.coalesce("busy_to", F.lit(BEFORE)), F.coalesce("held_to", F.lit(BEFORE))) > c("no"))
        return rows.withColumn("asks", c("gate").isNull() & free).drop("busy_to")

    # Assumed first: whoever asks is served up to where the stock runs out by that, and nobody after it.
    asked = cut(asking(attempts.withColumn("served", c("gate").isNull())).drop("served"))
    now = asked.join(_sold_out(asked, settled, start, segment_rows), "campaign_id", "left").withColumn(
        "served", c("asks") & F.coalesce(c("no") < c("sold_no"), F.lit(True))).select(attempts.columns + ["served"])
    while True:
        tried = asking(now).withColumn("was", c("served")).withColumn("delta", F.when(c("asks"), -1).otherwise(0))
        backs = now.filter(c("served") & c("back_no").isNotNull()).select("campaign_id", c("back_no").alias("no"), F.lit(1).alias("delta")).unionByName(
            settled.select("campaign_id", c("back_no").alias("no"), F.lit(1).alias("delta")))
        moves = tried.drop("served").unionByName(backs, allowMissingColumns=True)
        moves = running_stock(moves, ["campaign_id"], "no", start, segment_rows).withColumn("served", c("asks") & (c("before") > 0))
        if moves.filter("served <> was").isEmpty():
            return moves
        now = moves.filter("asks is not null").select(attempts.columns + ["served"])


def answer_commands(commands: DataFrame, state: DataFrame, records: DataFrame, holders: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Answers to requests and give-backs in the order of ``arrival_no``, from the state before them.

    ``commands``: kind (REQUEST or COMPENSATE), campaign_id, user_id, request_id, arrived_at, arrival_no. ``state``: campaigns with
    stock and sequence. ``records``: campaign_id, request_id, user_id, code, lifecycle, issue_sequence, remaining, decided_at of earlier
    requests. ``holders``: campaign_id, user_id that hold something. A give-back has ``result`` and ``restored``, a request ``code``,
    ``issue_sequence``, ``remaining``, ``decided_at`` and ``repeated``.
    """
    c = F.col
    rows = cut(validate_requests(commands))
    # One row a campaign: kept and sent to the rows, which would otherwise meet in a task a campaign.
    limits = if_small(cut(campaign_limits(state)))

    # The first valid request of an id that isn't remembered decides, in campaigns that can decide at all.
    first = rows.filter((c("kind") == REQUEST_KIND) & c("valid")).join(records.select(*_KEY), _KEY, "left_anti").groupBy(*_KEY).agg(
        F.min(F.struct("arrival_no", "user_id", "arrived_at")).alias("f")).select(*_KEY, c("f.arrival_no").alias("no"), "f.user_id", "f.arrived_at")
    first = first.join(limits.filter(~c("corrupt")).select("campaign_id", "open_at", "close_at"), "campaign_id").withColumn(
        "gate", F.when(c("arrived_at") < c("open_at"), DECISION_NOT_OPEN).when(c("arrived_at") >= c("close_at"), DECISION_CLOSED)).drop("open_at", "close_at")
    first = cut(first)
    known = first.select(*_KEY, "user_id", "no").unionByName(records.select(*_KEY, "user_id", F.lit(BEFORE).cast("long").alias("no")))
    backs = rows.filter(c("kind") == GIVE_BACK_KIND).select(*_KEY, "user_id", "arrival_no").join(known, [*_KEY, "user_id"]).filter(
        c("arrival_no") > c("no")).groupBy(*_KEY).agg(F.min("arrival_no").alias("back_no"))
    open_record = (c("code") == DECISION_ACCEPTED) & (c("lifecycle") == PENDING)
    settled = cut(records.filter(open_record).join(backs, _KEY).select(*_KEY, "user_id", "back_no"))
    freed = settled.groupBy("campaign_id", "user_id").agg(F.min("back_no").alias("freed_no"))
    held = holders.select("campaign_id", "user_id").distinct().join(freed, ["campaign_id", "user_id"], "left").select(
        "campaign_id", "user_id", F.coalesce("freed_no", F.lit(NEVER)).alias("held_to"))
    attempts = cut(first.join(backs, _KEY, "left").join(held, ["campaign_id", "user_id"], "left"))

    # Passes move narrow rows; ids and times come back at the end.
    ref = F.xxhash64("request_id").alias("ref")
    moves = _served(attempts.select("campaign_id", "user_id", "no", ref, "gate", "back_no", "held_to"), settled, limits, segment_rows)
    tried = moves.filter("asks is not null").drop("back_no").join(
        attempts.select("campaign_id", "no", ref, "request_id", "arrived_at", "back_no"), ["campaign_id", "no", "ref"])
    places = ranked(
        tried.filter("served").select("campaign_id", "no"), ["campaign_id"], number_segment(c("no"), segment_rows), [c("no")], name="place"
    ).join(limits.select("campaign_id", "base_sequence"), "campaign_id").select("campaign_id", "no", (c("base_sequence") + c("place")).alias("issue_sequence"))
    restored = moves.filter("asks is null").select("campaign_id", c("no").alias("back_no"), c("after").alias("restored"))
    decided = tried.join(places, ["campaign_id", "no"], "left").select(
        *_KEY, "user_id", "no",
        F.coalesce("gate", F.when(c("served"), DECISION_ACCEPTED).when(c("asks"), DECISION_SOLD_OUT).otherwise(DECISION_ALREADY_ISSUED)).cast("int").alias("code"),
        F.when(c("served"), PENDING).otherwise(TERMINAL).cast("int").alias("lifecycle"), "issue_sequence", c("after").alias("remaining"),
        c("arrived_at").alias("decided_at"), F.when(c("served"), c("back_no")).alias("back_no"))
    earlier = records.join(settled.select(*_KEY, "back_no"), _KEY, "left").select(
        *_KEY, "user_id", F.lit(BEFORE).cast("long").alias("no"), "code", "lifecycle", "issue_sequence", "remaining", "decided_at", "back_no")
    memory = decided.unionByName(earlier).join(restored, ["campaign_id", "back_no"], "left").select(
        *_KEY, F.struct("user_id", "no", "code", "lifecycle", "issue_sequence", "remaining", "decided_at", "back_no", "restored").alias("m"))

    out = rows.join(memory, _KEY, "left").join(limits.select("campaign_id", "known", "corrupt"), "campaign_id", "left")
    at, request = c("arrival_no"), c("kind") == REQUEST_KIND
    there = c("m").isNotNull() & (c("m.no") <= at)
    mine = there & (c("m.user_id") == c("user_id"))
    returned = F.coalesce(c("m.back_no") < at, F.lit(False))
    remembered = request & c("valid") & there
    forgotten = request & c("valid") & ~there
    code = (
        F.when(~request, None).when(~c("valid"), DECISION_INVALID_ARGUMENT).when(there & ~mine, DECISION_IDEMPOTENCY_CONFLICT)
        .when(there & returned, DECISION_PERSISTENCE_FAILED).when(there, c("m.code")).when(c("known").isNull(), DECISION_NOT_INITIALIZED)
        .otherwise(DECISION_CORRUPTED_STATE))
    result = (
        F.when(request, None).when(~there, "REQUEST_NOT_FOUND").when(~mine, "INVALID_ARGUMENT").when(c("m.back_no") == at, "COMPENSATED")
        .when(returned | ((c("m.code") == DECISION_PERSISTENCE_FAILED) & (c("m.lifecycle") == COMPENSATED)), "ALREADY_COMPENSATED")
        .otherwise("NOT_COMPENSABLE"))
    told = remembered & mine
    return out.select(
        "campaign_id", "user_id", "request_id", "arrived_at", "arrival_no", code.cast("int").alias("code"),
        F.when(told, c("m.issue_sequence")).cast("long").alias("issue_sequence"),
        F.when(told, F.when(returned, c("m.restored")).otherwise(c("m.remaining"))).cast("long").alias("remaining"),
        F.when(remembered, c("m.decided_at")).when(forgotten & c("known").isNotNull(), c("arrived_at")).alias("decided_at"),
        F.coalesce(remembered & (c("m.no") < at), F.lit(False)).alias("repeated"), result.alias("result"),
        F.when(~request & (result == "COMPENSATED"), c("m.restored")).cast("long").alias("restored"))
