"""User commands on coupons (use, cancel a use, expire), coupon masters and campaign rounds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroll.constants import EXPIRED, ISSUED, OPEN, REASON_MANUAL_EXPIRED, SCHEDULED, USED
from tallyroll.functions.times import ts
from tallyroll.plans.segments import number_segment, ranked, spread
from tallyroll.plans.staging import cut, kept


_CONTENT = ("issue_id", "user_id", "target_status")


def replay_commands(cmds: DataFrame, idempotency: DataFrame) -> DataFrame:
    """Hold commands against the remembered keys.

    ``cmds``: event_uid, command_no, issue_id, user_id, target_status. A remembered key with the same content gets
    the earlier answer (REPLAY), or DUPLICATE_REQUEST while that one is unfinished; other content is an
    IDEMPOTENCY_CONFLICT. Commands of keys nobody remembers are NEW.
    """
    c = F.col
    stored = idempotency.select("event_uid", F.struct(*_CONTENT).alias("stored"), c("occurred_at").alias("stored_at"))
    return cmds.join(stored, "event_uid", "left").withColumn("replay", _replay()).drop("stored", "stored_at")


def _replay():
    c = F.col
    return (
        F.when(c("stored").isNull(), "NEW").when(c("stored") != F.struct(*_CONTENT), "IDEMPOTENCY_CONFLICT")
        .when(c("stored_at").isNull(), "DUPLICATE_REQUEST").otherwise("REPLAY"))


def _judged(cmds: DataFrame, idempotency: DataFrame) -> DataFrame:
    """As :func:`replay_commands`, with ``first``: the first command of a key that several commands have and nobody remembers.

    Keys are counted in narrow rows and held against the remembered ones there; whole commands are shuffled once, to the few keys that matter.
    """
    c = F.col
    stored = idempotency.select("event_uid", F.struct(*_CONTENT).alias("stored"), c("occurred_at").alias("stored_at"))
    keys = cmds.groupBy("event_uid").agg(F.count(F.lit(1)).alias("n"), F.min("command_no").alias("first")).join(stored, "event_uid", "left")
    keys = keys.filter((c("n") > 1) | c("stored").isNotNull()).withColumn("first", F.when(c("stored").isNull(), c("first"))).drop("n")
    return cmds.join(keys, "event_uid", "left").withColumn("replay", _replay()).drop("stored", "stored_at")


def run_commands(issue: DataFrame, cmds: DataFrame, idempotency: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Commands one after the other, keys remembered once a command has succeeded.

    Returns issue updates, history rows and results of the commands that were tried, and the others with their
    ``replay``. A refused command leaves its key free, so a later one with that key is tried.

    Whether a command is tried depends on what earlier ones of its key achieved, and that on the coupons. Starting with the first
    command of each key, a round tries the commands up to the first success known so far. The first n decisions are final
    after n rounds, and a round that changes nothing ends it. Only coupons which a key with several commands touches are looked
    at again after the first round; what it found for the others stays.
    """
    c = F.col
    judged = kept(_judged(cmds, idempotency), "judged")
    open_ = judged.filter(c("replay") == "NEW").drop("replay", "first")
    contested = judged.filter((c("replay") == "NEW") & c("first").isNotNull()).drop("replay")
    untried = contested.filter(c("command_no") > c("first")).select("command_no")
    ids = cut(contested.select("issue_id").distinct())
    tried = judged.filter((c("replay") == "NEW") & ~F.coalesce(c("command_no") > c("first"), F.lit(False))).select(cmds.columns)
    if ids.isEmpty():
        results = kept(_outcomes(issue, tried), "results")
        late = open_.limit(0).withColumn("replay", F.lit(None).cast("string"))
    else:
        shared = F.coalesce("shared", F.lit(False))
        found = kept(_outcomes(issue, tried).join(ids.withColumn("shared", F.lit(True)), "issue_id", "left").withColumn("shared", shared), "results")
        results = found.filter(c("shared")).drop("shared")
        # The other commands of the shared coupons are tried in every round; contested ones up to the first success of their key.
        others = kept(results.select(cmds.columns).join(contested.select("event_uid").distinct(), "event_uid", "left_anti").select(cmds.columns), "others")
        coupons = cut(issue.join(ids, "issue_id", "left_semi"))
        untried = cut(untried)
        while True:
            won = results.filter(c("result") == "SUCCESS").select("event_uid", "command_no").join(
                contested.select("event_uid").distinct(), "event_uid", "left_semi").groupBy("event_uid").agg(F.min("command_no").alias("won"))
            after = cut(contested.join(won, "event_uid").filter(c("command_no") > c("won")).select("command_no"))
            if after.exceptAll(untried).isEmpty() and untried.exceptAll(after).isEmpty():
                break
            untried = after
            tried = contested.select(cmds.columns).join(untried, "command_no", "left_anti").select(cmds.columns)
            results = kept(_outcomes(coupons, others.unionByName(tried)), "results")
        results = found.filter(~c("shared")).drop("shared").unionByName(results)
        answers = results.filter(c("result") == "SUCCESS").select("event_uid", F.struct(*_CONTENT).alias("stored"))
        late = contested.drop("first").join(untried, "command_no", "left_semi").join(answers, "event_uid").withColumn(
            "replay", F.when(c("stored") != F.struct(*_CONTENT), "IDEMPOTENCY_CONFLICT").otherwise("REPLAY")).drop("stored")
    columns = [*cmds.columns, "replay"]
    repeats = judged.filter(c("replay") != "NEW").select(columns).unionByName(late.select(columns))
    return _updates(issue, results), _history(results), results, repeats


#: Commands of one coupon that one task takes; more are taken in segments of the log.
CROWD_ROWS = 100_000


def apply_commands(issue: DataFrame, cmds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run commands in ``command_no`` order. Returns issue updates, history rows and results.

    ``cmds``: command_no, event_uid, issue_id, user_id, target_status, reason, at.
    """
    results = _outcomes(issue, kept(cmds, "commands"))
    return _updates(issue, results), _history(results), results


def _outcomes(issue: DataFrame, cmds: DataFrame) -> DataFrame:
    """Results of commands. ``cmds`` is read twice.

    While a coupon is live its status is decided by the last admissible use or cancel before, so a running last value gives the
    status each command meets; the first expiry that meets ISSUED ends the coupon. Commands and coupons are shuffled once, by
    coupon. Coupons with very many commands are counted out before and spread over tasks.
    """
    crowded = cut(cmds.groupBy("issue_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD_ROWS).select("issue_id"))
    if crowded.isEmpty():
        return _results(_met(_refused(issue, cmds)))
    ids = F.broadcast(crowded.withColumnRenamed("issue_id", "_id"))
    on = cmds["issue_id"].eqNullSafe(F.col("_id"))
    few, many = cmds.join(ids, on, "left_anti"), cmds.join(ids, on, "left_semi")
    return _results(_met(_refused(issue, few))).unionByName(_results(_met_in_segments(_refused(issue, many))))


def _refused(issue: DataFrame, cmds: DataFrame) -> DataFrame:
    """Commands with their coupon, why they are refused whatever status they meet, and the status they leave if they aren't."""
    c = F.col
    no = F.lit(False)
    known = issue.select(
        "issue_id", "event_id", c("user_id").alias("owner"), "status", "valid_from", "valid_to"
    ).withColumn("found", F.lit(True))
    rows = cmds.join(known, "issue_id", "left")
    target, at = c("target_status"), c("at")
    early = F.coalesce((target == USED) & (c("valid_from") > at), no)
    late = F.coalesce(target.isin(USED, ISSUED) & (c("valid_to") < at), no)
    mine = F.coalesce(c("owner") == c("user_id"), no)
    rows = rows.withColumn(
        "refusal",
        F.when(c("found").isNull(), "ISSUE_NOT_FOUND").when(~mine, "INVALID_REQUEST")
        .when(early, "EVENT_NOT_OPEN").when(late, "ALREADY_EXPIRED"),
    )
    return rows.withColumn("mark", F.when(c("refusal").isNull() & target.isin(USED, ISSUED), target)).withColumn(
        "live", c("status").isin(ISSUED, USED)).drop("owner", "valid_from", "valid_to", "found")


def _ends_it():
    """Whether a command expires its coupon, if none before did."""
    c = F.col
    return c("live") & c("refusal").isNull() & (c("target_status") == EXPIRED) & (c("meets") == ISSUED)


def _met(rows: DataFrame) -> DataFrame:
    """The status each command meets while its coupon lives, and the command that ends it; a coupon's commands in one task."""
    c = F.col
    # Commands without a number have no place in the order: they meet each other only.
    inside = Window.partitionBy("issue_id", c("command_no").isNull()).orderBy("command_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("meets", F.coalesce(F.last("mark", ignorenulls=True).over(inside), c("status")))
    return rows.withColumn("ended_no", F.min(F.when(_ends_it(), c("command_no"))).over(Window.partitionBy("issue_id")))


def _met_in_segments(rows: DataFrame) -> DataFrame:
    """As :func:`_met`: the running value is taken inside segments of the log and carried over them."""
    c = F.col
    rows = rows.withColumn("segment", number_segment(c("command_no")))
    inside = Window.partitionBy("issue_id", "segment").orderBy("command_no").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("issue_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        rows.filter(c("mark").isNotNull()).groupBy("issue_id", "segment")
        .agg(F.max(F.struct("command_no", "mark"))["mark"].alias("end"))
    )
    # Every segment of an issue needs its carry, also those without a mark of their own.
    carried = (
        rows.select("issue_id", "segment").distinct().join(ends, ["issue_id", "segment"], "left")
        .withColumn("carry", F.last("end", ignorenulls=True).over(before)).drop("end")
    )
    rows = spread(rows.join(carried, ["issue_id", "segment"], "left"), "issue_id", "segment").withColumn(
        "meets", F.coalesce(F.last("mark", ignorenulls=True).over(inside), c("carry"), c("status"))
    )
    ended = rows.filter(_ends_it()).groupBy("issue_id").agg(F.min("command_no").alias("ended_no"))
    return rows.join(ended, "issue_id", "left")


def _results(rows: DataFrame) -> DataFrame:
    c = F.col
    target = c("target_status")
    prev = F.when(~c("live"), c("status")).when(c("command_no") > c("ended_no"), EXPIRED).otherwise(c("meets"))
    rows = rows.withColumn("previous_status", prev)
    prev = c("previous_status")
    allowed = (
        ((prev == ISSUED) & target.isin(USED, EXPIRED)) | ((prev == USED) & (target == ISSUED))
    )
    result = (
        F.when(c("refusal").isNotNull(), c("refusal")).when(allowed, "SUCCESS")
        .when((target == USED) & (prev == USED), "ALREADY_USED")
        .when((target == ISSUED) & (prev == ISSUED), "NOT_YET_USED")
        .when((target == EXPIRED) & (prev == EXPIRED), "ALREADY_EXPIRED")
        .otherwise("INVALID_STATE_TRANSITION")
    )
    return rows.withColumn("result", result).select(
        "command_no", "event_uid", "issue_id", "event_id", "user_id", "target_status", "reason", "at",
        F.when(c("refusal").isNull(), prev).alias("previous_status"), "result",
    )


def _history(results: DataFrame) -> DataFrame:
    c = F.col
    target, at = c("target_status"), c("at")
    reason = F.when(target == EXPIRED, REASON_MANUAL_EXPIRED).otherwise(
        F.coalesce(c("reason"), F.when(target == ISSUED, "USE_CANCELED").otherwise("USED"))
    )
    return results.filter(c("result") == "SUCCESS").select(
        "issue_id", c("previous_status").alias("from_status"), target.alias("to_status"),
        F.concat(F.lit("USER_"), c("user_id").cast("string")).alias("actor"), reason.alias("reason"),
        at.alias("occurred_at"), at.alias("recorded_at"), "event_uid",
    )


def _updates(issue: DataFrame, results: DataFrame) -> DataFrame:
    c = F.col
    target = c("target_status")
    last = results.filter(c("result") == "SUCCESS").groupBy("issue_id").agg(
        F.max(F.struct("command_no", "target_status"))["target_status"].alias("status"),
        F.max(F.when(target != EXPIRED, F.struct("command_no", "target_status", "at"))).alias("move"),
    )
    times = issue.select("issue_id", "used_at", "canceled_at").join(last, "issue_id")
    moved = c("move").isNotNull()
    return times.select(
        "issue_id", "status",
        F.when(moved, F.when(c("move.target_status") == USED, c("move.at"))).otherwise(c("used_at")).alias("used_at"),
        F.when(moved, F.when(c("move.target_status") == ISSUED, c("move.at"))).otherwise(c("canceled_at")).alias("canceled_at"),
    )


def create_coupons(coupon: DataFrame, cmds: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """New coupon masters and the refused commands.

    ``cmds``: command_no, coupon_id, coupon_name, type, value, valid_hours.
    """
    c = F.col
    name = F.trim(c("coupon_name"))
    no = F.lit(False)
    fault = (
        F.when(~F.coalesce((F.length(name) > 0) & (F.length(name) <= 100), no), "INVALID_NAME")
        .when(c("type").isNull() | (F.length(F.trim(c("type"))) == 0), "MISSING_TYPE")
        .when(~F.coalesce(c("value") >= 0, no), "INVALID_VALUE")
        .when(~F.coalesce(c("valid_hours") > 0, no), "INVALID_VALID_HOURS")
    )
    judged = cmds.withColumn("fault", fault)
    fresh = judged.filter(c("fault").isNull()).select(
        "coupon_id", name.alias("coupon_name"), "type", "value", "valid_hours", ts(now).alias("created_at")
    )
    return coupon.unionByName(fresh.select(coupon.columns)), judged.filter(c("fault").isNotNull())


def create_rounds(event: DataFrame, coupon: DataFrame, cmds: DataFrame, now: datetime) -> DataFrame:
    """Outcome and round number per command.

    ``cmds``: command_no, coupon_id, round (or NULL), total_stock, open_at, close_at. A given round is
    reused when configured alike and refused otherwise; without one the first round
    configured alike is reused, or the next number is taken. Commands with a round are placed
    before those without.
    """
    c = F.col
    no = F.lit(False)
    config = ["coupon_id", "total_stock", "open_at", "close_at"]
    judged = (
        cmds.join(coupon.select("coupon_id").withColumn("has_coupon", F.lit(True)), "coupon_id", "left")
        .withColumn(
            "fault",
            F.when(~F.coalesce(c("open_at") < c("close_at"), no) | ~F.coalesce(c("close_at") > ts(now), no)
                   | ~F.coalesce(c("total_stock") > 0, no), "INVALID_REQUEST")
            .when(c("has_coupon").isNull(), "COUPON_NOT_FOUND"),
        )
    )
    sound = judged.filter(c("fault").isNull())

    # Rounds as configured: stored ones first, then the earliest command that names a new one.
    given = sound.filter(c("round").isNotNull())
    setup = F.struct("total_stock", "open_at", "close_at", "per_user_limit")
    stored = event.groupBy("coupon_id", "round").agg(F.first(setup).alias("stored"))
    named = given.groupBy("coupon_id", "round").agg(
        F.min(F.struct("command_no", F.struct("total_stock", "open_at", "close_at", F.lit(1).alias("per_user_limit")).alias("setup"))).alias("named")
    )
    mine = F.struct("total_stock", "open_at", "close_at", F.lit(1).alias("per_user_limit"))
    explicit = (
        given.join(named, ["coupon_id", "round"]).join(stored, ["coupon_id", "round"], "left")
        .withColumn(
            "outcome",
            F.when(c("stored").isNull() & (c("command_no") == c("named.command_no")), "CREATED")
            .when(F.coalesce(c("stored"), c("named.setup")) == mine, "REUSED")
            .otherwise("CONFIGURATION_CONFLICT"),
        ).withColumn("assigned_round", F.when(c("outcome") != "CONFIGURATION_CONFLICT", c("round")))
    )
    placed = (
        event.filter(c("per_user_limit") == 1).select(*config, "round", F.lit(0).alias("placed"), c("event_id").alias("place_no"))
        .unionByName(explicit.filter(c("outcome") == "CREATED").select(*config, "round", F.lit(1).alias("placed"), c("command_no").alias("place_no")))
    )
    alike = placed.groupBy(*config).agg(F.min(F.struct("placed", "place_no", "round"))["round"].alias("alike_round"))
    top = (
        event.select("coupon_id", "round").unionByName(explicit.filter(c("outcome") == "CREATED").select("coupon_id", "round"))
        .groupBy("coupon_id").agg(F.max("round").alias("top_round"))
    )

    open_cmds = sound.filter(c("round").isNull())
    wanted = open_cmds.groupBy(*config).agg(F.min("command_no").alias("first_no")).join(alike, config, "left")
    fresh = ranked(
        wanted.filter(c("alike_round").isNull()), ["coupon_id"], number_segment(c("first_no")), [c("first_no")], name="step"
    ).join(top, "coupon_id", "left").select(
        *config, (F.coalesce(c("top_round"), F.lit(0)) + c("step")).cast("int").alias("new_round"), "first_no"
    )
    implicit = (
        open_cmds.join(alike, config, "left").join(fresh, config, "left")
        .withColumn("outcome", F.when(c("alike_round").isNull() & (c("command_no") == c("first_no")), "CREATED").otherwise("REUSED"))
        .withColumn("assigned_round", F.coalesce(c("alike_round"), c("new_round")))
    )
    refused = judged.filter(c("fault").isNotNull()).withColumn("outcome", c("fault")).withColumn("assigned_round", F.lit(None).cast("int"))
    columns = ["command_no", "coupon_id", "outcome", "assigned_round", "open_at"]
    out = explicit.select(columns).unionByName(implicit.select(columns)).unionByName(refused.select(columns))
    return out.withColumn(
        "status", F.when(c("outcome") == "CREATED", F.when(c("open_at") > ts(now), SCHEDULED).otherwise(OPEN))
    ).drop("open_at")
