"""The issue stream: reading entries, typing them, and reading packed request records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroll.constants import COMPENSATED, CONFIRMED, DECISION_ACCEPTED, DECISION_CLOSED, DECISION_PERSISTENCE_FAILED, DECISION_SOLD_OUT, PENDING, RECORD_VERSION, TERMINAL
from tallyroll.functions.ids import bitmap_offset, bitmap_segment, is_uuid, message_id
from tallyroll.functions.text import label
from tallyroll.functions.times import epoch_millis_to_local
from tallyroll.operators.allocation import state_status
from tallyroll.schemas import STREAM_ENTRY


def read_issue_stream(spark: SparkSession, folder: str, max_files: int | None = None, fmt: str = "json") -> DataFrame:
    """Entries as a stream over files; the query's checkpoint is the read position."""
    reader = spark.readStream.format(fmt).schema(STREAM_ENTRY)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def _number(name: str) -> Column:
    """A 64-bit number, or NULL; only an optional sign and digits count."""
    text = F.col(name)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def typed_entries(entries: DataFrame, zone: str = "Asia/Seoul") -> DataFrame:
    """Entries with typed columns and ``fault``: NULL for a good ISSUE entry, SKIPPED for other types."""
    c = F.col
    t = entries.select(
        "*",
        _number("campaignId").alias("event_id"), _number("userId").alias("user_id"), _number("bitmapSegmentId").alias("segment_id"),
        _number("bitOffset").alias("bit_offset"), _number("issueSequence").alias("issue_sequence"), _number("decidedAt").alias("decided_ms"),
    )
    no = F.lit(False)
    ok = lambda cond: F.coalesce(cond, no)
    fault = (
        F.when(~ok(c("type") == "ISSUE"), "SKIPPED")
        .when(~ok(is_uuid(c("requestId"))), "requestId")
        .when(~ok(c("event_id") > 0), "campaignId").when(~ok(c("user_id") > 0), "userId")
        .when(~ok(c("segment_id") >= 0), "bitmapSegmentId").when(~ok(c("bit_offset") >= 0), "bitOffset")
        .when(~ok(c("issue_sequence") > 0), "issueSequence").when(c("decided_ms").isNull(), "decidedAt")
    )
    return t.withColumn("fault", fault).withColumn(
        "decided_at", F.when(c("fault").isNull(), epoch_millis_to_local(c("decided_ms"), zone))
    ).withColumn("message_id", F.when(c("fault").isNull(), message_id(c("event_id"), c("entry_id"))))


def parse_issue_entries(entries: DataFrame, zone: str = "Asia/Seoul") -> tuple[DataFrame, DataFrame]:
    """Good entries, and malformed ISSUE entries to set aside. Other types are skipped."""
    typed = typed_entries(entries, zone)
    good = typed.filter(F.col("fault").isNull()).select(
        "entry_id", F.lower(F.col("requestId")).alias("request_id"), "event_id", "user_id", "segment_id", "bit_offset", "issue_sequence",
        "decided_at", "message_id",
    )
    bad = typed.filter(F.col("fault").isNotNull() & (F.col("fault") != "SKIPPED")).select(*entries.columns, "fault")
    return good, bad


# Status numbers of the older record forms.
OLD_STATUS = {
    0: "ACCEPTED", 1: "PROCESSING", 2: "ISSUED", 3: "FAILED", 4: "COMPENSATED", 5: "REJECTED_SOLD_OUT",
    6: "REJECTED_DUPLICATE", 7: "REJECTED_NOT_OPEN", 8: "REJECTED_CLOSED",
}


def _field(fields: Column, i: int) -> Column:
    return F.try_element_at(fields, F.lit(i + 1))


def _long(fields: Column, i: int) -> Column:
    text = _field(fields, i)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def parse_request_state(df: DataFrame) -> DataFrame:
    """Unpack ``record`` into status, sequence, remaining stock, decision time and ``valid``.

    Ten fields are the current form; the shorter ones are older and carry a status instead
    of a decision code.
    """
    c = F.col
    parts = df.withColumn("_f", F.split(c("record"), r"\|", -1)).withColumn("_n", F.size("_f"))
    f = c("_f")
    current = c("_n") == 10
    code, stage, updated = _long(f, 4), _long(f, 5), _long(f, 9)
    pick = lambda new, old: F.when(current, _long(f, new)).otherwise(_long(f, old))
    user, sequence, remaining, decided = pick(1, 0), pick(6, 3), pick(7, 4), pick(8, 5)
    old_text = _field(f, 2)
    names = F.array(*[F.lit(v) for v in OLD_STATUS.values()])
    old_status = F.coalesce(label(_long(f, 2).cast("int"), OLD_STATUS), F.when(F.array_contains(names, old_text), old_text))
    pair_ok = (
        ((code == DECISION_ACCEPTED) & stage.isin(PENDING, CONFIRMED))
        | ((code == DECISION_PERSISTENCE_FAILED) & (stage == COMPENSATED))
        | (code.between(DECISION_SOLD_OUT, DECISION_CLOSED) & (stage == TERMINAL))
    )
    sound = F.when(
        current, (_field(f, 0) == RECORD_VERSION) & pair_ok & (updated >= decided)
    ).otherwise(c("_n").isin(*OLDER_FIELD_COUNTS) & old_status.isNotNull())
    valid = F.coalesce(
        sound & user.isNotNull() & sequence.isNotNull() & remaining.isNotNull() & (decided > 0), F.lit(False)
    )
    status = F.when(current, state_status(code.cast("int"), stage.cast("int"))).otherwise(old_status)
    keep = lambda col: F.when(valid, col)
    return parts.select(
        *df.columns, valid.alias("valid"), keep(user).alias("user_id"), keep(status).alias("status"),
        F.when(valid & (sequence >= 0), sequence).alias("issue_sequence"),
        F.when(valid & (remaining >= 0), remaining).alias("remaining"),
        keep(decided).alias("decided_ms"),
    )


# Field counts of the older record forms.
OLDER_FIELD_COUNTS = (6, 7)


def pack_request_state(state: DataFrame) -> DataFrame:
    """Request records as packed text, with times as epoch milliseconds."""
    c = F.col
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ms = lambda name: F.timestamp_diff("MILLISECOND", epoch, c(name)).cast("string")
    record = F.concat_ws(
        "|", F.lit(RECORD_VERSION), c("user_id").cast("string"), bitmap_segment(c("user_id")).cast("string"),
        bitmap_offset(c("user_id")).cast("string"), c("code").cast("string"), c("lifecycle").cast("string"),
        F.coalesce(c("issue_sequence"), F.lit(-1)).cast("string"), F.coalesce(c("remaining"), F.lit(-1)).cast("string"),
        ms("decided_at"), ms("updated_at"),
    )
    return state.select("campaign_id", "request_id", record.alias("record"))
