"""Planting one fault per campaign on a copy of the tables, to try the audit rules.

Each planter takes the tables, an optional frame of ``event_id`` and the time, changes one
row per campaign in one pass, and returns new tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroll.constants import ISSUED, USED
from tallyroll.functions.ids import uuid_from_name
from tallyroll.functions.times import hours, seconds, ts
from tallyroll.operators.chains import latest_history
from tallyroll.operators.recovery import apply_changes
from tallyroll.sources.ledger import Tables


# Planted history rows get ids far above the stored ones.
PLANTED_ID_BASE = 1 << 60


def _newest(rows: DataFrame, events: DataFrame | None, *order) -> DataFrame:
    """The first row of each campaign; the rank filter is applied before the shuffle too."""
    if events is not None:
        rows = rows.join(events.select("event_id"), "event_id", "left_semi")
    w = Window.partitionBy("event_id").orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def _by_created():
    return F.col("created_at").desc_nulls_last(), F.col("issue_id").desc()


def _history_of(tables: Tables) -> DataFrame:
    return tables.history.join(tables.issue.select("issue_id", "event_id", "status"), "issue_id")


def expiration_lag(tables: Tables, now: datetime, events: DataFrame | None = None) -> Tables:
    """Newest unused coupon: validity ended a day ago."""
    t = _newest(tables.issue.filter(F.col("status") == ISSUED), events, *_by_created())
    change = t.select("issue_id", (ts(now) - hours(24)).alias("valid_to"))
    return tables.with_(issue=apply_changes(tables.issue, "issue_id", change))


def history_structure(tables: Tables, now: datetime, events: DataFrame | None = None) -> Tables:
    """Newest history row: a status that does not exist."""
    t = _newest(_history_of(tables), events, F.col("occurred_at").desc_nulls_last(), F.col("history_id").desc())
    change = t.select("history_id", F.lit("INVALID_STATUS").alias("to_status"))
    return tables.with_(history=apply_changes(tables.history, "history_id", change))


def issue_history_state(tables: Tables, now: datetime, events: DataFrame | None = None) -> Tables:
    """Newest issue: status swapped without a history row, its own fields kept sound."""
    t = _newest(tables.issue, events, *_by_created())
    was_issued = F.coalesce(F.col("status") == ISSUED, F.lit(False))
    change = t.select(
        "issue_id", F.when(was_issued, USED).otherwise(ISSUED).alias("status"), F.when(was_issued, ts(now)).alias("used_at"),
        F.lit(None).cast("timestamp_ntz").alias("canceled_at"),
    )
    return tables.with_(issue=apply_changes(tables.issue, "issue_id", change))


def issue_structure(tables: Tables, now: datetime, events: DataFrame | None = None) -> Tables:
    """Newest issue: a request id that is no UUID."""
    t = _newest(tables.issue, events, *_by_created())
    change = t.select("issue_id", F.concat(F.lit("INVALID-REQUEST-ID-"), F.col("issue_id").cast("string")).alias("request_id"))
    return tables.with_(issue=apply_changes(tables.issue, "issue_id", change))


def time_sync(tables: Tables, now: datetime, events: DataFrame | None = None) -> Tables:
    """Newest use moved five seconds later; a campaign without one gets a first issue moved five seconds back."""
    c = F.col
    latest = latest_history(tables.history, "from_status", "to_status").select("issue_id", "from_status", "to_status")
    rows = tables.issue.select("issue_id", "event_id", "status", "used_at", "issued_at").join(latest, "issue_id")
    used = (c("status") == USED) & (c("to_status") == USED)
    fresh = (c("status") == ISSUED) & (c("to_status") == ISSUED) & c("from_status").isNull()
    target = _newest(
        rows.filter(used | fresh), events,
        F.when(used, 0).otherwise(1), F.when(used, c("used_at")).otherwise(c("issued_at")).desc_nulls_last(), c("issue_id").desc(),
    )
    change = target.select(
        "issue_id", F.when(used, c("used_at") + seconds(5)).otherwise(c("used_at")).alias("used_at"),
        F.when(used, c("issued_at")).otherwise(c("issued_at") - seconds(5)).alias("issued_at"),
    )
    return tables.with_(issue=apply_changes(tables.issue, "issue_id", change))


def loss(tables: Tables, now: datetime, events: DataFrame | None = None) -> Tables:
    """Live stock one lower than it should be."""
    rows = tables.state if events is None else tables.state.join(events.select("event_id"), "event_id", "left_semi")
    change = rows.select("event_id", (F.col("remaining_stock") - 1).alias("remaining_stock"))
    return tables.with_(state=apply_changes(tables.state, "event_id", change))


def state_chain(tables: Tables, now: datetime, events: DataFrame | None = None) -> Tables:
    """The move into the coupon's present status, written once more."""
    t = _newest(_history_of(tables), events, F.col("occurred_at").desc_nulls_last(), F.col("history_id").desc())
    extra = t.select(
        (F.lit(PLANTED_ID_BASE) + F.col("history_id")).alias("history_id"), "issue_id",
        F.when(F.col("status") == ISSUED, USED).otherwise(ISSUED).alias("from_status"), F.col("status").alias("to_status"),
        F.lit("INJECTOR").alias("actor"), F.lit("VIOLATION_INJECTION").alias("reason"), ts(now).alias("occurred_at"),
        ts(now).alias("recorded_at"), uuid_from_name(F.concat(F.lit("plant:"), F.col("issue_id").cast("string"))).alias("event_uid"),
    )
    return tables.with_(history=tables.history.unionByName(extra))


def stock(tables: Tables, now: datetime, events: DataFrame | None = None) -> Tables:
    """Stored remaining stock one lower than it should be."""
    rows = tables.event if events is None else tables.event.join(events.select("event_id"), "event_id", "left_semi")
    change = rows.select("event_id", (F.col("remaining_stock") - 1).alias("remaining_stock"))
    return tables.with_(event=apply_changes(tables.event, "event_id", change))


PLANTERS = {
    "expiration_lag": expiration_lag, "history_structure": history_structure, "issue_history_state": issue_history_state,
    "issue_structure": issue_structure, "time_sync": time_sync, "loss": loss, "state_chain": state_chain, "stock": stock,
}
