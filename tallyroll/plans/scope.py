"""Which rows an audit looks at, and the audit watermark."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroll.constants import LOOKBACK_HOURS, SAFETY_MARGIN_SECONDS
from tallyroll.functions.times import hours, seconds, ts

EVENT, AS_OF_RANGE, ALL = "EVENT", "AS_OF_RANGE", "ALL"


@dataclass(frozen=True)
class Scope:
    """One campaign, a half-open time range, or everything up to a cut-off.

    An ALL scope may be narrowed to the campaigns of a frame with an ``event_id`` column.
    """

    kind: str
    event_id: int | None = None
    start: datetime | None = None
    end: datetime | None = None
    event_set: DataFrame | None = None

    @staticmethod
    def event(event_id: int) -> "Scope":
        if event_id is None:
            raise ValueError("an EVENT scope needs an event id")
        return Scope(EVENT, event_id=event_id)

    @staticmethod
    def events(event_set: DataFrame) -> "Scope":
        """The EVENT rules over every campaign of a frame, in one pass."""
        return Scope(EVENT, event_set=event_set)

    @staticmethod
    def range(start: datetime, end: datetime) -> "Scope":
        if start is None or end is None or not start < end:
            raise ValueError("a range scope needs start < end")
        return Scope(AS_OF_RANGE, start=start, end=end)

    @staticmethod
    def all(end: datetime, event_set: DataFrame | None = None) -> "Scope":
        if end is None:
            raise ValueError("an ALL scope needs a cut-off")
        return Scope(ALL, end=end, event_set=event_set)

    def within(self, column: Column) -> Column:
        """``start <= column < end``."""
        return (column >= ts(self.start)) & (column < ts(self.end))

    def keep_events(self, df: DataFrame) -> DataFrame:
        """Rows of the scope's campaigns; a scope without any keeps all."""
        if self.event_set is not None:
            return df.join(self.event_set.select("event_id"), "event_id", "left_semi")
        if self.kind == EVENT:
            return df.filter(F.col("event_id") == self.event_id)
        return df


def events_for_all(events: DataFrame, end: datetime) -> DataFrame:
    """Campaigns an ALL audit covers: those created before the cut-off."""
    return events.filter(F.col("created_at") < ts(end)).select("event_id")


def all_cutoff(now: datetime, margin_seconds: int = SAFETY_MARGIN_SECONDS) -> datetime:
    """Cut-off of an ALL audit: rows still being written are left for the next run."""
    return now - timedelta(seconds=margin_seconds)


def next_range(
    results: DataFrame,
    now: datetime,
    lookback_hours: int = LOOKBACK_HOURS,
    margin_seconds: int = SAFETY_MARGIN_SECONDS,
) -> DataFrame:
    """Next range per check: from the last finished range's end up to now minus the margin.

    A check with no finished range gets the look-back; ``skip`` marks an empty range.
    """
    done = (F.col("scope_type") == AS_OF_RANGE) & (F.col("status") != "ERROR")
    end = ts(now) - seconds(margin_seconds)
    last = F.max(F.when(done, F.col("scope_to")))
    start = F.coalesce(last, end - hours(lookback_hours))
    return results.groupBy("check_name").agg(start.alias("scope_from"), end.alias("scope_to")).withColumn(
        "skip", F.col("scope_from") >= F.col("scope_to")
    )
