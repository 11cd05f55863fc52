"""Per-issue history: the latest row, breaks of the status chain, and where chains stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroll.constants import ISSUED
from tallyroll.plans.segments import spread, time_segment
from tallyroll.plans.staging import cut, matching

_ROW = ("issue_id", "history_id", "from_status", "to_status", "occurred_at")


def latest_history(history: DataFrame, *columns: str) -> DataFrame:
    """Newest history row per issue by (occurred_at, history_id).

    The rank filter is applied before the shuffle too, so each map task sends at
    most one row per issue.
    """
    newest = Window.partitionBy("issue_id").orderBy(
        F.col("occurred_at").desc_nulls_last(), F.col("history_id").desc()
    )
    wanted = dict.fromkeys(("issue_id", "history_id", "occurred_at", *columns))
    return (
        history.select(*wanted)
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
    )


def chain_breaks(history: DataFrame, settled: str | None = None) -> DataFrame:
    """History rows that do not continue their issue's chain.

    The first row must be (none -> ISSUED); every later row must start at the status
    the previous one ended with. Ordered by (occurred_at, history_id), missing times first.
    Rows with ``settled`` true are gone on from, but not judged themselves.
    """
    h = spread(
        history.select(
            *_ROW, (F.col(settled) if settled else F.lit(False)).alias("settled"),
            time_segment(F.col("occurred_at"), F.col("history_id")).alias("segment"),
        ),
        "issue_id", "segment",
    )
    inside = Window.partitionBy("issue_id", "segment").orderBy(
        F.col("occurred_at").asc_nulls_first(), F.col("history_id")
    )
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = h.select(
        "*",
        F.row_number().over(inside).alias("n"),
        F.lag("to_status").over(inside).alias("prev_to_status"),
        F.last("to_status").over(whole).alias("segment_end"),
    )
    out = ["issue_id", "history_id", "occurred_at", "prev_to_status", "from_status", "to_status", "is_first"]

    later = (
        rows.filter((F.col("n") > 1) & ~F.col("settled") & ~F.col("from_status").eqNullSafe(F.col("prev_to_status")))
        .withColumn("is_first", F.lit(False))
        .select(out)
    )

    across = Window.partitionBy("issue_id").orderBy("segment")
    heads = (
        rows.filter(F.col("n") == 1)
        .withColumn("is_first", F.row_number().over(across) == 1)
        .withColumn("prev_to_status", F.lag("segment_end").over(across))
    )
    starts_well = F.col("from_status").isNull() & F.coalesce(F.col("to_status") == ISSUED, F.lit(False))
    continues = F.col("from_status").eqNullSafe(F.col("prev_to_status"))
    broken = F.when(F.col("is_first"), ~starts_well).otherwise(~continues)
    return later.unionByName(heads.filter(broken & ~F.col("settled")).select(out))


def chain_heads(history: DataFrame) -> DataFrame:
    """Where each issue's chain stands: its last row by (occurred_at, history_id), missing times first. One aggregate, no sort."""
    last = F.max(F.struct("occurred_at", "history_id", "to_status")).alias("last")
    return history.groupBy("issue_id").agg(last).select("issue_id", "last.history_id", "last.occurred_at", "last.to_status")


def moved_heads(heads: DataFrame, new: DataFrame) -> DataFrame:
    """``heads`` after the rows of ``new``."""
    return chain_heads(heads.unionByName(new.select(*heads.columns)))


def continued_breaks(heads: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """Breaks that ``new`` rows bring, given where chains stood before them; ``heads`` are those of ``old``.

    A chain whose new rows all lie after its head goes on from there, and its old rows are not read. A chain that a
    late row reaches back into is judged whole, so that its breaks replace those found before. Only these issues' rows
    of ``old`` are read; they find each other by a semi join.
    """
    place = F.struct("occurred_at", "history_id")
    touched = new.groupBy("issue_id").agg(F.min(place).alias("first"))
    met = cut(heads.join(touched, "issue_id").withColumn("late", F.col("first") < place))
    anchors = met.filter(~F.col("late")).withColumn("from_status", F.lit(None).cast("string")).select(*_ROW, F.lit(True).alias("settled"))
    again = matching(old, met.filter("late"), ["issue_id"])
    rows = new.select(*_ROW).unionByName(again.select(*_ROW)).withColumn("settled", F.lit(False))
    return chain_breaks(rows.unionByName(anchors), "settled")
