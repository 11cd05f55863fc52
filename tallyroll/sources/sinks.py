"""Writing table snapshots. Audit results are written by ``plans.runner.run_and_store``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_issue_snapshot(issue: DataFrame, folder: str, rows_per_file: int = 2_000_000) -> None:
    """Next issue table, laid out by campaign so that a campaign audit reads its own files only.

    Files are bounded by rows, not by campaign: a very large campaign becomes many files. The folder
    must be new; a table is never overwritten while it is being read.
    """
    issue.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy("event_id").parquet(folder)


def write_history_snapshot(history: DataFrame, folder: str, rows_per_file: int = 2_000_000) -> None:
    history.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(folder)


def write_history_by_month(history: DataFrame, folder: str, rows_per_file: int = 2_000_000) -> None:
    """History laid out by the month in which it was recorded, for audits of what is new (``ledger.read_history``).

    Rows of a month meet in few files; adaptive execution splits large months.
    """
    laid = history.withColumn("recorded_in", F.trunc("recorded_at", "month")).hint("rebalance", "recorded_in")
    laid.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy("recorded_in").parquet(folder)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Table bucketed by ``key``: joins and windows on the key then need no shuffle."""
    df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
