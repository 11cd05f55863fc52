"""Reading the ledger tables: Parquet, JSON lines or JDBC, always with fixed schemas."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroll.functions.times import ts
from tallyroll.schemas import TABLES


@dataclass(frozen=True)
class Tables:
    """The frames an audit works on; unused ones stay None."""

    issue: DataFrame | None = None
    history: DataFrame | None = None
    event: DataFrame | None = None
    coupon: DataFrame | None = None
    user: DataFrame | None = None
    state: DataFrame | None = None
    failure: DataFrame | None = None

    def with_(self, **frames: DataFrame) -> "Tables":
        return replace(self, **frames)


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One ledger table from ``folder/name`` as Parquet or JSON lines."""
    return spark.read.format(fmt).schema(TABLES[name]).load(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, fmt: str = "parquet") -> Tables:
    """All audit tables below ``folder``."""
    names = ("issue", "history", "event", "coupon", "user", "failure")
    return Tables(**{n: read_table(spark, folder, n, fmt) for n in names})


def read_history(spark: SparkSession, folder: str, since: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """History laid out by month (``sinks.write_history_by_month``); files of other months are not opened.

    ``since``: recorded from then on; rows without a recorded time count as new. ``before``: recorded before then.
    """
    month, at = F.col("recorded_in"), F.col("recorded_at")
    rows = spark.read.schema(T.StructType([*TABLES["history"].fields, T.StructField("recorded_in", T.DateType())])).parquet(folder)
    if since is not None:
        rows = rows.filter(month.isNull() | (month >= F.lit(since.date().replace(day=1)))).filter(at.isNull() | (at >= ts(since)))
    if before is not None:
        rows = rows.filter(month <= F.lit(before.date())).filter(at < ts(before))
    return rows.drop("recorded_in")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    name: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A ledger table over JDBC, read in ``partitions`` id ranges and cast to the fixed schema."""
    df = (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower),
            upperBound=str(upper), numPartitions=str(partitions), preferTimestampNTZ="true", **options,
        )
        .load()
    )
    return df.select([F.col(f.name).cast(f.dataType) for f in TABLES[name]])
