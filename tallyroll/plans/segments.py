"""Order-dependent work on keys of any size.

A window per key puts a whole key in one task. The helpers here cut each key
into segments of its order column, work inside segments, and carry only one
small row per segment across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroll.plans.staging import cut, if_small

SEGMENT_ROWS = 1_000_000
NULL_TIME_BASE = -(1 << 62)


def number_segment(order: Column, size: int = SEGMENT_ROWS) -> Column:
    """Segment of a unique running number: at most ``size`` rows each. Integer arithmetic only."""
    return (order - F.pmod(order, F.lit(size))).cast("long")


def time_segment(at: Column, tie: Column, width_seconds: int = 86_400) -> Column:
    """Segment of a (time, number) order with missing times first."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(at.isNull(), F.lit(NULL_TIME_BASE) + number_segment(tie)).otherwise(
        number_segment(F.timestamp_diff("SECOND", epoch, at), width_seconds)
    )


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Partition by all of ``columns``.

    A window on (key, segment) is also content with rows partitioned by the key alone, as
    a join leaves them; that would put a hot key back into one task.
    """
    return df.repartition(*columns)


def segment_offsets(df: DataFrame, keys: list[str], segment: str, descending: bool = False) -> DataFrame:
    """Rows of each key that lie in earlier segments."""
    order = F.col(segment).desc() if descending else F.col(segment).asc()
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(
        *keys, segment, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )


def ranked(
    df: DataFrame,
    keys: list[str],
    segment: Column,
    order: list[Column],
    limit: str | None = None,
    descending: bool = False,
    name: str = "rank",
) -> DataFrame:
    """1-based rank within ``keys``.

    ``segment`` must not contradict ``order``. With ``limit`` (a column of ``df``) only rows ranked
    up to it are kept, and segments beyond it are dropped before any sorting.
    """
    rows = df.withColumn("_segment", segment)
    offsets = segment_offsets(rows.select(*keys, "_segment"), keys, "_segment", descending)
    joined = rows.join(offsets, [*keys, "_segment"])
    if limit:
        joined = joined.filter(F.col("_offset") < F.col(limit))
    joined = spread(joined, *keys, "_segment")
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order)
    out = joined.withColumn(name, F.col("_offset") + F.row_number().over(inside))
    if limit:
        out = out.filter(F.col(name) <= F.col(limit))
    return out.drop("_segment", "_offset")


def running_max_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, size: int = SEGMENT_ROWS) -> DataFrame:
    """Largest value of the rows of the same keys with a smaller number in ``order``; NULL where there is none."""
    rows = spread(df.withColumn("_segment", number_segment(F.col(order), size)).withColumn("_value", value), *keys, "_segment")
    inside = Window.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_segment").agg(F.max("_value").alias("_most")).select(*keys, "_segment", F.max("_most").over(across).alias("_before"))
    return rows.withColumn("_within", F.max("_value").over(inside)).join(carried, [*keys, "_segment"]).withColumn(
        name, F.greatest("_before", "_within")).drop("_segment", "_value", "_before", "_within")


def running_stock(moves: DataFrame, keys: list[str], order: str, start: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """``before`` and ``after`` of a stock that ``delta`` (-1, 0 or 1) moves row by row and that never falls below zero.

    ``start``: the keys and ``stock``, not negative. A row maps a stock x to max(x + d, 0), and maps of the form
    max(x + a, a + m) are closed under composition: a is the sum of the moves, m the lowest point of their running sums
    (or zero), negated. Each segment is one such map, the maps before a segment compose to its first stock, and inside
    a segment running sums and minima give every row's. These are worked out once and kept, for the maps and the rows.
    """
    c = F.col
    rows = spread(moves.withColumn("_segment", number_segment(c(order), size)), *keys, "_segment")
    upto = Window.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = Window.partitionBy(*keys, "_segment").orderBy(order)
    rows = cut(rows.withColumn("_sum", F.sum("delta").over(upto)).withColumn("_low", F.max(-c("_sum")).over(upto)).withColumn("_last_low", F.lag("_low").over(step)))
    across = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    maps = rows.groupBy(*keys, "_segment").agg(F.sum("delta").alias("_a"), F.max("_low").alias("_m"))
    maps = maps.withColumn("_moved", F.coalesce(F.sum("_a").over(across), F.lit(0)))
    maps = maps.withColumn("_reach", F.max(c("_m") - c("_moved")).over(across)).join(start.select(*keys, "stock"), keys, "left")
    stock = F.coalesce("stock", F.lit(0))
    first = cut(maps.select(*keys, "_segment", (c("_moved") + F.greatest(stock, F.coalesce("_reach", stock))).alias("_first")))
    return rows.join(if_small(first), [*keys, "_segment"]).withColumn(
        "before", c("_sum") - c("delta") + F.greatest("_first", F.coalesce("_last_low", "_first"))).withColumn(
        "after", c("_sum") + F.greatest("_first", "_low")).drop("_segment", "_sum", "_low", "_last_low", "_first")
