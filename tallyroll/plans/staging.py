"""Folders for staged tables and stream positions, shared by all executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only for a session on one machine."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named
    if spark.sparkContext.master.partition("[")[0] == "local":
        return tempfile.mkdtemp(prefix="tallyroll-")
    raise ValueError(f"set {SETTING} to a folder all executors can reach")


def cut(df: DataFrame) -> DataFrame:
    """The frame written to reliable shared storage, its lineage cut there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes begun inside go when the write ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """The frame written once to a folder of its own, for several readers: packed columns, a fraction of what ``cut`` takes."""
    folder = work_folder(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


BROADCAST_ROWS = 200_000


def if_small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A frame of keys, marked for broadcast once it is known to hold at most ``rows`` rows.

    The check counts at most one row more than that. Above it the frame is left as it is and Spark
    joins by shuffle. Use it for narrow key columns only.
    """
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def matching(table: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a large table whose key occurs in ``keys``; the table is not shuffled for few keys."""
    return table.join(if_small(keys.select(*columns).distinct()), columns, "left_semi")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own for one run."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_batches(spark: SparkSession, folder: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows written by earlier micro-batches below ``folder/batch=N``; empty when there are none yet."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        rows = spark.read.schema(full).parquet(folder)
    except AnalysisException as missing:
        # Only a folder nobody has written yet counts as empty; anything else must not pass for it.
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    return rows if before is None else rows.filter(rows["batch"] < before)


def write_batch(df: DataFrame, folder: str, batch: int) -> None:
    """Write one micro-batch's rows; a repeated micro-batch replaces its own rows."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/batch={batch}")
