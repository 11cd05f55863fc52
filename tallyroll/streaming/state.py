"""Keyed state of a stream as bucketed tables.

The newest row of every key is kept in ``buckets`` hash buckets. Each micro-batch writes its changed rows as a delta; every
``merge_every`` batches the deltas and the last snapshot become a new snapshot. A micro-batch reads the newest snapshot
finished at its number and the few deltas since, and of both only the buckets its keys fall into, so what it reads
depends on its keys and not on the age of the stream. Nothing is changed in place: a repeated micro-batch reads the same
folders and replaces its own delta, and a snapshot counts once the table of finished ones names it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroll.functions.ids import packed, unpacked
from tallyroll.plans.staging import BROADCAST_ROWS, shuffles_freed

BUCKETS, MERGE_EVERY = 64, 16
# Parts a bucket is dealt into where a shuffle gathers whole buckets.
PARTS = 16
_DONE = T.StructType([T.StructField("base", T.LongType())])


@dataclass(frozen=True)
class KeyedState:
    """Rows of ``schema`` by ``keys`` below ``folder``. Micro-batches are numbered from 0 without gaps.

    ``by`` names the part of the keys that rows are bucketed and looked up by; all of them unless given. The bucket count can't
    change over a stream's life. Keys may be null in part; null parts are keys like others. ``once``: a key is written once
    and never changes, so that no newest row has to be picked.
    """

    spark: SparkSession
    folder: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = BUCKETS
    merge_every: int = MERGE_EVERY
    by: tuple[str, ...] = ()
    once: bool = False

    @property
    def place(self) -> tuple[str, ...]:
        return self.by or self.keys

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast(self.schema[k].dataType) for k in self.place]), F.lit(self.buckets)).cast("int").alias("bucket")

    def _texts(self, rows: DataFrame, how: Callable[[Column], Column], names: tuple[str, ...] | None = None) -> DataFrame:
        """Text columns packed or unpacked: ids take half the room in a shuffle."""
        names = [f.name for f in self.schema.fields if isinstance(f.dataType, T.StringType) and (names is None or f.name in names)]
        return rows.withColumns({n: how(F.col(n)) for n in names}) if names else rows

    def _write(self, rows: DataFrame, path: str, dealt: bool = False) -> None:
        """``dealt``: rows have their bucket and lie together by it."""
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        # A bucket meets in few files; adaptive execution splits a large one over tasks.
        if dealt:
            rows = rows.select(*fields, "bucket")
        else:
            rows = self._texts(rows.select(*fields).withColumn("bucket", self._bucket()), packed).hint("rebalance", "bucket")
            rows = self._texts(rows, unpacked)
        with shuffles_freed(rows.sparkSession):
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])).option(
            "basePath", self.folder).parquet(*paths)

    def base(self, batch: int) -> int | None:
        """Number of the newest finished snapshot that a micro-batch may use."""
        try:
            done = self.spark.read.schema(_DONE).parquet(f"{self.folder}-finished")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return done.filter(F.col("base") <= batch).agg(F.max("base")).first()[0]

    def _finish(self, rows: DataFrame, batch: int, dealt: bool = False) -> None:
        # Snapshot N holds what came before batch N; its version orders it before that batch's delta.
        self._write(rows, f"{self.folder}/kind=base/version={batch}", dealt)
        self.spark.range(1).select(F.lit("x").alias("x")).write.mode("overwrite").parquet(f"{self.folder}-finished/base={batch}")

    def start(self, rows: DataFrame | None = None) -> None:
        """The state before the first micro-batch, empty or that of ``rows`` (one a key); only the first call counts."""
        if self.base(0) is None:
            self._finish(self.spark.createDataFrame([], self.schema) if rows is None else rows, 0)

    def update(self, rows: DataFrame, batch: int) -> None:
        """A micro-batch's changed rows, one a key."""
        self._write(rows, f"{self.folder}/kind=delta/version={batch}")

    def all(self, batch: int, buckets: list[int] | None = None) -> DataFrame:
        """The newest row of every key before ``batch``, of some buckets or of all."""
        return self._newest(batch, *self._versions(batch, buckets))

    def _versions(self, batch: int, buckets: list[int] | None) -> tuple[int, DataFrame]:
        """The newest snapshot's number, and its rows with those of the deltas since."""
        base = self.base(batch)
        if base is None:
            raise ValueError(f"{self.folder} has not been started")
        rows = self._read(f"{self.folder}/kind=base/version={base}", *[f"{self.folder}/kind=delta/version={n}" for n in range(base, batch)])
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        # Both kinds of version ``base`` may be read: the delta is the newer one.
        return base, rows.withColumn("_newer", F.col("version") * 2 + F.col("_metadata.file_path").contains("/kind=delta/").cast("long"))

    def _newest(self, batch: int, base: int, rows: DataFrame) -> DataFrame:
        if base == batch or self.once:
            return rows.select(self.schema.fieldNames())
        return self._texts(self._picked(self._texts(rows, packed)), unpacked)

    def _picked(self, rows: DataFrame, *beside: str) -> DataFrame:
        """The newest row of each key; ``beside``: columns that hang on the key."""
        values = [f.name for f in self.schema.fields if f.name not in self.keys]
        rows = rows.select(*beside, *self.keys, F.struct(F.lit(True).alias("_"), *values).alias("row"), "_newer")
        if beside:
            rows = rows.repartition(*beside)
        picked = rows.groupBy(*beside, *self.keys).agg(F.max_by("row", "_newer").alias("row"))
        return picked.select(*beside, *[F.col(n) if n in self.keys else F.col(f"row.{n}").alias(n) for n in self.schema.fieldNames()])

    def _asked(self, wanted: DataFrame) -> dict[int, int]:
        """Buckets that some keys fall into, and how many of the keys: at most ``buckets`` numbers."""
        return {r[0]: r[1] for r in wanted.groupBy(self._bucket()).count().collect()}

    def touched(self, wanted: DataFrame) -> list[int]:
        """Buckets that some keys fall into: at most ``buckets`` numbers."""
        return sorted(self._asked(wanted))

    def near(self, wanted: DataFrame, batch: int, *pack: str) -> DataFrame:
        """The newest rows before ``batch`` of the keys in ``wanted``, and where these are many, also others of their buckets.

        For joins by the key, which leave out the others: kept rows and keys that are asked for then are shuffled once, by that join.
        ``pack``: columns of the result to be packed.
        """
        asked = wanted.select(*self.place)
        buckets = self._asked(asked)
        base, rows = self._versions(batch, sorted(buckets))
        if rows.isEmpty():
            return self._texts(self.spark.createDataFrame([], self.schema).limit(0), packed, pack)
        if sum(buckets.values()) <= BROADCAST_ROWS:
            # As one column, in which null parts are parts like others.
            key = F.struct(*self.place).alias("_key")
            rows = rows.withColumn("_key", key).join(F.broadcast(asked.select(key)), "_key", "left_semi").drop("_key")
        rows = self._texts(rows, packed, pack)
        return rows.select(self.schema.fieldNames()) if base == batch or self.once else self._picked(rows)

    def of(self, wanted: DataFrame, batch: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The newest rows before ``batch`` of the keys (or their ``by`` part) in ``wanted``; other buckets aren't read.

        ``keep`` (such as ``cut``) stores the rows found.
        """
        asked = wanted.select(*self.place)
        base, rows = self._versions(batch, self.touched(asked))
        # Nothing kept in these buckets: nothing to look up, and what is asked for needn't be shuffled.
        if rows.isEmpty():
            return self.spark.createDataFrame([], self.schema).limit(0)
        here, asked = self._newest(batch, base, rows).alias("s"), asked.alias("w")
        same = [F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}")) for k in self.place]
        on = same[0]
        for part in same[1:]:
            on = on & part
        found = here.join(asked, on, "left_semi")
        return found if keep is None else keep(found)

    def due(self, batch: int) -> bool:
        """Whether a micro-batch starts with a new snapshot."""
        return batch > 0 and batch % self.merge_every == 0

    def merge(self, batch: int, keep: Column | None = None) -> bool:
        """Before micro-batch ``batch``: a new snapshot where it is due; rows for which ``keep`` doesn't hold are left out."""
        if not self.due(batch) or self.base(batch) == batch:
            return False
        base, rows = self._versions(batch, None)
        if self.once:
            rows = rows.select(self.schema.fieldNames())
        else:
            # Dealt by bucket and part of it, picked there and written from there: one shuffle.
            part = F.pmod(F.xxhash64(F.lit(PARTS), *[F.col(k) for k in self.place]), F.lit(PARTS))
            rows = self._texts(self._picked(self._texts(rows.withColumn("part", part), packed), "bucket", "part").drop("part"), unpacked)
        self._finish(rows if keep is None else rows.filter(keep), batch, not self.once)
        return True

    def outdated(self, batch: int) -> list[str]:
        """Folders that no micro-batch from ``batch`` on reads."""
        base = self.base(batch) or 0
        done = self.spark.read.schema(_DONE).parquet(f"{self.folder}-finished").filter(F.col("base") < base).collect()
        return [f"{self.folder}/kind=base/version={r[0]}" for r in done] + [f"{self.folder}/kind=delta/version={n}" for n in range(base)]
