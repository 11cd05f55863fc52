"""Helpers shared by the operators: staged tables, text buffers, hashes."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroll.plans.staging import work_folder

#: Bytes of text that one step of a vectorised loop works on.
SLICE_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

U64 = np.uint64
#: Odd multipliers of the mixing steps (fixed values of a public 64-bit finalizer).
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; Python workers started from here on also look for this package where the driver has it."""
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), ROOT]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame written once to the shared folder and read back.

    It survives lost executors, cuts the lineage, and its shuffle files go when the write has ended.
    """
    spark = df.sparkSession
    folder = work_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    """``mix`` for one Python integer."""
    x &= 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


#: A random 64-bit value for each byte, made by rule.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
POWER_BASE = U64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            inverse = U64(pow(int(POWER_BASE), -1, 1 << 64))
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, POWER_BASE)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inverse)]))
        return self.up, self.down


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """One value more than bytes; ``span_hashes`` makes the hash of any span from two of them."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * GOLDEN)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values one after another, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def text_slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) of pieces of a batch."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(name)))
    for first, last in slices(offsets, most):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and tab to carriage return, and their row."""
    inside = WORD_BYTE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = offsets[1:-1]
        before[cuts[cuts < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    # A run ends where the next byte is white space or another row begins.
    last = np.empty(len(data), bool)
    if len(data):
        last[-1] = True
        last[:-1] = ~inside[1:]
        cuts = offsets[1:-1] - 1
        last[cuts[cuts >= 0]] = True
    end = np.flatnonzero(inside & last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def counts_by_row(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending positions fall into each row."""
    return np.diff(np.searchsorted(positions, offsets))


def total_text(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


#: Tasks of a stage at most; a task that gets many buckets takes them one at a time.
MOST_TASKS = 1 << 17


def bucket_count(total_bytes: int, each: int, least: int = 16) -> int:
    """Buckets of about ``each`` bytes, whatever the input."""
    return max(least, -(-total_bytes // each))


def deal(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, the rows of ``columns`` that belong to it, column after column), in the rows' order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        if a < b:
            yield int(bucket[a]), b"".join(c[a:b].tobytes() for c in columns)


def dealt(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The columns back from pieces made by ``deal``."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for part, kind in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows without the key) of sorted batches; the first ``keys`` columns are the key."""
    open_, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != open_:
                if open_ is not None:
                    yield open_, rows
                open_, rows = row[:keys], []
            rows.append(row[keys:])
    if open_ is not None:
        yield open_, rows


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node that links reach.

    Large and small stars in turn: each node's neighbours are hung on its smallest neighbour until nothing changes. Every
    round is a join and an aggregation with partial sums; rounds grow with the logarithm of the longest path.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: a node's larger neighbours are hung on its smallest neighbour (or itself), and it too.
        met = both.join(least, "a")
        large = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.unionByName(met.filter("a > m and b < a").select("a", F.col("m").alias("b"))).distinct(), name)
        # Small star: a node's smaller neighbours are hung on the smallest of them, and the node too.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node, which hangs on none."""
    ends = edges.select("a", F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up")))
    return ends.groupBy("a").agg(F.sum("up").alias("n"), F.min("up").alias("low")).filter("n > 1 or (n = 1 and low = 0)").isEmpty()


class Forest:
    """Union and find over numbers from 0; the smallest number of a tree is its root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
