"""Exact top-k search by tiled matrix products.

Vectors are packed once into shards, matrices of a bounded number of rows. Query rows become tiles of bounded size.
Every tile meets every shard in a matrix product of its own task, which keeps each query's best k of that shard; the
short lists are merged in a tree, eight to one, until one list a query is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroll.llm.common import staged

K, SCALE, QUERY_STEP = 5, 256, 50
SHARD_ROWS, TILE_ROWS, FAN_IN = 8192, 1024, 8


def _pack(batches: Iterator[pa.RecordBatch], rows: int, has_id: bool) -> Iterator[pa.RecordBatch]:
    """Packs quantised vectors of equal length into matrices; a row's place is (shard, at), its own for every row."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    open_: dict[int, tuple[list, list]] = {}

    def out(dim: int) -> pa.RecordBatch:
        nonlocal number
        ids, matrix = open_.pop(dim)
        shard = part << 32 | number
        number += 1
        values = np.concatenate(matrix)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
             pa.array([values.tobytes()], pa.binary()), pa.array([float(np.abs(values).max()) if values.size else 0.0])],
            names=["shard", "dim", "ids", "matrix", "largest"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        vectors = batch.column(1)
        lengths = np.array([-1 if v is None else v for v in pa.compute.list_value_length(vectors).to_pylist()], np.int64)
        flat = vectors.flatten()
        values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), float)
        ends = np.cumsum(np.maximum(lengths, 0))
        scaled = np.floor(SCALE * values)
        good = np.concatenate([[0], np.cumsum(~np.isfinite(scaled))])
        starts = ends - np.maximum(lengths, 0)
        use = (lengths >= 0) & (good[ends] == good[starts]) & np.array([i is not None for i in ids], bool)
        for dim in np.unique(lengths[use]).tolist():
            rows_here = np.flatnonzero(use & (lengths == dim))
            for at in range(0, len(rows_here), rows):
                some = rows_here[at : at + rows]
                held = open_.setdefault(dim, ([], []))
                held[0].append(np.array([ids[i] for i in some], np.int64))
                held[1].append(scaled[starts[some][:, None] + np.arange(dim)[None, :]].reshape(len(some), dim))
                if sum(map(len, held[0])) >= rows:
                    yield out(dim)
    for dim in list(open_):
        yield out(dim)


def _tiles(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """The query rows of each shard, in tiles."""
    for batch in batches:
        for shard, dim, ids, matrix, largest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            ids = np.frombuffer(ids, np.int64)
            matrix = np.frombuffer(matrix, float).reshape(len(ids), dim)
            at = np.flatnonzero(ids % step == 0)
            for k in range(0, len(at), TILE_ROWS):
                some = at[k : k + TILE_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([dim], pa.int32()), pa.array([some.astype(np.int64).tobytes()], pa.binary()),
                     pa.array([ids[some].tobytes()], pa.binary()), pa.array([matrix[some].tobytes()], pa.binary()), pa.array([largest])],
                    names=["q_shard", "dim", "q_at", "q_ids", "q_matrix", "q_largest"])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, ties to the smaller id; columns come in ascending id."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        row, column = np.nonzero(score >= least[:, None])
    else:
        row, column = np.nonzero(np.ones(score.shape, bool))
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(score.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep]


def _multiply(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            x = dict(zip(names, values, strict=True))
            dim, ids = x["dim"], np.frombuffer(x["ids"], np.int64)
            q_ids, q_at = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["q_at"], np.int64)
            m = np.frombuffer(x["matrix"], float).reshape(len(ids), dim)
            q = np.frombuffer(x["q_matrix"], float).reshape(len(q_ids), dim)
            # Products of doubles are exact while every partial sum stays below 2**53; else 64-bit integers.
            exact = x["largest"] * x["q_largest"] * max(dim, 1) < 2.0**53
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                score = (part @ m.T) if exact else (part.astype(np.int64) @ m.astype(np.int64).T)
                if x["shard"] == x["q_shard"]:
                    own = q_at[a : a + 256]
                    score = score.astype(float) if exact else score
                    score[np.arange(len(part)), own] = -np.inf if exact else np.iinfo(np.int64).min
                row, column = _best(score, ids, k)
                if x["shard"] == x["q_shard"]:
                    real = column != own[row]
                    row, column = row[real], column[real]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), x["q_shard"], np.int64)), pa.array(q_at[a + row]), pa.array(q_ids[a + row]),
                     pa.array(np.full(len(row), x["shard"], np.int64)), pa.array(ids[column]), pa.array(score[row, column].astype(np.int64))],
                    names=["q_shard", "q_at", "query_id", "shard", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each row whose vec_id is divisible by ``step``.

    ``vectors``: vec_id, embedding. A component x counts as floor(256 * x). Scores are integer inner products, ties go to
    the smaller vec_id; fewer rows than ``k`` give fewer ranks. Rows with a null id or vector, or with a null or non-finite
    component take no part. Repeated ids are rows of their own: a row leaves out only itself. Vectors of different length
    do not meet. Scores over 63 bits are not defined.
    """
    spark = vectors.sparkSession
    packed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        lambda it: _pack(it, shard_rows, True), "shard long, dim int, ids binary, matrix binary, largest double")
    packed = staged(packed, "topk-shards")
    tiles = packed.mapInArrow(
        lambda it: _tiles(it, step), "q_shard long, dim int, q_at binary, q_ids binary, q_matrix binary, q_largest double")
    # A stated set of queries meets every shard, so each tile is sent once to each shard of its length.
    places = packed.select("shard", "dim")
    sent = tiles.join(places, "dim").join(packed.drop("dim"), "shard")
    rows = sent.mapInArrow(lambda it: _multiply(it, k), "q_shard long, q_at long, query_id long, shard long, vec_id long, score long")
    rows = staged(rows.repartition(spark.sparkContext.defaultParallelism, "q_shard", "q_at"), "topk-lists")
    shards = places.count()
    lists = rows.withColumn("node", F.pmod(F.xxhash64("shard"), F.lit(max(1, shards))))
    entry = F.struct((-F.col("score")).alias("minus"), "vec_id", "shard")
    nodes = max(1, shards)
    while True:
        nodes = -(-nodes // FAN_IN)
        # At most FAN_IN lists of k entries on average meet in one cell.
        lists = lists.withColumn("node", F.pmod("node", F.lit(nodes))).groupBy("q_shard", "q_at", "query_id", "node").agg(
            F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
        if nodes == 1:
            break
        lists = lists.select("q_shard", "q_at", "query_id", "node", F.explode("best").alias("b")).select(
            "q_shard", "q_at", "query_id", "node", (-F.col("b.minus")).alias("score"), "b.vec_id", "b.shard")
    return lists.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))


ORACLE = """
with flat as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as x from embeddings),
     cells as (select vec_id, i, floor(256 * cast(x as double)) as v from flat),
     bad as (select distinct vec_id from cells where v is null or not isfinite(v)),
     good as (select c.* from cells c where c.vec_id not in (select vec_id from bad)),
     pairs as (select q.vec_id as query_id, c.vec_id, cast(sum(q.v * c.v) as bigint) as score
               from good q join good c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by 1, 2),
     ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rk from pairs)
select query_id, cast(rk as integer) as rank, vec_id, score from ranked where rk <= 5
"""
