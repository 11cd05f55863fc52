"""Hard negatives by exact subset-sum scoring.

Candidates are packed once: components become integers, written as bit planes, one byte for eight dimensions. For an
anchor, each group of eight dimensions has a table of the 256 sums of subsets of its eight components, so a candidate's
byte looks up what that plane and group add to the score; planes are added up by doubling, the sign plane counts negative.
Scores are full and exact.

Anchors and shards of candidates are dealt over a grid of cells. A cell holds its anchors and streams its shards through,
keeping only each anchor's best; lists of cells are merged by rank. One pass finds the positives, and one the negatives
within each positive's score window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroll.llm.common import staged

SCALE, ANCHOR_STEP, SHIFT_STEP, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
SHARD_ROWS, CELL_ANCHORS, CELL_ROWS = 4096, 1024, 1 << 21
#: Bytes of the tables, or of the scores, that one step works on.
STEP_BYTES = 16 << 20
LIMIT = 1 << 62
NONE = np.iinfo(np.int64).min
SHARD = "shard long, dim int, bits int, n int, ids binary, labels binary, planes binary"
FOUND = "place long, anchor_id long, positive_id long, positive_score long, vec_id long, at long, score long"


def to_planes(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Two's complement bit planes of rows of integers, (bits, groups, rows) bytes, and how many bits they take."""
    n, dim = values.shape
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    bits = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    groups = -(-dim // 8)
    planes = np.zeros((bits, groups, n), np.uint8)
    for b in range(bits):
        planes[b] = np.packbits((values >> b & 1).astype(bool), axis=1, bitorder="little").T
    return planes, bits


def from_planes(planes: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
    """The integers of some rows."""
    bits = len(planes)
    out = np.zeros((len(rows), dim), np.int64)
    for b in range(bits):
        one = np.unpackbits(np.ascontiguousarray(planes[b][:, rows].T), axis=1, bitorder="little")[:, :dim].astype(np.int64)
        out += (-one if b == bits - 1 else one) << b
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): for every byte the sum of each anchor's components that its bits name."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    padded = np.zeros((n, groups * 8), kind)
    padded[:, :dim] = anchors
    parts = padded.reshape(n, groups, 8).transpose(1, 2, 0)
    sums = np.zeros((groups, 256, n), kind)
    for k in range(8):
        sums[:, 1 << k : 2 << k] = sums[:, : 1 << k] + parts[:, k : k + 1]
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products: look up each byte, add over groups, double from plane to plane."""
    bits, groups, n = planes.shape
    total = np.zeros((n, sums.shape[2]), sums.dtype)
    found = np.empty_like(total)
    for b in range(bits - 1, -1, -1):
        total += total
        for g in range(groups):
            np.take(sums[g], planes[b, g], axis=0, out=found, mode="clip")
            if b == bits - 1:
                total -= found
            else:
                total += found
    return total


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Shards of vectors of equal length, each in ascending id."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    open_: dict[int, list[list[np.ndarray]]] = {}

    def out(dim: int) -> pa.RecordBatch:
        nonlocal number
        ids, labels, values = (np.concatenate(x) for x in open_.pop(dim))
        order = np.argsort(ids, kind="stable")
        planes, bits = to_planes(values[order])
        shard = part << 32 | number
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([dim], pa.int32()), pa.array([bits], pa.int32()), pa.array([len(ids)], pa.int32()),
             pa.array([ids[order].tobytes()]), pa.array([labels[order].tobytes()]), pa.array([planes.tobytes()])],
            names=["shard", "dim", "bits", "n", "ids", "labels", "planes"])

    for batch in batches:
        ids, labels, vectors = batch.columns
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), -1), np.int64)
        flat = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(float("nan")), float)
        ends = np.cumsum(np.maximum(lengths, 0))
        starts = ends - np.maximum(lengths, 0)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        use = (lengths >= 0) & (bad[ends] == bad[starts]) & np.asarray(ids.is_valid()) & np.asarray(labels.is_valid())
        scaled = np.clip(np.where(np.isfinite(flat), np.floor(SCALE * flat), 0.0), -float(LIMIT), float(LIMIT)).astype(np.int64)
        ids, labels = np.asarray(ids.fill_null(0)), np.asarray(labels.fill_null(0))
        for dim in np.unique(lengths[use]).tolist():
            here = np.flatnonzero(use & (lengths == dim))
            for k in range(0, len(here), rows):
                some = here[k : k + rows]
                held = open_.setdefault(dim, [[], [], []])
                held[0].append(ids[some])
                held[1].append(labels[some])
                held[2].append(scaled[starts[some][:, None] + np.arange(dim)[None, :]].reshape(len(some), dim))
                if sum(map(len, held[0])) >= rows:
                    yield out(dim)
    for dim in list(open_):
        yield out(dim)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["planes"], np.uint8).reshape(row["bits"], -(-row["dim"] // 8), row["n"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}


def _anchors(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """The anchors of each shard; ``place`` tells rows of one id apart."""
    for row in _rows(batches):
        ids, labels, planes = _unpacked(row)
        some = np.flatnonzero(ids % step == 0)
        for k in range(0, len(some), 256):
            part = some[k : k + 256]
            values = from_planes(planes, part, row["dim"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["shard"] * SHARD_ROWS + part), pa.array(np.full(len(part), row["dim"], np.int32)), pa.array(ids[part]),
                 pa.array(labels[part]), pa.array([v.tobytes() for v in values], pa.binary())],
                names=["place", "dim", "anchor_id", "label", "vector"])


class _Best:
    """The k best rows of each column over several blocks, by score and then by id and place."""

    def __init__(self, score: np.ndarray, id_: np.ndarray, place: np.ndarray) -> None:
        self.score, self.id, self.place, self.k = score, id_, place, score.shape[1]

    @classmethod
    def none(cls, columns: int, k: int) -> _Best:
        return cls(*(np.full((columns, k), NONE) for _ in range(3)))

    def some(self, first: int, n: int) -> _Best:
        """The lists of some columns; adding to them adds here."""
        return _Best(*(x[first : first + n] for x in (self.score, self.id, self.place)))

    def add(self, score: np.ndarray, ok: np.ndarray, ids: np.ndarray, first: int) -> None:
        """``score`` and ``ok``: (columns, rows); rows come in ascending id."""
        k = self.k
        # A row that can't enter a column's list isn't looked at further; a short list takes all.
        full = self.id[:, -1] != NONE
        ok = ok & (~full[:, None] | (score >= self.score[:, -1:]))
        for c in np.flatnonzero(ok.any(axis=1)):
            at = np.flatnonzero(ok[c])
            s = score[c, at].astype(np.int64)
            if len(at) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > least)
                # Positions ascend by id, so the first ones of a tie are the ones to keep.
                ties = np.flatnonzero(s == least)[: k - len(above)]
                pick = np.concatenate([above, ties])
                at, s = at[pick], s[pick]
            s = np.concatenate([self.score[c], s])
            i = np.concatenate([self.id[c], ids[at]])
            p = np.concatenate([self.place[c], first + at])
            real = i != NONE
            s, i, p = s[real], i[real], p[real]
            order = np.lexsort((p, i, -s))[:k]
            n = len(order)
            self.score[c, :n], self.id[c, :n], self.place[c, :n] = s[order], i[order], p[order]


class _Cell:
    """The anchors of one cell and the lists they have so far."""

    def __init__(self, anchors: list[dict]) -> None:
        self.dim = anchors[0]["dim"]
        self.place = np.array([a["place"] for a in anchors], np.int64)
        self.id = np.array([a["anchor_id"] for a in anchors], np.int64)
        self.label = np.array([a["label"] for a in anchors], np.int64)
        self.vectors = np.array([np.frombuffer(a["vector"], np.int64) for a in anchors], np.int64).reshape(len(anchors), self.dim)
        self.positives = [a["positives"] for a in anchors]
        # Columns of the lists: an anchor's positives in turn, or the anchor itself while they are searched.
        self.mined = self.positives[0] is not None
        width = [len(p) for p in self.positives] if self.mined else [1] * len(anchors)
        self.column = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
        self.best = _Best.none(int(self.column[-1]), NEGATIVES if self.mined else POSITIVES)
        if self.mined:
            mine = [p["score"] for ps in self.positives for p in ps]
            # 30 p <= 100 s <= 90 p in whole scores; Python's integers don't overflow.
            self.low = np.array([-((-LOW * p) // 100) for p in mine], np.int64)
            self.high = np.array([HIGH * p // 100 for p in mine], np.int64)

    def meet(self, row: dict) -> None:
        ids, labels, planes = _unpacked(row)
        first = row["shard"] * SHARD_ROWS
        groups = max(1, -(-self.dim // 8))
        step = max(1, STEP_BYTES // (8 * max(256 * groups, len(ids))))
        for a in range(0, len(self.id), step):
            b = min(len(self.id), a + step)
            some = self.vectors[a:b]
            # 32 bits where no partial sum can leave them.
            reach = max((sum(map(abs, v)) for v in some.tolist()), default=0) << row["bits"]
            found = scores(subset_sums(some, np.int32 if reach < 1 << 31 else np.int64), planes).T
            same = labels[None, :] == self.label[a:b, None]
            if self.mined:
                owner = np.repeat(np.arange(a, b), np.diff(self.column[a : b + 1])) - a
                low, high = self.low[self.column[a] : self.column[b]], self.high[self.column[a] : self.column[b]]
                # The list's columns in steps, so that no more scores are held than before.
                for c in range(0, len(owner), step):
                    part = owner[c : c + step]
                    s = found[part]
                    ok = ~same[part] & (s >= low[c : c + step, None]) & (s <= high[c : c + step, None])
                    self.best.some(int(self.column[a]) + c, len(part)).add(s, ok, ids, first)
            else:
                own = self.place[a:b] - first
                here = np.flatnonzero((own >= 0) & (own < len(ids)))
                same[here, own[here]] = False
                self.best.some(a, b - a).add(found, same, ids, first)

    def rows(self) -> pa.RecordBatch:
        column, rank = np.nonzero(self.best.id != NONE)
        anchor = np.searchsorted(self.column, column, side="right") - 1
        if self.mined:
            flat = [p for ps in self.positives for p in ps]
            chosen = [flat[c] for c in column]
            positive, worth = pa.array([p["id"] for p in chosen], pa.int64()), pa.array([p["score"] for p in chosen], pa.int64())
        else:
            positive = worth = pa.nulls(len(column), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(self.place[anchor]), pa.array(self.id[anchor]), positive, worth, pa.array(self.best.id[column, rank]),
             pa.array(self.best.place[column, rank]), pa.array(self.best.score[column, rank])],
            names=["place", "anchor_id", "positive_id", "positive_score", "vec_id", "at", "score"])


def _score_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, its anchors before its shards."""
    key, anchors, cell = None, [], None
    for row in _rows(batches):
        if row["cell"] != key:
            if cell is not None:
                yield cell.rows()
            key, anchors, cell = row["cell"], [], None
        if row["planes"] is None:
            anchors.append(row)
        elif anchors:
            if cell is None:
                cell = _Cell(anchors)
            cell.meet(row)
    if cell is not None:
        yield cell.rows()


POSITIVE = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))


def _dealt(anchors: DataFrame, shards: DataFrame, sizes: list, cores: int, cell_rows: int) -> DataFrame:
    """Anchors and shards with the cells they meet in; vectors of different length share none.

    Rows of the grid hold about ``CELL_ANCHORS`` anchors, columns at most about ``cell_rows`` candidates and at least one
    shard, with some more cells than cores where there are enough shards.
    """
    spark = shards.sparkSession
    grid = [(dim, -(-n // CELL_ANCHORS), rows, count) for dim, n, rows, count in sizes if n]
    grid = [(dim, r, max(-(-rows // cell_rows), min(count, -(-3 * cores // r)))) for dim, r, rows, count in grid]
    # One small row for each length of vectors.
    lengths = F.broadcast(spark.createDataFrame(grid, "dim int, across int, down int"))
    name = lambda r, c: F.concat_ws(":", "dim", r, c)
    placed = anchors.join(lengths, "dim").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).withColumn(
        "cell", name(F.pmod(F.xxhash64("place"), F.col("across")), F.col("c")))
    met = shards.join(lengths, "dim").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("across") - 1))).withColumn(
        "cell", name(F.col("r"), F.pmod(F.xxhash64("shard"), F.col("down"))))
    both = placed.select("cell", "place", "dim", "anchor_id", "label", "vector", "positives").unionByName(
        met.select("cell", "shard", "dim", "bits", "n", "ids", "labels", "planes"), allowMissingColumns=True)
    cells = sum(r * c for _, r, c in grid)
    return both.repartition(max(1, min(cells, 1 << 16)), "cell").sortWithinPartitions("cell", F.col("planes").isNotNull(), "place", "shard")


def _shifted(label: F.Column) -> F.Column:
    return F.when(F.col("vec_id") % SHIFT_STEP == 0, (label + 1) % LABELS).otherwise(label)


def hard_negatives(
        vectors: DataFrame, step: int = ANCHOR_STEP, shift: bool = True, shard_rows: int = SHARD_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, embedding, label. Rows with a null id, label or vector, or with a null or non-finite component take
    no part; neither do vectors of different length with each other. A component x counts as floor(256 * x). Anchors are the
    rows whose vec_id is divisible by ``step``; each has its 5 best other rows of its label as positives, and for each of these
    the 10 best rows of another label with 30 to 90 % of the positive's score as negatives; ties go to the smaller vec_id. A
    negative positive_score has none. With ``shift``, the label of rows whose vec_id is divisible by 7 is first moved by one,
    modulo 10. Repeated ids are rows of their own: an anchor leaves out only itself. Components count as within 62 bits;
    scores over 63 bits are not defined.
    """
    if shard_rows > SHARD_ROWS:
        raise ValueError(f"a shard holds at most {SHARD_ROWS} rows")
    spark = vectors.sparkSession
    label = F.col("label").cast("long")
    shards = staged(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), (_shifted(label) if shift else label).alias("label"),
            F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(lambda it: _pack(it, shard_rows), SHARD), "negatives-shards")
    anchors = staged(shards.mapInArrow(
        lambda it: _anchors(it, step), "place long, dim int, anchor_id long, label long, vector binary"), "negatives-anchors")
    counts = {r["dim"]: r["n"] for r in anchors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sizes = [(r["dim"], counts.get(r["dim"], 0), r["n"], r["c"]) for r in shards.groupBy("dim").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()]
    cores = spark.sparkContext.defaultParallelism

    def best(asked: DataFrame, keys: list[str], k: int) -> DataFrame:
        found = _dealt(asked, shards, sizes, cores, cell_rows).mapInArrow(_score_cells, FOUND)
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "at")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    positives = best(anchors.withColumn("positives", F.lit(None).cast(POSITIVE)), ["place"], POSITIVES)
    listed = positives.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "at", "score"))).alias("p"))
    listed = listed.select("place", F.expr("transform(p, x -> named_struct('id', x.vec_id, 'score', x.score))").alias("positives"))
    asked = staged(anchors.join(listed, "place"), "negatives-positives")
    # Two positives may share an id and a score: their negatives are the same, and each has its own rows.
    numbered = asked.withColumn("positives", F.expr("transform(positives, (x, i) -> named_struct('id', i, 'score', x.score))"))
    found = best(numbered, ["place", "positive_id"], NEGATIVES)
    names = asked.select("place", F.posexplode("positives").alias("number", "p")).select(
        "place", F.col("number").cast("long").alias("positive_id"), F.col("p.id").alias("real_id"))
    return found.join(names, ["place", "positive_id"]).select(
        "anchor_id", F.col("real_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
with flat as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding) as x from embeddings where label is not null),
     cells as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, i, floor(256 * cast(x as double)) as v, x from flat),
     bad as (select distinct vec_id from cells where v is null or not isfinite(v)),
     good as (select * from cells where vec_id not in (select vec_id from bad)),
     pairs as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(sum(a.v * c.v) as bigint) as score
               from good a join good c on a.i = c.i and a.vec_id <> c.vec_id where a.vec_id % 100 = 0 group by 1, 2, 3),
     positives as (select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
                   qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
     ranked as (select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
                  row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rk
                from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
                  and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rk as integer) as rank, negative_id, positive_score, negative_score from ranked where rk <= 10
"""
