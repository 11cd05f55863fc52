"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words. A document's expected number of copies is target / source size; its whole
part is fixed, its fraction is rounded by the pivotal method: two undecided documents of a source exchange words
at random, in such a way that the words of both together and each one's expectation stay the same, until one of
them is decided. Buckets of documents do this side by side; the one document that a bucket leaves undecided goes
up a reduction tree, eight nodes to one, until one document a source is left, whose fraction is drawn. A source's
taken words therefore miss its target by less than that document's size; long documents are dealt with first, so that
it is a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroll.llm.common import mix_int, staged

#: Weights of the sources in code point order, repeating; how far a source may be repeated.
WEIGHTS, MOST_COPIES, SEED = (5, 2, 1), 3, 20231
BUCKET_ROWS, FAN_IN = 4096, 8
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of bytes other than space and tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, rows, target): ``sizes`` has source and size; null is a source of its own, the last.

    Targets share the words of all sources by weight and stop at ``most`` times their source; what is over is shared
    again among the others. With sources in order of most * size / weight, the share of one unit of weight is the
    largest over k of (words - limits of those before k) / (weights from k on).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    # One row a source: the windows below see as many rows as there are sources.
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * float(most))
    order = Window.orderBy((F.col("limit") / F.col("w")), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("unit", (F.sum("source_size").over(everything) - before) / behind)
    unit = F.max("unit").over(everything)
    return per.select("source", "source_size", "rows", F.least("limit", unit * F.col("w")).alias("target"))


def _round(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rounds the rows of each (source, node), which come together; a node's undecided row keeps its fraction."""
    held = None  # the undecided row, when it came with an earlier batch

    def filled(rows: pa.RecordBatch, copies: list, fraction: list) -> pa.RecordBatch:
        at = rows.schema.get_field_index
        rows = rows.set_column(at("__copies"), "__copies", pa.array(copies, pa.int64()))
        return rows.set_column(at("__p"), "__p", pa.array(fraction, pa.float64()))

    def settled(p: float) -> int | None:
        return 0 if p <= 1e-9 else 1 if p >= 1 - 1e-9 else None

    node, pend, p_pend, s_pend = None, None, 0.0, 0
    for batch in batches:
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
        keys = list(zip(column("__source"), column("__node"), strict=True))
        size, whole, draw = column("__size"), column("__whole"), column("__draw")
        copies, p = [None] * len(keys), column("__p")

        def decide(index, value, copies=copies, p=p, whole=whole):
            nonlocal held
            if index < 0:
                row, base = held
                held = None
                return filled(row, [base + value], [0.0])
            copies[index], p[index] = whole[index] + value, 0.0
            return None

        for j, key in enumerate(keys):
            if key != node:
                if pend is not None:
                    if last:
                        out = decide(pend, int(_unit(d_pend) < p_pend))  # noqa: F821
                        if out is not None:
                            yield out
                    elif pend >= 0:
                        p[pend] = p_pend
                    else:
                        yield filled(held[0], [None], [p_pend])
                        held = None
                node, pend = key, None
            value = settled(p[j])
            if value is None and not size[j]:
                value = int(_unit(draw[j]) < p[j])
            if value is not None:
                decide(j, value)
                continue
            if pend is None:
                pend, p_pend, s_pend, d_pend = j, p[j], size[j], draw[j]
                continue
            a, b, q = s_pend, size[j], p[j]
            gain, loss = min(a * (1 - p_pend), b * q), min(a * p_pend, b * (1 - q))
            move = gain if _unit(draw[j] * 3 + d_pend) * (gain + loss) < loss else -loss
            p_pend, q = p_pend + move / a, q - move / b
            one, two = settled(p_pend), settled(q)
            if one is not None:
                out = decide(pend, one)
                if out is not None:
                    yield out
                pend = None
            if two is not None:
                decide(j, two)
            elif pend is None:
                pend, p_pend, s_pend, d_pend = j, q, b, draw[j]
            else:  # rounding errors left both open: the smaller is settled by its draw
                decide(j, int(_unit(draw[j]) < q))
        if pend is not None and pend >= 0:
            held = (batch.slice(pend, 1), whole[pend])
            if pend:
                yield filled(batch.slice(0, pend), copies[:pend], p[:pend])
            if pend + 1 < len(keys):
                yield filled(batch.slice(pend + 1), copies[pend + 1 :], p[pend + 1 :])
            pend = -1
        elif len(keys):
            yield filled(batch, copies, p)
    if pend is not None:
        row, base = held
        yield filled(row, [base + int(_unit(d_pend) < p_pend)], [0.0]) if last else filled(row, [None], [p_pend])


def _unit(h: int) -> float:
    return mix_int(h) / 2.0**64


def _level(rows: DataFrame, last: bool) -> DataFrame:
    dealt = rows.repartition("__source", "__node").sortWithinPartitions("__source", "__node", F.desc("__size"), "__draw", "__id")
    return dealt.mapInArrow(lambda it: _round(it, last), rows.schema)


def mix_sources(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``docs`` (with doc_id, source and, without ``size``, text) plus size, source_size, target and copies, the times the mix takes it.

    Every row counts for itself, repeated ones too. A null source is the last source, a null text has no words, a
    document without words is drawn by itself. Reruns over the same rows give the same copies. Existing columns of
    those names are replaced; others are kept.
    """
    docs = docs.drop("source_size", "target", "copies")
    docs = docs.withColumn("size", (word_count(F.col("text")) if size is None else size).cast("long"))
    targets = source_targets(docs.select("source", "size"), weights, most)
    targets = staged(targets, "mix-targets").withColumnsRenamed({c: f"__t_{c}" for c in ("source", "source_size", "rows", "target")})
    rows = docs.join(targets, F.col("source").eqNullSafe(F.col("__t_source")))
    each = F.when(F.col("__t_source_size") > 0, F.col("__t_target") / F.col("__t_source_size")).otherwise(F.lit(1.0))
    draw = F.xxhash64(F.lit(seed), "doc_id", "source", "size")
    rows = rows.select(
        *docs.columns, F.col("__t_source_size").alias("source_size"), F.col("__t_target").alias("target"),
        F.col("source").alias("__source"), F.col("doc_id").alias("__id"), F.col("size").alias("__size"), draw.alias("__draw"),
        F.pmod(F.shiftright(draw, 7), F.ceil(F.col("__t_rows") / BUCKET_ROWS)).cast("long").alias("__node"),
        F.floor(each + 1e-9).cast("long").alias("__whole"), F.greatest(each - F.floor(each + 1e-9), F.lit(0.0)).alias("__p"),
        F.lit(None).cast("long").alias("__copies"))
    nodes = targets.agg(F.max(F.ceil(F.col("__t_rows") / BUCKET_ROWS))).first()[0] or 1
    done = []
    while True:
        last = nodes <= 1
        rows = _level(rows, last)
        if last:
            done.append(rows)
            break
        rows = staged(rows, "mix-level")
        done.append(rows.filter(F.col("__copies").isNotNull()))
        rows = rows.filter(F.col("__copies").isNull()).withColumn("__node", F.floor(F.col("__node") / FAN_IN).cast("long"))
        nodes = -(-nodes // FAN_IN)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*docs.columns, "source_size", "target", F.col("__copies").alias("copies"))


def taken(docs: DataFrame) -> DataFrame:
    """The mix as the contract of the query states it: doc_id, size, source_size, target, taken."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mix_sources(slim, F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs``."""
    held = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mix_sources(held, F.col("size")).filter("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__n")).select("__row.*")
