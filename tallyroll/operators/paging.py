"""Pages of an ordered listing that read their own slices only.

An index of a listing holds how many rows fall into each of a few hundred ranges of the ordering keys, in order. Page N then
finds the ranges it lies in from the counts, and only rows of these are read and sorted: a deep page costs no more than
the first. Values that hold very many rows are ranges of their own and are cut further by the next key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroll.plans.staging import cut

#: Cuts of one key, and rows of a single value from which on the next key cuts it.
CUTS, MOST = 256, 100_000


@dataclass(frozen=True)
class Span:
    """A run of rows in order: the filter that reads them, and how many there are."""

    where: Column
    count: int


def _inside(key: Column, cuts: list, number: int) -> Column:
    if number % 2:
        return key == F.lit(cuts[number // 2])
    i, where = number // 2, key.isNotNull()
    if i:
        where = where & (key > F.lit(cuts[i - 1]))
    return where & (key < F.lit(cuts[i])) if i < len(cuts) else where


def _ranges(rows: DataFrame, keys: list[str], cuts_of: int) -> tuple[dict, dict]:
    """By the values of all keys but the last: the last one's cuts, and the rows of each of its ranges.

    Range 2i lies below cut i, range 2i + 1 is the cut itself, and -1 holds missing values. At most two rows a cut come to the driver.
    """
    *prefix, name = keys
    key = F.col(name)
    shares = F.array(*[F.lit((k + 1) / cuts_of) for k in range(cuts_of)])
    made = rows.groupBy(*prefix).agg(F.percentile_approx(key, shares, 10 * cuts_of).alias("_cuts"))
    # Stored, since estimates may differ from run to run.
    made = cut(made.withColumn("_cuts", F.coalesce(F.array_sort(F.array_distinct("_cuts")), F.array().cast(made.schema["_cuts"].dataType))))
    cuts = {tuple(r[k] for k in prefix): list(r["_cuts"]) for r in made.collect()}
    if prefix:
        on = None
        for k in prefix:
            same = F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
            on = same if on is None else on & same
        held = rows.select(*keys).alias("r").join(F.broadcast(made.alias("c")), on).select("r.*", "c._cuts")
    else:
        held = rows.select(key).withColumn("_cuts", F.array(*[F.lit(c) for c in cuts.get((), [])]).cast(made.schema["_cuts"].dataType))
    number = F.when(key.isNull(), -1).otherwise(
        2 * F.size(F.filter("_cuts", lambda c: c < key)) + F.array_contains("_cuts", key).cast("int"))
    counts: dict = {}
    for r in held.groupBy(*prefix, number.alias("_n")).agg(F.count("*").alias("_c")).collect():
        counts.setdefault(tuple(r[k] for k in prefix), {})[r["_n"]] = r["_c"]
    return cuts, counts


def _spans(rows: DataFrame, keys: list[tuple[str, bool]], cuts_of: int, most: int) -> list[Span]:
    """Ranges of the first key in order; its heavy values cut by the next key, all of a level in one pass."""
    names, levels, here = [k for k, _ in keys], [], rows
    for depth in range(len(keys)):
        cuts, counts = _ranges(here, names[: depth + 1], max(2, cuts_of // 4**depth))
        levels.append((cuts, counts))
        heavy = [(*prefix, None if n == -1 else cuts[prefix][n // 2]) for prefix, of in counts.items() for n, c in of.items() if c > most and n % 2]
        if not heavy or depth + 1 == len(keys):
            break
        # No more values than rows / most.
        wanted = rows.sparkSession.createDataFrame(heavy, rows.select(*names[: depth + 1]).schema).alias("h")
        on = None
        for k in names[: depth + 1]:
            same = F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}"))
            on = same if on is None else on & same
        here = rows.alias("r").join(F.broadcast(wanted), on, "left_semi")

    def walk(depth: int, prefix: tuple, where: Column | None) -> list[Span]:
        cuts, counts = levels[depth]
        key, out = F.col(names[depth]), []
        for n in sorted(counts[prefix], reverse=keys[depth][1]):
            mine = key.isNull() if n == -1 else _inside(key, cuts[prefix], n)
            mine = mine if where is None else where & mine
            below = (*prefix, None if n == -1 else cuts[prefix][n // 2]) if n % 2 else None
            if below is not None and depth + 1 < len(levels) and below in levels[depth + 1][1]:
                out += walk(depth + 1, below, mine)
            else:
                out.append(Span(mine, counts[prefix][n]))
        return out

    return walk(0, (), None) if levels[0][1] else []


@dataclass(frozen=True)
class PageIndex:
    """An index of ``rows`` in the order of ``keys``: (column, descending). Missing values count as the smallest.

    It stands for the rows as they were when it was made; make it once for a stored listing and take any pages.
    """

    rows: DataFrame
    keys: list[tuple[str, bool]]
    spans: list[Span]

    @classmethod
    def of(cls, rows: DataFrame, keys: list[tuple[str, bool]], cuts: int = CUTS, most: int = MOST) -> PageIndex:
        return cls(rows, keys, _spans(rows, keys, cuts, most))

    def total(self) -> int:
        return sum(s.count for s in self.spans)

    def slices(self, number: int, size: int) -> tuple[DataFrame, int, int]:
        """The rows of the ranges that a page lies in, how many these are, and how many of them come before the page."""
        start, before, first, held, where = number * size, 0, 0, 0, F.lit(False)
        for span in self.spans:
            if before + span.count > start and before < start + size:
                first = before if not held else first
                held += span.count
                where = where | span.where
            before += span.count
        return self.rows.filter(where), held, start - first

    def page(self, number: int, size: int) -> DataFrame:
        """Rows number * size and on, ``size`` of them at most, in order."""
        rows, held, skip = self.slices(number, size)
        order = [F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first() for name, down in self.keys]
        return rows.orderBy(*order).offset(skip).limit(size) if held else self.rows.limit(0)
