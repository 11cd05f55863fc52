"""N-gram Jaccard join over a count-vector R-tree.

A document is the set of its distinct word shingles. Shingles are hashed into groups, and a set is the point of its
group counts: two sets share at most the sum of the smaller counts, group by group, so boxes of points bound the overlap
of everything in them. Sets whose boxes and points leave room for the similarity are compared exactly.

Boxes of many-dimensional counts overlap almost everywhere as long as a box holds unrelated sets, so the root of the
tree is not made of boxes: sets are first dealt into cells which no linked pair can miss. For sizes near b, a linked
pair differs in at most D shingles; with D + 1 groups or more one group holds the same shingles in both, and its content
is the cell. The points of a cell are joined by descending their tree's levels against itself; a cell of more than CELL_ROWS sets is cut
into blocks by size, which are joined each by itself before trees meet across blocks. The parts that pairs within the bounds
connect are the subtrees, each of which gets its texts once, builds its leaves and joins them exactly. A subtree of more
than TILE_SETS sets is cut into tiles that meet pair by pair in tasks of their own. Equal sets are one point throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroll.llm.common import (
    GOLDEN, MOST_TASKS, U64, Forest, bucket_count, components, deal, dealt, grouped, mix, prefix_hashes, span_hashes, staged, text_slices, total_text, word_spans)

TILE_SETS, TILE_SHINGLES = 2048, 4_000_000
#: Points of a leaf, and boxes of a box, of the tree.
LEAF, FAN = 16, 8
#: Tasks that a component's rows are spread over when they learn their first document.
SALTS = 16
CELL_ROWS = 2048
LEAST_AXES, MOST_AXES = 64, 2048
FLUSH_ROWS = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link when 100 * intersection >= percent * union."""

    words: int = 3
    percent: int = 90

    def differ(self, sizes: int) -> int:
        """The most shingles that a linked pair of this many together may differ in."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def least_common(self, sizes):
        """The fewest shingles that a linked pair of this many together shares."""
        return -(-(self.percent * sizes) // (100 + self.percent))

    def levels(self, n: int) -> list[tuple[int, int, int]]:
        """(level, groups, groups that may be empty) for each level in which a set of n takes part.

        A level holds the sets from its bound to the next, one and a half times it, and the larger ones that link into it.
        """
        level, low = 0, 1
        while (high := low + (low + 1) // 2) <= n:
            level, low = level + 1, high
        out = [self._groups(level, high)]
        if level and -(-self.percent * n // 100) < low:
            out.append(self._groups(level - 1, low))
        return [x for x in out if x]

    def _groups(self, level: int, high: int) -> tuple[int, int, int] | None:
        small = high - 1
        most = self.differ(small + small * 100 // self.percent)
        if not most:
            return None  # linked sets of this size are equal
        spare = 1 + most // (20 if self.percent >= 85 else 7)
        return level, most + 1 + spare, spare


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every row; a row with fewer words is one shingle, one without words none."""
    data = LOWER[data]
    start, end, row = word_spans(data, offsets)
    hashes = span_hashes(prefix_hashes(data), start, end)
    ends = np.searchsorted(row, np.arange(len(offsets)))
    m = max(0, len(hashes) - words + 1)
    key = np.zeros(m, np.uint64)
    for k in range(words):
        key = (key + hashes[k : k + m]) * GOLDEN
    key = mix(key)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(key[a : b - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            h = U64(0)
            with np.errstate(over="ignore"):
                for x in hashes[a:b]:
                    h = (h + x) * GOLDEN
            out.append(mix(np.array([h + U64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(own: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that stand for the whole set."""
    one, two = mix(own + U64(len(own))), mix(own ^ GOLDEN)
    return int(one.sum(dtype=np.uint64)), int(two.sum(dtype=np.uint64))


def cells(own: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """The cell keys of a set: one for each group that holds shingles, of each level."""
    out = []
    scrambled = mix(own ^ U64(0x5851F42D4C957F2D))
    for level, groups, spare in rule.levels(len(own)):
        group = ((own >> U64(32)) * U64(groups) >> U64(32)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        key = np.add.reduceat(scrambled, first)
        out.append(mix(key + (group[first] + (level << 32)).astype(np.uint64) * GOLDEN))
        # With more empty groups than that, the group which a link leaves alone may be an empty one.
        if groups - len(first) > spare:
            empty = np.setdiff1d(np.arange(groups), group[first])
            out.append(mix((empty + (level << 32)).astype(np.uint64) * GOLDEN + U64(77)))
    return out


def _emit(batches: Iterator[pa.RecordBatch], rule: Rule, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pieces for the buckets: cell rows (key, set, size) and one row a text (row id, doc id, set key, size)."""
    held: list[list[np.ndarray]] = [[], [], []]
    count = 0
    names = ["bucket", "kind", "piece"]

    def flush() -> Iterator[pa.RecordBatch]:
        key, owner, size = (np.concatenate(c) for c in held)
        # Equal sets of one task send their cells once.
        order = np.lexsort((owner, key))
        keep = np.ones(len(order), bool)
        keep[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        order = order[keep]
        key, owner, size = key[order], owner[order], size[order]
        pieces = list(deal((key >> U64(32)).astype(np.int64) % buckets, [key, owner, size]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in pieces], pa.int32()), pa.array([0] * len(pieces), pa.int32()), pa.array([p for _, p in pieces], pa.binary())], names=names)

    for batch in batches:
        rid, doc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        missing = np.asarray(doc.is_null())
        ids = np.asarray(doc.fill_null(0))
        for first, last, data, offsets in text_slices(batch, most=2 << 20):
            sets = shingle_sets(data, offsets, rule.words)
            keys = np.array([set_key(s) for s in sets], np.uint64).reshape(-1, 2)
            sizes = np.array([len(s) for s in sets], np.uint32)
            pieces = deal((keys[:, 0] >> U64(32)).astype(np.int64) % buckets,
                          [rid[first:last].astype(np.int64), ids[first:last].astype(np.int64), keys[:, 0], keys[:, 1], sizes, missing[first:last].astype(np.uint8)])
            pieces = list(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in pieces], pa.int32()), pa.array([1] * len(pieces), pa.int32()), pa.array([p for _, p in pieces], pa.binary())], names=names)
            spread = [k for k, own in enumerate(sets) if rule.levels(len(own))]
            if spread:
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys[spread, 0] >> U64(32)).astype(np.int64) % buckets, pa.int32()), pa.array([2] * len(spread), pa.int32()),
                     pa.array([int(keys[k, 0]).to_bytes(8, "little") + point(sets[k], axes_for(len(sets[k]))).tobytes() for k in spread], pa.binary())], names=names)
            for own, key in zip(sets, keys[:, 0], strict=True):
                for part in cells(own, rule):
                    held[0].append(part)
                    held[1].append(np.full(len(part), key, np.uint64))
                    held[2].append(np.full(len(part), len(own), np.uint32))
                    count += len(part)
            if count > FLUSH_ROWS:
                yield from flush()
                held, count = [[], [], []], 0
    if count:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch], rule: Rule, cell_rows: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket: the sets that meet others in a cell (with block and blocks of the cell), its points, and the rows of its texts."""
    names = ["rid", "doc_id", "k1", "k2", "n", "cell", "block", "blocks", "point"]
    for (_, kind), rows in grouped(batches, 2):
        pieces = [r[0] for r in rows]
        if kind == 2:
            own = {p[:8]: p[8:] for p in pieces}
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.array([int.from_bytes(k, "little", signed=True) for k in own], pa.int64()), none, none, none, none, none,
                 pa.array(list(own.values()), pa.binary())],
                names=names)
            continue
        if kind:
            rid, doc, k1, k2, n, missing = dealt(pieces, ["<i8", "<i8", "<u8", "<u8", "<u4", "u1"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(doc, mask=missing.astype(bool)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n.astype(np.int64)),
                 *[pa.nulls(len(rid), pa.int64())] * 3, pa.nulls(len(rid), pa.binary())], names=names)
            continue
        key, owner, size = dealt(pieces, ["<u8", "<u8", "<u4"])
        order = np.lexsort((owner, size, key))
        key, owner, size = key[order], owner[order], size[order].astype(np.int64)
        # Neighbours by size in a cell; behind a gap in size nothing can link across it.
        link = np.flatnonzero((key[1:] == key[:-1]) & (owner[1:] != owner[:-1]) & (100 * size[:-1] >= rule.percent * size[1:]))
        if not len(link):
            continue
        rows_ = np.unique(np.concatenate([link, link + 1]))
        # Equal rows of different tasks are one.
        rows_ = rows_[np.concatenate([[True], (key[rows_[1:]] != key[rows_[:-1]]) | (owner[rows_[1:]] != owner[rows_[:-1]])])]
        none = pa.nulls(len(rows_), pa.int64())
        start = np.concatenate([[0], np.flatnonzero(key[rows_[1:]] != key[rows_[:-1]]) + 1])
        count = np.diff(np.concatenate([start, [len(rows_)]]))
        block = (np.arange(len(rows_)) - np.repeat(start, count)) // cell_rows
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.array(owner[rows_].view(np.int64)), none, pa.array(size[rows_]), pa.array(key[rows_].view(np.int64)), pa.array(block),
             pa.array(np.repeat(-(-count // cell_rows), count)), pa.nulls(len(rows_), pa.binary())], names=names)


def _within_bounds(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Of each task: a forest over the sets that some block holds and whose points leave room for a link. Sets of one root are one tree before."""
    number: dict[int, int] = {}
    forest = Forest(0)

    def numbered(k: int) -> int:
        if k not in number:
            number[k] = len(forest.up)
            forest.up.append(number[k])
        return number[k]

    for _, rows in grouped(batches, 3):
        own = [numbered(k1) for _, k1, _, _ in rows]
        for x, (_, _, root, _) in zip(own, rows, strict=True):
            if root is not None:
                forest.union(x, numbered(root))
        trees = np.array([forest.find(x) for x in own])
        if (trees == trees[0]).all():
            continue
        size = np.array([n for n, *_ in rows], np.int64)
        points = [np.frombuffer(p, np.uint16) for *_, p in rows]
        axes = min(map(len, points))
        points = np.stack([p.reshape(-1, axes).sum(axis=0) for p in points]).astype(np.int64)
        for a, b in bounded_pairs(points, size, rule, lambda x, own=own: forest.find(own[x]), trees):
            forest.union(own[a], own[b])
    keys = list(number)
    # The smallest key of each tree is its root in what follows.
    least: dict[int, int] = {}
    for x, k in enumerate(keys):
        root = forest.find(x)
        least[root] = min(least.get(root, k), k)
    found = [(k, least[forest.find(x)]) for x, k in enumerate(keys)]
    found = [(k, r) for k, r in found if k != r]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["a", "b"])


def _across_blocks(large: DataFrame, chained: DataFrame, near, rule: Rule, cell_rows: int) -> DataFrame:
    """``chained`` (node, root), joined across the blocks of ``large`` cells (cell, block, n, k1).

    One set of each tree goes first, where a cell has few trees. Where several are left, the sets outside of the cell's
    largest tree are dealt into chunks, which meet the blocks of that tree and each other: no two sets of different trees
    miss each other, sets of the largest tree don't meet again, and no task holds more than a block and a chunk.
    """
    def rooted() -> DataFrame:
        rows = large.join(chained.withColumnRenamed("node", "k1"), "k1", "left")
        return staged(rows.select("cell", "block", "n", "k1", F.coalesce("root", "k1").alias("root")), "ngram-large")

    def joined(found: DataFrame) -> DataFrame:
        return components(chained.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found), "ngram-subtrees")

    rows = rooted()
    trees = rows.groupBy("cell", "root").agg(F.min(F.struct("n", "k1")).alias("x"))
    few = trees.groupBy("cell").agg(F.count("*").alias("t")).filter(F.col("t").between(2, cell_rows)).select("cell")
    chained = joined(near(trees.join(few, "cell").select("cell", F.lit(0).alias("one"), F.lit(0).alias("two"), "x.n", "x.k1", "root")))
    rows = rooted()
    trees = rows.groupBy("cell", "root").agg(F.count("*").alias("k"))
    cells = trees.groupBy("cell").agg(F.count("*").alias("t"), F.sum("k").alias("all"), F.max(F.struct("k", "root")).alias("most")).filter("t > 1")
    cells = staged(cells.select("cell", F.col("most.root").alias("largest"), F.ceil((F.col("all") - F.col("most.k")) / cell_rows).alias("chunks")), "ngram-open")
    if cells.isEmpty():
        return chained
    rows = rows.join(cells, "cell").withColumn("chunk", F.pmod(F.xxhash64("k1"), F.col("chunks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    inner, open_ = rows.filter("root = largest"), rows.filter("root <> largest")
    spans = inner.groupBy("cell", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    met = open_.drop("block").join(spans, "cell").filter((100 * F.col("high") >= rule.percent * F.col("n")) & (100 * F.col("n") >= rule.percent * F.col("low")))
    sent = inner.select("cell", F.col("block").alias("one"), every.alias("two"), "n", "k1", "root")
    sent = sent.unionByName(met.select("cell", F.col("block").alias("one"), F.col("chunk").alias("two"), "n", "k1", "root"))
    sent = sent.unionByName(open_.withColumn("other", every).select(
        "cell", (-1 - F.least("chunk", "other")).alias("one"), F.greatest("chunk", "other").alias("two"), "n", "k1", "root"))
    return joined(near(sent))


def axes_for(n: int) -> int:
    """Groups of a point: so many that each counts a few shingles, a power of two."""
    return min(MOST_AXES, max(LEAST_AXES, 1 << (n // 6).bit_length()))


def point(own: np.ndarray, axes: int) -> np.ndarray:
    """Group counts by the low bits of the hash. Half as many groups are the sums of both halves of the counts."""
    count = np.bincount((own & U64(axes - 1)).astype(np.int64), minlength=axes)
    if count.max(initial=0) > 0xFFFF:
        raise ValueError("a group count is over 16 bits")
    return count.astype(np.uint16)


# --- subtrees ---

@dataclass(frozen=True)
class Level:
    """Boxes of one level of the tree: upper corners, sizes from and to, and where each box's members begin below."""

    top: np.ndarray
    small: np.ndarray
    large: np.ndarray
    start: np.ndarray

    def over(self, fan: int) -> "Level":
        """The level above: boxes of ``fan`` neighbours."""
        start = np.arange(0, len(self.small), fan)
        return Level(np.maximum.reduceat(self.top, start), np.minimum.reduceat(self.small, start), np.maximum.reduceat(self.large, start),
                     np.append(start, len(self.small)))


def packed_order(points: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Points in the order of the leaves: by size first, then slab by slab along the axis that spreads the slab most, twice over."""
    order = np.argsort(size, kind="stable")
    for slab in (LEAF * FAN * FAN, LEAF * FAN):
        if len(size) > slab // FAN:
            order = np.concatenate([part[np.argsort(points[part, points[part].var(axis=0).argmax()], kind="stable")]
                                    for part in (order[k : k + slab] for k in range(0, len(size), slab))])
    return order


def bounded_pairs(points: np.ndarray, size: np.ndarray, rule: Rule, root, side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs whose sizes fit and whose summed minima reach the overlap they would need.

    An R-tree over the points: leaves of LEAF points next to each other, boxes of FAN boxes above them up to one root. The
    tree meets itself from the root down. Two boxes are opened where their sizes fit and the summed minima of their upper
    corners leave room for a link; boxes that are one tree of links already, by ``root``, are left closed, so a group of near
    copies costs about one pass over its leaves. With ``side``, pairs of different sides only.
    """
    n = len(size)
    if n == 0:
        return
    order = packed_order(points, size)
    p, s = points[order], size[order]
    start = np.arange(0, n, LEAF)
    levels = [Level(np.maximum.reduceat(p, start), np.minimum.reduceat(s, start), np.maximum.reduceat(s, start), np.append(start, n))]
    while len(levels[-1].small) > 1:
        levels.append(levels[-1].over(FAN))

    # A box known to be one tree of links stays one; that tree's root is looked up anew.
    whole = [np.zeros(len(level.small), bool) for level in levels]

    def one_tree(h: int, i: int) -> int | None:
        """The root of everything in box ``i`` of level ``h``, None if it holds several trees."""
        first, last = int(levels[h].start[i]), int(levels[h].start[i + 1])
        if not whole[h][i]:
            if h == 0:
                tree = root(order[first])
                whole[h][i] = all(root(x) == tree for x in order[first + 1 : last])
            else:
                tree = one_tree(h - 1, first)
                whole[h][i] = tree is not None and all(one_tree(h - 1, k) == tree for k in range(first + 1, last))
            if not whole[h][i]:
                return None
        while h:
            first, h = int(levels[h].start[i]), h - 1
            i = first
        return root(order[levels[0].start[i]])

    # Depth first: links found below one pair of boxes close others before they are opened.
    open_ = [(len(levels) - 1, 0, 0)]
    while open_:
        h, i, j = open_.pop()
        tree = one_tree(h, i)
        if tree is not None and (i == j or one_tree(h, j) == tree):
            continue
        level = levels[h]
        mine, other = slice(level.start[i], level.start[i + 1]), slice(level.start[j], level.start[j + 1])
        if h:
            below = levels[h - 1]
            small, large = below.small, below.large
            good = (100 * large[other][None, :] >= rule.percent * small[mine][:, None]) & (100 * large[mine][:, None] >= rule.percent * small[other][None, :])
            room = np.minimum(below.top[mine][:, None, :], below.top[other][None, :, :]).sum(axis=2)
            good &= room >= rule.least_common(small[mine][:, None] + small[other][None, :])
        else:
            room = np.minimum(p[mine][:, None, :], p[other][None, :, :]).sum(axis=2)
            good = room >= rule.least_common(s[mine][:, None] + s[other][None, :])
            if side is not None:
                good &= side[order[mine]][:, None] != side[order[other]][None, :]
        one, two = np.nonzero(good)
        one, two = one + mine.start, two + other.start
        if i == j:
            keep = one <= two if h else one < two
            one, two = one[keep], two[keep]
        if h:
            # Boxes next to each other come off the stack first.
            far = np.argsort(one - two, kind="stable")
            open_ += [(h - 1, int(x), int(y)) for x, y in zip(one[far], two[far], strict=True)]
        else:
            yield from zip(order[one].tolist(), order[two].tolist(), strict=True)


def tree_join(sets: list[np.ndarray], side: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """A forest of links among ``sets``. With two sides, links are looked for between them only.

    Pairs within the bounds are compared exactly, unless links connect them already.
    """
    size = np.array([len(s) for s in sets], np.int64)
    axes = axes_for(int(size.max(initial=0)))
    points = np.stack([point(s, axes) for s in sets]).astype(np.int64)
    forest, links = Forest(len(sets)), []
    for a, b in bounded_pairs(points, size, rule, forest.find, side if len(set(side.tolist())) > 1 else None):
        if forest.find(a) == forest.find(b):
            continue
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * common >= rule.percent * (size[a] + size[b] - common):
            forest.union(a, b)
            links.append((a, b))
    return links


def _join(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Linked sets of each pair of tiles, each hung on the smallest it reaches there."""
    for (_, one, two), rows in grouped(batches, 3):
        known: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        for a in range(0, len(rows), 64):
            raw = [r[0].encode() for r in rows[a : a + 64]]
            data = np.frombuffer(b"".join(raw), np.uint8)
            found = shingle_sets(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]), rule.words)
            for own, (_, tile) in zip(found, rows[a : a + 64], strict=True):
                known.setdefault(set_key(own), (own, tile))
        keys = sorted(known)
        side = np.array([known[k][1] for k in keys]) if one != two else np.zeros(len(keys), np.int64)
        links = tree_join([known[k][0] for k in keys], side, rule)
        if links:
            forest = Forest(len(keys))
            for a, b in links:
                forest.union(a, b)
            found = [(k, forest.find(k)) for k in sorted({k for link in links for k in link})]
            name = lambda k: b"".join(x.to_bytes(8, "big") for x in keys[k])  # noqa: E731, B023
            stars = [(name(k), name(r)) for k, r in found if k != r]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in stars], pa.binary()), pa.array([b for _, b in stars], pa.binary())], names=["a", "b"])


def with_row_id(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__rid", F.xxhash64("doc_id", "text"))


def similar_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """__rid, doc_id, n_shingles, component_id, leads of every row of ``docs`` (doc_id, text); no link is lost.

    Null texts and texts without words have no shingles and link with nothing. Rows with equal sets are linked, repeated
    rows too. component_id is the smallest doc_id of the component (null ids last). ``leads`` marks the row ids of one
    document in each component. Columns other than those two are not read.
    """
    buckets, cell_rows = bucket_count(total_text(docs), 8 << 20), CELL_ROWS
    rows = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("__rid", "doc_id", "text")
    tasks = min(buckets, MOST_TASKS)
    sent = rows.mapInArrow(lambda it: _emit(it, rule, buckets), "bucket int, kind int, piece binary")
    met = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(
        lambda it: _meet(it, rule, cell_rows), "rid long, doc_id long, k1 long, k2 long, n long, cell long, block long, blocks long, point binary")
    met = staged(met, "ngram-cells")
    key = F.unhex(F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")))
    texts = met.filter("rid is not null").select(F.col("rid").alias("__rid"), "doc_id", key.alias("set"), "k1", "n")
    points = met.filter("point is not null").groupBy("k1").agg(F.first("point").alias("point"))
    inside = met.filter("cell is not null").select("cell", "block", "blocks", "n", "k1")
    place = ["cell", "one", "two"]

    def near(sent: DataFrame) -> DataFrame:
        held = sent.join(points, "k1").select(*place, "n", "k1", "root", "point")
        return held.repartition(tasks, *place).sortWithinPartitions(*place, "n", "k1").mapInArrow(lambda it: _within_bounds(it, rule), "a long, b long")

    single = inside.select("cell", F.col("block").alias("one"), F.lit(0).alias("two"), "n", "k1", F.lit(None).cast("long").alias("root"))
    chained = components(near(single), "ngram-subtrees")
    large = inside.filter("blocks > 1")
    if not large.isEmpty():
        chained = _across_blocks(large, chained, near, rule, cell_rows)
    # One text of each set that meets others.
    sets = texts.groupBy("set").agg(F.min(F.struct("doc_id", "__rid", "k1", "n")).alias("x")).select("set", "x.*")
    sets = staged(sets.join(chained.withColumnRenamed("node", "k1"), "k1").select("set", "__rid", "n", "root"), "ngram-sets")
    sizes = sets.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("m")).filter("k > 1")
    tiles = F.greatest(F.ceil(F.col("k") / TILE_SETS), F.ceil(F.col("m") / TILE_SHINGLES)).cast("int")
    sizes = staged(sizes.select("root", tiles.alias("tiles")), "ngram-sizes")
    places = sets.join(sizes, "root").select("__rid", "root", "tiles", F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int").alias("tile"))
    # A tile goes to every pair of tiles it is part of; most subtrees have one tile and go to one task.
    pairs = places.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "__rid", "root", "tile", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"))
    blocks = rows.select("__rid", "text").join(pairs, "__rid").select("root", "one", "two", "text", "tile")
    links = blocks.repartition("root", "one", "two").sortWithinPartitions("root", "one", "two").mapInArrow(
        lambda it: _join(it, rule), "a binary, b binary")
    trees = components(links, "ngram-links").select(F.col("node").alias("set"), "root")
    member = texts.join(trees, "set", "left").withColumn("root", F.coalesce("root", "set"))
    first = member.filter("n > 0").groupBy("root").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__rid")).alias("lead"), F.count("*").alias("rows"))
    # A document without company is its own first. The others' firsts are dealt to SALTS places, and a large component's rows over them.
    first = first.filter("rows > 1").drop("rows").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = member.withColumn("salt", F.pmod(F.xxhash64("__rid"), F.lit(SALTS)).cast("int")).join(first, ["root", "salt"], "left")
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "__rid")
    out = out.withColumn("least", F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("least"))).withColumn("lead", F.coalesce("lead", own))
    alone = F.col("n") == 0
    return out.select(
        "__rid", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("__rid") == F.col("lead.__rid")))).alias("leads"))


def documents_components(docs: DataFrame) -> DataFrame:
    return similar_groups(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, rule: Rule = Rule(5, 80)) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id; a repeated row once."""
    leads = similar_groups(docs, rule).filter("leads").select(F.col("__rid").alias("__r"), F.col("doc_id").alias("__d")).distinct()
    held = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    held = with_row_id(held).select("__row", F.col("doc_id").alias("__d"), F.col("__rid").alias("__r"))
    kept = held.join(leads.withColumnsRenamed({"__r": "__lr", "__d": "__ld"}), (F.col("__r") == F.col("__lr")) & F.col("__d").eqNullSafe(F.col("__ld")))
    return kept.dropDuplicates(["__r", "__d"]).select("__row.*")
