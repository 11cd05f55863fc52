"""Removal of repeated substrings by blockwise suffix sorting with a difference-cover sample.

Positions whose remainder modulo PERIOD lies in a difference cover are the sample: for any two positions there is one
shift below PERIOD that brings both onto sample positions. So two equal strings of LENGTH bytes share a sample pair whose
CORE = LENGTH - PERIOD + 1 bytes are equal, with the rest of the strings to the left and right of it.

1. Texts are packed into chunks, written once.
2. A filter: samples whose core occurs nowhere else have no repeat around them. Cores are dealt into buckets by hash, and
   4 bytes of the hash tell which may occur again; samples passed by chance only cost time.
3. The other samples go into suffix buckets, equal cores into the same one, with the bytes of their window. One bucket is sorted at a
   time: its samples by their next LENGTH bytes, which gives every sample its rank, for each depth, from the common prefixes
   of neighbours; and by the bytes before them, read backwards. The suffix that starts ``shift`` bytes before a sample is then ordered by
   the rank of those bytes, and ties, which are what is looked for, by the sample's rank at depth LENGTH - shift; neighbours with the same two ranks have
   LENGTH bytes in common. Each sample gets a mask of shifts whose string starts earlier elsewhere.
4. Masks return to the chunks, where bytes are removed.

Hashes deal rows out and filter; what is equal is decided by ranks of the bytes themselves.

Memory is bounded by a bucket or a chunk; buckets grow in number with the input, not in size, and a task that gets many takes one at a
time. The filter also counts: a core that may occur more than ``hot_rows`` times would fill its bucket, so its samples send their
strings, whole and shift by shift, to buckets of the strings' own hashes. Equal strings and windows of a chunk go on as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroll.llm.common import MOST_TASKS, U64, bucket_count, deal, dealt, grouped, mix, slices, staged, text_buffers, total_text

LENGTH = 100
#: A perfect difference cover (fixed values): every remainder modulo PERIOD is a difference of two of them.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
CORE, SIDE = LENGTH - PERIOD + 1, PERIOD - 1
WINDOW = SIDE + LENGTH
CHUNK_BYTES, BUCKET_BYTES, HOT_ROWS, SLAB = 4 << 20, 8 << 20, 20_000, 1 << 16
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True

CHUNK = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("docs", T.BinaryType()),
                      T.StructField("missing", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("packed", T.BinaryType())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole texts, compressed; a chunk is named by the task and a running number, in 32 bits."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    ids, missing, sizes, texts, held = [], [], [], [], 0

    def out() -> pa.RecordBatch:
        nonlocal number
        if part >= 1 << 20 or number >= 1 << 12:
            raise ValueError("a chunk's number has 20 bits for the task and 12 for the chunk: read the texts in more, or fewer, tasks")
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        row = [part << 12 | number, sum(map(len, ids)), np.concatenate(ids).tobytes(), np.concatenate(missing).tobytes(), np.concatenate(sizes).tobytes(), packed]
        number += 1
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=CHUNK.fieldNames())

    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        doc = batch.column(0)
        values, none = np.asarray(doc.fill_null(0)).astype("<i8"), np.asarray(doc.is_null()).astype("u1")
        for first, last in slices(offsets, CHUNK_BYTES):
            some = data[offsets[first] : offsets[last]].tobytes()
            if ids and held + len(some) > CHUNK_BYTES:
                yield out()
                ids, missing, sizes, texts, held = [], [], [], [], 0
            ids.append(values[first:last])
            missing.append(none[first:last])
            sizes.append(np.diff(offsets[first : last + 1]).astype("<i8"))
            texts.append(some)
            held += len(some)
    if ids:
        yield out()


def unpack(packed: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a chunk."""
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(offsets[-1]) or 1)
    return np.frombuffer(raw, np.uint8), offsets


def samples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cover positions that lie in some string of LENGTH bytes of their text, with the bytes there are to the left and right of the core, SIDE at most."""
    at = (np.arange(0, len(data), PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
    at = at[at + CORE <= len(data)]
    row = np.searchsorted(offsets, at, side="right") - 1
    left = np.minimum(SIDE, at - offsets[row])
    right = np.minimum(SIDE, offsets[row + 1] - at - CORE)
    use = np.flatnonzero((right >= 0) & (left + right >= SIDE))
    return at[use], left[use], right[use]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def core_hashes(words: np.ndarray, at: np.ndarray, salt: int = 1) -> np.ndarray:
    """64-bit hashes of the cores at the positions."""
    key = np.full(len(at), salt, np.uint64)
    for k in range(0, CORE, 8):
        x = words[at + k]
        if CORE - k < 8:
            x = x & U64((1 << 8 * (CORE - k)) - 1)
        key = mix(key + x * U64(0x9FB21C651E98DF25))
    return key


def _filter_values(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket << 32 | value) of a chunk's cores in order, each one's count, and each core's entry."""
    entry = _bucket(key, buckets).astype(np.uint64) << U64(32) | key & U64(0xFFFFFFFF)
    distinct, of, count = np.unique(entry, return_inverse=True, return_counts=True)
    return distinct, count, of


def _sample_values(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each bucket the distinct values of a chunk's cores, with the counts' powers of two."""
    for batch in batches:
        for chunk, _, _, _, sizes, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data, offsets = unpack(packed, sizes)
            distinct, count, _ = _filter_values(core_hashes(_words(data), samples(data, offsets)[0]), buckets)
            power = np.ceil(np.log2(count)).astype("u1")
            pieces = list(deal((distinct >> U64(32)).astype(np.int64), [distinct.astype("<u4"), power]))
            if pieces:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in pieces], pa.int32()), pa.array([chunk] * len(pieces), pa.int64()), pa.array([p for _, p in pieces], pa.binary())],
                    names=["bucket", "chunk", "piece"])


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _met(batches: Iterator[pa.RecordBatch], hot_rows: int) -> Iterator[pa.RecordBatch]:
    """For each piece of a bucket two bits a value: whether its core may occur again, and whether too often for one bucket."""
    for (bucket,), rows in grouped(batches, 1):
        values, power = dealt([p for _, p in rows], ["<u4", "u1"])
        _, of, pieces = np.unique(values, return_inverse=True, return_counts=True)
        total = np.bincount(of, weights=np.exp2(power.astype(float)))
        again, hot = (total[of] > 1) | (pieces[of] > 1), total[of] > hot_rows
        at, out = 0, []
        for _, piece in rows:
            n = len(piece) // 5
            span = slice(at, at + n)
            out.append(np.packbits(again[span]).tobytes() + np.packbits(hot[span]).tobytes() if again[span].any() else None)
            at += n
        found = [k for k, o in enumerate(out) if o is not None]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[k][0] for k in found], pa.int64()), pa.array([bucket] * len(found), pa.int32()), pa.array([out[k] for k in found], pa.binary())],
                names=["chunk", "bucket", "bits"])


OCCURRENCE = ["u1", "<i8", "<u8", "u1", "u1", f"V{WINDOW}"]


def _windows(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """SIDE bytes before and LENGTH bytes from each sample on; what lies outside of its text is zero."""
    padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    out = np.empty((len(at), WINDOW), np.uint8)
    column = np.arange(WINDOW)
    for k in range(0, len(at), SLAB):
        part = slice(k, k + SLAB)
        out[part] = padded[at[part, None] + column[None, :]]
        out[part][(column[None, :] < SIDE - left[part, None]) | (column[None, :] >= SIDE + CORE + right[part, None])] = 0
    return out


def _piece_rows(kind: int, pieces: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(pieces), pa.int32()), pa.array([b for b, _ in pieces], pa.int64()), pa.array([p for _, p in pieces], pa.binary())],
        names=["kind", "bucket", "piece"])


def _occurrences(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Samples that passed the filter: of equal windows the first of the chunk; the others' masks are settled here.

    Kinds: 0 samples with their windows, 1 masks, 2 strings of cores that are too frequent for one bucket.
    """
    for (chunk,), rows in grouped(batches, 1):
        body = next(r for r in rows if r[0] == -1)
        bits = sorted((r[0], r[1]) for r in rows if r[0] != -1)
        if not bits:
            continue
        _, _, ids, missing, sizes, packed = body
        data, offsets = unpack(packed, sizes)
        at, left, right = samples(data, offsets)
        key = core_hashes(_words(data), at)
        distinct, _, of = _filter_values(key, buckets)
        found = np.array([b for b, _ in bits], np.uint64) << U64(32)
        again, often = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        for (_, two), first, last in zip(bits, np.searchsorted(distinct, found), np.searchsorted(distinct, found + U64(1 << 32)), strict=True):
            two = np.frombuffer(two, np.uint8)
            again[first:last] = np.unpackbits(two[: len(two) // 2], count=last - first)
            often[first:last] = np.unpackbits(two[len(two) // 2 :], count=last - first)
        some = np.flatnonzero(again[of])
        at, left, right, key, often = at[some], left[some], right[some], key[some], often[of[some]]
        row = np.searchsorted(offsets, at, side="right") - 1
        window = _windows(data, at, left, right)
        none = np.frombuffer(missing, "u1")[row]
        doc = np.frombuffer(ids, "<i8")[row]
        # Texts without an id come last; equal ids go by chunk and place.
        place = np.uint64(chunk) << U64(32) | at.astype(np.uint64)
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((place, doc, none))] = np.arange(len(at))
        value = _hash_rows(window) + mix(left.astype(np.uint64) * U64(64) + right.astype(np.uint64))
        group = np.lexsort((rank, value))
        repeat = np.zeros(len(at), bool)
        repeat[group[1:]] = (value[group[1:]] == value[group[:-1]]) & (left[group[1:]] == left[group[:-1]]) & (
            right[group[1:]] == right[group[:-1]]) & (window[group[1:]] == window[group[:-1]]).all(axis=1)
        valid = _valid(left, right)
        rest = np.flatnonzero(repeat)
        if len(rest):
            yield _piece_rows(1, [(chunk, _masks(at[rest], valid[rest]))])
        lead = np.flatnonzero(~repeat & ~often)
        columns = [none[lead], doc[lead], place[lead], left[lead].astype("u1"), right[lead].astype("u1"), window[lead].view(f"V{WINDOW}").ravel()]
        yield _piece_rows(0, [(b, zstandard.ZstdCompressor(level=3).compress(p)) for b, p in deal(_bucket(mix(key[lead]), buckets), columns)])
        lead = np.flatnonzero(~repeat & often)
        for k in range(0, len(lead), SLAB):
            for shift in range(SIDE + 1):
                own = lead[k : k + SLAB]
                own = own[(valid[own] >> U64(shift) & U64(1)).astype(bool)]
                if len(own):
                    strings = np.ascontiguousarray(window[own, SIDE - shift : SIDE - shift + LENGTH])
                    columns = [none[own], doc[own], place[own], np.full(len(own), shift, "u1"), strings.view(f"V{LENGTH}").ravel()]
                    pieces = deal(_bucket(_hash_rows(strings) ^ mix(np.full(len(own), shift, np.uint64)), buckets), columns)
                    yield _piece_rows(2, [(b, zstandard.ZstdCompressor(level=3).compress(p)) for b, p in pieces])


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    width = -(-rows.shape[1] // 8) * 8
    if width != rows.shape[1]:
        rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    out = np.zeros(len(rows), np.uint64)
    for x in np.ascontiguousarray(rows).view("<u8").T:
        out = mix(out + x * U64(0x9FB21C651E98DF25))
    return out


def _valid(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits of the shifts whose string lies inside the text: SIDE - right to left."""
    one = U64(1)
    upto = (one << (left.astype(np.uint64) + one)) - one
    return upto & ~((one << (U64(SIDE) - right.astype(np.uint64))) - one)


def _masks(at: np.ndarray, mask: np.ndarray) -> bytes:
    """Positions and masks of one chunk."""
    return at.astype("<u4").tobytes() + mask.astype("<u8").tobytes()


def sorted_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of equally long byte rows, and how many bytes each shares with the one before in that order."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    shared = np.zeros(len(rows), np.int64)
    for k in range(1, len(rows), SLAB):
        part = np.arange(k, min(len(rows), k + SLAB))
        differ = rows[order[part]] != rows[order[part - 1]]
        shared[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, shared


def ranks(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every row by its first ``depth`` bytes; rows with the same ones have the same rank."""
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(shared < depth).astype(np.uint64)
    return out


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of the samples of each suffix bucket, and of the strings of each bucket of frequent ones."""
    for (kind, bucket), rows in grouped(batches, 2):
        if kind == 1:  # settled where it was found
            yield _piece_rows(1, [(bucket, p) for (p,) in rows])
            continue
        raw = [zstandard.ZstdDecompressor().decompress(p) for (p,) in rows]
        if kind == 2:
            yield from _settle(raw)
            continue
        none, doc, place, left, right, window = dealt(raw, OCCURRENCE)
        del raw
        # Rows in the order of the texts, so that the first of equal strings stands first.
        first = np.lexsort((place, doc, none))
        place, left, right = place[first], left[first], right[first]
        window = np.frombuffer(window[first].tobytes(), np.uint8).reshape(-1, WINDOW)
        valid = _valid(left, right)
        # The cover samples in suffix order, and the bytes before them in the order in which suffixes meet them.
        behind, ahead = sorted_prefixes(window[:, SIDE:]), sorted_prefixes(window[:, SIDE - 1 :: -1])
        of = ranks(*behind, CORE).astype(np.int64)
        whole = ranks(*behind, LENGTH) << U64(32) | ranks(*ahead, SIDE)
        order = np.lexsort((np.arange(len(whole)), right, left, whole))
        same = (whole[order[1:]] == whole[order[:-1]]) & (left[order[1:]] == left[order[:-1]]) & (right[order[1:]] == right[order[:-1]])
        mask = np.zeros(len(whole), np.uint64)
        repeat = np.zeros(len(whole), bool)
        repeat[order[1:][same]] = True
        mask[repeat] = valid[repeat]
        # What is left: one sample for each window; classes with one of them have nothing to compare.
        tried = np.flatnonzero(~repeat & (np.bincount(of[~repeat], minlength=of.max() + 1)[of] > 1))
        for shift in range(SIDE + 1):
            own = tried[(valid[tried] >> U64(shift) & U64(1)).astype(bool)]
            # The suffix that starts ``shift`` bytes before: those bytes, then the sample's rank at the depth that is left.
            suffix = ranks(*ahead, shift)[own] << U64(32) | ranks(*behind, LENGTH - shift)[own]
            by = np.argsort(suffix, kind="stable")
            mask[own[by[1:][suffix[by[1:]] == suffix[by[:-1]]]]] |= U64(1) << U64(shift)
        yield from _returned(place, mask)


def _returned(place: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Masks on their way to their chunks."""
    set_ = np.flatnonzero(mask)
    if not len(set_):
        return
    set_ = set_[np.argsort(place[set_], kind="stable")]
    chunk, at, mask = (place[set_] >> U64(32)).astype(np.int64), (place[set_] & U64(0xFFFFFFFF)).astype(np.int64), mask[set_]
    cuts = np.flatnonzero(np.diff(chunk)) + 1
    spans = list(zip([0, *cuts], [*cuts, len(chunk)], strict=True))
    yield pa.RecordBatch.from_arrays(
        [pa.array([1] * len(spans), pa.int32()), pa.array([int(chunk[a]) for a, _ in spans], pa.int64()), pa.array([_masks(at[a:b], mask[a:b]) for a, b in spans], pa.binary())],
        names=["kind", "bucket", "piece"])


def _settle(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Strings of frequent cores: of equal ones at the same shift all but the first start earlier elsewhere."""
    none, doc, place, shift, strings = dealt(raw, ["u1", "<i8", "<u8", "u1", f"V{LENGTH}"])
    first = np.lexsort((place, doc, none))
    strings = np.frombuffer(strings[first].tobytes(), np.uint8).reshape(-1, LENGTH)
    order, shared = sorted_prefixes(np.concatenate([shift[first][:, None], strings], axis=1))
    later = first[order[shared > LENGTH]]
    yield from _returned(place[later], U64(1) << shift[later].astype(np.uint64))


def covered(n: int, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Bytes of a chunk that lie in a string which starts earlier elsewhere."""
    one = U64(1)
    low, high = mask & ~(mask << one), mask & ~(mask >> one)  # ends of the runs of shifts
    begin, end = [], []
    for shift in range(SIDE + 1):
        begin.append(at[high >> U64(shift) & one == 1] - shift)
        end.append(at[low >> U64(shift) & one == 1] - shift + LENGTH)
    step = np.bincount(np.concatenate(begin), minlength=n + 1) - np.bincount(np.concatenate(end), minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for _, rows in grouped(batches, 1):
        _, _, ids, missing, sizes, packed = next(r for r in rows if r[0] == -1)
        data, offsets = unpack(packed, sizes)
        at, mask = dealt([r[1] for r in rows if r[0] == 1], ["<u4", "<u8"])
        gone = covered(len(data), at.astype(np.int64), mask) if len(at) else np.zeros(len(data), bool)
        count = np.concatenate([[0], np.cumsum(gone)])
        start = gone.copy()
        start[1:] &= ~gone[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        start[cuts] = gone[cuts]
        runs = np.concatenate([[0], np.cumsum(start)])
        left = [data[a:b][~gone[a:b]].tobytes() if count[b] > count[a] else data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        columns = [pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(missing, "u1").astype(bool)), pa.array(np.diff(offsets)),
                   pa.array(np.diff(count[offsets])), pa.array(np.diff(runs[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns.append(pa.array(left, pa.binary()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, with_text: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every row of ``docs`` (doc_id, text).

    Removed is every byte inside LENGTH bytes that also start earlier, in a document of smaller doc_id or earlier in the same
    one; strings never cross documents and are judged on the input. A null text is empty. Null ids come last; rows of the same
    id come in the order in which they were read and packed. Other columns are not read.
    """
    buckets = bucket_count(total_text(docs), BUCKET_BYTES)
    tasks = min(buckets, MOST_TASKS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = staged(rows.mapInArrow(_pack, CHUNK), "substring-chunks", "uncompressed")
    values = chunks.mapInArrow(lambda it: _sample_values(it, buckets), "bucket int, chunk long, piece binary")
    met = staged(values.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(
        lambda it: _met(it, hot_rows), "chunk long, bucket int, bits binary"), "substring-filter")
    body = chunks.select("chunk", F.lit(-1).alias("kind"), F.lit(None).cast("binary").alias("piece"), "n", "docs", "missing", "sizes", "packed")
    nothing = [F.lit(None).cast("long").alias("n"), *[F.lit(None).cast("binary").alias(c) for c in ("docs", "missing", "sizes", "packed")]]

    def beside(pieces: DataFrame) -> DataFrame:
        """Chunks with the pieces that belong to them, chunk by chunk."""
        both = body.unionByName(pieces.select(*pieces.columns, *nothing))
        return both.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind").select(
            "chunk", "kind", "piece", "docs", "missing", "sizes", "packed")

    found = beside(met.select("chunk", F.col("bucket").alias("kind"), F.col("bits").alias("piece"))).mapInArrow(
        lambda it: _occurrences(it, buckets), "kind int, bucket long, piece binary")
    # Samples are the largest thing on the way: they are shuffled once and never stored.
    masks = staged(found.select("kind", "bucket", "piece").repartition(tasks, "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(
        _sort_buckets, "kind int, bucket long, piece binary"), "substring-masks", "uncompressed")
    masks = masks.select(F.col("bucket").alias("chunk"), "kind", "piece")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return beside(masks).mapInArrow(lambda it: _remove(it, with_text), schema)

