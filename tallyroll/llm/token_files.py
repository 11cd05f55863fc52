"""Token-id files: a static range asymmetric numeral system over interleaved lanes.

One frequency table for the whole data set is counted first and stored with it. Documents lie in ascending order of
their id, in segments; each segment is a run of blocks, each block holds whole documents and is coded by itself:
its tokens are dealt over lanes that share one stream of 32-bit words. A block has the lanes' states and the place in
the stream at several checkpoints, so that it can be decoded from any of them side by side, and a checksum of the ids
between them.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroll.llm.common import U64, staged, text_buffers, slices

MODEL, END_ID = "word_bpe_49k.json", 1
#: Frequencies of the table add up to 2**SCALE_BITS; ids are below VOCABULARY.
SCALE_BITS, VOCABULARY = 20, 1 << 16
BLOCK_TOKENS, LANE_TOKENS, MOST_LANES, SECTION_STEPS = 1 << 19, 128, 2048, 128
SEGMENT_BYTES = 24 << 20
MOST_WORDS = 800_000
#: A known word is one number: where its ids begin, and in the low bits how many there are.
_LENGTH_BITS, _LENGTH = 31, (1 << 31) - 1
CLOSING = ".,;:!?"
LOW = U64(1 << 31)


# --- tokens ---

@lru_cache(maxsize=4)
def load(model: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(model))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Words(dict):
    """Word -> place and number of its ids in ``ids``. The tokenizer never looks across a space or a line feed.

    A word of letters, with or without closing punctuation, is one or two pre-tokens, so its lower-cased letters go
    straight to the merges; other words go through the whole tokenizer. Words met first are kept, later ones for a
    batch only.
    """

    def __init__(self, model: str, end_id: int) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = load(model)
        self.merges, self.spell = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters: dict[str, int] = {}
        self.letter_ids = array("i")
        self.closing: dict[str, list[int]] = {"": []}
        self.ids = array("i", [end_id])
        self.kept = 1
        self.more: dict[str, int] = {}
        self[""], self["\n"] = 0, 1

    def find(self, word: str) -> list[int]:
        core = word.rstrip(CLOSING)
        if not core.isalpha() or not (core.isascii() or max(core) < "\u0100"):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        low = core.lower()
        place = self.letters.get(low)
        if place is None:
            ids = [t.id for t in self.merges.tokenize(low if low.isascii() else self.spell(low)[0][0])]
            if len(self.letters) < MOST_WORDS:
                self.letters[low] = len(self.letter_ids) << _LENGTH_BITS | len(ids)
                self.letter_ids.extend(ids)
        else:
            ids = self.letter_ids[place >> _LENGTH_BITS : (place >> _LENGTH_BITS) + (place & _LENGTH)].tolist()
        end = word[len(core) :]
        after = self.closing.get(end)
        if after is None:
            after = self.tokenizer.encode(end, add_special_tokens=False).ids
            if len(self.closing) < MOST_WORDS:
                self.closing[end] = after
        return ids + after

    def __missing__(self, word: str) -> int:
        value = self.more.get(word)
        if value is None:
            ids = self.find(word)
            value = len(self.ids) << _LENGTH_BITS | len(ids)
            self.ids.extend(ids)
            if len(self) < MOST_WORDS:
                self[word] = value
                self.kept = len(self.ids)
            else:
                self.more[word] = value
        return value

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by the end id, and the number of each."""
        words = " \n ".join([t.replace("\n", " ") for t in texts]).split(" ") if texts else []
        words.append("\n")
        place = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        ends = np.flatnonzero(place == 1)
        length = place & _LENGTH
        upto = np.cumsum(length)
        ids = np.frombuffer(self.ids, np.int32)[np.repeat((place >> _LENGTH_BITS) - (upto - length), length) + np.arange(upto[-1])]
        if self.more:
            self.more.clear()
            del self.ids[self.kept :]
        return ids, np.diff(np.concatenate([[0], upto[ends]]))


@lru_cache(maxsize=1)
def known_words(model: str, end_id: int) -> Words:
    """One a worker process, so that words stay known from task to task."""
    return Words(model, end_id)


TOKENS = T.StructType([
    T.StructField("segment", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("docs", T.BinaryType()), T.StructField("missing", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("tokens", T.BinaryType())])


def tokenized(docs: DataFrame, model: str, end_id: int) -> DataFrame:
    """Blocks of whole documents with their 16-bit ids, in ascending order of (segment, block), written once.

    Texts are dealt into ranges of doc_id before they are encoded, so ids are never shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(spark.sparkContext.defaultParallelism, -(-int(total) // SEGMENT_BYTES))
    dealt = rows.repartitionByRange(segments, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment, words = TaskContext.get().partitionId(), known_words(model, end_id)
        ids, counts, names, size, block = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            row = (segment, block, size, np.array([d or 0 for d in names], "<i8").tobytes(), bytes(d is None for d in names),
                   np.concatenate(counts).astype("<i8").tobytes(), np.concatenate(ids).astype("<u2").tobytes())
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=TOKENS.fieldNames())

        for batch in batches:
            sizes = text_buffers(batch.column(1))[1]
            for first, last in slices(sizes, 1 << 20):
                part = batch.slice(first, last - first)
                some, n = words.encode(part.column(1).to_pylist())
                ids.append(some)
                counts.append(n)
                names += part.column(0).to_pylist()
                size += len(some)
                if size >= BLOCK_TOKENS:
                    yield out()
                    ids, counts, names, size, block = [], [], [], 0, block + 1
        if names:
            yield out()

    return staged(dealt.mapInArrow(run, TOKENS), "token-ids", "zstd")


# --- the shared table ---

def frequencies(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids, of every document. One row an id and task is summed by Spark; the driver gets one an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            data, _ = text_buffers(batch.column(0))
            total += np.bincount(np.frombuffer(data.tobytes(), "<u2"), minlength=VOCABULARY)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(VOCABULARY, np.int64)
    for row in tokens.select("tokens").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row[0]] = row[1]
    return out


@dataclass
class Table:
    """Frequencies that add up to 2**SCALE_BITS; every id that occurs has one of at least 1."""

    share: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Table:
        used = np.flatnonzero(counts)
        if not len(used):
            return Table(np.zeros(len(counts), np.uint64))
        whole = 1 << SCALE_BITS
        exact = counts[used] * ((whole - len(used)) / counts[used].sum())
        part = 1 + np.floor(exact).astype(np.int64)
        left = whole - int(part.sum())
        order = np.lexsort((used, -(exact - np.floor(exact))))
        part[order[:left]] += 1
        share = np.zeros(len(counts), np.uint64)
        share[used] = part.astype(np.uint64)
        return Table(share)

    @property
    def start(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.share)[:-1]]).astype(np.uint64)

    @property
    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.share), dtype=np.uint16), self.share.astype(np.int64))


# --- blocks ---

def encode_block(ids: np.ndarray, share: np.ndarray, start: np.ndarray) -> dict:
    """Header and words of one block. Token i belongs to lane i mod lanes; step t codes one token of each lane."""
    n = len(ids)
    lanes = max(1, min(MOST_LANES, n // LANE_TOKENS))
    steps = -(-n // lanes)
    f_all, c_all = share[ids], start[ids]
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    sections = -(-steps // SECTION_STEPS)
    states, places = [None] * sections, [0] * sections
    for t in range(steps - 1, -1, -1):
        f, c = f_all[t * lanes : (t + 1) * lanes], c_all[t * lanes : (t + 1) * lanes]
        m = len(f)
        x = state[:m]
        full = x >= (f << U64(63 - SCALE_BITS))
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> U64(32), x)
        q = x // f
        state[:m] = (q << U64(SCALE_BITS)) + (x - q * f) + c
        if t % SECTION_STEPS == 0:
            states[t // SECTION_STEPS], places[t // SECTION_STEPS] = state.copy(), len(words)
    sizes = np.cumsum([len(w) for w in words])
    total = int(sizes[-1])
    # The decoder reads what was written last first; a section's words begin where the earlier steps' words end.
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    at = [total - int(sizes[k - 1]) for k in places]
    step = SECTION_STEPS * lanes
    sums = [zlib.crc32(ids[k : k + step].astype("<u4").tobytes()) for k in range(0, n, step)]
    return {"lanes": lanes, "words": stream.astype("<u4").tobytes(), "states": np.concatenate(states).astype("<u8").tobytes(),
            "places": np.array(at, "<i8").tobytes(), "checksums": np.array(sums, "<u4").tobytes()}


def decode_sections(n: int, block: dict, share: np.ndarray, start: np.ndarray, symbols: np.ndarray, only: range | None = None) -> np.ndarray:
    """Ids of the block's sections ``only`` (all by default), each from its own checkpoint and checked."""
    lanes = block["lanes"]
    stream = np.frombuffer(block["words"], "<u4")
    states = np.frombuffer(block["states"], "<u8").reshape(-1, lanes)
    places, sums = np.frombuffer(block["places"], "<i8"), np.frombuffer(block["checksums"], "<u4")
    out = []
    for k in range(len(places)) if only is None else only:
        state, at = states[k].astype(np.uint64), int(places[k])
        first, last = k * SECTION_STEPS * lanes, min(n, (k + 1) * SECTION_STEPS * lanes)
        ids = np.empty(last - first, np.uint16)
        for a in range(0, last - first, lanes):
            m = min(lanes, last - first - a)
            x = state[:m]
            slot = x & U64((1 << SCALE_BITS) - 1)
            symbol = symbols[slot.astype(np.int64)]
            ids[a : a + m] = symbol
            x = share[symbol] * (x >> U64(SCALE_BITS)) + slot - start[symbol]
            need = np.flatnonzero(x < LOW)
            x[need] = x[need] << U64(32) | stream[at : at + len(need)]
            at += len(need)
            state[:m] = x
        if zlib.crc32(ids.astype("<u4").tobytes()) != int(sums[k]):
            raise ValueError(f"checksum of section {k} does not match")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


BLOCK = T.StructType([
    T.StructField("segment", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("docs", T.BinaryType()), T.StructField("missing", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("lanes", T.IntegerType()),
    T.StructField("words", T.BinaryType()), T.StructField("states", T.BinaryType()), T.StructField("places", T.BinaryType()), T.StructField("checksums", T.BinaryType())])


def write_files(docs: DataFrame, model: str = MODEL, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Encodes ``docs`` (doc_id, text) and writes block and table files; gives both read back.

    Documents go by doc_id, nulls first, repeated ids by text; a null text is empty and has the end id alone. Other
    columns are not read. The table has one row an id that occurs: id, share.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, model, end_id)
    table = Table.of(frequencies(tokens))
    used = np.flatnonzero(table.share)
    stored = staged(spark.createDataFrame([(int(i), int(table.share[i])) for i in used], "id int, share long"), "token-table")
    # As large as the vocabulary at most.
    shared = spark.sparkContext.broadcast((table.share, table.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, start = shared.value
        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = dict(zip(batch.schema.names, values, strict=True))
                row |= encode_block(np.frombuffer(row.pop("tokens"), "<u2"), share, start)
                kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in zip(BLOCK.fieldNames(), kinds, strict=True)], names=BLOCK.fieldNames())

    return staged(tokens.mapInArrow(run, BLOCK), "token-files", "uncompressed"), stored


def read_files(blocks: DataFrame, table: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids (little-endian 32-bit) of every document, decoded from the files.

    Without ``with_ids`` every id is decoded and checked as well, but left out of the rows.
    """
    spark = blocks.sparkSession
    share = np.zeros(VOCABULARY, np.uint64)
    for row in table.collect():  # one row an id
        share[row[0]] = row[1]
    shared = spark.sparkContext.broadcast(share)
    # One row a segment goes through the ordered window, then one a block within its segment.
    sums = blocks.groupBy("segment").agg(F.sum("n_tokens").alias("n"))
    whole = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("segment", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("base"))
    inside = Window.partitionBy("segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("segment", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("before")).join(sums, "segment").select(
        "segment", "block", (F.col("base") + F.col("before")).alias("first"))
    schema = "segment int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(shared.value)
        share_, start, symbols = t.share, t.start, t.symbols
        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x = dict(zip(batch.schema.names, values, strict=True))
                ids = decode_sections(x["n_tokens"], x, share_, start, symbols).astype("<u4")
                counts, docs = np.frombuffer(x["counts"], "<i8"), np.frombuffer(x["docs"], "<i8")
                missing = np.frombuffer(x["missing"], np.uint8).astype(bool)
                ends = np.cumsum(counts)
                own = [ids[b - n : b].tobytes() for b, n in zip(ends, counts, strict=True)]
                same = lambda v, k=len(docs): np.full(k, v, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same(x["segment"])), pa.array(same(x["block"])), pa.array(docs.astype(np.int64), mask=missing), pa.array((ends - counts).astype(np.int64)),
                     pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(o) for o in own], pa.int64()), *[pa.array(own, pa.binary())] * with_ids],
                    names=["segment", "block", "doc_id", "inside", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    decoded = blocks.mapInArrow(run, schema)
    return decoded.join(heads, ["segment", "block"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def documents_token_files(docs: DataFrame) -> DataFrame:
    """The columns of the query: the files of all documents, written and read back."""
    return read_files(*write_files(docs), with_ids=False)
