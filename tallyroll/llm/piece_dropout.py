"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The model's merge rule works through an agenda: of all neighbouring symbols that make a known piece, the one with the
highest score (the leftmost of equals) is merged next. Here a keyed hash of seed, text place and candidate decides
whether a candidate is skipped when its turn comes; a skipped candidate stays skipped until its symbols change.
Skipping gives other segmentations of the same text, which decode to it byte for byte; without it the result is the
library's own.

No piece holds a line feed, or a word mark behind another character, so a text's units (a word with the marks before
it) are segmented each by itself. Every occurrence of a unit has a key of its own, made of seed, document and place. What is
remembered is a unit's merges without skips: an occurrence that skips none of them gets these, and only the others are
segmented anew, side by side: a row of a matrix each, one merge a round.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroll.llm.common import GOLDEN, U64, mix, mix_int, slices, text_buffers

MODEL, RATE, SEED = "piece_bpe_32k.model", 0.1, 1234
MARK = "▁"
MOST_UNITS, LONG_UNIT, ROWS = 150_000, 48, 20_000
#: Symbols from here on are characters without a piece; they become byte pieces.
BARE = 1 << 16
PAD = BARE * 32
NONE = np.int32(2**31 - 1)
_UNITS = re.compile(r"\n[^ \n]*| +[^ \n]*")


class Pieces:
    """The tables of one model."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        known = {names[i]: i for i in normal}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in known):
            raise ValueError("pieces of this model cross units")
        self.char = np.arange(0x110000, dtype=np.int32) + BARE
        for piece, i in known.items():
            if len(piece) == 1 and piece != MARK:
                self.char[ord(piece)] = i
        self.mark = known[MARK]
        pairs = sorted((known[p[:k]] << 16 | known[p[k:]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known)
        self.pair = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int32)
        self.byte = np.zeros(256, np.int32)
        raw: list[bytes] = []
        for i in range(n):
            if sp.is_byte(i):
                value = int(names[i][3:-1], 16)
                self.byte[value] = i
                raw.append(bytes([value]))
            else:
                raw.append(b"" if sp.is_control(i) or sp.is_unknown(i) else names[i].replace(MARK, " ").encode())
        self.raw_length = np.array([len(r) for r in raw])
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    @cached_property
    def joins(self) -> dict[int, tuple[int, int]]:
        """Pair -> (merged symbol, rank), for work on one unit."""
        return dict(zip(self.pair.tolist(), zip(self.merged.tolist(), self.rank[self.merged].tolist(), strict=True), strict=True))

    def join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbol and rank of each pair; rank NONE where there is no such piece."""
        key = left.astype(np.int64) << 16 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        good = (self.pair[at] == key) & (left < BARE) & (right < BARE)
        merged = np.where(good, self.merged[at], 0)
        return merged, np.where(good, self.rank[merged], NONE)

    def symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all units one after another, and the number of each.

        A unit that begins with a line feed stands as it is; before others goes one mark, and spaces are marks.
        """
        spelt = [u if u[:1] == "\n" else " " + u for u in units]
        code = np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32)
        out = self.char[code]
        out[code == 32] = self.mark
        return out, np.fromiter(map(len, spelt), np.int64, len(spelt))

    def spell(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with bare characters as byte pieces, and the new number of each unit."""
        bare = np.flatnonzero(symbols >= BARE)
        if not len(bare):
            return symbols, sizes
        raw = [chr(c).encode() for c in (symbols[bare] - BARE).tolist()]
        length = np.ones(len(symbols), np.int64)
        length[bare] = list(map(len, raw))
        out = np.repeat(symbols, length)
        upto = np.cumsum(length)
        places = np.repeat(upto[bare] - length[bare], length[bare]) + np.concatenate([np.arange(len(r)) for r in raw])
        out[places] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.diff(np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(sizes)])])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, the first mark still in front."""
        length = self.raw_length[ids]
        upto = np.cumsum(length)
        return self.raw[np.repeat(self.raw_start[ids] - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)]


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def skipped(key, start, pair, rate: float):
    """Whether the candidate at this place of the unit is skipped: the same for the same key at any time."""
    return mix(mix(key + start.astype(np.uint64) * GOLDEN) ^ pair.astype(np.uint64)) < U64(min(2**64 - 1, int(rate * 2.0**64)))


def matrix(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Units as rows, with one column more than the longest; what is over holds a symbol that joins with none."""
    out = np.full((len(sizes), int(sizes.max()) + 1), PAD, np.int32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def taken(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` from ``begin`` on, one after another."""
    upto = np.cumsum(length)
    return flat[np.repeat(begin - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)]


def place_keys(documents: np.ndarray, ordinals: np.ndarray, seed: int) -> np.ndarray:
    """Hash of seed, document and the unit's ordinal in it: the key of one occurrence."""
    return mix(mix(documents + ordinals.astype(np.uint64) * GOLDEN) + U64(mix_int(seed)))


def unit_keys(rows: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Hash of seed, draw and symbols of each row, for units outside of documents; padding doesn't count."""
    key = mix(draws.astype(np.uint64) + U64(mix_int(seed)))
    for column in rows.T:
        key = np.where(column == PAD, key, mix(key * U64(31) + column.astype(np.uint64)))
    return key


def segment_one(p: Pieces, symbols: np.ndarray, key: np.uint64, rate: float) -> np.ndarray:
    """One unit by the agenda itself, for long units (and for tests)."""
    n = len(symbols)
    symbol, nxt, prv, alive = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    agenda: list = []

    base, joins, bound = int(key), p.joins, min(2**64 - 1, int(rate * 2.0**64)) if rate > 0 else 0

    def propose(i: int) -> None:
        if i < 0 or nxt[i] >= n or symbol[i] >= BARE or symbol[nxt[i]] >= BARE:
            return
        pair = symbol[i] << 16 | symbol[nxt[i]]
        known = joins.get(pair)
        if known is not None and not (bound and mix_int(mix_int(base + i * int(GOLDEN)) ^ pair) < bound):
            heapq.heappush(agenda, (known[1], i, known[0], symbol[i], symbol[nxt[i]]))

    for i in range(n):
        propose(i)
    while agenda:
        _, i, m, a, b = heapq.heappop(agenda)
        if not alive[i] or symbol[i] != a or nxt[i] >= n or symbol[nxt[i]] != b:
            continue
        gone = nxt[i]
        symbol[i], alive[gone], nxt[i] = m, False, nxt[gone]
        if nxt[i] < n:
            prv[nxt[i]] = i
        propose(prv[i])
        propose(i)
    return np.array([s for s, a in zip(symbol, alive, strict=True) if a], np.int32)


def segment_rows(p: Pieces, rows: np.ndarray, keys: np.ndarray, rate: float, steps: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Units side by side, each the same as by ``segment_one``: all symbols one after another, and the number of each.

    ``steps`` takes (rows, places, pairs) of the merges of each round.
    """
    symbol = rows.copy()
    n, width = symbol.shape[0], symbol.shape[1] - 1
    alive = symbol != PAD

    def ranks(left, right, at, key):
        merged, rank = p.join(left, right)
        some = np.flatnonzero(rank != NONE) if rate > 0 else []
        if len(some):
            pair = left[some].astype(np.int64) << 16 | right[some]
            rank[some[skipped(key[some], at[some], pair, rate)]] = NONE
        return merged, rank

    column = np.arange(width)
    merged, rank = ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel(), np.tile(column, n), np.repeat(keys, width))
    merged, rank = merged.reshape(n, width), rank.reshape(n, width)
    after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
    while width:
        best = rank.argmin(axis=1)
        row = np.flatnonzero(rank[np.arange(n), best] != NONE)
        if not len(row):
            break
        at = best[row]
        gone = after[row, at]
        if steps is not None:
            steps.append((row, at, symbol[row, at].astype(np.int64) << 16 | symbol[row, gone]))
        symbol[row, at] = merged[row, at]
        alive[row, gone] = False
        rank[row, np.minimum(gone, width - 1)] = np.where(gone < width, NONE, rank[row, np.minimum(gone, width - 1)])
        then = np.minimum(after[row, gone], width)
        # Beyond the last symbol stands padding, which joins with nothing.
        ended = gone == width
        then = np.where(ended, width, then)
        after[row, at], before[row, then] = then, at
        right = np.where(then == gone, PAD, symbol[row, then])
        merged[row, at], rank[row, at] = ranks(symbol[row, at], right, at, keys[row])
        lead = np.flatnonzero(before[row, at] >= 0)
        if len(lead):
            r, left = row[lead], before[row[lead], at[lead]]
            merged[r, left], rank[r, left] = ranks(symbol[r, left], symbol[r, at[lead]], left, keys[r])
    return symbol[alive], alive.sum(axis=1)


class Pool:
    """Pieces of varying length, numbered from 0."""

    def __init__(self, kind) -> None:
        self.flat, self.begin, self.length = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, length: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(length) - length])
        self.flat, self.length = np.concatenate([self.flat, flat.astype(self.flat.dtype)]), np.concatenate([self.length, length])

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return taken(self.flat, self.begin[numbers], self.length[numbers])

    def cut(self, n: int) -> None:
        """Leaves only the first ``n`` pieces."""
        if n < len(self.begin):
            self.flat, self.begin, self.length = self.flat[: self.begin[n]].copy(), self.begin[:n], self.length[:n]


class Segmenter(dict):
    """Unit -> number; units met first keep theirs, later ones get one for the batch only."""

    def __init__(self, model: str, rate: float, seed: int) -> None:
        super().__init__()
        self.p, self.rate, self.seed = pieces(model), rate, seed
        self.names: list[str] = []
        self.more: dict[str, int] = {}
        #: Of each unit: first symbols, ids without skips, places and pairs of the merges that lead to them.
        self.first, self.plain, self.place, self.pair = Pool(np.int32), Pool(np.int32), Pool(np.int32), Pool(np.uint32)

    def __missing__(self, unit: str) -> int:
        if len(self) < MOST_UNITS:
            number = self[unit] = len(self.names)
            self.names.append(unit)
            return number
        number = self.more.get(unit)
        if number is None:
            number = self.more[unit] = len(self.names)
            self.names.append(unit)
        return number

    def encode(self, texts: list[str], documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each."""
        numbers, sizes = [], []
        for text in texts:
            parts = text.replace("\n", " \n").split(" ") if text else []
            if "" in parts:
                parts = [u if u[0] == "\n" else u[1:] for u in _UNITS.findall(" " + text)]
            sizes.append(len(parts))
            numbers.append(np.fromiter(map(self.__getitem__, parts), np.int64, len(parts)))
        sizes = np.array(sizes, np.int64)
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self.learn()
        ordinal = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = place_keys(np.repeat(documents, sizes), ordinal, self.seed)
        anew = self.touched(number, key)
        begin, length = self.plain.begin[number], self.plain.length[number]
        own = number[anew]
        found, n = self.segment(self.first.take(own), self.first.length[own], key[anew], self.rate)
        begin[anew], length[anew] = len(self.plain.flat) + np.cumsum(n) - n, n
        ids = taken(np.concatenate([self.plain.flat, found]), begin, length)
        counts = np.diff(np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(sizes)])])
        if self.more:
            # Units beyond the kept ones are forgotten.
            self.more.clear()
            del self.names[len(self) :]
            for pool in (self.first, self.plain, self.place, self.pair):
                pool.cut(len(self))
        return ids, counts

    def learn(self) -> None:
        """Symbols, ids and merges without skips of the units that have none yet."""
        new = self.names[len(self.first.begin) :]
        if not new:
            return
        symbols, sizes = self.p.symbols(new)
        # Of long units hardly an occurrence is without a skip, so nothing but their symbols is kept.
        plain = sizes <= LONG_UNIT if self.rate > 0 else np.ones(len(sizes), bool)
        steps: list = []
        found, n = self.segment(symbols[np.repeat(plain, sizes)], sizes[plain], np.zeros(plain.sum(), np.uint64), 0.0, steps)
        length = np.zeros(len(sizes), np.int64)
        length[plain] = n
        self.first.add(symbols, sizes)
        self.plain.add(found, length)
        unit, place, pair = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else np.zeros((3, 0), np.int64)
        order = np.argsort(unit, kind="stable")
        length = np.zeros(len(sizes), np.int64)
        length[plain] = np.bincount(unit, minlength=int(plain.sum()))
        self.place.add(place[order], length)
        self.pair.add(pair[order], length)

    def touched(self, number: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The occurrences that don't come out as without skips: some merge that leads there is skipped."""
        if self.rate <= 0:
            return np.zeros(0, np.int64)
        out = []
        for a in range(0, len(number), ROWS):
            own = number[a : a + ROWS]
            which = np.repeat(np.arange(len(own)), self.place.length[own])
            hit = self.first.length[own] > LONG_UNIT
            hit[which[skipped(key[a : a + ROWS][which], self.place.take(own), self.pair.take(own), self.rate)]] = True
            out.append(a + np.flatnonzero(hit))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def segment(self, flat: np.ndarray, sizes: np.ndarray, keys: np.ndarray, rate: float, steps: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units given by their first symbols, one after another, and the number of each.

        ``steps`` takes (units, places, pairs) of the merges of all but long units.
        """
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], LONG_UNIT, side="right"))
        parts, counts = [np.zeros(0, np.int32)], np.zeros(len(sizes), np.int64)
        for a in [*range(0, short, ROWS), *range(short, len(order))]:
            part = order[a : min(a + ROWS, short)] if a < short else order[a : a + 1]
            own = taken(flat, begin[part], sizes[part])
            if a < short:
                made: list | None = None if steps is None else []
                found, n = segment_rows(self.p, matrix(own, sizes[part]), keys[part], rate, made)
                if made:
                    steps += [(part[row], at, pair) for row, at, pair in made]
            else:
                found = segment_one(self.p, own, keys[part][0], rate)
                n = np.array([len(found)])
            found, counts[part] = self.p.spell(found, n)
            parts.append(found)
        at = np.zeros(len(sizes), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return taken(np.concatenate(parts), at, counts), counts


@lru_cache(maxsize=1)
def segmenter(model: str, rate: float, seed: int) -> Segmenter:
    """One a worker process, so that units stay known from task to task."""
    return Segmenter(model, rate, seed)


def numbered_copies(docs: DataFrame, name: str) -> DataFrame:
    """doc_id and text of every row, and from 1 on which of the rows with the same two it is."""
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
    return docs.select("doc_id", "text").withColumn(name, F.row_number().over(same))


def encode_pieces(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED, draw: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32, ids and decoded_sha256 (of the text decoded from the ids) of every document.

    Null and empty texts have no ids. The draws depend on doc_id (null: 0), place, unit and seed only, so reruns agree and
    repeated rows get the same ids, unless a further column ``draw`` tells them apart. A word mark that stands in a text is spelt in bytes, so decoding is lossless.
    """
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("ids", ints), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segmenter(model, rate, seed)
        for batch in batches:
            sizes = text_buffers(batch.column(2))[1]
            for first, last in slices(sizes, 1 << 21):
                part = batch.slice(first, last - first)
                documents = np.array(part.column(1).to_pylist(), np.int64).view(np.uint64)
                ids, counts = known.encode(part.column(2).to_pylist(), mix(documents + GOLDEN))
                ends = np.concatenate([[0], np.cumsum(counts)])
                raw = known.p.decode(ids)
                upto = np.concatenate([[0], np.cumsum(known.p.raw_length[ids])])[ends]
                own = ids.astype("<i4")
                crc = [zlib.crc32(own[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                sha = [hashlib.sha256(raw[a + 1 : b] if b > a else b"").hexdigest() for a, b in zip(upto[:-1], upto[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(sizes)[first:last]), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), lists, pa.array(sha)],
                    names=schema.fieldNames())

    key = F.coalesce(F.xxhash64("doc_id"), F.lit(0)) if draw is None else F.xxhash64("doc_id", draw)
    rows = docs.select("doc_id", key.alias("draw"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def decode_pieces(ids: list[int], model: str = MODEL) -> str:
    """The text that the ids were made from."""
    return pieces(model).decode(np.array(ids, np.int64)).tobytes()[1:].decode() if len(ids) else ""
