"""Quality rules: fixed base rules, and a hashed n-gram logistic regression trained on labelled rows.

Features are hashed word 1- and 2-grams and hashed character 3- and 5-grams, as shares of all of a text's word or character
grams, so that a score is a mean of weights and scoring is table look-ups in Arrow batches. The model is fitted on a
bounded sample of the labelled rows, its scores are turned into probabilities on rows held out from the fit (Platt's
method), and a text is kept from a fixed probability on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroll.llm.common import GOLDEN, U64, WORD_BYTE, counts_by_row, mix, prefix_hashes, span_hashes, text_slices, word_spans

#: Labelled rows used to fit the model, at most; those with the smallest hash of their id.
MOST_LABELLED = 2000
BITS, EPOCHS, RATE, SHRINK, SEED = 16, 12, 0.5, 1e-6, 7
KEEP_FROM = 0.5
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"

_SIZE = 1 << BITS
_GRAMS = (3, 5)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80  # not a continuation byte
_STEP = U64(0x9FB21C651E98DF25)
_UP = U64(64 - BITS)


def base_counts(data: np.ndarray, offsets: np.ndarray, words=None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    start, end, row = word_spans(data, offsets) if words is None else words[:3]
    hashes = span_hashes(prefix_hashes(data), start, end) if words is None else words[3]
    n = len(offsets) - 1
    n_words = np.bincount(row, minlength=n)
    inside = np.flatnonzero(WORD_BYTE[data] & _HEAD[data])
    symbols = np.flatnonzero(_SYMBOL[data])
    lines = np.zeros(n, np.int64)
    raw = data.tobytes()
    for r in range(n):
        found = [x for x in raw[offsets[r] : offsets[r + 1]].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines[r] = len(found) - len(set(found))
    return {"n_words": n_words, "word_chars": counts_by_row(inside, offsets), "n_symbols": counts_by_row(symbols, offsets),
            "n_dup_lines": lines, "n_repeat_words": _repeated(hashes, row, n)}


def _repeated(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words in windows that their row holds twice or more."""
    m = len(hashes) - WINDOW + 1
    if m < 1:
        return np.zeros(n, np.int64)
    key = mix(row[:m].astype(np.uint64) * GOLDEN)
    for k in range(WINDOW):
        key = key * U64(0x100000001B3) + hashes[k : k + m]
    key = mix(key)
    whole = np.flatnonzero(row[:m] == row[WINDOW - 1 :])
    order = whole[np.argsort(key[whole])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(hashes) + 1, np.int64)
    at = order[twice]
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return np.bincount(row[np.cumsum(step[:-1]) > 0], minlength=n)


def _word_grams(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places and rows of all word 1- and 2-grams."""
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else row
    two = mix(hashes[pair] * U64(3) + hashes[pair + 1]) if len(pair) else hashes[:0]
    return np.concatenate([mix(hashes) >> _UP, two >> _UP]).astype(np.int64), np.concatenate([row, row[pair]])


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts one after another, and the offsets of the texts among them."""
    if not len(data) or data.max() < 0x80:
        return data, offsets
    at = np.flatnonzero(data & 0xC0 != 0x80)
    first = data[at].astype(np.uint32)
    size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    code = np.where(size == 1, first, first & (0xFF >> (size + 1)))
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for k in range(1, 4):
        longer = size > k
        code[longer] = code[longer] << 6 | padded[at[longer] + k] & 0x3F
    return code, np.searchsorted(at, offsets)


def _char_grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Table places of the k-grams that start at each code point but the last k - 1."""
    if len(codes) < k:
        return np.zeros(0, np.int64)
    m = len(codes) - k + 1
    wide = codes.astype(np.uint64)
    value = np.zeros(m, np.uint64)
    for i in range(k):
        value = value * _STEP + wide[i : i + m]
    return ((value + U64(k)) * GOLDEN >> _UP).astype(np.int64)


@dataclass
class Model:
    """Weights of word and character grams, and the line that turns a score into a log-odds."""

    words: np.ndarray
    grams: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        place, of = _word_grams(hashes, row)
        total = np.bincount(of, weights=self.words[place], minlength=n)
        out = total / np.maximum(1, np.bincount(of, minlength=n))
        total, count = np.zeros(n), np.zeros(n, np.int64)
        codes, offsets = characters(data, offsets)
        for k in _GRAMS:
            sums = np.zeros(len(codes) + 1)
            np.cumsum(self.grams[_char_grams(codes, k)], out=sums[1 : max(1, len(codes) - k + 2)])
            upto = np.maximum(offsets[:-1], offsets[1:] - k + 1)
            total += np.where(upto > offsets[:-1], sums[upto] - sums[offsets[:-1]], 0.0)
            count += upto - offsets[:-1]
        return out + total / np.maximum(1, count)

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.shift, -40, 40)))


def features(docs: DataFrame) -> DataFrame:
    """Sparse feature rows: label, places and shares; word grams first, character grams after them."""
    schema = "quality int, place binary, share binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality = batch.column(0).to_pylist()
            places, shares = [], []
            for _, _, data, offsets in text_slices(batch):
                start, end, row = word_spans(data, offsets)
                place, of = _word_grams(span_hashes(prefix_hashes(data), start, end), row)
                codes, cuts = characters(data, offsets)
                for r in range(len(offsets) - 1):
                    own = codes[cuts[r] : cuts[r + 1]]
                    grams = np.concatenate([_char_grams(own, k) for k in _GRAMS])
                    words, n = np.unique(place[of == r], return_counts=True)
                    chars, m = np.unique(grams, return_counts=True)
                    places.append(np.concatenate([words, chars + _SIZE]).astype(np.int32).tobytes())
                    shares.append(np.concatenate([n / max(1, n.sum()), m / max(1, m.sum())]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(quality, pa.int32()), pa.array(places, pa.binary()), pa.array(shares, pa.binary())], names=["quality", "place", "share"])

    return docs.select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """The model fitted on at most ``most`` labelled documents; None when they don't show both classes.

    ``labels``: doc_id, quality (1 good, 0 bad; other and null rows are left out). Without a model nothing is rejected.
    """
    marked = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # The sample's size is bounded by a parameter, so it may be broadcast to find its texts.
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = [(r[0], r[1]) for r in sample.collect()]
    if len({q for _, q in ids}) < 2:
        return None
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(ids, T.StructType([marked.schema["doc_id"], T.StructField("quality", T.IntegerType())])))
    texts = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("quality", "text"), "text").alias("x"))
    rows = features(texts.select("x.quality", "x.text")).collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    y = np.array([r[0] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    place = [np.frombuffer(r[1], np.int32) for r in rows]
    share = [np.frombuffer(r[2], np.float32) for r in rows]
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    used = order[len(rows) // 5 :]
    if len(set(y[used])) < 2 or len(set(y[held])) < 2:
        held = used = order
    balance = np.where(y == 1, 0.5 / y[used].mean(), 0.5 / (1 - y[used]).mean())
    w, seen = np.zeros(2 * _SIZE), np.full(2 * _SIZE, 1e-8)
    bias, lot = 0.0, 64

    def raw(k: int) -> float:
        return float(w[place[k]] @ share[k])

    for _ in range(EPOCHS):
        rng.shuffle(used)
        for at in range(0, len(used), lot):
            part = used[at : at + lot]
            slope = np.array([balance[k] * (1 / (1 + np.exp(-np.clip(raw(k) + bias, -40, 40))) - y[k]) for k in part]) / len(part)
            cells = np.concatenate([place[k] for k in part])
            gradient = np.bincount(cells, weights=np.concatenate([g * share[k] for g, k in zip(slope, part, strict=True)]), minlength=2 * _SIZE)
            gradient += SHRINK * w
            seen += gradient**2
            w -= RATE * gradient / np.sqrt(seen)
            bias -= RATE * slope.sum()
    scores = np.array([raw(k) for k in held])
    slope, shift = _calibrated(scores, y[held])
    return Model(w[:_SIZE].astype(np.float32), w[_SIZE:].astype(np.float32), slope, shift)


def _calibrated(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's line, by Newton's method on smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    centre, spread = scores.mean(), scores.std() + 1e-12
    x = np.stack([(scores - centre) / spread, np.ones(len(y))], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (goal - p) - 1e-6 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / spread), float(b[1] - b[0] * centre / spread)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the counts, base_failed, probability and kept of every row.

    Null and empty texts have no words, so they fail the base rules. Rows are judged each by itself, repeated ones too.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    extra = T.StructType([*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()),
                          T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["row"], *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for first, last, data, offsets in text_slices(batch, most=2 << 20):
                start, end, row = word_spans(data, offsets)
                hashes = span_hashes(prefix_hashes(data), start, end)
                n = base_counts(data, offsets, (start, end, row, hashes))
                failed = (n["n_words"] < LEAST_WORDS) | (100 * n["n_repeat_words"] > MOST_REPEATED_PERCENT * n["n_words"])
                chance = np.ones(last - first) if held is None else held.probability(held.scores(data, offsets, hashes, row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *[pa.array(n[c].astype(np.int64)) for c in COUNTS], pa.array(failed),
                     pa.array(chance), pa.array(~failed & (chance >= keep_from))], names=["row", *extra.fieldNames()])

    return rows.mapInArrow(run, schema).select("row.*", *extra.fieldNames())


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the calibrated probability of every document."""
    return judge(docs, fit(docs, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "probability")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    held = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return judge(held, fit(docs, labels), keep=("__row",)).filter("kept").select("__row.*")
