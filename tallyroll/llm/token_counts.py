"""Token counts by the whole-token shortcut.

Before any text is read, every vocabulary string is tried: those that encode alone as one token are proven to cost
one token wherever they stand as a pre-token, since merges never cross pre-tokens. Texts are then cut into
pre-tokens; proven ones count one each, and only the others are merged by the library. Counts of units (a run of
non-space characters with the space or line feed before it) are kept while a partition runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "byte_bpe_50k.json"
LIMIT = 1024
#: Kept units; beyond it the memory starts afresh, which changes no count.
MOST_UNITS = 300_000
#: Pre-tokens of the byte-level models (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with other white space, or with what may be a special string, go whole to the library.
UNUSUAL = regex.compile(r"[^\S \n]|[\x1c-\x1f᠎​﻿]|[ \n]{2}|^[ \n]|[ \n]$|<\|")


@lru_cache(maxsize=4)
def load(model: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(model))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def proven(model: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as exactly one token."""
    tokenizer = load(model)
    strings = sorted({tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())})
    strings = [s for s in strings if s and "�" not in s and "<|" not in s]
    cut = regex.compile(PRE_TOKENS)
    found = []
    for at in range(0, len(strings), 4096):
        part = strings[at : at + 4096]
        encoded = tokenizer.encode_batch_fast(part, add_special_tokens=False)
        found += [s for s, e in zip(part, encoded, strict=True) if len(e.ids) == 1 and cut.findall(s) == [s]]
    return frozenset(found)


class Counter(dict):
    """Tokens of a unit: 'word' stands for ' word', '\\nword' for a line feed and 'word'."""

    def __init__(self, model: str, whole: frozenset[str]) -> None:
        super().__init__()
        self.tokenizer, self.whole, self.cut = load(model), whole, regex.compile(PRE_TOKENS)
        self.merged: dict[str, int] = {}

    def merge(self, piece: str) -> int:
        n = self.merged.get(piece)
        if n is None:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            if len(self.merged) >= MOST_UNITS:
                self.merged.clear()
            self.merged[piece] = n
        return n

    def pieces(self, text: str) -> int:
        whole = self.whole
        return sum(1 if p in whole else self.merge(p) for p in self.cut.findall(text))

    def __missing__(self, unit: str) -> int:
        n = self.pieces("\n") + self.pieces(unit[1:]) if unit[0] == "\n" else self.pieces(" " + unit)
        if len(self) < MOST_UNITS:
            self[unit] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if UNUSUAL.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.pieces(first) + sum(map(self.__getitem__, rest))


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each; other columns are not read. Special
    strings inside texts are recognised, as the library does by default. A ``.model`` file is counted by the
    sentencepiece library, whose pieces do not follow pre-tokens.
    """
    rows = docs.select("doc_id", "text")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    whole = docs.sparkSession.sparkContext.broadcast(proven(model)) if model.endswith(".json") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if whole is not None:
            count = Counter(model, whole.value).count
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
            count = lambda text: len(pieces.encode(text or ""))
        for batch in batches:
            texts = batch.column(1)
            n = np.fromiter((count(t.as_py()) for t in texts), np.int64, len(texts))
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def documents_token_counts(docs: DataFrame) -> DataFrame:
    return token_counts(docs, MODEL, LIMIT).select(F.col("doc_id"), "n_bytes", "n_tokens", "over_limit")
