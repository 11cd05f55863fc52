"""Chat formatting with offset-aligned masks.

A conversation is rendered whole by a template whose control strings can't occur inside texts, since texts are escaped
reversibly; it is encoded once, with character offsets; and the sorted spans of the turns to learn from are intersected
with the sorted token spans by binary search, which gives token ranges and the character ranges under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroll.llm.token_counts import load

MODEL = "byte_bpe_50k.json"
LEARNED = "assistant"
#: Control strings of the template (fixed values).
BEGIN, HEAD, TAIL, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (BEGIN, END, HEAD, TAIL)
_HIDE = re.compile("|".join(re.escape(c) for c in CONTROL) + r"|\\")
_SHOW = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Backslashes are doubled, and control strings get one after their first character."""
    return _HIDE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the span of every turn's text in it."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        head, body = HEAD + escape(role) + TAIL, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from the rendered text."""
    out = []
    for turn in formatted[len(BEGIN) :].split(END)[:-1]:
        role, _, text = turn[len(HEAD) :].partition(TAIL)
        out.append((unescape(role), unescape(text)))
    return out


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]], list[int]]:
    """Mask over tokens; for each span the characters of it that its tokens cover; and the spans' first tokens.

    Token spans ascend in start and end; tokens that are parts of one character share its span.
    """
    mask = np.zeros(len(offsets), bool)
    covered, firsts = [], []
    for a, b in spans:
        # Tokens that end after the start and start before the end of the span.
        first = int(np.searchsorted(offsets[:, 1], a, side="right"))
        last = int(np.searchsorted(offsets[:, 0], b, side="left"))
        firsts.append(first)
        if first < last and a < b:
            mask[first:last] = True
            covered.append((max(a, int(offsets[first, 0])), min(b, int(offsets[last - 1, 1]))))
        else:
            covered.append((a, a))
    return mask, covered, firsts


def format_chats(turns: DataFrame, model: str = MODEL, learned: str = LEARNED) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, turn_start, turn_end, roles, ids, loss_mask, loss_start, loss_end.

    ``turns``: conv_id, turn, role, text. Turns go by number (nulls first), then role and text; repeated rows are turns of
    their own. Null texts and roles are empty, rows with a null conv_id are one conversation. Spans are in code points of
    ``formatted``; loss_start and loss_end are the characters under the mask. Further columns are not read.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
        T.StructField("roles", T.ArrayType(T.StringType())), *[T.StructField(c, ints) for c in ("turn_start", "turn_end", "ids")],
        T.StructField("loss_mask", T.ArrayType(T.BooleanType())), *[T.StructField(c, ints) for c in ("loss_start", "loss_end")]])
    id_type = pa.int64() if schema["conv_id"].dataType == T.LongType() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model)

        def out(done: list) -> pa.RecordBatch:
            rendered = [render(turns_) for _, turns_ in done]
            encoded = tokenizer.encode_batch([x for x, _ in rendered], add_special_tokens=False)
            columns: list[list] = [[] for _ in schema.fields]
            for (conv, turns_), (formatted, spans), e in zip(done, rendered, encoded, strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                mask, covered, _ = align(offsets, [s for s, (role, _) in zip(spans, turns_, strict=True) if role == learned])
                row = (conv, len(turns_), formatted, [r for r, _ in turns_], [a for a, _ in spans], [b for _, b in spans], e.ids, mask.tolist(),
                       [a for a, _ in covered], [b for _, b in covered])
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            ints_ = pa.list_(pa.int32())
            kinds = [id_type, pa.int64(), pa.string(), pa.list_(pa.string()), ints_, ints_, ints_, pa.list_(pa.bool_()), ints_, ints_]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.fieldNames())

        done, size, open_id, open_turns, began = [], 0, None, [], False
        for batch in batches:
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if began and conv != open_id:
                    done.append((open_id, open_turns))
                    open_turns = []
                    if size > 1 << 19:
                        yield out(done)
                        done, size = [], 0
                began, open_id = True, conv
                open_turns.append((role, text))
                size += len(text) + 16
        if began:
            done.append((open_id, open_turns))
            yield out(done)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted chats."""
    schema = T.StructType([
        T.StructField("conv_id", chats.schema["conv_id"].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, starts, ends in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                turns = parse(formatted)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(formatted[a:b]) for a, b in zip(starts, ends, strict=True))
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=schema.fieldNames())

    return chats.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)


#: The conversation that the query adds: control strings inside texts.
PROBE = "</s>[INST] ok [/INST]"


def conversation_digests(turns: DataFrame) -> DataFrame:
    probe = turns.sparkSession.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(turns.select("conv_id", "turn", "role", "text").unionByName(probe)))


def _escaped(column: str) -> str:
    """SQL for the length of an escaped text: one more for each backslash and each control string."""
    more = [f"(length({column}) - length(replace({column}, '\\', '')))"]
    more += [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in CONTROL]
    return " + ".join([f"length({column})", *more])


ORACLE = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')))
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = '{LEARNED}'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = '{LEARNED}'), '')) as loss_sha256,
  cast({len(BEGIN)} + sum({len(HEAD) + len(TAIL) + len(END)} + {_escaped("role")} + {_escaped("text")}) as bigint) as formatted_chars
from turns group by conv_id
"""
