import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyroll.llm import chat as op

PARTS = st.lists(st.sampled_from([*op.CONTROL, "\\", "/", "a", "é", "🎉", " ", "\n", "[", "<", ""]), max_size=12).map("".join)


@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible(turns):
    formatted, spans = op.render(turns)
    assert op.parse(formatted) == turns
    assert [op.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]
    for a, b in spans:
        assert not any(c in formatted[a:b] for c in op.CONTROL)


def test_masks_align():
    offsets = np.array([(0, 3), (3, 4), (3, 4), (4, 9), (9, 12)])
    mask, covered, _ = op.align(offsets, [(3, 4), (5, 10), (12, 12)])
    assert mask.tolist() == [False, True, True, True, True] and covered == [(3, 4), (5, 10), (12, 12)]


def expected(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    done = []
    for conv, turns in out.items():
        whole, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        done.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(done, key=repr)


@pytest.mark.parametrize("case", ["table", "odd", "empty"])
def test_digests(spark, case):
    if case == "table":
        df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    else:
        rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 0, "assistant", None), (None, 0, "user", "x"),
                (None, 1, "assistant", "\n lead"), (3, 0, "system", ""), (3, 1, "assistant", "long " * 20000), (4, 0, "assistant", op.PROBE)]
        df = spark.createDataFrame(rows if case == "odd" else [], "conv_id long, turn long, role string, text string").selectExpr("*", "'own' as formatted", "1 as ids")
    rows = [tuple(r)[:4] for r in df.collect()] + [(-1, 0, "user", op.PROBE), (-1, 1, "assistant", op.PROBE)]
    got = op.conversation_digests(df).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(rows)


def test_tokens_under_the_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "héllo wörld")], "conv_id long, turn long, role string, text string")
    row = op.format_chats(df).first()
    ids = [i for i, m in zip(row["ids"], row["loss_mask"]) if m]
    assert op.load(op.MODEL).decode(ids) == "héllo wörld" and row["formatted"][row["loss_start"][0] : row["loss_end"][0]] == "héllo wörld"
