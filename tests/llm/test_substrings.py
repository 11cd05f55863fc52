import hashlib

import numpy as np
import pytest

from tallyroll.llm import substring_dedup as op


def brute(texts):
    """(bytes, removed, spans, digest) of texts in order."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - op.LENGTH + 1):
            window = raw[i : i + op.LENGTH]
            if window in seen:
                gone[i : i + op.LENGTH] = True
            seen.add(window)
        start = gone.copy()
        start[1:] &= ~gone[:-1]
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((len(raw), int(gone.sum()), int(start.sum()), hashlib.sha256(left).hexdigest()))
    return out


def test_cover_reaches_every_difference():
    assert {(a - b) % op.PERIOD for a in op.COVER for b in op.COVER} == set(range(op.PERIOD))


@pytest.mark.parametrize("hot_rows", [op.HOT_ROWS, 1])
def test_same_as_brute_force(spark, documents, hot_rows):
    rows = sorted(documents.select("doc_id", "text").collect())
    got = {r[0]: tuple(r[1:]) for r in op.remove_repeats(documents, hot_rows=hot_rows).collect()}
    assert [got[r[0]] for r in rows] == brute([r[1] for r in rows])


def test_edges(spark, rows_of):
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    texts = [base[:99], base[:100], base[:100], base[50:260], "zz" + base[40:300] + "yy" + base[40:300], None, "", "a" * 350, "é" * 60, "é" * 60, base[101:200]]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, n_removed string")
    got = sorted(tuple(r) for r in op.remove_repeats(df.repartition(3)).collect())
    assert [g[1:] for g in got] == brute(texts)


def test_odd_rows(odd, empty, clashing, rows_of):
    got = rows_of(op.remove_repeats(odd))
    assert len(got) == odd.count() and rows_of(op.remove_repeats(clashing)) == got
    assert op.remove_repeats(empty).collect() == []
    kept = {r["doc_id"]: bytes(r["kept"]) for r in op.remove_repeats(odd, with_text=True).collect()}
    assert kept[4] == b"one" and len(kept[9]) < 400


def test_ranks_order_rows_by_any_depth():
    draw = np.random.default_rng(4)
    rows = draw.integers(0, 2, (300, 9), dtype=np.uint8)
    order, shared = op.sorted_prefixes(rows)
    assert [bytes(r) for r in rows[order]] == sorted(bytes(r) for r in rows)
    for depth in range(10):
        rank = op.ranks(order, shared, depth)
        heads = [bytes(r[:depth]) for r in rows]
        number = {h: k for k, h in enumerate(sorted(set(heads)))}
        assert [number[h] for h in heads] == (rank - rank.min()).tolist()
