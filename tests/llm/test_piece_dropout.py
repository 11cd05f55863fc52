import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyroll.llm import piece_dropout as op

TEXTS = ["", " ", "a", "  two  spaces ", "\n", "\nx\n\ny", " \n x", "tab\tq é日本 🎉 z", "a\n b", "x " * 50, "w" * 300, "Hello world, the quick brown fox."]


def encode(texts, rate, seed=1):
    ids, counts = op.Segmenter(op.MODEL, rate, seed).encode(texts, np.arange(len(texts)).astype(np.uint64))
    ends = np.cumsum(counts)
    return [ids[b - n : b].tolist() for b, n in zip(ends, counts, strict=True)]


def test_without_dropout_it_is_the_library(documents):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op.MODEL))
    texts = TEXTS + [r[0] or "" for r in documents.select("text").limit(60).collect()]
    assert encode(texts, 0.0) == [library.encode(t) for t in texts]


@given(st.text(max_size=60), st.integers(0, 5))
@settings(max_examples=150, deadline=None)
def test_lossless(text, seed):
    assert op.decode_pieces(encode([text], 0.3, seed)[0]) == text


def test_rows_are_the_agenda():
    p = op.pieces(op.MODEL)
    flat, sizes = p.symbols(["thing", "unbelievable", "日本語x", "\nfoo", "aaaaaaaaaaaaaaa", "", "  x"] * 8)
    rows = op.matrix(flat, sizes)
    keys = op.unit_keys(rows, np.arange(len(sizes)) % 8, 3)
    for rate in (0.0, 0.2, 0.6):
        found, n = op.segment_rows(p, rows, keys, rate)
        ends, begin = np.cumsum(n), np.cumsum(sizes) - sizes
        for k in range(len(sizes)):
            assert op.segment_one(p, flat[begin[k] : begin[k] + sizes[k]], keys[k], rate).tolist() == found[ends[k] - n[k] : ends[k]].tolist()


def test_segmentations_vary_and_reruns_agree(monkeypatch):
    text = "international " * 40
    first = encode([text], 0.2)[0]
    assert encode([text], 0.2)[0] == first and encode([text], 0.2, 9)[0] != first and len(first) > len(encode([text], 0.0)[0])
    monkeypatch.setattr(op, "MOST_UNITS", 1)
    assert encode([text, "other words here"], 0.2)[0] == first


def test_documents(odd, empty, clashing, rows_of):
    got = op.encode_pieces(odd).collect()
    want = sorted((r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((r["doc_id"] or 0, r["decoded_sha256"]) for r in got) == want
    assert rows_of(op.encode_pieces(clashing)) == rows_of(op.encode_pieces(odd.repartition(3)))
    assert op.encode_pieces(empty).collect() == []


def test_every_occurrence_has_a_draw_of_its_own():
    """Skips come at the rate, frequent units vary too, and each occurrence is the agenda's under its key."""
    n, seed = 20_000, 1234
    for word in ("of", "the", "international"):
        p = op.pieces(op.MODEL)
        ids, counts = op.Segmenter(op.MODEL, op.RATE, seed).encode([word] * n, np.arange(n).astype(np.uint64))
        ends = np.cumsum(counts)
        got = [tuple(ids[b - k : b].tolist()) for b, k in zip(ends, counts, strict=True)]
        flat, _ = p.symbols([word])
        steps: list = []
        plain, _ = op.segment_rows(p, op.matrix(flat, np.array([len(flat)])), np.zeros(1, np.uint64), 0.0, steps)
        share = sum(x != tuple(plain.tolist()) for x in got) / n
        # A skip of the last merge always shows; others may be made up for by other merges.
        assert 0.09 < share < 1.01 - 0.9 ** len(steps), (word, share)
        keys = op.place_keys(np.arange(n).astype(np.uint64), np.zeros(n, np.int64), seed)
        for k in range(0, n, 97):
            assert tuple(op.segment_one(p, flat, keys[k], op.RATE).tolist()) == got[k]
    assert len(set(got)) > 8


def test_copies_of_a_document_have_draws_of_their_own(spark, odd, rows_of):
    text = "international segmentation of repeated documents " * 5
    df = spark.createDataFrame([(1, text)] * 3 + [(2, text), (None, None), (None, None)], "doc_id long, text string")
    apart = op.encode_pieces(op.numbered_copies(df, "copy"), draw="copy")
    got = [r for r in apart.collect() if r["doc_id"] is not None]
    assert len({tuple(r["ids"]) for r in got}) == 4 and {op.decode_pieces(r["ids"]) for r in got} == {text}
    assert rows_of(op.encode_pieces(op.numbered_copies(df.repartition(3), "copy"), draw="copy")) == rows_of(apart)
    assert len({tuple(r["ids"]) for r in op.encode_pieces(df).collect() if r["doc_id"] == 1}) == 1
