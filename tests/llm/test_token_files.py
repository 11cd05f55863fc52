import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyroll.llm import token_files as op


def brute(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(op.MODEL))
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, op.END_ID]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1])


@pytest.mark.parametrize("which", ["documents", "odd", "clashing"])
def test_same_as_the_library(which, request):
    df = request.getfixturevalue(which)
    got = sorted((tuple(r) for r in op.documents_token_files(df).collect()), key=key)
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in df.collect()]), key=key)


def test_empty_table(empty):
    assert op.documents_token_files(empty).collect() == []


@pytest.mark.parametrize("n", [1, 5, 127, 128, 1000, 70000])
def test_blocks_decode_from_any_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49407).astype(np.uint16)
    table = op.Table.of(np.bincount(ids, minlength=op.VOCABULARY))
    assert int(table.share.sum()) == 1 << op.SCALE_BITS
    block = op.encode_block(ids, table.share, table.start)
    assert np.array_equal(op.decode_sections(n, block, table.share, table.start, table.symbols), ids)
    sections = len(np.frombuffer(block["places"], "<i8"))
    parts = [op.decode_sections(n, block, table.share, table.start, table.symbols, range(k, k + 1)) for k in reversed(range(sections))]
    assert np.array_equal(np.concatenate(parts[::-1]), ids)
    bad = dict(block, checksums=bytes(len(block["checksums"])))
    with pytest.raises(ValueError):
        op.decode_sections(n, bad, table.share, table.start, table.symbols)
