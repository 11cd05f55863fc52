import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyroll.llm import token_counts as op


@pytest.mark.parametrize("which", ["documents", "odd", "clashing"])
def test_same_as_the_library(which, request):
    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(op.MODEL))
    want = []
    for r in df.collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > op.LIMIT))
    assert sorted((tuple(r) for r in op.documents_token_counts(df).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "\n\na", "a\n b", "a \nb", "it's 12 o'clock", "x\ty", "a b", "<|endoftext|>", "a <|endoftext|> b", "\n", "don't\n'll", "a\n\n\nb  c"])
def test_white_space_and_special_strings(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(op.MODEL))
    assert op.Counter(op.MODEL, op.proven(op.MODEL)).count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_proof_and_sentencepiece(spark, empty):
    assert " the" in op.proven(op.MODEL) and len(op.proven(op.MODEL)) > 40000
    assert op.token_counts(empty).collect() == []
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in op.token_counts(df, "piece_bpe_32k.model").collect()) == [(1, 11, 2, False), (2, 0, 0, False)]
