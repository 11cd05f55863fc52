import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyroll.llm import secrets as op
from tallyroll.llm.common import text_buffers

import numpy as np
import pyarrow as pa


#: The base rules in a spelling of their own: names with either case of their ASCII letters, runs as classes of single characters.
NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else f"{c}?" for c in name) for name in ("password", "passwd", "secret", "token", "api_key"))
QUOTE, BLANKS, VALUE = "(?:\"|')?", "(?: )*", "(?:[A-Z]|[a-z]|[0-9]|[-+/_.=])"
OWN = (("assign", f"(?:{NAMES}){QUOTE}{BLANKS}(?::|=){BLANKS}{QUOTE}(?P<value>{VALUE}+)", 6), ("access", "(?P<value>AKIA(?:[A-Z]|[0-9])+)", 20), ("hex", "(?P<value>(?:[a-f]|[0-9])+)", 24))


def brute(text):
    spans, counts = [], []
    for k, (_, expression, least) in enumerate(OWN):
        own = [(m.start(), k, m.end()) for m in re.finditer(expression, text) if len(m["value"]) >= least]
        counts.append(len(own))
        spans += own
    said = ",".join(f"{OWN[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*counts, hashlib.sha256(said.encode()).hexdigest())


CASES = ["", "password = hunter22", "PassWord:'abc'", "api_key=ABCDEF12 apikey : \"x.y-z_9\"", "token=token=abcdef", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "é AKIA" + "Z" * 30 + "é",
         "f" * 23, "f" * 24, "secret=" + "a1" * 20, "passwd  =  'abcdef", "tokenſ=abcdef", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "sécret=abcdef secret=abcdeé"]


@pytest.mark.parametrize("which", ["documents", "odd", "clashing"])
def test_base_spans(which, request):
    df = request.getfixturevalue(which)
    got = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in op.scan_secrets(df).collect()]
    assert sorted(got, key=repr) == sorted(((r["doc_id"], *brute(r["text"] or "")) for r in df.collect()), key=repr)


def test_cases(spark, empty):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in op.scan_secrets(df).collect()}
    for i, text in enumerate(CASES):
        assert tuple(got[i])[1:5] == brute(text), text
    assert got[13]["spans"].startswith("github:0:40") and got[14]["spans"].startswith("pem:0:")
    assert op.scan_secrets(empty).collect() == []


@given(st.text(alphabet="abAKI=:xghpo_0", max_size=40), st.sampled_from(["gh[po]_[ab0]{2,}", "(ab|ba)x", "A[KI]{2}x?b", "[a-z]+", "abx?=|ho_0", "(a|b)(x|g)(h|p)", "ab*x", "(abc){2,3}", "x(ab)+K"]))
@settings(max_examples=400, deadline=None)
def test_queries_miss_no_match(text, expression):
    """A text with a match is always among the candidates."""
    rules = op.Rules([("r", expression, 0, 0)])
    data, offsets = text_buffers(pa.array(["zz", text, "zz"]))
    found = rules.candidates(rules.rules[0][4], rules.postings(data, offsets), np.arange(3))
    assert not re.search(expression, text) or 1 in found


def test_masking(spark, clashing):
    df = spark.createDataFrame([(1, "x password=abcdef12 " + "f" * 30, "s", 50), (2, "clean", "s", 5), (3, None, None, None)], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in op.mask_secrets(df).collect()}
    assert got == {1: ("x [SECRET] [SECRET]", 19), 2: ("clean", 5), 3: (None, None)}
    assert op.mask_secrets(clashing).columns == clashing.columns


def test_whole_key_blocks_are_masked(spark):
    lines = ["MIIEpAIBAAKCAQEA" + "Zx9+/aB3" * 6] * 3 + ["q1w2=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = "\n".join(lines)
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    cases = {
        f"a\n{begin}\n{body}\n{end}\nb c": "a\n[SECRET]\nb c", f"a {begin}\n{headers}{body}\n{end} b": "a [SECRET] b",
        f"a {begin}\r\n" + "\r\n".join(lines) + f"\r\n{end}\r\nb": "a [SECRET]\r\nb", f'"{begin}\\n' + "\\n".join(lines) + f'\\n{end}\\n"': '"[SECRET]\\n"',
        f"{begin}\n{body}": "[SECRET]", f"{begin}\n{body}\nThis is text.": "[SECRET]\nThis is text.", f"{begin} {' '.join(lines)} {end}": "[SECRET]",
        f"{begin}\n{headers}{body}\n\nmore text": "[SECRET]\n\nmore text", f"{begin} is a line": "[SECRET] is a line", f"{begin}\n{body}\n{end}\n{begin}\n{body}\n{end}": "[SECRET]\n[SECRET]"}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in op.mask_secrets(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
