import re
from collections import Counter

import numpy as np
import pytest

from tallyroll.llm import quality as op


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("which", ["documents", "odd", "clashing"])
def test_base_counts(which, request):
    df = request.getfixturevalue(which)
    got = op.judge(df, None).collect()
    want = []
    for r in df.collect():
        n = brute(r["text"] or "")
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        want.append((r["doc_id"], *n, failed, 1.0, not failed))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    judged = op.judge(docs, op.fit(docs, train)).join(test, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in judged)
    assert len(judged) > 100 and right >= 0.97 * len(judged)


def test_without_labels(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(None, 1, 0), (4, None, 0), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert op.fit(odd, labels) is None
    assert sorted(r["doc_id"] or 0 for r in op.kept_documents(odd, labels).collect()) == sorted(
        r["doc_id"] or 0 for r in odd.collect() if brute(r["text"] or "")[0] >= 10 and 100 * brute(r["text"])[4] <= 20 * brute(r["text"])[0])
    assert op.quality_rules(empty, labels).collect() == [] and op.kept_documents(clashing, labels).columns == clashing.columns


def test_characters_are_code_points():
    texts = ["", "plain", "é日本🎉 ▁x", "ß", "", "🎉🎉"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    codes, cuts = op.characters(data, offsets)
    assert ["".join(map(chr, codes[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == texts
    # Grams are those of the characters, wherever the text stands.
    one, other = op._char_grams(op.characters(np.frombuffer("日本語".encode(), np.uint8), np.array([0, 9]))[0], 3), op._char_grams(codes, 3)
    assert len(one) == 1 and len(other) == len("".join(texts)) - 2
