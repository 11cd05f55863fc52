import random
import re
import zlib
from collections import Counter

from tallyroll.llm import spelling as op


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute(docs, slip=199):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out, forms = [], {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out.append((w, n, len(near)))
    rows = []
    for w, n, k in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, k, words[forms[w]] if forms[w] else None))
    return sorted(rows, key=repr)


NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def rows(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_scan_of_a_sorted_list():
    draw = random.Random(3)
    for _ in range(3000):
        width = draw.randint(1, 4)
        words = sorted({"".join(draw.choices("abé", k=width + draw.randint(0, 1))) for _ in range(draw.randint(1, 9))})
        for open_end in (True, False):
            want = set()
            for i, a in enumerate(words):
                for j in range(i + 1, len(words)):
                    b = words[j]
                    first = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                    if one_edit(a, b) and min(len(a), len(b)) == width and (open_end or first < width):
                        want.add((i, j))
            assert set(op.near_in_list(words, width, open_end)) == want


def test_same_as_brute_force(spark, documents):
    docs = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    want = brute(docs)
    assert len(want) > 500 and any(r[1] for r in want)
    assert rows(op.spelling_variants(documents)) == want


def test_large_groups_are_halved_to_the_letter(spark):
    """Words that share nearly all letters: windows are halved down to one code point, and chains of forms are followed."""
    draw = random.Random(5)
    words = {"".join(draw.choices("abcdé", k=draw.choice((6, 7, 8)))) for _ in range(150)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaab"}
    docs = [(k, " ".join([w] * draw.choice((5, 6, 30, 160, 900)))) for k, w in enumerate(sorted(words))]
    docs += [(900 + k, "prefix" + "x" * 20 + c + " " + ("prefix" + "x" * 20 + c + " ") * 5 * 6**k) for k, c in enumerate("abcd")]
    docs += [(950, "chainaa " * 5 + "chainab " * 30 + "chainbb " * 200 + "chacnbb " * 1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert max(len(r[0]) for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert rows(op.spelling_variants(df)) == want
    assert rows(op.spelling_variants(df, group=2)) == want
    assert rows(op.spelling_variants(df, slip=None)) == brute(docs, None)


def test_odd_texts(spark, odd, clashing, empty):
    more = spark.createDataFrame([(None, "Straße straße STRASSE Ünïcode×÷ " * 6), (None, "éaiment aiment aimentx " * 40), (3, "aiment\0aiment " * 200)], "doc_id long, text string")
    both = odd.select("doc_id", "text").unionByName(more)
    want = brute([tuple(r) for r in both.collect()])
    assert want and rows(op.spelling_variants(both)) == want
    assert rows(op.spelling_variants(clashing.withColumn("word", clashing.lang).withColumn("n", clashing.lang))) == rows(op.spelling_variants(odd))
    assert op.spelling_variants(empty).collect() == []
