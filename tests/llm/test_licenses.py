import re

from tallyroll.llm import licenses as op

PLACES = [("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])]
NAMES = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def brute(doc, text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[0-9a-z\u0080-\U0010ffff]+", lower)
    found = [(k, label) for label, phrase in PLACES for k in range(len(words)) if words[k : k + len(phrase)] == phrase]
    at = [k for k, _ in found]
    return doc, len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def base(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in op.scan_licenses(df).collect()}


def test_base_as_brute_force(spark, documents, odd):
    more = spark.createDataFrame([
        (100, "CC BY cc by-nc CC-BY 4.0 cc  by cc by"), (101, "General Public License general public licenses general general public license"), (102, "cc"), (103, "by cc"),
        (104, "All rights\nreserved. all right reserved all rights reserved" * 50), (104, "cc by " * 3000), (105, "É cc by İ cc by ß|cc|by"), (None, "cc by")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more)
    want = sorted((brute(r[0], r[1]) for r in docs.collect()), key=repr)
    assert base(op.scan_licenses(docs.repartition(3))) == want
    assert sum(r[2] for r in want) > 3000


def test_notices_with_changes(spark):
    notice = dict(op.NOTICES)["mit"].split()
    changed = notice[:10] + ["odd", "words"] + notice[10:25] + notice[27:]
    part = notice[: len(notice) // 4]
    far = " x y z ".join(" ".join(notice[k : k + 2]) for k in range(0, len(notice) - 1, 2))
    rows = scan(spark, "intro " + " ".join(notice) + " outro", "Intro: " + " ".join(changed), " ".join(part), far, " ".join(notice).upper() * 2, "of the software to use and or sell the rights to", "", None)
    assert [rows[k]["labels"] for k in range(8)] == ["mit", "mit", "", "", "mit", "", "", ""]
    assert rows[0]["score"] == 1.0 and 0.6 <= rows[1]["score"] < 1.0 and rows[2]["score"] == 0.0
    assert all(rows[k]["base_labels"] == "" and rows[k]["n_base"] == 0 for k in range(8))


def test_phrases_add_labels(spark):
    rows = scan(spark, "Released under the MIT license, CC BY.", "apache license and the general public license", "license apache", "mozilla public license mozilla public")
    assert [rows[k]["labels"] for k in range(4)] == ["cc-by,mit", "apache,gpl", "", "mpl"]
    assert [rows[k]["base_labels"] for k in range(4)] == ["cc-by", "gpl", "", ""]


def test_spans(spark):
    df = spark.createDataFrame([(1, "a b " + dict(op.NOTICES)["gpl"] + " c"), (2, "cc by x cc by")], "doc_id long, text string")
    found = {(r["doc_id"], r["label"], r["base"]): (r["first"], r["last"], r["n"]) for r in op.spans(df).collect()}
    assert found[(2, "cc-by", True)] == (0, 3, 2) and found[(2, None, False)] == (None, None, 5)
    first, last, n = found[(1, "gpl", False)]
    assert (first, last, n) == (2, 2 + len(dict(op.NOTICES)["gpl"].split()) - 2, 1)


def test_clashing_names_and_empty_table(spark, odd, clashing, empty):
    more = clashing.selectExpr("*", *[f"'own' as {n}" for n in ("words", "number", "label", "at", "h", "diagonal", "hits", "first")])
    assert base(op.scan_licenses(more)) == base(op.scan_licenses(odd))
    assert op.scan_licenses(empty).collect() == []


def test_no_python_in_the_plan(documents):
    plan = op.scan_licenses(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
