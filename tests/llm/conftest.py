import pytest

from tallyroll.llm.common import ROOT

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


#: Nulls in any column, empty and blank texts, ties, repeated rows, one very long text, control characters.
ODD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3),
    (5, "x", None, "b", 1), (None, "no id here but some words to count in this text", "en", None, 10), (None, None, "en", "b", 0),
    (6, "Same words " * 30, "en", "a", 330), (7, "same WORDS " * 30, "fr", "b", 330), (8, "é日本🎉 ▁<|endoftext|> café   two\r\nlines \x1c end\n", "fr", "b", 9),
    (9, "long " + "abcdefghij" * 20000 + " tail", "en", "c", 200010), (10, "secret: hunter2secret " + "0123456789abcdef" * 2, "en", "c", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Further columns with the names that operators use themselves."""
    names = ("size", "target", "copies", "source_size", "n_tokens", "n_bytes", "kept", "spans", "quality", "component_id", "chunk", "bucket", "kind", "piece", "set", "root", "segment", "row")
    return odd.selectExpr("*", *[f"'own' as {n}" for n in names])


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.fixture(scope="session")
def rows_of():
    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda r: repr(r))

    return rows
