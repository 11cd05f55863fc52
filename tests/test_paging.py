"""Pages from an index equal the slices of the sorted rows, and read their own ranges only."""

import random
from datetime import datetime, timedelta

from tallyroll.operators.paging import PageIndex

START = datetime(2026, 8, 18)


def listing(spark, n=3000):
    draw = random.Random(8)
    # A third of all rows has one time; some have none.
    at = lambda: None if draw.random() < 0.02 else START + timedelta(seconds=0 if draw.random() < 0.33 else draw.randrange(5000))
    rows = [(k, at()) for k in range(n)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, at timestamp_ntz").repartition(5)


def test_pages_are_slices_of_the_sorted_rows(spark):
    rows, df = listing(spark)
    value = lambda r, down: (r[1] is not None, r[1] or START)
    for down in (True, False):
        want = sorted(rows, key=lambda r: (value(r, down), r[0]), reverse=down)
        index = PageIndex.of(df, [("at", down), ("id", down)], cuts=16, most=100)
        assert index.total() == len(rows)
        for number, size in ((0, 10), (1, 7), (60, 20), (149, 20), (150, 20), (2, 1200), (999, 50)):
            got = [(r["id"], r["at"]) for r in index.page(number, size).collect()]
            assert got == want[number * size : number * size + size]


def test_a_deep_page_reads_its_ranges(spark):
    rows, df = listing(spark)
    index = PageIndex.of(df, [("at", True), ("id", True)], cuts=32, most=100)
    for number in (0, 50, 100, 140):
        part, held, skip = index.slices(number, 20)
        assert part.count() == held < len(rows) / 8 and skip < held
        plan = index.page(number, 20)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "SinglePartition" not in plan


def test_empty_and_missing(spark):
    _, df = listing(spark, 40)
    assert PageIndex.of(df.filter("false"), [("at", True)]).page(0, 5).collect() == []
    none = df.selectExpr("id", "cast(null as timestamp_ntz) as at")
    assert [r["id"] for r in PageIndex.of(none, [("at", True), ("id", True)], cuts=4, most=5).page(1, 10).collect()] == list(range(29, 19, -1))
