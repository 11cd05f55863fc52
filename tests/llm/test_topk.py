import math

from tallyroll.llm import topk as op


def brute(rows, k=op.K, step=op.QUERY_STEP):
    good = []
    for at, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((at, i, [math.floor(256 * x) for x in v]))
    out = []
    for at, i, v in good:
        if i % step == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for other, j, w in good if other != at and len(w) == len(v))
            out += [(i, rank, j, -minus) for rank, (minus, j, _) in enumerate(found[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_same_as_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in op.top_k(table).collect()) == brute(rows)
    assert sorted(tuple(r) for r in op.top_k(table, shard_rows=37).collect()) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (50, [0.25, 0.25]), (50, [0.25, 0.25]), (7, [1.0]), (100, []), (150, [1.0, 2.0]), (8, [-0.001, 0.001])]
    assert sorted(tuple(r) for r in op.top_k(frame(spark, rows)).collect()) == brute(rows)
    assert op.top_k(frame(spark, [])).collect() == []
    assert op.top_k(frame(spark, [(0, [1.0])])).collect() == []


def test_large_values_stay_exact(spark):
    rows = [(i, [1e5 + i / 256, -1e5]) for i in range(0, 150, 5)] + [(1000, [3.0e6, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in op.top_k(df).collect()) == brute(rows)
