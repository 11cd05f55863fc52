import math
import random

import numpy as np

from tallyroll.llm import hard_negatives as op


def brute(rows, shift=True):
    good = []
    for at, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if shift and i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        good.append((at, i, [math.floor(256 * x) for x in v], label))
    out = []
    for at, i, v, label in good:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other, m) for other, j, w, m in good if other != at and len(w) == len(v))
        for minus, j, _, _ in [s for s in scored if s[3] == label][:5]:
            worth = -minus
            fit = [s for s in scored if s[3] != label and 30 * worth <= 100 * -s[0] <= 90 * worth]
            out += [(i, j, rank, n, worth, -m) for rank, (m, n, _, _) in enumerate(fit[:10], 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, data, kind="float"):
    return spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, label int")


def test_lookups_give_inner_products():
    draw = np.random.default_rng(1)
    for dim in (1, 7, 8, 9, 64):
        for reach in (1, 3, 300, 1 << 40):
            values, anchors = draw.integers(-reach, reach, (50, dim)), draw.integers(-9, 9, (6, dim))
            planes, bits = op.to_planes(values)
            assert planes.shape == (bits, -(-dim // 8), 50)
            assert (op.from_planes(planes, np.arange(50), dim) == values).all()
            assert (op.scores(op.subset_sums(anchors, np.int64), planes) == values @ anchors.T).all()


def test_same_as_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    want = brute(data)
    assert len(want) > 100
    assert rows(op.hard_negatives(table)) == want
    assert rows(op.hard_negatives(table.repartition(3), shard_rows=37, cell_rows=64)) == want


def test_odd_vectors(spark):
    data = [(0, [0.5, -0.25], 1), (0, [0.5, -0.25], 1), (1, [0.5, -0.25], 1), (2, [0.25, 0.0], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1),
            (6, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (8, [0.5, 0.5], None), (9, [0.25], 1), (100, [], 1), (200, [], 1), (11, [], 2),
            (300, [0.0, 0.0], 3), (12, [0.0, 0.0], 3), (13, [-0.5, 0.25], 1), (700, [0.5, -0.25], 0), (7, [0.5, -0.25], -1), (14, [0.25, 0.0], 2147483647)]
    assert rows(op.hard_negatives(frame(spark, data))) == brute(data)
    assert rows(op.hard_negatives(frame(spark, data, "double"), shift=False, shard_rows=2)) == brute(data, False)
    for few in ([], [(0, [1.0], 1)], [(1, [1.0], 1)], [(0, None, None)]):
        assert op.hard_negatives(frame(spark, few)).collect() == []
    extra = frame(spark, data).selectExpr("*", *[f"'own' as {n}" for n in ("cell", "place", "shard", "rank", "score", "dim", "n", "ids", "planes", "positives")])
    assert rows(op.hard_negatives(extra)) == brute(data)


def test_many_equal_vectors(spark):
    """Ties everywhere go to the smaller id, over shards and cells."""
    draw = random.Random(2)
    data = [(i, [0.5, 0.25] if draw.random() < 0.6 else [0.25, 0.125], draw.randrange(2)) for i in range(450)]
    draw.shuffle(data)
    assert rows(op.hard_negatives(frame(spark, data), shard_rows=32, cell_rows=64)) == brute(data)


def test_large_values_stay_exact(spark):
    data = [(i, [1e5 + i / 256, -1e5, 3.0], i % 3) for i in range(0, 400, 5)] + [(1000, [3.0e6, 1.0, 0.0], 0)]
    assert rows(op.hard_negatives(frame(spark, data, "double"))) == brute(data)
