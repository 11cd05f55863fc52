import re

import pytest

from tallyroll.llm import mixing as op


def targets(sizes, weights=op.WEIGHTS, most=op.MOST_COPIES):
    """Shares by weight, limits and what is over shared again, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_targets_and_bounds(which, request):
    df = request.getfixturevalue(which)
    source = [(r["doc_id"], r["source"], len(re.findall(op.WORDS, r["text"] or ""))) for r in df.collect()]
    sizes = {}
    for _, s, n in source:
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    got = op.mix_sources(df.select("doc_id", "source", "text")).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((d or 0, n) for d, _, n in source)
    taken = {}
    for r in got:
        assert 0 <= r["copies"] <= op.MOST_COPIES and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(size for _, x, size in source if x == s)


def test_tree_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(op, "BUCKET_ROWS", 16)
    rows = [(i, "a" if i % 3 else "b", " ".join(["w"] * (1 + i * i % 50))) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = sorted(tuple(r) for r in op.taken(df).collect())
    assert sorted(tuple(r) for r in op.taken(df.repartition(2)).collect()) == got
    assert len(got) == 1200
    for size in {r[2] for r in got}:
        own = [r for r in got if r[2] == size]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= 50
        assert {r[5] for r in own} <= {int(own[0][3] // size), int(own[0][3] // size) + 1}


def test_documents_keep_their_columns(clashing, empty):
    out = op.mixed_documents(clashing)
    assert out.columns == clashing.columns and {r["size"] for r in out.collect()} <= {"own"}
    assert op.mixed_documents(empty).collect() == [] and op.taken(empty).collect() == []
