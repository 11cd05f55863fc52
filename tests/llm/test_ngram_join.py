import random
import re

import numpy as np
import pytest

from tallyroll.llm import ngram_join as op

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, rule):
    sets = [shingles(t, rule.words) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= rule.percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    group = {}
    for i, (doc, _) in enumerate(rows):
        group.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in group.items()}
    return sorted(((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)), key=repr)


def result(df, rule):
    return sorted((tuple(r) for r in op.similar_groups(df, rule).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def near_copies():
    """Texts of many lengths with copies that differ in one place to a fifth of their words."""
    draw = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([1, 2, 5, 9, 12, 20, 40, 90, 200, 400]))]
        rows.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for _ in range(draw.randrange(1 + len(words) // 15)):
                other[draw.randrange(len(other))] = f"w{draw.randrange(5000)}"
            rows.append(" ".join(other[draw.randrange(2) :]) if draw.random() < 0.3 else " ".join(other).upper())
    return list(enumerate(rows))


@pytest.mark.parametrize("rule", [op.Rule(3, 90), op.Rule(5, 80)])
def test_same_as_brute_force(spark, rule):
    rows = near_copies()
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rule) == brute(rows, rule)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE_SETS", 3)
    rows = near_copies()[:120]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), op.Rule(5, 80)) == brute(rows, op.Rule(5, 80))


def test_odd_rows(odd, empty, clashing):
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], op.Rule())
    assert result(odd, op.Rule()) == want and result(clashing, op.Rule()) == want
    assert result(empty, op.Rule()) == []
    kept = op.one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 8, 9, 10]


def test_tree_finds_what_pairs_find():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(5, 300, 60)]
    sets = base + [np.unique(np.concatenate([b[rng.random(len(b)) > 0.04], rng.integers(0, 2**63, 2).astype(np.uint64)])) for b in base for _ in range(3)]
    rule = op.Rule(3, 90)
    links = op.tree_join(sets, np.zeros(len(sets), int), rule)
    up = op.Forest(len(sets))
    for a, b in links:
        up.union(a, b)
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                assert up.find(i) == up.find(j)


@pytest.mark.parametrize("leaf, fan", [(1, 2), (3, 2), (16, 8)])
def test_inner_levels_lose_no_pair(monkeypatch, leaf, fan):
    """Without links known, the descent gives every pair within the bounds once; with two sides, those between them."""
    monkeypatch.setattr(op, "LEAF", leaf)
    monkeypatch.setattr(op, "FAN", fan)
    rng = np.random.default_rng(leaf)
    for n in (0, 1, 2, 7, 150):
        base = rng.integers(0, 4, (12, 32))
        points = np.abs(base[rng.integers(0, 12, n)] + rng.integers(-1, 2, (n, 32)) * (rng.random((n, 32)) < 0.1)).astype(np.int64)
        size, side, rule = points.sum(axis=1), rng.integers(0, 2, n), op.Rule(3, 90)
        room = np.minimum(points[:, None, :], points[None, :, :]).sum(axis=2)
        fits = room >= rule.least_common(size[:, None] + size[None, :])
        want = {(a, b) for a in range(n) for b in range(a + 1, n) if fits[a, b]}
        got = [tuple(sorted(p)) for p in op.bounded_pairs(points, size, rule, lambda x: x)]
        assert len(got) == len(set(got)) and set(got) == want
        got = [tuple(sorted(p)) for p in op.bounded_pairs(points, size, rule, lambda x: x, side)]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if side[a] != side[b]}


def test_family_is_closed_after_about_one_pass():
    """Near copies of one set: links found close boxes from the top, so few of the half million pairs are looked at."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.append(base[rng.random(len(base)) > 0.01], rng.integers(0, 2**63, 2).astype(np.uint64))) for _ in range(1000)]
    points, size = np.stack([op.point(s, 64) for s in sets]).astype(np.int64), np.array([len(s) for s in sets])
    forest, seen = op.Forest(len(sets)), 0
    for a, b in op.bounded_pairs(points, size, op.Rule(3, 90), forest.find):
        forest.union(a, b)
        seen += 1
    assert len({forest.find(x) for x in range(len(sets))}) == 1 and seen < 40 * len(sets)


def test_levels_meet():
    """Two sizes that can link share a level with the same number of groups."""
    for percent in (80, 90):
        rule = op.Rule(3, percent)
        for a in range(1, 400):
            for b in range(a, 100 * a // percent + 1):
                if rule.differ(a + b) > 0 and b <= 100 * a / percent:
                    both = set(rule.levels(a)) & set(rule.levels(b))
                    assert any(groups > rule.differ(a + b) + spare for _, groups, spare in both) or a == b == 0, (a, b)


@pytest.mark.parametrize("most", [2, 5])
def test_large_cells_are_cut_into_blocks(spark, monkeypatch, most):
    """Families over many blocks, and sets of their cells that are no part of them."""
    monkeypatch.setattr(op, "CELL_ROWS", most)
    draw = random.Random(7)
    rows = near_copies()[:60]
    for family in range(3):
        words = [f"f{family}w{k}" for k in range(120)]
        for _ in range(25):
            other = list(words)
            for _ in range(draw.randrange(8)):
                other[draw.randrange(len(other))] = f"x{draw.randrange(5000)}"
            # Far ones share cells of the family only.
            rows.append((len(rows), " ".join(other[: draw.choice([120, 120, 110, 70])])))
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), op.Rule(5, 80)) == brute(rows, op.Rule(5, 80))


def test_blocks_hold_no_more_than_their_bound():
    n = 11
    piece = b"".join(c.tobytes() for c in (np.full(n, 9, np.uint64), np.arange(n).astype(np.uint64), np.full(n, 50, np.uint32)))
    batch = op.pa.RecordBatch.from_arrays([op.pa.array([0], op.pa.int32()), op.pa.array([0], op.pa.int32()), op.pa.array([piece], op.pa.binary())], names=["bucket", "kind", "piece"])
    met = op.pa.Table.from_batches(op._meet(iter([batch]), op.Rule(), 4)).to_pydict()
    assert met["block"] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2] and set(met["blocks"]) == {3}
