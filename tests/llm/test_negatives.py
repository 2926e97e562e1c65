"""Hard negatives against plain sums over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollkeeper.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
LONG = (1 << 63) - 1


def whole(x):
    return max(-LONG - 1, min(LONG, math.floor(256 * x)))


def plain_negatives(rows, every=100, positives=5, count=5):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if i % 7 == 0 else label
        one = (label, [whole(float(np.float32(x))) for x in v])
        good[i] = min(good.get(i, one), one)
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        clip = lambda s: max(-LONG, min(LONG, s))
        scored = sorted((-clip(sum(x * y for x, y in zip(v, w))), i) for i, (_, w) in good.items() if i != a)
        mine = [(-s, i) for s, i in scored if good[i][0] == label][:positives]
        others = [(-s, i) for s, i in scored if good[i][0] != label]
        for ps, p in mine:
            fit = [(s, i) for s, i in others if 80 * ps <= 100 * s <= 100 * ps][:count]
            out += [(a, p, r, i, ps, s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def same(spark, rows, **given):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({n: F.lit("x") for n in ("score", "slab", "query_id", "ids")})
    found = negatives.hard_negatives(table, label=negatives.moved_label(), **given)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows, **given)


def some_rows(n, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) + rng.normal(size=(4, dims))[rng.integers(0, 4, n)]
    return [(int(i), [float(x) for x in v[i]], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("slab, leaf, fanout, block", [(8192, 64, 8, 256), (100, 5, 2, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, slab, leaf, fanout, block):
    monkeypatch.setattr(negatives, "SHARD", slab)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives.BoxTree.__init__, "__defaults__", (leaf, fanout))
    monkeypatch.setattr(negatives.tile, "__defaults__", (leaf,))
    rows = some_rows(600)
    # A vector that a third of the rows have, odd rows, repeated ids and all-zero vectors.
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    rows += [(5000, None, 1), (5100, [1.0] * 8, None), (None, [1.0] * 8, 1), (5200, [nan] * 8, 1), (5300, [inf] + [0.0] * 7, 1), (5400, [None] + [0.0] * 7, 1)]
    rows += [(100, rows[3][1], 1), (200, rows[200][1], 0), (5500, [0.0] * 8, 2), (5600, [], 0), (-700, [1.0] * 8, -3), (5700, [0.5] * 3, 1)]
    same(spark, rows, every=50)


def test_numbers_beyond_floating_point(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(0, 14)], int(i % 2)) for i in range(120)]
    rows.append((300, [1e30, -1e30, 1.0, 2.0], 1))
    same(spark, rows, every=10)


def test_nothing_to_find(spark):
    same(spark, [])
    same(spark, [(100, [1.0], 1)])
    same(spark, [(100, [1.0], 1), (101, [-1.0], 1), (102, [1.0], 2)])
    same(spark, [(100, [], 1), (101, [], 1), (102, [], 2)])


def test_boxes_hold_their_points():
    rng = np.random.default_rng(2)
    points = rng.integers(-300, 300, (1000, 6))
    points = points[negatives.tile(points, [3, 1, 0], 10)]
    labels, queries = rng.integers(0, 3, 1000), rng.integers(-300, 300, (7, 6))
    tree = negatives.BoxTree(points, labels, queries, 10, 4)
    products, size = queries @ points.T, 10
    for least, largest, first, last in tree.levels:
        for box in range(len(first)):
            part = slice(box * size, (box + 1) * size)
            assert (least[:, box] <= products[:, part].min(axis=1)).all() and (products[:, part].max(axis=1) <= largest[:, box]).all()
            assert first[box] == labels[part].min() and last[box] == labels[part].max()
        size *= 4
    assert len(tree.levels[-1][2]) == 1
    # Tiles are narrower than slices of the given order.
    wide = np.ptp(points.reshape(100, 10, 6), axis=1).mean(axis=0)
    assert wide[[3, 1, 0]].max() < 350 < wide[[2, 4, 5]].min()


def test_window_boxes_are_left():
    points = np.arange(1000)[:, None]
    tree = negatives.BoxTree(points, np.zeros(1000, dtype=int), np.array([[1]]), 10, 4)
    seen = {}
    found = tree.search(0, 1, False, -1, [[i] for i in range(1000)], 3, 400, 500, seen)
    assert found == [(500, 500), (499, 499), (498, 498)] and set(seen) <= {49, 50}
