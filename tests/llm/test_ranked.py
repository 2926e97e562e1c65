"""Ranked search against plain sums over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollkeeper.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, top=10):
    counted = [(i, Counter(t)) for i, t in ((i, plain_terms(x)) for i, x in docs) if t]
    n, total = len(counted), sum(sum(k.values()) for _, k in counted)
    held = Counter(t for _, k in counted for t in k)
    out = []
    for item, text in items:
        scores = []
        for doc, k in counted:
            m = 25 + 75 * sum(k.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * k[t] // (1000 * k[t] + 8 * m)) for t in plain_terms(text) if k[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def some_texts(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 4))) for _ in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(n)]
    # Copies, near copies and ties.
    return texts + texts[:30] + [t + " zz" for t in texts[:30]]


def same(found, wanted):
    rows = sorted([tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()], key=repr)
    assert rows == sorted(wanted, key=repr)


def test_terms():
    for text in ("A-b_c 9x\x00É​ß‐日本", "", None, "ÀÉ İ ﬀ\n\t.", "x" * 10_000):
        assert [t.decode() for t in ranked.terms_of(text)] == plain_terms(text)


@pytest.mark.parametrize("leaf, shard, block", [(64, 4096, 512), (3, 50, 4)])
def test_search_equals_brute_force(spark, monkeypatch, leaf, shard, block):
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", block)
    monkeypatch.setattr(ranked.BallTree.__init__, "__defaults__", (leaf,))
    docs = list(enumerate(some_texts(300))) + [(None, "a b c dé"), (9000, None), (9001, ""), (9002, ".,-"), (-5, "a"), (9003, "A a " * 20_000)]
    items = list(enumerate(some_texts(8, 7)[:8])) + [(100, None), (101, ""), (102, "nowhere"), (103, "a a a"), (0, "b"), (None, "zz")]
    table = spark.createDataFrame(docs, DOCS).repartition(3).withColumns({n: F.lit(1) for n in ("score", "rank", "item", "cell", "words")})
    same(ranked.search(table, spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(1))), plain_search(docs, items))


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS)
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert ranked.search(none, items).count() == 0
    assert ranked.search(one, items.limit(0)).count() == 0
    assert ranked.search(one.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_copies_rank_by_id(spark):
    docs = [(i, "same words here") for i in range(200)] + [(1000 + i, "other words there") for i in range(20)]
    items = [(1, "same here"), (2, "there")]
    same(ranked.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)), plain_search(docs, items))


def test_no_product_exceeds_its_bound():
    rng = np.random.default_rng(3)
    width, n = 60, 500
    sizes = rng.integers(1, 12, n)
    columns = np.concatenate([rng.choice(width, s, replace=False) for s in sizes])
    values = rng.integers(1, 1_000_000, sizes.sum())
    rows = ranked.Rows(np.concatenate([[0], np.cumsum(sizes)]), columns, values, width)
    tree = ranked.BallTree(rows, 8)
    queries = rng.integers(0, 17_000, (20, width)) * (rng.random((20, width)) < 0.2)
    bounds = tree.bounds(queries.astype(float))
    products = np.array([tree.rows.products(q) for q in queries])
    for node, (a, b) in enumerate(zip(tree.begin, tree.end)):
        assert (products[:, a:b].max(axis=1) <= bounds[node]).all()
        below = sorted((tree.begin[k], tree.end[k]) for k in tree.below[node])
        assert not below or (below[0][0] == a and below[0][1] == below[1][0] and below[1][1] == b)
    assert sorted(tree.order.tolist()) == list(range(n))
    # Equal rows make balls of next to no size.
    same_rows = ranked.BallTree(rows.take(np.zeros(100, dtype=int)), 8)
    assert (same_rows.radii < 1e-3 * np.sqrt(same_rows.rows.squares()).max()).all()
