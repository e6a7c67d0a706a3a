"""Recall of the neighbour search where vectors differ in length, and vectors of very large components."""

from collections import defaultdict

import numpy as np
import pytest

from sylva.llm import ann


def found(spark, x, **settings):
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    by = defaultdict(set)
    for r in ann.search(rows, **settings).collect():
        by[r["query_id"]].add(r["vec_id"])
    return by


def recall(x, by, top=20):
    hit = 0
    for q, ids in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(ids & set(np.argsort(-s, kind="stable")[:top].tolist()))
    return hit / (top * len(by))


@pytest.mark.parametrize("kind", ["gauss", "log-normal"])
def test_recall_at_the_size_of_a_shard(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(ann.SHARD_ROWS, 64))
    if kind == "log-normal":
        x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(rng.normal(size=(len(x), 1)))
    by = found(spark, x)
    assert len(by) == -(-len(x) // 20) and recall(x, by) >= 0.9


def test_large_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)) * np.where(np.arange(400) % 2, 1e20, 1.0)[:, None]
    by = found(spark, x)
    assert len(by) == 20 and recall(x, by) >= 0.95


def test_bands_hold_all_rows():
    assert ann.bands([], 10) == []
    counts = [(s, 5) for s in range(-100, 100)]
    made = ann.bands(counts, 40)
    assert sum(n for _, n in made) == 1000 and min(n for _, n in made) >= 40
    assert [low for low, _ in made] == sorted((low for low, _ in made), reverse=True)
    assert ann.bands([(3, 7)], 40) == [(3, 7)]
    assert ann.rows_of_shard(1000, 8192) == 8192 and ann.rows_of_shard(10**9, 8192) == ann.MOST_SHARD_ROWS
