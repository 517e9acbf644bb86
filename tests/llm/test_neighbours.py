"""Neighbours where the tree can prune, and the bounded sample."""

import numpy as np


def test_clusters_are_told_apart_by_the_tree(spark):
    """On vectors in clusters fewer than half of the leaves are visited, at a recall of 0.9 and more."""
    from loomspan.llm.neighbours import search

    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 16)) * 4
    x = centres[rng.integers(60, size=6000)] + rng.normal(size=(6000, 16)) * 0.3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = search(rows, every=40, leaves=64).collect()
    hits = 0
    for q in range(0, 6000, 40):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * 150
    assert 1 <= got[0].visits < 32


def test_sample_is_of_the_asked_size(spark):
    from loomspan.llm.neighbours import _smallest

    rows = spark.range(50_000).select((F_mod("id", 7)).alias("vec_id"), "id").withColumnRenamed("id", "row")
    for most in (1, 100, 5000, 49_999, 60_000):
        got = [r.row for r in _smallest(rows, 50_000, most).collect()]
        assert len(got) == len(set(got)) == min(most, 50_000)


def F_mod(column, n):
    from pyspark.sql import functions as F

    return F.col(column) % n
