"""Recall of the n-gram join's buckets in the deepest tree."""

import numpy as np

from matchstats.llm import ngram_join


def test_runs_reach_the_recall_of_the_draw():
    at = [np.flatnonzero(ngram_join.chosen(ngram_join.run_names(np.zeros(1, np.uint64), r), 0.8)[0]) for r in range(200)]
    times = lambda runs: np.bincount(np.concatenate([at[r] for r in runs]), minlength=64)
    runs = ngram_join.root_runs()
    assert all(len(at[r]) for r in runs) and ngram_join.missed(times(runs)) <= 1e-4
    assert times(range(20)).sum() == 15 and ngram_join.missed(times(range(20))) > 1e-3  # as it was


def test_pairs_meet_through_all_levels(spark, monkeypatch):
    """No bucket is small enough to stop early: pairs at the threshold meet after three splits."""
    monkeypatch.setattr(ngram_join, "SMALL", 1)
    r, n = np.random.default_rng(5), 6000
    left = r.integers(0, 2**31, (n, 64))
    right = np.where(r.random((n, 64)) < 0.8, left, r.integers(0, 2**31, (n, 64)))
    rows = [(2 * i + s, m[i].tolist()) for i in range(n) for s, m in ((0, left), (1, right))]
    reps = spark.createDataFrame(rows, "rep long, mh array<int>").repartition(4).persist()
    leaves = ngram_join.buckets(reps, ngram_join.root_runs(), 0.8)
    met = leaves.selectExpr("path", "rep div 2 AS pair").groupBy("path", "pair").count().where("count = 2").select("pair").distinct().count()
    assert n - met <= 3
