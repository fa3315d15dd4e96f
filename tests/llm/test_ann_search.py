"""Probes, memory and recall of the cross-polytope tables at several dimensions."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerloom.llm import ann_search


def unit_rows(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize(("m", "probes"), [(1, 1), (5, 3), (8, 64), (40, 7), (64, 200)])
def test_best_pairs_hold_all_largest_sums(m, probes):
    rng = np.random.default_rng(m)
    i, j = ann_search.best_pairs(m, probes)
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i) and len(i) <= probes * (1 + np.log(probes) + 1)
    for _ in range(20):
        a, b = (np.sort(rng.normal(size=m))[::-1] for _ in range(2))
        every = np.sort((a[:, None] + b).ravel())[::-1][:probes]
        assert np.array_equal(np.sort(a[i] + b[j])[::-1][:probes], every)


@pytest.mark.parametrize("setting", ann_search.SETTINGS)
def test_memory_of_a_batch_is_bounded(setting):
    unit = ann_search.directions(unit_rows(10_000 if setting[1] < 256 else 2_000, 64, 1))
    tracemalloc.start()
    keys = ann_search.buckets(unit, 0, *setting)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys.shape == (len(unit), setting[1]) and peak < 500e6
    assert all(len(set(k)) == len(k) for k in keys[:50].tolist())


@pytest.mark.parametrize("d", [64, 256, 768])
def test_recall_at_every_dimension(d):
    """The chosen tables meet nine tenths of the neighbours of queries that did not choose them."""
    n = 1500 if d > 500 else 3000
    x = unit_rows(n, d, d)
    unit = ann_search.directions(x)

    def near(queries):
        s = x[queries] @ x.T
        s[np.arange(len(queries)), queries] = -np.inf
        return np.argsort(-s, 1)[:, :20]

    trial, other = np.arange(0, 64), np.arange(1000, 1032)
    f, p, tables = ann_search.choose(unit[trial], np.repeat(np.arange(64), 20), unit[near(trial).ravel()], unit[-1000:], n, 14, None, ann_search.MOST)
    asked = [ann_search.buckets(unit[other], t, f, p) for t in range(tables)]
    own = [ann_search.buckets(unit, t, f, 1)[:, 0] for t in range(tables)]
    hit = [any((asked[t][i] == own[t][v]).any() for t in range(tables)) for i, row in enumerate(near(other)) for v in row]
    assert np.mean(hit) >= 0.9


def test_where_no_tables_do_all_rows_are_compared(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "MOST", 0)
    x = unit_rows(300, 16, 3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann_search.search(rows, F.col("vec_id") % 50 == 0, tables=1).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert got == {(q, k + 1): v for q in range(0, 300, 50) for k, v in enumerate(np.argsort(-s[q])[:20].tolist())}
