"""Whitening against exact integers and NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerloom.llm import whitening as wh


def exact(vectors):
    """n X'X - SS' with Python's integers, of x with its shift."""
    x = [[math.floor(64 * c) + wh.SHIFT for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    return x, n, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(parts)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e12, 3e16])
def test_scatter_is_exact_at_every_size(spark, scale):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(50, 4)) * scale).tolist()
    _, n, s, m = exact(vectors)
    got = wh.scatter(wh.usable(frame(spark, vectors), "vec_id", "embedding"))
    assert set(got) == {4}
    assert got[4][0] == n and got[4][2] == m
    assert got[4][1] == [v - n * wh.SHIFT for v in s]


def test_limbs_are_the_whole_number():
    y = np.array([0, 1, -1, 2**20, -(2**20), 2**62, -(2**62), 123456789012345678])
    back = [sum(int(p[i]) << (wh.LIMB * k) for k, p in enumerate(wh.limbs(y))) for i in range(len(y))]
    assert back == y.tolist()


def test_whitened_rows_against_numpy(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40))
    out = sorted(wh.whiten(frame(spark, vectors)).collect(), key=lambda r: r.id)
    x = np.floor(64 * vectors) + wh.SHIFT
    v = np.cov(x.T, bias=True)
    value, vector = (a[..., ::-1] for a in np.linalg.eigh(v))
    want = (x - x.mean(0)) @ vector[:, :32] / np.sqrt(value[:32])
    got = np.array([r.whitened for r in out])
    assert got.shape == (400, 32)
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-7
    assert np.allclose(out[0].explained, value[:32] / np.trace(v), rtol=1e-9)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9
    ints, n, s, _ = exact(vectors.tolist())
    assert [r.deviation for r in out] == [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in ints]


def test_deviation_beyond_a_long(spark):
    vectors = [[1e15, 0.0], [-1e15, 1.0], [3e14, 2.0]]
    ints, n, s, _ = exact(vectors)
    out = sorted(wh.whiten(frame(spark, vectors)).collect(), key=lambda r: r.id)
    assert [int(r.deviation_digits) for r in out] == [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in ints]
    assert [r.deviation for r in out] == [None] * 3


def test_edges(spark):
    rows = [
        (1, [1.0, 2.0], 1), (2, [2.0, 1.0], 1), (2, [2.0, 1.0], 1), (None, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1),
        (8, [], 1), (9, [5.0, 5.0, 1.0], 1), (10, [1e300, 0.0], 1), (11, [6.0, 5.0, 1.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int").withColumns({"v": F.lit(1), "d": F.lit("x"), "n": F.create_map(F.lit(1), F.lit(1))})
    out = wh.whiten(df).collect()
    assert sorted((r.id is None, r.id or 0, r.d, r.n) for r in out) == [(False, 1, 2, 4), (False, 2, 2, 4), (False, 2, 2, 4), (False, 9, 3, 2), (False, 11, 3, 2), (True, 0, 2, 4)]
    third = next(r for r in out if r.id == 9)
    assert third.whitened[0] in (1.0, -1.0) and third.whitened[1:] == [None, None]  # no variance in two components
    assert out[0].identity_error < 1e-9
    assert wh.whiten(df.limit(0)).count() == 0
    same = wh.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in same] == [([None], [None], None, 0)] * 2


def test_query_on_the_whole_table(spark, small):
    out = wh.op12_whitening(spark, small)
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    n, d = vectors.count(), vectors.select(F.size("embedding")).first()[0]
    assert out.count() == n * min(32, d)
    assert out.agg(F.max("identity_error")).first()[0] < 1e-4
    assert out.groupBy("component").agg(F.avg(F.col("whitened") ** 2).alias("v")).where("abs(v - 1) > 1e-6").count() == 0
