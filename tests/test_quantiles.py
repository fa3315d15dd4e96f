"""Exact quantiles against percentile, to the last bit."""

import pytest
from pyspark.sql import functions as F

from showerloom.operators import quantiles

POINTS = {"zero": 0.0, "low": 0.01, "half": 0.5, "odd": 0.6827, "high": 0.99, "one": 1.0}


def table(spark, kind, n):
    x = F.randn(5) * 3 if kind != "ties" else F.floor(F.rand(5) * 7)
    v = {"plain": x, "ties": x, "long tails": F.exp(x * 4), "nulls": F.when(F.rand(2) < 0.5, x)}[kind]
    return spark.range(n).select((F.col("id") % 3).alias("g"), v.cast("double").alias("v")).where("g <> 2 OR v IS NULL OR v > 0")


@pytest.mark.parametrize("kind", ["plain", "ties", "long tails", "nulls"])
def test_equal_to_percentile(spark, kind):
    df = table(spark, kind, 60_000).cache()
    for keys in ([], ["g"]):
        want = df.groupBy(*keys).agg(*(F.percentile("v", q).alias(n) for n, q in POINTS.items())).collect()
        got = quantiles.exact_quantiles(df, keys, "v", POINTS, accuracy=200).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    df.unpersist()


def test_one_group_of_a_million(spark):
    """Only the values near the quantiles' ranks are sorted."""
    df = table(spark, "plain", 1_000_000).select("v").cache()
    got = quantiles.exact_quantiles(df, [], "v", {"half": 0.5, "high": 0.9}).first()
    assert tuple(got) == df.agg(F.percentile("v", 0.5), F.percentile("v", 0.9)).first()
    sketch = df.agg(F.percentile_approx("v", [0.5 - 3 / quantiles.ACCURACY, 0.5 + 3 / quantiles.ACCURACY], quantiles.ACCURACY)).first()[0]
    assert df.where(F.col("v").between(*sketch)).count() < 0.01 * df.count()
    df.unpersist()


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 4.0), (3, None)], "g long, v double")
    assert sorted(map(tuple, quantiles.exact_quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.75}).collect())) == [(1, 5.0, 5.0), (2, 2.5, 3.25)]
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
