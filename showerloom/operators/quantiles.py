"""Exact quantiles of large groups without a task that holds a group.

A mergeable sketch gives a bracket around each quantile's rank; the rows below it are counted, and only the
different values within it are sorted, with their counts.  Ties collapse to one value however many
there are.  The result is that of ``percentile``, to the last bit.

Quantiles of many small groups come from a sort of each group (``numbered``), which spills where it must;
``percentile`` keeps a map of a group's values, which takes several times longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: the sketch's accuracy: ranks are right within a share of 1 / ACCURACY
ACCURACY = 2_000


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys, one column for each quantile): interpolated quantiles of the values that are not null; keys without any have no row."""
    v = F.col(value).cast("double")
    held = rows.select(*keys, v.alias("v")).where("v IS NOT NULL")
    names, points = list(quantiles), list(quantiles.values())
    around = [min(1.0, max(0.0, q + s * 3 / accuracy)) for q in points for s in (-1, 1)]
    sketch = held.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", around, accuracy).alias("at"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(points))))
    few = F.col("n") < 2 * accuracy  # one row more or less is beyond the bracket's margin
    end = lambda k, limit: F.when(few, F.col(limit)).otherwise(F.col("at")[2 * F.col("e.i") + k])
    asked = sketch.select("*", each.alias("e")).select(*keys, "n", "e.*", end(0, "low").alias("a"), end(1, "high").alias("b"))
    place = F.col("q") * (F.col("n") - 1)
    asked = asked.select(*keys, "i", "a", "b", place.alias("place"), F.floor(place).alias("lo"), F.ceil(place).alias("hi"))
    return _between(held, keys, asked).groupBy(*keys).pivot("i", list(range(len(names)))).agg(F.first("value")).select(*keys, *(F.col(str(i)).alias(n) for i, n in enumerate(names)))


def _between(held: DataFrame, keys: list[str], asked: DataFrame) -> DataFrame:
    """(keys, i, value) from brackets (keys, i, a, b, place, lo, hi)."""
    brackets = asked.groupBy(*keys).agg(F.collect_list(F.struct("i", "a", "b", "place", "lo", "hi")).alias("all"))  # one entry for each quantile
    met = held.join(brackets, keys) if keys else held.join(F.broadcast(brackets))  # one row
    met = met.select(*keys, "v", F.explode("all").alias("e")).select(*keys, "v", "e.*").where("v <= b")
    # rows below a bracket collapse to one value, so what is kept are counts
    kept = met.groupBy(*keys, "i", "a", "b", "place", "lo", "hi", F.when(F.col("v") >= F.col("a"), F.col("v")).alias("v")).agg(F.count("*").alias("k"))
    order = W.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first())
    ranked = kept.withColumn("upto", F.sum("k").over(order))
    holds = lambda r: (F.col("upto") > F.col(r)) & (F.col("upto") - F.col("k") <= F.col(r))
    found = ranked.groupBy(*keys, "i", "place", "lo", "hi").agg(F.max(F.when(holds("lo"), F.col("v"))).alias("x"), F.max(F.when(holds("hi"), F.col("v"))).alias("y"))
    value = F.when((F.col("lo") == F.col("hi")) | (F.col("x") == F.col("y")), F.col("x")).otherwise((F.col("hi") - F.col("place")) * F.col("x") + (F.col("place") - F.col("lo")) * F.col("y"))
    missed = F.raise_error(F.lit("the sketch's bracket missed a quantile")).cast("double")
    return found.select(*keys, "i", F.when(F.col("x").isNull() | F.col("y").isNull(), missed).otherwise(value).alias("value"))


def numbered(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with what ``picked`` reads: the place of each value in its group (_k_*, from 0, nulls last) and the number of those that are not null (_n_*)."""
    group = W.partitionBy(*keys)
    for v in values:
        rows = rows.withColumn(f"_k_{v}", F.row_number().over(group.orderBy(F.col(v).asc_nulls_last())) - 1)
    return rows.withColumns({f"_n_{v}": F.count(v).over(group) for v in values})


def _place(value: str, q: float) -> Column:
    return F.lit(float(q)) * (F.col(f"_n_{value}") - 1)


def _ends(value: str, q: float) -> tuple[Column, Column]:
    """Aggregates of ``numbered`` rows: the values at the places around the quantile's."""
    k, place = F.col(f"_k_{value}"), _place(value, q)
    return F.max(F.when(k == F.floor(place), F.col(value))), F.max(F.when(k == F.ceil(place), F.col(value)))


def _between_ends(at: Column, x: Column, y: Column) -> Column:
    return F.when((F.floor(at) == F.ceil(at)) | (x == y), x).otherwise((F.ceil(at) - at) * x + (at - F.floor(at)) * y)


def picked(value: str, q: float) -> Column:
    """The interpolated quantile, as ``percentile`` gives it: an aggregate of ``numbered`` rows."""
    return _between_ends(F.lit(float(q)) * (F.max(f"_n_{value}") - 1), *_ends(value, q))


def picked_beside(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``numbered`` rows with the quantiles (name: value and share) of their group beside them.

    The values around each are windows of their own: a window that an expression names several times is evaluated as often.
    """
    group = W.partitionBy(*keys)
    ends = {f"_{e}_{n}": c.over(group) for n, (v, q) in wanted.items() for e, c in zip("xy", _ends(v, q), strict=True)}
    return rows.withColumns(ends).withColumns({n: _between_ends(_place(v, q), F.col(f"_x_{n}"), F.col(f"_y_{n}")) for n, (v, q) in wanted.items()}).drop(*ends)
