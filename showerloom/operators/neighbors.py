"""Range self-joins as bucketed equi-joins, and the nearest row of lower rank by rings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut_lineage

#: levels between two rounds of a ring search: cells of about three times the width
COARSER = 3
#: level of groups with at most FEW rows
WHOLE, FEW = -1, 128


def range_self_join(df: DataFrame, keys: list[str], dims: list[str], radius: Column | float, carry: list[str], bucketed: int = 2, strict: bool = False, asking: Column | None = None) -> DataFrame:
    """Ordered pairs (keys, carry, other_*: carry, d2) within radius in the same keys, self included; asking: which rows may come first.

    The first `bucketed` dims are cut in buckets of the radius; each left row looks into the 3^k
    buckets around its own, so the join is an equi-join on keys and buckets whatever a group's size.
    A group of at most FEW rows is one bucket.  radius may be a column that is constant within keys.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    cut = dims[:bucketed]
    few = F.count("*").over(W.partitionBy(*keys)) <= FEW
    first = F.lit(True) if asking is None else asking
    rows = df.select(*keys, *dims, *carry, r.alias("_r"), first.alias("_first"), few.alias("_few"))
    rows = rows.withColumns({f"_b{i}": F.when(F.col("_few"), 0).otherwise(F.floor(F.col(d) / F.col("_r"))).cast("long") for i, d in enumerate(cut)})
    left = rows.where("_first")
    for i in range(len(cut)):
        b = F.col(f"_b{i}")
        left = left.withColumn(f"_b{i}", F.explode(F.when(F.col("_few"), F.array(b)).otherwise(F.array(b - 1, b, b + 1))))
    left = left.drop("_first", "_few")
    right = rows.drop("_r", "_first", "_few").withColumnsRenamed({c: f"other_{c}" for c in (*dims, *carry)})
    pairs = left.join(right, [*keys, *(f"_b{i}" for i in range(len(cut)))])
    gaps = [F.col(d) - F.col(f"other_{d}") for d in dims]
    d2 = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    near = F.col("d2") < F.col("_r") * F.col("_r") if strict else F.col("d2") <= F.col("_r") * F.col("_r")
    return pairs.withColumn("d2", d2).where(near).select(*keys, *carry, *(f"other_{c}" for c in carry), "d2")


def nearest(pairs: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first pair of each key in the given order."""
    return pairs.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def ring_pairs(asking: DataFrame, points: DataFrame, keys: list[str], dims: list[str], radius: float) -> DataFrame:
    """Rows of asking (with level) beside the points (step_id, rank) of the 3 x 3 cells around them, nearer than radius.

    Cells of level l are radius / 2^(l/2) wide, so every point within that width is met; level WHOLE is
    one cell for all points of the keys.  Points are only put into cells of levels that rows of the
    same keys ask for.
    """
    width = F.lit(float(radius)) / F.pow(F.lit(2.0), F.col("level") / 2)
    cell = [F.when(F.col("level") == WHOLE, 0).otherwise(F.floor(F.col(d) / width)).cast("long").alias(f"_b{i}") for i, d in enumerate(dims)]
    levels = asking.select(*keys, "level").distinct()
    right = points.select(*keys, *(F.col(d).alias(f"other_{d}") for d in dims), *dims, F.col("step_id").alias("other_step_id"), F.col("rank").alias("other_rank"))
    right = right.join(levels, keys).select(*keys, "level", *cell, *(f"other_{d}" for d in dims), "other_step_id", "other_rank")
    left = asking.select("*", *cell)
    for i in range(len(dims)):
        b = F.col(f"_b{i}")
        left = left.withColumn(f"_b{i}", F.explode(F.when(F.col("level") == WHOLE, F.array(b)).otherwise(F.array(b - 1, b, b + 1))))
    gaps = [F.col(d) - F.col(f"other_{d}") for d in dims]
    d2 = reduce(lambda a, b: a + b, (g * g for g in gaps))
    pairs = left.join(right, [*keys, "level", *(f"_b{i}" for i in range(len(dims)))])
    return pairs.withColumn("d2", d2).where(F.col("d2") < F.lit(float(radius)) * F.lit(float(radius)))


def nearest_of_lower_rank(rows: DataFrame, keys: list[str], dims: list[str], radius: float, level: Column, cap: int | None) -> DataFrame:
    """(keys, step_id, d2, nh): the nearest row of lower rank strictly within radius, where it is among the min(rank + 1, cap) nearest rows of any rank (anywhere without cap).

    rows: keys, step_id, rank, dims; ties of distance go to the smaller step_id; a row is its own nearest.
    level: where a row's search begins: two for each halving of the radius (``ring_pairs``).  A row stops at the first level at
    which a row of lower rank, or as many rows as may be looked at, lie within the width of a cell, for then nothing
    nearer can be missing; the others go on with wider cells, up to the radius.  Rows of groups of at most
    FEW rows look at their whole group at once.  Each round counts and
    takes minima by hash, nothing is sorted; whose position among the nearest decides is found by counting again
    up to the distance that has been found.
    """
    limit = F.least(F.col("rank") + 1, F.lit(cap)).cast("long") if cap else F.lit(1 << 62)
    few = F.max("rank").over(W.partitionBy(*keys)) < FEW
    begin = F.when(few, WHOLE).otherwise(F.greatest(level, F.lit(0))).cast("int")
    asking = cut_lineage(rows.select(*keys, "step_id", "rank", *dims, begin.alias("level"), limit.alias("limit")).where("rank > 0"))
    row = asking.columns
    sure = F.lit(float(radius)) / F.pow(F.lit(2.0), F.col("level") / 2)
    last = F.col("level") <= 0
    done = []
    while not asking.isEmpty():
        met = ring_pairs(asking, rows, keys, dims, radius).groupBy(*row).agg(F.min(F.when(F.col("other_rank") < F.col("rank"), F.col("d2"))).alias("least"), F.count_if(F.col("d2") < sure * sure).alias("near"))
        met = cut_lineage(met.withColumn("found", F.when(last | (F.col("least") < sure * sure), F.col("least"))))
        ready = last | F.col("found").isNotNull() | (F.col("near") >= F.col("limit"))
        done.append(met.where(ready & F.col("found").isNotNull()).select(*row, "found"))
        asking = met.where(~ready).select(*row).withColumn("level", F.greatest(F.col("level") - COARSER, F.lit(0)))
    if not done:
        return rows.select(*keys, "step_id", F.lit(0.0).alias("d2"), F.col("step_id").alias("nh")).where(F.lit(False))
    found = reduce(DataFrame.unionByName, done)
    at = F.col("d2") == F.col("found")
    counted = ring_pairs(found, rows, keys, dims, radius).where("d2 <= found").groupBy(*row, "found").agg(
        F.count_if(~at).alias("nearer"), F.count("*").alias("up_to"), F.min(F.when(at & (F.col("other_rank") < F.col("rank")), F.col("other_step_id"))).alias("nh"),
    )
    counted = cut_lineage(counted.where("nearer < limit"))
    plain = counted.where("up_to <= limit").select(*keys, "step_id", F.col("found").alias("d2"), "nh")
    tied = counted.where("up_to > limit")  # equal distances on both sides of the limit
    if tied.isEmpty():
        return plain
    before = ring_pairs(tied, rows, keys, dims, radius).where("d2 = found AND other_step_id <= nh").groupBy(*keys, "step_id", "found", "nh", "nearer", "limit").agg(F.count("*").alias("place"))
    return plain.unionByName(before.where("nearer + place <= limit").select(*keys, "step_id", F.col("found").alias("d2"), "nh"))
