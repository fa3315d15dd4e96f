"""From labelled steps to point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import weighted_mean

NOISE = -1


def point_cloud(labelled: DataFrame, keys: list[str], label: list[str], with_time: bool = True) -> DataFrame:
    """One point per label: energy-weighted position, summed energy, earliest time, pdg 0, steps merged.

    Noise (first label column NOISE) is dropped.  Labels are taken within keys, so a point can't mix
    events or subdetectors.
    """
    rows = labelled.where(F.col(label[0]) != NOISE) if label == ["label"] else labelled
    aggs = [*(weighted_mean(c, "energy").alias(c) for c in "xyz"), F.sum("energy").alias("energy"), F.count("*").alias("n_steps")]
    if with_time:
        aggs.append(F.min("time").alias("time"))
    return rows.groupBy(*keys, *label).agg(*aggs).withColumn("pdg", F.lit(0))


def noise_report(labelled: DataFrame) -> DataFrame:
    """n_steps, n_noise, noise_pct."""
    n, k = F.count("*"), F.count_if(F.col("label") == NOISE)
    return labelled.agg(n.alias("n_steps"), k.alias("n_noise"), F.try_divide(k * 100.0, n).alias("noise_pct"))


def compression_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_before, n_after, ratio (null if nothing is left), reduction_pct, n_events."""
    b = before.agg(F.count("*").alias("n_before"), F.countDistinct("event_id").alias("n_events"))
    a = after.agg(F.count("*").alias("n_after"))
    both = b.join(F.broadcast(a))  # one row each
    return both.select("n_events", "n_before", "n_after", F.try_divide(F.col("n_before").cast("double"), F.col("n_after")).alias("ratio"), ((1 - F.try_divide(F.col("n_after").cast("double"), F.col("n_before"))) * 100).alias("reduction_pct"))
