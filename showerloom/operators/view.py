"""What a before / after picture of one event needs: ranges, ticks, colours and sizes of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import weighted_quantiles

SMALL, LARGE, CAP, AFTER_SCALE, PAD = 2.0, 9.0, 0.95, 12.0 / 9.0, 0.08


def view_ranges(points: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(axis, lo, hi, dtick, tick0) over all points (step_id, x, y, z, energy) of both sides."""
    rows = points.select("step_id", "energy", F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), F.col(k).alias("v")) for k in "xyz"))).alias("p")).select("step_id", "energy", "p.*")
    q = weighted_quantiles(rows, ["axis"], "v", "energy", {"lo": low, "hi": high})
    lim = rows.groupBy("axis").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    both = q.join(lim, "axis")
    flat = F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") == F.col("hi"))
    widen = F.when(flat & (F.col("a") == F.col("b")), 1.0).otherwise(0.0)
    both = both.select("axis", (F.when(flat, F.col("a")).otherwise(F.col("lo")) - widen).alias("lo"), (F.when(flat, F.col("b")).otherwise(F.col("hi")) + widen).alias("hi"))
    pad = (F.col("hi") - F.col("lo")) * PAD
    both = both.select("axis", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))
    step = tick(F.col("hi") - F.col("lo"))
    return both.withColumn("dtick", step).withColumn("tick0", F.floor(F.col("lo") / F.col("dtick")) * F.col("dtick"))


def view_config(points: DataFrame, event_id: int, subdetector: int | None = None, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(axis, title, lo, hi, tickmode, tick0, dtick, figure): what a 3-d picture of one event needs beside its points."""
    if not 0 <= low < high <= 1:
        raise ValueError("quantiles must satisfy 0 <= low < high <= 1")
    figure = f"Shower 3D \u2014 Event {event_id}" + ("" if subdetector is None else f" (subdet {subdetector})")
    ranges = view_ranges(points, low, high)
    return ranges.select("axis", F.concat("axis", F.lit(" [mm]")).alias("title"), "lo", "hi", F.lit("linear").alias("tickmode"), "tick0", "dtick", F.lit(figure).alias("figure"))


def tick(span: Column, target: int = 6) -> Column:
    """The smallest of 1, 2, 5, 10 times a power of ten that is at least span / target; 1 for no span."""
    raw = span / target
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    out = base * 10
    for k in (5, 2, 1):
        out = F.when(base * k >= raw, base * k).otherwise(out)
    return F.when(span > 0, out).otherwise(1.0)


def log_energy(energy: str = "energy") -> Column:
    return F.log10(F.greatest(F.col(energy), F.lit(1e-9)))


def color_range(points: DataFrame) -> DataFrame:
    """(cmin, cmax) of log10 energy; (0, 1) without points."""
    return points.agg(F.coalesce(F.min(log_energy()), F.lit(0.0)).alias("cmin"), F.coalesce(F.max(log_energy()), F.lit(1.0)).alias("cmax"))


def view_points(points: DataFrame) -> DataFrame:
    """(event_id, side, step_id, x, y, z, log_e, size): sizes by energy up to the side's 95th percentile of positive energy."""
    cap = points.groupBy("event_id", "side").agg(F.coalesce(F.percentile(F.when(F.col("energy") > 0, F.col("energy")), CAP), F.lit(1.0)).alias("cap"))
    share = F.least(F.greatest(F.col("energy") / F.when(F.col("cap") > 0, F.col("cap")).otherwise(1.0), F.lit(0.0)), F.lit(1.0))
    size = F.lit(SMALL) + F.lit(LARGE - SMALL) * F.sqrt(share)
    return points.join(cap, ["event_id", "side"]).select("event_id", "side", "step_id", *"xyz", log_energy().alias("log_e"), (size * F.when(F.col("side") == "after", AFTER_SCALE).otherwise(1.0)).alias("size"))
