"""Weighted statistics as aggregate columns, and those that need a sort as DataFrame functions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..operators.graph import cut_lineage
from ..operators.quantiles import picked
from ..operators.select import with_event
from .geometry import Vec, cross, dot, norm, scaled


def weighted_mean(value, weight, over: WindowSpec | None = None) -> Column:
    """sum(w v) / sum(w); the plain mean where the weights sum to 0 or less; equal values are their own mean exactly; over: of a window's rows."""
    v, w = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    of = lambda c: c if over is None else c.over(over)
    return F.when(of(F.min(v)) == of(F.max(v)), of(F.min(v))).when(of(F.sum(w)) > 0, F.try_divide(of(F.sum(w * v)), of(F.sum(w)))).otherwise(of(F.avg(v)))


def circular_mean(angle: str, weight: str) -> Column:
    """Direction of the weighted mean vector; 0 where the weights sum to 0 or less."""
    a, w = F.col(angle), F.col(weight)
    return F.when(F.sum(w) > 0, F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a)))).otherwise(0.0)


def fd_width(value: str) -> Column:
    """Freedman-Diaconis width 2 s n^(-1/3), s: IQR or, where that is 0, the population deviation; null without spread."""
    return fd_of(F.percentile(value, 0.75) - F.percentile(value, 0.25), F.stddev_pop(value), F.count(value))


def fd_width_of_numbered(value: str) -> Column:
    """``fd_width`` as an aggregate of ``numbered`` rows."""
    return fd_of(picked(value, 0.75) - picked(value, 0.25), F.stddev_pop(value), F.max(f"_n_{value}"))


def fd_of(iqr: Column, deviation: Column, n: Column) -> Column:
    """``fd_width`` from its parts."""
    spread = F.when(iqr > 0, iqr).otherwise(deviation)
    return F.when((n > 1) & (spread > 0), spread * 2 * F.pow(n.cast("double"), F.lit(-1.0 / 3)))


def clamped(width: Column, low: float, high: float) -> Column:
    return F.coalesce(F.least(F.greatest(width, F.lit(low)), F.lit(high)), F.lit(low))


def covariance(df: DataFrame, keys: list[str], names: Vec | tuple[str, str, str] = ("x", "y", "z"), weight: str = "energy") -> DataFrame:
    """Per key: n, centroid (cx, cy, cz) and weighted covariance (sxx .. szz) about it, in two passes."""
    x, y, z = names
    centre = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(weight).alias("sw"), *(weighted_mean(c, weight).alias(f"c{k}") for c, k in zip(names, "xyz", strict=True)))
    rows = df.select(*keys, *names, weight)
    rows = with_event(rows, cut_lineage(centre)) if keys == ["event_id"] else rows.join(centre, keys)
    w = F.when(F.col("sw") > 0, F.col(weight)).otherwise(1.0)
    d = {k: F.col(c) - F.col(f"c{k}") for c, k in zip(names, "xyz", strict=True)}
    terms = [F.try_divide(F.sum(w * d[a] * d[b]), F.sum(w)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return rows.groupBy(*keys, "n", "cx", "cy", "cz").agg(*terms)


def staged(df: DataFrame, columns: dict) -> DataFrame:
    """df with columns computed once: a one-row explode keeps the optimizer from inlining them into all later uses."""
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_stage")
    return df.select("*", one).select(*df.columns, *(F.col(f"_stage.{n}").alias(n) for n in columns))


def with_axis(cov: DataFrame) -> DataFrame:
    """cov with ax, ay, az: the eigenvector of the largest eigenvalue, a . (1, 1, 1) >= 0.

    Closed form for symmetric 3 x 3 matrices: the eigenvalue by the cosine rule, the vector as the
    longest cross product of two rows of S - l I.  Where the two largest eigenvalues are equal these
    products vanish; the axis is then a direction across the longest row, among the two.  One row,
    isotropic or null spectra give z.
    """
    s = {k: F.col(f"s{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    out = staged(cov, {"_q": (s["xx"] + s["yy"] + s["zz"]) / 3})
    q = F.col("_q")
    a, b, c = s["xx"] - q, s["yy"] - q, s["zz"] - q
    out = staged(out, {"_p": F.sqrt((a * a + b * b + c * c + (s["xy"] * s["xy"] + s["xz"] * s["xz"] + s["yz"] * s["yz"]) * 2) / 6)})
    p = F.col("_p")
    det = a * (b * c - s["yz"] * s["yz"]) - s["xy"] * (s["xy"] * c - s["yz"] * s["xz"]) + s["xz"] * (s["xy"] * s["yz"] - b * s["xz"])
    half = F.least(F.greatest(F.try_divide(det, p * p * p * 2), F.lit(-1.0)), F.lit(1.0))
    out = staged(out, {"_l": q + p * 2 * F.cos(F.acos(half) / 3)})
    m = F.col("_l")
    rows = ((s["xx"] - m, s["xy"], s["xz"]), (s["xy"], s["yy"] - m, s["yz"]), (s["xz"], s["yz"], s["zz"] - m))
    crosses = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    out = staged(out, {f"_v{i}{k}": v[j] for i, v in enumerate(crosses) for j, k in enumerate("xyz")})
    out = staged(out, {f"_n{i}": dot(v, v) for i in range(3) for v in [tuple(F.col(f"_v{i}{k}") for k in "xyz")]})
    v = {k: F.when((F.col("_n0") >= F.col("_n1")) & (F.col("_n0") >= F.col("_n2")), F.col(f"_v0{k}")).when(F.col("_n1") >= F.col("_n2"), F.col(f"_v1{k}")).otherwise(F.col(f"_v2{k}")) for k in "xyz"}
    out = staged(out, {f"_w{k}": v[k] for k in "xyz"} | {"_n": F.sqrt(F.greatest("_n0", "_n1", "_n2"))})
    sizes = [dot(row, row) for row in rows]
    row = {k: F.when((sizes[0] >= sizes[1]) & (sizes[0] >= sizes[2]), rows[0][j]).when(sizes[1] >= sizes[2], rows[1][j]).otherwise(rows[2][j]) for j, k in enumerate("xyz")}
    out = staged(out, {f"_r{k}": row[k] for k in "xyz"})
    x, y, z = (F.col(f"_r{k}") for k in "xyz")
    near_x, near_y = (F.abs(x) <= F.abs(y)) & (F.abs(x) <= F.abs(z)), F.abs(y) <= F.abs(z)
    pick = lambda a, b, c: F.when(near_x, a).when(near_y, b).otherwise(c)
    out = staged(out, {"_ex": pick(F.lit(0.0), -z, y), "_ey": pick(z, F.lit(0.0), -x), "_ez": pick(-y, x, F.lit(0.0)), "_equal": F.col("_n") <= F.col("_p") * F.col("_p") * 1e-7})
    size = F.sqrt(F.col("_ex") * F.col("_ex") + F.col("_ey") * F.col("_ey") + F.col("_ez") * F.col("_ez"))
    out = out.withColumns({f"_w{k}": F.when(F.col("_equal"), F.col(f"_e{k}")).otherwise(F.col(f"_w{k}")) for k in "xyz"} | {"_n": F.when(F.col("_equal"), size).otherwise(F.col("_n"))})
    good = (F.col("n") >= 2) & (F.col("_p") > 0) & (F.col("_n") > 0)
    sign = F.when(F.col("_wx") + F.col("_wy") + F.col("_wz") < 0, -1.0).otherwise(1.0)
    out = staged(out, {f"a{k}": F.when(good, F.try_divide(F.col(f"_w{k}"), F.col("_n")) * sign).otherwise(1.0 if k == "z" else 0.0) for k in "xyz"})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, quantiles: dict[str, float], tie: str = "step_id") -> DataFrame:
    """Per key one column per quantile, by linear interpolation over cumulative weight shares.

    Below the first share the first value counts; groups whose weights sum to 0 or less get null.
    """
    rows = cumulated(df.select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_w"), F.col(tie).alias("_t")), keys, "_v", "_w", "_t")
    return rows.groupBy(*keys).agg(*(reached_at(q, "_v").alias(name) for name, q in quantiles.items()))


def cumulated(rows: DataFrame, keys: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """rows with their place (_k), cumulative weight share (_c) and the value and share before them (_pv, _pc)."""
    order = W.partitionBy(*keys).orderBy(value, tie)
    run = lambda last: F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, last))
    rows = rows.withColumns({"_run": run(0), "_prun": run(-1), "_total": F.sum(weight).over(W.partitionBy(*keys)), "_pv": F.lag(value).over(order), "_k": F.row_number().over(order)})
    share = lambda c: F.when(F.col("_total") > 0, F.try_divide(F.col(c), F.col("_total")))
    return rows.withColumns({"_c": share("_run"), "_pc": share("_prun")}).drop("_prun")  # the same sums, so no second sort for the share before


def reached_at(q: float, value: str) -> Column:
    """The aggregate of ``cumulated`` rows that is their weighted quantile."""
    v = F.col(value)
    at = F.when(F.col("_pc").isNull() | (F.col("_c") <= F.col("_pc")), v).otherwise(F.col("_pv") + (F.lit(q) - F.col("_pc")) * (v - F.col("_pv")) / (F.col("_c") - F.col("_pc")))
    reached = (F.col("_c") >= q) | (F.col("_c") == 1.0)
    return F.min_by(F.when(reached, at), F.when(reached, F.col("_k")))


def with_basis(frame: DataFrame) -> DataFrame:
    """frame (ax, ay, az) with two directions across the axis: b1x .. b1z and b2x .. b2z, per row of the frame."""
    axis = tuple(F.col(f"a{k}") for k in "xyz")
    near_x = F.abs(axis[0]) >= 0.9
    helper = (F.when(near_x, 0.0).otherwise(1.0), F.when(near_x, 1.0).otherwise(0.0), F.lit(0.0))
    for name, other in (("b1", helper), ("b2", tuple(F.col(f"b1{k}") for k in "xyz"))):
        frame = staged(frame, {f"_c{k}": v for k, v in zip("xyz", cross(axis, other), strict=True)})
        c = tuple(F.col(f"_c{k}") for k in "xyz")
        frame = staged(frame, {f"{name}{k}": c[i] / (norm(c) + 1e-12) for i, k in enumerate("xyz")}).drop("_cx", "_cy", "_cz")
    return frame


def histogram_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin from 0, the last one closed; null outside; equal limits are widened by one half."""
    lo = F.when(low == high, low - 0.5).otherwise(low)
    hi = F.when(low == high, high + 0.5).otherwise(high)
    return F.when((value >= lo) & (value <= hi), F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1))).cast("long")


def degrees(angle: Column) -> Column:
    return angle * 180 / F.lit(pi)


def unit_vector(v: Vec) -> Vec:
    return scaled(v, 1 / (norm(v) + 1e-12))
