"""Density clustering of steps per layer, plain and with a core / tail split.

Layers of few steps are labelled where an event's steps lie (``blocks``).  In all others cells of enough steps are
cores at once, other steps find neighbours by ``range_self_join`` and are cores by count; clusters are connected
components of cells and single cores, border steps go to the smallest core label in reach.  A label is the
smallest core step_id of the cluster (unique within the event), NOISE otherwise.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import layer_of
from ..functions.stats import cumulated, reached_at, weighted_mean, weighted_quantiles
from .blocks import apart, by_event, matrices, split
from .graph import connected_components, cut_lineage
from .neighbors import nearest, range_self_join
from .reduce import NOISE
from .select import LAYER_KEYS, min_group

#: mm and ns that count as one unit
MM, NS = 5.0, 1.0
FEATURES = ["fx", "fy", "ft"]
CELL = ["c0", "c1", "c2"]


def features(steps: DataFrame, min_samples: int = 5) -> DataFrame:
    """Steps of layers with at least min_samples steps, with layer and scaled x, y and time from the layer's median."""
    return scaled(min_group(steps.withColumn("layer", layer_of(F.col("cell_id"))), LAYER_KEYS, min_samples))


def scaled(rows: DataFrame) -> DataFrame:
    """rows (with layer) with FEATURES."""
    middle = F.median("time").over(W.partitionBy(*LAYER_KEYS))
    return rows.withColumns({"fx": F.col("x") / MM, "fy": F.col("y") / MM, "ft": (F.col("time") - middle) / NS})


def neighbour_pairs(rows: DataFrame, eps: float = 1.5, keys: list[str] | None = None) -> DataFrame:
    """Ordered pairs (keys, step_id, other_step_id, d2) within eps, self included; eps may be a column name."""
    return range_self_join(rows, keys or LAYER_KEYS, FEATURES, F.col(eps) if isinstance(eps, str) else eps, ["step_id"])


def core_flags(pairs: DataFrame, keys: list[str], min_samples: int) -> DataFrame:
    """(keys, step_id, neighbours, is_core)."""
    return pairs.groupBy(*keys, "step_id").agg(F.count("*").alias("neighbours")).withColumn("is_core", F.col("neighbours") >= min_samples)


def celled(rows: DataFrame, keys: list[str], eps, min_samples: int) -> DataFrame:
    """(keys, step_id, FEATURES, eps, cells, dense, vertex): steps in cells whose diagonal is below eps.

    A cell with min_samples steps is dense: all its steps are cores of one cluster, so it is one vertex, its
    smallest step_id; any other step is a vertex by itself.
    """
    reach = F.col(eps) if isinstance(eps, str) else F.lit(float(eps))
    width = reach * ((1 - 1e-9) / len(FEATURES) ** 0.5)  # steps of a cell stay within eps whatever the rounding
    cell = [F.floor(F.col(c) / width).cast("long").alias(f"c{i}") for i, c in enumerate(FEATURES)]
    inside = W.partitionBy(*keys, *CELL)
    out = rows.select(*keys, "step_id", *FEATURES, reach.alias("eps"), *cell).withColumns({"dense": F.count("*").over(inside) >= min_samples, "vertex": F.min("step_id").over(inside)})
    return cut_lineage(out.withColumn("vertex", F.when(F.col("dense"), F.col("vertex")).otherwise(F.col("step_id"))))


def cell_pairs(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, eps, u, v, u_*, v_*: bounds, sure) of dense cells that may hold steps within eps, each pair once; sure: all their steps are."""
    bounds = [f(c).alias(f"{c}_{n}") for c in FEATURES for n, f in (("lo", F.min), ("hi", F.max))]
    cells = steps.where("dense").groupBy(*keys, *CELL, "vertex", "eps").agg(*bounds)
    near = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if (a, b, c) > (0, 0, 0)]
    shift = F.explode(F.array(*(F.struct(*(F.lit(k).alias(f"c{i}") for i, k in enumerate(o))) for o in near)))
    left = cells.withColumnsRenamed({"vertex": "u", **{f"{c}_{n}": f"u_{c}_{n}" for c in FEATURES for n in ("lo", "hi")}}).withColumn("o", shift)
    left = left.withColumns({c: F.col(c) + F.col(f"o.{c}") for c in CELL}).drop("o")
    right = cells.drop("eps").withColumnsRenamed({"vertex": "v", **{f"{c}_{n}": f"v_{c}_{n}" for c in FEATURES for n in ("lo", "hi")}})
    gap = [F.greatest(F.col(f"v_{c}_lo") - F.col(f"u_{c}_hi"), F.col(f"u_{c}_lo") - F.col(f"v_{c}_hi"), F.lit(0.0)) for c in FEATURES]
    span = [F.greatest(F.col(f"v_{c}_hi"), F.col(f"u_{c}_hi")) - F.least(F.col(f"v_{c}_lo"), F.col(f"u_{c}_lo")) for c in FEATURES]
    limit = F.col("eps") * F.col("eps")
    return left.join(right, [*keys, *CELL]).where(squares(gap) <= limit).withColumn("sure", squares(span) <= limit).drop(*CELL)


def squares(parts: list) -> Column:
    return reduce(lambda a, b: a + b, (p * p for p in parts))


def beside(pairs: DataFrame, steps: DataFrame, keys: list[str], end: str, other: str) -> DataFrame:
    """pairs with every step of their cell `end` (as end_fx, ..) and its squared distance to the other cell's bounds, where that is within eps."""
    rows = steps.where("dense").select(*keys, F.col("vertex").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in FEATURES))
    gap = squares([F.greatest(F.col(f"{other}_{c}_lo") - F.col(f"{end}_{c}"), F.col(f"{end}_{c}") - F.col(f"{other}_{c}_hi"), F.lit(0.0)) for c in FEATURES])
    return pairs.join(rows, [*keys, end]).withColumn(f"{end}_gap", gap).where(F.col(f"{end}_gap") <= F.col("eps") * F.col("eps"))


def witnessed(pairs: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u, v) of cell pairs whose step of u nearest to v's bounds has a step of v within eps: linear in the steps."""
    first = beside(pairs, steps, keys, "u", "v").groupBy(*keys, "u", "v", "eps", *(f"u_{c}_{n}" for c in FEATURES for n in ("lo", "hi"))).agg(F.min_by(F.struct(*(f"u_{c}" for c in FEATURES)), "u_gap").alias("at"))
    return touching(beside(first.select("*", "at.*").drop("at"), steps, keys, "v", "u"), keys)


def touching(rows: DataFrame, keys: list[str]) -> DataFrame:
    apart = squares([F.col(f"u_{c}") - F.col(f"v_{c}") for c in FEATURES])
    return rows.where(apart <= F.col("eps") * F.col("eps")).select(*keys, "u", "v").distinct()


def clusters(steps: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, root) of core vertices that are linked; links: (keys, u, v) of cores outside dense cells.

    Pairs of dense cells are linked by their bounds, then by one witness.  Only pairs that are still in
    different clusters after that are compared step by step, near the bounds they share.
    """
    if steps.where("dense").isEmpty():
        return connected_components(links, keys, "u", "v")
    pairs = cut_lineage(cell_pairs(steps, keys))
    open_pairs = pairs.where("NOT sure")
    seen = cut_lineage(witnessed(open_pairs, steps, keys))
    groups = connected_components(links.unionByName(pairs.where("sure").select(*keys, "u", "v")).unionByName(seen), keys, "u", "v")
    root = lambda c: groups.select(*keys, F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    rest = open_pairs.join(seen, [*keys, "u", "v"], "left_anti").join(root("u"), [*keys, "u"], "left").join(root("v"), [*keys, "v"], "left")
    rest = rest.withColumns({f"{c}_root": F.coalesce(f"{c}_root", c) for c in "uv"}).where("u_root <> v_root")
    more = touching(beside(beside(rest, steps, keys, "u", "v"), steps, keys, "v", "u"), keys)
    joined = cut_lineage(more.join(rest.select(*keys, "u", "v", "u_root", "v_root"), [*keys, "u", "v"]).select(*keys, "u_root", "v_root").distinct())
    if joined.isEmpty():
        return groups
    again = connected_components(joined, keys, "u_root", "v_root").withColumnsRenamed({"id": "root", "root": "top"})
    return groups.join(again, [*keys, "root"], "left").select(*keys, "id", F.coalesce("top", "root").alias("root")).unionByName(
        again.join(groups, [*keys, "root"], "left_anti").select(*keys, F.col("root").alias("id"), F.col("top").alias("root"))
    )


def labels_within(table: pa.Table, sizes: np.ndarray, eps, min_samples: int) -> list[np.ndarray]:
    """Labels of the steps of small groups."""
    columns = [table[c].to_numpy() for c in FEATURES]
    reach = table[eps].to_numpy() if isinstance(eps, str) else np.full(table.num_rows, float(eps))
    out = np.full(table.num_rows, NOISE)
    for rows, own in matrices(sizes):
        r = reach[rows][:, None, :]
        with np.errstate(invalid="ignore"):
            near = apart(columns, rows, own) <= r * r
        core = near.sum(1) >= min_samples
        least = smallest_reached(near & core[:, :, None], core)
        steps = table["step_id"].to_numpy()[rows]
        found = np.take_along_axis(steps, np.minimum(least, steps.shape[1] - 1), 1)
        out[rows[own]] = np.where(least < steps.shape[1], found, NOISE)[own]
    return [out]


def smallest_reached(meets: np.ndarray, core: np.ndarray) -> np.ndarray:
    """For each row of each line the smallest core row of the clusters that it meets, the number of rows where it meets none; meets[., j, i]: j is a core within reach of i."""
    n = core.shape[1]
    kind = np.int16 if n < 1 << 15 else np.int32
    label = np.where(core, np.arange(n, dtype=kind), kind(n))
    while True:
        least = np.where(meets, label[:, :, None], kind(n)).min(1)
        lower = np.where(core, np.minimum(least, label), kind(n))
        ends = np.concatenate([lower, np.full((len(lower), 1), n, kind)], 1)
        lower = np.take_along_axis(ends, lower.astype(np.int64), 1)
        if (lower == label).all():
            return least
        label = lower


def labelled(rows: DataFrame, keys: list[str], eps, min_samples: int) -> DataFrame:
    """rows with label; groups of fewer than min_samples rows are NOISE."""
    small, large = split(rows, keys)
    found = by_event(small, keys, lambda table, sizes: labels_within(table, sizes, eps, min_samples), "label long")
    return found if large is None else found.unionByName(labelled_by_joins(large, keys, eps, min_samples).select(found.columns))


def labelled_by_joins(rows: DataFrame, keys: list[str], eps, min_samples: int) -> DataFrame:
    """rows with label.

    Only steps outside dense cells look for neighbours; what they meet is kept as one row for each vertex.
    """
    steps = celled(rows, keys, eps, min_samples)
    pairs = range_self_join(steps, keys, FEATURES, F.col("eps"), ["step_id", "vertex", "dense"], asking=~F.col("dense"))
    met = cut_lineage(pairs.groupBy(*keys, "step_id", F.col("other_vertex").alias("vertex"), F.col("other_dense").alias("dense")).agg(F.count("*").alias("n")))
    cores = met.groupBy(*keys, "step_id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select(*keys, F.col("step_id").alias("vertex"))
    to_core = cut_lineage(met.join(cores.withColumn("core", F.lit(True)), [*keys, "vertex"], "left").where("dense OR core").select(*keys, "step_id", "vertex", "dense"))
    own = to_core.where("step_id = vertex").select(*keys, "step_id")  # a core meets itself
    links = to_core.where("dense OR step_id < vertex").join(own, [*keys, "step_id"], "left_semi").select(*keys, F.col("step_id").alias("u"), F.col("vertex").alias("v"))
    root = clusters(steps, links, keys).withColumnRenamed("id", "vertex")
    # a core's own label is the smallest in reach too: all cores around it are in its cluster
    reach = to_core.drop("dense").unionByName(steps.where("dense").select(*keys, "step_id", "vertex"))
    found = reach.join(root, [*keys, "vertex"], "left").groupBy(*keys, "step_id").agg(F.min(F.coalesce("root", "vertex")).alias("label"))
    return rows.join(found, [*keys, "step_id"], "left").withColumn("label", F.coalesce("label", F.lit(NOISE)))


def dbscan(steps: DataFrame, eps: float = 1.5, min_samples: int = 5) -> DataFrame:
    """steps with layer and label."""
    rows = scaled(steps.withColumn("layer", layer_of(F.col("cell_id"))))
    return labelled(rows, LAYER_KEYS, eps, min_samples).drop(*FEATURES)


def layer_radius(rows: DataFrame, quantile: float = 0.68) -> tuple[DataFrame, DataFrame]:
    """(rows with r from the layer's energy centroid in xy, (LAYER_KEYS, rq): energy quantile of r, 0 without energy)."""
    centre = rows.groupBy(*LAYER_KEYS).agg(weighted_mean("x", "energy").alias("cx"), weighted_mean("y", "energy").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    rows = rows.join(centre, LAYER_KEYS).withColumn("r", F.sqrt(dx * dx + dy * dy)).drop("cx", "cy")
    rq = weighted_quantiles(rows, LAYER_KEYS, "r", "energy", {"rq": quantile})
    return rows, rq.withColumn("rq", F.coalesce("rq", F.lit(0.0)))


def zoned(rows: DataFrame, quantile: float, core_eps: float, tail_eps: float) -> DataFrame:
    """rows (with layer) with zone and eps, all by windows of the layer: ``layer_radius`` without joins."""
    layer = W.partitionBy(*LAYER_KEYS)
    rows = rows.withColumns({f"_c{k}": weighted_mean(k, "energy", layer) for k in "xy"})
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    rows = cumulated(rows.withColumn("_r", F.sqrt(dx * dx + dy * dy)), LAYER_KEYS, "_r", "energy", "step_id").withColumn("_rq", F.coalesce(reached_at(quantile, "_r").over(layer), F.lit(0.0)))
    core = F.col("_r") <= F.col("_rq")
    rows = rows.withColumns({"zone": F.when(core, "core").otherwise("tail"), "eps": F.when(core, core_eps).otherwise(tail_eps)})
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def nearest_core(found: DataFrame, zones: list[str], reach: float) -> DataFrame:
    """found with the labels of tail clusters merged, by windows: a small layer has few core clusters, each told once by the step that names it."""
    w, named, own = F.col("energy"), F.col("label") != NOISE, W.partitionBy(*zones, "label")
    total = F.sum(w).over(own)
    centre = {f"_{c}": F.when(total > 0, F.try_divide(F.sum(w * F.col(c)).over(own), total)).otherwise(F.sum(w * F.col(c)).over(own)) for c in FEATURES}
    told = F.when(named & (F.col("zone") == "core") & (F.col("step_id") == F.col("label")), F.struct("label", *centre))
    rows = found.withColumns(centre).withColumn("_cores", F.collect_list(told).over(W.partitionBy(*LAYER_KEYS)))
    each = lambda c: F.struct(squares([F.col(f"_{f}") - c[f"_{f}"] for f in FEATURES]).alias("d2"), c["label"].alias("label"))
    rows = rows.withColumn("_best", F.when(named & (F.col("zone") == "tail"), F.array_min(F.transform("_cores", each))))
    return rows.withColumn("label", F.when(F.col("_best.d2") <= reach * reach, F.col("_best.label")).otherwise(F.col("label"))).drop("_cores", "_best", *centre)


def dbscan_adaptive(steps: DataFrame, eps: float = 1.5, min_samples: int = 5, quantile: float = 0.68, k_core: float = 1.8, k_tail: float = 0.6) -> DataFrame:
    """steps with layer and label; core (r <= rq) and tail of a layer are clustered apart.

    A tail cluster joins the core cluster with the nearest energy centroid in scaled space if that
    is within eps; labels belong to the steps they were computed for.
    """
    rows = zoned(scaled(steps.withColumn("layer", layer_of(F.col("cell_id")))), quantile, eps * k_core, eps * k_tail)
    zones = [*LAYER_KEYS, "zone"]
    small, large = split(rows, LAYER_KEYS)
    within = by_event(small, zones, lambda table, sizes: labels_within(table, sizes, "eps", min_samples), "label long")
    out = nearest_core(within.repartition("event_id"), zones, eps)
    if large is not None:
        out = out.unionByName(adaptive_by_joins(large, zones, eps, min_samples).select(out.columns))
    return out.drop(*FEATURES, "zone", "eps")


def adaptive_by_joins(rows: DataFrame, zones: list[str], eps: float, min_samples: int) -> DataFrame:
    """rows (``zoned``) with label, for layers of any size."""
    found = cut_lineage(labelled(rows, zones, "eps", min_samples))
    w = F.col("energy")
    share = lambda c: F.when(F.sum(w) > 0, F.try_divide(F.sum(w * F.col(c)), F.sum(w))).otherwise(F.sum(w * F.col(c))).alias(c)
    centres = found.where(F.col("label") != NOISE).groupBy(*zones, "label").agg(*map(share, FEATURES))
    tails = centres.where("zone = 'tail'").drop("zone")
    cores = centres.where("zone = 'core'").drop("zone").withColumnsRenamed({c: f"core_{c}" for c in ("label", *FEATURES)})
    d2 = sum(((F.col(c) - F.col(f"core_{c}")) * (F.col(c) - F.col(f"core_{c}")) for c in FEATURES[1:]), (F.col("fx") - F.col("core_fx")) * (F.col("fx") - F.col("core_fx")))
    merged = nearest(tails.join(cores, LAYER_KEYS).withColumn("d2", d2), [*LAYER_KEYS, "label"], ["d2", "core_label"]).where(F.col("d2") <= eps * eps)
    merged = merged.select(*LAYER_KEYS, "label", F.lit("tail").alias("zone"), "core_label")
    return found.join(merged, [*zones, "label"], "left").withColumn("label", F.coalesce("core_label", "label"))
