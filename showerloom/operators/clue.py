"""Density-peak clustering of steps per layer.

rho: 1 + (neighbours within dc - 1) / 2.  Steps of a layer are ranked by falling rho, ties by
step_id.  A step's nearest higher is its closest step of smaller rank among the min(rank + 1, K_CAP)
closest steps of any rank (itself included) strictly within the search radius; delta is that
distance, or the layer's largest finite delta (the radius if there is none).  Seeds have rho >= rhoc
and delta >= deltac; a layer without seeds promotes its step of largest rho delta, if that is above 0.  Others take the
label of the first seed along nearest-higher steps; chains that end elsewhere or meet an outlier
stay NOISE.  Labels are seeds' step_ids.  exact=True lifts the cap on neighbours.
Layers of few steps are settled where an event's steps lie (``blocks``), all others by joins.
"""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import layer_of
from .blocks import apart, by_event, matrices, split
from .graph import cut_lineage, follow
from .neighbors import nearest_of_lower_rank, range_self_join
from .reduce import NOISE
from .select import LAYER_KEYS, min_group

MM, K_CAP, SEARCH, PROBE = 5.0, 128, 5.0, 16
PARAMS = {"dc": 15.3, "rhoc": 5.0, "deltac": None, "outlier_factor": None, "min_points": 5}


def features(steps: DataFrame, min_points: int = 5) -> DataFrame:
    return scaled(min_group(steps.withColumn("layer", layer_of(F.col("cell_id"))), LAYER_KEYS, min_points))


def scaled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"fx": F.col("x") / MM, "fy": F.col("y") / MM})


def density(rows: DataFrame, dc: float) -> DataFrame:
    """(LAYER_KEYS, step_id, rho)."""
    pairs = range_self_join(rows, LAYER_KEYS, ["fx", "fy"], dc / MM, ["step_id"])
    return pairs.groupBy(*LAYER_KEYS, "step_id").agg(((F.count("*") - 1) * 0.5 + 1.0).alias("rho"))


def search_radius(dc: float, outlier_factor: float | None) -> float:
    return (outlier_factor or SEARCH) * dc / MM


def peaks_within(table: pa.Table, sizes: np.ndarray, dc: float, radius: float, cap: int | None, least: int = 0) -> dict[str, np.ndarray]:
    """rho, rank, delta and nh (a row number, -1 for none) of the steps of small layers; taken: those that have a density, in layers of at least `least` steps."""
    columns, n = [table[c].to_numpy() for c in ("fx", "fy")], table.num_rows
    out = {"taken": np.zeros(n, bool), "rho": np.zeros(n), "rank": np.zeros(n, np.int64), "delta": np.zeros(n), "nh": np.zeros(n, np.int64)}
    for rows, own in matrices(sizes):
        with np.errstate(invalid="ignore"):
            d2 = apart(columns, rows, own)
        within = (d2 <= dc / MM * (dc / MM)).sum(-1)
        taken = (within > 0) & (own.sum(-1, keepdims=True) >= least)
        rho = np.where(taken, (within - 1) * 0.5 + 1.0, -np.inf)
        rank = np.argsort(np.argsort(-rho, axis=1, kind="stable"), axis=1)
        near = d2 < radius * radius
        place = rank.astype(np.int32)
        d2_higher = np.where(near & (place[:, None, :] < place[:, :, None]), d2, np.inf)
        nh = d2_higher.argmin(-1)
        d2_found = np.take_along_axis(d2_higher, nh[:, :, None], 2)
        has = taken & np.isfinite(d2_found[:, :, 0])
        if cap:  # its position among the nearest
            before = near & ((d2 < d2_found) | (d2 == d2_found) & (np.arange(rows.shape[1]) <= nh[:, :, None]))
            has &= before.sum(-1) <= np.minimum(rank + 1, cap)
        found = np.where(has, np.sqrt(d2_found[:, :, 0]), -np.inf)
        most = found.max(-1, keepdims=True)
        delta = np.where(has, found, np.where(most < 0, radius, most))
        for name, values in (("taken", taken), ("rho", rho), ("rank", rank), ("delta", delta), ("nh", np.where(has, np.take_along_axis(rows, nh, 1), -1))):
            out[name][rows[own]] = values[own]
    return out | {"group": np.repeat(np.arange(len(sizes)), sizes)}


def peak_columns(table: pa.Table, sizes: np.ndarray, *search) -> list[tuple]:
    p = peaks_within(table, sizes, *search)
    no = ~p["taken"]
    return [(p["rho"], None, no), (p["rank"].astype(np.int32), None, no), (p["delta"], None, no), (table["step_id"].to_numpy()[p["nh"]], None, p["nh"] < 0)]


def labels_within(table: pa.Table, sizes: np.ndarray, search: tuple, dc: float, rhoc: float, deltac: float | None, outlier_factor: float | None) -> list[np.ndarray]:
    """Labels of the steps of small layers: ``classify`` and ``labels`` on ``peaks_within``."""
    p = peaks_within(table, sizes, *search)
    rho, delta, taken, group = p["rho"], p["delta"], p["taken"], p["group"]
    dense, first = rho >= rhoc, np.cumsum(sizes) - sizes
    seed = taken & dense & (delta >= (dc if deltac is None else deltac) / MM)
    outlier = taken & ~dense & (delta >= outlier_factor * dc / MM) if outlier_factor else np.zeros(len(rho), bool)
    gain = np.where(taken, np.where(taken, rho, 0.0) * delta, -np.inf)
    best = np.lexsort([-gain, outlier | ~taken, group])[first]
    seed[best] |= ~np.logical_or.reduceat(seed, first) & ~outlier[best] & (gain[best] > 0)
    n = len(rho)
    to = np.append(np.where(seed, np.arange(n), np.where(outlier | (p["nh"] < 0), n, p["nh"])), n)
    while (to[to] != to).any():
        to = to[to]
    return [np.append(table["step_id"].to_numpy(), NOISE)[to[:n]]]


def nearest_higher(rows: DataFrame, dc: float, outlier_factor: float | None = None, exact: bool = False) -> DataFrame:
    """(LAYER_KEYS, step_id, rho, rank, delta, nh): nh null where no higher step was found."""
    search = (dc, search_radius(dc, outlier_factor), None if exact else K_CAP)
    small, large = split(rows.select(*LAYER_KEYS, "step_id", "fx", "fy"), LAYER_KEYS)
    found = by_event(small, LAYER_KEYS, lambda table, sizes: peak_columns(table, sizes, *search), "rho double, rank int, delta double, nh long")
    found = found.where("rho IS NOT NULL").drop("fx", "fy")
    return found if large is None else found.unionByName(higher_by_joins(large, dc, outlier_factor, exact))


def higher_by_joins(rows: DataFrame, dc: float, outlier_factor: float | None = None, exact: bool = False) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*LAYER_KEYS).orderBy(F.desc("rho"), "step_id")) - 1
    ranked = cut_lineage(rows.select(*LAYER_KEYS, "step_id", "fx", "fy").join(density(rows, dc), [*LAYER_KEYS, "step_id"]).withColumn("rank", rank))
    radius = search_radius(dc, outlier_factor)
    # cells of which 3 x 3 hold about PROBE rows, by the rows within dc
    width = dc / MM * F.sqrt(F.lit(PROBE * pi / 9) / (2 * F.col("rho") - 1))
    found = nearest_of_lower_rank(ranked, LAYER_KEYS, ["fx", "fy"], radius, F.floor(2 * F.log2(F.lit(radius) / width)), None if exact else K_CAP)
    out = ranked.join(found, [*LAYER_KEYS, "step_id"], "left").withColumn("found", F.sqrt("d2"))
    fill = F.coalesce(F.max("found").over(W.partitionBy(*LAYER_KEYS)), F.lit(radius))
    return out.select(*LAYER_KEYS, "step_id", "rho", "rank", F.coalesce("found", fill).alias("delta"), "nh")


def classify(peaks: DataFrame, dc: float, rhoc: float, deltac: float | None = None, outlier_factor: float | None = None) -> DataFrame:
    """peaks with kind: seed, outlier or follower."""
    dense = F.col("rho") >= rhoc
    kind = F.when(dense & (F.col("delta") >= (dc if deltac is None else deltac) / MM), "seed")
    if outlier_factor:
        kind = kind.when(~dense & (F.col("delta") >= outlier_factor * dc / MM), "outlier")
    rows = peaks.withColumn("kind", kind.otherwise("follower"))
    layer = W.partitionBy(*LAYER_KEYS)
    seeds = F.count_if(F.col("kind") == "seed").over(layer)
    best = F.row_number().over(layer.orderBy((F.col("kind") == "outlier").cast("int"), F.desc(F.col("rho") * F.col("delta")), "step_id"))
    promoted = (seeds == 0) & (best == 1) & (F.col("kind") != "outlier") & (F.col("rho") * F.col("delta") > 0)
    return rows.withColumn("kind", F.when(promoted, "seed").otherwise(F.col("kind")))


def labels(kinds: DataFrame) -> DataFrame:
    """(LAYER_KEYS, step_id, label)."""
    ptr = F.when(F.col("kind") == "seed", F.col("step_id")).when(F.col("kind") == "follower", F.col("nh"))
    ends = follow(kinds.select(*LAYER_KEYS, F.col("step_id").alias("id"), ptr.alias("ptr")), LAYER_KEYS)
    return ends.select(*LAYER_KEYS, F.col("id").alias("step_id"), F.coalesce("root", F.lit(NOISE)).alias("label"))


def clue(steps: DataFrame, dc: float = 15.3, rhoc: float = 5.0, deltac: float | None = None, outlier_factor: float | None = None, min_points: int = 5, exact: bool = False) -> DataFrame:
    """steps with layer and label."""
    rows = scaled(steps.withColumn("layer", layer_of(F.col("cell_id"))))
    search = (dc, search_radius(dc, outlier_factor), None if exact else K_CAP, min_points)
    small, large = split(rows, LAYER_KEYS)
    found = by_event(small, LAYER_KEYS, lambda table, sizes: labels_within(table, sizes, search, dc, rhoc, deltac, outlier_factor), "label long")
    if large is not None:
        peaks = higher_by_joins(min_group(large, LAYER_KEYS, min_points), dc, outlier_factor, exact)
        own = labels(classify(peaks, dc, rhoc, deltac, outlier_factor))
        found = found.unionByName(large.join(own, [*LAYER_KEYS, "step_id"], "left").withColumn("label", F.coalesce("label", F.lit(NOISE))).select(found.columns))
    return found.drop("fx", "fy")
