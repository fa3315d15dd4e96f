"""Compression on a grid in the shower's own axis frame, with optional merging of cells.

Per event: the energy-weighted principal axis of the energetic steps, pseudo-layers along it
(Freedman-Diaconis width, clamped), square cells across it.  Merging joins neighbouring occupied
cells of a pseudo-layer whose energies stand out of their local median and are alike, or that hold
enough hits together, and takes connected components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import bin_of, dot, minus
from ..functions.stats import clamped, covariance, fd_of, fd_width_of_numbered, staged, weighted_mean, with_axis, with_basis
from .graph import connected_components, cut_lineage
from .quantiles import numbered, picked, picked_beside
from .select import sent_by_event, with_event

PARAMS = {"grid_mm": 3.0, "fd_min": 2.0, "fd_max": 10.0, "axis_quantile": 0.7, "second_stage": "ccl4", "bridge_energy_factor": 0.6, "similarity_ratio": 0.5, "bridge_min_hits": None}
SIDES = ((0, 1), (1, 0))
CORNERS = ((1, 1), (1, -1))
CELL = ["event_id", "w_layer", "i", "j"]


def energetic(steps: DataFrame, quantile: float = 0.7) -> DataFrame:
    """Steps at or above their event's energy quantile; all steps of events with fewer than 5."""
    alone = numbered(steps.select("event_id", "energy"), ["event_id"], ["energy"])
    bar = cut_lineage(alone.groupBy("event_id").agg(picked("energy", quantile).alias("bar"), F.count("*").alias("n")))
    return with_event(steps, bar).where("n < 5 OR energy >= bar").drop("bar", "n")


def frames(steps: DataFrame, quantile: float = 0.7) -> DataFrame:
    """(event_id, cx, cy, cz, ax, ay, az)."""
    return with_axis(covariance(energetic(steps, quantile), ["event_id"])).select("event_id", "cx", "cy", "cz", "ax", "ay", "az")


def projected(steps: DataFrame, frame: DataFrame) -> DataFrame:
    """steps with w along the axis and u, v across it."""
    rows = with_event(steps, cut_lineage(with_basis(frame)))
    rel = minus(tuple(F.col(k) for k in "xyz"), tuple(F.col(f"c{k}") for k in "xyz"))
    along = {n: dot(rel, tuple(F.col(f"{p}{k}") for k in "xyz")) for n, p in (("w", "a"), ("u", "b1"), ("v", "b2"))}
    return rows.select(*steps.columns, *(c.alias(n) for n, c in along.items()))


def layer_widths(rows: DataFrame, low: float = 2.0, high: float = 10.0) -> DataFrame:
    """(event_id, raw_width, w_width) from projected steps; raw_width is null where undefined."""
    ranked = numbered(rows.select("event_id", "w"), ["event_id"], ["w"])
    return ranked.groupBy("event_id").agg(fd_width_of_numbered("w").alias("raw_width")).withColumn("w_width", clamped(F.col("raw_width"), low, high))


def celled(steps: DataFrame, grid_mm: float = 3.0, fd_min: float = 2.0, fd_max: float = 10.0, axis_quantile: float = 0.7) -> DataFrame:
    """steps with w_layer and cell i, j.

    The axis of each event is small and written once.  Steps are then sent by event, one time: its width, and whatever
    is made of its cells, is found where they lie.
    """
    rows = projected(sent_by_event(steps, steps.count()), frames(steps, axis_quantile))
    rows = picked_beside(numbered(rows, ["event_id"], ["w"]), ["event_id"], {"_q1": ("w", 0.25), "_q3": ("w", 0.75)})
    rows = rows.withColumn("_sd", F.stddev_pop("w").over(W.partitionBy("event_id")))
    rows = staged(rows, {"w_width": clamped(fd_of(F.col("_q3") - F.col("_q1"), F.col("_sd"), F.col("_n_w")), fd_min, fd_max)})
    return rows.select(*steps.columns, bin_of(F.col("w"), F.col("w_width")).alias("w_layer"), *(bin_of(F.col(c), F.lit(grid_mm)).alias(n) for c, n in (("u", "i"), ("v", "j"))))


def cells(rows: DataFrame) -> DataFrame:
    """(CELL, energy, hits)."""
    return rows.groupBy(*CELL).agg(F.sum("energy").alias("energy"), F.count("*").alias("hits"))


def offsets(stage: str) -> tuple[tuple[int, int], ...]:
    """Half of the neighbourhood; the other half is its mirror image."""
    return SIDES if stage == "ccl4" else SIDES + CORNERS


def beside(occupied: DataFrame, sides: tuple[tuple[int, int], ...], carry: list[str], both: bool) -> DataFrame:
    """occupied cells with _next{n} (and _last{n}): carry of the occupied cell at the n-th of sides, and at its mirror image; null where there is none.

    Along each direction a pseudo-layer's cells are sorted, and neighbours follow each other: nothing is joined or repeated.
    """
    line = {(0, 1): ("i", "j"), (1, 0): ("j", "i"), (1, 1): (F.col("i") - F.col("j"), "i"), (1, -1): (F.col("i") + F.col("j"), "i")}
    told = F.struct("i", "j", *carry)
    for n, (a, b) in enumerate(sides):
        order = W.partitionBy("event_id", "w_layer").orderBy(*line[a, b])
        ways = {f"_next{n}": (F.lead(told), a, b)} | ({f"_last{n}": (F.lag(told), -a, -b)} if both else {})
        occupied = occupied.withColumns({c: f.over(order) for c, (f, _, _) in ways.items()})
        there = {c: F.when((F.col(f"{c}.i") == F.col("i") + di) & (F.col(f"{c}.j") == F.col("j") + dj), F.col(c)) for c, (_, di, dj) in ways.items()}
        occupied = occupied.withColumns(there)
    return occupied


def local_medians(occupied: DataFrame, stage: str) -> DataFrame:
    """occupied with med: the median energy over a cell and its occupied neighbours."""
    names = occupied.columns
    known = occupied.where(" AND ".join(f"{c} IS NOT NULL" for c in CELL))
    sides = offsets(stage)
    around = [F.col("energy"), *(F.col(f"{w}{n}.energy") for n in range(len(sides)) for w in ("_next", "_last"))]
    there = sum((e.isNotNull().cast("int") for e in around), F.lit(0))
    rows = staged(beside(known, sides, ["energy"], True), {"_e": F.sort_array(F.array(*around)), "_n": there})  # nulls come first
    at = lambda k: F.get("_e", F.lit(len(around)) - F.col("_n") + k.cast("int"))
    rows = staged(rows, {"_low": at(F.floor((F.col("_n") - 1) / 2)), "_high": at(F.floor(F.col("_n") / 2))})
    return staged(rows, {"med": F.when(F.col("_n") > 0, F.col("_low") * 0.5 + F.col("_high") * 0.5)}).select(*names, "med")


def cell_edges(occupied: DataFrame, stage: str = "ccl4", bridge_energy_factor: float = 0.6, similarity_ratio: float = 0.5, bridge_min_hits: int | None = None) -> DataFrame:
    """(event_id, w_layer, i, j, ni, nj): accepted neighbour pairs, each once."""
    stands = F.col("energy") >= F.lit(bridge_energy_factor) * F.greatest(F.col("med"), F.lit(1e-12))
    ready = staged(local_medians(occupied, stage), {"stands": F.coalesce(stands, F.lit(False))}).select(*CELL, "energy", "hits", "stands")
    if bridge_min_hits is None:
        ready = ready.where("stands")  # both ends of a pair must
    sides = offsets(stage)

    def accepted(o):
        gate = F.col("stands") & o["stands"] & (F.least(F.col("energy"), o["energy"]) >= F.lit(similarity_ratio) * F.greatest(F.col("energy"), o["energy"]))
        return gate if bridge_min_hits is None else gate | (F.col("hits") + o["hits"] >= bridge_min_hits)

    rows = beside(ready, sides, ["energy", "hits", "stands"], False)
    ends = [F.when(F.col(o).isNotNull() & accepted(F.col(o)), F.struct(F.col(f"{o}.i").alias("ni"), F.col(f"{o}.j").alias("nj"))) for o in (f"_next{n}" for n in range(len(sides)))]
    return rows.select(*CELL, F.explode(F.array(*ends)).alias("e")).where("e IS NOT NULL").select(*CELL, "e.ni", "e.nj")


def grouped(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows of cells with gi, gj: the smallest cell of their cell's component.

    Cells that are not their own group are sent to the rows of their event and stand beside them in a window of the
    cell, so rows that were sent by event stay where they are.  Rows without a cell are left out.
    """
    links = edges.select("event_id", "w_layer", F.struct("i", "j").alias("a"), F.struct(F.col("ni").alias("i"), F.col("nj").alias("j")).alias("b"))
    moved = connected_components(links, ["event_id", "w_layer"], "a", "b").where("id <> root")
    moved = moved.select("event_id", "w_layer", F.col("id.i").alias("i"), F.col("id.j").alias("j"), "root").repartition("event_id")
    known = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in CELL))
    both = known.withColumns({"_root": F.lit(None).cast(moved.schema["root"].dataType), "_row": F.lit(True)})
    both = both.unionByName(moved.withColumnsRenamed({"root": "_root"}).withColumn("_row", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_root", F.max("_root").over(W.partitionBy(*CELL))).where("_row")
    return both.select(*rows.columns, *(F.coalesce(F.col(f"_root.{c}"), F.col(c)).alias(f"g{c}") for c in "ij"))


def grid_cloud(steps: DataFrame, second_stage: str = "ccl4", grid_mm: float = 3.0, fd_min: float = 2.0, fd_max: float = 10.0, axis_quantile: float = 0.7, **gate) -> DataFrame:
    """One point per cell group: event_id, w_layer, gi, gj, x, y, z, energy, time, n_steps, subdetector 0."""
    rows = celled(steps, grid_mm, fd_min, fd_max, axis_quantile)
    if second_stage == "none":
        rows = rows.withColumns({"gi": F.col("i"), "gj": F.col("j")})
    else:
        rows = grouped(rows.select(*CELL, *"xyz", "energy", "time"), cell_edges(cells(rows), second_stage, **gate))
    points = rows.groupBy("event_id", "w_layer", "gi", "gj").agg(*(weighted_mean(c, "energy").alias(c) for c in "xyz"), F.sum("energy").alias("energy"), F.min("time").alias("time"), F.count("*").alias("n_steps"))
    return points.withColumn("subdetector", F.lit(0))
