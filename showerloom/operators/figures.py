"""One side of a comparison in one pass: sums and containment of whole events as arrays.

Rows that stand beside their event's geometry are sent by event once, sorted by it, and taken as Arrow
batches of whole events; windows would sort every row once for each observable.  Events
of more than WHOLE_EVENT steps keep to the windows of ``validate``, which spill.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import validate as va
from .blocks import ROWS, whole_groups
from .graph import cut_lineage
from .select import sent_by_event, with_event

#: steps of an event that is held whole
WHOLE_EVENT = 500_000
QUANTILES = {"r50": ("r", 0.5), "r80": ("r", 0.8), "r90": ("r", 0.9), "w10": ("long", 0.1), "w50": ("long", 0.5), "w90": ("long", 0.9)}


def starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)


def reached(value: np.ndarray, energy: np.ndarray, known: np.ndarray, at: np.ndarray, shares: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(quantile, whether there is none) of each group that begins at `at`, for each share; rows by group, value and step.

    As ``weighted_quantiles`` has it: sums leave out energies that are not known, and NaN is above all numbers.
    """
    n = len(value)
    sums = lambda x: np.concatenate([np.cumsum(part) for part in np.split(x, at[1:])])
    run, begun = sums(np.where(known, energy, 0.0)), sums(known) > 0
    size = np.diff(np.append(at, n))
    total = np.repeat(run[at + size - 1], size)
    with np.errstate(all="ignore"):
        c = run / total
        told = begun & ((total > 0) | np.isnan(total))
        before = np.arange(n) - 1
        alone = np.zeros(n, bool)
        alone[at] = True
        alone |= ~told[before]
        out = []
        for q in shares:
            first = np.minimum.reduceat(np.where(told & ((c >= q) | (c == 1.0) | np.isnan(c)), np.arange(n), n), at)
            none = first == n
            i = np.where(none, 0, first)
            b = before[i]
            between = value[b] + (q - c[b]) * (value[i] - value[b]) / (c[i] - c[b])
            out.append((np.where(alone[i] | (c[i] <= c[b]), value[i], between), none))
    return out


def of_events(table: pa.Table) -> pa.Table:
    """(event_id, n, total, inside, QUANTILES) of whole events (event_id, step_id, energy, r, long, kept)."""
    flat = lambda c: table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c]
    ids = table["event_id"].to_numpy()
    first = starts(ids)
    e = table["energy"].to_numpy()
    known = pc.is_valid(table["energy"]).to_numpy()
    sums = lambda x: np.add.reduceat(x, first)
    kept = pc.fill_null(table["kept"], False).to_numpy()
    mass = np.where(known, e, 0.0)
    out = [
        flat("event_id").take(pa.array(first)),
        pa.array(sums(pc.is_valid(table["step_id"]).to_numpy().astype(np.int64))),
        pa.array(sums(mass), mask=sums(known.astype(np.int64)) == 0),
        pa.array(sums(np.where(kept, mass, 0.0))),
    ]
    event = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    rows = np.flatnonzero(kept)
    at = starts(event[rows])
    found: dict[str, pa.Array] = {}
    for c in ("r", "long"):
        names = [n for n, (of, _) in QUANTILES.items() if of == c]
        value = table[c].to_numpy()
        order = rows[np.lexsort([table["step_id"].to_numpy()[rows], value[rows], event[rows]])]
        quantiles = reached(value[order], e[order], known[order], at, [QUANTILES[n][1] for n in names]) if len(rows) else []
        for name, (q, none) in zip(names, quantiles, strict=False):
            wide, no = np.zeros(len(first)), np.ones(len(first), bool)
            wide[event[rows][at]], no[event[rows][at]] = q, none
            found[name] = pa.array(wide, mask=no)
    out += [found.get(n, pa.nulls(len(first), pa.float64())) for n in QUANTILES]
    return pa.Table.from_arrays(out, names=["event_id", "n", "total", "inside", *QUANTILES])


def by_arrays(rows: DataFrame, n: int) -> DataFrame:
    added = ["n long", "total double", "inside double", *(f"{q} double" for q in QUANTILES)]
    schema = T.StructType([rows.schema["event_id"], *T._parse_datatype_string(", ".join(added)).fields])

    def run(batches):
        for table in whole_groups(batches, "event_id", ROWS):
            yield from of_events(table).to_batches()

    return sent_by_event(rows, n).sortWithinPartitions("event_id").mapInArrow(run, schema)


def by_windows(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("event_id").agg(F.count("step_id").alias("n"), F.sum("energy").alias("total"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("energy"))), F.lit(0.0)).alias("inside"))
    quantiles = va.containment(rows.where("kept").withColumn("side", F.lit(va.BEFORE))).drop("side")
    return sums.join(quantiles, "event_id", "left")


def side_figures(rows: DataFrame, told: DataFrame, n: int) -> DataFrame:
    """(event_id, n, total, inside, QUANTILES) of a table's events that are told of: rows, their energy, the part inside the cuts, and containment.

    rows: event_id, step_id, x, y, z, energy; told: BEFORE's ``geometry``; n: how many rows there are, at most.
    """
    def placed(events):
        return va.placed(rows.select("event_id", "step_id", *"xyz", "energy"), events).select("event_id", "step_id", "energy", "r", "long", "kept")

    small = by_arrays(placed(told.where(F.col("steps") <= WHOLE_EVENT)), n)
    large = told.where(F.col("steps") > WHOLE_EVENT)
    return small if large.isEmpty() else small.unionByName(by_windows(placed(cut_lineage(large))))
