"""Small groups without joins: the rows of an event come together once and small layers are settled where they lie.

Steps are shuffled by event for their numbers, windows and layers alike; a join of steps with themselves would
send them two times more for every look.  Groups of at most WHOLE rows therefore pass as arrays, PAIRS pairs at a
time; larger groups are left to the joins of ``neighbors`` and ``dbscan``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import columns_of, cut_lineage

#: rows of a group that passes whole, pairs of a call, and pairs that are held at a time (which stay in a core's cache)
WHOLE, PAIRS, CELLS = 256, 1_000_000, 32_000
#: rows of whole events that are held at a time, at least
ROWS = 50_000


def split(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """rows of groups of at most WHOLE rows, and those of all others (None without any); groups with null keys are others."""
    unknown = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    others = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > WHOLE) | unknown).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))))
    if others.isEmpty():
        return rows, None
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return rows.join(others, same, "left_anti"), rows.join(others, same, "left_semi")


def by_event(rows: DataFrame, keys: list[str], f: Callable, added: str) -> DataFrame:
    """rows with the columns `added` that f (columns by name, sizes of groups) gives for whole groups, which follow each other, sorted by step_id.

    Rows are sent by the first key and sorted by it; a call of f for each event would cost more than its pairs.
    """
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(added).fields])
    new = [s.name for s in schema.fields[len(rows.columns) :]]

    def run(batches):
        for table in whole_groups(batches, keys[0], ROWS):
            parts = [c for k in reversed(keys) for c in columns_of(flat(table, k), False)]
            table = table.take(pa.array(np.lexsort([table["step_id"].to_numpy(), *parts])))
            codes = [c for k in keys for c in columns_of(flat(table, k), False)]
            start = np.ones(table.num_rows, bool)
            start[1:] = np.any([c[1:] != c[:-1] for c in codes], 0)
            sizes = np.diff(np.append(np.flatnonzero(start), table.num_rows))
            found = [f(part, n) for part, n in pieces(table, sizes)]
            for i, c in enumerate(new):
                table = table.append_column(c, pa.chunked_array([pa.array(*x[i]) if isinstance(x[i], tuple) else pa.array(x[i]) for x in found]))
            yield from table.to_batches()

    return rows.repartition(keys[0]).sortWithinPartitions(keys[0]).mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows (but the last) that end with a group; batches: rows sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table[key].to_numpy()
            others = np.flatnonzero(ids != ids[-1])
            if len(others):
                yield table.slice(0, others[-1] + 1)
                table = table.slice(others[-1] + 1)
            held = table.to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def flat(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table[name].chunks)


def pieces(table: pa.Table, sizes: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups with at most about PAIRS pairs at a time."""
    part = np.cumsum(sizes * sizes) // PAIRS
    ends = np.cumsum(sizes)
    for chosen in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
        first = ends[chosen[0]] - sizes[chosen[0]]
        yield table.slice(first, ends[chosen[-1]] - first), sizes[chosen]


def matrices(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, own): places of the rows of groups of like size, one group a line, and which of them are not padding; at most about CELLS pairs of a line's rows at a time.

    Pairs of a line are told by shifting axes, so no pair is gathered from the columns.
    """
    first, order = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        wide = sizes[order[at:]].astype(np.int64)
        fits = np.flatnonzero(np.arange(1, len(wide) + 1) * wide * wide <= CELLS)
        chosen = order[at : at + max(1, len(fits))]
        own = np.arange(sizes[chosen[-1]]) < sizes[chosen, None]
        yield np.where(own, first[chosen, None] + np.arange(own.shape[1]), 0), own
        at += len(chosen)


def apart(columns: list[np.ndarray], rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of each line; nan, which is near to nothing, where a coordinate is missing and in the padding."""
    values = (np.where(own, c[rows], np.nan) for c in columns)
    return reduce(lambda a, b: a + b, ((v[:, :, None] - v[:, None, :]) ** 2 for v in values))
