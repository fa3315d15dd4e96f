"""A Python data source for HDF5 groups `steps`; used only where h5py is installed.

A scan is split into spans of at most ROWS rows, which arrive as Arrow batches; columns that a file lacks
are null.  Filters on event_id (with ``spark.sql.python.filterPushdown.enabled``) narrow the spans:
in a file sorted by event, those outside the wanted events are not opened.  The group
`metadata/subdetector_names` is read by ``names``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

ROWS = 1_000_000
SCHEMA = pa.schema([("event_id", pa.int64()), ("step_id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("energy", pa.float64()), ("time", pa.float64()), ("subdetector", pa.int32()), ("cell_id", pa.int64()), ("pdg", pa.int32())])


class Span(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Hdf5Steps(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hdf5_steps"

    def schema(self) -> str:
        return "event_id long, step_id long, x double, y double, z double, energy double, time double, subdetector int, cell_id long, pdg int"

    def reader(self, schema) -> DataSourceReader:
        return Hdf5Reader(self.options["path"])


def names(path: str) -> dict[int, str]:
    """Names of the subdetectors by their number; none where the file has no such table."""
    import h5py

    with h5py.File(path) as f:
        if "metadata/subdetector_names" not in f:
            return {}
        return {i: n.decode() if isinstance(n, bytes) else str(n) for i, n in enumerate(f["metadata/subdetector_names"][:])}


class Hdf5Reader(DataSourceReader):
    def __init__(self, path: str, rows: int = ROWS):
        self.path, self.rows = path, rows
        self.low, self.high = -(2**63), 2**63 - 1

    def pushFilters(self, filters):
        """Takes note of the bounds of event_id; Spark applies every filter again, for a span may hold other events too."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("event_id",) and value not in (None, ()) and (not isinstance(value, tuple) or None not in value):
                low, high = {
                    EqualTo: lambda v: (v, v), In: lambda v: (min(v), max(v)), GreaterThan: lambda v: (v + 1, self.high), GreaterThanOrEqual: lambda v: (v, self.high),
                    LessThan: lambda v: (self.low, v - 1), LessThanOrEqual: lambda v: (self.low, v),
                }.get(type(f), lambda v: (self.low, self.high))(value)
                self.low, self.high = max(self.low, low), min(self.high, high)
            yield f

    def partitions(self):
        """Spans whose first and last event do not rule the wanted ones out; event ids are read a span at a time."""
        import h5py

        out = []
        with h5py.File(self.path) as f:
            event = f["steps/event_id"]
            n = len(event)
            for first in range(0, n, self.rows):
                last = min(first + self.rows, n)
                if (self.low, self.high) == (-(2**63), 2**63 - 1):
                    out.append(Span(first, last))
                    continue
                ids = event[first:last]
                if len(ids) and ids.max() >= self.low and ids.min() <= self.high:
                    hit = ((ids >= self.low) & (ids <= self.high)).nonzero()[0]
                    if len(hit):
                        out.append(Span(first + int(hit[0]), first + int(hit[-1]) + 1))
        return out

    def read(self, span: Span):
        import h5py
        import numpy as np

        with h5py.File(self.path) as f:
            g, at = f["steps"], slice(span.first, span.last)
            n = span.last - span.first
            xyz = g["position"][at].astype(float)
            given = {"step_id": np.arange(span.first, span.last), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}
            columns = []
            for field in SCHEMA:
                if field.name in given:
                    column = pa.array(given[field.name], field.type)
                elif field.name not in g:
                    column = pa.nulls(n, field.type)
                elif field.name == "cell_id":  # the 64 bits are kept, the highest becomes the sign
                    column = pa.array(g["cell_id"][at].astype(np.uint64).view(np.int64))
                else:
                    column = pa.array(g[field.name][at].astype(field.type.to_pandas_dtype()), field.type)
                columns.append(column)
            yield pa.record_batch(columns, schema=SCHEMA)
