"""The HDF5 source through a stand-in for h5py: a dictionary of arrays that notes what is read."""

import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from showerloom.sources import hdf5


class Noted(np.ndarray):
    """An array that notes the bounds of what is taken from it."""

    def __getitem__(self, at):
        if isinstance(at, slice) and hasattr(self, "log"):
            self.log.append((self.path, at.start or 0, len(self) if at.stop is None else at.stop))
        return np.asarray(self)[at]


@pytest.fixture
def stand_in(monkeypatch):
    rng = np.random.default_rng(2)
    n = 100
    data = {
        "event_id": np.repeat(np.arange(10, dtype="i4"), 10), "position": rng.normal(size=(n, 3)).astype("f4"), "energy": rng.random(n).astype("f4"),
        "time": rng.random(n).astype("f4"), "subdetector": (np.arange(n) % 2).astype("u1"), "cell_id": np.arange(n, dtype="u8") + (1 << 63),
    }
    log: list = []
    groups: dict = {}
    for name, values in data.items():
        a = values.view(Noted)
        a.log, a.path = log, name
        groups[name] = a

    class File(dict):
        def __init__(self, path):
            super().__init__({"steps": groups, **{f"steps/{k}": v for k, v in groups.items()}, "metadata/subdetector_names": np.array([b"barrel", b"endcap"])})

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    monkeypatch.setitem(sys.modules, "h5py", SimpleNamespace(File=File))
    return SimpleNamespace(data=data, log=log)


def table(reader):
    return pa.Table.from_batches([b for s in reader.partitions() for b in reader.read(s)], hdf5.SCHEMA)


def test_batches_hold_every_row(stand_in):
    got = table(hdf5.Hdf5Reader("x", rows=30))
    assert got.num_rows == 100 and got["step_id"].to_pylist() == list(range(100))
    assert got["event_id"].to_pylist() == stand_in.data["event_id"].tolist()
    assert np.array_equal(np.column_stack([got[c] for c in "xyz"]), stand_in.data["position"].astype(float))
    assert got["cell_id"].to_pylist() == [i - (1 << 63) for i in range(100)]
    assert got["pdg"].null_count == 100 and got["subdetector"].to_pylist() == [i % 2 for i in range(100)]
    assert hdf5.names("x") == {0: "barrel", 1: "endcap"}


@pytest.mark.parametrize(("filters", "events"), [([EqualTo(("event_id",), 4)], [4]), ([In(("event_id",), (2, 3))], [2, 3]), ([GreaterThanOrEqual(("event_id",), 7), LessThan(("event_id",), 9)], [7, 8]), ([EqualTo(("event_id",), 77)], [])])
def test_only_spans_of_the_wanted_events_are_opened(stand_in, filters, events):
    reader = hdf5.Hdf5Reader("x", rows=30)
    assert list(reader.pushFilters(filters)) == filters  # Spark checks them again
    spans = reader.partitions()
    stand_in.log.clear()
    got = pa.Table.from_batches([b for s in spans for b in reader.read(s)], hdf5.SCHEMA)
    assert sorted(set(got["event_id"].to_pylist())) == events and got.num_rows == 10 * len(events)
    assert all(10 * min(events) <= a and b <= 10 * max(events) + 10 for _, a, b in stand_in.log)


def test_other_filters_narrow_nothing(stand_in):
    reader = hdf5.Hdf5Reader("x")
    list(reader.pushFilters([EqualTo(("energy",), 1.0)]))
    assert table(reader).num_rows == 100


def test_spark_takes_the_batches(spark, stand_in):
    got = spark.createDataFrame(table(hdf5.Hdf5Reader("x")))
    assert got.schema.simpleString() == f"struct<{','.join(f.strip().replace(' ', ':').replace('long', 'bigint') for f in hdf5.Hdf5Steps({}).schema().split(','))}>"
