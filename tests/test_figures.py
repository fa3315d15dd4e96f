"""Figures of a side as arrays against the windows, and how often the job goes through the steps."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobs import compare_settings
from jobs.settings import config
from showerloom.operators import blocks, clue, dbscan, figures, validate

from .test_operators import steps


def odd_steps(spark):
    """Events with ties, one without energy, one with energies that aren't known, one of a single step."""
    rng = random.Random(4)
    rows = [(event, i, 3 * rng.randrange(6), 3 * rng.randrange(6), 5 * rng.randrange(8), rng.choice((0.0, 0.5, 2.0)), 0, 0) for event in (1, 2, 3, 4) for i in range(60)]
    df = steps(spark, [*rows, (5, 0, 1, 1, 1, 1, 0, 0)])
    energy = F.when(F.col("event_id") == 2, 0.0).when((F.col("event_id") == 3) & (F.col("step_id") % 4 == 0), F.lit(None)).otherwise(F.col("energy"))
    return df.withColumn("energy", energy.cast("double"))


@pytest.mark.parametrize("whole", [40, 7])
def test_arrays_tell_what_windows_tell(spark, monkeypatch, whole):
    df = odd_steps(spark)
    told = validate.geometry(df.where("energy IS NOT NULL"))
    monkeypatch.setattr(figures, "ROWS", whole)
    got = {r.event_id: r.asDict() for r in figures.side_figures(df, told, 1000).collect()}
    monkeypatch.setattr(figures, "WHOLE_EVENT", 10)  # all but the single step by windows
    want = {r.event_id: r.asDict() for r in figures.side_figures(df, told, 1000).collect()}
    assert set(got) == set(want) == {1, 2, 3, 4, 5}
    for event, row in got.items():
        for name, value in row.items():
            assert value == want[event][name] or abs(value - want[event][name]) < 1e-9, (event, name)
    assert got[2]["r50"] is None and got[2]["total"] == 0 and got[3]["n"] == 60


def test_steps_are_gone_through_once_for_all_settings(spark, small, tmp_path, monkeypatch):
    """What is told of the steps doesn't depend on a setting."""
    source = str(tmp_path / "in")
    spark.read.parquet(f"{small}/lineitem.parquet").where("l_suppkey <= 1").write.parquet(source)
    grid = config(None, compare_settings.CONFIG)
    grid["settings"] = [grid["settings"][0] | {"name": n} for n in "ab"]
    placed, plain = [], validate.about
    monkeypatch.setattr(validate, "about", lambda rows, keep: placed.append(keep) or plain(rows, keep))
    compare_settings.run(spark, source, str(tmp_path / "out"), grid)
    # once for the cuts, once for the steps' figures, once for each cloud
    assert len(placed) == 4
    a, b = ([r[:-1] for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("setting") == n).orderBy("event_id").collect()] for n in "ab")
    assert a == b and len(a) == 2


def test_a_call_takes_many_events(spark, tmp_path):
    df = steps(spark, [(event, i, i, 0, 0, 1, 0, 0) for event in range(30) for i in range(6)]).withColumn("layer", F.lit(0)).coalesce(1)

    def sizes(table, n):
        return [pa.array([len(n)] * table.num_rows)]

    calls = blocks.by_event(df, ["event_id", "layer"], sizes, "together long").agg(F.sum(1 / F.col("together")).alias("calls"), F.count("*").alias("n")).first()
    assert calls.n == 180 and calls.calls < 6 * 30 / 2


def test_lines_of_any_size_give_the_same_labels(monkeypatch):
    """Layers of one step up to many, padded together or apart."""
    rng = random.Random(7)
    n = [1, 2, 3, 40, 7, 7, 90, 1, 5]
    total = sum(n)
    table = pa.table({"fx": [rng.uniform(-3, 3) for _ in range(total)], "fy": [rng.uniform(-3, 3) for _ in range(total)], "ft": [0.0] * total, "step_id": [i for k in n for i in range(k)]})
    found = []
    for cells in (1, 500, 10**6):
        monkeypatch.setattr(blocks, "CELLS", cells)
        sizes = blocks.np.array(n)
        found.append([x.tolist() for cap in (128, None) for x in (*dbscan.labels_within(table, sizes, 0.8, 4), *clue.labels_within(table, sizes, (4.0, 20.0, cap, 5), 4.0, 2.0, None, None))])
    assert found[0] == found[1] == found[2] and {-1} < set(found[0][0])
