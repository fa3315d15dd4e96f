"""Neighbouring cells and cell groups against brute force, and how often rows are sent."""

import random
import statistics

import pytest

from showerloom.operators import grid
from showerloom.operators.quantiles import numbered, picked
from pyspark.sql import functions as F


def some_cells(spark, n=300):
    rnd = random.Random(3)
    places = {(e, w, rnd.randrange(-6, 6), rnd.randrange(-6, 6)) for e in (1, 2) for w in (0, 1) for _ in range(n // 4)}
    rows = [(*p, None if k == 5 else rnd.choice([0.5, 1.0, 1.0, 1.1, rnd.random()]), rnd.randrange(1, 5)) for k, p in enumerate(sorted(places))]
    return rows, spark.createDataFrame(rows, "event_id long, w_layer long, i long, j long, energy double, hits long")


def sent(df):
    """Exchanges of df's plan but those of whole small tables."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("stage", ["ccl4", "ccl8"])
@pytest.mark.parametrize("hits", [None, 6])
def test_edges_and_medians_are_those_of_all_pairs(spark, stage, hits):
    rows, df = some_cells(spark)
    energy, count = {r[:4]: r[4] for r in rows}, {r[:4]: r[5] for r in rows}
    half = grid.offsets(stage)
    around = [(0, 0), *half, *((-a, -b) for a, b in half)]
    near = lambda p, o: (p[0], p[1], p[2] + o[0], p[3] + o[1])
    seen = {p: [energy[near(p, o)] for o in around if energy.get(near(p, o)) is not None] for p in energy}
    med = {p: statistics.median(v) if v else None for p, v in seen.items()}
    assert {tuple(r)[:4]: r.med for r in grid.local_medians(df, stage).select(*grid.CELL, "med").collect()} == pytest.approx(med)
    strong = {p for p in energy if energy[p] is not None and energy[p] >= 0.6 * max(med[p], 1e-12)}
    want = set()
    for p in energy:
        for q in (near(p, o) for o in half):
            alike = {p, q} <= strong and min(energy[p], energy[q]) >= 0.5 * max(energy[p], energy[q])
            if q in energy and (alike or hits and count[p] + count[q] >= hits):
                want.add((*p, *q[2:]))
    got = [tuple(r) for r in grid.cell_edges(df, stage, bridge_min_hits=hits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cells_of_an_event_are_sent_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        _, df = some_cells(spark)
        assert sent(grid.cell_edges(df.repartition("event_id"), "ccl8")) == 1
        rows = df.selectExpr("event_id", "i + 0.5D AS x", "j + 0.5D AS y", "w_layer + 0.5D AS z", "energy", "hits AS time").repartition(3)
        assert sent(grid.cell_edges(grid.cells(grid.celled(rows)), "ccl8")) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_numbered_quantiles_are_those_of_percentile(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice([None, rnd.random(), 0.25])) for k in range(4) for _ in range(k * 7)] + [(9, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    points = (0.0, 0.01, 0.3, 0.7, 1.0)
    want = {tuple(r) for r in df.groupBy("k").agg(*(F.percentile("v", q) for q in points)).collect()}
    assert {tuple(r) for r in numbered(df, ["k"], ["v"]).groupBy("k").agg(*(picked("v", q) for q in points)).collect()} == want
