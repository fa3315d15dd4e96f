import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerloom.operators import blocks, clue, dbscan, graph, select, validate
from showerloom.operators.select import LAYER_KEYS

from .test_operators import brute_dbscan, cloud_of, steps


def lattice(rng, n, layers):
    """Steps with many equal distances, dealt over events and layers."""
    return [(1 + i % 3, i, 4 * rng.randrange(9), 4 * rng.randrange(9), 0, rng.uniform(0, 5), rng.randrange(2), i % layers) for i in range(n)]


def no_join(*args, **kw):
    raise AssertionError("a layer of few steps was joined with itself")


def test_small_layers_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(dbscan, "range_self_join", no_join)
    monkeypatch.setattr(clue, "range_self_join", no_join)
    df = steps(spark, cloud_of(random.Random(1), 200))
    for f in (dbscan.dbscan, dbscan.dbscan_adaptive, clue.clue):
        out = f(df)
        assert out.count() == 200 and set(out.columns) == {*df.columns, "layer", "label"}


@pytest.mark.parametrize("whole", [256, 30, 0])
def test_labels_whatever_the_limit(spark, monkeypatch, whole):
    """Layers of 25 to 50 steps: all in blocks, some, none."""
    rng = random.Random(whole)
    rows = [*lattice(rng, 150, 2), *((9, i, rng.gauss(0, 8), rng.gauss(0, 8), 0, 1, rng.uniform(0, 3), 0) for i in range(50))]
    monkeypatch.setattr(blocks, "WHOLE", whole)
    monkeypatch.setattr(blocks, "PAIRS", 900)
    df = steps(spark, rows)
    got = {(r.event_id, r.step_id): r.label for r in dbscan.dbscan(df).collect()}
    for event, layer in {(r[0], r[7]) for r in rows}:
        own = [r for r in rows if (r[0], r[7]) == (event, layer)]
        middle = np.median([r[6] for r in own])
        label = brute_dbscan([(r[2] / 5, r[3] / 5, r[6] - middle) for r in own], 1.5, 5)
        assert [got[event, r[1]] for r in own] == [own[k][1] if k >= 0 else -1 for k in label]


@pytest.mark.parametrize("kw", [{}, {"exact": True}, {"rhoc": 3.0, "outlier_factor": 2.0, "dc": 5.0}, {"rhoc": 99.0}, {"dc": 6.0, "rhoc": 2.0, "min_points": 40}])
def test_density_peaks_in_blocks_as_by_joins(spark, monkeypatch, kw):
    rng = random.Random(5)
    df = steps(spark, [*lattice(rng, 160, 2), *((9, i, rng.gauss(0, 8), rng.gauss(0, 8), 0, 1, 0, 0) for i in range(200))])
    take = lambda: sorted((r.event_id, r.layer, r.step_id, r.label) for r in clue.clue(df, **kw).collect())
    search = (kw.get("dc", 15.3), kw.get("outlier_factor"), kw.get("exact", False))
    peaks = lambda: sorted(map(repr, clue.nearest_higher(clue.features(df), *search).collect()))
    got = take(), peaks()
    monkeypatch.setattr(blocks, "WHOLE", 0)
    assert got == (take(), peaks())


def test_steps_without_place_are_noise(spark):
    rows = steps(spark, [(1, i, 0, 0, 0, 1, 0, 0) for i in range(16)])
    odd = rows.withColumn("x", F.when(F.col("step_id") < 8, F.col("x")).when(F.col("step_id") < 12, F.lit(float("nan"))))
    for f in (dbscan.dbscan, lambda df: clue.clue(df, dc=5.0, rhoc=2.0, deltac=0.0)):
        got = {r.step_id: r.label for r in f(odd).collect()}
        assert len(got) == 16 and {got[i] for i in range(8, 16)} == {-1} and -1 not in {got[i] for i in range(8)}


def test_an_empty_table_has_no_labels(spark):
    none = steps(spark, [(1, 0, 0, 0, 0, 1, 0, 0)]).limit(0)
    for f in (dbscan.dbscan, dbscan.dbscan_adaptive, clue.clue):
        assert f(none).count() == 0
    assert blocks.split(none.withColumn("layer", F.lit(1)), LAYER_KEYS)[1] is None


def test_adaptive_in_blocks_as_by_joins(spark, monkeypatch):
    rng = random.Random(8)
    far = [(9, 200 + i, rng.gauss(5, 1) + 9, rng.gauss(0, 3), 0, 0.2, rng.uniform(0, 1), 0) for i in range(50)]
    rows = [*lattice(rng, 150, 2), *far, *((9, i, rng.gauss(0, 2), rng.gauss(0, 2), 0, 2, rng.uniform(0, 1), 0) for i in range(60))]
    take = lambda: sorted((r.event_id, r.step_id, r.label) for r in dbscan.dbscan_adaptive(steps(spark, rows), eps=2.5, min_samples=4).collect())
    got = take()
    monkeypatch.setattr(blocks, "WHOLE", 0)
    assert got == take() and len({x[2] for x in got}) > 3


def exchanged(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_stay_beside_a_table_of_events(spark, monkeypatch):
    """Rows are not sent to meet what is known of their event; beyond the bound they are, with the same result."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.range(400).select((F.col("id") % 7).alias("event_id"), "id")
    known = graph.cut_lineage(rows.groupBy("event_id").agg(F.max("id").alias("most")))
    near = select.with_event(rows, known)
    assert exchanged(near) == 0
    monkeypatch.setattr(select, "BROADCAST_EVENTS", 3)
    far = select.with_event(rows, known)
    assert exchanged(far) == 2 and sorted(near.collect()) == sorted(far.collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_step_tables_of_a_comparison_are_sent_once_for_both_quantiles(spark):
    rows = steps(spark, cloud_of(random.Random(2), 60)).withColumns({"side": F.lit("before"), "r": F.col("x"), "long": F.col("z")})
    plan = validate.containment(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(event_id" in plan and "observable" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
