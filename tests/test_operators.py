"""Hand-made cases and brute force for the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerloom.functions.stats import covariance, histogram_bin, weighted_quantiles, with_axis
from showerloom.operators import clue, dbscan, grid, validate
from showerloom.operators.graph import connected_components, follow
from showerloom.operators.neighbors import range_self_join
from showerloom.operators.reduce import point_cloud
from showerloom.operators.select import first_n_events, one_event
from showerloom.sources.steps import SCHEMA, ensure_columns, output_name, read_steps, write_cloud


def steps(spark, rows):
    """rows: (event, step, x, y, z, energy, time, layer)."""
    return spark.createDataFrame([(e, s, float(x), float(y), float(z), float(en), float(t), 0, lay << 19, 22) for e, s, x, y, z, en, t, lay in rows], SCHEMA)


def cloud_of(rng, n, layers=2):
    return [(1, i, rng.gauss(0, 8), rng.gauss(0, 8), rng.uniform(0, 40), rng.uniform(0.1, 5), rng.uniform(0, 3), i % layers) for i in range(n)]


def brute_dbscan(points, eps, least):
    n = len(points)
    near = [[j for j in range(n) if sum((a - b) ** 2 for a, b in zip(points[i], points[j], strict=True)) <= eps * eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    label = [-1] * n
    for i in range(n):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = i
                    stack += [k for k in near[j] if core[k] and label[k] < 0]
    for i in range(n):
        if not core[i]:
            label[i] = min((label[j] for j in near[i] if core[j]), default=-1)
    return label


def test_dbscan_against_brute_force(spark):
    rows = cloud_of(random.Random(1), 120)
    got = {r.step_id: r.label for r in dbscan.dbscan(steps(spark, rows)).collect()}
    for layer in (0, 1):
        own = [r for r in rows if r[7] == layer]
        middle = np.median([r[6] for r in own])
        label = brute_dbscan([(r[2] / 5, r[3] / 5, r[6] - middle) for r in own], 1.5, 5)
        assert [got[r[1]] for r in own] == [own[k][1] if k >= 0 else -1 for k in label]


def test_border_goes_to_smallest_core(spark):
    left = [(1, i, -6.0 - i / 10, 0, 0, 1, 0, 0) for i in range(6)]
    right = [(1, 10 + i, 6.0 + i / 10, 0, 0, 1, 0, 0) for i in range(6)]
    got = {r.step_id: r.label for r in dbscan.dbscan(steps(spark, [*left, *right, (1, 99, 0, 0, 0, 1, 0, 0)]), eps=1.21).collect()}
    assert got[99] == 0 and got[3] == 0 and got[12] == 10


def test_small_layer_is_noise(spark):
    rows = [(1, i, 0, 0, 0, 1, 0, 0) for i in range(4)]
    assert {r.label for r in dbscan.dbscan(steps(spark, rows)).collect()} == {-1}
    assert {r.label for r in clue.clue(steps(spark, rows)).collect()} == {-1}


def test_adaptive_labels_sit_on_their_steps(spark):
    core = [(1, 2 * i, i / 10, 0, 0, 10, 0, 0) for i in range(8)]
    far = [(1, 2 * i + 1, 100 + i / 10, 0, 0, 0.1, 0, 0) for i in range(6)]
    got = {r.step_id: r.label for r in dbscan.dbscan_adaptive(steps(spark, core + far)).collect()}
    assert len({got[r[1]] for r in core} - {-1}) == 1 and {got[r[1]] for r in far}.isdisjoint({got[r[1]] for r in core} - {-1})


def test_clue_matches_definition(spark):
    rows = cloud_of(random.Random(3), 90, 1)
    kinds = clue.classify(clue.nearest_higher(clue.features(steps(spark, rows)), 6.0), 6.0, 3.0).collect()
    p = np.array([(r[2] / 5, r[3] / 5) for r in rows])
    d = np.sqrt(((p[:, None] - p) ** 2).sum(-1))
    rho = 1 + 0.5 * ((d <= 1.2).sum(1) - 1)
    rank = {i: k for k, i in enumerate(sorted(range(90), key=lambda i: (-rho[i], i)))}
    for r in kinds:
        i = r.step_id
        assert r.rho == rho[i] and r.rank == rank[i]
        near = sorted((d[i, j], j) for j in range(90) if d[i, j] < 6.0)[: min(rank[i] + 1, 128)]
        higher = [(x, j) for x, j in near if rank[j] < rank[i]]
        assert r.nh == (higher[0][1] if higher and rank[i] else None)


def test_follow_ends_and_losses(spark):
    rows = [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, None), (1, 6, 5), (1, 7, 6)]
    got = {r.id: r.root for r in follow(spark.createDataFrame(rows, "k int, id int, ptr int"), ["k"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: None, 6: None, 7: None}


def test_components_of_a_path(spark):
    ids = list(range(60))
    random.Random(4).shuffle(ids)
    e = spark.createDataFrame([(1, a, b) for a, b in zip(ids, ids[1:], strict=False)] + [(2, 5, 9)], "k int, a int, b int")
    got = {(r.k, r.id): r.root for r in connected_components(e, ["k"], "a", "b").collect()}
    assert got == {(1, i): 0 for i in ids} | {(2, 5): 5, (2, 9): 5}


def test_range_join_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i % 2, i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(80)]
    got = {(r.id, r.other_id) for r in range_self_join(spark.createDataFrame(rows, "k int, id int, x double, y double"), ["k"], ["x", "y"], 2.0, ["id"]).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 4}


def test_axis_against_eigh(spark):
    rng = np.random.default_rng(6)
    p, e = rng.normal(size=(50, 3)) * (1, 2, 9), rng.uniform(0.1, 2, 50)
    df = spark.createDataFrame([(1, *map(float, q), float(w)) for q, w in zip(p, e, strict=True)], "event_id int, x double, y double, z double, energy double")
    r = with_axis(covariance(df, ["event_id"])).first()
    c = np.average(p, axis=0, weights=e)
    vec = np.linalg.eigh(((p - c) * (e / e.sum())[:, None]).T @ (p - c))[1][:, 2]
    assert abs(abs(vec @ [r.ax, r.ay, r.az]) - 1) < 1e-9 and r.ax + r.ay + r.az >= 0


@pytest.mark.parametrize("rows", [[(1, 3.0, 4.0, 5.0, 1.0)], [(1, 0.0, 0.0, 0.0, 0.0)] * 3])
def test_axis_without_direction_is_z(spark, rows):
    r = with_axis(covariance(spark.createDataFrame(rows, "event_id int, x double, y double, z double, energy double"), ["event_id"])).first()
    assert (r.ax, r.ay, r.az) == (0, 0, 1)


def test_weighted_quantile_against_interp(spark):
    rng = np.random.default_rng(7)
    v, w = rng.normal(size=40), rng.uniform(0.1, 1, 40)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, w, strict=True))] + [(2, 0, 1.0, 0.0)], "k int, step_id int, v double, w double")
    got = {r.k: r for r in weighted_quantiles(df, ["k"], "v", "w", {"a": 0.001, "b": 0.5, "c": 0.9}).collect()}
    o = np.argsort(v)
    want = np.interp([0.001, 0.5, 0.9], np.cumsum(w[o]) / w.sum(), v[o])
    assert np.allclose([got[1].a, got[1].b, got[1].c], want) and got[2].b is None


def test_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (-0.1,)], "v double")
    assert [r[0] for r in df.select(histogram_bin(F.col("v"), F.lit(0.0), F.lit(1.0), 4)).collect()] == [0, 3, None, None]


@pytest.mark.parametrize("stage", ["none", "ccl4", "ccl8"])
def test_grid_keeps_energy(spark, stage):
    rows = steps(spark, cloud_of(random.Random(8), 150, 1))
    got = grid.grid_cloud(rows, stage).agg(F.sum("energy").alias("e"), F.sum("n_steps").alias("n")).first()
    assert math.isclose(got.e, rows.agg(F.sum("energy")).first()[0]) and got.n == 150


def test_validation_of_itself(spark):
    rows = steps(spark, cloud_of(random.Random(9), 80, 1))
    all_rows, kept = validate.prepared(rows, rows)
    assert math.isclose(validate.energy_closure(all_rows).first().closure, 1)
    assert all(abs(r.delta) < 1e-12 for r in validate.containment_delta(validate.containment(kept)).collect())


def test_zero_energy_cluster_takes_plain_mean(spark):
    rows = steps(spark, [(1, i, i, 0, 0, 0, 5 - i, 0) for i in range(3)]).withColumns({"layer": F.lit(0), "label": F.lit(7)})
    r = point_cloud(rows, ["event_id", "subdetector", "layer"], ["label"]).first()
    assert (r.x, r.energy, r.time, r.pdg) == (1.0, 0.0, 3.0, 0)


def test_selection_and_sources(spark, tmp_path):
    rows = steps(spark, [(e, i, 0, 0, 0, 1, 0, 0) for e in (5, 2, 9) for i in range(2)])
    assert {r.event_id for r in first_n_events(rows, 2).collect()} == {2, 5}
    with pytest.raises(ValueError):
        one_event(rows, 3)
    write_cloud(rows, str(tmp_path / "cloud"), {"eps": 1.5})
    assert read_steps(spark, str(tmp_path / "cloud")).count() == 6
    nested = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0.5)], "event_id int, position array<float>, energy float")
    r = ensure_columns(nested).first()
    assert (r.x, r.y, r.z, r.subdetector, r.pdg) == (1, 2, 3, 0, 0)
    with pytest.raises(ValueError):
        ensure_columns(nested.drop("energy"))
    assert output_name("/a/in.parquet", "dbscan", eps=1.5, n=None) == "in_dbscan_eps1.5.parquet"
