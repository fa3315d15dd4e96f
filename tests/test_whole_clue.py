"""Registered density-peak queries look at every step within the search radius: brute force over layers of few and of many steps."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerloom.plans import reference
from showerloom.sources.steps import steps_view


@pytest.fixture(scope="module")
def at(spark, small, tmp_path_factory):
    """Three events, one of which has layers of more steps than pass as arrays and than the 128 nearest."""
    folder = str(tmp_path_factory.mktemp("whole"))
    key = F.when(F.col("l_suppkey") < 7, F.lit(0)).otherwise(F.col("l_suppkey")).cast("long")
    spark.read.parquet(f"{small}/lineitem.parquet").withColumn("l_suppkey", key).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def layers(spark, at):
    """{(event, subdetector, layer): (step_ids, places)} of at least 5 steps, by step_id."""
    rows = defaultdict(list)
    for r in steps_view(spark, at).collect():
        rows[r.event_id, r.subdetector, (r.cell_id >> 19) & 511].append((r.step_id, r.x / 5, r.y / 5))
    return {k: (np.array([x[0] for x in sorted(v)]), np.array([x[1:] for x in sorted(v)])) for k, v in rows.items() if len(v) >= 5}


def peaks(points, dc, radius):
    """rho, nh (-1: none), delta: the nearest of all steps of smaller rank strictly within the radius."""
    gap = points[:, None] - points
    d2 = gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1]
    n = len(points)
    rho = 1 + 0.5 * ((d2 <= dc * dc).sum(1) - 1)
    rank = np.empty(n, int)
    rank[np.lexsort([np.arange(n), -rho])] = np.arange(n)
    able = np.where((rank[None, :] < rank[:, None]) & (d2 < radius * radius), d2, np.inf)
    nh = np.where(np.isfinite(able.min(1)), able.argmin(1), -1)
    found = np.sqrt(able.min(1))
    most = found[nh >= 0].max(initial=-1.0)
    return rho, nh, np.where(nh >= 0, found, radius if most < 0 else most)


def kinds(rho, delta, rhoc, deltac, factor=None, dc=None):
    out = np.where((rho >= rhoc) & (delta >= deltac), "seed", "follower").astype(object)
    if factor:
        out[(rho < rhoc) & (delta >= factor * dc)] = "outlier"
    free = np.flatnonzero(out != "outlier")
    if not (out == "seed").any() and len(free):
        best = free[np.argmax((rho * delta)[free])]
        out[best] = "seed" if rho[best] * delta[best] > 0 else out[best]
    return out


def ends(kind, nh):
    """Place of the first seed along nearest-higher steps, -1 for none."""
    out = []
    for i in range(len(nh)):
        while i >= 0 and kind[i] == "follower":
            i = nh[i]
        out.append(i if i >= 0 and kind[i] == "seed" else -1)
    return out


def test_clue_cloud_counts_all_steps_of_a_cluster(spark, at):
    want = {}
    for key, (ids, points) in layers(spark, at).items():
        rho, nh, delta = peaks(points, 15.3 / 5, 5.0 * 15.3 / 5)
        for end in ends(kinds(rho, delta, 5.0, 15.3 / 5), nh):
            if end >= 0:
                want[*key, ids[end]] = want.get((*key, ids[end]), 0) + 1
    assert {(r.event_id, r.subdetector, r.layer, r.label): r.n_steps for r in reference.QUERIES["clue_cloud"](spark, at).collect()} == want


def test_clue_delta_nh_looks_beyond_the_nearest(spark, at):
    want = {}
    for (event, *_), (ids, points) in layers(spark, at).items():
        _, nh, delta = peaks(points, 15.3 / 5, 5.0 * 15.3 / 5)
        want |= {(event, i): (ids[j] if j >= 0 else -1, np.floor(d * 1e4 + 0.5) / 1e4) for i, j, d in zip(ids, nh, delta, strict=True)}
    got = {(r.event_id, r.step_id): (r.nh, r.delta) for r in reference.QUERIES["clue_delta_nh"](spark, at).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(v[1] - want[k][1]) < 1.01e-4 for k, v in got.items())


def kinds_of(spark, at, dc, rhoc, factor=None):
    out = {}
    for (event, *_), (ids, points) in layers(spark, at).items():
        rho, _, delta = peaks(points, dc, (factor or 5.0) * dc)
        out |= {(event, i): k for i, k in zip(ids, kinds(rho, delta, rhoc, dc, factor, dc), strict=True)}
    return out


def test_clue_outlier_types_by_all_steps(spark, at):
    got = {(r.event_id, r.step_id): r.kind for r in reference.QUERIES["clue_outlier_types"](spark, at).collect()}
    assert got == kinds_of(spark, at, 1.0, 3.0, 2.0)


def test_clue_types_by_all_steps(spark, at):
    got = {(r.event_id, r.step_id): r.kind for r in reference.QUERIES["clue_types"](spark, at).collect()}
    assert got == kinds_of(spark, at, 15.3 / 5, 5.0)


def test_validate_clue_compares_with_the_whole_clusters(spark, at, monkeypatch):
    """The comparison's cloud is that of clusters by all steps: its points and their steps in the barrel."""
    taken = []
    plain = reference.va.prepared
    monkeypatch.setattr(reference.va, "prepared", lambda rows, cloud: taken.append(cloud) or plain(rows, cloud))
    reference.QUERIES["validate_clue"](spark, at)
    own = [(key, *peaks(points, 15.3 / 5, 5.0 * 15.3 / 5)) for key, (_, points) in layers(spark, at).items() if key[1] == 0]
    sizes = []
    for key, rho, nh, delta in own:
        end = np.array(ends(kinds(rho, delta, 5.0, 15.3 / 5), nh))
        sizes += [(key[0], key[2], n) for n in np.unique(end[end >= 0], return_counts=True)[1]]
    assert sorted((r.event_id, r.layer, r.n_steps) for r in taken[0].collect()) == sorted(sizes)
