"""Ring search and dense cells against brute force, and how their pairs grow."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerloom.operators import clue, dbscan, graph, neighbors
from showerloom.operators.select import LAYER_KEYS

from .test_operators import brute_dbscan, steps


def brute_higher(points, rank, radius, cap):
    """{i: (j, d2)} by the definition, over rows of one layer."""
    out = {}
    for i, p in enumerate(points):
        near = sorted(((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]), j) for j, q in enumerate(points))
        near = [(d, j) for d, j in near if d < radius * radius][: min(rank[i] + 1, cap) if cap else None]
        for d, j in near if rank[i] > 0 else ():
            if rank[j] < rank[i]:
                out[i] = (j, d)
                break
    return out


def ranked(spark, points, rank):
    rows = [(1, 0, 3, i, float(x), float(y), int(r)) for i, ((x, y), r) in enumerate(zip(points, rank, strict=True))]
    return spark.createDataFrame(rows, "event_id long, subdetector int, layer long, step_id long, fx double, fy double, rank int").withColumn("rank", F.col("rank").cast("int"))


CASES = {
    "gauss": lambda rng: rng.normal(size=(400, 2)) * 3,
    "lattice with ties": lambda rng: rng.integers(0, 12, size=(400, 2)).astype(float),
    "one point": lambda rng: np.zeros((200, 2)),
    "core and halo": lambda rng: np.concatenate([rng.normal(size=(250, 2)) * 0.05, rng.uniform(-20, 20, size=(150, 2))]),
    "few": lambda rng: rng.normal(size=(60, 2)),
}


@pytest.mark.parametrize("cap", [128, 7, None])
@pytest.mark.parametrize("name", CASES)
def test_rings_against_brute_force(spark, name, cap):
    rng = np.random.default_rng(len(name))
    points = CASES[name](rng)
    rank = rng.permutation(len(points))
    level = (F.col("step_id") % 9).cast("double")
    got = neighbors.nearest_of_lower_rank(ranked(spark, points, rank), LAYER_KEYS, ["fx", "fy"], 6.0, level, cap)
    assert {r.step_id: (r.nh, r.d2) for r in got.collect()} == brute_higher(points.tolist(), rank, 6.0, cap)


def test_candidates_grow_with_the_rows(spark, monkeypatch):
    """Ten times the rows on the same area: the density search meets less than 15 times the pairs, all pairs would be 100 times."""
    met = []
    plain = neighbors.ring_pairs

    def counted(*args):
        pairs = plain(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(neighbors, "ring_pairs", counted)
    total = []
    for n in (300, 3000):
        rng = random.Random(n)
        rows = [(1, i, rng.uniform(-40, 40), rng.uniform(-40, 40), 0, 1, 0, 0) for i in range(n)]
        met.clear()
        clue.nearest_higher(clue.features(steps(spark, rows)), 6.0).collect()
        total.append(sum(met))
    assert total[1] < 15 * total[0]


def test_no_seed_among_steps_at_one_point(spark):
    """Every delta is 0: no step is promoted, all stay noise; one step apart is promoted."""
    same = [(1, i, 0, 0, 0, 1, 0, 0) for i in range(6)]
    assert {r.label for r in clue.clue(steps(spark, same), rhoc=100.0).collect()} == {-1}
    got = {r.step_id: r.label for r in clue.clue(steps(spark, [*same, (1, 6, 3, 0, 0, 1, 0, 0)]), rhoc=100.0).collect()}
    assert len(set(got.values())) == 1 and -1 not in got.values()


def dense_layer(rng, n):
    """Three blobs of which two touch through a thin bridge, and a halo."""
    rows = [(rng.gauss(0, 2), rng.gauss(0, 2), rng.gauss(0, 0.3)) for _ in range(n)]
    rows += [(rng.gauss(22, 2), rng.gauss(0, 2), rng.gauss(0, 0.3)) for _ in range(n)]
    rows += [(rng.gauss(0, 1.5), rng.gauss(90, 1.5), rng.gauss(0, 0.3)) for _ in range(n)]
    rows += [(rng.uniform(-60, 60), rng.uniform(-60, 110), rng.uniform(-3, 3)) for _ in range(n // 3)]
    return [(1, i, x, y, 0, 1, t, 0) for i, (x, y, t) in enumerate(rows)]


def test_dense_cells_give_the_same_labels(spark):
    for seed, n in ((1, 60), (2, 150)):
        rows = dense_layer(random.Random(seed), n)
        got = {r.step_id: r.label for r in dbscan.dbscan(steps(spark, rows)).collect()}
        middle = np.median([r[6] for r in rows])
        label = brute_dbscan([(r[2] / 5, r[3] / 5, r[6] - middle) for r in rows], 1.5, 5)
        assert [got[r[1]] for r in rows] == label


def test_cells_that_only_a_corner_joins(spark):
    """Two dense cells whose nearest steps are not those nearest to the other's bounds."""
    eps, w = 1.5, 1.5 / 3**0.5
    a = [(0.1 * w, 0.1 * w, 0), (0.99 * w, 0.02 * w, 0), (0.2 * w, 0.3 * w, 0), (0.3 * w, 0.2 * w, 0), (0.4 * w, 0.9 * w, 0)]
    for shift in np.linspace(0.0, 1.4, 8):
        b = [(x + 2 * w, y + shift * w, 0) for x, y, _ in reversed(a)]
        points = a + b
        rows = [(1, i, x * 5, y * 5, 0, 1, t, 0) for i, (x, y, t) in enumerate(points)]
        got = {r.step_id: r.label for r in dbscan.dbscan(steps(spark, rows), eps=eps).collect()}
        assert [got[i] for i in range(10)] == brute_dbscan([(r[2] / 5, r[3] / 5, r[6]) for r in rows], eps, 5)


def test_dense_cells_make_fewer_pairs(spark, monkeypatch):
    rows = dbscan.features(steps(spark, dense_layer(random.Random(3), 600)))
    every = dbscan.neighbour_pairs(rows).count()
    made = []
    plain = neighbors.range_self_join

    def counted(*args, **kw):
        pairs = plain(*args, **kw)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(dbscan, "range_self_join", counted)
    dbscan.labelled(rows, LAYER_KEYS, 1.5, 5).collect()
    assert sum(made) * 20 < every


def test_forests_join_what_the_edges_join(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(g, rng.randrange(60), rng.randrange(60)) for g in ("a", "b") for _ in range(70)]
    df = spark.createDataFrame(edges, "g string, u long, v long").where("u <> v")
    want = graph_components(edges)
    for block in (5, 1000):
        monkeypatch.setattr(graph, "BLOCK", block)
        thin = graph.forests(df, ["g"])
        assert thin.count() <= df.count()
        assert graph_components([tuple(r) for r in thin.collect()]) == want
        assert {(r.g, r.id): r.root for r in graph.connected_components(df, ["g"], "u", "v").collect()} == want
    pairs = df.select("g", F.struct((F.col("u") % 7).alias("i"), (-F.col("u")).alias("j")).alias("a"), F.struct((F.col("v") % 7).alias("i"), (-F.col("v")).alias("j")).alias("b"))
    got = {(r.g, -r.id.j): r.root for r in graph.connected_components(pairs, ["g"], "a", "b").collect()}
    for (g, x), root in got.items():
        assert (root.i, root.j) == min((y % 7, -y) for (h, y), r in want.items() if h == g and r == want[g, x])
    assert graph.connected_components(df.limit(0), ["g"], "u", "v").count() == 0


def graph_components(edges):
    """{(g, vertex): smallest vertex} by search."""
    near = {}
    for g, a, b in edges:
        if a != b:
            near.setdefault((g, a), set()).add((g, b))
            near.setdefault((g, b), set()).add((g, a))
    out = {}
    for start in sorted(near):
        stack = [start] if start not in out else []
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = start[1]
                stack += near[x]
    return out
