"""The command lines from a stored table to stored results, and formulas against plain numbers."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerloom import tools
from showerloom.functions.stats import fd_width, weighted_mean, with_axis
from showerloom.operators import grid, validate
from showerloom.operators.reduce import point_cloud
from showerloom.sources.steps import described, ensure_columns, read_steps, run_params, steps_view, subdetector_names

from .test_operators import cloud_of, steps


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tools") / "steps.parquet")
    rows = cloud_of(random.Random(4), 120) + [(2, i, *r[2:]) for i, r in enumerate(cloud_of(random.Random(5), 80))]
    steps(spark, rows).write.parquet(path)
    return path


def energy(df):
    return df.agg(F.sum("energy")).first()[0]


@pytest.mark.parametrize("argv", [["dbscan"], ["dbscan", "--adaptive", "--n-events", "1"], ["clue", "--dc", "6", "--rhoc", "3"], ["grid"], ["grid", "--second-stage", "none", "--n-events", "1"]])
def test_clouds_from_the_command_line(spark, stored, tmp_path, capsys, argv):
    out = tools.main([argv[0], stored, "--output", str(tmp_path / "cloud"), *argv[1:]], spark)
    cloud, before = spark.read.parquet(out), spark.read.parquet(stored)
    assert "n_before" in capsys.readouterr().out
    told = run_params(cloud).first()
    assert told.units == "mm, MeV, ns" and json.loads(told.cluster_params)["algorithm"].startswith(argv[0]) and told.n_rows == cloud.count()
    assert {r.event_id for r in cloud.select("event_id").distinct().collect()} == ({1} if "--n-events" in argv else {1, 2})
    whole = before.where("event_id = 1") if "--n-events" in argv else before
    assert math.isclose(energy(cloud), energy(whole)) if argv[0] == "grid" else 0 < energy(cloud) <= energy(whole) + 1e-9


def test_compare_and_view_from_the_command_line(spark, stored, tmp_path):
    cloud = tools.main(["grid", stored, "--output", str(tmp_path / "cloud")], spark)
    out = tools.main(["validate", stored, cloud, "--output", str(tmp_path / "v")], spark)
    report = {r.quantity: r for r in spark.read.parquet(f"{out}/report").collect()}
    assert math.isclose(report["closure"].mean, 1) and {"f_keep_before", "f_keep_after", "r50", "w90"} <= set(report)
    edges = spark.read.parquet(f"{out}/edges").where("observable = 'r' AND event_id = 1").orderBy("bin").collect()
    assert len(edges) == validate.R_BINS and all(math.isclose(a.hi, b.lo) for a, b in zip(edges, edges[1:], strict=False))
    view = tools.main(["view", stored, cloud, "--event", "2", "--output", str(tmp_path / "w")], spark)
    assert {r.axis for r in spark.read.parquet(f"{view}/config").collect()} == {"x", "y", "z"}
    assert {r.side for r in spark.read.parquet(f"{view}/points").select("side").distinct().collect()} == {"before", "after"}


def test_input_checks(spark, stored, tmp_path):
    with pytest.raises(SystemExit):
        tools.main(["dbscan", stored, "--eps", "0"], spark)
    for low, high in ((0.5, 0.5), (0.9, 0.1)):
        with pytest.raises(ValueError, match="quantiles"):
            tools.main(["validate", stored, stored, "--qlo", str(low), "--qhi", str(high), "--output", str(tmp_path / "x")], spark)
    other = str(tmp_path / "other.parquet")
    steps(spark, [(77, 0, 0, 0, 0, 1, 0, 0)]).write.parquet(other)
    with pytest.raises(ValueError, match="common"):
        tools.main(["validate", stored, other, "--output", str(tmp_path / "x")], spark)
    with pytest.raises(ValueError, match="event 5"):
        tools.main(["view", stored, stored, "--event", "5", "--output", str(tmp_path / "x")], spark)
    spark.read.parquet(stored).drop("cell_id").write.parquet(str(tmp_path / "flat.parquet"))
    with pytest.raises(ValueError, match="cell_id"):
        tools.main(["dbscan", str(tmp_path / "flat.parquet")], spark)


@pytest.mark.parametrize(("tool", "column"), [("dbscan", "time"), ("dbscan", "subdetector"), ("clue", "subdetector"), ("grid", "time")])
def test_missing_columns_are_told(spark, stored, tmp_path, tool, column):
    """A table without time would cluster to noise alone."""
    spark.read.parquet(stored).drop(column).write.parquet(str(tmp_path / "less"))
    with pytest.raises(ValueError, match=column):
        tools.main([tool, str(tmp_path / "less"), "--output", str(tmp_path / "out")], spark)


def test_paths_are_looked_at_first(spark, stored, tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        tools.main(["dbscan", str(tmp_path / "nothing.parquet")], spark)
    out = tools.main(["grid", stored, "--output", str(tmp_path / "cloud"), "--n-events", "all"], spark)
    monkeypatch.setattr(tools, "read_steps", lambda *a, **k: pytest.fail("work was begun"))
    for tool in ("grid", "dbscan", "clue"):
        with pytest.raises(FileExistsError):
            tools.main([tool, stored, "--output", out], spark)


def test_names_tell_the_events(spark, stored):
    names = [tools.target(spark, tools.parser().parse_args(["grid", stored, *a]), "grid", {"grid_mm": 3.0}) for a in ([], ["--n-events", "3"], ["--n-events", "all"])]
    assert names == ["steps_grid_grid_mm3_n100.parquet", "steps_grid_grid_mm3_n3.parquet", "steps_grid_grid_mm3.parquet"]


def test_no_outliers_where_the_factor_is_0(spark, stored, tmp_path):
    a, b = (spark.read.parquet(tools.main(["clue", stored, "--output", str(tmp_path / str(i)), *x], spark)) for i, x in enumerate(([], ["--outlier-factor", "0"])))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_view_keeps_what_has_no_energy(spark, tmp_path):
    rows = [(3, 0, 0, 0, 0, 0, 0, 0), (3, 1, 5, 5, 5, 2, 0, 0), (3, 2, 9, 9, 9, -1, 0, 0), (7, 0, 1, 1, 1, 1, 0, 0)]
    before, after = str(tmp_path / "b"), str(tmp_path / "a")
    steps(spark, rows).write.parquet(before)
    steps(spark, rows[1:3]).withColumn("subdetector", F.lit(1)).write.parquet(after)
    view = tools.main(["view", before, after, "--output", str(tmp_path / "w")], spark)  # event 3 is the first on both sides
    points = spark.read.parquet(f"{view}/points").collect()
    assert sorted((r.event_id, r.side, r.x) for r in points) == [(3, "after", 5.0), (3, "after", 9.0), (3, "before", 0.0), (3, "before", 5.0), (3, "before", 9.0)]
    one = tools.main(["view", before, after, "--subdetector", "0", "--output", str(tmp_path / "one")], spark)  # one side is empty
    assert {r.side for r in spark.read.parquet(f"{one}/points").collect()} == {"before"}
    with pytest.raises(ValueError, match="subdetector 5"):
        tools.main(["view", before, after, "--subdetector", "5", "--output", str(tmp_path / "none")], spark)
    with pytest.raises(ValueError, match="both sides"):
        tools.main(["view", before, after, "--event", "7", "--output", str(tmp_path / "none")], spark)


def test_compare_all_subdetectors(spark, stored, tmp_path):
    both = spark.read.parquet(stored)
    both.unionByName(both.withColumns({"subdetector": F.lit(1), "step_id": F.col("step_id") + 1000})).write.parquet(str(tmp_path / "b"))
    counts = {}
    for name, extra in (("ecal", []), ("all", ["--no-ecal-only"])):
        out = tools.main(["validate", str(tmp_path / "b"), str(tmp_path / "b"), "--output", str(tmp_path / name), *extra], spark)
        counts[name] = spark.read.parquet(f"{out}/histograms").where("observable = 'log_energy'").agg(F.sum("value")).first()[0]
    assert counts["all"] > 1.5 * counts["ecal"]


def test_names_and_units_survive_the_tools(spark, stored, tmp_path):
    named = described(spark.read.parquet(stored), names={0: "barrel", 4: "other"})
    named.write.parquet(str(tmp_path / "in"))
    assert read_steps(spark, str(tmp_path / "in")).schema["event_id"].metadata["subdetector_names"] == {"0": "barrel", "4": "other"}
    cloud = spark.read.parquet(tools.main(["grid", str(tmp_path / "in"), "--output", str(tmp_path / "out")], spark))
    assert [(r.subdetector, r.name, r.n_rows) for r in subdetector_names(cloud).collect()] == [(0, "barrel", cloud.count())]
    assert cloud.schema["energy"].metadata == {"unit": "MeV"} and cloud.schema["time"].metadata == {"unit": "ns"}


def test_steps_without_numbers_are_numbered_by_their_values(spark):
    rows = [(1, float(i), 0.0, 0.0, 1.0 + i) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id int, x double, y double, z double, energy double")
    number = lambda d: {r.x: r.step_id for r in ensure_columns(d).collect()}
    assert number(df) == number(df.repartition(5, "x")) == {float(i): i + 1 for i in range(6)}


@pytest.mark.parametrize("values", [[0.0] * 8 + [10.0], [1.0, 2.0, 4.0, 8.0, 16.0], [3.0], [2.0, 2.0, 2.0], [5.0, 9.0]])
def test_width_against_plain_numbers(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "w double").agg(fd_width("w").alias("x")).first().x
    iqr = np.subtract(*np.percentile(values, [75, 25]))
    spread = iqr if iqr > 0 else np.std(values)
    if len(values) < 2 or spread == 0:
        assert got is None
    else:
        assert math.isclose(got, 2 * spread / len(values) ** (1 / 3))


def test_equal_coordinates_are_their_own_mean(spark):
    y, e = -26.12196864, 0.0372
    r = spark.createDataFrame([(y, e), (y, 3 * e), (y, 0.7 * e)], "v double, w double").agg(weighted_mean("v", "w").alias("m")).first()
    assert r.m == y


def test_axis_of_two_equal_eigenvalues_lies_among_them(spark):
    s = {"sxx": 4.0, "sxy": 0.0, "sxz": 0.0, "syy": 4.0, "syz": 0.0, "szz": 1.0}
    r = with_axis(spark.createDataFrame([(1, 9, *s.values())], ["event_id", "n", *s])).first()
    assert math.isclose(r.ax**2 + r.ay**2 + r.az**2, 1) and abs(r.az) < 1e-6


def test_clusters_are_pure(spark):
    """A point never mixes events, subdetectors or layers: its steps and energy are those of its own keys."""
    rows = steps(spark, cloud_of(random.Random(6), 100) + [(2, i, *r[2:]) for i, r in enumerate(cloud_of(random.Random(6), 100))])
    labelled = rows.withColumns({"layer": F.expr("CAST(cell_id >> 19 AS INT)"), "label": F.lit(7)})
    got = {(r.event_id, r.layer): (r.n_steps, r.energy) for r in point_cloud(labelled, ["event_id", "subdetector", "layer"], ["label"]).collect()}
    want = {(r.event_id, r.layer): (r.n, r.e) for r in labelled.groupBy("event_id", "layer").agg(F.count("*").alias("n"), F.sum("energy").alias("e")).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in got)


def test_bins_do_not_depend_on_partitions(spark):
    """Rows at the edges of cuts and bins stay there however the sums are split."""
    found = []
    for n in (1, 200):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            rows = steps_view(spark, "/root/testdata/sf0.001").where("subdetector = 0 AND event_id <= 3")
            rows = rows.repartition(n % 7 + 1, "step_id")
            cloud = grid.grid_cloud(rows, "none").selectExpr("*", "row_number() OVER (PARTITION BY event_id ORDER BY w_layer, gi, gj) AS step_id")
            _, kept = validate.prepared(rows, cloud)
            found.append(sorted((r.event_id, r.side, r.observable, r.bin, round(r.value, 6)) for r in validate.histograms(kept).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert found[0] == found[1]
