"""The jobs on copies of the given tables: growing input, runs again, and their SQL."""

import pytest
from pyspark.sql import functions as F

from jobs import compare_settings, keep_clouds, queries
from jobs.settings import config, steps_of
from showerloom.operators.grid import grid_cloud


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_matches_sql(spark, small, duck, same, name):
    same(queries.QUERIES[name](spark, small), duck, queries.ORACLE[name])


def points(df):
    """Sums run in another order over other files, so coordinates are rounded."""
    return rows(df.select("event_id", "w_layer", "gi", "gj", "n_steps", *(F.round(c, 6).alias(c) for c in ("x", "y", "z", "energy", "time"))))


def test_growing_input_takes_only_what_is_new(spark, small, tmp_path):
    settings = config(None, keep_clouds.CONFIG) | {"events_per_part": 3}
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.read.parquet(f"{small}/lineitem.parquet")
    full = lambda df: points(grid_cloud(steps_of(df, settings["columns"], settings["where"]), **settings["grid"]))
    stamps = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "out/cloud").rglob("*.parquet")}

    first = table.where("l_suppkey <= 5 AND l_orderkey % 2 = 0")
    first.write.parquet(source)
    (one,) = keep_clouds.run(spark, source, target, settings)
    assert one["steps"] == steps_of(first, settings["columns"], settings["where"]).count() and one["ranges"] == 2
    assert points(spark.read.parquet(f"{target}/cloud")) == full(first)

    before = stamps()
    assert keep_clouds.run(spark, source, target, settings) == []  # nothing new
    assert stamps() == before

    # more steps of two known events, and a new one; events 0 to 2 lie in a range that gets nothing
    more = table.where("l_suppkey IN (3, 4) AND l_orderkey % 2 = 1 OR l_suppkey = 9")
    more.write.mode("append").parquet(source)
    (two,) = keep_clouds.run(spark, source, target, settings)
    assert two["steps"] == steps_of(more, settings["columns"], settings["where"]).count() and two["ranges"] == 2
    assert points(spark.read.parquet(f"{target}/cloud")) == full(first.union(more))
    after = stamps()
    kept = {p for p in before if "part=0" in p}
    assert kept and all(after[p] == before[p] for p in kept)
    events = spark.read.parquet(f"{target}/events").collect()
    assert sorted(r.event_id for r in events) == [0, 1, 2, 3, 4, 5, 9]
    assert all(abs(r.energy_after - r.energy_before) < 1e-6 * r.energy_before for r in events)


def test_a_batch_run_again_replaces_what_it_wrote(spark, small, tmp_path):
    settings = config(None, keep_clouds.CONFIG)
    steps = steps_of(spark.read.parquet(f"{small}/lineitem.parquet").where("l_suppkey <= 2"), settings["columns"], settings["where"])
    target = str(tmp_path)
    once = keep_clouds.add(steps, 0, target, settings)
    want = points(spark.read.parquet(f"{target}/cloud"))
    again = keep_clouds.add(steps, 0, target, settings)
    assert (once["steps"], once["points"], once["ranges"]) == (again["steps"], again["points"], again["ranges"])
    assert points(spark.read.parquet(f"{target}/cloud")) == want
    assert keep_clouds.add(steps.limit(0), 1, target, settings)["points"] == 0  # an empty batch changes nothing
    assert points(spark.read.parquet(f"{target}/cloud")) == want


def test_files_are_taken_in_several_batches(spark, small, tmp_path):
    settings = config(None, keep_clouds.CONFIG) | {"files_per_batch": 1}
    table = spark.read.parquet(f"{small}/lineitem.parquet").where("l_suppkey <= 2")
    table.repartition(2).write.parquet(str(tmp_path / "in"))
    done = keep_clouds.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), settings)
    assert [d["batch"] for d in done] == [0, 1]
    want = grid_cloud(steps_of(table, settings["columns"], settings["where"]), **settings["grid"])
    assert points(spark.read.parquet(str(tmp_path / "out/cloud"))) == points(want)


def test_settings_are_replaced_one_by_one(spark, small, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.read.parquet(f"{small}/lineitem.parquet").where("l_suppkey <= 3").write.parquet(source)
    all_settings = config(None, compare_settings.CONFIG)
    fine = {"name": "grid_1mm", "tool": "grid", "parameters": {"second_stage": "none", "grid_mm": 1.0}}
    with_these = lambda *s: all_settings | {"settings": list(s)}
    done = compare_settings.run(spark, source, target, with_these(all_settings["settings"][0]))
    first = rows(spark.read.parquet(target))
    assert done["grid_3mm"]["events"] == 4 == len(first)
    compare_settings.run(spark, source, target, with_these(fine))  # beside the first
    assert rows(spark.read.parquet(target).where("setting = 'grid_3mm'")) == first
    got = {r.setting: r.n for r in spark.read.parquet(target).groupBy("setting").agg(F.sum("n_after").alias("n")).collect()}
    assert got["grid_1mm"] > got["grid_3mm"]  # a finer grid keeps more points
    count = spark.read.parquet(target).count()
    compare_settings.run(spark, source, target, with_these(fine))
    assert spark.read.parquet(target).count() == count


def test_settings_that_are_not_set_stay(spark, small, tmp_path):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    settings = config(None, keep_clouds.CONFIG)
    keep_clouds.run(spark, f"{small}/lineitem.parquet", str(tmp_path), settings)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
