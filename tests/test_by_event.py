"""Tables stored by event: same rows and figures, without exchanges."""

import re

import pytest
from pyspark.sql import functions as F

from showerloom import tools
from showerloom.operators import grid, select, validate
from showerloom.operators.reduce import point_cloud
from showerloom.sources.by_event import read_by_event, store_by_event
from showerloom.sources.steps import read_steps, steps_view


@pytest.fixture(scope="module")
def tables(spark, small, tmp_path_factory):
    at = tmp_path_factory.mktemp("by_event")
    rows = select.ecal_only(steps_view(spark, small))
    after = rows.groupBy("event_id", F.pmod("step_id", F.lit(7)).alias("k")).agg(F.min("step_id").alias("step_id"), *(F.avg(c).alias(c) for c in "xyz"), F.sum("energy").alias("energy")).where("event_id % 5 <> 1").drop("k")
    for df, name in ((rows, "before"), (after, "after")):
        df.write.parquet(str(at / f"{name}.parquet"))
        store_by_event(spark.read.parquet(str(at / f"{name}.parquet")), str(at / name), 4)
    return at


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|single|round)", plan(df)))


def test_rows_and_metadata_stay(spark, tables):
    plain, by_event = (read_steps(spark, str(tables / n)) for n in ("before.parquet", "before"))
    assert by_event.columns == plain.columns and by_event.exceptAll(plain).isEmpty() and plain.count() == by_event.count()
    assert by_event.schema["x"].metadata["unit"] == "mm" and not spark.catalog.listTables()


def test_sums_and_joins_by_event_need_no_exchange(spark, tables):
    before, after = (read_by_event(spark, str(tables / n)) for n in ("before", "after"))
    closure = validate.closure_by_event(before, after)
    common = select.common_events(before, after)
    cloud = point_cloud(before.withColumn("label", F.col("pdg")), ["event_id", "subdetector"], ["label"])
    assert [shuffles(df) for df in (closure, common, cloud)] == [0, 0, 0]
    plain = [spark.read.parquet(str(tables / f"{n}.parquet")) for n in ("before", "after")]
    assert shuffles(validate.closure_by_event(*plain)) > 0
    want = {r.event_id: r.closure for r in validate.energy_closure(validate.both_sides(*plain)).collect()}
    got = {r.event_id: r.closure for r in closure.collect()}
    assert got == pytest.approx(want, rel=1e-12) and 0 < len(got) == common.count() < plain[0].select("event_id").distinct().count()


def test_one_event_is_one_bucket(spark, tables):
    before = read_by_event(spark, str(tables / "before"))
    event = before.agg(F.max("event_id")).first()[0]
    picked = before.where(F.col("event_id") == event)
    counted = plan(picked.groupBy("event_id").count())
    assert "SelectedBucketsCount: 1 out of 4" in counted and f"EqualTo(event_id,{event})" in counted
    plain = spark.read.parquet(str(tables / "before.parquet")).where(F.col("event_id") == event)
    assert picked.count() == plain.count() > 0 and picked.exceptAll(plain).isEmpty()


def test_store_from_the_command_line_and_reruns(spark, tables, tmp_path):
    out = tools.main(["store", str(tables / "before.parquet"), "--output", str(tmp_path / "s"), "--buckets", "3"], spark)
    cloud = tools.main(["grid", out, "--n-events", "2", "--output", str(tmp_path / "cloud")], spark)
    want = grid.grid_cloud(select.grid_scan(read_steps(spark, str(tables / "before.parquet")), 2), **grid.PARAMS)
    assert spark.read.parquet(cloud).count() == want.count() > 0
    with pytest.raises(FileExistsError):
        tools.main(["store", str(tables / "before.parquet"), "--output", out], spark)
    with pytest.raises(ValueError, match="bucket"):
        tools.main(["store", str(tables / "before.parquet"), "--output", str(tmp_path / "t"), "--buckets", "0"], spark)


def test_empty_table(spark, tables, tmp_path):
    store_by_event(read_steps(spark, str(tables / "before.parquet")).limit(0), str(tmp_path / "none"), 2)
    none = read_by_event(spark, str(tmp_path / "none"))
    assert none.count() == 0 and validate.closure_by_event(none, none).count() == 0
