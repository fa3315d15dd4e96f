"""What a comparison writes, and what comparisons of the same steps share."""

import pytest

from jobs import compare_settings
from jobs.settings import config
from showerloom.operators import validate
from showerloom.sources.steps import steps_view


@pytest.fixture
def before(spark, small):
    return steps_view(spark, small).where("subdetector = 0 AND event_id <= 3")


def test_a_comparison_writes_one_row_an_event(spark, before, monkeypatch):
    sizes = []
    plain = validate.cut_lineage

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(validate, "cut_lineage", counted)
    rows, kept = validate.prepared(before, before.where("step_id % 2 = 0"))
    events = before.select("event_id").distinct().count()
    assert sizes and max(sizes) <= events
    assert 0 < kept.count() < rows.count()


def test_windows_are_evaluated_once(before):
    """Every quantile beside a row takes two windows, however often its expression names them."""
    placed = before.selectExpr("event_id", "x AS long", "y AS r", "z AS phi", "energy")
    plan = validate.cuts(placed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max(") == 2 * 2 * len(validate.COORDS)


def test_settings_share_the_geometry(spark, small, tmp_path, monkeypatch):
    made = []
    plain = validate.geometry
    monkeypatch.setattr(validate, "geometry", lambda *a, **k: made.append(1) or plain(*a, **k))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.read.parquet(f"{small}/lineitem.parquet").where("l_suppkey <= 3").write.parquet(source)
    settings = config(None, compare_settings.CONFIG)
    grids = [{"name": f"g{mm}", "tool": "grid", "parameters": {"second_stage": "none", "grid_mm": float(mm)}} for mm in (2, 3)]
    compare_settings.run(spark, source, target, settings | {"settings": grids})
    assert len(made) == 1 and spark.read.parquet(target).count() == 8


def test_tasks_go_by_rows_where_an_event_is_sorted(spark, monkeypatch):
    """More rows than the cores' tasks should sort get tasks of their own number, whatever their compressed size; the rows stay the same."""
    from showerloom.operators import select as se

    rows = spark.range(4000).selectExpr("id % 100 AS event_id", "id")
    monkeypatch.setattr(se, "ROWS_PER_TASK", 100)
    got = se.sent_by_event(rows, 4000)
    assert got.rdd.getNumPartitions() == 40
    assert got.groupBy("event_id").agg({"id": "count"}).where("`count(id)` = 40").count() == 100
    assert se.sent_by_event(rows, 100).count() == 4000
