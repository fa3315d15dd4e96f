"""The jobs as registered queries: each runs twice into one new folder and returns its output, with SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import compare_settings, keep_clouds
from jobs.settings import config
from showerloom.operators.graph import shared_folder
from showerloom.plans.oracle import with_ctes
from showerloom.plans.reference import near, r, rounded, rs


def twice(job, spark: SparkSession, sf_dir: str) -> str:
    """The folder into which the job has run two times."""
    at = f"{shared_folder(spark)}/{job.__name__.rsplit('.', 1)[-1]}-{uuid.uuid4().hex}"
    for _ in range(2):
        job.run(spark, f"{sf_dir}/lineitem.parquet", at, config(None, job.CONFIG))
    return at


def job1_keep_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point with the totals of its event."""
    at = twice(keep_clouds, spark, sf_dir)
    events = spark.read.parquet(f"{at}/events").select("event_id", F.col("n_steps").alias("event_steps"), F.col("n_points").alias("event_points"), near(F.try_divide("energy_after", "energy_before")).alias("closure"))
    cloud = rounded(spark.read.parquet(f"{at}/cloud"), [F.col("part").cast("long").alias("part"), "event_id", "w_layer", "gi", "gj", "n_steps"], ["x", "y", "z", "energy", "time"])
    return cloud.join(events, "event_id")


def job2_compare_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(twice(compare_settings, spark, sf_dir))
    counts = ["setting", "event_id", "n_before", "n_after"]
    return rounded(out, counts, [c for c in out.columns if c not in counts])


def _events(setting: str, prefix: str) -> str:
    """Rows of one setting from the validation's relations with this prefix."""
    side = lambda c, s: f"max(CASE WHEN side = '{s}' THEN {c} END)"
    share = "CASE WHEN sum(energy) > 0 THEN coalesce(sum(CASE WHEN kept THEN energy END), 0) / sum(energy) END"
    quantiles = [(f"{q}_{s}", side(q, s)) for q in compare_settings.QUANTILES for s in ("before", "after")]
    return f"""SELECT '{setting}' AS setting, n.event_id, n_before, n_after, {r('closure', 'f_keep_before', 'f_keep_after', *(n for n, _ in quantiles))}
 FROM (SELECT event_id, count(*) FILTER (side = 'before') AS n_before, count(*) FILTER (side = 'after') AS n_after FROM {prefix}sides GROUP BY event_id) n
 LEFT JOIN {prefix}closure c ON n.event_id = c.event_id
 LEFT JOIN (SELECT event_id, {side('f', 'before')} AS f_keep_before, {side('f', 'after')} AS f_keep_after FROM (SELECT event_id, side, {share} AS f FROM {prefix}flagged GROUP BY ALL) GROUP BY event_id) k ON n.event_id = k.event_id
 LEFT JOIN (SELECT event_id, {', '.join(f'{v} AS {n}' for n, v in quantiles)} FROM {prefix}cont GROUP BY event_id) q ON n.event_id = q.event_id"""


QUERIES = {"job1_keep_clouds": job1_keep_clouds, "job2_compare_settings": job2_compare_settings}
ORACLE = {
    "job1_keep_clouds": with_ctes(f"""SELECT event_id // 100 AS part, event_id, w_layer, gi, gj, n_steps, {r("x", "y", "z", "energy")}, {rs('"time"')} AS "time", CAST(sum(n_steps) OVER e AS BIGINT) AS event_steps, count(*) OVER e AS event_points,
 {rs('sum(energy) OVER e / s')} AS closure FROM ccl4_cloud JOIN (SELECT event_id, sum(energy) AS s FROM ecal GROUP BY event_id) USING (event_id) WINDOW e AS (PARTITION BY event_id)"""),
    "job2_compare_settings": with_ctes(" UNION ALL ".join(_events(*x) for x in (("grid_3mm", ""), ("dbscan_1.5", "vd_"), ("clue_15.3", "vc_")))),
}
