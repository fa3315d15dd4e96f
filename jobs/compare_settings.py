"""Compares compressions of a table of steps, event by event, to choose a setting.

    python -m jobs.compare_settings SOURCE TARGET [--config FILE]

For each setting of the config (a tool and its parameters) the steps are compressed and held against
the original in the shower's own frame.  TARGET gets one partition `setting=NAME` with a row for each
event: numbers of steps and points, energy closure, share of the energy inside the cuts on both sides, and
the containment quantiles on both sides.  Only the partitions of the config's settings are
replaced (dynamic partition overwrite), so a second run leaves the same table, and a new setting is
added beside the others.

The config names the steps' columns as expressions of the source, a filter and the settings.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobs.settings import config, log, start_log, steps_of
from showerloom.operators import validate as va
from showerloom.operators.clue import clue
from showerloom.operators.dbscan import dbscan, dbscan_adaptive
from showerloom.operators.figures import QUANTILES, side_figures
from showerloom.operators.graph import cut_lineage, on_disk
from showerloom.operators.grid import grid_cloud
from showerloom.operators.reduce import point_cloud
from showerloom.operators.select import LAYER_KEYS
from showerloom.sources.steps import ensure_columns

CONFIG = "compare_settings.json"
LABELS = {"dbscan": dbscan, "dbscan_adaptive": dbscan_adaptive, "clue": clue}


def compressed(steps: DataFrame, tool: str, parameters: dict) -> DataFrame:
    """(event_id, step_id, x, y, z, energy) of the points; step_id numbers an event's points."""
    if tool == "grid":
        cloud, order = grid_cloud(steps, **parameters), ["w_layer", "gi", "gj"]
    else:
        cloud, order = point_cloud(LABELS[tool](steps, **parameters), LAYER_KEYS, ["label"], False), ["subdetector", "layer", "label"]
    number = F.row_number().over(W.partitionBy("event_id").orderBy(*order)).cast("long")
    return cloud.select("event_id", number.alias("step_id"), *"xyz", "energy")


def per_event(steps: DataFrame, points: DataFrame) -> DataFrame:
    """One row for each event that has steps and points."""
    told = va.geometry(steps)
    return compared(side_figures(steps, told, steps.count()), side_figures(points, told, points.count()))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of ``per_event`` from the figures of both sides."""
    sides = (va.BEFORE, va.AFTER)
    named = lambda df, s: df.select("event_id", *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "event_id"))
    total = {s: F.col(f"total_{s}") for s in sides}
    return named(before, va.BEFORE).join(named(after, va.AFTER), "event_id").select(
        "event_id",
        *(f"n_{s}" for s in sides),
        F.when(total[va.BEFORE] > 0, F.try_divide(total[va.AFTER], total[va.BEFORE])).alias("closure"),
        *(F.when(total[s] > 0, F.try_divide(F.col(f"inside_{s}"), total[s])).alias(f"f_keep_{s}") for s in sides),
        *(f"{q}_{s}" for q in QUANTILES for s in sides),
    )


def run(spark: SparkSession, source: str, target: str, settings: dict) -> dict[str, dict]:
    """Writes the partitions of all settings; what each has read and written."""
    raw = spark.read.parquet(source)
    steps = on_disk(ensure_columns(steps_of(raw, settings["columns"], settings.get("where"))))
    n = steps.count()
    told = va.geometry(steps)  # what all comparisons take from the steps
    before = cut_lineage(side_figures(steps, told, n))
    done = {}
    for setting in settings["settings"]:
        name, tool = setting["name"], setting["tool"]
        seen = Observation()
        points = on_disk(compressed(steps, tool, setting.get("parameters", {})))
        table = compared(before, side_figures(points, told, points.count())).withColumn("setting", F.lit(name))
        table = table.observe(seen, F.count("*").alias("events"), F.sum("n_after").alias("points"))
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("setting").parquet(target)
        done[name] = {"steps": n, **seen.get}
        log.info("%s: read %s steps of %s, wrote %s events with %s points to %s", name, n, source, seen.get["events"], seen.get["points"], target)
    return done


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Compares compressions of a table of steps.")
    args.add_argument("source")
    args.add_argument("target")
    args.add_argument("--config")
    args = args.parse_args(argv)
    start_log()
    spark = SparkSession.builder.appName("compare_settings").getOrCreate()
    try:
        run(spark, args.source, args.target, config(args.config, CONFIG))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
