"""Keeps the point clouds of a growing table of steps up to date.

    python -m jobs.keep_clouds SOURCE TARGET [--config FILE]

SOURCE is a Parquet folder (or file) to which files are added.  A file stream with a checkpoint in
TARGET/state takes only files that no earlier run has taken, and ends when it has caught up.  Each
micro-batch

1. stores its steps under TARGET/steps/batch=N, by ranges of events (`part`),
2. clusters the ranges that it has added to, anew from all their stored steps, because steps of an event
   may arrive in several batches, and
3. replaces these ranges in TARGET/cloud and TARGET/events by dynamic partition overwrite; ranges without new
   steps are neither read nor written.

A batch that is run again after a failure (the stream gives it the same number and the same files)
replaces what it has written before, so the tables come out the same.  A run without new files
changes nothing.  TARGET/events holds for each event the numbers and energies of its steps and points.

The config names the steps' columns as expressions of the source, a filter, how many events a
range has, how many files a batch takes, and the settings of the clustering on a grid.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.settings import config, log, start_log, steps_of
from showerloom.operators.grid import grid_cloud

CONFIG = "keep_clouds.json"


def replace(df: DataFrame, path: str) -> None:
    """Replaces df's ranges of events; files are evened out within them."""
    df.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def add(steps: DataFrame, number: int, target: str, settings: dict) -> dict:
    """One micro-batch of steps into the tables under target; what was read and written."""
    spark = steps.sparkSession
    part = F.floor(F.col("event_id") / settings["events_per_part"]).cast("long")
    here = f"{target}/steps/batch={number}"
    taken, written = Observation(), Observation()
    seen = steps.withColumn("part", part).observe(taken, F.count("*").alias("steps"), F.sum("energy").alias("energy"))
    seen.write.mode("overwrite").partitionBy("part").parquet(here)
    got = {"batch": number, "steps": taken.get["steps"], "energy": taken.get["energy"], "points": 0, "ranges": 0}
    if not got["steps"]:
        return got
    touched = spark.read.parquet(here).select("part").distinct()
    got["ranges"] = touched.count()
    stored = spark.read.parquet(f"{target}/steps").join(touched, "part", "left_semi")
    cloud = grid_cloud(stored.drop("batch", "part"), **settings["grid"]).withColumn("part", part)
    replace(cloud.observe(written, F.count("*").alias("points")), f"{target}/cloud")
    got["points"] = written.get["points"]
    before = stored.groupBy("part", "event_id").agg(F.count("*").alias("n_steps"), F.sum("energy").alias("energy_before"))
    points = spark.read.parquet(f"{target}/cloud").join(touched, "part", "left_semi")
    after = points.groupBy("part", "event_id").agg(F.count("*").alias("n_points"), F.sum("energy").alias("energy_after"))
    replace(before.join(after, ["part", "event_id"], "left"), f"{target}/events")
    return got


def arriving(spark: SparkSession, source: str, most: int) -> DataFrame:
    """source as a stream of files, at most so many in a batch; a lone file is its folder's only file of that name."""
    table = spark.read.parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", most)
    folder, _, name = source.rstrip("/").rpartition("/")
    first = table.select("_metadata.file_name").first()
    if first is not None and first.file_name == name:
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(source)


def run(spark: SparkSession, source: str, target: str, settings: dict) -> list[dict]:
    """Takes what is new in source; one entry for each batch."""
    done: list[dict] = []

    def batch(rows: DataFrame, number: int) -> None:
        done.append(add(steps_of(rows, settings["columns"], settings.get("where")), number, target.rstrip("/"), settings))
        log.info("batch %(batch)s: read %(steps)s steps of energy %(energy)s, wrote %(points)s points in %(ranges)s ranges of events", done[-1])

    stream = arriving(spark, source, settings["files_per_batch"]).writeStream.foreachBatch(batch).option("checkpointLocation", f"{target.rstrip('/')}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("%s batches from %s into %s", len(done), source, target)
    return done


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Keeps point clouds of a growing table of steps up to date.")
    args.add_argument("source")
    args.add_argument("target")
    args.add_argument("--config")
    args = args.parse_args(argv)
    start_log()
    spark = SparkSession.builder.appName("keep_clouds").getOrCreate()
    try:
        run(spark, args.source, args.target, config(args.config, CONFIG))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
