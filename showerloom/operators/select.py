"""Row selection: first events, subdetectors, group sizes, common events."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAYER_KEYS = ["event_id", "subdetector", "layer"]
#: ids of events that are broadcast without a look at their size
BROADCAST_IDS = 100_000
#: events of a table with one row for each that is broadcast (some 100 bytes an event)
BROADCAST_EVENTS = 500_000
#: steps that a task sorts beside their event; several sorts of some 250 bytes a step are held at once
ROWS_PER_TASK = 500_000


def first_n_events(steps: DataFrame, n: int) -> DataFrame:
    """Rows of the n smallest event ids."""
    ids = steps.select("event_id").distinct().orderBy("event_id").limit(n)
    return steps.join(few_ids(ids, n), "event_id", "left_semi")


def few_ids(ids: DataFrame, n: int) -> DataFrame:
    """At most n ids, to be broadcast where these are few; else Spark decides by their size."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def with_event(rows: DataFrame, written: DataFrame, how: str = "inner") -> DataFrame:
    """rows beside what is known of their event; written: a checkpointed table of one row for each event.

    Up to BROADCAST_EVENTS events rows stay where they are; a checkpoint tells no size, so Spark would send both sides.
    """
    return rows.join(F.broadcast(written) if written.count() <= BROADCAST_EVENTS else written, "event_id", how)


def sent_by_event(rows: DataFrame, n: int) -> DataFrame:
    """rows of an event in one task, for sorts and windows; n: how many rows there are, at most.

    Spark merges shuffle partitions by their compressed size until there are hardly more than cores, and sorts of many
    columns then spill; where that leaves a task more than ROWS_PER_TASK, the number of tasks goes by the rows.
    """
    tasks = ceil(n / ROWS_PER_TASK)
    return rows.repartition(tasks, "event_id") if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows.repartition("event_id")


def ecal_only(steps: DataFrame) -> DataFrame:
    return steps.where("subdetector = 0")


def grid_scan(steps: DataFrame, n: int) -> DataFrame:
    """Barrel rows of the n smallest event ids of all subdetectors: events are counted before the cut."""
    return ecal_only(first_n_events(steps, n))


def min_group(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least `least` rows."""
    name = "_group_rows"
    return df.withColumn(name, F.count("*").over(W.partitionBy(*keys))).where(F.col(name) >= least).drop(name)


def common_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Event ids present on both sides."""
    return before.select("event_id").distinct().join(after.select("event_id").distinct(), "event_id")


def one_event(df: DataFrame, event_id: int, subdetector: int | None = None) -> DataFrame:
    """Rows of one event (and subdetector); raises where there are none."""
    out = df.where(F.col("event_id") == event_id)
    out = out if subdetector is None else out.where(F.col("subdetector") == subdetector)
    if out.isEmpty():
        raise ValueError(f"event {event_id} has no rows here")
    return out
