"""Steps stored by event: tables in buckets of event ids, so that work per event starts without an exchange.

A stored table is a folder with ``rows`` (Parquet in buckets of event_id, sorted by event and step) and
``layout`` (the number of buckets and the columns, written last, so a folder with a layout is whole).  Sums per event,
distinct events and joins of two tables with equally many buckets read their bucket and need no
shuffle; one event is looked up in one bucket, where row groups of other events are skipped.

An event lies in one bucket, and a bucket is one task of what reads it: this layout is for tables of
many events, not for one that is mostly a single event.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .steps import described, exists

BUCKETS = 64
LAYOUT = "buckets int, columns string"


def store_by_event(steps: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """steps in the layout above, with their units and names as metadata; rows need event_id and step_id."""
    spark = steps.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    name = f"by_event_{uuid.uuid4().hex}"
    rows = described(steps).repartition(buckets, "event_id")  # one file a bucket
    try:
        rows.write.format("parquet").bucketBy(buckets, "event_id").sortBy("event_id", "step_id").option("path", f"{path}/rows").saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its rows stay
    spark.createDataFrame([(buckets, rows.schema.json())], LAYOUT).write.json(f"{path}/layout")


def stored_by_event(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/layout")


def read_by_event(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table with their buckets and metadata."""
    layout = spark.read.schema(LAYOUT).json(f"{path}/layout").first()
    schema = StructType.fromJson(json.loads(layout["columns"]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    name = f"by_event_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (event_id) SORTED BY (event_id, step_id) INTO {layout["buckets"]} BUCKETS LOCATION '{path}/rows'")
    try:
        df = spark.table(name)
        return df.select(*(df[f.name].alias(f.name, metadata=f.metadata) if f.metadata else df[f.name] for f in schema))
    finally:
        spark.sql(f"DROP TABLE {name}")
