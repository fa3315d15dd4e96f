"""The steps table: schema, readers, writers and the stand-in built from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("step_id", T.LongType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()),
    T.StructField("energy", T.DoubleType()), T.StructField("time", T.DoubleType()),
    T.StructField("subdetector", T.IntegerType()), T.StructField("cell_id", T.LongType()), T.StructField("pdg", T.IntegerType()),
])
#: what a missing optional column counts as
DEFAULTS = {"time": None, "pdg": 0, "subdetector": 0, "cell_id": None}

#: SQL over a `lineitem` relation, the same in Spark and DuckDB but for quoting of "time"
STEPS_SQL = """
WITH b AS (SELECT l_suppkey AS event_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) AS step_id,
    CAST((l_partkey*7919 + l_orderkey*31) % 2001 - 1000 AS DOUBLE) / 1000 AS p, CAST((l_orderkey*6151 + l_partkey*17) % 2001 - 1000 AS DOUBLE) / 1000 AS q,
    (l_quantity - 1)*2 + l_discount*10 AS z, l_extendedprice, l_tax, l_linenumber, l_orderkey FROM lineitem)
SELECT event_id, CAST(step_id AS BIGINT) AS step_id, CAST(30 AS DOUBLE)*p*p*p + CAST(0.2 AS DOUBLE)*z AS x, CAST(30 AS DOUBLE)*q*q*q - CAST(0.1 AS DOUBLE)*z AS y, z,
  l_extendedprice/1000 * (CAST(1 AS DOUBLE)-p*p) * (CAST(1 AS DOUBLE)-q*q) + CAST(0.001 AS DOUBLE) AS energy, z/300 + l_tax*10 AS {time},
  CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS subdetector, CAST(floor(z/10) AS BIGINT)*524288 + l_orderkey % 524288 AS cell_id, 22 AS pdg FROM b"""


def steps_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps derived from lineitem by arithmetic alone."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(STEPS_SQL.format(time="`time`").replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)


def ensure_columns(df: DataFrame, need: tuple[str, ...] = ()) -> DataFrame:
    """df in the steps schema: columns cast, optional ones filled, position arrays split.

    need: optional columns that this use cannot do without (cell_id for layers).  Rows without step_id
    are numbered within their event in the order of their values, which doesn't depend on file splits.
    """
    if "position" in df.columns:
        df = df.select("*", *(F.col("position")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    if missing := [f.name for f in SCHEMA if f.name not in df.columns and (f.name in need or f.name not in DEFAULTS and f.name != "step_id")]:
        raise ValueError(f"columns missing: {missing}")
    if "step_id" not in df.columns:
        order = [c for c in ("cell_id", "subdetector", "time", "energy", "x", "y", "z", "pdg") if c in df.columns]
        df = df.withColumn("step_id", F.row_number().over(W.partitionBy("event_id").orderBy(*order)))
    told = {c: df.schema[c].metadata for c in df.columns}
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(DEFAULTS[f.name])).cast(f.dataType).alias(f.name, metadata=told.get(f.name) or {}) for f in SCHEMA))


def read_steps(spark: SparkSession, path: str, need: tuple[str, ...] = ()) -> DataFrame:
    """Parquet steps, those stored by event in their buckets; .h5 files through the Python data source (needs h5py)."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith((".h5", ".hdf5")):
        from .hdf5 import Hdf5Steps, names

        spark.dataSource.register(Hdf5Steps)
        return described(ensure_columns(spark.read.format("hdf5_steps").load(path), need), names=names(path))
    from .by_event import read_by_event, stored_by_event

    if stored_by_event(spark, path):
        return ensure_columns(read_by_event(spark, path), need)
    return ensure_columns(spark.read.parquet(path), need)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything at path."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


#: units of the columns
UNITS = {"x": "mm", "y": "mm", "z": "mm", "energy": "MeV", "time": "ns"}
#: the subdetectors that are known without a table of their own
NAMES = {0: "ECAL barrel", 1: "ECAL endcap"}
#: the column whose metadata tells how a cloud was made
CARRIER = "event_id"


def described(df: DataFrame, params: dict | None = None, names: dict[int, str] | None = None) -> DataFrame:
    """df with units, parameters and names of subdetectors as column metadata, which Parquet files keep; names that it has already stay."""
    own = df.schema[CARRIER].metadata if CARRIER in df.columns else {}
    known = own.get("subdetector_names") or {str(k): v for k, v in (names or NAMES).items()}
    about = own | {"subdetector_names": known} | ({"cluster_params": params} if params is not None else {})
    for c, unit in UNITS.items():
        if c in df.columns:
            df = df.withMetadata(c, df.schema[c].metadata | {"unit": unit})
    return df.withMetadata(CARRIER, about)


def subdetector_names(df: DataFrame) -> DataFrame:
    """(subdetector, name, n_rows) of df's own subdetectors, named by its metadata; null where it names none."""
    names = df.schema[CARRIER].metadata.get("subdetector_names", {})
    table = df.sparkSession.createDataFrame([(int(k), v) for k, v in names.items()], "subdetector int, name string")
    return df.groupBy("subdetector").agg(F.count("*").alias("n_rows")).join(F.broadcast(table), "subdetector", "left")  # a few names


def run_params(df: DataFrame) -> DataFrame:
    """(units, cluster_params, n_rows): units of df's columns in their order, its parameters as JSON with sorted keys, and how many rows it has."""
    import json

    units = list(dict.fromkeys(f.metadata["unit"] for f in df.schema if "unit" in f.metadata))
    params = df.schema[CARRIER].metadata.get("cluster_params")
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(", ".join(units)).alias("units"), F.lit(None if params is None else json.dumps(params, sort_keys=True)).alias("cluster_params"), "n_rows")


def write_cloud(cloud: DataFrame, path: str, params: dict | None = None, names: dict[int, str] | None = None) -> None:
    """A point cloud as Parquet by subdetector, with its units, parameters and names as metadata."""
    described(cloud, params, names).write.mode("errorifexists").partitionBy("subdetector").parquet(path)


def output_name(source: str, tool: str, **params) -> str:
    """A file name that tells the parameters."""
    stem = source.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return "_".join([stem, tool, *(f"{k}{v:g}" if isinstance(v, int | float) else f"{k}{v}" for k, v in params.items() if v is not None)]) + ".parquet"
