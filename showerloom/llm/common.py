"""Shared pieces of the training-data operators: tokens, row keys, checkpoints, components.

Tokens everywhere are the maximal runs ``[^\\x20\\x09-\\x0D]+`` of the text after A-Z is
lower-cased.  In Python that is ``text.encode().lower().split()`` (bytes methods touch ASCII
only); in SQL it is ``WORDS`` below.  A null text counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[^\x20\x09-\x0D]+"
#: texts of one Arrow batch handled together in numpy, in bytes; bounds the temporary arrays
BLOCK_BYTES = 2 << 20
#: rows that a task of a graph round should hold
ROWS_PER_TASK = 100_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of lower-cased tokens; empty for null or blank texts."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(c), F.lit(f"({TOKEN})")), F.array().cast("array<string>"))


def tokens(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(c.cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """The session's own checkpoint folder, which all hosts share; a temporary one only on a local master, where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder.

    A checkpointed frame keeps the size estimate of the plan it replaces.  Joins multiply estimates,
    so over the rounds of a loop they grow to numbers that take minutes to multiply; the rows
    are therefore wrapped anew, without an estimate, and AQE decides by the real sizes.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    done = df.checkpoint(eager=True)
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def free_name(name: str, taken) -> str:
    """name, with underscores until no name in taken equals it (in any case of its letters)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def give_back() -> None:
    """Returns what a Python worker has freed to the system: it is kept for later tasks and may idle beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A key for each row of a scan, so that null or repeated ids stay apart."""
    return df.withColumn(name, F.monotonically_increasing_id())


class HashCache(dict):
    """64-bit token hashes; forgets everything when it has grown to `most` tokens."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.most, self.digest = most, xxh3_64_intdigest

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = self.digest(token)
        return value

    def of(self, toks: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, toks), np.uint64, len(toks))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every vertex that has an edge; component_id is the smallest id.

    Contraction: each vertex points to the smallest of itself and its neighbours, edges are
    rewritten to the targets, loops and repeats go; after O(log n) rounds no edge is left and
    the chain of pointers is composed.  Rows per round never exceed the edges.  Each round is a
    grouped minimum and equi-joins, so a hub's edges are pre-aggregated, never gathered.
    """
    def few(n: int) -> int:
        return max(1, ceil(n / ROWS_PER_TASK))  # tasks for at most n rows, so that late rounds are not many empty files

    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    n = e.count()
    tasks = first = few(2 * n)
    labels = None
    while n:
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
        if labels is None:
            labels = up.select(F.col("u").alias("id"), F.col("m").alias("component_id"))
        else:
            moved = labels.join(up.withColumnRenamed("u", "component_id"), "component_id", "left").select("id", F.coalesce("m", "component_id").alias("component_id"))
            labels = cut(moved.coalesce(first))
        e = e.join(up.withColumnRenamed("m", "mu"), "u").join(up.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
        e = cut(e.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).where("u <> v").distinct().coalesce(tasks))
        n = e.count()
        tasks = few(2 * n)
    if labels is None:
        return edges.select(F.col(a).alias("id"), F.col(a).alias("component_id")).where(F.lit(False))
    return labels
