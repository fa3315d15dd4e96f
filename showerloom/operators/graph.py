"""Connected components and pointer chains within groups: forests of blocks of edges, then iterated joins."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all hosts share; a temporary one only where a local master names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the session's checkpoint folder.

    The rows are wrapped anew without the plan's size estimate, which joins would multiply from
    round to round; AQE goes by the real sizes.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint(eager=True)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def on_disk(df: DataFrame) -> DataFrame:
    """df's rows as Parquet in the shared folder: for tables of steps or points, of which a checkpoint keeps every column uncompressed."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: edges that a task turns into a forest at a time
BLOCK = 500_000


def columns_of(values: pa.Array, ordered: bool) -> list[np.ndarray]:
    """Integer columns that are equal where the values are, and in the same order if asked for."""
    if pa.types.is_struct(values.type):
        return [c for part in values.flatten() for c in columns_of(part, ordered)]
    if pa.types.is_integer(values.type):
        return [values.to_numpy(zero_copy_only=False)]
    return [(pc.rank(values, tiebreaker="dense") if ordered else values.dictionary_encode().indices).to_numpy(zero_copy_only=False)]


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex of the component of each of n vertices."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]


def forest(edges: pa.Table) -> pa.Table:
    """Edges (keys, u, v) that join the same vertices, one for each vertex but the smallest of its component."""
    edges = edges.combine_chunks()
    n = edges.num_rows
    ends = pa.concat_arrays([edges.column(c).chunk(0) if edges.column(c).num_chunks else pa.array([], edges.schema.field(c).type) for c in ("u", "v")])
    keys = [k for k in edges.column_names if k not in ("u", "v")]
    group = [np.tile(c, 2) for k in keys for c in columns_of(edges.column(k).combine_chunks(), False)]
    parts = [*columns_of(ends, True)[::-1], *group]
    order = np.lexsort(parts)  # by group, then by vertex
    new = np.ones(2 * n, bool)
    if n:
        new[1:] = np.any([p[order][1:] != p[order][:-1] for p in parts], 0)
    code = np.empty(2 * n, np.int64)
    code[order] = np.cumsum(new) - 1
    at = order[new]  # a place where each vertex stands
    root = roots(code[:n], code[n:], len(at))
    member = np.flatnonzero(root != np.arange(len(at)))
    rows = edges.select(keys).take(pa.array(at[member] % max(n, 1)))
    return rows.append_column("u", ends.take(pa.array(at[root[member]]))).append_column("v", ends.take(pa.array(at[member])))


def forests(edges: DataFrame, keys: list[str]) -> DataFrame:
    """edges (keys, u, v) of whole groups brought together and thinned to forests, BLOCK edges at a time.

    Components that lie within a block come out as stars around their smallest vertex; what spans several
    blocks is left to the rounds of ``connected_components``.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield from forest(pa.Table.from_batches(held)).to_batches()
                held = []
        if held:
            yield from forest(pa.Table.from_batches(held)).to_batches()

    together = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return together.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, id, root) of every vertex with an edge; vertices are unique within keys, root is the smallest.

    Edges are thinned to ``forests`` first, which settles all groups that fit a block.  Then rounds of
    contraction: every vertex points to its smallest neighbour or itself, edges move to the targets and
    shrink; O(log n) rounds.
    """
    e = cut_lineage(forests(edges.select(*keys, F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), keys))
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        up = cut_lineage(both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        if labels is None:
            labels = up.withColumnsRenamed({"u": "id", "m": "root"})
        else:
            labels = cut_lineage(labels.join(up.withColumnRenamed("u", "root"), [*keys, "root"], "left").select(*keys, "id", F.coalesce("m", "root").alias("root")))
        moved = e.join(up.withColumnRenamed("m", "mu"), [*keys, "u"]).join(up.withColumnsRenamed({"u": "v", "m": "mv"}), [*keys, "v"])
        e = cut_lineage(moved.select(*keys, F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).where("u <> v").distinct())
    return edges.select(*keys, F.col(a).alias("id"), F.col(a).alias("root")).where(F.lit(False)) if labels is None else labels


def follow(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, root) from (keys, id, ptr): ends of pointer chains; ends point to themselves, null is lost.

    Pointer jumping: the distance halves each round.
    """
    p = cut_lineage(pointers.select(*keys, "id", "ptr"))
    while True:
        step = p.join(p.select(*keys, F.col("id").alias("ptr"), F.col("ptr").alias("next")), [*keys, "ptr"], "left").select(*keys, "id", "ptr", "next")
        moved = cut_lineage(step)
        p = moved.select(*keys, "id", F.col("next").alias("ptr"))
        if moved.where("ptr IS NOT NULL AND NOT (ptr <=> next)").isEmpty():
            return p.withColumnRenamed("ptr", "root")
