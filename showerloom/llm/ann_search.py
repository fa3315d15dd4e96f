"""Approximate nearest neighbours by cross-polytope hashing.

Rows and queries are hashed by direction, so no long vector moves the others' buckets and a row is met
as often as its angle to the query allows.  Rows are split into norm ranges (powers of two of the median);
those of the longer ranges of at most ``BLOCK`` rows, whose products are large at any angle, are compared
with every query.  Each of ``TABLES`` tables rotates the
(zero-padded) vectors by three rounds of random signs and a fast Hadamard transform and takes the
nearest signed axis as bucket, or the nearest axes of two such rotations.  A query probes its nearest
buckets of each table.

How many axes and probes is measured at every size of table: the true neighbours of ``TRIALS`` queries drawn
by hash are found among all rows (one scan), and of ``SETTINGS`` the one is taken that asks for the fewest
comparisons while its tables meet a share ``AIM`` of these neighbours.  Where ``TABLES`` tables don't meet as
many in any setting, twice, three times .. ``MOST`` as many are tried, and if these don't either, all rows are
compared with all queries, in blocks.  The trials' neighbours choose the setting only and are no results.

Rows and queries meet by equi-join on (table, bucket); buckets are dealt into blocks of at most about
``BLOCK`` rows and queries, so a hot bucket is many small groups.  A group reranks its candidates
exactly in float64 and hands on k per query.  Each query first meets its own bucket of each table; its
k-th best product there bounds the true one from below, so the groups of all other probes hand on nothing
beneath it.  Queries that met fewer than k rows are compared with all rows, in blocks.
Only the trials, a sample of ``ROWS`` vectors, one norm and the sizes of the longer norm ranges reach the driver.

Edge cases: unusable vectors (see ``vectors.usable``) and rows without an id take no part; rows with
the same id are rows of their own, and only the query's own row is no candidate of it; ties go to
the smaller vec_id; fewer candidates than k: all of them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import matrix, top_rows, usable

TABLES, MOST = 14, 56
#: numbers that a block of rows may take while it is hashed
NUMBERS = 1 << 21
#: (axes of a bucket, probes of a table)
SETTINGS = tuple((1, p) for p in (2, 4, 6, 8, 10, 12, 15, 18, 24, 32, 48, 64)) + tuple((2, p) for p in (16, 32, 64, 128, 256, 512, 1024))
AIM, TRIALS, ROWS = 0.97, 64, 2048
#: comparisons that cost as much as sending a query to one more bucket
SENDING = 30
BLOCK = 4096
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def signed_axes(unit: np.ndarray, t: int, f: int) -> np.ndarray:
    """Coordinates along all signed axes after the pseudo-rotation of table t, function f."""
    rng = np.random.default_rng((SEED, t, f))
    size = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size))
    return np.hstack([x, -x])


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors, with a coordinate more."""
    x = x / np.abs(x).max(1, keepdims=True)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.hstack([x / norm, np.zeros_like(norm)])


def best_pairs(m: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in two falling lists of m that can be among the `probes` largest sums: (i + 1) (j + 1) sums are at least as large."""
    i, j = np.concatenate([np.column_stack([np.full(n := min(m, probes // (i + 1)), i), np.arange(n)]) for i in range(min(m, probes))]).T
    return i, j


def buckets(unit: np.ndarray, t: int, functions: int, probes: int) -> np.ndarray:
    """The best `probes` buckets of each vector in table t, best first; in blocks of rows of bounded memory."""
    width = 2 << max(1, (unit.shape[1] - 1).bit_length())
    m = min(probes, width)
    i, j = best_pairs(m, probes) if functions == 2 else (np.arange(m), None)
    step = max(1, NUMBERS // max(width, len(i)))
    return np.concatenate([_buckets(unit[at : at + step], t, functions, probes, i, j) for at in range(0, max(len(unit), 1), step)])


def _buckets(unit: np.ndarray, t: int, functions: int, probes: int, i: np.ndarray, j: np.ndarray | None) -> np.ndarray:
    along = [signed_axes(unit, t, f) for f in range(functions)]
    axes = [np.argsort(-s, 1, kind="stable")[:, : i.max() + 1] if i.max() else s.argmax(1)[:, None] for s in along]
    if j is None:
        return axes[0]
    first, second = (np.take_along_axis(s, a, 1) for s, a in zip(along, axes, strict=True))
    best = np.argsort(-(first[:, i] + second[:, j]), 1, kind="stable")[:, :probes]
    row = np.arange(len(unit))[:, None]
    return axes[0][row, i[best]] * along[0].shape[1] + axes[1][row, j[best]]


def hashed(rows: DataFrame, functions: int, probes: int, tables: int) -> DataFrame:
    """rows (_rid, id, v, tau), once per table and probed bucket, with t, probe (0: nearest), bucket."""
    step = min(1024, max(1, NUMBERS // (tables * probes)))

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                unit = directions(matrix(part.v))
                yield part.assign(keys=list(np.hstack([buckets(unit, t, functions, probes) for t in range(tables)])))

    per = rows.mapInPandas(run, "_rid long, id long, v array<double>, tau double, keys array<long>")
    per = per.select("_rid", "id", "v", "tau", "keys", F.posexplode("keys").alias("p", "bucket"))
    each = F.expr(f"CAST(size(keys) / {tables} AS INT)")
    return per.select("_rid", "id", "v", "tau", F.floor(F.col("p") / each).cast("int").alias("t"), (F.col("p") % each).alias("probe"), "bucket")


def neighbours(data: DataFrame, some: pd.DataFrame, k: int) -> pd.DataFrame:
    """(q, score, v): the k best rows of all for each of the few queries (_rid, v), numbered by q."""
    held = data.sparkSession.sparkContext.broadcast((some._rid.to_numpy(), matrix(some.v)))

    def run(batches):
        own, y = held.value
        best_ = None
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf.v)
                score = np.where(own[:, None] == pdf._rid.to_numpy(), -np.inf, y @ x.T)
                top = np.argsort(-score, 1, kind="stable")[:, :k]
                part = pd.DataFrame({"q": np.repeat(np.arange(len(y)), top.shape[1]), "score": np.take_along_axis(score, top, 1).ravel(), "v": list(x[top.ravel()])})
                best_ = pd.concat([best_, part[part.score > -np.inf]]).sort_values("score", ascending=False, kind="stable").groupby("q").head(k)
        if best_ is not None:
            yield best_

    found = data.select("_rid", "v").mapInPandas(run, "q int, score double, v array<double>")
    return found.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("k") <= k).drop("k").toPandas()


def choose(y: np.ndarray, q: np.ndarray, x: np.ndarray, rows: np.ndarray, n: int, tables: int, functions: int | None = None, most: int | None = None) -> tuple[int, int, int] | None:
    """(functions, probes, tables) for n rows; None where even `most` tables meet too few.

    x are neighbours that the queries y[q] must meet, rows a sample; all directions.  The fewest multiple of
    `tables` is taken with which one of SETTINGS meets a share AIM of the neighbours.
    """
    kinds = {f: [p for g, p in SETTINGS if g == f] for f in ((functions,) if functions else (1, 2))}
    met = {f: np.full(len(q), max(some)) for f, some in kinds.items()}
    visits = {f: np.zeros(max(some)) for f, some in kinds.items()}
    for t in range(most or tables):
        for f, some in kinds.items():
            asked = buckets(y, t, f, max(some))
            hit = asked[q] == buckets(x, t, f, 1)
            met[f] = np.minimum(met[f], np.where(hit.any(1), hit.argmax(1), max(some)))
            keys, count = np.unique(buckets(rows, t, f, 1), return_counts=True)
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            visits[f][: asked.shape[1]] += np.where(keys[at] == asked, count[at], 0).mean(0) / len(rows)
        if (t + 1) % tables == 0:
            options = [(n * visits[f][:p].sum() + SENDING * (t + 1) * p, f, p) for f, some in kinds.items() for p in some if (met[f] < p).mean() >= AIM]
            if options:
                return *min(options)[1:], t + 1
    return None


FOUND = "q_rid long, query_id long, rid long, vec_id long, score double"


def rerank(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q_rid, query_id, rid, vec_id, score): k per query and group; both sides have t, bucket."""
    sizes = data.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nd")).join(queries.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nq")), ["t", "bucket"])
    block = lambda n: F.expr(f"CAST(pmod(xxhash64(_rid), {n}) AS INT)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized_d = data.join(sizes, ["t", "bucket"]).withColumn("db", block("nd")).withColumn("qb", every("nq"))
    sized_q = queries.join(sizes, ["t", "bucket"]).withColumn("qb", block("nq")).withColumn("db", every("nd"))
    keys = ["t", "bucket", "db", "qb"]

    def run(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = {"q_rid": [], "query_id": [], "rid": [], "vec_id": [], "score": []}
        if len(d) and len(q):
            x, y = matrix(d.v), matrix(q.v)
            rid, vec, own, ids, tau = d._rid.to_numpy(), d.id.to_numpy(), q._rid.to_numpy(), q.id.to_numpy(), q.tau.to_numpy()
            for at in range(0, len(q), 256):
                scores = y[at : at + 256] @ x.T
                for i, s in enumerate(scores, at):
                    near = np.flatnonzero((s >= tau[i]) & (rid != own[i]))
                    if not len(near):
                        continue
                    rows, exact = top_rows(s[near], x[near], y[i], vec[near], k)
                    rows = near[rows]
                    for c, v in (("q_rid", np.full(len(rows), own[i])), ("query_id", np.full(len(rows), ids[i])), ("rid", rid[rows]), ("vec_id", vec[rows]), ("score", exact)):
                        out[c].append(v)
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, float if c == "score" else np.int64) for c, v in out.items()})

    sized_d, sized_q = (x.select(*keys, "_rid", "id", "v", "tau").toDF(*keys, "_rid", "id", "v", "tau") for x in (sized_d, sized_q))
    return sized_d.groupBy(*keys).cogroup(sized_q.groupBy(*keys)).applyInPandas(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid")
    once = found.groupBy("q_rid", "rid").agg(*(F.max(c).alias(c) for c in ("query_id", "vec_id", "score")))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rows_of(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v, q, _rid) of the usable vectors, behind a checkpoint."""
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q")).where("id IS NOT NULL"), "v")
    return cut(rows.withColumn("_rid", F.monotonically_increasing_id()))


#: one bucket for all
WHOLE = ("-1 AS t", "0L AS bucket")


def met_by_tables(rows: DataFrame, k: int, tables: int = TABLES, functions: int | None = None, probes: int | None = None) -> DataFrame:
    """(q_rid, query_id, rid, vec_id, score, rank): what the tables meet, k per query at most."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, middle = rows.agg(F.count("*"), F.percentile_approx(norm, 0.5)).first()
    span = F.floor(F.log2(norm / F.lit(middle)) + 0.5)
    long_ = [r["span"] for r in rows.where(norm > F.lit(middle)).groupBy(span.alias("span")).count().where(f"span > 0 AND count <= {BLOCK}").collect()]
    nothing = F.lit(-float("inf")).alias("tau")
    data, queries = rows.select("_rid", "id", "v", nothing), rows.where("q").select("_rid", "id", "v", nothing)
    if functions is None or probes is None:
        some = queries.orderBy(F.xxhash64("_rid")).limit(TRIALS).toPandas()
        hashed_only = data.where(F.coalesce(~span.isin(long_), F.lit(True)))
        near = neighbours(hashed_only, some, k)
        sample = matrix(hashed_only.orderBy(F.xxhash64("_rid", F.lit(1))).select("v").limit(ROWS).toPandas().v)
        least = SETTINGS[0][1] if functions is None else min(p for f, p in SETTINGS if f == functions)
        chosen = choose(directions(matrix(some.v)), near.q.to_numpy(), directions(matrix(near.v)), directions(sample), n, tables, functions, MOST) if len(near) else (functions or 1, least, tables)
        if chosen is None:
            return cut(best(rerank(data.selectExpr("*", *WHOLE), queries.selectExpr("*", *WHOLE), k), k))
        functions, probes, tables = chosen
    index = hashed(data.where(F.coalesce(~span.isin(long_), F.lit(True))), functions, 1, tables)
    nearest = rerank(index, hashed(queries, functions, 1, tables), k)
    if long_:
        nearest = nearest.unionByName(rerank(data.where(span.isin(long_)).selectExpr("*", *WHOLE), queries.selectExpr("*", *WHOLE), k))
    first = cut(best(nearest, k))
    so_far = first.where(F.col("rank") == k).select(F.col("q_rid").alias("_rid"), (F.col("score") - 1e-9 * F.abs("score")).alias("tau"))
    bounded = queries.drop("tau").join(so_far, "_rid", "left").select("_rid", "id", "v", F.coalesce("tau", nothing).alias("tau"))
    further = rerank(index, hashed(bounded, functions, probes, tables).where("probe > 0"), k)
    return cut(best(further.unionByName(first.drop("rank")), k))


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, tables: int = TABLES, functions: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for every row where is_query holds, against all rows."""
    rows = rows_of(vectors, is_query, id_col, vec_col)
    n = rows.count()
    if n < 2 or rows.where("q").isEmpty():
        return rows.where("false").selectExpr("id AS query_id", "1 AS rank", "id AS vec_id", "0D AS score")
    found = met_by_tables(rows, k, tables, functions, probes)
    # queries that met too few are compared with all rows, in blocks
    data, queries = (x.select("_rid", "id", "v", F.lit(-float("inf")).alias("tau")) for x in (rows, rows.where("q")))
    short = queries.join(found.groupBy(F.col("q_rid").alias("_rid")).count().where(F.col("count") >= min(k, n - 1)), "_rid", "left_anti")
    if not short.isEmpty():
        found = best(found.drop("rank").unionByName(rerank(data.selectExpr("*", *WHOLE), short.selectExpr("*", *WHOLE), k)), k)
    return found.select("query_id", "rank", "vec_id", "score")


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


QUERIES = {"op4_ann_search": op4_ann_search}
ORACLE: dict = {}
