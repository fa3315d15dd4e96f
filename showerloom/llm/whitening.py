"""Embedding whitening from an exact integer scatter.

Each entry c of a vector counts as the long x = floor(64 c) + SHIFT.  ``scatter`` subtracts the shift
again and adds up, for every pair of dimensions, the products of what is left, with a constant 1 as
dimension 0, so that the number of rows and the sums come along.  Blocks are multiplied in
double precision only while every partial sum stays below 2^53; larger entries are split into limbs
of LIMB bits first.  Each partition hands on one row per pair and power of two, as two longs, and
Spark adds these as decimals: exact however many rows there are.  n X'X - SS' doesn't depend on
the shift and is formed in integers; only then it is converted to double and decomposed by eigh.

``whiten`` gives each row an array of its components, numbered by falling eigenvalue.  Vectors of
another length can't share a covariance: each length is a fit of its own, over all vectors of that
length, so no row is left out.

Edge cases: vectors that are null, or hold null or non-finite entries, are dropped, and so are those
with an entry of which x would not fit a long; an empty vector has no components; null or repeated
ids and repeated or tied vectors stay; components without variance (the eigenvalue is within rounding of 0)
have null whitened values and don't count in identity_error; deviation is null where it does not
fit a long, deviation_digits always tells it; equal eigenvalues: any orthonormal basis of their space,
the same for all rows; an empty table gives no rows; other columns, whatever their names, are not
read.  The driver holds d^2 numbers for each length d, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table

SCALE, SHIFT, MOST = 64, 1_000_000, 32
#: bits of a limb and rows of a block: sums of BLOCK products of two limbs stay below 2^53
LIMB, BLOCK = 20, 1 << 12
#: long bits that the lower of two longs takes
LOW = 32
#: eigenvalues below this share of the largest are rounding
NOISE = 1e-13


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    bound = float(2**63 - 2 * SHIFT) / SCALE
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < bound))
    return rows.where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("v") > 0))


def lengths(column: pa.ChunkedArray | pa.Array):
    """For each length: the rows' places and their entries as integers without the shift (rows x d)."""
    size = np.asarray(column.value_lengths(), dtype=np.int64)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        part = column if len(at) == len(size) else column.take(pa.array(at))
        values = part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
        yield int(d), at, np.floor(SCALE * values).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Parts of LIMB bits, the last one signed, so that y = sum of part << (LIMB * place)."""
    out = []
    while len(y) and np.abs(y).max() >= 1 << LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


def moments(batches):
    """Of one partition: exact sums of products, as high << LOW + low, of every pair i <= j of dimensions and power of two."""
    held: dict = {}
    for batch in batches:
        for d, _, y in lengths(batch.column(0)):
            for first in range(0, len(y), BLOCK):
                parts = limbs(np.concatenate([np.ones((len(y[first : first + BLOCK]), 1), np.int64), y[first : first + BLOCK]], 1))
                for a, left in enumerate(parts):
                    for b, right in enumerate(parts):
                        product = (left.T @ right).astype(np.int64)
                        high, low = held.setdefault((d, LIMB * (a + b)), (np.zeros((d + 1, d + 1), np.int64), np.zeros((d + 1, d + 1), np.int64)))
                        high += product >> LOW
                        low += product & ((1 << LOW) - 1)
    for (d, power), (high, low) in held.items():
        i, j = np.triu_indices(d + 1)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            n = len(i[s])
            yield pa.record_batch({"d": np.full(n, d, np.int32), "i": i[s].astype(np.int32), "j": j[s].astype(np.int32), "power": np.full(n, power, np.int32), "high": high[i[s], j[s]], "low": low[i[s], j[s]]})
    give_back()


def scatter(rows: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """For each length d: n, the sums of x without the shift, and n X'X - SS', all exact."""
    parts = rows.select("v").mapInArrow(moments, "d int, i int, j int, power int, high long, low long")
    added = parts.groupBy("d", "i", "j", "power").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    total: dict = {}
    for d, i, j, power, high, low in added.toLocalIterator():
        cell = total.setdefault(d, {})
        cell[i, j] = cell.get((i, j), 0) + (((int(high) << LOW) + int(low)) << power)
    out = {}
    for d, cell in total.items():
        n, s = cell[0, 0], [cell[0, j] for j in range(1, d + 1)]
        out[d] = n, s, [[n * cell[min(i, j), max(i, j)] - s[i - 1] * s[j - 1] for j in range(1, d + 1)] for i in range(1, d + 1)]
    return out


def fit(rows: DataFrame, most: int = MOST) -> dict[int, dict]:
    """For each length: n, sums, the projection of the first components and their shares of the variance."""
    models = {}
    for d, (n, s, m) in scatter(rows).items():
        v = np.array([[e / (n * n) for e in line] for line in m])  # quotients of integers are rounded once
        value, vector = np.linalg.eigh(v)
        k = min(most, d)
        value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
        trace = sum(m[i][i] for i in range(d)) / (n * n)
        live = value > NOISE * max(float(value[0]), 0.0)
        root = np.where(live, np.sqrt(np.where(live, value, 1)), np.nan)
        models[d] = {"n": n, "sums": s, "axes": vector / root, "explained": [float(e) / trace if trace else None for e in np.maximum(value, 0)]}
    return models


def project(model: dict, y: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The exact sum of (n x - S)^2 of each row, and its whitened components (NaN without variance)."""
    n, s, d = model["n"], model["sums"], y.shape[1]
    reach = n * int(np.abs(y).max(initial=0)) + max(map(abs, s), default=0)
    if d * reach * reach < 1 << 63:
        gap = n * y - np.array(s, np.int64)
        deviation = (gap * gap).sum(1).tolist()
        centred = gap / n
    else:
        exact = y.astype(object) * n - np.array(s, object)
        deviation = (exact * exact).sum(1).tolist()
        centred = np.array([[e / n for e in line] for line in exact.tolist()])
    return deviation, centred @ model["axes"]


def projected(rows: DataFrame, models: dict[int, dict]) -> DataFrame:
    """(id, d, n, deviation, deviation_digits, whitened array)."""

    def run(batches):
        for batch in batches:
            for d, at, y in lengths(batch.column(1)):
                for first in range(0, len(at), BLOCK):
                    here = slice(first, first + BLOCK)
                    deviation, w = project(models[d], y[here])
                    offsets = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
                    yield pa.record_batch({
                        "id": batch.column(0).take(pa.array(at[here])), "d": np.full(len(w), d, np.int32), "n": pa.array([models[d]["n"]] * len(w), pa.int64()),
                        "deviation": pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()), "deviation_digits": pa.array(map(str, deviation), pa.string()),
                        "whitened": pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel(), from_pandas=True)),
                    })
        give_back()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, d int, n long, deviation long, deviation_digits string, whitened array<double>")


def identity_errors(done: DataFrame, models: dict[int, dict]) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""

    def sums(batches):
        held: dict = {}
        for batch in batches:
            size, column = np.asarray(batch.column(0)), batch.column(1)
            for d in np.unique(size):
                part = column.take(pa.array(np.flatnonzero(size == d)))
                w = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                w = np.concatenate([np.ones((len(w), 1)), np.nan_to_num(w)], 1)
                held[d] = held.get(d, 0) + w.T @ w
        for d, m in held.items():
            i, j = np.triu_indices(len(m))
            yield pa.record_batch({"d": np.full(len(i), d, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "s": m[i, j]})

    added = done.select("d", "whitened").mapInArrow(sums, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s"))
    total: dict = {}
    for d, i, j, s in added.collect():  # at most MOST^2 rows for each length
        total.setdefault(d, {})[i, j] = s
    worst = None
    for d, cell in total.items():
        n, live = cell[0, 0], [k + 1 for k in np.flatnonzero(~np.isnan(models[d]["axes"][0]))]
        for i in live:
            for j in live:
                if i <= j:
                    gap = abs(cell[i, j] / n - cell[0, i] / n * cell[0, j] / n - (i == j))
                    worst = gap if worst is None else max(worst, gap)
    return worst


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = MOST) -> DataFrame:
    """(id, d, n, deviation, deviation_digits, whitened, explained, identity_error), one row for each vector that takes part."""
    rows = usable(df, id_col, vec_col)
    models = fit(rows, most)
    done = projected(rows, models)
    error = identity_errors(done, models)
    shares = F.create_map(*(c for d, m in models.items() for c in (F.lit(d), F.array(*(F.lit(e).cast("double") for e in m["explained"]))))) if models else F.lit(None).cast("map<int,array<double>>")
    return done.withColumns({"explained": shares[F.col("d")], "identity_error": F.lit(error).cast("double")})


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whiten(table(spark, sf_dir, "embeddings"))
    at = done.select("*", F.posexplode("whitened").alias("place", "value"))
    return at.select(
        F.col("id").alias("vec_id"), (F.col("place") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.col("explained")[F.col("place")].alias("explained"),
        "identity_error", F.col("d").alias("dimensions"), "deviation_digits",
    )


QUERIES = {"op12_whitening": op12_whitening}
ORACLE: dict = {}
