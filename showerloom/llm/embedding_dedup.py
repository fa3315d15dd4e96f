"""Embedding near-dedup: ITQ codes, multi-index Hamming tables, exact reranking.

Rotations that balance binary codes are learned on a bounded sample (``SAMPLE`` vectors drawn by
hash; all vectors are indexed): unit vectors are coded by sign and turned by the orthogonal matrix
that best fits the codes, in turn.  A table's key is b code bits; no bit serves two tables, and each
64 bits come from a rotation learned from another random start.

How often linked vectors share no table is measured, not derived: around the sample's vectors, pairs
at exactly the threshold cosine are made by turning a vector in a random direction and towards another
vector, and the sample's own pairs just over the threshold join them.  Tables are added until of each
kind a share MISS at most is missed.  Whether the mean is taken off first (codes are more even, but
the angle of a pair widens) and b follow from the measured cost: rows times tables, and pairs that meet.

Equal vectors are one class from the start.  Buckets are dealt into pairs of blocks of at most about
``BLOCK`` classes; a group multiplies its blocks, keeps cosines >= threshold in float64 on the
original vectors, counts each pair only in the first table in which it meets, and hands on per class
its number of linked vectors and the root of its local component: never pairs.  Components are
merged by contraction.

Edge cases: unusable vectors (see ``vectors.usable``) and rows without an id link with nothing,
have 0 links and are their own component; equal vectors link with each other (m copies: m - 1
links each); rows with the same id are vectors of their own; an empty table gives no rows; labels
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table
from .vectors import matrix, usable

SAMPLE, ROUNDS, MISS, BLOCK, SEED = 5000, 30, 0.01, 2048, 17
THRESHOLD = 0.9
#: bits of a table's key; own pairs of the sample that are enough to measure by
LEAST_BITS, MOST_BITS, ENOUGH = 4, 48, 500


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn_rotation(x: np.ndarray, bits: int = 64, seed: int = 0, centred: bool = True, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): the sign of (unit(x) - mean) @ projection is the code; mean is 0 if not centred."""
    u = unit(x)
    mean = u.mean(0) * centred
    c = u - mean
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :bits]
    y = c @ axes
    turn = np.linalg.qr(np.random.default_rng((SEED, seed)).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        code = np.where(y @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(code.T @ y)
        turn = (left @ right).T
    return mean, axes @ turn


def random_rotation(d: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of random directions about 0, whose bits differ with probability angle / pi for every pair."""
    return np.zeros(d), np.linalg.qr(np.random.default_rng((SEED, seed, 1)).normal(size=(d, d)))[0][:, :64]


def threshold_pairs(x: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of unit vector pairs at the threshold around those of x; and x's own just over it, if ENOUGH."""
    rng = np.random.default_rng((SEED, 2))
    u = unit(x)[rng.integers(0, len(x), SAMPLE)]
    noise = rng.normal(size=u.shape)
    kinds = []
    for way in (noise, unit(x)[rng.integers(0, len(x), SAMPLE)] + 1e-6 * noise):
        way = way - (way * u).sum(1, keepdims=True) * u
        way /= np.maximum(np.sqrt((way * way).sum(1, keepdims=True)), 1e-300)
        kinds.append((u, unit(threshold * u + np.sqrt(max(0.0, 1 - threshold**2)) * way)))
    u, near = unit(x), []
    for at in range(0, len(u), 500):
        s = u[at : at + 500] @ u.T
        i, j = np.nonzero((s >= threshold) & (s <= threshold + (1 - threshold) / 5))
        these = np.column_stack([i + at, j])[i + at < j]
        near.append(these[rng.permutation(len(these))[:SAMPLE]])
    own = np.concatenate(near)
    if len(own) >= ENOUGH:
        own = own[rng.permutation(len(own))[:SAMPLE]]
        kinds.append((u[own[:, 0]], u[own[:, 1]]))
    return kinds


def bits_of(u: np.ndarray, rotation: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (u - rotation[0]) @ rotation[1] >= 0


def keys_of(bit: np.ndarray, b: int) -> np.ndarray:
    """A column per table: keys of b bits each."""
    count = bit.shape[1] // b
    return bit[:, : count * b].reshape(len(bit), count, b) @ (np.int64(1) << np.arange(b, dtype=np.int64))


def tables_needed(differ: list[np.ndarray], b: int, miss: float) -> float:
    """Independent tables of b bits until each kind is missed at most that often; differ: shares of unequal bits."""
    for count in np.unique(np.geomspace(1, 1 << 14, 150).astype(int)):
        if all(((1 - (1 - q) ** b) ** count).mean() <= miss for q in differ):
            return float(count)
    return np.inf


def plan(x: np.ndarray, n: int, threshold: float, miss: float = MISS) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """(b, rotations) for n vectors like those of the sample x; learned on one half, measured on the other."""
    x, other = (x[::2], x[1::2]) if len(x) > 1 else (x, x)  # rotations fit the vectors they are learned on too well
    u, pairs = unit(x), threshold_pairs(other, threshold)
    options = []
    for centred in (True, False):
        trial = [learn_rotation(x, seed=i, centred=centred) for i in range(2)]
        differ = [np.mean([(bits_of(y, r) != bits_of(z, r)).mean(1) for r in trial], 0) for y, z in pairs]
        codes = [bits_of(u, r) for r in trial]
        for b in range(LEAST_BITS, max(LEAST_BITS, min(MOST_BITS, codes[0].shape[1])) + 1):
            b = min(b, codes[0].shape[1])
            count = tables_needed(differ, b, miss)
            shared = []
            for key in np.hstack([keys_of(c, b) for c in codes]).T:
                m = np.unique(key, return_counts=True)[1]
                shared.append((m * (m - 1.0)).sum() / max(1, len(u) * (len(u) - 1.0)))
            # bytes of a row in a table, and vectors it is compared with there
            options.append((count * (8 * (x.shape[1] + count) + n * max(np.mean(shared), 0.5**b)), b, not centred, count))
    _, b, plain, count = min(options)
    rotations, left, made = [], [np.ones(len(y), bool) for y, _ in pairs], 0
    while not rotations or any(m.sum() + 2 * np.sqrt(m.sum()) > miss * len(m) for m in left):  # by two standard errors
        at = len(rotations)
        # where learned rotations come out alike, random ones go on
        rotations.append(learn_rotation(x, seed=at, centred=not plain) if made <= 2 * count else random_rotation(x.shape[1], at))
        for m, (y, z) in zip(left, pairs, strict=True):
            m &= ~(keys_of(bits_of(y, rotations[-1]), b) == keys_of(bits_of(z, rotations[-1]), b)).any(1)
        made += rotations[-1][1].shape[1] // b
    return b, rotations


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Mask of row pairs with cosine >= threshold; those within rounding of it by a plain sum."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    s = (x @ y.T) / (nx[:, None] * ny)
    mask = s >= threshold
    for i, j in zip(*np.nonzero(np.abs(s - threshold) < 1e-12), strict=True):
        mask[i, j] = np.dot(x[i], y[j]) / (nx[i] * ny[j]) >= threshold
    return mask


def roots(mask: np.ndarray) -> np.ndarray:
    """Smallest row number of each row's component under a symmetric mask."""
    out = np.full(len(mask), -1)
    for i in range(len(mask)):
        if out[i] < 0:
            reach = np.zeros(len(mask), bool)
            reach[i] = True
            front = reach
            while front.any():
                front = mask[front].any(0) & ~reach
                reach = reach | front
            out[reach] = i
    return out


def link_groups(classes: DataFrame, threshold: float) -> DataFrame:
    """(cid, n, root) per class and group of a table: linked vectors counted there, and a local root.

    classes: cid, v (array<double>), m (copies).
    """
    sc = classes.sparkSession.sparkContext
    some = classes.orderBy(F.xxhash64("cid")).select("v").limit(SAMPLE).toPandas()
    held = sc.broadcast(plan(matrix(some.v), classes.count(), threshold))

    def code(batches):
        b, rotations = held.value
        for pdf in batches:
            if len(pdf):
                u = unit(matrix(pdf.v))
                yield pdf.assign(keys=list(np.hstack([keys_of(bits_of(u, r), b) for r in rotations])))

    coded = classes.select("cid", "v", "m").mapInPandas(code, "cid long, v array<double>, m long, keys array<long>")
    entries = coded.select("*", F.posexplode("keys").alias("t", "key"))
    sizes = entries.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    rows = entries.join(sizes, ["t", "key"]).withColumn("own", F.expr("CAST(pmod(xxhash64(cid), nb) AS INT)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("t", "key", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), "own", "cid", "v", "m", "keys")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, b0, b1 = int(pdf.t.iat[0]), int(pdf.b0.iat[0]), int(pdf.b1.iat[0])
        pdf = pdf.sort_values("cid")
        x, m, keys = matrix(pdf.v), pdf.m.to_numpy(float), np.array(pdf["keys"].to_list())
        mask = linked(x, x, threshold)
        mask |= mask.T
        np.fill_diagonal(mask, False)
        if b0 != b1:  # pairs within one block are another group's
            side = pdf.own.to_numpy()
            mask &= side[:, None] != side
        counted = mask
        if t and mask.any():
            counted = mask.copy()
            i, j = np.nonzero(mask)
            for at in range(0, len(i), 1 << 18):
                part = slice(at, at + (1 << 18))
                earlier = np.zeros(len(i[part]), bool)
                for k in range(t):
                    earlier |= keys[i[part], k] == keys[j[part], k]
                counted[i[part][earlier], j[part][earlier]] = False
        some = mask.any(1)
        cid = pdf.cid.to_numpy()
        return pd.DataFrame({"cid": cid[some], "n": (counted @ m)[some].astype(np.int64), "root": cid[roots(mask)][some]})

    return rows.groupBy("t", "key", "b0", "b1").applyInPandas(run, "cid long, n long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = usable(rows.where("id IS NOT NULL"), "v").withColumn("_rid", F.monotonically_increasing_id())
    classes = cut(good.groupBy("v").agg(F.min("_rid").alias("cid"), F.count("*").alias("m"), F.min("id").alias("least")))
    if classes.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = cut(link_groups(classes, threshold))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    groups = components(found.select("cid", "root"), "cid", "root").withColumnsRenamed({"id": "cid", "component_id": "at"})
    placed = classes.join(groups, "cid", "left").withColumn("at", F.coalesce("at", "cid")).join(counts, "cid", "left")
    least = placed.groupBy("at").agg(F.min("least").alias("component_id"))
    of_class = placed.join(least, "at").select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    keyed = rows.withColumn("v", F.when(F.col("id").isNotNull(), F.col("v")))
    out = keyed.join(of_class, "v", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLE: dict = {}
