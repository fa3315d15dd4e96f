"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each text gives its set of distinct word shingles (64-bit hashes), a digest of that set and
   30 bands of 6 MinHash rows: at Jaccard 0.8 a pair shares a band with probability 0.9999.
   Texts with the same set are one class from here on, so copies never make pairs.
2. Candidates: per round, pairs of a class with a pivot of its bucket, only across components found
   so far.  Round one pairs each class with one pivot, round two with the pivots of all its buckets,
   each drawn by hash.  What still shares a bucket across components is compared exhaustively, but in
   blocks (``exhaust``) that hand on links alone, so connectivity over all banded candidates is exact.
   Classes that hang together by such buckets are one family of blocks while at most ``BLOCK``; larger
   families, which chains of buckets may spread over a corpus, are compared bucket by bucket.
3. Verification compares the signatures in batches of 30 rows.  With a uniform prior, m agreements
   in n rows leave P(J >= t | m, n) = P(Binomial(n + 1, t) <= m); a pair goes as soon as that is
   below ``miss``.  Only survivors meet their full shingle sets, which decide.
4. Links become components by contraction (see ``common.components``).

Edge cases: null or blank text has an empty set and links with nothing (its component is itself);
with fewer words than a shingle the whole sequence is one shingle; repeated rows are one class; very
long texts are hashed whole, and their sets travel whole; a
null key is smallest among nothing: min() skips it unless the whole component is null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashCache, components, cut, free_name, give_back, table, tokens

BANDS, ROWS = 30, 6
K = BANDS * ROWS
BATCH = 30
#: classes on either side of a block of comparisons
BLOCK = 512
#: keys over which the rows of a large family are spread
SALTS = 64
_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 32, K, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        return mix((hashes * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    return np.unique(mix(sum(hashes[j : n - width + 1 + j] * _ODD[j] for j in range(width))))


def signature(s: np.ndarray) -> np.ndarray:
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    return reduce(np.minimum, ((x[i : i + 16384, None] * _A + _B).min(0) for i in range(0, len(x), 16384)))


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = (sig.reshape(BANDS, ROWS).astype(np.uint64) * _ROW).sum(1, dtype=np.uint64)
    return mix(rows + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def least_agreements(threshold: float, miss: float) -> list[int]:
    """For n = BATCH, 2 BATCH, ..: fewest agreements that still leave P(J >= threshold) >= miss."""
    out = []
    for n in range(BATCH, K + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return out


def sketch(docs: DataFrame, key: str, width: int) -> DataFrame:
    """key, n_shingles, text_hash, cls (digest of the set; null for an empty one), bands."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        cache = HashCache()
        for pdf in batches:
            sizes, names, bands = [], [], []
            for t in pdf.text:
                s = shingles(cache.of(tokens(t)), width)
                sizes.append(len(s))
                names.append(digest(s) if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pd.DataFrame({"key": pdf.key, "n_shingles": sizes, "text_hash": pdf.text_hash, "cls": names, "bands": bands})
        cache.clear()
        give_back()

    rows = docs.select(F.col(key).alias("key"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInPandas(run, f"key {kind}, n_shingles long, text_hash long, cls binary, bands array<long>")


def payload(docs: DataFrame, key: str, wanted: DataFrame, width: int) -> DataFrame:
    """cls, sig, items of the wanted classes (cls, key, text_hash of one document of each).

    Documents are dealt by key and text, so that copies of one text are spread over the tasks.
    """

    def run(batches):
        cache = HashCache()
        for pdf in batches:
            pdf = pdf.drop_duplicates("cls")
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                sets = [shingles(cache.of(tokens(t)), width) for t in part.text]
                keep = [digest(s) == bytes(c) for s, c in zip(sets, part.cls, strict=True)]
                sets = [s for s, k in zip(sets, keep, strict=True) if k]
                yield pd.DataFrame({"cls": part.cls[keep], "sig": [signature(s).tobytes() for s in sets], "items": [s.tobytes() for s in sets]})
        cache.clear()
        give_back()

    rows = docs.select("text", F.col(key).alias("k"), F.xxhash64("text").alias("h"))
    found = rows.join(wanted, F.col("k").eqNullSafe(F.col("key")) & (F.col("h") == F.col("text_hash")))
    return found.select("text", "cls").mapInPandas(run, "cls binary, sig binary, items binary").dropDuplicates(["cls"])


def alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = np.concatenate([s, t])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def verify(pairs: DataFrame, held: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    least = least_agreements(percent / 100, miss)

    def likely(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(-1, K) for c in ("sig_a", "sig_b"))
            live, agree = np.arange(len(pdf)), np.zeros(len(pdf), int)
            for i, m in enumerate(least):
                at = slice(i * BATCH, (i + 1) * BATCH)
                agree[live] += (x[live, at] == y[live, at]).sum(1)
                live = live[agree[live] >= m]
            yield pdf.iloc[live][["a", "b"]]

    def sure(batches):
        for pdf in batches:
            good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(pdf.items_a, pdf.items_b, strict=True)]
            yield pdf.loc[good, ["a", "b"]]

    def sides(pairs, what):
        side = lambda c: held.select(F.col("cls").alias(c), F.col(what).alias(f"{what}_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    kept = sides(pairs, "sig").mapInPandas(likely, "a binary, b binary")
    return sides(kept, "items").mapInPandas(sure, "a binary, b binary")


def ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def exhaust(placed: DataFrame, held: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) between classes of different components that share a bucket.

    placed: bucket, cls, pivot, at (component), main (the bucket's commonest component), for buckets
    with several components.  In such a pair one side is not of the main component; these few are
    compared with their group (a small family, or a bucket of a large one) in blocks of BLOCK x BLOCK
    classes, pairs of a large family only in the first bucket that they share.
    """
    least = least_agreements(percent / 100, miss)
    family = components(placed.select("pivot", "cls"), "pivot", "cls").withColumnsRenamed({"id": "cls", "component_id": "family"})
    # at most one class in BLOCK leads a large family; its rows meet that on one of SALTS keys
    large = family.groupBy("family").count().where(F.col("count") > BLOCK).select("family", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("large"))
    rows = placed.join(family, "cls").withColumn("salt", F.expr(f"CAST(pmod(xxhash64(cls, bucket), {SALTS}) AS INT)")).join(large, ["family", "salt"], "left")
    rows = rows.withColumn("only", F.when(F.col("large"), F.col("bucket")))
    rows = rows.groupBy("family", "only", "cls").agg(F.first("at").alias("at"), F.max(F.col("at") != F.col("main")).alias("few"))
    sizes = rows.groupBy("family", "only").agg(F.ceil(F.count_if("few") / BLOCK).cast("int").alias("nf"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nm")).where("nf > 0")
    rows = rows.join(sizes.withColumnsRenamed({"family": "f", "only": "o"}), F.expr("family = f AND only <=> o")).drop("f", "o").join(held, "cls")
    own = lambda n: F.expr(f"CAST(pmod(xxhash64(cls), {n}) AS INT)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["family", "only", "fb", "mb", "cls", "at", "few", "sig", "items"]
    few = rows.where("few").withColumn("fb", own("nf")).withColumn("mb", every("nm")).select(cols).toDF(*cols)
    all_ = rows.withColumn("mb", own("nm")).withColumn("fb", every("nf")).select(cols).toDF(*cols)

    def run(f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(f) and len(m):
            fs, ms = (np.frombuffer(b"".join(x.sig), np.uint32).reshape(-1, K) for x in (f, m))
            fk, mk = (np.array([band_keys(s) for s in x]) for x in (fs, ms))
            names, comp = m.cls.map(bytes).to_numpy(object), m["at"].map(bytes)
            comp_no, comp = pd.factorize(comp)
            only = None if pd.isna(f["only"].iat[0]) else int(f["only"].iat[0])
            small, sizes_ = m.few.to_numpy(bool), m["items"].map(len).to_numpy() // 8
            for i in range(len(f)):
                name, at, n = bytes(f.cls.iat[i]), bytes(f["at"].iat[i]), len(f["items"].iat[i]) // 8
                other = comp_no != (list(comp).index(at) if at in comp else -1)
                other &= 100 * np.minimum(sizes_, n) >= percent * np.maximum(sizes_, n)
                shared = mk[other] == fk[i]
                other[other] = shared.any(1) if only is None else shared.any(1) & (fk[i][shared.argmax(1)] == only)
                live = np.flatnonzero(other)
                live = live[[not small[j] or name < names[j] for j in live]] if len(live) else live
                agree = np.zeros(len(m), int)
                for r, least_ in enumerate(least):
                    rows_ = slice(r * BATCH, (r + 1) * BATCH)
                    agree[live] += (ms[live, rows_] == fs[i, rows_]).sum(1)
                    live = live[agree[live] >= least_]
                mine, done = np.frombuffer(f["items"].iat[i], np.uint64), set()
                for j in live[np.argsort(-agree[live], kind="stable")]:
                    if comp_no[j] in done:  # linked with that component already
                        continue
                    if alike(mine, np.frombuffer(m["items"].iat[j], np.uint64), percent):
                        done.add(comp_no[j])
                        a.append(min(name, names[j]))
                        b.append(max(name, names[j]))
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    keys = ["family", "only", "fb", "mb"]
    return few.groupBy(*keys).cogroup(all_.groupBy(*keys)).applyInPandas(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", width: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """One row per document: key, n_shingles, component (the smallest key reachable by links)."""
    sketches = cut(sketch(docs, key, width))
    classes = cut(sketches.where("cls IS NOT NULL").groupBy("cls").agg(F.min("key").alias("least_key"), F.min(F.struct("key", "text_hash")).alias("one"), F.any_value("bands").alias("bands")))
    postings = classes.select("cls", F.explode("bands").alias("bucket"))
    drawn = F.min_by("cls", F.xxhash64("cls", "bucket"))
    shared = postings.groupBy("bucket").agg(F.count("*").alias("n"), drawn.alias("pivot")).where("n > 1").drop("n")
    buckets = cut(postings.join(shared, "bucket"))
    held = cut(payload(docs, key, classes.select("cls", "one.key", "one.text_hash").join(buckets.select("cls").distinct(), "cls", "left_semi"), width))

    def mixed(links: DataFrame) -> DataFrame:
        """Entries of the buckets that hold several components."""
        groups = components(links).withColumnsRenamed({"id": "cls", "component_id": "at"})
        placed = buckets.join(groups, "cls", "left").withColumn("at", F.coalesce("at", "cls"))
        counts = placed.groupBy("bucket", "at").agg(F.count("*").alias("n"))
        several = counts.groupBy("bucket").agg(F.count("*").alias("k"), F.max_by("at", F.struct("n", "at")).alias("main")).where("k > 1").select("bucket", "main")
        return cut(placed.join(several, "bucket"))

    tried = cut(buckets.groupBy("cls").agg(F.min("pivot").alias("pivot")).where("pivot <> cls").select(*ordered("pivot", "cls")).distinct())
    links = cut(verify(tried, held, percent, miss))
    placed = mixed(links)
    pivots = placed.where("cls = pivot").select("bucket", F.col("at").alias("pivot_at"))
    pairs = placed.join(pivots, "bucket").where("at <> pivot_at").select(*ordered("pivot", "cls")).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(cut(verify(pairs, held, percent, miss)))
    placed = mixed(links)
    if not placed.isEmpty():
        links = links.unionByName(cut(exhaust(placed, held, percent, miss)))

    groups = components(links).withColumnsRenamed({"id": "cls", "component_id": "at"})
    at = classes.select("cls", "least_key").join(groups, "cls", "left").withColumn("at", F.coalesce("at", "cls"))
    of_class = at.join(at.groupBy("at").agg(F.min("least_key").alias("component")), "at").select("cls", "component")
    out = sketches.select("key", "n_shingles", "cls").join(of_class, "cls", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("component", "key").alias("component"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without near-duplicates (five-word shingles): of each component the smallest (doc_id, row) stays."""
    key = free_name("_key", docs.columns)
    keyed = docs.select("*", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.monotonically_increasing_id().alias("row")).alias(key))
    kept = near_duplicates(keyed.select(key, "text"), key).where(F.col(key) == F.col("component")).select(key)
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
ORACLE: dict = {}
