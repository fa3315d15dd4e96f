"""LM scoring with a hidden Markov language model.

Tokens are words and one end mark per text.  A state emits a token class, the class emits the word:
P(w | s) = P(class(w) | s) P(w | class(w)).  Classes are the hash of the word modulo ``N_CLASSES``
(the end mark is a class of its own), so the tables of the chain have a fixed size and can be
broadcast whatever the vocabulary; P(w | class) = (c + 1) / (N_class + V_class + 1), where the
last 1 is for all unseen words of the class, comes from counts over all training documents.
As that part does not depend on the state, log P(text) is exactly the log likelihood of the class
sequence (scaled forward recursion) plus the words' own terms.

Training: ``PASSES`` full Baum-Welch iterations over every training document; each partition runs
forward-backward over its texts and emits its expected counts, which are summed by key in Spark.
The chain starts from a mixture of unigrams fitted on about ``INIT_DOCS`` documents (drawn by hash),
a starting point only.  Counts of words: every training document, summed by hash.

Word counts are looked up in two ways with one result: the ``HEAD`` most frequent words (a fixed
bound) are broadcast, all others are joined by hash.

Edge cases: null text is empty: a single end mark; a null doc_id counts as a training row; repeated
rows are scored each; equal texts score alike; a very long text is one sequence of its own, whose
arrays grow with it (24 numbers a token in training, 6 in scoring); with no training tokens all counts
are 0 and the chain is uniform; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashCache, crc_mod, cut, give_back, table, tokens, with_row_id

FOLD = 7
N_CLASSES = 8192
STATES = 6
PASSES = 2
INIT_DOCS = 1500
HEAD = 200_000
#: pseudo-counts of the class emission, spread by class frequency, and of transitions
PRIOR_EMIT, PRIOR_TRANS = 50.0, 5.0
#: tokens of the texts that run side by side
SIDE_BY_SIDE = 300_000


def encode(texts, cache: HashCache) -> list[np.ndarray]:
    return [cache.of(tokens(t)) for t in texts]


def classes(h: np.ndarray) -> np.ndarray:
    return np.append((h % np.uint64(N_CLASSES)).astype(np.int64), N_CLASSES)


def sets_of(lengths: np.ndarray):
    """Row numbers, longest first, in sets of about SIDE_BY_SIDE tokens."""
    order, at, held = np.argsort(-lengths, kind="stable"), 0, 0
    for i, k in enumerate(order):
        if i > at and held + lengths[k] > SIDE_BY_SIDE:
            yield order[at:i]
            at, held = i, 0
        held += lengths[k]
    if at < len(order):
        yield order[at:]


class Chain:
    """start (S), move (S x S) and emit (classes x S); rows of move and columns of emit sum to 1."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    def run(self, seqs: list[np.ndarray], backward: bool):
        """log likelihoods (natural) of sequences given longest first; expected counts if backward."""
        lens = np.array([len(s) for s in seqs])
        live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
        first = np.r_[0, np.cumsum(live)[:-1]]
        # by step: all texts' token 0, then token 1, ..
        of_doc = np.concatenate([np.arange(k) for k in live])
        flat, begin = np.concatenate(seqs), np.cumsum(lens) - lens
        cls = flat[begin[of_doc] + np.repeat(np.arange(len(live)), live)]
        kind = np.float32 if backward else np.float64  # counts need no more; likelihoods do
        tilt = self.move.astype(kind)
        e = self.emit.astype(kind)[cls]
        alpha, scale = np.empty_like(e) if backward else None, np.empty(len(e), kind)
        state = self.start.astype(kind)
        for f, k in zip(first, live, strict=True):
            state = (state[:k] @ tilt if f else state) * e[f : f + k]
            c = state.sum(1)
            state = state / c[:, None]
            scale[f : f + k] = c
            if backward:
                alpha[f : f + k] = state
        ll = np.bincount(of_doc, np.log(scale), len(seqs))
        if not backward:
            return ll, None
        weighed = e / scale[:, None]
        beta = np.ones_like(e)
        for t in range(len(live) - 2, -1, -1):
            f, g, k = first[t], first[t + 1], live[t + 1]
            beta[f : f + k] = (beta[g : g + k] * weighed[g : g + k]) @ tilt.T
        gamma = alpha * beta
        emit = np.column_stack([np.bincount(cls, gamma[:, s], len(self.emit)) for s in range(gamma.shape[1])])
        later = np.arange(live[0], len(e))
        prev = np.repeat(first[:-1], live[1:]) + of_doc[later] if len(later) else later
        move = self.move * (alpha[prev].T @ (beta[later] * weighed[later]))
        return ll, (gamma[: live[0]].sum(0), move, emit)

    @staticmethod
    def from_counts(start, move, emit) -> Chain:
        share = emit.sum(1, keepdims=True) + 1e-3
        emit = emit + PRIOR_EMIT * share / share.sum()
        start, move = start + PRIOR_TRANS, move + PRIOR_TRANS
        return Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def first_chain(seqs: list[np.ndarray], seed: int = 5) -> Chain:
    """States as the parts of a mixture of unigrams over whole texts, with a tendency to stay."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(seqs), N_CLASSES + 1), np.float32)
    for row, s in zip(x, seqs, strict=True):
        np.add.at(row, s, 1)
    part = rng.dirichlet(np.full(STATES, 0.3), len(seqs)).astype(np.float32) if len(seqs) else np.zeros((0, STATES), np.float32)
    for _ in range(12):
        emit = (x.T @ part).astype(float) + 1e-3
        emit += PRIOR_EMIT * emit.sum(1, keepdims=True) / emit.sum()
        logs = x @ np.log(emit / emit.sum(0)).astype(np.float32) + np.log(part.sum(0) + 1.0)
        logs = np.exp((logs - logs.max(1, keepdims=True)) / 4) if len(seqs) else logs
        part = (logs / logs.sum(1, keepdims=True)).astype(np.float32)
    emit = (x.T @ part).astype(float)
    mass = emit.sum(0) + 1
    return Chain.from_counts(part.sum(0).astype(float), np.diag(mass * 0.9) + 0.1 * np.outer(mass, mass / mass.sum()), emit)


def count_words(train: DataFrame) -> DataFrame:
    """(word, c): 64-bit hash of each word of the training texts and its count."""

    def run(batches):
        cache = HashCache()
        for pdf in batches:
            arrays = encode(pdf.text, cache)
            word, c = np.unique(np.concatenate(arrays), return_counts=True) if arrays else (np.zeros(0, np.uint64), np.zeros(0, int))
            yield pd.DataFrame({"word": word.view(np.int64), "c": c})

    return train.select("text").mapInPandas(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most `most` of the most frequent words: all above a count that a histogram gives."""
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = sorted(counts.groupBy(step.alias("b")).count().collect(), key=lambda r: -r["b"])  # a few hundred at most
    least, held = 1 << 30, 0
    for r in bins:
        held += r["count"]
        if held > most:
            break
        least = r["b"]
    return counts.where(step >= least)


def baum_welch(train: DataFrame, chain: Chain) -> Chain:
    """One iteration over all training texts."""
    held = train.sparkSession.sparkContext.broadcast(chain)  # (N_CLASSES + 1) x STATES numbers

    def run(batches):
        cache, total = HashCache(), None
        for pdf in batches:
            seqs = [classes(h) for h in encode(pdf.text, cache)]
            for rows in sets_of(np.array([len(s) for s in seqs])):
                _, got = held.value.run([seqs[i] for i in rows], True)
                total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            start, move, emit = total
            every = np.vstack([start[None], move, emit])
            yield pd.DataFrame({"k": np.arange(len(every)), **{f"s{i}": every[:, i] for i in range(STATES)}})
        give_back()

    cols = [f"s{i}" for i in range(STATES)]
    summed = train.select("text").mapInPandas(run, "k int, " + ", ".join(f"{c} double" for c in cols)).groupBy("k").agg(*(F.sum(c).alias(c) for c in cols))
    got = summed.toPandas().set_index("k").reindex(range(1 + STATES + N_CLASSES + 1), fill_value=0.0)[cols].to_numpy()
    return Chain.from_counts(got[0], got[1 : 1 + STATES], got[1 + STATES :])


def learn(train: DataFrame, n_docs: int, id_col: str = "doc_id") -> Chain:
    few = train.where(F.expr(f"pmod(xxhash64(`{id_col}`, text), {max(n_docs, 1)}) < {INIT_DOCS}")).orderBy(F.xxhash64("text")).select("text").limit(2 * INIT_DOCS)

    def run(batches):
        cache = HashCache()
        for pdf in batches:
            yield pd.DataFrame({"s": [classes(h).astype("<u2").tobytes() for h in encode(pdf.text, cache)]})

    chain = first_chain([np.frombuffer(s, "<u2").astype(np.int64) for s in few.mapInPandas(run, "s binary").toPandas().s])
    for _ in range(PASSES):
        chain = baum_welch(train, chain)
    return chain


def score(documents: DataFrame, train: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for every document; train: id, text; other columns are left out."""
    documents, train = documents.select(id_col, "text"), train.select(id_col, "text")
    sc = documents.sparkSession.sparkContext
    n_docs = train.count()
    chain = learn(train, n_docs, id_col)
    counts = cut(count_words(train))
    head = most_frequent(counts, HEAD).toPandas().sort_values("word")
    by_class = counts.groupBy(F.expr(f"CAST(pmod(word, {N_CLASSES}) AS INT)").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas().set_index("k").reindex(range(N_CLASSES), fill_value=0)
    big_n, big_v = int(by_class.n.sum()) + n_docs, int(by_class.v.sum()) + (n_docs > 0)
    own = np.append(np.log10(by_class.n.to_numpy() + by_class.v.to_numpy() + 1.0), 0.0)
    held = sc.broadcast((head.word.to_numpy(np.int64), np.log10(head.c.to_numpy(float) + 1), chain, own, n_docs))

    def run(batches):
        cache = HashCache()
        word, weight, chain, own, n_docs = held.value
        for pdf in batches:
            arrays = encode(pdf.text, cache)
            seqs = [classes(h) for h in arrays]
            ll = np.empty(len(seqs))
            for rows in sets_of(np.array([len(s) for s in seqs])):
                ll[rows] = chain.run([seqs[i] for i in rows], False)[0] / np.log(10)
            known, logs, tails = [], [], []
            for h in arrays:
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(word, h), max(len(word) - 1, 0))
                hit = word[at] == h if len(word) else np.zeros(len(h), bool)
                known.append(int(hit.sum()))
                logs.append(float(weight[at[hit]].sum()))
                tails.append(h[~hit])
            yield pd.DataFrame({"_rid": pdf._rid, "id": pdf.id, "n_tokens": [len(s) for s in seqs], "head_known": known, "head_logs": logs, "chain": ll - [own[s].sum() for s in seqs], "tail": tails})
        give_back()

    kind = documents.schema[id_col].dataType.simpleString()
    rows = with_row_id(documents.select(F.col(id_col).alias("id"), "text")).select("_rid", "id", "text")
    first = cut(rows.mapInPandas(run, f"_rid long, id {kind}, n_tokens long, head_known long, head_logs double, chain double, tail array<long>"))
    tail = first.select("_rid", F.explode("tail").alias("word")).join(counts, "word").groupBy("_rid").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("tail_logs"))
    both = first.drop("tail").join(tail, "_rid", "left")
    logs = F.col("head_logs") + F.coalesce("tail_logs", F.lit(0.0))
    end = float(np.log10(n_docs + 1))
    return both.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + int(n_docs > 0)).alias("n_known"), F.lit(big_n).cast("long").alias("train_tokens"),
        (logs + end - F.col("n_tokens") * float(np.log10(big_n + 1.0 * (big_v + 1)))).alias("base_score"), (F.col("chain") + logs).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), FOLD) == 2, F.lit(False))
    out = score(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLE: dict = {}
