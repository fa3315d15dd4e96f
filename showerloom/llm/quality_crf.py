"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is labelled good or bad from its own features and those of its two neighbours; exact
forward-backward gives each line's marginal, and the document's score is their mean weighted by
line length (bytes + 1).  Lines are what ``split("\\n")`` gives, so every text has at least one.

Training: document labels are given to all lines of a document (weak supervision) and the
conditional likelihood is maximised by L-BFGS on the driver, over at most ``max_docs`` labelled
documents (the smallest hashes of their ids, so the choice does not depend on order or
partitions).  The fit alone leaves out documents with more than ``max_lines`` lines or ``max_bytes``
bytes.  Scoring has no bounds: every line of every text is used; features are computed in numpy over
blocks of text, a text longer than a block being a block of its own.

Edge cases: null or empty text is one empty line and gets a score too; a null doc_id is scored but
never learned from, and held_out is false; repeated documents are scored each; repeated labels of
a document count by their mean (1 if at least one half); without any usable label every score is
0.5; an empty table gives no rows; other columns are kept, whatever their names, and labels, lang,
source and doc_id are never inputs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, crc_mod, free_name, give_back, table

THRESHOLD = 0.7
FOLD = 4
#: byte classes: 0 other symbol, 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence mark, 6 bar, 7 beyond ASCII
CLASS = np.zeros(256, np.uint8)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r\x0b\x0c\n", 4), (b".,;:!?'\"()-", 5), (b"|", 6)):
    CLASS[list(_chars)] = _k
CLASS[128:] = 7
OWN = 20
#: own, previous and next line's features, and a constant
WIDTH = 3 * OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x WIDTH), weights of the lines, and the number of lines of each text."""
    n_lines = np.array([t.count(b"\n") + 1 for t in texts])
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    stops = np.flatnonzero(buf == 10)
    starts = np.r_[0, stops[:-1] + 1]
    size = (stops - starts).astype(float)
    kind = CLASS[buf]
    total = lambda mask: np.add.reduceat(mask.view(np.int8), starts, dtype=np.int32).astype(float)
    blank = kind == 4
    counts = [total(kind == k) for k in (0, 1, 2, 3, 5, 6, 7)]
    first = ~blank & np.r_[True, blank[:-1]]
    ends = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    begins = np.flatnonzero(first)
    length = ends - begins
    line = np.searchsorted(stops, begins)
    per = lambda mask: np.bincount(line[mask], minlength=len(stops)).astype(float)
    n_words = np.bincount(line, minlength=len(stops)).astype(float)
    closing = kind[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    opening = kind[begins] if len(begins) else np.zeros(0, np.uint8)
    middle = np.r_[False, (kind[1:] == 0) & np.isin(kind[:-1], (1, 2, 7))]
    held = np.where(blank, 0, buf).astype(np.int32)
    mass = np.add.reduceat(held, begins, dtype=np.int64) if len(begins) else np.zeros(0, np.int64)
    moment = np.add.reduceat(held * np.arange(len(buf)), begins) - begins * mass if len(begins) else mass
    again = np.r_[False, (length[1:] == length[:-1]) & (mass[1:] == mass[:-1]) & (moment[1:] == moment[:-1]) & (line[1:] == line[:-1])][: len(begins)]
    w, n = np.maximum(n_words, 1), np.maximum(size, 1)
    doc = np.repeat(np.arange(len(texts)), n_lines)
    raw = b"\n".join(texts).split(b"\n")
    ids = np.fromiter(map(hash, raw), np.int64, len(raw))
    order = np.lexsort((ids, doc))
    new = np.r_[True, (ids[order][1:] != ids[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
    group = np.cumsum(new) - 1
    repeats = np.empty(len(raw))
    repeats[order] = np.bincount(group)[group]
    tail = kind[np.maximum(stops - 1, 0)]
    own = np.column_stack([
        *(c / n for c in counts), np.log1p(size), np.log1p(n_words), per(length <= 3) / w, per(length >= 9) / w, np.bincount(line, length, len(stops)) / w / 10,
        per(closing == 0) / w, per(opening == 2) / w, per(closing == 5) / w, per(again) / w, total(middle) / w, np.log(repeats), (size == 0).astype(float), ((tail == 5) & (size > 0)).astype(float),
    ])
    edge_first = np.r_[True, doc[1:] != doc[:-1]]
    edge_last = np.r_[edge_first[1:], True]
    before = np.r_[np.zeros((1, OWN)), own[:-1]]
    after = np.r_[own[1:], np.zeros((1, OWN))]
    before[edge_first] = own[edge_first]
    after[edge_last] = own[edge_last]
    return np.hstack([own, before, after, np.ones((len(own), 1))]), size + 1, n_lines


def blocks(texts: list[bytes]):
    """Slices of the texts of about BLOCK_BYTES each; a longer text is a slice of its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > BLOCK_BYTES:
            yield slice(at, i)
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield slice(at, len(texts))


def marginals(gap: np.ndarray, n_lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact marginals of good, log partition of each chain, and expected transitions.

    gap: a line's log potential of good over bad.  Chains run side by side, longest first, so that
    step t works on those that still have a line t.
    """
    order = np.argsort(-n_lines, kind="stable")
    lens = n_lines[order]
    offset = (np.cumsum(n_lines) - n_lines)[order]
    live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right") if len(lens) else np.zeros(0, int)
    psi = np.exp(trans - trans.max())
    emit = np.column_stack([1 / (1 + np.exp(np.clip(gap, -500, 500))), 1 / (1 + np.exp(np.clip(-gap, -500, 500)))])
    log_emit = np.logaddexp(0, gap)
    alpha, beta, scale = np.empty_like(emit), np.empty_like(emit), np.empty(len(gap))
    state = np.ones((len(lens), 2))
    for t, k in enumerate(live):
        at = offset[:k] + t
        state = (state[:k] @ psi if t else state[:k]) * emit[at]
        c = state.sum(1)
        state = state / c[:, None]
        alpha[at], scale[at] = state, c
    back = np.zeros((0, 2))
    for t in range(len(live) - 1, -1, -1):
        at = offset[: live[t]] + t
        cur = np.ones((live[t], 2))
        if k := len(back):
            cur[:k] = (back * emit[at[:k] + 1] / scale[at[:k] + 1, None]) @ psi.T
        beta[at] = back = cur
    both = alpha * beta
    follow = np.ones(len(gap), bool)
    follow[np.cumsum(n_lines) - n_lines] = False
    nxt = np.flatnonzero(follow)
    pairs = psi * (alpha[nxt - 1].T @ (emit[nxt] * beta[nxt] / scale[nxt, None]))
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    log_z = np.bincount(doc, np.log(scale) + log_emit, len(n_lines)) + (n_lines - 1) * trans.max()
    return both[:, 1] / both.sum(1), log_z, pairs


def fit(x: np.ndarray, n_lines: np.ndarray, y: np.ndarray, steps: int = 60, l2: float = 1e-3) -> dict:
    """L-BFGS with backtracking on the mean negative conditional log-likelihood."""
    mean, std = x.mean(0), x.std(0)
    mean[-1], std = 0, np.where(std > 1e-9, std, 1)
    z, y_line, n = (x - mean) / std, np.repeat(y, n_lines).astype(float), len(y)
    links = np.array([[((n_lines - 1) * (1 - y)).sum(), 0], [0, ((n_lines - 1) * y).sum()]], float)

    def loss(p):
        w, trans = p[:WIDTH], p[WIDTH:].reshape(2, 2)
        gap = z @ w
        good, log_z, pairs = marginals(gap, n_lines, trans)
        value = (log_z.sum() - (gap * y_line).sum() - (links * trans).sum()) / n + l2 * (p @ p)
        return value, np.r_[z.T @ (good - y_line), (pairs - links).ravel()] / n + 2 * l2 * p

    p = np.zeros(WIDTH + 4)
    value, grad = loss(p)
    past: list = []
    for _ in range(steps):
        q, coef = grad.copy(), []
        for s, d in reversed(past):
            coef.append((s @ q) / (s @ d))
            q -= coef[-1] * d
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1, np.linalg.norm(grad))
        for (s, d), a in zip(past, reversed(coef), strict=True):
            q += (a - (d @ q) / (s @ d)) * s
        step = 1.0
        while step > 1e-6:
            new, new_grad = loss(p - step * q)
            if new <= value - 1e-4 * step * (grad @ q):
                break
            step /= 2
        else:
            break
        s, d = -step * q, new_grad - grad
        past = [*past[-7:], (s, d)] if s @ d > 1e-12 else past
        done = value - new < 1e-6
        p, value, grad = p + s, new, new_grad
        if done:
            break
    return {"w": p[:WIDTH] / std, "b": -(p[:WIDTH] * mean / std).sum(), "trans": p[WIDTH:].reshape(2, 2)}


def _bytes(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def train(documents: DataFrame, labels: DataFrame, max_docs: int = 3000, max_lines: int = 500, max_bytes: int = 1 << 20) -> dict | None:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    known = known.where(crc_mod(F.col("doc_id"), FOLD) != 2)
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))  # at most max_docs rows

    def features(batches):
        for pdf in batches:
            texts = _bytes(pdf.text)
            for s in blocks(texts):
                x, _, n = line_features(texts[s])
                yield pd.DataFrame({"good": pdf.good.iloc[s], "n": n, "x": [a.astype("f4").tobytes() for a in np.split(x, np.cumsum(n)[:-1])]})
        give_back()

    lines = F.length("text") - F.length(F.translate("text", "\n", ""))
    few = ((F.octet_length("text") <= max_bytes) & (lines < max_lines)) | F.col("text").isNull()
    got = documents.select("doc_id", "text").where(few).join(chosen, "doc_id").select("text", "good").mapInPandas(features, "good int, n int, x binary").toPandas()
    if not len(got):
        return None
    order = np.lexsort((got.x.rank(method="dense"), got.n))
    got = got.iloc[order]
    x = np.frombuffer(b"".join(got.x), "f4").reshape(-1, WIDTH).astype(float)
    return fit(x, got.n.to_numpy(), got.good.to_numpy())


def score_texts(texts: list[bytes], model: dict | None) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    for s in blocks(texts) if model is not None else ():
        x, weight, n = line_features(texts[s])
        good, _, _ = marginals(x @ model["w"] + model["b"], n, model["trans"])
        doc = np.repeat(np.arange(len(n)), n)
        out[s] = np.bincount(doc, good * weight, len(n)) / np.bincount(doc, weight, len(n))
    give_back()
    return np.clip(out, 0, 1)


def score(documents: DataFrame, model: dict | None) -> DataFrame:
    """documents with a column quality_score (replaced where there is one)."""
    others = [c for c in documents.columns if c != "quality_score"]

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(_bytes(texts), model))

    return documents.select(*others, scored("text").alias("quality_score"))


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), FOLD) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier calls good; their columns stay as they are."""
    model = train(docs, table(spark, sf_dir, "labels"))
    name = free_name("_quality", docs.columns)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(_bytes(texts), model))

    return docs.withColumn(name, scored("text")).where(F.col(name) >= THRESHOLD).drop(name)


QUERIES = {"op9_quality_crf": op9_quality_crf}
ORACLE: dict = {}
