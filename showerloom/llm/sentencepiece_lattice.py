"""SentencePiece encoding and decoding by a relational lattice.

A text (spaces as U+2581, one in front) is cut into words where no piece of the table spans the
cut, so words are encoded alone and the result is that of the whole text.  Lattice: substrings of
each word up to the longest piece are exploded, equi-joined to the piece table (its size is the
vocabulary's, checked, so it is broadcast), edges are grouped by word, and a Spark higher-order
``aggregate`` folds them into the word's cuts.

The fold follows the model's own type.  A unigram model takes the Viterbi fold: best sum of scores
over the edges, position by position.  A BPE model defines its result by merge order, which no sum
of scores reproduces, so its fold replays the merges over the same edges: the best-scored edge that
joins two neighbours (leftmost on ties) until none is left.  Both equal the reference library's
output for their model type.

One pass over the edges by rank replays the merges wherever every piece in the lattice comes out of
its own text by such a pass.  (An edge opened late would have both ends uncrossed, so what lies
between them was merged as in the piece's own text, and the piece was joined when its rank came.)
Pieces for which that fails, as it does for runs of spaces of one score, are marked in the table; words with such an edge look for the best open
edge again after each merge.

Each distinct word of the corpus goes through the lattice about once.  Documents are dealt by a hash
of their whole row into blocks of about ``BLOCK`` bytes of text, so that blocks are the same whenever
a lost task is run again, and shuffled compressed.  A block asks for its words in packets by word hash, the lattice answers
each word to the blocks that asked for it (in lists of at most ``ASKING`` blocks), and documents meet
the answers of their block.  An answer that is missing is an error, never a guess.  The ``HEAD``
most frequent words of a sample of a fixed number of documents are encoded by the lattice first and
broadcast: they change the speed only.  A run of over ``MAX_FOLD`` characters without a cut is
segmented by the same rule in Python with a heap (BPE) or a table (unigram), as a fold over it would
be quadratic and its cuts don't fit the bits of a long.

Edge cases: null or empty text has no pieces and decodes to ""; characters outside the table become
byte pieces (or the unknown id where the model has none); U+2581 in a text decodes as a space (the
format's own rule); a very long text makes its block as long; repeated rows are encoded each; an
empty table gives no rows; other columns are kept by ``encode``, but one with the name of its output
is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import filterfalse
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, give_back, parts, table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
COARSE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
FINE = re.compile(rf"{SPACE}*[^\W\d_]+|{SPACE}+|.", re.S)
#: longest word of the fold: its cuts are the bits of a long, its places 6 bits of an edge
MAX_FOLD = 60
#: bytes of text in a block of documents; blocks in one answer of the lattice
BLOCK, ASKING = 4 << 20, 4096
SAMPLE_DOCS, HEAD = 10_000, 100_000
MOST_PIECES = 1 << 20
UNIGRAM, BPE = 1, 2
#: type numbers of pieces in the model file
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; values are ints or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            n = varint() if wire == 2 else 4 if wire == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def key_of(word: str) -> str:
    """A word's key: what stands behind its one U+2581, or a space and the word."""
    return word[1:] if len(word) > 1 and word[0] == SPACE and word[1] != SPACE else " " + word


def word_of(key: str) -> str:
    return key[1:] if key[0] == " " else SPACE + key


def strings(column: pa.Array) -> list[str]:
    """to_pylist() of strings in a tenth of its time."""
    return column.to_numpy(zero_copy_only=False).tolist()


@dataclass
class Model:
    """A piece table: ids by piece, scores by piece, bytes, unknown id, type, dummy prefix."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int] | None
    unknown: int
    kind: int
    prefix: bool
    texts: list[bytes]

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    @staticmethod
    def load(path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        ids, scores, by, unknown, kind, prefix, texts = {}, {}, {}, 0, UNIGRAM, True, []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                name, what, at = piece[1].decode(), piece.get(3, NORMAL), len(texts)
                texts.append(name.replace(SPACE, " ").encode())
                if what == USER_DEFINED:
                    raise ValueError("user-defined pieces are not supported")
                if what == NORMAL:
                    ids[name], scores[name] = at, struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                elif what == BYTE:
                    by[int(name[3:5], 16)] = at
                    texts[-1] = bytes([int(name[3:5], 16)])
                else:
                    unknown = at if what == UNKNOWN else unknown
                    texts[-1] = " ⁇ ".encode() if what == UNKNOWN else b""
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models without normalisation are supported")
        if kind not in (UNIGRAM, BPE) or len(ids) > MOST_PIECES:
            raise ValueError("unsupported model")
        return Model(ids, scores, [by[i] for i in range(256)] if len(by) == 256 else None, unknown, kind, prefix, texts)

    def keys(self, text: str | None) -> list[str]:
        """Words up to the next run of spaces, by key; no piece may have U+2581 behind another character."""
        t = (text or "").replace(SPACE, " ")
        if self.prefix and t and "  " not in t and t[0] != " " and t[-1] != " ":
            return t.split(" ")
        return [key_of(c) for c in COARSE.findall((" " * self.prefix + t).replace(" ", SPACE))] if t else []

    def split(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(different keys of the texts, their numbers key by key, each text's first and last of these and one): keys() of all texts, those with single spaces in Arrow."""
        plain = [(t or "").replace(SPACE, " ") for t in texts]
        single = np.array([self.prefix and t != "" and "  " not in t and t[0] != " " and t[-1] != " " for t in plain], bool)
        lists = pc.split_pattern(pa.array([t for t, one in zip(plain, single, strict=True) if one], pa.large_string()), " ")
        other = [self.keys(t) for t, one in zip(plain, single, strict=True) if not one]
        found = pa.concat_arrays([lists.flatten(), pa.array([k for ks in other for k in ks], pa.large_string())]).dictionary_encode()
        n = np.zeros(len(texts), np.int64)
        n[single], n[~single] = pc.list_value_length(lists).to_numpy(), list(map(len, other))
        order = np.r_[np.flatnonzero(single), np.flatnonzero(~single)]  # as the keys lie
        last = np.empty_like(n)
        last[order] = np.cumsum(n[order])
        return strings(found.dictionary), found.indices.to_numpy(), last - n, last

    @cached_property
    def bytes_of(self) -> pa.LargeBinaryArray:
        return pa.array(self.texts, pa.large_binary())

    @cached_property
    def late(self) -> frozenset[str]:
        """Pieces that one pass over the edges of their own text, by rank, doesn't put together."""
        out = []
        for piece, own in self.scores.items():
            n = len(piece)
            if n < 3:
                continue
            edges = sorted((-self.scores[x], i, j) for i in range(n - 1) for j in range(i + 2, n + 1) if (x := piece[i:j]) in self.scores and (i or j < n))
            cuts, done = set(range(n + 1)), []
            for rank, i, j in edges:
                between = [k for k in range(i + 1, j) if k in cuts]
                if i in cuts and j in cuts and len(between) == 1:
                    cuts.discard(between[0])
                    done.append(rank)
            if len(cuts) != 3 or any(rank >= -own for rank in done):
                out.append(piece)
        return frozenset(out)

    def fine(self, word: str) -> list[str]:
        """The word in parts that no piece spans."""
        if word[1:].isalpha() and len(word) <= MAX_FOLD and (word[0] == SPACE or word[0].isalpha()):
            return [word]
        runs = FINE.findall(word)
        if len(runs) == 1 and len(word) <= MAX_FOLD:
            return runs
        out: list[str] = []
        for r in runs:
            if out and out[-1][-1] + r[0] in self.inside:
                out[-1] += r
            else:
                out.append(r)
        if max(map(len, out)) <= MAX_FOLD:
            return out
        shorter = []
        for w in out:
            last = 0
            for i in range(1, len(w)):
                if w[i - 1 : i + 1] not in self.inside:
                    shorter.append(w[last:i])
                    last = i
            shorter.append(w[last:])
        return shorter

    def spell(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def segment(self, w: str) -> list[str]:
        """The word's pieces, for words too long for the fold."""
        return self._viterbi(w) if self.kind == UNIGRAM else self._merge(w)

    def _viterbi(self, w: str) -> list[str]:
        low = min(self.scores.values(), default=0) - 10
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - self.longest), j):
                s = self.scores.get(w[i:j], low if j - i == 1 else None)
                if s is not None and best[i][0] + s > best[j][0]:
                    best[j] = (best[i][0] + s, i)
        cuts, j = [], len(w)
        while j:
            cuts.append(w[best[j][1] : j])
            j = best[j][1]
        return cuts[::-1]

    def _merge(self, w: str) -> list[str]:
        n = len(w)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def offer(i):
            if i >= 0 and end[i] < n and (s := self.scores.get(w[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (-s, i, end[i], end[end[i]]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if alive[i] and end[i] == j and alive[j] and end[j] == k:
                end[i], alive[j] = k, False
                if k < n:
                    prev[k] = i
                offer(i)
                offer(prev[i])
        out, i = [], 0
        while i < n:
            out.append(w[i : end[i]])
            i = end[i]
        return out


def lattice(words: DataFrame, pieces: DataFrame, least: int, longest: int, keys: list[str], carry: list[str], edge: Column) -> DataFrame:
    """keys, word, carry, edges: the pieces of least or more characters at their places i, j, as `edge`.

    Words have two characters at least; one without an edge keeps its row (i = 0, j = least).
    """
    n = F.char_length("word")
    rows = words.select(*keys, "word", *carry, F.explode(F.sequence(F.lit(0), n - least)).alias("i"))
    rows = rows.select("*", F.explode(F.sequence(F.col("i") + least, F.least(n, F.col("i") + longest))).alias("j"))
    found = rows.withColumn("piece", F.expr("substring(word, i + 1, j - i)")).join(F.broadcast(pieces.withColumn("is_piece", F.lit(True))), "piece", "left")
    found = found.where(f"is_piece OR (i = 0 AND j = {least})")
    return found.groupBy(*keys, "word").agg(*(F.first(c).alias(c) for c in carry), F.collect_list(F.when(F.col("is_piece"), edge)).alias("edges"))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


#: an edge of a BPE lattice: rank << 13 | i << 7 | j << 1 | late
BPE_EDGE = "shiftleft(rank, 13) + i * 128 + j * 2 + late"


def _masks(e: Column) -> tuple[Column, Column]:
    """Bits i .. j and bits i, j of an edge."""
    i, j = _bit(F.shiftright(e, 7).bitwiseAND(63)), _bit(F.shiftright(e, 1).bitwiseAND(63))
    return j * 2 - i, i + j


def _open(cuts: Column, every: Column, ends: Column) -> Column:
    """Whether both ends and exactly one place between them are cuts."""
    return (cuts.bitwiseAND(ends) == ends) & (F.bit_count(cuts.bitwiseAND(every)) == 3)


def rank_fold(edges: Column, n: Column) -> Column:
    """Cuts as bits 0 .. n of a long after one pass over the edges by rank, then place; none may be late."""

    def step(cuts, e):
        every, ends = _masks(e)
        return F.when(_open(cuts, every, ends), cuts.bitwiseAND(F.bitwise_not(every - ends))).otherwise(cuts)

    return F.aggregate(F.sort_array(edges), _bit(n) * 2 - 1, step)


def merge_fold(edges: Column, n: Column) -> Column:
    """The same for all edges: the first open edge by rank, then place, is merged, again and again."""
    masks = F.transform(F.sort_array(edges), lambda e: F.struct(_masks(e)[0].alias("all"), _masks(e)[1].alias("ends")))

    def step(acc, _):
        m, es = acc["m"], acc["es"]
        open_ = F.filter(es, lambda e: _open(m, e["all"], e["ends"]))
        inner = F.get(F.transform(F.slice(open_, 1, 1), lambda e: e["all"] - e["ends"]), F.lit(0))
        return F.struct(es.alias("es"), m.bitwiseAND(F.bitwise_not(F.coalesce(inner, F.lit(0).cast("long")))).alias("m"))

    start = F.struct(masks.alias("es"), (_bit(n) * 2 - 1).alias("m"))
    return F.aggregate(F.sequence(F.lit(1), F.least(n - 1, F.size(edges))), start, step, lambda acc: acc["m"])


def viterbi_fold(edges: Column, n: Column, low: float) -> Column:
    """Cuts as bits 0 .. n of a long of the best-scored path; edges: i, j, score."""
    row = lambda score, back: F.struct(score.cast("double").alias("score"), back.cast("int").alias("back"))

    def step(acc, j):
        prior = acc["p"]
        here = F.filter(acc["e"], lambda e: e["j"] == j)
        options = F.transform(here, lambda e: row(F.get(prior, e["i"])["score"] + e["score"], -e["i"]))
        fallback = row(F.get(prior, j - 1)["score"] + F.lit(low), 1 - j)
        best = F.array_max(F.concat(options, F.array(fallback)))
        return F.struct(acc["e"].alias("e"), F.concat(prior, F.array(row(best["score"], -best["back"]))).alias("p"))

    start = F.struct(edges.alias("e"), F.array(row(F.lit(0.0), F.lit(0))).alias("p"))

    def walk(acc):
        p = acc["p"]
        pos = F.struct(n.cast("int").alias("at"), _bit(n).alias("m"))

        def back(c, _):
            before = F.get(p, c["at"])["back"]
            return F.struct(before.alias("at"), c["m"].bitwiseOR(_bit(before)).alias("m"))

        return F.aggregate(F.sequence(F.lit(1), n), pos, back, lambda c: c["m"])

    return F.aggregate(F.sequence(F.lit(1), n), start, step, walk)


def lattice_words(words: DataFrame, model: Model, keys: list[str], carry: list[str]) -> DataFrame:
    """keys, word, carry, cuts (bits) of words of 2 to MAX_FOLD characters, each once."""
    n = F.char_length("word")
    table_ = pd.DataFrame({"piece": list(model.scores), "score": list(model.scores.values())})
    table_["rank"] = table_.score.rank(method="dense", ascending=False).astype("int64")
    table_["late"] = table_.piece.isin(model.late).astype("int64") if model.kind == BPE else 0
    pieces = words.sparkSession.createDataFrame(table_, "piece string, score double, rank long, late long")
    if model.kind == BPE:
        got = lattice(words, pieces.where(F.char_length("piece") > 1).select("piece", "rank", "late"), 2, model.longest, keys, carry, F.expr(BPE_EDGE))
        late = F.exists("edges", lambda e: e.bitwiseAND(1) == 1)
        cuts = F.when(late, merge_fold(F.col("edges"), n)).otherwise(rank_fold(F.col("edges"), n))
    else:
        got = lattice(words, pieces.select("piece", "score"), 1, model.longest, keys, carry, F.struct("i", "j", "score"))
        cuts = viterbi_fold(F.col("edges"), n, min(model.scores.values(), default=0.0) - 10)
    return got.select(*keys, "word", *carry, cuts.alias("cuts"))


def pieces_of(word: str, cuts: int) -> list[str]:
    at = [i for i in range(len(word) + 1) if cuts >> i & 1]
    return [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class Words:
    """Ids of words by key, packed as int32: the broadcast head, which nothing changes."""

    def __init__(self, model: Model, head: dict[str, bytes], packets: int = 1):
        self.model, self.head, self.packets = model, head, packets

    def pack(self, pieces: list[str]) -> bytes:
        return np.array(self.model.spell(pieces), "<i4").tobytes()

    def part(self, w: str) -> bytes | None:
        """Ids of a word without cuts; None if only the lattice can tell."""
        if (got := self.head.get(w[1:] if w[0] == SPACE and w[1:2] not in ("", SPACE) else " " + w)) is not None:
            return got
        if len(w) > MAX_FOLD:
            return self.pack(self.model.segment(w))
        return self.pack([w]) if len(w) == 1 else None

    def parts(self, key: str) -> list[str]:
        """The word of a key in parts that no piece spans; the common kinds without a regular expression."""
        if len(key) < MAX_FOLD and key[0] != " ":
            if key.isalpha():
                return [SPACE + key]
            end = key[-1]
            if not end.isalnum() and key[:-1].isalpha() and key[-2:] not in self.model.inside:
                return [SPACE + key[:-1], end]
        return self.model.fine(word_of(key))

    def missing(self, texts: list[str | None]) -> tuple[dict, list[str]]:
        """lacking() of the words of the texts."""
        return self.lacking(self.model.split(texts)[0])

    def lacking(self, keys: list[str]) -> tuple[dict[str, str | list[bytes | str]], list[str]]:
        """(those of the different keys that are not in the head, with their parts: ids where known, else the part itself; parts that need the lattice, by packet)."""
        parts_: dict[str, str | list[bytes | str]] = {}
        known: dict[str, bytes | str] = {}
        for k in filterfalse(self.head.__contains__, keys):
            if len(k) < MAX_FOLD and k.isalpha():  # one part, which the head would have by this key
                w = SPACE + k
                parts_[k] = known[w] = w
                continue
            own = parts_[k] = []
            for w in self.parts(k):
                if (got := known.get(w)) is None:
                    got = known[w] = w if (ids := self.part(w)) is None else ids
                own.append(got)
        lost = [w for w, got in known.items() if type(got) is str]
        packets: list[list[str]] = [[] for _ in range(self.packets)]
        for w, p in zip(lost, self.packets_of(lost).tolist(), strict=True):
            packets[p].append(w)
        return parts_, [w for some in packets for w in sorted(some)]

    def packets_of(self, lost: list[str]) -> np.ndarray:
        coded = " ".join(lost).encode("utf-8", "surrogatepass").split(b" ") if lost else []  # no word holds a space
        return np.fromiter(map(zlib.crc32, coded), np.int64, len(lost)) % self.packets

    def ids(self, parts_: list[str], own: dict[str, bytes]) -> bytes:
        """Ids of a word; own: the answers of the lattice."""
        if len(parts_) == 1 and (got := own.get(parts_[0])) is not None:
            return got
        out = []
        for w in parts_:
            if (got := own.get(w)) is None and (got := self.part(w)) is None:
                raise ValueError(f"the lattice gave no answer for {w!r}")
            out.append(got)
        return b"".join(out)

    def encode(self, texts: list[str | None], parts_: dict, own: dict[str, bytes]) -> list[bytes]:
        """Ids of the texts of a block; parts_ from missing()."""
        return self.joined(*self.model.split(texts), parts_, own)

    def joined(self, keys: list[str], numbers: np.ndarray, first: np.ndarray, last: np.ndarray, parts_: dict, own: dict[str, bytes]) -> list[bytes]:
        """encode() of texts that split() has cut: each different word is looked up once, Arrow puts the texts together."""
        found = list(map(self.head.get, keys))
        try:
            for n, (k, ids) in enumerate(zip(keys, found, strict=True)):
                if ids is None:
                    ps = parts_[k]
                    found[n] = own[ps] if type(ps) is str else b"".join([own[p] if type(p) is str else p for p in ps])
        except KeyError as e:
            raise ValueError(f"the lattice gave no answer for {e}") from e
        ids = pa.array(found, pa.large_binary()).take(pa.array(numbers))
        ends = np.r_[0, np.cumsum(pc.binary_length(ids).to_numpy())]
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends[first].tolist(), ends[last].tolist(), strict=True)]


def head_words(docs: DataFrame, model: Model, sample_docs: int = SAMPLE_DOCS, head: int = HEAD) -> dict[str, bytes]:
    """Ids of the `head` most frequent words of about sample_docs documents, and of their parts, by key."""

    bare = Words(model, {})

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 300):  # counts of few texts at a time keep the worker small
                total: Counter = Counter()
                for t in pdf.text.iloc[at : at + 300]:
                    total.update(model.keys(t))
                yield pd.DataFrame({"word": list(total), "n": list(total.values())}).astype({"word": "str", "n": "int64"})

    def fine(batches):
        for pdf in batches:
            yield pd.DataFrame({"word": list({w for k in pdf.word for w in bare.parts(k) if 2 <= len(w) <= MAX_FOLD})}, dtype="str")

    n = max(docs.count(), 1)
    few = docs.select("text", F.monotonically_increasing_id().alias("i")).where(F.expr(f"pmod(xxhash64(i), {n}) < {sample_docs}"))
    # a table of a fixed size, whatever the corpus
    top = cut(few.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(head).select("word"))
    parts_ = top.repartition(parts(docs.sparkSession)).mapInPandas(fine, "word string").distinct()
    rows = lattice_words(parts_, model, [], []).select("word", "cuts").toArrow()
    words = Words(model, {key_of(p): np.array([i], "<i4").tobytes() for p, i in model.ids.items() if len(p) == 1})
    own = {w: words.pack(pieces_of(w, c)) for w, c in zip(rows["word"].to_pylist(), rows["cuts"].to_pylist(), strict=True)}
    made = {k: words.ids(words.parts(k), own) for k in top.toArrow()["word"].to_pylist()}  # put together from their parts
    return words.head | {key_of(w): ids for w, ids in own.items()} | made


def answers(found: DataFrame, held, block: str) -> DataFrame:
    """(block, packed): ids of asked words, from (word, cuts, at: blocks and the word's number there)."""

    def run(batches):
        for batch in batches:
            words, at = held.value, batch.column("at")
            ids = [words.pack(pieces_of(w, c)) for w, c in zip(strings(batch.column("word")), batch.column("cuts").to_numpy().tolist(), strict=True)]
            lists = np.diff(at.offsets.to_numpy())
            rows = at.flatten()
            blocks, number, word = rows.field("b").to_numpy(), rows.field("k").to_numpy(), np.repeat(np.arange(len(ids)), lists)
            order = np.argsort(blocks, kind="stable")
            ends = np.flatnonzero(np.diff(blocks[order], append=np.int64(-1)))
            names, packed, first = [], [], 0
            for end in ends + 1:
                own = order[first:end]
                some = [ids[i] for i in word[own]]
                names.append(blocks[own[0]])
                packed.append(b"".join([np.array([len(own), *map(len, some)], "<i4").tobytes(), number[own].astype("<i4").tobytes(), *some]))
                first = end
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in packed], pa.binary()), pa.array(list(map(len, packed)), pa.int64())], [block, "packed", "size"])

    return found.select("word", "cuts", "at").mapInArrow(run, f"`{block}` long, packed binary, size long")


def answered(packets, sizes, lost: list[str]) -> dict[str, bytes]:
    """Ids of the words that a block asked for."""
    own: dict[str, bytes] = {}
    for packed, size in zip(packets, sizes, strict=True):
        data = pa.decompress(packed, size, "zstd", asbytes=True)
        n = int(np.frombuffer(data, "<i4", 1)[0])
        stops = (np.cumsum(np.frombuffer(data, "<i4", n, 4)) + 4 + 8 * n).tolist()
        for k, start, stop in zip(np.frombuffer(data, "<i4", n, 4 + 4 * n).tolist(), [4 + 8 * n, *stops], stops, strict=False):
            own[lost[k]] = data[start:stop]
    if len(own) != len(lost):
        raise ValueError(f"{len(lost) - len(own)} words without an answer of the lattice")
    return own


def zipped(rows: DataFrame, size: str) -> DataFrame:
    """rows with text compressed (zstd) and its size in bytes, as documents are shuffled."""

    def run(batches):
        for batch in batches:
            at, texts = batch.schema.get_field_index("text"), [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            packed = pa.array([None if t is None else pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())
            sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield batch.set_column(at, "text", packed).append_column(size, sizes)

    fields = [T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in rows.schema]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(size, T.LongType())]))


def unzipped(packed: pa.ChunkedArray, sizes: pa.ChunkedArray) -> list[str | None]:
    return [None if b is None else pa.decompress(b, n, "zstd", asbytes=True).decode() for b, n in zip(packed.to_pylist(), sizes.to_pylist(), strict=True)]


def encode(docs: DataFrame, model: Model, out: str = "ids", keep: list[str] | None = None, sample_docs: int = SAMPLE_DOCS, head: int = HEAD, block_bytes: int = BLOCK, finish=None, kind: str = "binary") -> DataFrame:
    """docs (or the columns `keep` of it) with a column of its piece ids, packed as little-endian int32.

    finish(texts, packed), where given, makes the column (an Arrow array of the given type) from both
    within the same Python function.  docs is read several times: a table, or a frame cut from its plan.
    """
    spark = docs.sparkSession
    block = free_name("_block", [*docs.columns, out])
    size = free_name("_size", [*docs.columns, block, out])
    rows = docs.select(*(c for c in docs.columns if c != out))
    kept = rows.select(*(rows.columns if keep is None else keep)).schema
    n_blocks = ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) / block_bytes)
    packets = 8 * parts(spark)
    held = spark.sparkContext.broadcast(Words(model, head_words(docs, model, sample_docs, head), packets))  # one copy per Python worker
    hashed = ", ".join(f"`{f.name}`" for f in rows.schema if "map<" not in f.dataType.simpleString())  # maps have no hash
    rows = zipped(rows.withColumn(block, F.expr(f"pmod(xxhash64({hashed}), {n_blocks})")), size)

    def ask(rows: pa.Table) -> pa.Table:
        words = held.value
        lost = words.missing(unzipped(rows["text"], rows[size]))[1]
        numbers = words.packets_of(lost)
        first = np.flatnonzero(np.diff(numbers, prepend=-1))
        texts = [" ".join(lost[a:b]) for a, b in zip(first, [*first, len(lost)][1:], strict=True)]  # no word holds a space
        at = rows[block][0].as_py() if len(rows) else 0
        give_back()
        return pa.table({"p": pa.array(numbers[first], pa.int64()), "b": pa.array([at] * len(first), pa.int64()), "first": pa.array(first, pa.int64()), "words": pa.array(texts, pa.string())})

    asked = rows.groupBy(block).applyInArrow(ask, "p long, b long, first long, words string").repartition(parts(spark), "p")
    asked = asked.select("p", "b", "first", F.posexplode(F.split("words", " ")).alias("k", "word"))
    asked = asked.groupBy("p", "word", F.expr(f"b DIV {ASKING}").alias("chunk")).agg(F.collect_list(F.struct("b", (F.col("first") + F.col("k")).cast("int").alias("k"))).alias("at"))
    got = answers(lattice_words(asked, model, ["p", "chunk"], ["at"]), held, block)

    def meet(rows: pa.Table, got: pa.Table) -> pa.Table:
        words, texts = held.value, unzipped(rows["text"], rows[size])
        split = words.model.split(texts)
        parts_, lost = words.lacking(split[0])
        packed = words.joined(*split, parts_, answered(got["packed"].to_pylist(), got["size"].to_pylist(), lost))
        column = pa.array(packed, pa.binary()) if finish is None else finish(texts, packed)
        done = pa.table([pa.array(texts, pa.string()) if f.name == "text" else rows[f.name] for f in kept] + [column], [*kept.names, out])
        del texts, split, parts_, lost, packed
        give_back()
        return done

    schema = T.StructType([*kept, T.StructField(out, T._parse_datatype_string(kind))])
    return rows.groupBy(block).cogroup(got.groupBy(block)).applyInArrow(meet, schema)


def decode_ids(ids: np.ndarray, model: Model) -> str:
    text = b"".join(map(model.texts.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


def decodes(texts: list[str | None], packed: list[bytes], model: Model) -> list[bool]:
    """Whether decode_ids() of each text's ids gives the text; equal bytes are told from all ids at once, others one by one."""
    ends = np.r_[0, np.cumsum([len(b) // 4 for b in packed], dtype=np.int64)]
    found = model.bytes_of.take(pa.array(np.frombuffer(b"".join(packed), "<i4")))
    stops = np.r_[0, np.cumsum(pc.binary_length(found).to_numpy())][ends].tolist()
    data, space, out = memoryview(found.buffers()[2] or b""), b" " * model.prefix, []
    for k, t in enumerate(texts):
        t = (t or "").replace(SPACE, " ")
        out.append(bytes(data[stops[k] : stops[k + 1]]) == space + t.encode() or decode_ids(np.frombuffer(packed[k], "<i4").tolist(), model) == t)
    return out


@lru_cache(maxsize=4)
def load_model(path: str) -> Model:
    return Model.load(path)


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian int32), round_trip (decoding gives the text)."""
    model = load_model(model_file)

    def digest(texts, packed):
        digests = [hashlib.sha256(b).hexdigest() for b in packed]
        columns = [pa.array([len(b) // 4 for b in packed], pa.int64()), pa.array(digests, pa.string()), pa.array(decodes(texts, packed, model), pa.bool_())]
        return pa.StructArray.from_arrays(columns, ["n_pieces", "ids_sha256", "round_trip"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, model, "d", ["doc_id"], finish=digest, kind="struct<n_pieces: bigint, ids_sha256: string, round_trip: boolean>").select("doc_id", "d.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, lang, source, n_chars, n_pieces, ids of every document."""
    keep = ["doc_id", "lang", "source", "n_chars"]

    def unpacked(texts, packed):
        offsets = np.r_[0, np.cumsum([len(b) // 4 for b in packed], dtype=np.int64)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    got = encode(docs.select(*keep, "text"), load_model(model_file), "ids", keep, finish=unpacked, kind="array<int>")
    return got.select(*keep, F.size("ids").cast("long").alias("n_pieces"), "ids")


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLE: dict = {}
