"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only
its reply is under the loss mask.  Turns after the last reply (or a conversation without any
reply) give one more example without a target, so that no turn is lost.

Template: a turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Escaping is reversible: in role and
text each backslash is doubled and a backslash is put after the first character of every control
string, so no control string survives inside; in roles a line feed gets a backslash before it.
Dropping each escaping backslash restores the original exactly.

Edge cases: null text or role counts as empty; null conv_id is a conversation of its own; turns are
ordered by (turn, role, text), nulls first, and repeated rows are repeated turns; a null turn comes
first; an empty table gives no rows; other columns are ignored.  The expansion is quadratic in the
turns of a conversation by its nature; each example is a row of its own.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: control strings of this template and of other common chat templates
CONTROL = (START, END, "<|endoftext|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "</s>", "<s>")


def _java(s: str) -> str:
    return re.sub(r"([\[\]|<>/\\^$.?*+(){}])", r"\\\1", s)


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(c, "|".join(f"(?<={_java(s[0])})(?={_java(s[1:])})" for s in CONTROL), r"\\")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def format_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 1), n_turns, is_last, formatted, loss_start, loss_end.

    loss_start and loss_end are code-point offsets (from 0, end exclusive) of the escaped reply in
    formatted; both are null where the example has no target.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), role.alias("r"), escape(F.col("text")).alias("t"))
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("ts"))
    ends = F.transform("ts", lambda t, i: F.when((t["role"] == "assistant") | (i == F.size("ts") - 1), i + 1))
    rows = convs.select("conv_id", "ts", F.size("ts").alias("all"), F.posexplode(F.filter(ends, lambda x: x.isNotNull())).alias("k", "n"))
    mark = lambda t: F.concat(F.lit(START), t["r"], F.lit("\n"), t["t"], F.lit(END + "\n"))
    last = F.element_at("ts", F.col("n"))
    rows = rows.withColumn("formatted", F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("n")), mark), ""))
    stop = F.when(last["role"] == "assistant", F.length("formatted") - len(END) - 1)
    return rows.select("conv_id", (F.col("k") + 1).alias("example"), F.col("n").cast("long").alias("n_turns"), (F.col("n") == F.col("all")).alias("is_last"), "formatted", (stop - F.length(last["t"])).alias("loss_start"), stop.alias("loss_end"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    turns = []
    for piece in formatted.split(START)[1:]:
        head = re.match(r"(?:[^\\\n]|\\.)*", piece, re.S)[0]
        turns.append((unescape(head), unescape(piece[len(head) + 1 : piece.rindex(END)])))
    return turns


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted examples alone."""

    def read(batches):
        for pdf in batches:
            out = {"conv_id": pdf.conv_id, "example": pdf.example, "chars": pdf.formatted.map(len)}
            out["loss"] = [None if pd.isna(a) else unescape(x[int(a) : int(b)]) for x, a, b in zip(pdf.formatted, pdf.loss_start, pdf.loss_end, strict=True)]
            turns = [parse(x) if last else None for x, last in zip(pdf.formatted, pdf.is_last, strict=True)]
            out["n_turns"] = [None if t is None else len(t) for t in turns]
            out["turns_sha256"] = [None if t is None else hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest() for t in turns]
            yield pd.DataFrame(out).astype({"n_turns": "Int64"})

    kind = dict(examples.dtypes)["conv_id"]
    parsed = examples.mapInPandas(read, f"conv_id {kind}, example int, chars long, loss string, n_turns long, turns_sha256 string")
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "")
    got = parsed.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return got.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


QUERIES = {"op2_chat_format": op2_chat_format}


def _sql() -> str:
    """Formats and escapes as the operator does, and takes the lengths and digests of what went in."""
    esc = lambda c: f"replace({c}, '\\', '\\\\')"
    def escaped(c: str) -> str:
        out = esc(c)
        for s in CONTROL:
            out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
        return out
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({len(START) + len(END) + 2} + length(replace({escaped('role')}, chr(10), '\\' || chr(10))) + length({escaped('text')})) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


ORACLE = {"op2_chat_format": _sql()}
