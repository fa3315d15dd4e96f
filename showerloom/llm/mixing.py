"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source.  A node's capacity is ``max_epochs`` times the tokens below
it.  The token budget goes down the tree: at each node it is dealt to the children in proportion to
their weights; what a child cannot take goes to its siblings, and only what a whole family cannot
take goes to the family's siblings (their common ancestor sees the family's capacity).  Per family
this is water-filling, child i gets min(capacity, L * weight); sorted by capacity / weight, L is the
largest of (budget - capacities before k) / (weights from k on), so three window passes over the
node tables give it without iteration.

A leaf with budget b and t tokens takes floor(b / t) whole epochs and a prefix of the next one: its
documents in the order of md5(seed, epoch, doc_id) while their running token sum stays within the
rest.  Running sums of a large leaf are not taken in one task: documents are summed by the first
three hex digits of their md5, the digits that hold the end of the prefix are found per leaf, and
only documents with those digits are sorted.

Edge cases: null or unlisted languages, sources and domains are nodes with weight 1 (null is the
node ""); weight 0 leaves a node out; null or empty texts have no tokens and cost nothing; a null
doc_id is hashed as ""; repeated rows count each, ties of their running sums in any order; a very
long text is one document of many tokens; an empty table gives no rows; other columns are carried
along, but ``mix`` replaces those with the names it returns (``MADE``); the stage keeps these too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import TOKEN, cut, free_name, table

#: first source number of each domain
DOMAINS = (("web", 0), ("reference", 10), ("forum", 15))
DOMAIN_WEIGHTS = {"web": 5, "reference": 3, "forum": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 3, "src12": 2}
BUDGET_PERCENT = 80
MAX_EPOCHS = 4
SEED = "mix-1"
LEVELS = ["_domain", "_lang", "_source"]
#: columns that ``mix`` returns, and those that it joins on the way
MADE = (*LEVELS, "_tokens", "_epoch")
INNER = ("_mark", "_part", "_run", "_inside", "full", "rest", "end", "tokens", "budget")
#: node tables of up to so many leaves are broadcast; larger ones are joined by shuffle
FEW_LEAVES = 10_000


def domain_of(source: Column) -> Column:
    n = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int")
    out = F.when(n.isNull(), "")
    for name, first in reversed(DOMAINS):
        out = out.when(n >= first, name)
    return out.otherwise("")


def weight(c: str, weights: dict[str, int]) -> Column:
    out = F.lit(None)
    for k, v in weights.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return F.coalesce(out, F.lit(1)).cast("long")


def deal(nodes: DataFrame, parents: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """nodes (parents, name, cap, budget of the parent as _b) with their own budget in _b."""
    family = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = family.orderBy(F.col("cap") / F.col("w"), name)
    rows = nodes.withColumn("w", weight(name, weights)).where("w > 0")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = F.max("level").over(family)
    rows = rows.withColumn("level", (F.col("_b") - before) / onward)
    return rows.withColumn("_b", F.least(F.col("cap").cast("double"), level * F.col("w"))).drop("w", "level")


def budgets(leaves: DataFrame, percent: int, max_epochs: int) -> DataFrame:
    """leaves (LEVELS, tokens) with budget, full (epochs) and rest (of the next one)."""
    wd, wl, ws = (weight(c, x) for c, x in zip(LEVELS, (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), strict=True))
    leaves = leaves.where((wd > 0) & (wl > 0) & (ws > 0)).withColumn("cap", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap"))
    domains = leaves.groupBy("_domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("t"))
    total = F.sum("t").over(W.partitionBy(F.lit(0)))
    domains = deal(domains.withColumn("_b", (total * percent / 100).cast("double")), [], "_domain", DOMAIN_WEIGHTS)
    langs = deal(langs.join(domains.select("_domain", "_b"), "_domain"), ["_domain"], "_lang", LANG_WEIGHTS)
    leaves = deal(leaves.join(langs.select("_domain", "_lang", "_b"), ["_domain", "_lang"]), ["_domain", "_lang"], "_source", SOURCE_WEIGHTS)
    full = F.coalesce(F.floor(F.try_divide(F.col("_b"), F.col("tokens").cast("double"))), F.lit(0)).cast("long")
    return leaves.select(*LEVELS, "tokens", F.col("_b").alias("budget"), full.alias("full")).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with other names for columns that the work itself needs, and the way back."""
    names = {c: free_name(f"kept_{c}", docs.columns) for c in docs.columns if c.lower() in {*MADE, *INNER}}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def mix(docs: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs' rows once per epoch in which they are taken, with _domain, _lang, _source, _tokens, _epoch (in place of docs' own)."""
    docs, back = set_aside(docs.drop(*(c for c in docs.columns if c.lower() in MADE)))
    return dealt(docs, percent, max_epochs, seed).withColumnsRenamed(back)


def dealt(docs: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    names = [F.coalesce(domain_of(F.col("source")), F.lit("")).alias("_domain"), F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source")]
    rows = docs.select(*docs.columns, *names, F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("_tokens"))
    leaves = cut(budgets(rows.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens")), percent, max_epochs))
    few = leaves.count() <= FEW_LEAVES
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))

    def placed(leaves):
        return rows.join(F.broadcast(leaves) if few else leaves, LEVELS).withColumn("_mark", mark).withColumn("_part", F.substring("_mark", 1, 3))

    sums = placed(leaves).groupBy(*LEVELS, "_part").agg(F.sum("_tokens").alias("n"), F.first("rest").alias("rest"))
    run = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("_part").rowsBetween(W.unboundedPreceding, 0))
    over = sums.withColumn("run", run).where("run > rest").groupBy(*LEVELS).agg(F.min(F.struct("_part", (F.col("run") - F.col("n")).alias("before"))).alias("end"))
    leaves = cut(leaves.join(over, LEVELS, "left").select(*LEVELS, "full", "rest", "end"))
    rows_at = placed(leaves)
    last = rows_at.where("_part = end._part")
    running = F.sum("_tokens").over(W.partitionBy(*LEVELS).orderBy("_mark", F.col("doc_id").asc_nulls_first(), "_tokens").rowsBetween(W.unboundedPreceding, 0))
    last = last.withColumn("_run", running + F.col("end.before")).where("_run <= rest").select(*rows.columns, F.col("full").alias("_epoch"))
    inside = F.when(F.col("end").isNull() | (F.col("_part") < F.col("end._part")), F.col("full")).otherwise(F.col("full") - 1)
    whole = rows_at.withColumn("_inside", inside).where("_inside >= 0").select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), "_inside")).alias("_epoch"))
    return whole.unionByName(last)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return taken.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in the target mixture; a document taken in several epochs comes as often."""
    rows, back = set_aside(docs)
    return dealt(rows).select(*rows.columns).withColumnsRenamed(back)


QUERIES = {"op8_mixing": op8_mixing}


def _case(c: str, weights: dict[str, int]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _deal(source: str, parents: str, name: str, weights: dict[str, int]) -> str:
    """SELECT that deals _b of each family of the relation among its nodes."""
    by = f"PARTITION BY {parents}" if parents else ""
    return f"""SELECT * EXCLUDE (_b, w, lv), least(CAST(cap AS DOUBLE), max(lv) OVER ({by}) * w) AS _b FROM (
  SELECT *, (_b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM (SELECT *, {_case(name, weights)} AS w FROM ({source})) WINDOW o AS ({by} ORDER BY cap / w, {name}))"""


_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE {' '.join(f"WHEN n >= {first} THEN '{name}'" for name, first in reversed(DOMAINS))} ELSE '' END AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS BIGINT) AS n_tokens
  FROM (SELECT *, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n FROM documents)),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) AS cap FROM d GROUP BY ALL),
dom AS ({_deal(f"SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CAST(sum(sum(tokens)) OVER () * {BUDGET_PERCENT} / 100 AS DOUBLE) AS _b FROM leaf GROUP BY domain", "", "domain", DOMAIN_WEIGHTS)}),
lng AS ({_deal("SELECT l.*, dom._b FROM (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY ALL) l JOIN dom USING (domain)", "domain", "lang", LANG_WEIGHTS)}),
src AS ({_deal("SELECT leaf.*, lng._b FROM leaf JOIN lng USING (domain, lang)", "domain, lang", "source", SOURCE_WEIGHTS)}),
b AS (SELECT domain, lang, source, CAST(coalesce(floor(_b / nullif(tokens, 0)), 0) AS BIGINT) AS "full", tokens, _b FROM src),
r AS (SELECT d.*, "full", _b - "full" * tokens AS rest, md5('{SEED}|' || "full" || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM d JOIN b USING (domain, lang, source)),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY mark, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, "full" + CASE WHEN run <= rest THEN 1 ELSE 0 END)) AS epoch FROM p"""

ORACLE = {"op8_mixing": _SQL}
