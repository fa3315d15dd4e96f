"""URL filter: rules first, then link-graph propagation of trust and distrust over hosts.

Rules are (host, path prefix) pairs with a verdict; a rule fits its host and all subdomains where
the url's path starts with the rule's path, and the longest fitting rule wins.  Rules are
configuration, so they become one CASE expression and cost no join.

All other urls get their host's verdict.  Hosts are linked by the absolute ``href``s of their pages
(links within a host aside; repeated links add weight).  Trust is PageRank personalised on the hosts
of allowed urls, distrust the same on reversed links from the hosts of blocked urls, each seed
weighted by its urls.  Both use x = (1 - d) s + d M'x without a jump from dead ends; scaled to sum 1
that is the fixed point of the variant in which dead ends jump to the seeds.  A host is blocked
where its distrust exceeds its trust by more than ``MARGIN`` of the mean share of a host, so the verdict
doesn't hang on the number of hosts.  Paths of up to ``ROUNDS`` links count: all longer ones together would
add less than a tenth of ``MARGIN`` to the sum over all hosts, at any size.  Rounds end before where nothing
more arrives.

Only aggregates per (host, host) and per host are shuffled; the broadcasts hold two sums and a count, and the
join of pages with verdicts can be split by AQE where one host has most pages.

Edge cases: a null url or one without ``://`` has empty host and path, fits no rule and, unless
other pages link to the empty host, is allowed; null html has no links; repeated pages are judged
each and count as often as seeds and links; without seeds every rank is 0; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cut, table

BLOCK, ALLOW = "block", "allow"
#: (verdict, host, path)
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))
DAMPING, MARGIN = 0.85, 0.01
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = """(?is)href\\s*=\\s*["']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\\s>]+)"""
#: rounds between checkpoints and looks at whether anything still arrives
CUT_EVERY = 4
#: the first multiple of CUT_EVERY after which all further rounds add less than MARGIN / 10 in all
ROUNDS = CUT_EVERY * ceil(log(MARGIN / 10, DAMPING) / CUT_EVERY)


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string or null, its verdict or null)."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    return found.select(F.col("host").alias("src"), ascii_lower(F.col("dst")).alias("dst")).where("src <> dst AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def shares(rows: DataFrame, value: str) -> DataFrame:
    """rows with total, the sum of value over their kind; the kinds are two verdicts, so two sums are broadcast."""
    return rows.join(F.broadcast(rows.groupBy("kind").agg(F.sum(value).alias("total"))), "kind")


def host_ranks(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, rank) from edges (src, dst, n) and seeds (kind, host, n): forward for allow, reversed for block."""
    both = edges.select(F.lit(ALLOW).alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit(BLOCK).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    both = cut(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("p")))
    start = cut(shares(seeds, "n").select("kind", "host", ((1 - DAMPING) * F.col("n") / F.col("total")).alias("rank")))
    rank, total = start, None
    for i in range(rounds):
        flow = both.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.lit(DAMPING) * F.col("p") * F.col("rank")).alias("rank"))
        rank = start.unionByName(flow).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % CUT_EVERY == CUT_EVERY - 1:
            rank, before = cut(rank), total
            total = rank.agg(F.sum("rank")).first()[0]
            if total == before or i < CUT_EVERY and total == start.agg(F.sum("rank")).first()[0]:
                break  # ranks only grow
    return rank


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url, html)."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    seeds = ruled.where("ruled IS NOT NULL").groupBy(F.col("ruled").alias("kind"), "host").agg(F.count("*").alias("n"))
    ranks = host_ranks(links(rows), seeds, rounds)
    ranks = shares(ranks, "rank").withColumn("rank", F.col("rank") / F.col("total"))
    lean = F.sum(F.when(F.col("kind") == BLOCK, F.col("rank")).otherwise(-F.col("rank")))
    hosts = cut(ranks.groupBy("host").agg(lean.alias("lean")))
    n = hosts.agg(F.count("*").alias("n"))  # one row
    hosts = hosts.join(F.broadcast(n)).where(F.col("lean") * F.col("n") > MARGIN).select("host", F.lit(BLOCK).alias("found"))
    return ruled.join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "found", F.lit(ALLOW)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op1_url_filter": op1_url_filter}


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if out == 'rule' else v}'" for v, h, p in rules) + " END"
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    steps = "".join(
        f""", x{i} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT * FROM x0 UNION ALL
  SELECT e.kind, e.dst, {DAMPING} * e.p * x.rank FROM e JOIN x{i - 1} x ON e.kind = x.kind AND e.src = x.host) GROUP BY ALL)"""
        for i in range(1, ROUNDS + 1)
    )
    return f"""
WITH r AS (SELECT page_id, html, {lower(f"coalesce(regexp_extract(url, '{URL}', 1), '')")} AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
p AS (SELECT page_id, host, path, {case('rule')} AS rule, {case('verdict')} AS ruled FROM r),
l AS (SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM r),
n AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND dst <> '' GROUP BY ALL),
b AS (SELECT '{ALLOW}' AS kind, src, dst, n FROM n UNION ALL SELECT '{BLOCK}', dst, src, n FROM n),
e AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS p FROM b),
x0 AS MATERIALIZED (SELECT kind, host, CAST(0.15 AS DOUBLE) * n / sum(n) OVER (PARTITION BY kind) AS rank FROM (SELECT ruled AS kind, host, count(*) AS n FROM p WHERE ruled IS NOT NULL GROUP BY ALL)){steps},
h AS (SELECT host, sum(CASE WHEN kind = '{BLOCK}' THEN rank ELSE -rank END) AS lean FROM (SELECT kind, host, rank / sum(rank) OVER (PARTITION BY kind) AS rank FROM x{ROUNDS}) GROUP BY host)
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN lean * (SELECT count(*) FROM h) > {MARGIN} THEN '{BLOCK}' END, '{ALLOW}') AS verdict FROM p LEFT JOIN h ON p.host = h.host"""


ORACLE = {"op1_url_filter": _sql()}
