"""Edge cases and brute force for the training-data operators, on small literals."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerloom.llm import ann_search, chat_format, embedding_dedup, license_scan, lm_score, minhash_dedup, mixing, quality_crf, url_filter
from showerloom.llm import sentencepiece_lattice as spl
from showerloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def docs(spark, texts, **extra):
    rows = [(i, t, ("en", None, "de")[i % 3], ("src0", None, "src12", "odd")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


TEXTS = [None, "", " \n\t ", "one", "one two", "The cat. Sat\non the mat.", "The cat. Sat\non the mat.", LONG, "é ü 😀 \x00", "a\n\n\nb"]
INNER = {"full": 5, "end": 6, "_epoch": 7, "_domain": "x", "_Part": 9, "rest": 1, "tokens": 2}
CLASH = {"_rid": 1, "cls": 2, "key": 3, "_tokens": 4, "ids": 5, "_quality": 6, "id": 7, "v": 8}


# chat formatting

def test_escape_and_parse_round_trip(spark):
    nasty = ["".join(random.Random(i).choices(["<s>", "</s>", "[INST]", "\\", "<|im_end|>", "<", "|im_start|>", "\n", "x", "<<SYS>>", "é"], k=12)) for i in range(40)]
    rows = [(i // 4, i % 4, ("user", "assistant", None, "sys\ntem<s>")[i % 4], t) for i, t in enumerate(nasty)] + [(None, None, "assistant", None), (77, 0, "user", "only"), (78, 0, "assistant", ""), (78, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    ex = chat_format.format_examples(df).collect()
    for e in ex:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == e.conv_id), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))][: e.n_turns]
        assert chat_format.parse(e.formatted) == want
        assert all(e.formatted.count(s) == (e.n_turns if s.startswith("<|im") else 0) for s in chat_format.CONTROL)
        if e.loss_start is not None:
            assert chat_format.unescape(e.formatted[e.loss_start : e.loss_end]) == want[-1][1] and want[-1][0] == "assistant"
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_examples(df)).collect()}
    assert got[77].loss_chars == 0 and got[77].n_turns == 1 and got[78].n_turns == 2 and len(got) == 13
    assert chat_format.read_back(chat_format.format_examples(df.limit(0))).count() == 0


def test_chat_query_against_sql(spark, small, duck, same):
    same(chat_format.op2_chat_format(spark, small), duck, chat_format.ORACLE["op2_chat_format"])


# url filter

def test_urls_and_rules(spark):
    rows = [(1, "HTTP://WWW.Example.NET/en/1?x#y", None), (2, "http://a.net/de/", ""), (3, "https://m.example.com/de/1", None), (4, "x://org/fr/", None), (5, "http://a.net", None), (6, None, None), (7, "no scheme/", None), (8, "", None), (9, "http://notexample.com/de/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[1] == ("www.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("a.net", "/de/", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][:3] == ("a.net", "", None) and got[6] == got[7] == got[8] == ("", "", None, "allow") and got[9][2] is None
    assert url_filter.judge(df.limit(0)).count() == 0


def test_distrust_flows_back_and_trust_forward(spark):
    link = lambda h: f"<A HREF = '//{h}/x'>"
    rows = [(1, "http://bad.net/x", ""), (2, "http://farm.io/1", link("bad.net") * 3), (3, "http://x.org/fr/1", link("good.io")), (4, "http://good.io/", link("bad.net")), (5, "http://far.io/", link("farm.io")), (6, "http://alone.io/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow"}


def test_distrust_reaches_hosts_far_from_the_seed(spark):
    rows = [(0, "http://bad.net/x", "")] + [(i, f"http://h{i}.io/", f"<a href='//{'bad.net' if i == 1 else f'h{i - 1}.io'}/'>") for i in range(1, 21)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.verdict for r in url_filter.judge(df).collect()} == {"block"}
    ring = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("allow", "a", 1)], "kind string, host string, n long")
    got = {r.host: r["rank"] for r in url_filter.host_ranks(ring, seeds, 144).collect()}
    assert math.isclose(got["a"], 0.15 / (1 - 0.85**2), abs_tol=1e-9) and math.isclose(got["a"] + got["b"], 1, abs_tol=1e-9)


def test_ranks_against_dense_iteration(spark):
    rng = random.Random(3)
    hosts = [f"h{i}" for i in range(12)]
    e = Counter((rng.choice(hosts), rng.choice(hosts)) for _ in range(40))
    e = {k: v for k, v in e.items() if k[0] != k[1]}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in e.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([("allow", "h0", 3), ("allow", "h1", 1), ("block", "h2", 1)], "kind string, host string, n long")
    got = {(r.kind, r.host): r["rank"] for r in url_filter.host_ranks(edges, seeds).collect()}
    for kind, s in (("allow", {"h0": 0.75, "h1": 0.25}), ("block", {"h2": 1.0})):
        way = {(a, b): n for (a, b), n in e.items()} if kind == "allow" else {(b, a): n for (a, b), n in e.items()}
        out = Counter()
        for (a, _), n in way.items():
            out[a] += n
        x = {h: 0.15 * s.get(h, 0) for h in hosts}
        for _ in range(url_filter.ROUNDS):
            x = {h: 0.15 * s.get(h, 0) + 0.85 * sum(x[a] * n / out[a] for (a, b), n in way.items() if b == h) for h in hosts}
        assert all(math.isclose(got.get((kind, h), 0), x[h], abs_tol=1e-12) for h in hosts)


def linked_pages(spark, hosts=90, pages=600):
    """Pages of hosts that link to one another with absolute links; a few hosts are seeds, one has a third of the pages."""
    rng = random.Random(8)
    name = lambda: rng.choice([f"h{rng.randrange(hosts)}.io", "hub.io", "hub.io", f"s{rng.randrange(4)}.net", f"t{rng.randrange(4)}.org", "H3.IO"])
    link = lambda: rng.choice([f"<a href='https://{name()}/p'>", f'<a href="//{name()}">', "<a href='/local'>", f"HREF = http://{name()}/x"])
    rows = [(i, f"http://{name()}{rng.choice(['/fr/', '/en/', '/', ''])}{i}", "".join(link() for _ in range(rng.randrange(5)))) for i in range(pages)]
    return spark.createDataFrame([*rows, (pages, None, None), (pages + 1, "http://hub.io/", None), *rows[:20]], "page_id long, url string, html string")


def test_linked_pages_against_sql(spark, same, tmp_path):
    import duckdb

    df = linked_pages(spark)
    df.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    got = url_filter.judge(df)
    same(got, con, url_filter.ORACLE["op1_url_filter"])
    found = Counter(r.verdict for r in got.where("rule IS NULL").collect())
    assert found["block"] > 20 and found["allow"] > 20


def test_verdicts_do_not_hang_on_the_number_of_hosts(spark):
    """The same small webs, once and many times over: shares of a host shrink, verdicts stay."""
    def web(copies):
        rows = []
        for c in range(copies):
            rows += [(8 * c, f"http://bad{c}.net/", ""), (8 * c + 1, f"http://near{c}.io/", f"<a href='//bad{c}.net'>"), (8 * c + 2, f"http://far{c}.io/", f"<a href='//near{c}.io'>"), (8 * c + 3, f"http://x{c}.org/fr/", f"<a href='//good{c}.io'>"), (8 * c + 4, f"http://good{c}.io/", f"<a href='//bad{c}.net'>")]
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    one, many = ({r.page_id: r.verdict for r in url_filter.judge(web(n)).collect()} for n in (1, 300))
    assert one[2] == "block" and all(v == one[k % 8] for k, v in many.items())


def test_url_query_against_sql(spark, small, duck, same):
    same(url_filter.op1_url_filter(spark, small), duck, url_filter.ORACLE["op1_url_filter"])


# license scan

def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"]
    words = mit.split()
    damaged = " ".join(w if i not in (11, 40) else "XX" for i, w in enumerate(words))
    texts = [*TEXTS, f"intro words here {mit} and more", f"x {damaged} y", "released UNDER the mit license!", "Released under the BSD license", "Licensed under CC BY-NC 4.0. Released under the MIT License. Released under the MIT License."]
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan(docs(spark, texts, **CLASH)).collect()}
    assert got[10, "MIT"] == 1 and 0.8 <= got[11, "MIT"] < 1 and got[12, "MIT-notice"] == 1
    assert {k for k in got if k[0] == 14} == {(14, "MIT-notice"), (14, "CC-BY-NC-4.0-notice")} and not any(k[0] < 10 or k[0] == 13 for k in got)
    assert license_scan.scan(docs(spark, [None]).limit(0)).count() == 0


def test_short_license_templates_are_refused(spark):
    with pytest.raises(ValueError, match="ARR"):
        license_scan.scan(docs(spark, TEXTS), templates={"ARR": "All rights reserved.", **license_scan.TEMPLATES})


def test_license_query_against_sql(spark, small, duck, same):
    same(license_scan.op3_license_scan(spark, small), duck, license_scan.ORACLE["op3_license_scan"])


def test_license_probability():
    for text in license_scan.TEMPLATES.values():
        n = len(license_scan.template_shingles(text))
        _, length, _ = license_scan.size_class(n)
        jaccard = 0.8 * n / (length + 0.2 * n)
        assert n == 1 or (1 - jaccard) ** license_scan.BANDS < 2e-6


# vectors

def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_rid", F.lit(1)).withColumn("v", F.lit("clash"))


UNUSABLE = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [1.0, 2.0]), (905, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]


@pytest.mark.parametrize(("functions", "probes"), [(None, None), (1, 9), (2, None)])
def test_search_against_brute_force(spark, functions, probes):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(260, 8)) * rng.uniform(0.5, 3, (260, 1))
    x[100:130] = x[100]
    extra = [*UNUSABLE, (20, x[20].tolist())]  # a repeated id
    got = ann_search.search(vectors(spark, x, extra), (F.col("vec_id") % 20 == 0) & (F.col("vec_id") != 20), functions=functions, probes=probes).collect()
    ids, all_ = [*range(260), 20], np.vstack([x, x[20]])
    hit = total = 0
    for q in (i for i in range(0, 260, 20) if i != 20):
        s = np.einsum("ij,j->i", all_, x[q])
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        mine = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == 20 and all(math.isclose(s[v], w, rel_tol=1e-12) for v, w in mine) and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        want = Counter(ids[i] for i in order)
        hit, total = hit + sum((want & Counter(v for v, _ in mine)).values()), total + 20
    assert hit / total >= 0.9 and {r.query_id for r in got} == {i for i in range(0, 260, 20) if i != 20}


def recall(spark, x, every, **settings):
    """(recall, share of queries with k found) of what the tables alone meet."""
    rows = ann_search.rows_of(vectors(spark, x), F.col("vec_id") % every == 0)
    found = {}
    for r in ann_search.met_by_tables(rows, 20, **settings).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hit = 0
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(found.get(q, [])))
    return hit / (20 * len(range(0, len(x), every))), np.mean([len(v) == 20 for v in found.values()])


@pytest.mark.parametrize(("n", "settings"), [(2000, {}), (10_000, {}), (2000, {"functions": 2})])
def test_recall_of_the_tables_alone(spark, n, settings):
    x = np.random.default_rng(n).normal(size=(n, 64))
    got, full = recall(spark, x / np.linalg.norm(x, axis=1)[:, None], 100, **settings)
    assert got >= 0.9 and full == 1


def test_recall_comes_from_the_buckets(spark):
    """One table with one probe meets its bucket alone: what is found is what is hashed there."""
    x = np.random.default_rng(5).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    few, _ = recall(spark, x, 100, tables=1, functions=1, probes=1)
    unit = ann_search.directions(x)
    own = ann_search.buckets(unit, 0, 1, 1)[:, 0]
    want = 0
    for q in range(0, 3000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        want += (own[np.argsort(-s)[:20]] == own[q]).sum()
    assert math.isclose(few, want / 600, abs_tol=1e-9) and few < 0.5


def test_settings_follow_the_neighbours():
    rng = np.random.default_rng(9)
    y, rows = rng.normal(size=(64, 64)), rng.normal(size=(2000, 64))
    near, far = (np.repeat(y, 20, 0) + w * rng.normal(size=(1280, 64)) for w in (0.3, 2.0))
    q, unit = np.repeat(np.arange(64), 20), ann_search.directions
    small = ann_search.choose(unit(y), q, unit(near), unit(rows), 10_000, 14)
    assert small == ann_search.choose(unit(y), q, unit(near), unit(rows), 10_000, 14) and small[0] == 1
    wide = ann_search.choose(unit(y), q, unit(far), unit(rows), 10_000, 14, None, ann_search.MOST)
    assert wide is None or wide[2] > 14 or wide[1] > small[1]
    assert ann_search.choose(unit(y), q, unit(near), unit(rows), 10**9, 14)[0] == 2  # many rows: finer buckets pay


def test_search_of_few(spark):
    x = np.eye(8)[:3]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann_search.search(vectors(spark, x, UNUSABLE), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    assert ann_search.search(vectors(spark, x).limit(0), F.lit(True)).count() == 0 and ann_search.search(vectors(spark, x[:1]), F.lit(True)).count() == 0


@pytest.mark.parametrize("norms", ["one long", "lognormal", "even"])
def test_search_of_uneven_norms(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= {"one long": np.where(np.arange(3000) == 7, 1000, 1), "lognormal": rng.lognormal(0, 1, 3000), "even": np.ones(3000)}[norms][:, None]
    got, full = recall(spark, x, 100)
    assert got >= 0.9 and full == 1


def test_search_of_queries_that_meet_nothing(spark):
    x = np.random.default_rng(7).normal(size=(2000, 16)) * 0.05 + 1
    x[0] = -np.random.default_rng(8).normal(size=16) ** 2 - 1
    got = [r.vec_id for r in ann_search.search(vectors(spark, x), F.col("vec_id") == 0, functions=1, probes=1, tables=2).orderBy("rank").collect()]
    s = np.einsum("ij,j->i", x, x[0])
    assert got == [i for i in np.lexsort((np.arange(2000), -s)) if i][:20]


def test_embedding_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    x = np.repeat(centres, 8, 0) + rng.normal(size=(160, 8)) * 0.12
    x[40:60] = x[40]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors(spark, x, UNUSABLE)).collect() if r.vec_id is not None}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    mask = u @ u.T >= 0.9
    np.fill_diagonal(mask, False)
    found = np.array([got[i].n_links for i in range(160)])
    assert (found <= mask.sum(1)).all() and found.sum() >= 0.97 * mask.sum()
    root = embedding_dedup.roots(mask)
    assert np.mean([got[i].component_id == root[i] for i in range(160)]) > 0.97
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 906))
    assert embedding_dedup.near_duplicates(vectors(spark, x).limit(0)).count() == 0


@pytest.mark.parametrize("shift", [0.0, 1.0, 3.0])
def test_embedding_tables_meet_pairs_at_the_threshold(shift):
    rng = np.random.default_rng(4)
    some = lambda: rng.normal(size=(3000, 64)) + shift * 8 * np.eye(64)[0]
    x, u = some(), embedding_dedup.unit(some())
    for n in (10_000, 100_000_000):
        b, rotations = embedding_dedup.plan(x, n, 0.9)
        for way in (rng.normal(size=u.shape), embedding_dedup.unit(some())):
            y = 0.9 * u + math.sqrt(0.19) * embedding_dedup.unit(way - (way * u).sum(1, keepdims=True) * u)
            hit = [(embedding_dedup.keys_of(embedding_dedup.bits_of(u, r), b) == embedding_dedup.keys_of(embedding_dedup.bits_of(y, r), b)).any(1) for r in rotations]
            assert np.any(hit, 0).mean() >= 0.98


def test_embedding_links_with_a_common_direction(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 32)) + 2.5 * math.sqrt(32) * np.eye(32)[0]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(vectors(spark, x)).collect()}
    u = embedding_dedup.unit(x)
    links = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([got[i] for i in range(1200)])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()


# near-duplicate documents

def brute(texts, width, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize("block", [512, 7])
def test_minhash_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = random.Random(5)
    base = [f"t{rng.randrange(400)}" for _ in range(120)]
    texts = list(TEXTS)
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 18)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[12].upper(), texts[12] + "  "]
    sizes, root = brute(texts, 2)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, texts, **CLASH), width=2).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component for i in range(len(texts))] == root
    assert minhash_dedup.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_minhash_of_large_families(spark, monkeypatch):
    """Chains of buckets longer than a block, compared bucket by bucket; copies of one text under many keys."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 5)
    rng = random.Random(11)
    texts, w = [], [f"t{i}" for i in range(60)]
    for _ in range(90):
        for _ in range(rng.randrange(2, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 8 + [texts[40].upper()] * 3
    sizes, root = brute(texts, 1)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, texts), width=1).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes and [got[i].component for i in range(len(texts))] == root


def test_minhash_of_keys_that_are_null_or_repeated(spark):
    rows = [(None, "a b c d"), (None, "A b c d"), (5, "a b c d"), (5, "x y z w"), (7, "x y z w"), (None, "q r s t"), (None, "q r s t ")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect() if r.component is not None)
    assert got == [(False, 5, 5), (False, 5, 5), (False, 7, 5), (True, 0, 5), (True, 0, 5)]


def test_pruning_bound():
    least = minhash_dedup.least_agreements(0.8, 1e-5)
    assert least == sorted(least) and all(m < 0.8 * (i + 1) * minhash_dedup.BATCH for i, m in enumerate(least))


def test_dedup_stage_keeps_one_of_each(spark):
    texts = ["a b c d e f g"] * 3 + [None, None, "", "x y z q r s t u"]
    df = docs(spark, texts, _key=1, component=2, **CLASH).unionByName(docs(spark, texts[:1], _key=1, component=2, **CLASH)).withColumn("doc_id", F.when(F.col("doc_id") == 1, None).otherwise(F.col("doc_id")))
    out = minhash_dedup.dedup_stage(spark, df, "")
    assert out.columns == df.columns and sorted(str(r.text) for r in out.collect()) == sorted(["a b c d e f g", "None", "None", "", "x y z q r s t u"])


def test_components(spark):
    ids = list(range(40))
    random.Random(1).shuffle(ids)
    e = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (90, 91), (7, 7)], "a long, b long")
    assert {r.id: r.component_id for r in components(e).collect()} == dict.fromkeys(range(40), 0) | {90: 90, 91: 90}
    assert components(e.limit(0)).count() == 0


# mixing

def test_mixing_against_greedy(spark):
    rng = random.Random(8)
    texts = [" ".join(["w"] * rng.randrange(0, 30)) for _ in range(120)] + [None, ""]
    df = docs(spark, texts, **CLASH, **INNER)
    staged = mixing.mixing_stage(spark, df, "")
    assert staged.columns == df.columns and all((r._tokens, r.full, r.end, r._epoch) == (4, 5, 6, 7) for r in staged.collect())
    assert {(r.full, r._rid) for r in mixing.mix(df).collect()} == {(5, 1)}
    got = mixing.mix(df, percent=60, max_epochs=2, seed="s").collect()
    rows = [(r.doc_id, next((n for n, f in reversed(mixing.DOMAINS) if (r.source or "x")[-1].isdigit() and int(r.source[3:]) >= f), ""), r.lang or "", r.source or "", len((r.text or "").split())) for r in df.collect()]
    weights = (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, mixing.SOURCE_WEIGHTS)

    def give(rows, budget, level):
        """Water-filling by many small rounds."""
        if level == 3:
            return {rows[0][1:4]: budget}
        kids = {}
        for r in rows:
            kids.setdefault(r[1 + level], []).append(r)
        cap = {k: 2 * sum(r[4] for r in v) for k, v in kids.items()}
        got = dict.fromkeys(kids, 0.0)
        left, open_ = budget, set(kids)
        while left > 1e-9 and open_:
            w = sum(weights[level].get(k, 1) for k in open_)
            step = min([left / w] + [(cap[k] - got[k]) / weights[level].get(k, 1) for k in open_])
            for k in open_:
                got[k] += step * weights[level].get(k, 1)
            left -= step * w
            open_ = {k for k in open_ if cap[k] - got[k] > 1e-9}
        return {leaf: b for k, v in kids.items() for leaf, b in give(v, got[k], level + 1).items()}

    taken = Counter((r.doc_id, r._epoch) for r in got)
    want = Counter()
    for leaf, b in give(rows, 0.6 * sum(r[4] for r in rows), 0).items():
        own = [r for r in rows if r[1:4] == leaf]
        t = sum(r[4] for r in own)
        full = math.floor(b / t + 1e-9) if t else 0
        want.update((r[0], e) for r in own for e in range(full))
        run = 0
        for r in sorted(own, key=lambda r: hashlib.md5(f"s|{full}|{r[0]}".encode()).hexdigest()):
            run += r[4]
            if run <= b - full * t + 1e-6:
                want[r[0], full] += 1
    assert taken == want
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_query_against_sql(spark, small, duck, same):
    same(mixing.op8_mixing(spark, small), duck, mixing.ORACLE["op8_mixing"])


# quality

def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    n = np.array([1, 4, 3])
    gap, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, log_z, pairs = quality_crf.marginals(gap, n, trans)
    at, want_pairs = 0, np.zeros((2, 2))
    for d, k in enumerate(n):
        g, paths = gap[at : at + k], [tuple((p >> i) & 1 for i in range(k)) for p in range(2**k)]
        weight = np.exp([sum(g[i] * y[i] for i in range(k)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)) for y in paths])
        assert math.isclose(log_z[d], math.log(weight.sum()))
        assert np.allclose(good[at : at + k], [sum(w for w, y in zip(weight, paths, strict=True) if y[i]) / weight.sum() for i in range(k)])
        for w, y in zip(weight, paths, strict=True):
            for a, b in zip(y, y[1:], strict=False):
                want_pairs[a, b] += w / weight.sum()
        at += k
    assert np.allclose(pairs, want_pairs)


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(4)
    good = ["\n".join("The " + " ".join(rng.choice(["house", "is", "a", "tree", "of", "water"]) for _ in range(8)) + "." for _ in range(rng.randrange(1, 5))) for _ in range(80)]
    bad = [t.replace(" ", "### ") for t in good[:40]]
    df = docs(spark, good + bad + TEXTS, **CLASH)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(120)] + [(None, 0), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r.quality_score for r in quality_crf.score(df, quality_crf.train(df, labels)).collect()}
    test = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert test and all((got[i] >= 0.7) == (i < 80) for i in test) and len(got) == 130 and all(0 <= s <= 1 for s in got.values())
    assert quality_crf.score(df, quality_crf.train(df, labels.limit(0))).first().quality_score == 0.5
    assert quality_crf.score(df.limit(0), None).count() == 0


# language model

def test_chain_against_enumeration():
    rng = np.random.default_rng(6)
    c = lm_score.Chain(*(x / x.sum(-1, keepdims=True) for x in (rng.random(2), rng.random((2, 2)))), rng.random((5, 2)))
    seqs = [np.array([1, 0, 4, 2]), np.array([3, 3]), np.array([2])]
    ll, (start, move, emit) = c.run(seqs, True)
    exact, want_emit, want_move, want_start = [], np.zeros((5, 2)), np.zeros((2, 2)), np.zeros(2)
    for s in seqs:
        paths = [tuple((p >> i) & 1 for i in range(len(s))) for p in range(2 ** len(s))]
        w = np.array([c.start[y[0]] * np.prod([c.emit[o, k] for o, k in zip(s, y, strict=True)]) * np.prod([c.move[a, b] for a, b in zip(y, y[1:], strict=False)]) for y in paths])
        exact.append(math.log(w.sum()))
        for p, y in zip(w / w.sum(), paths, strict=True):
            want_start[y[0]] += p
            for o, k in zip(s, y, strict=True):
                want_emit[o, k] += p
            for a, b in zip(y, y[1:], strict=False):
                want_move[a, b] += p
    assert np.allclose(ll, exact, atol=1e-5) and np.allclose(c.run(seqs, False)[0], exact, atol=1e-12)
    assert np.allclose(start, want_start, atol=1e-4) and np.allclose(move, want_move, atol=1e-4) and np.allclose(emit, want_emit, atol=1e-4)


@pytest.mark.parametrize("head", [200_000, 2])
def test_language_model(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["ab", "cd", "Ef"] if i % 2 else ["xx", "yy", "zz"]) for _ in range(30)) for i in range(60)] + TEXTS
    df = docs(spark, texts, **CLASH, n_tokens=1, chain=2)
    got = {r.doc_id: r for r in lm_score.score(df, df.where("doc_id % 5 <> 0")).collect()}
    toks = [[*(t or "").encode().lower().split(), None] for t in texts]
    c = Counter(w for i, t in enumerate(toks) if i % 5 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        assert got[i].n_tokens == len(t) and got[i].n_known == sum(c[w] > 0 for w in t) and got[i].train_tokens == n
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert got[i].score < 0 and math.isfinite(got[i].score)
    assert sum(got[i].score for i in range(60)) > sum(got[i].base_score for i in range(60))
    assert lm_score.score(df.limit(0), df.limit(0)).count() == 0
    assert len(lm_score.score(df, df.limit(0)).collect()) == len(texts)


# sentencepiece

ODD = [*TEXTS, " ", "   lead", "tail  ", "a" * 200, "日本語テキスト", "naïve café — “quoted” 1234567 x²+y²", "\u2581odd", "<s>[INST]</s>", "two  spaces and\u2581 mixed \u2581\u2581ones", "ab\x00cd e\nf\n\ng"]


@pytest.mark.parametrize("block_bytes", [spl.BLOCK, 400])
def test_encoding_equals_the_library(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(spl, "ASKING", 2 if block_bytes == 400 else 4096)
    sentencepiece = pytest.importorskip("sentencepiece")
    model = spl.Model.load(spl.MODEL_FILE)
    lib = sentencepiece.SentencePieceProcessor(model_file=spl.MODEL_FILE)
    df = docs(spark, [*ODD, *ODD[:9]], **CLASH).withColumns({"_block": F.lit(9), "p": F.lit("x"), "big": F.col("doc_id") + 2**60, "two words": F.lit(None).cast("timestamp")})
    got = spl.encode(df.unionByName(df.limit(5)), model, sample_docs=3, head=20, block_bytes=block_bytes)
    assert sorted(got.columns) == sorted(df.columns) and len(rows := got.collect()) == df.count() + 5
    for r in rows:
        ids = np.frombuffer(r.ids, "<i4").tolist()
        assert ids == lib.encode(r.text or "") and spl.decode_ids(ids, model) == (r.text or "").replace("\u2581", " ")
        assert (r._rid, r._block, r.big) == (1, 9, r.doc_id + 2**60)
    assert spl.encode(df.limit(0), model).count() == 0
    mapped = df.limit(3).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert spl.encode(mapped, model, sample_docs=3, head=20).where("m['a'] = 1").count() == mapped.count()


def test_lost_answers_are_errors():
    model = spl.Model.load(spl.MODEL_FILE)
    words = spl.Words(model, {}, 3)
    parts, lost = words.missing(["strange unheard words", "strange", "\u2581\u2581x a", None, ""])
    assert set(lost) == {"\u2581strange", "\u2581unheard", "\u2581words", "\u2581\u2581\u2581x", "\u2581a"} and lost == sorted(lost, key=lambda w: (zlib.crc32(w.encode()) % 3, w))
    own = {w: words.pack(model.segment(w)) for w in lost}
    assert words.encode(["strange unheard words"], parts, own) == [b"".join(own["\u2581" + w] for w in ("strange", "unheard", "words"))]
    with pytest.raises(ValueError):
        words.encode(["strange unheard words"], parts, {})
    with pytest.raises(ValueError):
        spl.answered([], [], lost)


def test_parts_without_a_pattern_are_those_of_the_pattern():
    model = spl.Model.load(spl.MODEL_FILE)
    words, rng = spl.Words(model, {}), random.Random(7)
    for _ in range(5000):
        key = "".join(rng.choice("abcZé²½٣12_.,%'\n\x00日") for _ in range(rng.randint(1, 6))) + rng.choice(["", ".", ",", "\n", "'", "s"])
        assert words.parts(key) == model.fine("\u2581" + key)


def test_texts_with_single_spaces_are_cut_together(monkeypatch):
    """A block's common texts cost no call of keys() each, its odd ones one."""
    model, calls, keys = spl.Model.load(spl.MODEL_FILE), [], spl.Model.keys
    monkeypatch.setattr(spl.Model, "keys", lambda self, t: calls.append(t) or keys(self, t))
    words, texts = spl.Words(model, {}, 3), ["strange unheard words", " odd", "strange, unheard", "strange"]
    parts, lost = words.missing(texts)
    got = words.encode(texts, parts, {w: words.pack(model.segment(w)) for w in lost})
    assert calls == [" odd", " odd"]
    assert got == [b"".join(words.pack(model.segment(w)) for k in keys(model, t) for w in words.parts(k)) for t in texts]


def test_split_gives_the_keys_of_each_text():
    model, rng = spl.Model.load(spl.MODEL_FILE), random.Random(5)
    texts = [None, *ODD, *("".join(rng.choice("ab, \u2581\n日é") for _ in range(rng.randrange(12))) for _ in range(500))]
    for prefix in (True, False):
        model.prefix = prefix
        for some in (texts, texts[:1], [], ["one two"], [" one"]):
            keys, numbers, first, last = model.split(some)
            assert len(set(keys)) == len(keys)
            assert [[keys[n] for n in numbers[a:b]] for a, b in zip(first, last, strict=True)] == [model.keys(t) for t in some]


def test_round_trips_of_many_texts_are_those_of_each():
    model, rng = spl.Model.load(spl.MODEL_FILE), random.Random(6)
    texts = [None, *ODD, "\ufffd", "\u2581", "x"]
    packed = [np.array(model.spell(model.segment(spl.SPACE + t.replace(" ", spl.SPACE))) if t else [], "<i4").tobytes() for t in texts]
    pairs = [(t, b) for t in texts for b in [packed[texts.index(t)], rng.choice(packed), np.array([3 + 255, model.unknown], "<i4").tobytes()]]
    for prefix in (True, False):
        model.prefix = prefix
        want = [spl.decode_ids(np.frombuffer(b, "<i4").tolist(), model) == (t or "").replace(spl.SPACE, " ") for t, b in pairs]
        assert spl.decodes(*map(list, zip(*pairs, strict=True)), model) == want and True in want and False in want
    assert spl.decodes([], [], model) == []


def bpe(scores):
    return spl.Model({p: i + 1 for i, p in enumerate(scores)}, scores, None, 0, spl.BPE, True, [b"?", *(p.replace("▁", " ").encode() for p in scores)])


def test_folds_of_tables_with_late_pieces(spark):
    rng = random.Random(2)
    for trial in range(3):
        names = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        model = bpe({p: -float(rng.randrange(12)) for p in sorted(names)})
        words = {"".join(rng.choice("abcx") for _ in range(rng.randint(2, 14))) for _ in range(150)}
        rows = spl.lattice_words(spark.createDataFrame([(w,) for w in words], "word string"), model, [], []).collect()
        assert model.late and {r.word: spl.pieces_of(r.word, r.cuts) for r in rows} == {w: model.segment(w) for w in words}, trial


def test_one_pass_is_exact_without_late_pieces():
    model = spl.Model.load(spl.MODEL_FILE)
    assert model.late and all(set(p) == {"\u2581"} for p in model.late)  # runs of spaces share one score
    rng = random.Random(3)
    pieces = [p for p in model.scores if len(p) > 1 and p not in model.late]
    for _ in range(3000):
        w = "".join(rng.choice(pieces)[: rng.randint(1, 6)] for _ in range(rng.randint(1, 6))).replace("\u2581" * 3, "x")
        cuts = set(range(len(w) + 1))
        for _, i, j in sorted((-model.scores[w[i:j]], i, j) for i in range(len(w)) for j in range(i + 2, len(w) + 1) if w[i:j] in model.scores):
            if i in cuts and j in cuts and len(inner := [k for k in cuts if i < k < j]) == 1:
                cuts.remove(inner[0])
        at = sorted(cuts)
        assert [w[a:b] for a, b in zip(at, at[1:], strict=False)] == model.segment(w)


def test_viterbi_fold_against_table(spark):
    scores = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.1, "bc": -3.3, "abc": -4.9, "ca": -3.6, "aa": -3.2, "▁": -2.0, "▁a": -2.7, "▁ab": -3.9}
    model = spl.Model({p: i + 1 for i, p in enumerate(scores)}, scores, None, 0, spl.UNIGRAM, True, [b"?", *(p.replace("▁", " ").encode() for p in scores)])
    rng = random.Random(1)
    words = {"".join(rng.choice("abcx▁") for _ in range(rng.randint(2, 12))) for _ in range(60)} | {"xx"}
    got = spl.lattice_words(spark.createDataFrame([(w,) for w in words], "word string"), model, [], []).collect()
    total = lambda ps: sum(scores.get(p, -14.9 + 0.0) for p in ps)
    assert {r.word for r in got} == words and all(math.isclose(total(spl.pieces_of(r.word, r.cuts)), total(model.segment(r.word))) for r in got)


# pipeline

def test_pipeline_stages(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_crf", "minhash_dedup", "mixing", "sentencepiece"]
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_pieces", "ids"] and out.count() > 20
    assert out.where("n_pieces <> size(ids)").count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """300 documents and more: good and bad ones, exact and near copies, nulls, empty texts, a long one, repeated rows, odd columns."""
    rng = random.Random(12)
    words = ["house", "is", "a", "tree", "of", "water", "the", "river", "stone", "bird", "wind", "road"]
    good = ["\n".join("The " + " ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(rng.randrange(2, 6))) for _ in range(180)]
    bad = [t.replace(" ", " ### ") for t in good[:60]]
    near = [t + " indeed." for t in good[60:90]]
    texts = good + bad + near + good[90:110] + TEXTS
    df = docs(spark, texts, **CLASH, _key=1, _row=2, component=3, quality_score=4, _block=5)
    at = str(tmp_path_factory.mktemp("corpus"))
    df.unionByName(df.where("doc_id IN (1, 200)")).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 180)) for i in range(240)] + [(None, 0), (3, None)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at, texts


def test_quality_stage_keeps_what_the_classifier_accepts(spark, corpus):
    at, texts = corpus
    df = spark.read.parquet(f"{at}/documents.parquet")
    out = quality_crf.quality_stage(spark, df, at)
    assert out.columns == df.columns
    kept = Counter(r.doc_id for r in out.collect())
    assert all(kept[i] == (2 if i == 1 else 1) for i in range(180)) and not any(kept[i] for i in range(180, 240)) and all(kept[i] == 1 for i in range(240, 290))
    assert quality_crf.quality_stage(spark, df.limit(0), at).count() == 0


def test_encode_stage_against_the_library(spark, corpus):
    at, texts = corpus
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=spl.MODEL_FILE)
    df = spark.read.parquet(f"{at}/documents.parquet")
    out = spl.encode_stage(spark, df, at)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_pieces", "ids"]
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: 1 for i in range(len(texts))}) + Counter([1, 200])
    assert all(r.ids == lib.encode(texts[r.doc_id] or "") and r.n_pieces == len(r.ids) for r in rows)


def test_pipeline_against_brute_force(spark, corpus):
    """Every stage on what its predecessor kept: accepted, one of each near-duplicate group, mixed, encoded."""
    import corpus_pipeline

    at, texts = corpus
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=spl.MODEL_FILE)
    df = spark.read.parquet(f"{at}/documents.parquet")
    accepted = sorted(r.doc_id for r in quality_crf.quality_stage(spark, df, at).collect())
    once = sorted(set(accepted))  # repeated rows have one text
    own = [texts[i] for i in once]
    _, root = brute(own, 5)
    empty = [k for k, t in enumerate(own) if not (t or "").split()]
    kept = [once[k] for k in range(len(once)) if root[k] == k]
    kept += [i for i in accepted if accepted.count(i) > 1 and once.index(i) in empty][1:]  # empty ones link with nothing
    mixed = Counter(r.doc_id for r in mixing.mixing_stage(spark, df.dropDuplicates(["doc_id"]).where(F.col("doc_id").isin(kept)), at).collect())
    rows = corpus_pipeline.run(spark, at).collect()
    assert Counter(r.doc_id for r in rows) == mixed and mixed
    assert all(r.ids == lib.encode(texts[r.doc_id] or "") for r in rows)
    assert len(kept) < len(once) < len(texts)


def test_pipeline_of_empty_tables(spark, corpus, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
