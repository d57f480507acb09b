"""Operators on pairs, groups and tables against brute force."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest_llm import by_id
from dossier.llm import mixing, queries, secrets, simhash, topk, url_filter, warc
from dossier.llm.shared import spread_join

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted(tuple(str(plain(r[n])) for n in names) for r in got.collect())
    b = sorted(tuple(str(plain(dict(zip(want.columns, r))[n])) for n in names) for r in want.fetchall())
    assert a == b


# op2


def test_op2_rules_and_list(spark):
    urls = ["http://A.Example.NET/en/x", "http://example.net/de", "http://example.com/de/", "http://notexample.com/de/", "https://x.org/fr/a?b#c", "http://org/fr/", "http://b.net", "http://b.net?q=/", None, "no scheme", "ftp://h.io:80/index.html?utm_x=1&b=2&a=1", "http://www.h.io?a=1&b=2", "http://h.io/?a=1&b=3", "x://y://z"]
    pages = spark.createDataFrame([(k, u, "x", "x") for k, u in enumerate(urls)], "page_id long, url string, rule string, canonical string")
    listed = spark.createDataFrame([("h.io?a=1&b=2",), ("h.io?a=1&b=2",), (None,)], "url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, listed).collect()}
    assert [got[k]["rule"] for k in range(len(urls))] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", "org/fr/", None, None, None, None, None, None, None, None]
    assert [got[k]["verdict"] for k in range(len(urls))] == ["allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "allow"]
    assert (got[8]["host"], got[8]["path"], got[9]["host"], got[13]["host"]) == ("", "", "", "y:")
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert url_filter.judge(pages, listed.limit(0)).where("listed").count() == 0


def test_op2_rule_of_a_whole_host(spark):
    df = spark.createDataFrame([("b.net", "/"), ("b.net", "")], "h string, p string")
    assert [r[0] for r in df.select(url_filter.rule_of(F.col("h"), F.col("p"))[0]).collect()] == ["net/", None]


def test_op2_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(20000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    blocks = url_filter.build_bloom(listed, "k")
    hashes = lambda a, b: np.array([r[0] for r in spark.range(a, b).select(F.xxhash64(F.concat(F.lit("k"), F.col("id").cast("string")))).collect()])
    assert url_filter.maybe(blocks, hashes(0, 20000)).all()
    assert url_filter.maybe(blocks, hashes(20000, 40000)).mean() < 0.05
    tiny = url_filter.build_bloom(listed, "k", max_bits=512)  # too small: all pass to the join
    assert url_filter.maybe(tiny, hashes(0, 100)).all()


def test_op2_repeated_urls_and_mirrors(spark):
    body = "<p>" + "x" * 200
    rows = [(k, "http://hot.io/a?utm_x=" + str(k), "y") for k in range(300)] + [(1000, "http://spam.io/1", body), (1001, "http://other.io/copy", body), (1002, "http://spam.io/2", "short"), (1003, "http://third.io/s", "short"), (1004, None, body), (1005, "http://clean.io", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    listed = url_filter.with_mirrors(pages, url_filter.host(F.col("url")) == "spam.io")
    assert sorted(r[0] for r in listed.collect()) == ["other.io/copy", "spam.io/1", "spam.io/2"]
    listed = listed.unionByName(spark.createDataFrame([("hot.io/a",)], "url string"))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, listed).collect()}
    assert {k for k, v in got.items() if v == "block"} == {*range(300), 1000, 1001, 1002} and len(got) == len(rows)
    empty = url_filter.with_mirrors(pages.limit(0), F.lit(True))
    assert empty.count() == 0 and url_filter.judge(pages.limit(0), empty).count() == 0


def test_op2_long_url(spark):
    path = "a/" * 500_000
    pages = spark.createDataFrame([(1, f"http://H.net/{path}?q=1"), (2, "http://h.org/" + path)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame([("h.org/" + path.rstrip("/"),)], "url string")).collect()}
    assert got[1]["path"] == "/" + path and (got[1]["rule"], got[1]["verdict"], got[2]["verdict"]) == ("net/", "block", "block")


def test_hot_keys_meet_by_broadcast_and_others_by_shuffle(spark):
    left = spark.createDataFrame([(1, k) for k in range(500)] + [(2, 0), (2, 1), (3, 0)], "k int, v int")
    right = spark.createDataFrame([(1, "hot", 500), (2, "cold", 2), (4, "none", 0)], "k int, name string, n long")
    got = sorted(tuple(r) for r in spread_join(left, right, "k", "n", 503, hot_rows=10).select("k", "v", "name").collect())
    assert got == [(1, k, "hot") for k in range(500)] + [(2, 0, "cold"), (2, 1, "cold")]


# op3


def masses(cells, p, d):
    return (cells["tokens"] * p).groupby(cells[d]).sum()


def test_op3_expected_sample_has_the_budget_and_the_reachable_marginals():
    rng = random.Random(1)
    cells = pd.DataFrame([(f"s{a}", f"l{b}", f"t{c}", rng.randint(1, 1000) * (500 if a == 0 else 1)) for a in range(4) for b in range(3) for c in range(3)], columns=["source", "lang", "topic", "tokens"])
    total = cells["tokens"].sum()
    targets = {"source": {"s0": 0.25, "s1": 0.25, "s2": 0.25, "s3": 0.25}, "lang": 0.5, "topic": {"t0": 0.5}}
    p, lacks = mixing.rake(cells, targets, 400, None)
    assert p.max() == 1 and np.abs(lacks).max() < 1e-6
    for d, target in targets.items():
        share = mixing.target_shares(cells.groupby(d)["tokens"].sum(), target)
        assert np.allclose(masses(cells, p, d) / (cells["tokens"] * p).sum(), share, atol=1e-6)
    # Beyond that, three small sources are taken whole and the large one fills the budget.
    for budget in (0.05, 0.5, 0.99):
        p, lacks = mixing.rake(cells, targets | {"lang": 1.0, "topic": 1.0}, 400, budget)
        own = cells.groupby("source")["tokens"].sum()
        want = mixing.wanted(own.to_numpy(float), np.full(4, 0.25), budget * total)
        assert want.sum() == pytest.approx(budget * total) and (want <= own).all()
        assert (0 <= p).all() and (p <= 1).all()
        assert np.allclose(masses(cells, p, "source"), want, rtol=1e-3)
        assert lacks[cells["source"] == "s1"].min() == pytest.approx(0.25 - want[1] / want.sum(), abs=1e-3)
    assert (mixing.rake(cells, targets | {"topic": 1.0}, 20, 1.0)[0] == 1).all()
    p, _ = mixing.rake(cells, targets | {"topic": {"t0": 1.0}}, 20, 0.3)
    assert (p[cells["topic"] != "t0"] == 0).all()


@pytest.mark.parametrize("targets", [mixing.POWERS, {"source": {"a": 0.9}, "lang": 1.0, "topic": {"prose": 0.4, "nothing": 0.1}}])
@pytest.mark.parametrize("budget", [0.5, None])
def test_op3_tables_give_what_the_driver_gives(spark, targets, budget):
    df = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(9999, "some words", "en", "a", 3)], "doc_id long, text string, lang string, source string, n_chars long"))
    a = by_id(mixing.mix(df, targets, budget, 3))
    b = by_id(mixing.mix(df, targets, budget, 3, max_cells=0))
    assert [(r["doc_id"], r["kept"]) for r in a] == [(r["doc_id"], r["kept"]) for r in b]
    for c in ("probability", "unreached"):
        assert np.allclose([r[c] for r in a], [r[c] for r in b], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("budget", [mixing.BUDGET, corpus_pipeline.MIX_BUDGET, None])
def test_op3_expected_sample_of_the_documents(spark, budget):
    """Sources and languages take the shares that the budget lets them; what topics lack is what `unreached` says."""
    df = pd.DataFrame([r.asDict() for r in mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), budget=budget).collect()])
    mass, total = df["n_tokens"] * df["probability"], df["n_tokens"].sum()
    if budget is not None:
        assert mass.sum() == pytest.approx(budget * total, rel=5e-3)
    lacks = {}
    for d in mixing.DIMENSIONS:
        own = df.groupby(d)["n_tokens"].sum()
        share = mixing.target_shares(own, mixing.POWERS[d])
        if budget is not None:
            want = mixing.wanted(own.to_numpy(float), share.to_numpy(), budget * total)
            assert np.abs(mass.groupby(df[d]).sum() - want).sum() < 0.01 * budget * total
        lacks[d] = (share - mass.groupby(df[d]).sum() / mass.sum())[df[d]].to_numpy()
    assert np.allclose(df["unreached"], np.maximum(0, np.max(list(lacks.values()), axis=0)), atol=1e-9)
    assert df["unreached"].max() < 0.005 if budget is None else df["unreached"].max() > 0.02
    assert abs((df["n_tokens"] * df["kept"]).sum() - mass.sum()) < 0.1 * total


def test_op3_edges(spark, edges):
    got = by_id(mixing.mix(edges))
    assert len(got) == 10 and [r["topic"] for r in got[2:5]] == ["empty"] * 3 and got[0]["kept"] == got[1]["kept"]
    assert {r["source"] for r in got} == {"a", "b", ""}
    kept = mixing.sample(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r["kept"] for r in got)
    assert mixing.mix(edges.limit(0)).count() == 0 == mixing.sample(edges.limit(0)).count()
    assert mixing.sample(edges, budget=1.0).count() == 10 == mixing.sample(edges, budget=1.0, max_cells=0).count()
    assert mixing.mix(edges.limit(0), budget=None).count() == 0


# op7


def brute_topk(rows, k=20):
    sound = [(i, vid, [math.floor(64 * x) for x in v]) for i, (vid, v) in enumerate(rows) if vid is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, qid, q in sound:
        if qid % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), vid) for j, vid, x in sound if j != i)
            out += [(qid, r + 1, vid, -s) for r, (s, vid) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,query,tile,pivots", [(16384, 512, 1024, 32), (37, 5, 7, 3), (50, 1, 64, 1)])
def test_op7_exact(spark, block, query, tile, pivots):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8)) * 3
    rows = [(k, [float(x) for x in centers[k % 6] + rng.normal(size=8) * 0.1]) for k in range(400)]
    rows += [(40, rows[40][1]), (40, rows[40][1]), (500, rows[3][1]), (None, rows[0][1]), (600, None), (620, [None] * 8), (640, [float("nan")] * 8), (660, [float("inf")] * 8), (680, [1.0, 2.0]), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"row": F.lit("x"), "dist": F.lit(1)})
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = topk.search(topk.quantized(df), F.col("vec_id") % 20 == 0, block_rows=block, query_rows=query, tile_rows=tile, pivots=pivots, group_blocks=2)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows)


def test_op7_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [2.0])]):
        df = spark.createDataFrame(rows, schema)
        assert sorted(tuple(r) for r in topk.search(topk.quantized(df), F.col("vec_id") % 20 == 0).collect()) == brute_topk(rows)


def test_op7_large_components_are_exact(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(k, [float(3**k % 1000), 1e8 + k, -1e8]) for k in range(60)] + [(100, [1e15, 0.0, 1.0]), (101, [-1e15, 5.0, 2.0]), (120, [2e7, 1e9, 1e9 + 1])]
    got = sorted(tuple(r) for r in topk.search(topk.quantized(spark.createDataFrame(rows, schema)), F.col("vec_id") % 20 == 0, block_rows=16, tile_rows=5).collect())
    fit = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    assert [r[3] for r in got] == [fit(s) for *_, s in brute_topk(rows)]
    assert [r for r in got if abs(r[3]) < 1 << 62] == [r for r in brute_topk(rows) if abs(r[3]) < 1 << 62]


# op8


def brute_print(text):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(ids, prints):
    n = len(ids)
    near = [[j for j in range(n) if j != i and (prints[i] ^ prints[j]).bit_count() <= 4] for i in range(n)]
    low = [None] * n
    for i in sorted(range(n), key=lambda i: ids[i]):
        if low[i] is None:
            stack, low[i] = [i], ids[i]
            while stack:
                for j in near[stack.pop()]:
                    if low[j] is None:
                        low[j] = ids[i]
                        stack.append(j)
    return sorted((d, f"{p:016x}", len(x), c) for d, p, x, c in zip(ids, prints, near, low))


def got_groups(df):
    return sorted((r["doc_id"], r["fingerprint"], r["n_near"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("size", [4096, 3])
def test_op8_fixture(spark, size):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(30, 120))) for _ in range(12)]
    texts = ["", "  \n", None, "one", "One", "one two three"] * 2
    for b in base:
        words = b.split()
        for k in range(12):
            w = list(words)
            for _ in range(k // 3):
                w[rng.randrange(len(w))] = "x"
            texts.append(" ".join(w).upper() if k % 2 else "\n".join(w))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, fp string, cnt int")
    assert got_groups(simhash.labelled(df, size)) == brute_groups(list(range(len(texts))), [brute_print(t) for t in texts])


def test_op8_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got_groups(queries.op8_simhash_near_dedup(spark, SF)) == brute_groups([r["doc_id"] for r in rows], [brute_print(r["text"]) for r in rows])


def test_op8_links_of_chosen_fingerprints(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for p in prints for _ in range(6)]
    prints = sorted(set(prints) | {0, 15, (1 << 64) - 1})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(p, k % 3 + 1) for k, p in enumerate(signed)], "fp long, cnt long")
    for size in (4096, 2):
        found = simhash.links(classes, size)
        near = {r["a"]: r["n"] for r in found.where("kind = 'near'").groupBy("a").agg(F.sum("n").alias("n")).collect()}
        for i, p in enumerate(prints):
            assert near.get(signed[i], 0) == sum(k % 3 + 1 for k, q in enumerate(prints) if k != i and (p ^ q).bit_count() <= 4)


def test_op8_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[k] == 1000 for k in range(1000, 1400))
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op8_edges(spark, edges):
    named = edges.where("doc_id is not null")
    got = {r["doc_id"]: r for r in simhash.labelled(named).collect()}
    assert simhash.labelled(named).count() == 9
    assert got[2]["fingerprint"] == "0" * 16 and got[2]["n_near"] == 2 and got[4]["component_id"] == 2 and got[6]["component_id"] == 1 and got[6]["n_near"] == 2
    kept = simhash.distinct_documents(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 5, 7, 8]
    assert kept.where("doc_id is null").count() == 1
    assert simhash.labelled(edges.limit(0)).count() == 0 == simhash.distinct_documents(edges.limit(0)).count()


def test_op8_repeated_ids_keep_the_smallest_text(spark):
    rows = [(5, "one two three four five six", "b"), (5, "zzz other words that are here now", "a"), (5, "one two three four five six", "a"), (6, "quite another text with its own words", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for part in (df, df.repartition(3)):
        assert sorted(tuple(r) for r in simhash.distinct_documents(part).collect()) == [rows[2], rows[3]]


# op10


def brute_warc(rows):
    def digest(html):
        return hashlib.sha256((html or "").encode()).hexdigest()

    first = {}
    for p, html in rows:
        if p is not None:
            first[digest(html)] = min(p, first.get(digest(html), p))
    out = []
    for p, html in rows:
        d, n = digest(html), len((html or "").encode())
        repeat = n >= 100 and d in first and p != first[d]
        out.append((p, n, d, "revisit" if repeat else "response", first[d] if repeat else None))
    return sorted(out, key=str)


def test_op10_round_trip(spark):
    hot, other = "<p>" + "hot é" * 40, "<p>" + "z" * 97
    rows = [(k, hot) for k in range(50, 450)] + [(7, hot), (7, hot), (None, hot), (1000, other), (1001, other), (1002, "z" * 99), (1003, "z" * 99), (1004, None), (1005, ""), (None, "q" * 200), (None, "q" * 200), (1006, "x\r\n\r\nWARC/1.1\r\n" * 30)]
    urls = [None, "http://a/b c\r\nX: y", "http://é/ü", ""]
    df = spark.createDataFrame([(p, urls[k % 4], h, "x", "y") for k, (p, h) in enumerate(rows)], "page_id long, url string, html string, payload_digest string, _salt string")
    got = warc.round_trip(df.repartition(5))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=str) == brute_warc(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_op10_very_long_html(spark):
    rows = [(1, "é" * 3_000_000), (2, "é" * 3_000_000), (3, "x")]
    df = spark.createDataFrame([(p, "http://h", h) for p, h in rows], "page_id long, url string, html string")
    got = warc.round_trip(df)
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=str) == brute_warc(rows)


def test_op10_archives(spark):
    hot = "y" * 200
    df = spark.createDataFrame([(k, f"http://h/{k}", hot if k % 2 else f"page {k} " * 50) for k in range(40)], "page_id long, url string, html string")
    index = warc.deduplicate(warc.resolve(warc.capture(df, 2000)), 2000)
    assert index.select("path").distinct().count() > 1
    records = {r["page_id"]: r for r in warc.read(index, with_payload=True).collect()}
    assert {r["record_type"] for k, r in records.items() if k % 2 and k > 1} == {"revisit"} and records[1]["record_type"] == "response"
    assert all(bytes(records[k]["payload"]).decode() == f"page {k} " * 50 for k in range(0, 40, 2))
    assert {records[k]["refers_to_record"] for k in range(3, 40, 2)} == {records[1]["record_id"]}
    assert len({r["record_id"] for r in records.values()}) == 40


# the pipeline


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secret_scan", "mix_sources", "tokenize"]
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, steps[-1], sf)
        out.write.parquet(str(tmp_path / str(k)))
        steps.append(spark.read.parquet(str(tmp_path / str(k))))
    read = [{r["doc_id"]: r for r in x.collect()} for x in steps]
    assert all(x.columns == names for x in steps[:5])
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(d in read[1] for d, q in good.items() if q) / sum(good.values()) > 0.97
    assert all(read[0][d]["text"] == r["text"] for d, r in read[1].items())
    groups = brute_groups(list(read[1]), [brute_print(r["text"]) for r in read[1].values()])
    assert set(read[2]) == {d for d, _, _, c in groups if d == c}
    assert set(read[3]) == set(read[2])
    grammar = secrets.compile_grammar(secrets.labelled_credentials())
    assert secrets.scan(steps[3], grammar).where("size(spans) > 0").count() <= 0.01 * len(read[3])
    mixed = {r["doc_id"]: r["kept"] for r in mixing.mix(steps[3], budget=corpus_pipeline.MIX_BUDGET).collect()}
    assert set(read[4]) == {d for d, kept in mixed.items() if kept} and all(read[3][d] == r for d, r in read[4].items())
    assert set(read[5]) == set(read[4]) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in read[5].values())
    whole = {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {d: bytes(r["ids"]) for d, r in read[5].items()}


def test_pipeline_edges(spark, edges, tmp_path, no_labels):
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for df in (edges, edges.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{df.limit(1).count()}-{k}")
            stage(spark, df, str(tmp_path)).write.parquet(path)
            df = spark.read.parquet(path)
        assert "ids" in df.columns
