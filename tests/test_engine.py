import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as t
from dossier.operators import briefs, browse, enrich, hybrid, ingest, jobs, records
from dossier.operators.hybrid import Filters, SearchError
from dossier.plans import config
from dossier.sources import embed, files, web
from dossier.streaming import watch


CITED = " — ".join(["Stormwater Report", "2026-05-01", "p. 3"])


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [
        ("a", "Stormwater Report", "2026-05-01", "Planning Commission", "staff report"),
        ("b", "Budget Packet", "2026-04-15", "City Council", "packet"),
        ("c", None, None, "Zoning Board", None),
        ("d", "Manager Report", "2026-03-01", None, "report"),
    ]
    documents = spark.createDataFrame(docs, "document_id string, title string, meeting_date string, body string, document_type string")
    texts = {
        "pa": ("a", "ca", 3, "Stormwater improvements downtown near the river"),
        "pb": ("b", "cb", 1, "The annual budget and its hearing"),
        "pc": ("c", "cc", 2, "Variance for a duplex"),
        "pd": ("d", "cd", 1, "A belt filter press was repaired"),
        "pe": ("d", "ce", 2, "Summer games at the park"),
        "pf": ("d", "cf", 3, "Athletics programme"),
        "pg": ("d", "cg", 4, "New books arrived"),
        "ph": ("d", "ch", 5, "A book was lent"),
        "pi": ("d", "ci", 6, "Booking of rooms, books"),
    }
    passages = spark.createDataFrame([(p, d, c, n, 1, x) for p, (d, c, n, x) in texts.items()], "passage_id string, document_id string, chunk_id string, page_start long, ordinal long, text string")
    return documents, passages


def vectors(spark, **distances):
    return spark.createDataFrame([(p, [1.0 + d**0.5, 0.0]) for p, d in distances.items()], "passage_id string, vector array<double>")


def ids(df):
    return [r["passage_id"] for r in df.collect()]


def run(spark, corpus, query, filters=Filters(), **distances):
    return hybrid.hybrid_search(corpus[1], corpus[0], vectors(spark, **distances) if distances else vectors(spark, none=9.0), query, [1.0, 0.0], filters)


def test_hybrid_scenarios(spark, corpus):
    found = run(spark, corpus, "stormwater downtown", pa=0.1)
    assert ids(found) == ["pa"] and found.first()["citation"] == CITED and found.first()["score"] == pytest.approx(1.0)
    assert ids(run(spark, corpus, "stormwater downtown", Filters(body="planning commission", document_type="STAFF REPORT", since="2025-01-01"))) == ["pa"]
    assert ids(run(spark, corpus, "semantic zoning", Filters(body="Planning Commission"), pc=0.1, pa=0.2)) == ["pa"]
    assert ids(run(spark, corpus, "stormwater downtown", Filters(body="City Council"))) == []
    assert ids(run(spark, corpus, "semantic zoning", pc=0.2)) == ["pc"]


def test_hybrid_gate(spark, corpus):
    assert ids(run(spark, corpus, "games", pe=0.92, pf=0.96)) == ["pe", "pf"]
    assert ids(run(spark, corpus, "Belt filter Press", pd=0.80, pf=0.97)) == ["pd"]
    assert set(ids(run(spark, corpus, "books"))[:3]) == {"pg", "ph", "pi"}


def test_hybrid_options(spark, corpus):
    for bad in (lambda: run(spark, corpus, " "), lambda: run(spark, corpus, "x", Filters(since="2026-5-1")), lambda: run(spark, corpus, "x", Filters(since="2026-02-01", until="2026-01-01")), lambda: hybrid.vector_search(vectors(spark, a=1.0), [], 3)):
        with pytest.raises(SearchError):
            bad()
    assert Filters(body=" x ").labels() == ["body=x"]


def test_packet(spark, corpus, tmp_path):
    text = browse.packet(run(spark, corpus, "stormwater downtown", pa=0.1), "stormwater", ["body=x"])
    for part in ("# Source Packet: stormwater", "## Key Evidence", f"1. **{CITED}**", "   > Stormwater improvements", "## Timeline", "- 2026-05-01 — ", "## Open Questions", "## Source List", "(page 3; title: Stormwater Report; body: Planning Commission"):
        assert part in text
    assert "No evidence found." in browse.packet(run(spark, corpus, "qqq"), "qqq")
    path = str(tmp_path / "p.md")
    browse.write_packet(path, text)
    with pytest.raises(SearchError):
        browse.write_packet(path, text)
    browse.write_packet(path, "new", overwrite=True)
    lines = hybrid.result_lines(run(spark, corpus, "stormwater downtown", pa=0.1), "downtown").collect()
    assert lines[0]["line"].startswith(CITED + "\n")


def test_inventory(spark):
    docs = spark.createDataFrame(
        [("a", "Minutes", "u", '{"body": "Council", "meeting_date": "2026-04-01"}', "2026-04-01"), ("b", "Budget", "v", '{"body": "Council", "meeting_date": "2026-04-02"}', "2026-04-02"), ("c", None, None, '{"stored_source_path": "/s/c.pdf"}', "2026-04-03")],
        "document_id string, title string, source_url string, metadata_json string, created_at string",
    ).withColumn("source_path", F.lit(None).cast("string"))
    docs = browse.flat_documents(docs)
    pages = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "document_id string, text string")
    page = browse.inventory(docs, pages, limit=2).collect()
    assert [(r["document_id"], r["total"], r["page_count"], r["source"]) for r in page] == [("c", 3, 0, "/s/c.pdf"), ("b", 3, 1, "v")]
    got = browse.inventory(docs, pages, browse.DocumentFilters(body="Council", since="2026-04-01", query="BUDGET")).collect()
    assert [(r["document_id"], r["total"]) for r in got] == [("b", 1)]
    for bad in ({"limit": 501}, {"limit": 0}, {"offset": -1}, {"filters": browse.DocumentFilters(since="04-01-2026")}):
        with pytest.raises(SearchError):
            browse.inventory(docs, pages, **bad)


def test_browse(spark):
    docs = spark.createDataFrame([("d1", "T1", "City Council", "2026-05-01"), ("d2", "T2", "Board", None)], "document_id string, title string, body string, meeting_date string")
    for c in ("document_type", "jurisdiction", "source_url", "source_path"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    items = spark.createDataFrame(
        [("1", "d1", "topic", "Zoning", "{}", 0.6), ("2", "d2", "topic", "budget", "{}", 0.6), ("3", "d1", "deadline", "May 3, 2026", '{"phrase": "x"}', 0.82), ("4", "d1", "action", "approved", "{}", 0.75)],
        "item_id string, document_id string, item_type string, label string, value_json string, confidence double",
    ).withColumns({"summary": F.lit("s"), "created_at": F.lit("2026-01-01")})
    assert [r["label"] for r in browse.browse(items, docs, browse.TOPICS).collect()] == ["budget", "Zoning"]
    assert [r["label"] for r in browse.browse(items, docs, browse.TOPICS, browse.DocumentFilters(body="City Council")).collect()] == ["Zoning"]
    line = browse.browse(items, docs, browse.TIMELINE, browse.DocumentFilters(item_type="deadline", min_confidence=0.8), "timeline").collect()
    assert [(r["label"], r["display_date"]) for r in line] == [("May 3, 2026", "May 3, 2026")]
    for bad in (browse.DocumentFilters(item_type="topic"), browse.DocumentFilters(min_confidence=1.5), browse.DocumentFilters(since="x")):
        with pytest.raises(SearchError):
            browse.browse(items, docs, browse.TIMELINE, bad)
    assert browse.item_show(items, docs, "3").first()["title"] == "T1"


def test_brief_caps_and_short_text(spark):
    rows = [("d", f"{k}{n}", k, f"{k} {n}", 0.5, 1) for k in briefs.ORDER for n in range(4)]
    items = spark.createDataFrame(rows, "document_id string, item_id string, item_type string, label string, confidence double, page_start long").withColumn("created_at", F.lit(""))
    got = briefs.notable(items).orderBy("place").collect()
    assert [r["item_type"] for r in got] == ["topic"] * 3 + ["action"] * 4 + ["deadline"]
    docs = spark.createDataFrame([("d", "T", None, "2026-01-01"), ("e", None, None, None)], "document_id string, title string, body string, meeting_date string")
    pages = spark.createDataFrame([("d", "x" * 50), ("e", "short")], "document_id string, text string")
    made = {r["document_id"]: r for r in briefs.briefs(docs, pages, items).collect()}
    assert made["d"]["summary"].startswith("T (2026-01-01) contains evidence about topic 0, topic 1, and topic 2. Notable")
    assert made["d"]["significance"] == "The selected evidence highlights deadlines or schedule changes, formal actions or votes."
    assert len(made["d"]["open_questions"]) == 2 and made["e"]["status"] == "too short" and made["e"]["summary"] is None


def response(**change):
    quote = {"page_start": 1, "quote": "council  APPROVED the plan"}
    claim = {"label": "L", "summary": "S", "evidence": quote}
    return json.dumps({"summary": "Sum", "summary_evidence": [quote], "notable_actions": [claim], "story_leads": [claim], "open_questions": ["q"]} | change)


def test_enrichment(spark):
    pages = spark.createDataFrame([(d, 1, f"page-{d}", "The Council approved\nthe plan today.") for d in "abcdef"], "document_id string, page_number long, page_id string, text string")
    passages = spark.createDataFrame([("a", "pp", 1, 1, 1, "Council approved the plan")], "document_id string, passage_id string, page_start long, page_end long, ordinal long, text string")
    bodies = {"a": response(), "b": "oops", "c": response(summary_evidence=[]), "d": response(story_leads=[{"label": "L", "summary": "S", "evidence": dict(page_start=1, quote="nobody said this")}]), "e": response(summary=" "), "f": response(notable_actions=[{"label": "L", "summary": "S", "evidence": {"page_start": 3, "page_end": 2, "quote": "x"}}])}
    made = enrich.enrich(spark.createDataFrame(list(bodies.items()), "document_id string, body string"), enrich.contexts(pages, passages))
    good = enrich.accepted(made).orderBy("claim_id").collect()
    assert [(r["document_id"], r["item_type"], r["confidence"], r["page_id"]) for r in good] == [("a", "summary", 0.8, "page-a"), ("a", "action", 0.78, "page-a"), ("a", "story_lead", 0.7, "page-a")]
    problems = {r["document_id"]: r["problem"] for r in made.where("problem is not null").collect()}
    assert set(problems) == set("bcdef") and problems["b"] == "not JSON" and "quote" in problems["d"]
    with pytest.raises(Exception, match="not JSON|missing|wasn't|empty|isn't"):
        enrich.require_all(made).collect()


def test_records(spark, tmp_path):
    schema = "id string, v int, created string"
    old = spark.createDataFrame([("a", 1, "c1"), ("b", 2, "c1")], schema)
    new = spark.createDataFrame([("a", 9, "c2"), ("n", 5, "c2"), ("n", 6, "c3")], schema)
    got = {r["id"]: (r["v"], r["created"]) for r in records.upsert(old, new, "id", keep=["created"], order=["created"]).collect()}
    assert got == {"a": (9, "c1"), "b": (2, "c1"), "n": (6, "c2")}
    e = "array<struct<document_id: string, page_start: int, page_end: int, quote: string, validation_status: string>>"
    item = lambda **k: tuple(({"document_id": "d", "item_type": "t", "label": "l", "extractor": "x", "confidence": 0.5, "evidence": [("d", 1, 1, "q", "v")]} | k).values())
    rows = [item(), item(label=" "), item(confidence=1.5), item(confidence=None), item(evidence=[("o", 1, 1, "q", "v")]), item(evidence=[("d", 0, 1, "q", "v")]), item(evidence=[("d", 2, 1, "q", "v")]), item(evidence=[("d", 1, 1, "", "v")])]
    df = spark.createDataFrame(rows, f"document_id string, item_type string, label string, extractor string, confidence double, evidence {e}")
    assert [r["problem"] is None for r in records.problems(df).collect()] == [True, False, False, True, False, False, False, False]
    store = records.Store(spark, str(tmp_path / "s"))
    assert store.read("t", schema).count() == 0
    for _ in range(2):
        store.append_bundle("b1", {"t": old})
    new.write.parquet(str(tmp_path / "s/t/bundle=lost"))  # a bundle whose commit never came
    assert store.read("t").count() == 2
    with pytest.raises(KeyError):
        records.lookup(old, "id", "zzz")
    assert records.lookup(old, "id", "b").first()["v"] == 2


def test_jobs(spark, tmp_path):
    q = jobs.Queue(spark, str(tmp_path / "jobs"))
    assert q.claim() is None
    a, b, c = q.enqueue("ok", ["{}"]) + q.enqueue("bad", ["{}"]) + q.enqueue("other", ["{}"])

    def boom(_):
        raise RuntimeError("boom")

    assert q.work({"ok": lambda p: None, "bad": boom}) == 3
    assert (q.get(a)["status"], q.get(b)["status"], q.get(b)["error"]) == ("done", "failed", "boom")
    counts = {r["status"]: r["n"] for r in jobs.status_counts(q.jobs()).collect()}
    assert counts == {"pending": 0, "running": 0, "done": 1, "failed": 2}
    assert jobs.overall(jobs.status_counts(q.jobs())).first()[0] == "warn"
    with pytest.raises(ValueError):
        q.retry(a)
    q.retry(b)
    assert q.get(b)["status"] == "pending" and q.get(b)["error"] is None and q.claim()["job_id"] == b


T0 = datetime(2026, 1, 1)


def changes(*rows):
    return [(p, s, T0 + timedelta(seconds=x)) for p, s, x in rows]


DEBOUNCE = changes(("a", "1", 0), ("a", "1", 2), ("b", "1", 0), ("b", "2", 4), ("b", "2", 10), ("c", "1", 0), ("c", "1", 20), ("z", "9", 100))


def test_debounce_batch(spark):
    got = {(r["path"], r["signature"]): (r["ready_at"] - T0).total_seconds() for r in watch.stable_batch(spark.createDataFrame(DEBOUNCE, watch.CHANGE), 5).collect()}
    assert got == {("a", "1"): 5, ("b", "2"): 9, ("c", "1"): 5, ("z", "9"): 105}


def test_debounce_stream(spark, tmp_path):
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "check")
    queue = jobs.Queue(spark, str(tmp_path / "jobs"))
    for part in (DEBOUNCE[:4], DEBOUNCE[4:], changes(("y", "1", 300)), changes(("y", "1", 400), ("a", "1", 400))):
        spark.createDataFrame(part, watch.CHANGE).coalesce(1).write.mode("append").parquet(log)
        stream = watch.stable_stream(spark.readStream.schema(watch.CHANGE).parquet(log), 5)
        watch.enqueue_stable(stream, queue, checkpoint).awaitTermination(120)
    seen = [json.loads(r["payload_json"]) for r in queue.jobs().collect()]
    assert sorted((x["path"], x["signature"]) for x in seen) == [("a", "1"), ("b", "2"), ("c", "1"), ("y", "1"), ("z", "9")]


def test_listing_sees_rewritten_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "in/b.txt").write_bytes(b"x")
    log = str(tmp_path / "log")
    assert watch.list_changes(spark, [str(tmp_path / "in")], log, T0) == 1
    (tmp_path / "in/a.PDF").write_bytes(b"%PDF-22")
    watch.list_changes(spark, [str(tmp_path / "in")], log, T0 + timedelta(seconds=9))
    assert spark.read.parquet(log).select("signature").distinct().count() == 2
    assert watch.signature(str(tmp_path / "gone")) is None


@pytest.mark.parametrize("text", ["documents: []", "other: 1", "documents:\n- title: x", "documents:\n- url: u\n  meeting_date: 05-01-2026", "documents:\n- url: u\n- url: u", "documents:\n- url: u\n  committee: c", "{", "documents:\n- url: 3"])
def test_manifest_errors(text):
    with pytest.raises(web.ManifestError):
        web.parse_manifest(text)


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.yaml"
    p.write_text("documents:\n- url: http://x/a.pdf\n  meeting_date: 2026-05-01\n- url: http://x/b.pdf\n  body: ' Council '\n")
    got = web.read_manifest(spark, str(p)).collect()
    assert [(r["url"], r["meeting_date"], r["body"]) for r in got] == [("http://x/a.pdf", "2026-05-01", None), ("http://x/b.pdf", None, "Council")]


def test_download(spark):
    def serve(url):
        return (b"%PDF-one", "text/plain") if url.endswith("a.pdf") else (b"html", "text/html")

    urls = spark.createDataFrame([("http://x/a.pdf",)], "url string")
    assert web.download(urls, serve).first()["content"] == b"%PDF-one"
    with pytest.raises(Exception, match="isn't a PDF"):
        web.download(spark.createDataFrame([("http://x/b",)], "url string"), serve).collect()


def test_ingest_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "agenda.pdf").write_bytes(b"%PDF-Agenda item one, a text of more than forty characters\fPublic comment section of the meeting, also long")
    (folder / "copy.pdf").write_bytes((folder / "agenda.pdf").read_bytes())
    assert len(files.pdf_paths(str(folder))) == 2
    for bad in (tmp_path / "none", tmp_path):
        if bad == tmp_path:
            (tmp_path / "x.txt").write_text("x")
            bad = tmp_path / "x.txt"
        with pytest.raises(files.SourceError):
            files.pdf_paths(str(bad))
    store = records.Store(spark, str(tmp_path / "store"))
    extract = [("blank", lambda content: [(1, "  "), (2, "")]), ("plain", files.plain_extractor)]
    docs = ingest.ingest(store, files.read_pdfs(spark, str(folder)), extract, embed.hashing_provider(8), "hashing:v1")
    assert [r["title"] for r in docs.collect()] == ["agenda"]
    counts = {n: store.read(n).count() for n in ("documents", "pages", "chunks", "passages", "chunk_vectors", "passage_vectors", "embedding_records")}
    assert counts == {"documents": 1, "pages": 2, "chunks": 2, "passages": 2, "chunk_vectors": 2, "passage_vectors": 2, "embedding_records": 4}
    assert {r["extractor"] for r in store.read("pages").collect()} == {"plain"}
    assert ingest.ingest(store, files.read_pdfs(spark, str(folder)), extract, embed.hashing_provider(8)).count() == 0
    assert store.read("documents").count() == 1
    assert records.missing_embeddings(store.read("passages"), store.read("embedding_records"), "local", "hashing", "v1").count() == 0


def test_embedding_checks():
    for bad in ([[1.0]], [[], [1]], [["x"], [1]], "ab", [[True], [1]]):
        with pytest.raises(embed.EmbeddingError):
            embed.checked(bad, 2)
    assert embed.identity("m:2") == ("m", "2") and embed.identity("m") == ("m", "latest")
    with pytest.raises(files.SourceError):
        files.extractors("word")
    assert [n for n, _ in files.extractors("auto")] == ["pymupdf", "pdfplumber"]


def test_config(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_DATA_HOME", "/x")
    assert config.load().data_dir == "/x/dossier"
    p = tmp_path / "c.yaml"
    p.write_text("data_dir: /y\nembed_model: m\n")
    assert config.load(str(p), data_dir="/z") == config.Config("/z", embed_model="m")
    p.write_text("oops: 1")
    with pytest.raises(ValueError):
        config.load(str(p))
    assert config.worst(config.health(spark, config.load())).first()["level"] in ("ok", "warn")


def test_citation(spark):
    df = spark.createDataFrame([("T", None), (None, "2026-01-01"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(t.citation(F.col("a"), F.col("b"), F.lit(4))).collect()] == ["T — p. 4", "2026-01-01 — p. 4", "p. 4"]
