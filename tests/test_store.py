"""Storage layout, ingest and watch jobs, kept sources, enrichment and briefs in the store, reports and health."""

import http.server
import json
import os
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dossier.operators import browse, chunks, enrich, facts, ingest, jobs, lexical, records, reports, storage
from dossier.operators import briefs as briefing
from dossier.plans import config
from dossier.sources import embed, files, web
from dossier.streaming import watch

PAGE = "Agenda item one, a text of more than forty characters"
T0 = datetime(2026, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    return records.Store(spark, str(tmp_path / "store"))


def pdf(folder, name, *pages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(b"%PDF-" + "\f".join(pages).encode())
    return str(folder / name)


def test_layout_is_made_once_and_fills_in_passages(spark, store):
    assert {r["level"] for r in storage.status(spark, store.path).collect()} == {"warn"}
    made = storage.initialize(store)
    assert set(made) == set(storage.TABLES)
    assert storage.initialize(store) == []
    assert [(r["key"], r["value"]) for r in store.read("metadata").collect()] == [("schema_version", "1")]
    assert {r["name"]: r["level"] for r in storage.status(spark, store.path, jobs.Queue(spark, store.path + "/q")).collect()} == {n: "ok" for n in ("data_dir", *storage.FOLDERS, "tables", "jobs", "watcher")}
    text = "Council report\nPage 10 of 16\n• The first point of the list, which is long enough\n• And a second point of it"
    store.append_bundle("old", {"chunks": spark.createDataFrame([("c1", "d1", 1, 1, 1, text)], storage.TABLES["chunks"])})
    assert storage.initialize(store) == ["passages of chunks"] and storage.initialize(store) == []
    assert [r["text"] for r in store.read("passages").orderBy("ordinal").collect()] == ["• The first point of the list, which is long enough", "• And a second point of it"]
    assert storage.backfill_embeddings(store, embed.hashing_provider(8), "m:1") == 2
    assert storage.backfill_embeddings(store, embed.hashing_provider(8), "m:1") == 0
    assert storage.backfill_embeddings(store, embed.hashing_provider(8), "m:2") == 2
    assert store.read("passage_vectors").count() == 4


def test_files_become_jobs_and_jobs_documents(spark, store, tmp_path):
    folder = tmp_path / "in"
    pdf(folder, "b.pdf", PAGE)
    pdf(folder, "a.pdf", PAGE + " and more", "Public comment section of the meeting, also long")
    found = spark.createDataFrame([(p,) for p in files.pdf_paths(str(folder))], "path string")
    queue = jobs.Queue(spark, str(tmp_path / "jobs"))
    assert ingest.enqueue_files(queue, found, {"body": "Council"}, "AUTO") == 2
    assert ingest.enqueue_files(queue, found, {"body": "Council"}, "AUTO") == 0
    payloads = sorted((json.loads(r["payload_json"]) for r in queue.jobs().collect()), key=lambda x: x["path"])
    assert payloads[0] == {"metadata": {"body": "Council"}, "path": str(folder / "a.pdf"), "pdf_extractor": "auto", "source": "files"}
    with pytest.raises(files.SourceError):
        ingest.enqueue_files(queue, found, extractor="word")
    run = ingest.handler(store, [("plain", files.plain_extractor)], embed.hashing_provider(8))
    assert queue.run({ingest.JOB: run}, poll=0, max_loops=3) == 2
    assert {r["status"] for r in queue.jobs().collect()} == {"done"}
    assert sorted(r["title"] for r in store.read("documents").collect()) == ["a", "b"]
    index = lexical.build_index(store.read("passages"), str(tmp_path / "index"), stemmed=True)
    assert lexical.search_index(spark, index, "agendas").count() == 2
    assert [r["line"] for r in jobs.lines(queue.jobs()).orderBy("line").collect()][0].count(" path=") == 1


def test_a_file_that_fails_fails_its_job_only(spark, store, tmp_path):
    good, bad = pdf(tmp_path / "in", "a.pdf", PAGE), str(tmp_path / "in/none.pdf")
    queue = jobs.Queue(spark, str(tmp_path / "jobs"))
    ingest.enqueue_files(queue, spark.createDataFrame([(good,), (bad,)], "path string"))
    assert queue.work({ingest.JOB: ingest.handler(store, [("plain", files.plain_extractor)], embed.hashing_provider(8))}) == 2
    assert sorted(r["status"] for r in queue.jobs().collect()) == ["done", "failed"]


def test_sources_are_kept_once_and_extractors_tried_file_by_file(spark, store, tmp_path):
    folder = tmp_path / "in"
    pdf(folder, "a.pdf", PAGE)
    pdf(folder, "b.pdf", " ")
    asked = tmp_path / "asked"
    asked.mkdir()

    def other(content):
        (asked / str(len(content))).touch()
        return [(1, "Fallback agenda")]

    blobs = str(tmp_path / "blobs")
    found = files.read_pdfs(spark, str(folder))
    pages = {r["extractor"]: r["text"] for r in files.extract_best(found, [("plain", files.plain_extractor), ("other", other)]).collect()}
    assert pages == {"plain": PAGE, "other": "Fallback agenda"}
    assert len(os.listdir(asked)) == 1
    ingest.ingest(store, found, [("plain", files.plain_extractor)], embed.hashing_provider(8), blobs=blobs)
    names = sorted(os.listdir(blobs))
    assert len(names) == 2 and {n.rsplit("-", 1)[1] for n in names} == {"a.pdf", "b.pdf"}
    (tmp_path / "blobs" / names[0]).write_bytes(b"kept")
    files.keep_sources(found, blobs).collect()
    assert (tmp_path / "blobs" / names[0]).read_bytes() == b"kept" and sorted(os.listdir(blobs)) == names


def test_urls_land_once_and_one_that_fails_says_why(spark, tmp_path):
    def serve(url):
        if "down" in url:
            raise OSError("no answer")
        return (b"%PDF-one", "text/plain") if url.endswith(".pdf") else (b"html", "text/html")

    urls = spark.createDataFrame([("http://x/a.pdf",), ("http://x/same.pdf",), ("http://x/page",), ("http://down",)], "url string")
    folder = str(tmp_path / "landed")
    got = {r["url"]: r for r in web.land(urls, folder, serve).collect()}
    assert len(os.listdir(folder)) == 1 and got["http://x/a.pdf"]["path"] == got["http://x/same.pdf"]["path"]
    assert "isn't a PDF" in got["http://x/page"]["error"] and got["http://down"]["error"] == "no answer" and got["http://x/a.pdf"]["bytes"] == 8
    queue = jobs.Queue(spark, str(tmp_path / "jobs"))
    assert ingest.enqueue_urls(queue, web.land(urls, folder, serve), {"body": "B"}) == 2
    meta = json.loads(queue.jobs().first()["payload_json"])["metadata"]
    assert set(meta) == {"body", "source_url", "retrieved_at"}


def test_watches_are_registered_once(spark, store, tmp_path):
    storage.initialize(store)
    folder = tmp_path / "w"
    folder.mkdir()
    row = storage.register_watch(store, str(folder), '{"body": "Council"}', "2026-01-01 00:00:00").first()
    assert row["path"] == str(folder)
    with pytest.raises(ValueError, match="already"):
        storage.register_watch(store, str(folder / "../w"))
    assert storage.watch_check([str(folder)])[1] == "ok"
    assert storage.watch_check([str(tmp_path / "gone"), str(pdf(tmp_path / "x", "a.pdf", "x"))])[1:] == ("warn", f"missing watched folder {tmp_path / 'gone'}; recreate it or remove/re-add the watch; watched path {tmp_path / 'x/a.pdf'} is not a directory; remove/re-add the watch")
    for k, s in enumerate("ab"):
        storage.remember_signatures(store, spark.createDataFrame([("/p", "w", s), ("/q" + s, "w", s)], "path string, watch_id string, signature string"), f"s{k}")
    assert {r["path"]: r["content_signature"] for r in storage.signatures(store).collect()} == {"/p": "b", "/qa": "a", "/qb": "b"}


def test_a_replayed_batch_adds_no_job(spark, tmp_path):
    queue = jobs.Queue(spark, str(tmp_path / "jobs"))
    watches = spark.createDataFrame([("w1", "/in", '{"body": "Council"}', "1")], storage.TABLES["watches"])
    stable = spark.createDataFrame([("/in/a.pdf", "1:1", T0), ("/else/b.pdf", "1:1", T0)], watch.STABLE)
    assert queue.enqueue_frame("ingest_pdf", watch.job_rows(stable, watches)) == 2
    assert queue.enqueue_frame("ingest_pdf", watch.job_rows(stable, watches)) == 0
    got = {json.loads(r["payload_json"])["path"]: json.loads(r["payload_json"]) for r in queue.jobs().collect()}
    assert got["/in/a.pdf"]["metadata"] == {"body": "Council"} and got["/in/a.pdf"]["watch_id"] == "w1" and got["/else/b.pdf"]["metadata"] == {}
    later = spark.createDataFrame([("/in/a.pdf", "2:2", T0)], watch.STABLE)
    assert queue.enqueue_frame("ingest_pdf", watch.job_rows(later)) == 1


def test_vanished_and_returning_versions(spark, tmp_path):
    rows = [("a", "1", 0), ("a", None, 3), ("b", "1", 0), ("b", "2", 20), ("b", "1", 40), ("c", "1", 0), ("c", "2", 20), ("c", "2", 21), ("c", None, 22), ("c", "1", 30)]
    changes = spark.createDataFrame([(p, s, T0 + timedelta(seconds=x)) for p, s, x in rows], watch.CHANGE)
    got = sorted((r["path"], r["signature"], (r["ready_at"] - T0).seconds) for r in watch.stable_batch(changes, 5).collect())
    assert got == [("b", "1", 5), ("b", "1", 45), ("b", "2", 25), ("c", "1", 5)]  # c: 1 was told last, so it isn't told again


def test_watch_loop_lists_settles_and_enqueues(spark, tmp_path):
    folder, log = tmp_path / "in", str(tmp_path / "log")
    pdf(folder, "a.pdf", "x")
    queue = jobs.Queue(spark, str(tmp_path / "jobs"))
    times = iter(T0 + timedelta(seconds=x) for x in (0, 10, 20, 30))

    def clock():
        now = next(times)
        if now.second == 20:
            os.remove(folder / "a.pdf")
            pdf(folder, "b.pdf", "y")
        return now

    assert watch.watch_loop(spark, [str(folder)], log, str(tmp_path / "check"), queue, 5, 0, 4, clock) == 4
    assert sorted(json.loads(r["payload_json"])["path"].rsplit("/", 1)[1] for r in queue.jobs().collect())[:1] == ["a.pdf"]
    assert spark.read.parquet(log).where("signature is null").count() == 1


def test_enrichment_and_briefs_are_stored_whole_or_not_at_all(spark, store, tmp_path):
    storage.initialize(store)
    quote = {"page_start": 1, "quote": "STRASSE was named"}
    body = json.dumps({"summary": " Sum ", "summary_evidence": [quote], "notable_actions": [], "story_leads": [{"label": "L", "summary": "S", "evidence": quote}], "open_questions": ["q?"]})
    (tmp_path / "answers").mkdir()
    (tmp_path / "answers/d 1.json").write_text(body)
    responses = enrich.read_responses(spark, str(tmp_path / "answers"))
    assert [r["document_id"] for r in responses.collect()] == ["d 1"]
    pages = spark.createDataFrame([("d 1", 1, "p1", "The Straße was  named today.")], "document_id string, page_number long, page_id string, text string")
    nothing = spark.createDataFrame([], storage.TABLES["passages"])
    made = enrich.accepted(enrich.enrich(responses, enrich.contexts(pages, nothing)))
    items, evidence, brief = enrich.rows_of(made, responses, "p", "m", "2026-01-01")
    storage.append_items(store, items, evidence, "e1", brief)
    assert store.read("discovery_items").count() == 2 and store.read("discovery_evidence").count() == 2
    row = store.read("document_briefs").first()
    assert (row["summary"], row["status"], row["open_questions"]) == ("Sum", "validated", ["q?"])
    with pytest.raises(ValueError, match="confidence"):
        storage.append_items(store, items.withColumn("confidence", F.lit(2.0)), evidence, "e2")
    assert store.read("discovery_items").count() == 2
    text = reports.enrichment("d 1", row["brief_id"], row["summary"], evidence.join(items.select("item_id", "item_type", "label"), "item_id").orderBy("item_type").collect())
    assert text.splitlines()[3:] == ["items_created: 2", "summary:", "Sum", "items:", "- story_lead: L p.1", "- summary: Document summary p.1"]


def test_facts_fold_case_and_are_reported(spark, store):
    storage.initialize(store)
    pages = spark.createDataFrame([("d", 1, "Council approved a $250,000 contract with ABC Construction. Work on it must begin by June 1, 2026."), ("d", 2, "The council DENIED it, and the contract too, at last.")], "document_id string, page_number long, text string")
    found = facts.first_of_key(facts.extract(pages))
    assert found.where("item_type = 'topic'").count() == 1
    one = spark.createDataFrame([("d", 1, 0, "entity", "Straße Board", "{}", "", 0.5, ""), ("d", 2, 0, "entity", "STRASSE BOARD", "{}", "", 0.5, "")], facts.FACT)
    assert facts.first_of_key(one).count() == 1
    items, evidence = facts.items_of(found, F.lit("2026-01-01"))
    none = F.lit(None).cast("string")
    evidence = evidence.withColumns({"page_id": none, "passage_id": none})
    storage.append_items(store, items, evidence, "f1")
    assert facts.new_facts(found, found).count() == 0
    text = reports.facts("d", 9, 1, found.where("item_type = 'money'").collect())
    assert text.splitlines()[-1] == "- money: $250,000 confidence=0.95 p.1"
    assert reports.facts("d", 9, 9, []).endswith("items: none")
    docs = spark.createDataFrame([("d", "T", "2026-01-01", "Council")], "document_id string, title string, meeting_date string, body string")
    made = briefing.briefs(docs, pages, items.join(evidence.select("item_id", "page_start"), "item_id"))
    stored = storage.append_briefs(store, made, "b1", "2026-01-01").first()
    text = reports.brief(made.first(), docs.first(), evidence.join(items.select("item_id", "item_type", "label"), "item_id").where("item_type = 'money'").collect(), stored)
    assert "- money: $250,000 — p. 1 — Council approved a $250,000 contract with ABC Construction." in text and text.endswith("status: draft")
    full = docs.withColumns({c: none for c in ("document_type", "jurisdiction", "source_url", "source_path")})
    page = browse.browse(items, full, ("money", "action"), limit=2)
    lines = reports.browse(page, evidence, "Items", "items", 2).splitlines()
    assert lines[1:3] == ["showing 2 of 3 item(s); limit=2 offset=0", "more: use --limit/--offset or filters to narrow results"] and lines[3].endswith("title=T | meeting_date=2026-01-01 | citation=d p.1")
    assert reports.browse(page.limit(0), evidence, "Items", "items", 2).endswith("items: none")
    shown = browse.item_show(browse.list_items(items, evidence, "d", "money"), docs, items.where("item_type = 'money'").first()["item_id"]).first()
    assert '    quote: "Council approved' in reports.item(shown) and "  amount_text: $250,000" in reports.item(shown)
    listed = browse.list_items(items, evidence, item_type="topic").collect()
    assert len(listed) == 1 and len(listed[0]["evidence"]) == 1


def test_document_and_search_reports(spark):
    row = spark.createDataFrame([("d", "T", "c", 2, '{"b": 1, "a": "x"}')], "document_id string, title string, created_at string, page_count long, metadata_json string").first()
    assert reports.document(row).splitlines()[-3:] == ["metadata:", "  a: x", "  b: 1"] and reports.fields("oops") == ["  none"]
    assert reports.document_list([], 3, 2, 4).endswith("documents: none at offset 4; total=3 limit=2")
    schema = "rank int, citation string, text string, body string, document_type string, jurisdiction string, source_url string"
    got = reports.search(spark.createDataFrame([(1, "T — p. 1", "some  text", "Council", None, " ", "http://u")], schema), "text")
    assert got == "Search\nT — p. 1\nmetadata: body=Council; source_url=http://u\nsome text"
    assert reports.search(spark.createDataFrame([], schema)) == "No evidence found."


def test_health(spark, tmp_path, monkeypatch):
    settings = config.Config(str(tmp_path), embed_model="m")
    answer = {"models": [{"name": "m:latest"}]}
    got = {r["name"]: r for r in config.health(spark, settings, get=lambda url, headers: answer, which=lambda c: "/bin/x").collect()}
    assert got["embedding"]["level"] == "ok" and got["daemon"]["level"] == "info" and got["watcher"]["level"] == "info" and got["qpdf"]["level"] == "ok"
    check = lambda get=None, **k: config.embedding_check(config.Config("/x", **({"embed_model": "m"} | k)), get or (lambda url, headers: answer))[1]

    def down(url, headers):
        raise OSError("refused")

    assert [check(down), check(embed_model="other"), check(embed_provider=""), check(embed_provider="x"), check(embed_model="")] == ["warn", "warn", "warn", "error", "warn"]
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert check(embed_provider="openai") == "warn"
    monkeypatch.setenv("KEY", "k")
    assert check(lambda url, headers: {"data": [{"id": "m"}]} if headers == {"Authorization": "Bearer k"} else {}, embed_provider="openai", api_key_env="KEY") == "ok"
    assert config.socket_check(str(tmp_path))[1] == "warn" and config.socket_check(str(tmp_path / "no"))[1] == "warn"
    rows = spark.createDataFrame([("a", "info", ""), ("b", "ok", "")], storage.CHECK)
    for level in ("ok", "warn", "error"):
        rows = rows.unionByName(spark.createDataFrame([("c", level, "")], storage.CHECK))
        assert config.worst(rows).first()["level"] == level
    assert config.worst(rows.where("level = 'info'")).first()["level"] == "ok"
    assert reports.checks("Health", rows.collect(), data_dir="/x").splitlines()[-1] == "summary: error"


def test_embedding_service(spark):
    seen = []

    class Serve(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, asked["model"], len(asked["input"])))
            body = json.dumps({"embeddings": [[float(len(x)), 1] for x in asked["input"]]} if asked["model"] == "m" else {}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Serve)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    rows = spark.createDataFrame([(k, "x" * k if k else None) for k in range(70)], "id int, text string").coalesce(1)
    got = embed.embed(rows, embed.http_provider(url, "m")).orderBy("id").collect()
    assert got[0]["vector"] is None and got[5]["vector"] == [5.0, 1.0]
    assert seen == [("/api/embed", "m", 32), ("/api/embed", "m", 32), ("/api/embed", "m", 5)]
    with pytest.raises(embed.EmbeddingError):
        embed.http_provider(url, "none")(["x"])
    server.shutdown()


def test_pdf_libraries_and_ocr_are_called_as_documented(monkeypatch, tmp_path):
    import sys
    import types

    class Doc(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    page = types.SimpleNamespace(get_text=lambda kind: f"one {kind}", extract_text=lambda: None)
    doc = Doc([page])
    doc.pages = [page]
    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda stream, filetype: doc))
    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda stream: doc))
    assert files.library_extractor("pymupdf")(b"x") == [(1, "one text")] and files.library_extractor("pdfplumber")(b"x") == [(1, "")]
    tool = tmp_path / "ocrmypdf"
    tool.write_text('#!/bin/sh\n[ "$1 $2" = "--quiet --skip-text" ] || exit 3\ngrep -q slow "$3" && exec sleep 30\ngrep -q bad "$3" && { echo broken >&2; exit 1; }\ntr a-z A-Z < "$3" > "$4"\n')
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    assert files.ocrmypdf(b"text") == b"TEXT"
    with pytest.raises(files.SourceError, match="broken"):
        files.ocrmypdf(b"bad")
    with pytest.raises(files.SourceError, match="more than"):
        files.ocrmypdf(b"slow", 0.5)


def test_casefold_agrees_with_python(spark):
    """Equality of single code points and of some words, up to Cherokee and what newer tables of one side add."""
    every = [c for c in range(0x250) if c] + list(range(0x370, 0x530)) + list(range(0x1E00, 0x2000)) + list(range(0xFB00, 0xFB18))
    rows = spark.createDataFrame([(k, chr(c)) for k, c in enumerate(every)], "k int, c string")
    from dossier.functions import text as t

    got = {r["c"]: r["f"] for r in rows.select("c", t.casefold(F.col("c")).alias("f")).collect()}
    groups = {}
    for c, f in got.items():
        groups.setdefault(c.casefold(), set()).add(f)
    assert all(len(x) == 1 for x in groups.values())
    assert len({f for x in groups.values() for f in x}) == len(groups)


def test_index_answers_the_whole_language_as_the_scan_does(spark, tmp_path):
    words = ["road", "plan", "council", "budget", "planning", "vote", "café"]
    docs = [(f"{k:03d}", " ".join(words[(k * 7 + j * j * (k % 5 + 1)) % 7] for j in range(k % 13))) for k in range(150)] + [("999", None)]
    rows = spark.createDataFrame(docs, "passage_id string, text string")
    for stemmed in (False, True):
        index = lexical.build_index(rows, str(tmp_path / f"index{stemmed}"), stemmed)
        for q in ("road", "plan road", "road road", "missing", "road OR vote", '"road plan"', "pla*", '"council pla"*', "^council", "NEAR(road vote, 2)", '(road OR vote) NOT "plan council"', "cafe AND budg*", "-text: road", '"" OR road', "NEAR(road, 3)"):
            a = [(r[0], round(r[1], 9)) for r in lexical.search(rows, q, 200, stemmed).collect()]
            assert [(r[0], round(r[1], 9)) for r in lexical.search_index(spark, index, q, 200).collect()] == a, q
    terms = {r["term"]: (r["df"], r["cf"]) for r in lexical.term_counts(rows).collect()}
    assert terms == {r["term"]: (r["df"], r["cf"]) for r in lexical.term_stats(lexical.postings(rows)).collect()}


def test_ordered_scans_and_batches(spark):
    rows = spark.createDataFrame([("d2", 1, "p1"), ("d1", 2, "p3"), ("d1", 1, "p2")], "document_id string, page_number long, page_id string")
    assert [r["page_id"] for r in records.ordered(rows, "pages").collect()] == ["p2", "p3", "p1"]
    assert [r["previous"] for r in records.adjacent(rows, "document_id", "page_number").orderBy("document_id", "page_number").collect()] == [None, 1, None]
    assert chunks.chunk_pages(rows.withColumn("text", F.lit(" "))).count() == 0
