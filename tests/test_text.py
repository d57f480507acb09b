import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as t
from dossier.functions.porter import stem
from dossier.operators import chunks, facts, lexical


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()[0]


def test_white_space_follows_python(spark):
    for s in ["", "  a \t b ", " a b\x1c", "\x1f\n x y ", "a　"]:
        assert one(spark, s, t.collapse) == " ".join(s.split())
        assert one(spark, s, t.strip) == s.strip()
        assert one(spark, s, t.optional) == (s.strip() or None)
        mine, want = one(spark, s, t.lines), [" ".join(x.split()) for x in s.splitlines()]
        assert mine in (want, [*want, ""])  # an empty last line ends no passage


def test_case(spark):
    assert one(spark, "ÉA", t.ascii_lower) == "Éa"
    assert one(spark, "STRASSE", lambda c: t.casefold_equal(c, "Straße"))
    assert one(spark, "Council", lambda c: t.casefold_equal(c, " COUNCIL "))


def test_json_text_keeps_types_apart(spark):
    assert one(spark, '{"k": "2026"}', lambda c: t.json_text(c, "k")) == "2026"
    assert one(spark, '{"k": 2026}', lambda c: t.json_text(c, "k")) is None
    assert one(spark, "not json", lambda c: t.json_text(c, "k")) is None
    assert one(spark, "[1]", t.metadata) == {} == one(spark, "oops", t.metadata)
    assert one(spark, '{"a": "b"}', t.metadata) == {"a": "b"}


def test_iso_date(spark):
    assert str(one(spark, "2026-05-01", t.iso_date)) == "2026-05-01"
    for bad in ("2026-5-1", "20260501", "2026-13-01", "2026-05-01 10:00:00", None):
        assert one(spark, bad, t.iso_date) is None


def test_snippet(spark):
    text = "a" * 1000 + " needle " + "b" * 1000
    got = one(spark, text, lambda c: t.snippet(c, "Needle"))
    assert got.startswith("…") and got.endswith("…") and "needle" in got and len(got) == 702
    assert one(spark, text, lambda c: t.snippet(c, None)) == text[:700] + "…"
    assert one(spark, "short", lambda c: t.snippet(c, "x")) == "short"


@pytest.mark.parametrize("n,count", [(0, 0), (2000, 1), (2001, 2), (3800, 2), (3801, 3), (4500, 3)])
def test_chunk_windows(spark, n, count):
    pages = spark.createDataFrame([("d", 1, "  " + "x" * n + "\n")], "document_id string, page_number long, text string")
    got = chunks.chunk_pages(pages).orderBy("chunk_no").collect()
    assert len(got) == count
    if count > 1:
        assert sum(len(r["text"]) for r in got) == n + 200 * (count - 1)


def test_passages_of_a_report(spark):
    text = "City Manager’s Report\nMay 1, 2026\nPage 10 of 16\n• The first bullet is here\ngoes on\n\n• Second\nNotes:\nshort\n"
    rows = spark.createDataFrame([("c", "d", 10, 10, text)], "chunk_id string, document_id string, page_start long, page_end long, text string")
    got = chunks.split_passages(rows).orderBy("ordinal").collect()
    assert [r["text"] for r in got] == ["• The first bullet is here goes on", "• Second"]
    assert [r["passage_id"] for r in got] == ["passage-c-001", "passage-c-002"]
    alone = spark.createDataFrame([("c", "d", 1, 1, "Page 1 of 2\nNotes:\nshort")], rows.schema)
    assert [r["text"] for r in chunks.split_passages(alone).collect()] == ["Notes: short"]


WORDS = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll books naive nationality generalizations oscillators logi archaeology".split()


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(text, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    return con


def test_stems_agree_with_a_full_text_engine(fts):
    fts.execute("create virtual table v using fts5vocab('f', 'row')")
    for w in WORDS:
        fts.execute("delete from f")
        fts.execute("insert into f values (?)", (w,))
        assert fts.execute("select term from v").fetchone()[0] == stem(w), w


def test_bm25_agrees_with_a_full_text_engine(spark):
    rng = random.Random(5)
    vocabulary = ["council", "vote", "budget", "road", "café", "books", "book", "stormwater", "plan", "the"]
    docs = [(f"p{k:03d}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for k in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, text, tokenize='porter unicode61')")
    con.executemany("insert into f values (?, ?)", docs)
    passages = spark.createDataFrame(docs, "passage_id string, text string").cache()
    for q in ("council budget", "cafe OR stormwater", '"council vote" NOT road', "boo* AND plan", "(road OR plan) AND budget", "NEAR(council road, 3)", "vote + budget", "text: books", '^council', "council council"):
        want = con.execute("select id, bm25(f) from f where f match ? order by bm25(f), id limit 20", (q,)).fetchall()
        got = [(r[0], r[1]) for r in lexical.search(passages, q, 20, stemmed=True).collect()]
        if "NEAR" in q or "^" in q:
            every = [r[0] for r in lexical.search(passages, q, 1000, stemmed=True).collect()]
            assert set(every) == {x for x, _ in con.execute("select id, 0 from f where f match ?", (q,)).fetchall()} and every[:20] == [x for x, _ in got]
            continue
        assert [round(s, 9) for _, s in got] == [round(s, 9) for _, s in want], q
        assert sorted(got)[0][0] == sorted(want)[0][0] if len(want) < 20 else True


def test_index_answers_as_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([("a", "road plan road"), ("b", "plan"), ("c", None), ("d", "road budget plan plan")], "passage_id string, text string")
    index = lexical.build_index(docs, str(tmp_path / "index"))
    for q in ("road", "plan road", "road road", "missing"):
        a = [(r[0], round(r[1], 12)) for r in lexical.search(docs, q).collect()]
        b = [(r[0], round(r[1], 12)) for r in lexical.search_index(spark, index, q).collect()]
        assert a == b
    with pytest.raises(lexical.QueryError):
        lexical.search_index(spark, index, "road-plan")


@pytest.mark.parametrize("bad", ["", "stay-at-home", "95%", "city's", "AND", '"open', "a AND", "nope: x", "(a", "(a OR b) c"])
def test_query_errors(bad):
    with pytest.raises(lexical.QueryError):
        lexical.parse(bad)


PAGE = "Council approved a $250,000 stormwater contract with ABC Construction. Work must begin by June 1, 2026 and is 95% funded. Resolution No. 2026-05 names https://example.test/plan."


def test_facts_of_a_page():
    got = list(facts.facts_of(PAGE))
    found = {(k, label) for k, label, *_ in got}
    assert {("money", "$250,000"), ("percentage", "95%"), ("date", "June 1, 2026"), ("civic_identifier", "Resolution No. 2026-05"), ("topic", "stormwater"), ("topic", "contract"), ("entity", "ABC Construction"), ("action", "approved"), ("deadline", "June 1, 2026"), ("url", "https://example.test/plan")} <= found
    money = next(q for k, _, _, _, q in got if k == "money")
    assert money == "Council approved a $250,000 stormwater contract with ABC Construction."


@pytest.mark.parametrize("blank", [" ", "  ", "\t", "\u00a0", " \u2003"])
def test_deadlines_with_irregular_blanks(blank):
    for words in ("no later than Friday noon", "must be submitted by noon", "must begin by noon", "by Jan 5"):
        sentence = "Bids for paving arrive " + words.replace(" ", blank) + "."
        got = [(k, label, quote) for k, label, _, _, quote in facts.facts_of(f"Heading\n{sentence}\n") if k == "deadline"]
        whole = "Bids for paving arrive " + words + "."
        assert got == [("deadline", whole, whole)], sentence


def test_facts_that_are_not():
    got = {(k, label) for k, label, *_ in facts.facts_of("Page 1 of 2\nCity Manager Report\nNo such date as 2026-99-99.\nThen the Planning Commission saw a zoning request.")}
    assert not any(k == "date" for k, _ in got)
    assert ("entity", "City Manager Report") not in got
    assert ("entity", "Planning Commission") in got and ("topic", "zoning") in got
    assert list(facts.facts_of("  \n")) == []


def test_facts_persist_once(spark):
    pages = spark.createDataFrame([("d", 1, PAGE + " Paid $1.2 million. Paid $1.2 million."), ("d", 2, PAGE), ("e", 1, None), ("f", 1, "")], "document_id string, page_number long, text string")
    first = facts.first_of_key(facts.extract(pages)).cache()
    assert {r["label"] for r in first.where("item_type = 'money'").collect()} == {"$250,000", "$1.2 million"}
    assert first.where("item_type = 'entity'").count() == 1
    assert first.where("item_type = 'money' and label = '$250,000'").count() == 2
    assert facts.new_facts(first, first).count() == 0
    counts = facts.persist_counts(first, first.limit(0)).first()
    assert counts["created"] == counts["extracted"] == first.count() and counts["skipped"] == 0
    items, evidence = facts.items_of(first)
    assert items.select("item_id").distinct().count() == evidence.count() == first.count()
