"""What keeps queries within their limits on large tables, and that the results stay whole there."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from dossier.operators import briefs, browse, chunks, facts, lexical
from dossier.plans import queries, records
from dossier.streaming import watch

SF = "/root/testdata/sf0.001"


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_many_watches_of_one_folder_meet_its_paths_once(spark):
    watches = spark.range(300).select(F.col("id").alias("watch_id"), F.when(F.col("id") % 2 == 0, "/in/a").otherwise("/in/a/").alias("folder"), (300 - F.col("id")).cast("double").alias("created_at"))
    watches = watches.unionByName(spark.createDataFrame([(900, "/in/a/b", 1.0), (901, "/in/a/b/c.pdf", 0.5), (902, "/", 9e9)], "watch_id long, folder string, created_at double"))
    paths = spark.createDataFrame([("/in/a/1.pdf",), ("/in/a/b/2.pdf",), ("/in/a/b/c.pdf",), ("/in/x.pdf",), ("in/a/1.pdf",)], "path string")
    got = watch.matching_watch(paths, watches)
    assert {r["path"]: (r["watch_id"], r["folder"]) for r in got.collect()} == {"/in/a/1.pdf": (299, "/in/a/"), "/in/a/b/2.pdf": (299, "/in/a/"), "/in/a/b/c.pdf": (901, "/in/a/b/c.pdf"), "/in/x.pdf": (902, "/")}
    assert plan(got).count("Aggregate [") == 2  # folders are reduced to one row each before they meet paths


PAGES = "document_id string, page_number long, text string"
TEXT = "Council approved a $250,000 contract with ABC Construction. Work must begin by June 1, 2026 and is 95% funded. See https://example.test/plan."


def pages(spark):
    rows = [("d", k, f"{TEXT} Paid $1.2 million. Paid $1.2 Million. PAID $1.2 million. The Straße Board met on item {k % 3}.") for k in range(6)]
    rows += [("e", k, t) for k, t in ((2, TEXT.upper()), (1, TEXT), (1, TEXT + " Paid $7."), (1, TEXT), (3, None), (4, " "), (None, TEXT), (None, TEXT))]
    return spark.createDataFrame([*rows, (None, 1, TEXT), (None, 1, TEXT), ("f", 9, "We saw the STRASSE BOARD. " + TEXT)], PAGES)


def shuffled_by(df):
    return [x for x in plan(df).splitlines() if "Repartition" in x or "Aggregate" in x or "Window" in x]


def test_first_facts_are_those_of_the_aggregate(spark):
    same = ["document_id", "page_number", "item_type", "label"]
    every = facts.first_of_key(facts.extract(pages(spark)))
    for columns in (facts.FIELDS, (*same, "seq"), same):
        got = facts.first_facts(pages(spark), columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, every.select(*got.columns).collect()))
        assert len(shuffled_by(got)) == 1  # pages are shuffled, not facts
    for kinds in (("topic",), ("date", "deadline", "action"), ("money", "entity")):
        got = facts.first_facts(pages(spark), same, kinds)
        assert sorted(map(str, got.collect())) == sorted(map(str, every.where(F.col("item_type").isin(*kinds)).select(*got.columns).collect()))


def test_keys_of_facts_are_counted_without_a_join(spark):
    found = facts.first_facts(pages(spark))
    old = facts.first_facts(pages(spark).where("page_number % 2 = 0"))
    got = facts.persist_counts(found, old)
    keys = lambda x: x.select("document_id", *facts.fact_key())
    both = keys(found).join(keys(old).distinct().withColumn("old", F.lit(1)), facts.KEY, "left").where("document_id is not null")
    want = both.groupBy("document_id").agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("old").isNull()).alias("created"), F.count("old").alias("skipped"))
    assert sorted(map(tuple, got.where("document_id is not null").collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in plan(got)
    assert facts.new_facts(found, old).where("document_id is not null").count() == both.where("old is null").count()
    assert "Broadcast" not in plan(facts.new_facts(found, old), "executedPlan")


def test_evidence_is_never_broadcast(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "y")], "item_id string, label string")
    evidence = spark.createDataFrame([("a", 2, "2", 2, "q2"), ("a", 1, "1", 1, "q1")], "item_id string, page_start int, evidence_id string, page_end int, quote string")
    got = browse.with_evidence(items, evidence)
    assert {r["label"]: [e["quote"] for e in r["evidence"]] for r in got.collect()} == {"x": ["q1", "q2"], "y": []}
    assert "Broadcast" not in plan(got, "executedPlan")
    assert "Join" not in plan(queries.evidence_nested(spark, SF)) and plan(queries.evidence_nested(spark, SF)).count("MapInArrow") == 1


def test_briefs_send_few_rows_of_a_document(spark):
    items = spark.createDataFrame([("d", f"{k}", k % 9, f"L{k}") for k in range(400)], "document_id string, item_id string, kind int, label string")
    items = items.select("document_id", "item_id", F.element_at(F.array(*map(F.lit, briefs.ORDER)), F.col("kind") + 1).alias("item_type"), "label", F.lit(0.9).alias("confidence"), F.lit(1).alias("page_start"), F.lit("t").alias("created_at"))
    got = [(r["place"], r["item_type"], r["label"]) for r in briefs.notable(items).orderBy("place").collect()]
    assert got == [(1, "topic", "L0"), (2, "topic", "L108"), (3, "topic", "L117"), (4, "action", "L1"), (5, "action", "L10"), (6, "action", "L100"), (7, "action", "L109"), (8, "action", "L118")]
    assert briefs.notable(items, 200).where("item_type <> 'topic' and item_type <> 'entity'").count() == 197
    assert "_group" in plan(briefs.notable(items))
    for name in ("brief_text", "browse_topics", "browse_timeline"):
        assert "key_quote" not in plan(queries.QUERIES[name](spark, SF))


def test_stems_hold_only_the_words_of_a_batch():
    words = ["resting", "rests", "cities", "Ärger", "hoping"]
    tokens = pa.array([words * 400, None, [], words[:2]] + [words * 400] * 100)
    assert lexical.stems(tokens.slice(1, 3)).to_pylist() == [None, [], ["rest", "rest"]]
    tracemalloc.start()
    got = lexical.stems(tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[-1].as_py() == [lexical.stem(x) for x in words] * 400 and len(got) == len(tokens)
    assert peak < 1e6  # 200,000 tokens as Python objects would take ten times that


def test_facts_of_documents_runs_the_rules_it_shows(spark, monkeypatch):
    asked = []
    real = facts.extract
    monkeypatch.setattr(facts, "extract", lambda rows, columns, kinds=facts.KINDS: asked.append(set(kinds)) or real(rows, columns, kinds))
    records.facts_of_documents(spark, SF)
    assert asked == [{"money", "percentage", "url", "civic_identifier", "topic"}]


def test_passages_are_split_without_a_fold_in_the_plan(spark):
    long = "a line that is long enough to be kept as a passage of its own"
    text = f"Agenda:\r\n{long}\nand its\x85rest\nPAGE 3 of  9\n• item\x0cgoes on\nJune 5, 2026\nshort\n\nThe following is a brief overview\n{long}"
    assert chunks.passages_of(text) == [f"{long} and its rest", "• item goes on", long]
    assert chunks.passages_of("Agenda:\nshort\n-\nwww.x.org") == ["Agenda: short"] and chunks.passages_of(" \n-") == []
    rows = spark.createDataFrame([("c", "d", 1, 1, text), ("n", "d", 1, 1, None)], "chunk_id string, document_id string, page_start long, page_end long, text string")
    got = chunks.split_passages(rows)
    assert [(r["passage_id"], r["ordinal"]) for r in got.orderBy("ordinal").collect()] == [(f"passage-c-00{k}", k) for k in (1, 2, 3)]
    assert "aggregate(" not in plan(got) and plan(got).count("passage_texts(") == 1
