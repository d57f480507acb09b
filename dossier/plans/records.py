"""Registered queries of records, metadata, validation, jobs and further search paths, with the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import text as t
from dossier.operators import browse, briefs, chunks, enrich, facts, hybrid, ingest, jobs, lexical, records, storage
from dossier.plans import config
from dossier.plans import queries as q
from dossier.session import table
from dossier.sources import testbed as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.strip()
        return f

    return add


@query(
    q._with(tb.CORPUS_SQL)
    + """, d as (select document_id, sha256(text) as h, created_at, cast(document_id as bigint) % 2 as odd from corpus)
select document_id, h as source_hash from (select *, row_number() over (partition by h order by created_at, document_id) as k from d where odd = 1) n
where k = 1 and not exists (select 1 from d e where e.odd = 0 and e.h = n.h)"""
)
def content_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New contents, one row each, that the documents of even number don't have."""
    rows = tb.corpus(spark, sf_dir).select("document_id", "created_at", records.content_hash(F.col("text")).alias("source_hash"), (F.col("document_id").cast("long") % 2).alias("odd"))
    new = records.first_of_content(rows.where("odd = 1"), "source_hash", ["created_at", "document_id"])
    return records.unseen(new, rows.where("odd = 0"), ["source_hash"]).select("document_id", "source_hash")


@query(q._with(tb.CORPUS_SQL, tb.PAGES_SQL, q._CHUNKS, q._PASSAGES) + "select 'passage-' || chunk_id || '-' || lpad(cast(ordinal as varchar), 3, '0') as passage_id, chunk_id from passages where cast(document_id as bigint) % 2 = 1")
def passage_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the chunks that have none yet; those of even documents do."""
    every = q._chunks(spark, sf_dir)
    have = chunks.split_passages(every.where("cast(document_id as bigint) % 2 = 0"))
    return chunks.split_passages(storage.chunks_without_passages(every, have)).select("passage_id", "chunk_id")


_META = """case when doc_id % 6 = 0 then 'no json' else '{"body": "b' || (doc_id % 3) || '", "source_url": ' || case when doc_id % 5 = 0 then '7' else '"http://m/' || doc_id || '"' end || case when doc_id % 4 = 0 then ', "stored_source_path": "/s/' || doc_id || '"' else '' end || ', "source_filename": "f' || doc_id || '.pdf"}' end"""


@query(
    f"""with d as (select doc_id, doc_id % 6 <> 0 as ok, case when doc_id % 7 = 0 then ' ' when doc_id % 2 = 0 then source end as body, case when doc_id % 9 = 0 then 'http://c' end as source_url from documents)
select doc_id as document_id, coalesce(nullif(trim(body), ''), case when ok then 'b' || (doc_id % 3) end) as body, coalesce(source_url, case when ok and doc_id % 5 <> 0 then 'http://m/' || doc_id end) as source_url,
  case when ok then case when doc_id % 4 = 0 then '/s/' || doc_id else 'f' || doc_id || '.pdf' end end as source_path from d"""
)
def resolved_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's column, else its JSON metadata, text only; broken JSON gives nothing."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.expr("case when doc_id % 7 = 0 then ' ' when doc_id % 2 = 0 then source end").alias("body"), F.expr("case when doc_id % 9 = 0 then 'http://c' end").alias("source_url"), F.expr(_META).alias("metadata_json"))
    return browse.resolved(docs).select("document_id", "body", "source_url", "source_path")


@query(
    """select event_id, case when event_id % 11 = 0 then 'label is empty' when event_id % 13 = 0 then 'confidence isn''t from 0 to 1' when event_id % 7 = 0 then 'evidence is of another document'
  when event_id % 5 = 0 then 'page_start is less than 1' when event_id % 3 = 0 then 'page_end comes before page_start' when event_id % 17 = 0 then 'a quote is empty' end as problem from events"""
)
def item_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with items and their evidence, the first fault of each."""
    expr = F.expr
    evidence = F.array(F.struct(expr("case when event_id % 7 = 0 then 'other' else 'd' end").alias("document_id"), expr("event_id % 5").alias("page_start"), expr("event_id % 5 - if(event_id % 3 = 0, 1, 0)").alias("page_end"), expr("if(event_id % 17 = 0, ' ', 'q')").alias("quote"), F.lit("validated").alias("validation_status")))
    items = table(spark, sf_dir, "events").select("event_id", F.lit("d").alias("document_id"), F.col("event_type").alias("item_type"), expr("if(event_id % 11 = 0, ' ', 'l')").alias("label"), F.lit("rules").alias("extractor"), expr("if(event_id % 13 = 0, 1.5D, 0.5D)").alias("confidence"), evidence.alias("evidence"))
    return records.problems(items).select("event_id", "problem")


@query(f"with {q._LATEST} select job_id, case status when 'failed' then 'pending' else status end as status, case status when 'done' then 'was done' end as error from latest")
def retry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after all failed jobs were tried again: pending and without their error; others keep what they had."""
    log = q._job_log(spark, sf_dir).withColumn("error", F.when(F.col("status") == "failed", "boom").when(F.col("status") == "done", "was done")).withColumn("seq", F.col("seq").cast("long"))
    again = jobs.retried(jobs.state(log), F.lit("2100-01-01").cast("timestamp"))
    return jobs.state(log.unionByName(again)).select("job_id", "status", "error")


@query(f"with {q._LATEST} select cast(job_id as varchar) as job_id, job_id || ' ' || status || ' ingest updated_at=t' || case when job_id % 2 = 0 then ' path=/in/' || job_id || '.pdf' else '' end || case status when 'failed' then ' failed_at=t error=boom' else '' end as line from latest")
def job_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.state(q._job_log(spark, sf_dir))
    payload = F.when(F.col("job_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("/in/"), F.col("job_id").cast("string"), F.lit(".pdf")).alias("path")))).otherwise("{}")
    rows = rows.select(F.col("job_id").cast("string").alias("job_id"), "status", F.lit("ingest").alias("kind"), F.lit("t").alias("updated_at"), payload.alias("payload_json"), F.when(F.col("status") == "failed", "boom").alias("error"))
    return jobs.lines(rows)


@query(
    q._with(tb.FACT_SQL, q._FACTS, q._FIRST, q._BROWSE_DOCS)
    + """select row_number() over (order by day desc, id) as place, document_id, label from (
  select i.document_id, label, '2024-01-' || lpad(cast(page_number % 28 + 1 as varchar), 2, '0') as day, i.document_id || '|' || page_number || '|' || label as id
  from items i join docs d on i.document_id = d.document_id where item_type = 'action') qualify place <= 80"""
)
def browse_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, the newest first."""
    items = q._items(spark, sf_dir, q._SHOWN, ("action",)).withColumns({"item_id": F.concat_ws("|", "document_id", F.col("page_start").cast("string"), "label"), "created_at": F.concat(F.lit("2024-01-"), F.lpad((F.col("page_start") % 28 + 1).cast("string"), 2, "0"))})
    page = browse.browse(items, q._browse_docs(spark, sf_dir), ("action",), order="created", limit=80)
    return page.select(F.col("place").cast("long").alias("place"), "document_id", "label")


@query(q._with(tb.FACT_SQL, q._FACTS, q._FIRST) + "select document_id, label, page_number as first_page from items where item_type = 'money' and document_id = '4'")
def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one document and type with their evidence."""
    rows = q._items(spark, sf_dir, (*q._SHOWN, "quote"), ("money",)).withColumn("item_id", F.concat_ws("|", "document_id", "item_type", F.col("page_start").cast("string"), "label"))
    evidence = rows.select("item_id", "page_start", F.col("item_id").alias("evidence_id"), F.col("page_start").alias("page_end"), "quote")
    return browse.list_items(rows, evidence, "4", "money").select("document_id", "label", F.get("evidence", F.lit(0))["page_start"].alias("first_page"))


@query(
    q._with(tb.FACT_SQL, q._FACTS, q._FIRST, q._NOTABLE)
    + """select document_id, array_to_string(list_filter([case when bool_or(item_type = 'money') then 'What funding source, vendor, or approval history explains the money mentioned?' end,
  case when bool_or(item_type in ('deadline', 'date')) then 'What happens before or after the cited date or deadline?' end, case when bool_or(item_type = 'action') then 'Who took the cited action, and what was the vote or decision context?' end,
  case when bool_or(item_type = 'entity') then 'What role do the named people or organizations play in the document?' end], lambda x: x is not null), '|') as questions, count(*) as n from notable group by document_id"""
)
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"), F.lit(None).cast("string").alias("meeting_date"))
    made = briefs.briefs(docs, tb.fact_pages(spark, sf_dir), q._items(spark, sf_dir)).where("status = 'draft'")
    return made.select("document_id", F.array_join("open_questions", "|").alias("questions"), F.col("n_items").cast("long").alias("n"))


@query(
    q._with(tb.CORPUS_SQL)
    + f""", c as (select document_id, unnest([0, 1]) as k from corpus where length(text) >= 200 and cast(document_id as bigint) % 3 <> 0 and {q._collapse('substr(text, 101, 60)')} <> '')
select document_id || '-' || k as claim_id, case k when 0 then 'summary' else 'story_lead' end as item_type, case k when 0 then 0.8 else 0.7 end as confidence, 'page-' || document_id || '-1' as page_id from c"""
)
def accepted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses whose every quote stands in the cited page; a third of them quote something else once, and fall as a whole."""
    docs = tb.corpus(spark, sf_dir)
    quote = F.substring("text", 101, 60)
    proof = lambda x: F.struct(F.lit(1).alias("page_start"), x.alias("quote"))
    wrong = F.when(F.col("document_id").cast("long") % 3 == 0, F.concat(F.lit("no such "), quote)).otherwise(quote)
    claim = F.struct(F.lit("Lead").alias("label"), F.lit("Why").alias("summary"), proof(wrong).alias("evidence"))
    none = F.array().cast("array<string>")
    body = F.to_json(F.struct(F.lit("Sum").alias("summary"), F.array(proof(quote)).alias("summary_evidence"), none.alias("notable_actions"), F.array(claim).alias("story_leads"), none.alias("open_questions")))
    pages = tb.corpus_pages(docs).withColumn("page_id", F.concat_ws("-", F.lit("page"), "document_id", F.col("page_number").cast("string")))
    nothing = spark.createDataFrame([], "document_id string, passage_id string, page_start long, page_end long, ordinal long, text string")
    made = enrich.enrich(docs.where("length(text) >= 200").select("document_id", body.alias("body")), enrich.contexts(pages, nothing))
    return enrich.accepted(made).select("claim_id", "item_type", "confidence", "page_id")


_NEAR = "len(list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'public' and list_contains(toks[greatest(1, i - 4):i + 4], 'license')))"


@query(q._with(tb.CORPUS_SQL) + "," + q._bm25_sql([q._words("public"), q._words("license")], "near > 0", 30).replace("len(toks) as dl,", f"len(toks) as dl, {_NEAR} as near,"))
def bm25_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words with at most three between them."""
    return q._bm25(spark, sf_dir, "NEAR(public license, 3)", 30)


_ONE_HIT = q._hybrid_sql("zebra", 10, 1.9).replace("then '• ' || text else text end as text\n  from conversations", "then '• ' || text else text end || case when conv_id = 3 and turn = 0 then ' zebra' else '' end as text\n  from conversations")


@query(_ONE_HIT)
def hybrid_one_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyword hit: vector candidates must come near its own distance."""
    passages, documents, vectors = tb.turns(spark, sf_dir)
    passages = passages.withColumn("text", F.when(F.col("passage_id") == "3-000", F.concat("text", F.lit(" zebra"))).otherwise(F.col("text")))
    found = hybrid.hybrid_search(passages, documents, vectors, "zebra", q._vector0(spark, sf_dir), limit=10, max_distance=1.9, stemmed=False)
    return found.select(F.col("rank").cast("long").alias("rank"), "passage_id", "document_id", "citation", *(F.round(c, 6).alias(c) for c in ("score", "keyword_score", "vector_score")))


@query("select case when bool_or(event_type = 'error') then 'error' when bool_or(event_type = 'click') then 'warn' else 'ok' end as level, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'click') as warn, count(*) filter (event_type not in ('error', 'click')) as ok from events")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warn").otherwise("ok")
    return config.worst(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("name"), level.alias("level"), F.lit("").alias("detail"))).select("level", "error", "warn", "ok")


@query(r"select page_id, regexp_replace(regexp_extract(url_decode(replace(regexp_replace(url, '[?#].*$', ''), '+', '%2B')), '([^/]*)$', 1), '(.)\.[^.]*$', '\1') as title from pages")
def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unquoted stem of a path's last part."""
    return table(spark, sf_dir, "pages").select("page_id", ingest.file_stem(F.regexp_replace("url", r"[?#].*\z", "")).alias("title"))


@query("select event_id, 'a=' || case when event_id % 2 = 0 then 'new' else 'old' end || ',b=' || event_type || case when event_id % 2 = 0 then ',c=1' else '' end as merged from events")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored metadata with given values over it."""
    stored = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("event_type"))
    given = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    pairs = F.array_sort(F.transform(F.map_entries(t.merged(stored, given)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(pairs, ",").alias("merged"))


@query("select n_name as name from nation where n_nationkey not in (select s_nationkey from supplier where s_suppkey <= 8)")
def missing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required names that aren't there, as of tables."""
    nation = table(spark, sf_dir, "nation")
    there = table(spark, sf_dir, "supplier").where("s_suppkey <= 8").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return storage.missing_tables(nation.select(F.col("n_name").alias("name")), there)


@query("""select o_orderkey as id, '{"metadata":{"body":"Council"},"path":"/in/' || o_orderkey || '.pdf","pdf_extractor":"auto","source":"files"}' as payload from orders""")
def ingest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of one job for each file."""
    path = F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ingest.payload(path, F.create_map(F.lit("body"), F.lit("Council")), "files", " AUTO ").alias("payload"))


@query("select conv_id, turn, lag(turn) over w as previous, lead(turn) over w as next from conversations window w as (partition by conv_id order by turn)")
def turn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.adjacent(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query(q._with(tb.CORPUS_SQL) + "select document_id, created_at from corpus where body = (select min(source) from documents) order by created_at, document_id limit 1")
def first_of_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup: the first row of a key."""
    docs = tb.corpus(spark, sf_dir)
    key = docs.agg(F.min("body")).first()[0]
    return records.lookup(docs, "body", key, ["created_at", "document_id"]).select("document_id", "created_at")


@query(
    r"""with f as (
  select doc_id, 'money' as item_type, unnest(regexp_extract_all(text, '(?i)\$\s?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s?(?:thousand|million|billion))?')) as m from documents
  union all select doc_id, 'percentage', unnest(regexp_extract_all(text, '(?i)\b(?:\d+\.)?\d+\s?(?:percent\b|%)')) from documents
  union all select doc_id, 'url', unnest(regexp_extract_all(text, '(?i)https?://[^,>)\s]+')) from documents
  union all select doc_id, 'civic_identifier', unnest(regexp_extract_all(text, '(?i)\b(?:resolution|ordinance)(?:\s+(?:number|no\.))?\s+[-a-z0-9]+\b')) from documents
) select cast(doc_id as varchar) as document_id, item_type, regexp_replace(rtrim(m, '.,;:'), '\s+', ' ', 'g') as label from f
union all select cast(doc_id as varchar), 'topic', x from (select doc_id, text, lower(text) as low, unnest(['grant', 'housing', 'ordinance', 'zoning', 'contract']) as x from documents)
  where regexp_matches(low, case x when 'housing' then '\bhousing\b' when 'zoning' then '\b(zoning|rezoning|variance)\b' when 'contract' then '\b(contract|bid|vendor|procurement)\b' else '\b' || x || '\b' end)"""
)
def facts_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of whole documents of all kinds of text, for the rules that RE2 can say."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")
    found = facts.extract(pages, ("document_id", "item_type", "label"), ("money", "percentage", "url", "civic_identifier", "topic"))
    topics = F.col("label").isin("grant", "housing", "ordinance", "zoning", "contract")
    return found.where((F.col("item_type") != "topic") | topics)


_CASES = {
    "money": "The {n} crew spent $1,2{k}0.50 and $ {k} million on it.",
    "percentage": "It is {k}.5 percent or {k}% of all percentages.",
    "deadline": "Bids are due by the clerk within {k} days of posting.",
    "none": "Work was overdue since {k} days and subdue it.",
    "action": "The board DENIED item {k} after it was postponedly held.",
    "entity": "We saw the Harbor {n} Commission in room {k} today.",
    "name": "All {n} Board members and the Staff Report met in room {k}.",
    "identifier": "See ordinance No. {k}-A and Resolution Number R{k} here.",
    "topic": "Their rezoning and wastewater funds were {k} in total.",
}
_TEXT = " ".join(f"when '{c}' then '{x}'" for c, x in _CASES.items())
_KEYS = list(_CASES)


@query(
    f"""with p as (select n_nationkey as k, n_name as raw, upper(substr(n_name, 1, 1)) || lower(regexp_replace(substr(n_name, 2), '[^A-Za-z]', '', 'g')) as n, unnest({_KEYS!r}) as c from nation)
select k || '-' || c as document_id, unnest(case c
  when 'money' then ['money|$1,2' || k || '0.50' , 'money|$ ' || k || ' million'] when 'percentage' then ['percentage|' || k || '.5 percent', 'percentage|' || k || '%']
  when 'deadline' then ['deadline|Bids are due by the clerk within ' || k || ' days of posting.'] when 'action' then ['action|denied'] when 'entity' then ['entity|Harbor ' || n || ' Commission']
  when 'identifier' then ['civic_identifier|ordinance No. ' || k || '-A', 'civic_identifier|Resolution Number R' || k, 'topic|ordinance', 'topic|resolution'] when 'topic' then ['topic|sewer', 'topic|zoning'] else [] end) as fact
from p where k < 10"""
)
def fact_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence a page for each rule, and some that look like it and give nothing."""
    name = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.regexp_replace(F.expr("substring(n_name, 2)"), "[^A-Za-z]", "")))
    rows = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("k"), name.alias("n"), F.explode(F.array(*map(F.lit, _KEYS))).alias("c"))
    text = F.expr(f"case c {_TEXT} end")
    text = F.replace(F.replace(text, F.lit("{k}"), F.col("k")), F.lit("{n}"), F.col("n"))
    pages = rows.select(F.concat_ws("-", "k", "c").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text"))
    return facts.extract(pages, ("document_id", "item_type", "label")).select("document_id", F.concat_ws("|", "item_type", "label").alias("fact"))
