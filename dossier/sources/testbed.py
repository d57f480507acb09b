"""The document model over the synthetic tables: adapters, as each query uses them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import spread, table

PAGE_CHARS = 5000

#: DuckDB text of the same adapters.
CORPUS_SQL = """
corpus as (
  select cast(doc_id as varchar) as document_id,
    case when doc_id % 5 <> 0 then 'Document ' || doc_id end as title,
    case when doc_id % 4 = 0 then 'https://example.test/d/' || doc_id end as source_url,
    case when doc_id % 3 = 0 then '/in/' || doc_id || '.pdf' end as source_path,
    source as body, lang as jurisdiction,
    case doc_id % 3 when 0 then 'agenda' when 1 then 'minutes' else 'report' end as document_type,
    case when doc_id % 7 <> 0 then strftime(date '2024-01-01' + cast(doc_id % 365 as integer), '%Y-%m-%d') end as meeting_date,
    strftime(date '2024-03-01' + cast(doc_id % 50 as integer), '%Y-%m-%d') || ' 00:00:00' as created_at,
    text
  from documents
)"""

PAGES_SQL = f"""
corpus_pages as (
  select document_id, k + 1 as page_number, substr(text, k * {PAGE_CHARS} + 1, {PAGE_CHARS}) as text
  from (select document_id, text, unnest(range(0, (length(text) + {PAGE_CHARS} - 1) // {PAGE_CHARS})) as k from corpus)
)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with metadata made from their ids; some of it is missing."""
    i = F.col("doc_id")
    day = lambda first, m: F.date_format(F.date_add(F.lit(first).cast("date"), (i % m).cast("int")), "yyyy-MM-dd")
    return spread(table(spark, sf_dir, "documents")).select(
        i.cast("string").alias("document_id"),
        F.when(i % 5 != 0, F.concat(F.lit("Document "), i.cast("string"))).alias("title"),
        F.when(i % 4 == 0, F.concat(F.lit("https://example.test/d/"), i.cast("string"))).alias("source_url"),
        F.when(i % 3 == 0, F.concat(F.lit("/in/"), i.cast("string"), F.lit(".pdf"))).alias("source_path"),
        F.col("source").alias("body"),
        F.col("lang").alias("jurisdiction"),
        F.when(i % 3 == 0, "agenda").when(i % 3 == 1, "minutes").otherwise("report").alias("document_type"),
        F.when(i % 7 != 0, day("2024-01-01", 365)).alias("meeting_date"),
        F.concat(day("2024-03-01", 50), F.lit(" 00:00:00")).alias("created_at"),
        "text",
    )


def corpus_pages(corpus_rows: DataFrame) -> DataFrame:
    """Pages of PAGE_CHARS characters."""
    last = F.ceil(F.length("text") / PAGE_CHARS).cast("int") - 1
    rows = corpus_rows.where("length(text) > 0").select("document_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("_k"))
    return rows.select("document_id", (F.col("_k") + 1).cast("long").alias("page_number"), F.substring("text", F.col("_k") * PAGE_CHARS + 1, F.lit(PAGE_CHARS)).alias("text"))


#: Sentences made from orders and customers, for fact extraction.
FACT_SQL = """
fact_pages as (
  select cast(o_custkey as varchar) as document_id, o_orderkey + 1 as page_number,
    'The Council ' || case o_orderstatus when 'F' then 'approved' when 'O' then 'tabled' else 'amended' end
      || ' $' || cast(floor(o_totalprice) as bigint) || ' for a contract with ' || case when o_orderkey % 2 = 0 then 'Harbor Construction' else 'Mill Road Library' end
      || '. Work on the road must begin by ' || strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ', ' || year(o_orderdate)
      || ' and is ' || (o_orderkey % 100) || '% funded. Resolution No. ' || (o_orderkey % 89) || '-' || (o_orderkey % 7)
      || ' authorizes https://example.test/p/' || o_orderkey || ', dated ' || strftime(o_orderdate, '%Y-%m-%d') || '.' as text
  from orders
)"""


def fact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d, s = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    lit = F.lit
    text = F.concat(
        lit("The Council "),
        F.when(s == "F", "approved").when(s == "O", "tabled").otherwise("amended"),
        lit(" $"),
        F.floor("o_totalprice").cast("string"),
        lit(" for a contract with "),
        F.when(i % 2 == 0, "Harbor Construction").otherwise("Mill Road Library"),
        lit(". Work on the road must begin by "),
        F.date_format(d, "MMMM"),
        lit(" "),
        F.dayofmonth(d).cast("string"),
        lit(", "),
        F.year(d).cast("string"),
        lit(" and is "),
        (i % 100).cast("string"),
        lit("% funded. Resolution No. "),
        (i % 89).cast("string"),
        lit("-"),
        (i % 7).cast("string"),
        lit(" authorizes https://example.test/p/"),
        i.cast("string"),
        lit(", dated "),
        F.date_format(d, "yyyy-MM-dd"),
        lit("."),
    )
    return spread(table(spark, sf_dir, "orders")).select(F.col("o_custkey").cast("string").alias("document_id"), (i + 1).alias("page_number"), text.alias("text"))


#: Turns of conversations as bulleted passages of a chunk, with vectors for some.
TURNS_SQL = """
turns as (
  select conv_id || '-' || lpad(cast(turn as varchar), 3, '0') as passage_id, cast(conv_id as varchar) as chunk_id, cast(conv_id as varchar) as document_id,
    conv_id % 9 + 1 as page_start, turn as ordinal, case when (conv_id + turn) % 3 <> 0 then '• ' || text else text end as text
  from conversations
), turn_documents as (
  select distinct cast(conv_id as varchar) as document_id, case when conv_id % 5 <> 0 then 'Talk ' || conv_id end as title,
    case when conv_id % 7 <> 0 then strftime(date '2024-01-01' + cast(conv_id % 365 as integer), '%Y-%m-%d') end as meeting_date,
    case conv_id % 3 when 0 then 'Council' when 1 then 'Planning' end as body
  from conversations
), turn_vectors as (
  select t.passage_id, list_transform(embedding, lambda x: cast(x as double)) as vector
  from (select conv_id || '-' || lpad(cast(turn as varchar), 3, '0') as passage_id, conv_id * 3 + turn as v from conversations) t join embeddings on v = vec_id
)"""


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """passages, documents, vectors."""
    c = table(spark, sf_dir, "conversations")
    i, k = F.col("conv_id"), F.col("turn")
    pid = F.concat(i.cast("string"), F.lit("-"), F.lpad(k.cast("string"), 3, "0"))
    text = F.when((i + k) % 3 != 0, F.concat(F.lit("• "), F.col("text"))).otherwise(F.col("text"))
    passages = c.select(pid.alias("passage_id"), i.cast("string").alias("chunk_id"), i.cast("string").alias("document_id"), (i % 9 + 1).alias("page_start"), k.alias("ordinal"), text.alias("text"))
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")), "yyyy-MM-dd")
    documents = c.select("conv_id").distinct().select(
        i.cast("string").alias("document_id"), F.when(i % 5 != 0, F.concat(F.lit("Talk "), i.cast("string"))).alias("title"), F.when(i % 7 != 0, date).alias("meeting_date"), F.when(i % 3 == 0, "Council").when(i % 3 == 1, "Planning").alias("body")
    )
    vectors = c.select(pid.alias("passage_id"), (i * 3 + k).alias("vec_id")).join(table(spark, sf_dir, "embeddings"), "vec_id").select("passage_id", F.col("embedding").cast("array<double>").alias("vector"))
    return passages, documents, vectors
