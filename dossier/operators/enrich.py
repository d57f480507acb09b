"""Quote-validated enrichment: claims are kept only if every quote stands in the cited pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import text as t

_EVIDENCE = T.StructType([T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType()), T.StructField("quote", T.StringType()), T.StructField("passage_id", T.StringType())])
_CLAIM = T.StructType([T.StructField("label", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("evidence", _EVIDENCE)])
RESPONSE = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("summary_evidence", T.ArrayType(_EVIDENCE)),
        T.StructField("notable_actions", T.ArrayType(_CLAIM)),
        T.StructField("story_leads", T.ArrayType(_CLAIM)),
        T.StructField("open_questions", T.ArrayType(T.StringType())),
    ]
)
CONFIDENCE = {"summary": 0.8, "action": 0.78, "story_lead": 0.7}


class EnrichmentError(ValueError):
    """A response isn't valid, or a quote has no support."""


def for_match(c: Column) -> Column:
    """Case folded, white space collapsed."""
    return t.casefold(t.collapse(c))


def contexts(pages: DataFrame, passages: DataFrame) -> DataFrame:
    """document_id, source_rank, place, page_id, passage_id, page_start, page_end, text: pages come before passages."""
    none = F.lit(None).cast("string")
    a = pages.select("document_id", F.lit(0).alias("source_rank"), F.struct(F.col("page_number").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("page_id").alias("c")).alias("place"), "page_id", none.alias("passage_id"), F.col("page_number").cast("long").alias("page_start"), F.col("page_number").cast("long").alias("page_end"), "text")
    b = passages.select("document_id", F.lit(1).alias("source_rank"), F.struct(F.col("page_start").cast("long").alias("a"), F.col("ordinal").cast("long").alias("b"), F.col("passage_id").alias("c")).alias("place"), none.alias("page_id"), "passage_id", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), "text")
    return a.unionByName(b)


def support(claims: DataFrame, where: DataFrame) -> DataFrame:
    """claims (claim_id, document_id, page_start, page_end, quote, passage_id) with the first supporting context, or nulls.

    An equi-join on the document; overlap of pages and then containment are its residual, so
    that only the text of cited pages is normalized. The first support is a minimum, taken by
    an aggregate that combines within tasks.
    """
    c = claims.select("claim_id", "document_id", F.col("page_start").alias("_s"), F.coalesce(F.nullif("page_end", F.lit(0)), "page_start").alias("_e"), for_match(F.col("quote")).alias("_q"), F.col("passage_id").alias("_p"))
    x = where.select("document_id", "source_rank", "place", "page_id", F.col("passage_id").alias("found_passage"), "page_start", "page_end", F.col("text").alias("_t"))
    hit = (c["document_id"] == x["document_id"]) & (x["page_start"] <= c["_e"]) & (x["page_end"] >= c["_s"]) & (c["_p"].isNull() | c["_p"].eqNullSafe(x["found_passage"])) & for_match(x["_t"]).contains(c["_q"])
    found = c.join(x, hit).groupBy("claim_id").agg(F.min_by(F.struct(F.col("page_id").alias("page_id"), F.col("found_passage").alias("passage_id"), F.lit(True).alias("supported")), F.struct("source_rank", "place")).alias("_f"))
    return claims.drop("passage_id").join(found, "claim_id", "left").select(*[k for k in claims.columns if k != "passage_id"], F.col("_f.page_id").alias("page_id"), F.col("_f.passage_id").alias("passage_id"), F.coalesce(F.col("_f.supported"), F.lit(False)).alias("supported"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """document_id and body from JSON files, one a document, whose names are the documents' ids."""
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path)
    return rows.select(F.regexp_extract(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"([^/]*)\.json\z", 1).alias("document_id"), F.col("value").alias("body"))


def rows_of(good: DataFrame, responses: DataFrame, provider: str, model: str, created_at: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, evidence, briefs) of accepted claims, for `storage.append_items`."""
    now = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    item = F.concat(F.lit("item-"), F.substring(F.sha2(F.concat_ws("|", "claim_id", "item_type", "label", "summary"), 256), 1, 16))
    none = F.lit(None).cast("string")
    items = good.select(item.alias("item_id"), "document_id", "item_type", "label", F.lit("{}").alias("value_json"), "summary", "confidence", F.lit("enrichment").alias("extractor"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), now.alias("created_at"))
    evidence = good.select(F.concat(item, F.lit("-1")).alias("evidence_id"), item.alias("item_id"), "document_id", "page_id", "passage_id", "page_start", "page_end", "quote", F.lit("validated").alias("validation_status"))
    parsed = parse_responses(responses).where("problem is null").join(good.select("document_id").distinct(), "document_id", "left_semi")
    brief = F.concat(F.lit("brief-"), F.substring(F.sha2(F.concat_ws("|", "document_id", F.col("r.summary")), 256), 1, 16))
    briefs = parsed.select(brief.alias("brief_id"), "document_id", F.trim("r.summary").alias("summary"), none.alias("significance"), F.col("r.open_questions").alias("open_questions"), F.lit("enrichment").alias("extractor"), F.lit("validated").alias("status"), now.alias("created_at"))
    return items, evidence, briefs


def parse_responses(responses: DataFrame) -> DataFrame:
    """document_id, r (the response) and problem, null if its form is right. responses: document_id, body (JSON text)."""
    r = F.from_json("body", RESPONSE)
    rows = responses.select("document_id", r.alias("r"), F.try_parse_json("body").alias("_v"))
    lists = ("summary_evidence", "notable_actions", "story_leads", "open_questions")
    blank = lambda c: t.optional(c).isNull()
    bad_evidence = lambda e: e.isNull() | e["page_start"].isNull() | (e["page_start"] < 1) | (F.coalesce(F.nullif(e["page_end"], F.lit(0)), e["page_start"]) < e["page_start"]) | blank(e["quote"])
    bad_claim = lambda c: c.isNull() | blank(c["label"]) | blank(c["summary"]) | bad_evidence(c["evidence"])
    problem = F.when(F.col("_v").isNull(), "not JSON").when(blank(F.col("r.summary")), "summary is missing")
    for n in lists:
        problem = problem.when(F.col(f"r.{n}").isNull(), f"{n} is missing")
    problem = problem.when(F.size("r.summary_evidence") == 0, "summary_evidence is empty")
    problem = problem.when(F.exists("r.summary_evidence", bad_evidence), "summary_evidence isn't valid")
    for n in ("notable_actions", "story_leads"):
        problem = problem.when(F.exists(f"r.{n}", bad_claim), f"{n} isn't valid")
    problem = problem.when(F.exists("r.open_questions", blank), "open_questions isn't valid")
    return rows.select("document_id", "r", problem.alias("problem"))


def enrich(responses: DataFrame, where: DataFrame) -> DataFrame:
    """claim_id, document_id, item_type, label, summary, confidence, quote, page_start, page_end, page_id, passage_id, supported, problem.

    A document with a problem has one row that names it. A document is accepted only if all
    its claims are supported: see `accepted`.
    """
    parsed = parse_responses(responses)
    one = lambda kind, label, summary, e: F.struct(F.lit(kind).alias("item_type"), label.alias("label"), summary.alias("summary"), e.alias("evidence"))
    claims = F.concat(
        F.transform("r.summary_evidence", lambda e: one("summary", F.lit("Document summary"), F.col("r.summary"), e)),
        F.transform("r.notable_actions", lambda c: one("action", c["label"], c["summary"], c["evidence"])),
        F.transform("r.story_leads", lambda c: one("story_lead", c["label"], c["summary"], c["evidence"])),
    )
    rows = parsed.where("problem is null").select("document_id", F.posexplode(claims).alias("_k", "_c"))
    confidence = F.lit(CONFIDENCE["summary"])
    for kind in ("action", "story_lead"):
        confidence = F.when(F.col("_c.item_type") == kind, CONFIDENCE[kind]).otherwise(confidence)
    e = F.col("_c.evidence")
    flat = rows.select(
        F.concat_ws("-", "document_id", F.col("_k").cast("string")).alias("claim_id"), "document_id", "_c.item_type", F.trim("_c.label").alias("label"), F.trim("_c.summary").alias("summary"), confidence.alias("confidence"),
        e["quote"].alias("quote"), e["page_start"].cast("long").alias("page_start"), F.coalesce(F.nullif(e["page_end"], F.lit(0)), e["page_start"]).cast("long").alias("page_end"), t.optional(e["passage_id"]).alias("passage_id"),
    )
    good = support(flat, where).withColumn("problem", F.when(~F.col("supported"), "a quote wasn't found in the cited text"))
    bad = parsed.where("problem is not null").select("document_id", "problem")
    return good.unionByName(bad, allowMissingColumns=True)


def accepted(enriched: DataFrame) -> DataFrame:
    """The claims of documents without any problem: all or nothing for each document."""
    failed = enriched.where("problem is not null").select("document_id").distinct()
    return enriched.where("problem is null").join(failed, "document_id", "left_anti")


def require_all(enriched: DataFrame) -> DataFrame:
    """As `enriched`, failing at the first problem."""
    return enriched.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "document_id", "problem"))).cast("string"))
