"""Vector search and the hybrid ranked query: keyword and vector candidates, expansion, filter, gate, merge, rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import text as t
from dossier.operators import lexical

LIMIT, CANDIDATES_A_RESULT, CANDIDATES_AT_LEAST = 5, 4, 20
KEYWORD_WEIGHT, VECTOR_WEIGHT = 0.6, 0.4
MAX_DISTANCE, MARGIN, STRONG = 1.0, 0.08, 0.98
HIT_CHARS, NEIGHBOUR_CHARS, PENALTY = 220, 320, 0.5
BULLET = "•"
META = "title meeting_date body document_type jurisdiction source_url source_path".split()


class SearchError(ValueError):
    """An option isn't valid."""


def held(df: DataFrame, bound: int) -> DataFrame:
    """The rows of a frame of at most `bound` rows as a local table, so that later steps don't scan its sources again."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)


def parse_day(value: str | None, name: str) -> date | None:
    if value is None or not value.strip():
        return None
    try:
        return date.fromisoformat(value.strip())
    except ValueError as e:
        raise SearchError(f"{name} must be a date as YYYY-MM-DD") from e


@dataclass(frozen=True)
class Filters:
    """Conditions on a passage's document. Text compares under case folding; a missing value fails."""

    since: str | None = None
    body: str | None = None
    until: str | None = None
    jurisdiction: str | None = None
    document_type: str | None = None
    source_url: str | None = None

    def days(self) -> tuple[date | None, date | None]:
        a, b = parse_day(self.since, "since"), parse_day(self.until, "until")
        if a and b and a > b:
            raise SearchError("since must not be after until")
        return a, b

    def labels(self) -> list[str]:
        names = ("body", "document_type", "jurisdiction", "source_url", "since", "until")
        return [f"{n}={getattr(self, n).strip()}" for n in names if (getattr(self, n) or "").strip()]

    def condition(self) -> Column | None:
        out = []
        for n in ("body", "document_type", "jurisdiction", "source_url"):
            v = (getattr(self, n) or "").strip()
            if v:
                out.append(F.coalesce(t.casefold_equal(t.optional(F.col(n)), v), F.lit(False)))
        since, until = self.days()
        day = t.iso_date(F.col("meeting_date"))
        if since:
            out.append(F.coalesce(day >= F.lit(since), F.lit(False)))
        if until:
            out.append(F.coalesce(day <= F.lit(until), F.lit(False)))
        whole = None
        for c in out:
            whole = c if whole is None else whole & c
        return whole


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    """Squared Euclidean distance in double precision, inside the JVM. Null if a length differs."""
    q = F.array(*(F.lit(float(x)) for x in query))
    terms = F.zip_with(vector.cast("array<double>"), q, lambda a, b: (a - b) * (a - b))
    return F.when(F.size(vector) == len(query), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def vector_search(vectors: DataFrame, query: Sequence[float], limit: int, max_distance: float | None = MAX_DISTANCE, id_column: str = "passage_id") -> DataFrame:
    """`id_column` and vector_score of the nearest `limit` vectors, then those within `max_distance`; ties to the smaller id."""
    if not len(query):
        raise SearchError("the query vector is empty")
    near = vectors.select(id_column, squared_distance(F.col("vector"), query).alias("vector_score")).where("vector_score is not null").orderBy("vector_score", id_column).limit(limit)
    return near if max_distance is None else near.where(F.col("vector_score") <= max_distance)


def expand_neighbours(hits: DataFrame, passages: DataFrame, limit: int) -> DataFrame:
    """hits (passage_id, keyword_score; at most `limit`, in order of score and id) and bulleted neighbours of lone bulleted hits.

    A neighbour scores its origin's score plus PENALTY; the first origin counts. The hits are
    few, so they are broadcast; neighbours are found by an equi-join on chunk and ordinal.
    """
    rows = passages.select("passage_id", "chunk_id", "ordinal", "text")
    found = rows.join(F.broadcast(hits), "passage_id")
    order = Window.orderBy("keyword_score", "passage_id")
    ranked = found.withColumn("_rank", F.row_number().over(order)).withColumn("_hits", F.count(F.lit(1)).over(Window.partitionBy("chunk_id"))).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy()))
    origins = ranked.where((F.col("_hits") == 1) & F.col("text").startswith(BULLET) & (F.length("text") <= HIT_CHARS))
    wanted = origins.select("chunk_id", F.explode(F.array(F.col("ordinal") - 1, F.col("ordinal") + 1)).alias("ordinal"), "_rank", "_all", "keyword_score")
    near = rows.join(F.broadcast(wanted), ["chunk_id", "ordinal"]).join(F.broadcast(hits.select("passage_id")), "passage_id", "left_anti")
    near = near.where(F.col("text").startswith(BULLET) & (F.length("text") <= NEIGHBOUR_CHARS))
    first = near.withColumn("_k", F.row_number().over(Window.partitionBy("passage_id").orderBy("_rank", "ordinal"))).where("_k = 1")
    place = F.row_number().over(Window.orderBy("_rank", "ordinal", "passage_id"))
    added = first.withColumn("_n", place).where(F.col("_n") <= F.lit(limit) - F.col("_all"))
    return hits.select("passage_id", "keyword_score").unionByName(added.select("passage_id", (F.col("keyword_score") + PENALTY).alias("keyword_score")))


def gate(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Vector candidates that the keyword candidates allow.

    No keyword hit: all. Two or more: those among them. One: if it has a vector hit, that and
    those no further than MARGIN beyond it, at most STRONG; else none.
    """
    marked = vector.join(F.broadcast(keyword.select("passage_id", F.lit(True).alias("_kw"))), "passage_id", "left")
    stats = keyword.agg(F.count(F.lit(1)).alias("_n"))
    best = marked.where("_kw").agg(F.min("vector_score").alias("_best"))
    rows = marked.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(best))  # one row each
    allowed = F.least(F.lit(STRONG), F.col("_best") + MARGIN)
    both = F.coalesce(F.col("_kw"), F.lit(False))
    ok = F.when(F.col("_n") == 0, True).when(F.col("_n") >= 2, both).otherwise(F.col("_best").isNotNull() & (both | (F.col("vector_score") <= allowed)))
    return rows.where(ok).select("passage_id", "vector_score")


def normalized(score: str) -> Column:
    """Lower is better: (max - x) / (max - min) over all rows that have one; 1 if they are equal."""
    every = Window.partitionBy()
    low, high = F.min(score).over(every), F.max(score).over(every)
    return F.when(F.col(score).isNull(), 0.0).when(low == high, 1.0).otherwise((high - F.col(score)) / (high - low))


def hybrid_search(
    passages: DataFrame,
    documents: DataFrame,
    vectors: DataFrame,
    query: str,
    query_vector: Sequence[float],
    filters: Filters = Filters(),
    limit: int = LIMIT,
    max_distance: float | None = MAX_DISTANCE,
    keyword_weight: float = KEYWORD_WEIGHT,
    vector_weight: float = VECTOR_WEIGHT,
    stemmed: bool = True,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
    index: lexical.Index | None = None,
) -> DataFrame:
    """rank, passage_id, document_id, citation, score, keyword_score, vector_score and the document's metadata.

    Candidates are taken before the filter applies, so the two top-k passes are the only ones
    over all rows; what follows is at most twice the candidate limit. With an index of the
    passages the keyword pass reads only the postings of the query's terms.
    """
    if not query.strip():
        raise SearchError("the query is empty")
    if limit < 1:
        raise SearchError("limit must be at least 1")
    filters.days()
    take = max(limit * CANDIDATES_A_RESULT, CANDIDATES_AT_LEAST)
    found = lexical.search(passages, query, take, stemmed) if index is None else lexical.search_index(passages.sparkSession, index, query, take)
    hits = held(found, take)
    hits = held(expand_neighbours(hits, passages, take), take)
    near = held(vector_search(vectors, query_vector, take, max_distance), take)
    if "metadata_json" in documents.columns:
        from dossier.operators.browse import resolved  # which needs this module

        documents = resolved(documents)
    fields = [c for c in META if c in documents.columns]
    missing = [F.lit(None).cast("string").alias(c) for c in META if c not in documents.columns]
    facts = documents.select("document_id", *(t.optional(F.col(c)).alias(c) for c in fields), *missing)
    condition = filters.condition()

    def kept(candidates: DataFrame) -> DataFrame:
        rows = passages.select("passage_id", "document_id").join(F.broadcast(candidates), "passage_id")
        if condition is not None:
            rows = facts.join(F.broadcast(rows), "document_id").where(condition)  # at most 2 * take rows
        return rows.select(*candidates.columns)

    keyword = kept(hits) if condition is not None else hits
    vector = gate(keyword, near)
    merged = keyword.join(vector, "passage_id", "full_outer")
    columns = ["passage_id", "document_id", "page_start", "text"]
    context = passages.select(*columns).join(F.broadcast(merged), "passage_id")
    context = facts.join(F.broadcast(context), "document_id")
    if condition is not None:
        context = context.where(condition)
    scored = context.withColumn("score", keyword_weight * normalized("keyword_score") + vector_weight * normalized("vector_score"))
    scored = scored.withColumn("citation", t.citation(F.col("title"), F.col("meeting_date"), F.col("page_start")))
    best = scored.orderBy(F.desc("score"), "citation", "passage_id").limit(limit)
    if rerank is not None:
        return rerank(best)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "citation", "passage_id"))
    return best.select(rank.alias("rank"), "passage_id", "document_id", "page_start", "citation", "score", "keyword_score", "vector_score", *META, "text").orderBy("rank")


def result_lines(results: DataFrame, query: str | None = None) -> DataFrame:
    """rank and line, the text of one result: citation, then the snippet."""
    return results.select("rank", F.concat_ws("\n", "citation", t.snippet(t.collapse(F.col("text")), query)).alias("line")).orderBy("rank")
