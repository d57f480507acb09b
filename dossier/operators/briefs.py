"""Document briefs: capped selection of notable items, and the sentences made from them, for all documents at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_TEXT, MAX_ITEMS = 40, 8
ORDER = "topic action deadline money civic_identifier date percentage entity url".split()
CAPS = {"topic": 3, "entity": 2}
OTHER_CAP, LAST = 99, 99


def priority(item_type: Column) -> Column:
    out = None
    for k, name in enumerate(ORDER):
        out = F.when(item_type == name, k) if out is None else out.when(item_type == name, k)
    return out.otherwise(LAST)


def notable(items: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Items with evidence, capped by type and document; adds `place` from 1.

    items: document_id, item_id, item_type, label, confidence, page_start (null without evidence), created_at.
    Both windows have limits, so each task keeps only its best before rows meet. Types whose own
    cap can't be reached within `max_items` share one window, so that a task sends no more than
    `max_items` rows of them for a document.
    """
    cap = None
    for name, k in CAPS.items():
        cap = F.when(F.col("item_type") == name, k) if cap is None else cap.when(F.col("item_type") == name, k)
    ties = [F.coalesce(F.col("confidence"), F.lit(0.0)).desc(), F.col("page_start"), F.lower("label"), F.col("created_at"), F.col("item_id")]
    supported = items.where("page_start is not null").withColumn("_priority", priority(F.col("item_type")))
    most = min(max_items, OTHER_CAP)
    group = F.when(F.col("item_type").isin(*CAPS), F.col("item_type")).otherwise("other") if max_items <= OTHER_CAP else F.col("item_type")
    by_type = F.row_number().over(Window.partitionBy("document_id", "_group").orderBy("_priority", *ties))
    some = supported.withColumn("_group", group).withColumn("_k", by_type).where(F.col("_k") <= most).where(F.col("_k") <= cap.otherwise(most))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("_priority", *ties))
    return some.withColumn("place", place).where(F.col("place") <= max_items).drop("_priority", "_group", "_k")


def joined(labels: Column, fallback: str) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(labels)
    many = F.concat(F.array_join(F.slice(labels, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(labels, -1))
    return F.when(n == 0, fallback).when(n == 1, F.get(labels, F.lit(0))).when(n == 2, F.array_join(labels, " and ")).otherwise(many)


def _present(pairs: Sequence[tuple[Column, Column | str]]) -> Column:
    parts = [F.when(c, F.lit(x) if isinstance(x, str) else x) for c, x in pairs]
    return F.array_compact(F.array(*parts))


def briefs(documents: DataFrame, pages: DataFrame, items: DataFrame) -> DataFrame:
    """document_id, summary, significance, open_questions, n_items of each document with at least MIN_TEXT characters.

    documents: document_id, title, body, meeting_date. pages: document_id, text. Documents with
    less text get status `too short` and no sentences.
    """
    sizes = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("text_length"))
    rows = notable(items)
    listed = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "item_type", "label"))).alias("_items"))  # at most MAX_ITEMS a document

    def labels(kind: str) -> Column:
        return F.array_distinct(F.transform(F.filter(F.col("_items"), lambda x: x["item_type"] == kind), lambda x: x["label"]))

    has = {k: F.size(labels(k)) > 0 for k in ORDER}
    signals = _present(
        [
            (has["action"], "action or vote language"),
            (has["deadline"], "deadline or schedule references"),
            (has["money"], joined(labels("money"), "financial references")),
            (has["civic_identifier"], "ordinance or resolution references"),
            (has["date"], "dated events"),
            (has["percentage"], "percentage-based progress or rate signals"),
        ]
    )
    about = F.concat_ws(", ", "body", "meeting_date")
    title = F.concat(F.coalesce(F.nullif("title", F.lit("")), "document_id"), F.when(about != "", F.concat(F.lit(" ("), about, F.lit(")"))).otherwise(""))
    summary = F.concat(title, F.lit(" contains evidence about "), joined(labels("topic"), "document activity"), F.lit(". Notable extracted signals include "), joined(signals, "evidence-backed document signals"), F.lit("."))
    highlights = _present(
        [(has["deadline"], "deadlines or schedule changes"), (has["money"], "financial commitments"), (has["action"], "formal actions or votes"), (has["civic_identifier"], "ordinances or resolutions"), (has["percentage"], "progress or rate changes")]
    )
    significance = F.when(F.size(highlights) > 0, F.concat(F.lit("The selected evidence highlights "), F.array_join(highlights, ", "), F.lit("."))).otherwise("The selected evidence provides a starting point for document review.")
    questions = _present(
        [
            (has["money"], "What funding source, vendor, or approval history explains the money mentioned?"),
            (has["deadline"] | has["date"], "What happens before or after the cited date or deadline?"),
            (has["action"], "Who took the cited action, and what was the vote or decision context?"),
            (has["entity"], "What role do the named people or organizations play in the document?"),
        ]
    )
    # Merged, not broadcast: sizes of what comes from pages can't be told from the files behind them.
    whole = documents.join(sizes.hint("merge"), "document_id", "left").join(listed.hint("merge"), "document_id", "left").withColumn("_items", F.coalesce("_items", F.array().cast("array<struct<place:int,item_type:string,label:string>>")))
    enough = F.coalesce(F.col("text_length"), F.lit(0)) >= MIN_TEXT
    return whole.select(
        "document_id",
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce("text_length", F.lit(0)).alias("text_length"),
        F.when(enough, "draft").otherwise("too short").alias("status"),
        F.when(enough, summary).alias("summary"),
        F.when(enough, significance).alias("significance"),
        F.when(enough, questions).alias("open_questions"),
        F.size("_items").alias("n_items"),
    )
