"""Inventory and discovery views: filters, counts, order, pages, evidence and display lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import text as t
from dossier.operators.hybrid import META, SearchError, parse_day

DEFAULT_LIMIT, MAX_LIMIT = 50, 500
TOPICS, ENTITIES, LEADS, TIMELINE = ("topic",), ("entity",), ("story_lead",), ("date", "deadline", "action")


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_LIMIT:
        raise SearchError(f"limit must be from 1 to {MAX_LIMIT}")
    if offset < 0:
        raise SearchError("offset must not be negative")


@dataclass(frozen=True)
class DocumentFilters:
    """Exact, case-sensitive conditions on documents; dates compare as text."""

    query: str | None = None
    since: str | None = None
    body: str | None = None
    min_confidence: float | None = None
    until: str | None = None
    jurisdiction: str | None = None
    item_type: str | None = None
    document_type: str | None = None
    source_url: str | None = None

    def value(self, name: str) -> str | None:
        return (getattr(self, name) or "").strip() or None

    def check(self) -> None:
        a, b = parse_day(self.since, "since"), parse_day(self.until, "until")
        if a and b and a > b:
            raise SearchError("since must not be after until")
        if self.min_confidence is not None and not 0 <= self.min_confidence <= 1:
            raise SearchError("min_confidence must be from 0 to 1")

    def conditions(self) -> list[Column]:
        out = [F.col(n) == v for n in ("body", "document_type", "jurisdiction") if (v := self.value(n))]
        if v := self.value("source_url"):
            out.append((F.col("source_url") == v) | F.coalesce(F.col("meta_source_url") == v, F.lit(False)))
        if v := self.value("since"):
            out.append(F.col("meeting_date") >= v)
        if v := self.value("until"):
            out.append(F.col("meeting_date") <= v)
        return out


def flat_documents(documents: DataFrame) -> DataFrame:
    """Documents with metadata_json spread into columns, strings only, as the filters want them."""
    meta = {n: t.json_text(F.col("metadata_json"), n) for n in ("body", "document_type", "jurisdiction", "meeting_date")}
    more = {f"meta_{n}": t.json_text(F.col("metadata_json"), n) for n in ("source_url", "stored_source_path", "source_filename")}
    return documents.withColumns(meta | more)


def resolved(documents: DataFrame) -> DataFrame:
    """Documents whose columns, where they are empty, take the value of metadata_json."""
    of = lambda n: t.json_text(F.col("metadata_json"), n)
    own = lambda c: t.optional(F.col(c)) if c in documents.columns else F.lit(None).cast("string")
    chains = {c: [own(c), t.optional(of(c))] for c in ("title", "meeting_date", "body", "document_type", "jurisdiction", "source_url")}
    chains["source_path"] = [own("source_path"), t.optional(of("stored_source_path")), t.optional(of("source_filename"))]
    return documents.withColumns({c: F.coalesce(*x) for c, x in chains.items()})


def _with_meta(documents: DataFrame) -> DataFrame:
    missing = [n for n in ("meta_source_url", "meta_stored_source_path", "meta_source_filename") if n not in documents.columns]
    return documents.withColumns({n: F.lit(None).cast("string") for n in missing}) if missing else documents


def best_source() -> Column:
    return F.coalesce(*(t.optional(F.col(c)) for c in ("source_url", "source_path", "meta_stored_source_path", "meta_source_filename")))


def like_any(query: str, columns: list[str]) -> Column:
    """ASCII-lowered LIKE over several columns; % and _ in the query are wildcards."""
    whole = F.lit(False)
    for c in columns:
        whole = whole | t.ascii_lower(F.coalesce(F.col(c), F.lit(""))).like(f"%{query.lower()}%".replace("\\", "\\\\"))
    return whole


def inventory(documents: DataFrame, pages: DataFrame, filters: DocumentFilters = DocumentFilters(), limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One page of documents, newest first: document_id, title, metadata, page_count, source, created_at and total.

    Pages are counted for the documents of the page only.
    """
    check_page(limit, offset)
    filters.check()
    rows = _with_meta(documents)
    for c in filters.conditions():
        rows = rows.where(c)
    if q := filters.value("query"):
        rows = rows.where(like_any(q, ["document_id", "title", "source_path", "source_url", "body"]))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = rows.orderBy(F.desc("created_at"), "document_id").offset(offset).limit(limit)
    counts = pages.join(F.broadcast(shown.select("document_id")), "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"))  # at most MAX_LIMIT ids
    out = shown.join(F.broadcast(counts), "document_id", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("document_id", *"title meeting_date body document_type".split(), F.coalesce("page_count", F.lit(0)).alias("page_count"), best_source().alias("source"), "created_at", "total").orderBy(F.desc("created_at"), "document_id")


def document_lines(page: DataFrame) -> DataFrame:
    """document_id and its display line."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    named = lambda n, c: F.concat(F.lit(n + "="), c)
    return page.select("document_id", F.concat_ws(" | ", "document_id", dash("title"), named("meeting_date", dash("meeting_date")), named("body", dash("body")), named("document_type", dash("document_type")), named("pages", F.col("page_count").cast("string")), named("source", dash("source")), named("created_at", F.col("created_at"))).alias("line"))


def page_counts(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, page_count, text_length; documents without pages have zeros. Pages are pre-aggregated before the join."""
    counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), F.sum(F.length("text")).alias("text_length"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select("document_id").join(counts, "document_id", "left").select("document_id", zero("page_count"), zero("text_length"))


def browse(items: DataFrame, documents: DataFrame, item_types: tuple[str, ...], filters: DocumentFilters = DocumentFilters(), order: str = "label", limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One page of items with their document's metadata, display_date, and total."""
    check_page(limit, offset)
    filters.check()
    if not item_types or not all(x.strip() for x in item_types):
        raise SearchError("item types are missing")
    want = filters.value("item_type")
    if want and want not in item_types:
        raise SearchError(f"item_type must be one of {', '.join(sorted(item_types))}")
    some = items.where(F.col("item_type").isin(*((want,) if want else item_types)))
    if filters.min_confidence is not None:
        some = some.where(F.col("confidence") >= filters.min_confidence)
    docs = _with_meta(documents)
    for c in filters.conditions():
        docs = docs.where(c)
    docs = docs.select("document_id", *META, "meta_source_url", "meta_stored_source_path", "meta_source_filename")
    rows = some.join(docs, "document_id")
    value = {n: F.get_json_object("value_json", f"$.{n}") for n in "date_text date deadline meeting_date".split()}
    shown_date = F.coalesce(*(t.optional(value[n]) for n in "date date_text deadline meeting_date".split()), F.when(F.col("item_type").isin("date", "deadline"), F.col("label")), F.col("meeting_date"))
    keys = {
        "timeline": [F.coalesce(value["date_text"], value["date"], value["deadline"], F.col("meeting_date"), F.col("created_at")).asc(), F.col("label").asc(), F.col("item_id").asc()],
        "created": [F.col("created_at").desc(), F.col("item_id").asc()],
    }.get(order, [t.ascii_lower(F.col("label")).asc(), F.col("created_at").desc(), F.col("item_id").asc()])
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(*keys).offset(offset).limit(limit)
    place = (F.row_number().over(Window.orderBy(*keys)) + offset).alias("place")
    return page.crossJoin(F.broadcast(total)).select(place, "item_id", "document_id", "item_type", "label", "summary", "confidence", shown_date.alias("display_date"), "title", "meeting_date", best_source().alias("source"), "total").orderBy("place")


def nested(evidence: DataFrame, *key: str) -> DataFrame:
    """The key's columns and `evidence`, its rows in order of page and id."""
    return evidence.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("page_start", "evidence_id", "page_end", "quote"))).alias("evidence"))


def with_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Items with their evidence, nested in order of page and id; items without have an empty array.

    The evidence isn't broadcast: its size, where it comes from a table function, can't be
    told from that of the files behind it.
    """
    rows = nested(evidence, "item_id")
    return items.join(rows.hint("merge"), "item_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(rows.schema["evidence"].dataType)))


def list_items(items: DataFrame, evidence: DataFrame, document_id: str | None = None, item_type: str | None = None, item_id: str | None = None) -> DataFrame:
    """Items with their evidence, of a document, a type, an id, or all; in order of created_at and id."""
    rows = items
    for c, v in (("document_id", document_id), ("item_type", item_type), ("item_id", item_id)):
        rows = rows.where(F.col(c) == v) if v is not None else rows
    return with_evidence(rows, evidence).orderBy("created_at", "item_id")


def item_show(items: DataFrame, documents: DataFrame, item_id: str) -> DataFrame:
    return items.where(F.col("item_id") == item_id).join(documents.select("document_id", "title", "meeting_date"), "document_id")


def labels_in_order(items: DataFrame) -> DataFrame:
    """document_id, item_type and the different labels in order of first sight (created_at, item_id)."""
    first = items.groupBy("document_id", "item_type", "label").agg(F.min(F.struct("created_at", "item_id")).alias("_first"))
    return first.groupBy("document_id", "item_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "label"))), lambda x: x["label"]).alias("labels"))


def packet(results: DataFrame, query: str, labels: list[str] | None = None) -> str:
    """The Markdown source packet of at most some dozens of ranked results, as `hybrid_search` returns them."""
    rows = results.orderBy("rank").collect()
    out = ["# Source Packet: " + query, ""]
    out += ["Filters: " + ", ".join(labels), ""] if labels else []
    out += ["## Key Evidence", ""]
    for r in rows:
        out += [f"{r['rank']}. **{r['citation']}**", f"   > {' '.join((r['text'] or '').split())}", ""]
    out += [] if rows else ["No evidence found.", ""]
    dated = sorted((r["meeting_date"], r["citation"]) for r in rows if r["meeting_date"] is not None)
    out += ["## Timeline", ""] + ([f"- {d} — {c}" for d, c in dated] or ["- No dated evidence found."]) + [""]
    asked = ("What additional source documents should be reviewed?", "Are there related agenda items, minutes, or staff reports that corroborate this evidence?")
    out += ["## Open Questions", ""] + [f"- {q}" for q in asked] + ["", "## Source List", ""]
    names = {"title": "title", "body": "body", "meeting date": "meeting_date", "document type": "document_type", "jurisdiction": "jurisdiction", "source file": "source_path", "source URL": "source_url"}
    for r in rows:
        details = [f"page {r['page_start']}"] + [f"{k}: {r[c].strip()}" for k, c in names.items() if (r[c] or "").strip()]
        out.append(f"- {r['citation']} ({'; '.join(details)})")
    out += [] if rows else ["- No sources found."]
    return "\n".join([*out, ""])


def write_packet(path: str, content: str, overwrite: bool = False) -> None:
    try:
        with open(path, "w" if overwrite else "x", encoding="utf-8") as f:
            f.write(content)
    except FileExistsError as e:
        raise SearchError(f"{path} is there already; pass overwrite to replace it") from e
