"""Reports as text: of one page of results each, whose rows are few by their limits."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators.hybrid import Filters, result_lines


def shown(value: object) -> str:
    return "-" if value is None or value == "" else str(value)


def confidence(value: float | None) -> str:
    return "-" if value is None else f"{value:.2f}"


def fields(raw: str | None) -> list[str]:
    """Indented lines of a JSON object's members, by name; text as it is, other values as JSON."""
    try:
        data = json.loads(raw or "{}")
    except ValueError:
        data = {}
    if not isinstance(data, dict) or not data:
        return ["  none"]
    return [f"  {k}: {v if isinstance(v, str) else json.dumps(v, sort_keys=True)}" for k, v in sorted(data.items())]


def pages(start: int, end: int, mark: str = "p.", many: str = "pp.") -> str:
    return f"{mark}{start}" if start == end else f"{many}{start}-{end}"


def search(results: DataFrame, query: str | None = None, filters: Filters = Filters()) -> str:
    rows = results.orderBy("rank").collect()
    lines = {r["rank"]: r["line"] for r in result_lines(results, query).collect()}
    active = ", ".join(filters.labels())
    if not rows:
        return f"No evidence found matching filters: {active}." if active else "No evidence found."
    out = ["Search", *([f"filters: {active}"] if active else [])]
    for r in rows:
        citation, _, body = lines[r["rank"]].partition("\n")
        meta = [f"{n}={r[n].strip()}" for n in ("body", "document_type", "jurisdiction", "source_url") if (r[n] or "").strip()]
        out += [citation, *([f"metadata: {'; '.join(meta)}"] if meta else []), body, ""]
    return "\n".join(out).rstrip()


def document(row) -> str:
    """One document with page_count."""
    names = ("source_url", "source_path", "source_hash", "normalized_path")
    data = row.asDict()
    head = ["Document", f"id: {row['document_id']}", f"title: {shown(data.get('title'))}", f"created_at: {row['created_at']}", f"pages: {row['page_count']}"]
    return "\n".join([*head, *(f"{n}: {shown(data.get(n))}" for n in names), "metadata:", *fields(data.get("metadata_json"))])


def document_list(lines: Sequence[str], total: int, limit: int, offset: int) -> str:
    return "\n".join(["Documents", *_window(len(lines), total, limit, offset, "documents", "document(s)"), *lines])


def _window(n: int, total: int, limit: int, offset: int, empty: str, noun: str) -> list[str]:
    if not n:
        return [f"{empty}: none at offset {offset}; total={total} limit={limit}" if total else f"{empty}: none"]
    more = ["more: use --limit/--offset or filters to narrow results"] if offset + n < total else []
    return [f"showing {n} of {total} {noun}; limit={limit} offset={offset}", *more]


def browse(page: DataFrame, evidence: DataFrame, title: str, empty: str, limit: int, offset: int = 0, total: int | None = None, dated: bool = False) -> str:
    """A page from `browse.browse`, with the first citation of each item. `total`: how many items there are, needed for an empty page only."""
    rows = page.orderBy("place").collect()
    first = evidence.join(F.broadcast(page.select("item_id")), "item_id", "left_semi").groupBy("item_id").agg(F.min_by(F.struct("document_id", "page_start", "page_end"), F.struct("page_start", "evidence_id")).alias("e"))
    cited = {r["item_id"]: r["e"] for r in first.collect()}
    out = [title, *_window(len(rows), rows[0]["total"] if rows else total or 0, limit, offset, empty, "item(s)")]
    for r in rows:
        parts = [r["item_id"], r["item_type"], r["label"], f"confidence={confidence(r['confidence'])}", f"document={r['document_id']}", f"title={shown(r['title'])}", f"meeting_date={shown(r['meeting_date'])}"]
        if dated:
            parts.insert(2, f"date={shown(r['display_date'])}")
        if e := cited.get(r["item_id"]):
            parts.append(f"citation={e['document_id']} {pages(e['page_start'], e['page_end'])}")
        out.append(" | ".join(parts))
    return "\n".join(out)


def item(row, source: str | None = None, title: str = "Discovery Item") -> str:
    """One item with its document's title and meeting_date and nested evidence."""
    out = [title, f"id: {row['item_id']}", f"type: {row['item_type']}", f"label: {row['label']}", f"document_id: {row['document_id']}", f"document_title: {shown(row['title'])}", f"meeting_date: {shown(row['meeting_date'])}"]
    out += [f"source: {shown(source)}", f"confidence: {confidence(row['confidence'])}", f"summary: {shown(row['summary'])}", "value:", *fields(row["value_json"]), "evidence:"]
    for e in row["evidence"]:
        out += [f"  - {row['document_id']} {pages(e['page_start'], e['page_end'])}", f'    quote: "{e["quote"]}"']
    return "\n".join(out + ([] if row["evidence"] else ["  none"]))


def brief(made, document, evidence: Sequence, record) -> str:
    """A brief (from `briefs.briefs`), its document, its notable items with quotes, and the stored record."""
    out = ["Document Brief", f"document_id: {made['document_id']}", f"title: {shown(document['title'])}", f"meeting_date: {shown(document['meeting_date'])}", f"body: {shown(document['body'])}", f"pages: {made['page_count']}"]
    out += ["", "Summary:", made["summary"], "", "Significance:", made["significance"], "", "Notable Evidence:"]
    out += [f"- {e['item_type']}: {e['label']} — {pages(e['page_start'], e['page_end'], 'p. ', 'pp. ')} — {e['quote']}" for e in evidence]
    out += ["", "Open Questions:", *([f"- {q}" for q in made["open_questions"] or []] or ["- none"])]
    return "\n".join([*out, "", "Brief Record:", f"id: {record['brief_id']}", f"extractor: {record['extractor']}", f"status: {record['status']}"])


def facts(document_id: str, extracted: int, skipped: int, created: Sequence) -> str:
    out = ["Discovery", f"document_id: {document_id}", f"extracted: {extracted}", f"created: {len(created)}", f"skipped_existing: {skipped}"]
    if not created:
        return "\n".join([*out, "items: none"])
    return "\n".join([*out, "items:", *(f"- {r['item_type']}: {r['label']} confidence={confidence(r['confidence'])} p.{r['page_number']}" for r in created)])


def enrichment(document_id: str, brief_id: str, summary: str, items: Sequence) -> str:
    out = ["Enrichment", f"document_id: {document_id}", f"brief_id: {brief_id}", f"items_created: {len(items)}", "summary:", summary, "items:"]
    return "\n".join([*out, *(f"- {r['item_type']}: {r['label']}" + (f" p.{r['page_start']}" if r["page_start"] is not None else "") for r in items)])


def checks(title: str, rows: Sequence, **head: object) -> str:
    """Checks (name, level, detail) and their worst level."""
    rank = ("info", "ok", "warn", "error")
    worst = max((r["level"] for r in rows), key=rank.index, default="ok")
    return "\n".join([title, *(f"{k}: {v}" for k, v in head.items()), *(f"{r['name']}: {r['level']} - {r['detail']}" for r in rows), f"summary: {'ok' if worst == 'info' else worst}"])

