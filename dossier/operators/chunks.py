"""Pages to overlapping chunks, chunks to passages; all within a row, without a shuffle."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import text as t

MAX_CHARS, OVERLAP = 2000, 200
KEEP_CHARS, HEADING_CHARS = 40, 20
BULLET = "•"


def chunk_pages(pages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, document_id, page_start, page_end, chunk_no, text: windows of `max_chars` that share `overlap` characters.

    Blank pages give nothing; ids are made from document, page and place, so that a repeated run makes the same.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and less than max_chars")
    n = F.length("_body")
    starts = F.when(n <= max_chars, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), n - overlap, F.lit(max_chars - overlap)))
    body = pages.select("document_id", "page_number", t.strip(F.col("text")).alias("_body")).where("_body <> ''")
    cut = body.select("document_id", "page_number", "_body", F.posexplode(starts).alias("_k", "_at"))
    out = cut.select(
        F.concat_ws("-", F.lit("chunk"), F.col("document_id").cast("string"), F.col("page_number").cast("string"), (F.col("_k") + 1).cast("string")).alias("chunk_id"),
        "document_id",
        F.col("page_number").cast("long").alias("page_start"),
        F.col("page_number").cast("long").alias("page_end"),
        (F.col("_k") + 1).cast("long").alias("chunk_no"),
        t.strip(F.substring("_body", F.col("_at"), F.lit(max_chars))).alias("text"),
    )
    return out.where("text <> ''")


_PAGE = re.compile(r"page\s+\d+\s+of\s+\d+", re.IGNORECASE)
_DATE = re.compile(r"[a-zA-Z]+\s+\d\d?,\s+\d{4}")


def is_header(line: str) -> bool:
    """Page numbers, whole-line dates and other lines that repeat on pages."""
    report = "City Manager's Report" in line or "City Manager’s Report" in line
    return report or line == "-" or line.endswith(" eventbrite.com") or line.startswith("www.") or (line[-1:].isdigit() and (_PAGE.fullmatch(line) or _DATE.fullmatch(line)) is not None)


def is_heading(line: str) -> bool:
    return (len(line) <= HEADING_CHARS and line.endswith(":")) or "The following is a brief overview" in line


def passages_of(text: str) -> list[str]:
    """The passages of a chunk's text, by one pass over its lines."""
    done: list[str] = []
    rest: list[str] = []
    current: list[str] = []

    def close() -> None:
        if current:
            x = " ".join(current)
            if len(x) >= KEEP_CHARS or x.startswith(BULLET):
                done.append(x)
            current.clear()

    for raw in text.splitlines():
        line = " ".join(raw.split())
        if not line or is_header(line):
            close()
            continue
        rest.append(line)
        if line.startswith(BULLET):
            close()
            current.append(line)
        elif is_heading(line):
            close()
        else:
            current.append(line)
    close()
    return done or ([" ".join(rest)] if rest else [])


@F.arrow_udf(T.ArrayType(T.StringType()))
def passage_texts(text: pa.Array) -> pa.Array:
    """The passages of chunks' texts. In Python, since a fold over lines within an expression took many times as long."""
    parts = (text.slice(at, 500).to_pylist() for at in range(0, max(len(text), 1), 500))
    return pa.concat_arrays([pa.array([passages_of(x or "") for x in part], pa.list_(pa.string())) for part in parts])


def split_passages(chunks: DataFrame) -> DataFrame:
    """passage_id, chunk_id, document_id, page_start, page_end, ordinal (from 1), text."""
    rows = chunks.select("chunk_id", "document_id", "page_start", "page_end", F.posexplode(passage_texts(F.col("text"))).alias("_k", "text"))
    ordinal = (F.col("_k") + 1).cast("long")
    return rows.select(F.format_string("passage-%s-%03d", "chunk_id", ordinal).alias("passage_id"), "chunk_id", "document_id", "page_start", "page_end", ordinal.alias("ordinal"), "text")
