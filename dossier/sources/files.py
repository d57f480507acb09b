"""PDF files as a table: listing, content, hash; pluggable OCR and text extraction."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import text as t

MODES = ("auto", "pymupdf", "pdfplumber", "table")
MAGIC = "%PDF-"

#: bytes of one file -> (page number, text) of its pages
Extractor = Callable[[bytes], Iterable[tuple[int, str]]]


class SourceError(ValueError):
    """An input is missing or isn't a PDF."""


def pdf_paths(path: str) -> list[str]:
    """A .pdf file, or all of a folder, sorted. For local paths; a cluster's folders go to `read_pdfs` as they are."""
    p = Path(path)
    if not p.exists():
        raise SourceError(f"{path} doesn't exist")
    if p.is_file():
        if p.suffix.lower() != ".pdf":
            raise SourceError(f"{path} isn't a PDF")
        return [str(p)]
    found = sorted(str(x) for x in p.rglob("*") if x.is_file() and x.suffix.lower() == ".pdf")
    if not found:
        raise SourceError(f"{path} holds no PDF")
    return found


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified, content, source_hash of the PDFs below a path of any file system."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("source_hash"))


def looks_like_pdf(content):
    return F.substring(content, 1, len(MAGIC)) == F.lit(MAGIC).cast("binary")


def plain_extractor(content: bytes) -> list[tuple[int, str]]:
    """Pages of a text file, divided by form feeds. It stands in where no PDF library is installed."""
    body = content.removeprefix(MAGIC.encode())
    return [(k, page) for k, page in enumerate(body.decode("utf-8", "replace").split("\f"), 1)]


def library_extractor(name: str) -> Extractor:
    """An extractor that imports its PDF library in the worker."""
    if name == "pymupdf":

        def run(content: bytes):
            import pymupdf

            with pymupdf.open(stream=content, filetype="pdf") as doc:
                return [(k, page.get_text("text")) for k, page in enumerate(doc, 1)]

    else:

        def run(content: bytes):
            import io

            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as doc:
                return [(k, page.extract_text() or "") for k, page in enumerate(doc.pages, 1)]

    return run


def extractor_mode(mode: str) -> str:
    name = (mode or "").strip().lower()
    if name not in MODES:
        raise SourceError(f"extractor must be one of {', '.join(MODES)}")
    return name


def extractors(mode: str) -> list[tuple[str, Extractor]]:
    """(name, extractor), the first preferred, for a mode."""
    first = {"auto": ["pymupdf", "pdfplumber"], "pymupdf": ["pymupdf"]}.get(extractor_mode(mode), ["pdfplumber"])
    return [(n, library_extractor(n)) for n in first]


def extract_pages(files: DataFrame, name: str, extractor: Extractor) -> DataFrame:
    """source_hash, page_number, text, extractor. A file that fails ends the job with its path."""

    def run(batches):
        for b in batches:
            rows = []
            for path, digest, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    rows += [(digest, k, text, name) for k, text in extractor(content)]
                except Exception as e:
                    raise SourceError(f"extracting {path}: {e}") from e
            columns = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["source_hash", "page_number", "text", "extractor"])

    return files.select("path", "source_hash", "content").mapInArrow(run, "source_hash string, page_number long, text string, extractor string")


def extract_best(files: DataFrame, choices: list[tuple[str, Extractor]]) -> DataFrame:
    """As `extract_pages`, by the first extractor that finds text in a file, and the last one's pages if none does.

    The decision is made file by file, so another extractor runs only where it is needed and no
    page is shuffled.
    """

    def run(batches):
        for b in batches:
            rows = []
            for path, digest, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                for name, extractor in choices:
                    try:
                        pages = [(digest, k, text, name) for k, text in extractor(content)]
                    except Exception as e:
                        raise SourceError(f"extracting {path}: {e}") from e
                    if any((text or "").strip() for _, _, text, _ in pages):
                        break
                rows += pages
            columns = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["source_hash", "page_number", "text", "extractor"])

    return files.select("path", "source_hash", "content").mapInArrow(run, "source_hash string, page_number long, text string, extractor string")


def keep_sources(files: DataFrame, folder: str) -> DataFrame:
    """Files with `stored_path`: a copy of the content as `<hash>-<name>` in a folder that the workers share; a copy that is there is left alone."""
    names = files.columns

    def run(batches):
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        for b in batches:
            stored = []
            for path, digest, content in zip(*(b.column(names.index(c)).to_pylist() for c in ("path", "source_hash", "content"))):
                place = f"{root.rstrip('/')}/{digest}-{path.rsplit('/', 1)[-1]}"
                put(target, place, content)
                stored.append(place)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(stored, pa.string())], names=[*names, "stored_path"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("stored_path", T.StringType())]))


def put(target: fs.FileSystem, place: str, content: bytes) -> None:
    """Write a file unless it is there; under another name first, so that no half of it is ever seen."""
    if target.get_file_info(place).type == fs.FileType.NotFound:
        part = f"{place}.{uuid.uuid4().hex}.part"
        with target.open_output_stream(part) as out:
            out.write(content)
        target.move(part, place)


def with_fallback(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """The primary pages of documents that have any text in them, else the alternate ones: a decision for whole documents."""
    good = primary.groupBy("source_hash").agg(F.bool_or(t.strip(F.coalesce("text", F.lit(""))) != "").alias("_has")).where("_has").select("source_hash")
    return primary.join(good, "source_hash", "left_semi").unionByName(alternate.join(good, "source_hash", "left_anti"))


def normalize(files: DataFrame, ocr: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """Files with their content passed through an OCR step, if one is given; the hash stays the source's."""
    if ocr is None:
        return files

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("content")
            new = pa.array([None if c is None else ocr(c) for c in b.column(at).to_pylist()], pa.binary())
            yield b.set_column(at, "content", new)

    return files.mapInArrow(run, files.schema)


def ocrmypdf(content: bytes, seconds: float = 600) -> bytes:
    """Runs the ocrmypdf command on one file's bytes, skipping pages that have text; it fails after so many seconds."""
    import subprocess
    import tempfile

    with tempfile.TemporaryDirectory() as d:  # input and output of one subprocess; nothing outlives it
        a, b = Path(d, "in.pdf"), Path(d, "out.pdf")
        a.write_bytes(content)
        try:
            done = subprocess.run(["ocrmypdf", "--quiet", "--skip-text", str(a), str(b)], capture_output=True, text=True, timeout=seconds)
        except subprocess.TimeoutExpired as e:
            raise SourceError(f"OCR took more than {seconds} s") from e
        if done.returncode:
            raise SourceError(f"OCR failed: {done.stderr.strip()}")
        return b.read_bytes()
