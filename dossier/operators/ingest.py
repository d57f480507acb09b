"""Content-addressed ingestion: files to documents, pages, chunks, passages and vectors, once a content."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as t
from dossier.operators import chunks, records
from dossier.operators.jobs import Queue
from dossier.sources import embed, files

JOB = "ingest_pdf"
_MASK = 2**64 - 1
DOCUMENTS = "document_id string, title string, source_path string, source_hash string, metadata_json string, created_at string"


def new_files(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Files whose content no document has, one for each content: the first by path."""
    return records.unseen(records.first_of_content(found, "source_hash", ["path"]), documents, ["source_hash"])


def file_stem(path: Column) -> Column:
    """The last part of a path or address, unquoted, without its ending."""
    name = F.regexp_extract(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def document_rows(found: DataFrame, metadata_json: str = "{}", created_at: str | None = None) -> DataFrame:
    """Documents with ids made from their content; the title is the metadata's, else the file's stem."""
    meta = F.lit(metadata_json)
    now = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return found.select(F.concat(F.lit("document-"), F.substring("source_hash", 1, 16)).alias("document_id"), F.coalesce(t.optional(t.json_text(meta, "title")), file_stem(F.col("path"))).alias("title"), F.col("path").alias("source_path"), "source_hash", meta.alias("metadata_json"), now.alias("created_at"))


def payload(path: Column, metadata: Column, source: str, extractor: str | None = None) -> Column:
    """An ingest job's payload, JSON with its keys in order."""
    mode = [] if extractor is None else [F.lit(files.extractor_mode(extractor)).alias("pdf_extractor")]
    return F.to_json(F.struct(metadata.alias("metadata"), path.alias("path"), *mode, F.lit(source).alias("source")))


def enqueue_files(queue: Queue, found: DataFrame, metadata: dict[str, str] | None = None, extractor: str | None = None) -> int:
    """One ingest job for each PDF of a listing (path); how many are new. A file that has its job gets no second one."""
    meta = F.from_json(F.lit(json.dumps(metadata or {})), "map<string,string>")
    return queue.enqueue_frame(JOB, found.select(F.col("path").alias("job_key"), payload(F.col("path"), meta, "files", extractor).alias("payload_json")))


def enqueue_urls(queue: Queue, landed: DataFrame, metadata: dict[str, str] | None = None, extractor: str | None = None) -> int:
    """One ingest job for each url that `web.land` wrote, with the url and the time in its metadata; how many are new."""
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), F.lit(v))]
    meta = F.create_map(*pairs, F.lit("source_url"), F.col("url"), F.lit("retrieved_at"), F.col("retrieved_at"))
    return queue.enqueue_frame(JOB, landed.where("error is null").select(F.col("url").alias("job_key"), payload(F.col("path"), meta, "urls", extractor).alias("payload_json")))


def handler(store: records.Store, extract: list[tuple[str, files.Extractor]], provider: embed.Provider, **options) -> Callable[[str], None]:
    """What a queue's worker does with an ingest job: the file of its payload becomes a document."""

    def run(payload_json: str) -> None:
        job = json.loads(payload_json)
        found = files.read_pdfs(store.spark, job["path"])
        ingest(store, found, extract, provider, metadata_json=json.dumps(job.get("metadata") or {}, sort_keys=True), **options)

    return run


def ingest(store: records.Store, found: DataFrame, extract: list[tuple[str, files.Extractor]], provider: embed.Provider, model: str = "hashing", metadata_json: str = "{}", ocr: Callable[[bytes], bytes] | None = None, created_at: str | None = None, blobs: str | None = None) -> DataFrame:
    """Add the files' documents to the store as one bundle; the new document rows.

    The bundle's id comes from the contents, so that a retry writes over what a failed run
    left. A repeated run finds nothing new. No list of files reaches the driver. With `blobs`,
    a folder that the workers share, the sources are kept there.
    """
    fresh = new_files(found, store.read("documents", DOCUMENTS))
    key = fresh.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("source_hash")).alias("a"), F.bit_xor(F.xxhash64("source_hash", F.lit(1))).alias("b")).first()
    docs = document_rows(fresh, metadata_json, created_at)
    if not key["n"]:
        return store.spark.createDataFrame([], docs.schema)
    bundle = f"ingest-{key['n']}-{key['a'] & _MASK:016x}{key['b'] & _MASK:016x}"
    staged = f"{store.path}/_staged/{bundle}"
    docs.write.mode("overwrite").parquet(f"{staged}/documents")
    docs = store.spark.read.parquet(f"{staged}/documents")
    ready = files.normalize(files.keep_sources(fresh, blobs) if blobs else fresh, ocr)
    pages = files.extract_best(ready, extract)
    did = F.concat(F.lit("document-"), F.substring("source_hash", 1, 16)).alias("document_id")
    page_rows = pages.select(did, "page_number", "text", "extractor")
    page_rows = page_rows.withColumn("page_id", F.concat_ws("-", F.lit("page"), "document_id", F.col("page_number").cast("string")))
    # Extraction is the dear step, so later tables read the pages back.
    page_rows.write.mode("overwrite").parquet(f"{staged}/pages")
    pages = store.spark.read.parquet(f"{staged}/pages")
    chunk_rows = chunks.chunk_pages(pages)
    passage_rows = chunks.split_passages(chunk_rows)
    chunk_vectors = embed.embed(chunk_rows, provider)
    passage_vectors = embed.embed(passage_rows, provider)
    name, version = embed.identity(model)
    provenance = records.embedding_records(chunk_vectors, "local", name, version, "chunk", "chunk_id").unionByName(records.embedding_records(passage_vectors, "local", name, version))
    store.append_bundle(bundle, {"documents": docs, "pages": pages, "chunks": chunk_rows, "passages": passage_rows, "chunk_vectors": chunk_vectors, "passage_vectors": passage_vectors, "embedding_records": provenance})
    return store.read_bundle("documents", bundle)
