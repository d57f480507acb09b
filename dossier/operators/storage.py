"""The store's tables: layout, schema version, migration with back-fills, and a status report."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from dossier.operators import chunks, jobs, records
from dossier.sources import embed

VERSION = "1"
FOLDERS = ("source_pdfs", "downloaded_pdfs", "normalized_pdfs", "logs", "artifacts")
TABLES = {
    "metadata": "key string, value string",
    "documents": "document_id string, title string, source_path string, source_url string, source_hash string, normalized_path string, metadata_json string, created_at string",
    "pages": "page_id string, document_id string, page_number long, text string, extractor string",
    "chunks": "chunk_id string, document_id string, page_start long, page_end long, chunk_no long, text string",
    "passages": "passage_id string, chunk_id string, document_id string, page_start long, page_end long, ordinal long, text string",
    "jobs": jobs.LOG,
    "watches": "watch_id string, path string, metadata_json string, created_at string",
    "watch_files": "path string, watch_id string, content_signature string, updated_at string",
    "embedding_records": "source_kind string, source_key string, provider string, model string, version string, dimensions long",
    "document_profiles": "profile_id string, document_id string, summary string, metadata_json string, created_at string, updated_at string",
    "document_briefs": "brief_id string, document_id string, summary string, significance string, open_questions array<string>, extractor string, status string, created_at string",
    "discovery_items": "item_id string, document_id string, item_type string, label string, value_json string, summary string, confidence double, extractor string, provider string, model string, created_at string",
    "discovery_evidence": "evidence_id string, item_id string, document_id string, page_id string, passage_id string, page_start long, page_end long, quote string, validation_status string",
}
CHECK = "name string, level string, detail string"


def existing_tables(store: records.Store) -> DataFrame:
    """name of each table that a committed bundle holds."""
    try:
        return store.spark.read.parquet(f"{store.path}/_commits/*").select("name").distinct()
    except AnalysisException:
        return store.spark.createDataFrame([], "name string")


def missing_tables(required: DataFrame, existing: DataFrame) -> DataFrame:
    """Names that are required and not there."""
    return required.select("name").exceptAll(existing.select("name").distinct()).distinct()


def initialize(store: records.Store) -> list[str]:
    """Make the folders and the tables that aren't there, note the schema version unless one is noted, and fill in passages of chunks without any.

    A second run changes nothing. Returns what was made.
    """
    local = store.path.removeprefix("file://")
    if "://" not in local:
        for name in FOLDERS:
            Path(local, name).mkdir(parents=True, exist_ok=True)
    required = store.spark.createDataFrame([(n,) for n in TABLES], "name string")
    lacking = sorted(r[0] for r in missing_tables(required, existing_tables(store)).collect())
    if lacking:
        store.append_bundle("layout-" + "-".join(lacking)[:80], {n: store.spark.createDataFrame([], TABLES[n]) for n in lacking})
    if store.read("metadata").where("key = 'schema_version'").isEmpty():
        store.append_bundle("schema-version", {"metadata": store.spark.createDataFrame([("schema_version", VERSION)], TABLES["metadata"])})
    return lacking + (["passages of chunks"] if backfill_passages(store) else [])


def chunks_without_passages(chunk_rows: DataFrame, passages: DataFrame) -> DataFrame:
    return chunk_rows.join(passages.select("chunk_id").where("chunk_id is not null").distinct(), "chunk_id", "left_anti")


def backfill_passages(store: records.Store) -> bool:
    """Split the chunks that have no passage, as one bundle; whether there were any."""
    lacking = chunks_without_passages(store.read("chunks", TABLES["chunks"]), store.read("passages", TABLES["passages"]))
    made = chunks.split_passages(lacking)
    key = made.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("passage_id")).alias("h")).first()
    if key["n"]:
        store.append_bundle(f"passages-{key['n']}-{key['h'] & (2**63 - 1):x}", {"passages": made})
    return bool(key["n"])


def backfill_embeddings(store: records.Store, provider: embed.Provider, model: str) -> int:
    """Embed the passages that have no record of this model, and append vectors and records as one bundle; how many."""
    name, version = embed.identity(model)
    have = store.read("embedding_records", TABLES["embedding_records"])
    lacking = records.missing_embeddings(store.read("passages", TABLES["passages"]), have, "local", name, version)
    key = lacking.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("passage_id")).alias("h")).first()
    if key["n"]:
        made = embed.embed(lacking.select("passage_id", "text"), provider)
        store.append_bundle(f"vectors-{name}-{version}-{key['n']}-{key['h'] & (2**63 - 1):x}", {"passage_vectors": made, "embedding_records": records.embedding_records(made, "local", name, version)})
    return key["n"]


def register_watch(store: records.Store, path: str, metadata_json: str = "{}", created_at: str | None = None) -> DataFrame:
    """Add a watched folder, once: ValueError if the path is registered. Returns its row."""
    folder = str(Path(path).expanduser().resolve())
    new = store.spark.createDataFrame([(folder, metadata_json)], "path string, metadata_json string")
    now = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    known = store.read("watches", TABLES["watches"])
    rows = records.unseen(new, known, ["path"]).select(F.concat(F.lit("watch-"), F.substring(F.sha2("path", 256), 1, 8)).alias("watch_id"), "path", "metadata_json", now.alias("created_at"))
    row = rows.first()
    if row is None:
        raise ValueError(f"{folder} is watched already")
    store.append_bundle(row["watch_id"], {"watches": store.spark.createDataFrame([row], TABLES["watches"])})
    return records.lookup(store.read("watches"), "path", folder)


def remember_signatures(store: records.Store, stable: DataFrame, bundle: str) -> None:
    """Note the signature of stable files (path, watch_id, signature): the last one of a path counts."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    store.append_bundle(bundle, {"watch_files": stable.select("path", "watch_id", F.col("signature").alias("content_signature"), now.alias("updated_at"))})


def signatures(store: records.Store) -> DataFrame:
    """path, watch_id, content_signature, updated_at of each file, the last noted."""
    return records.latest(store.read("watch_files", TABLES["watch_files"]), "path", ["updated_at", "content_signature"])


def append_items(store: records.Store, items: DataFrame, evidence: DataFrame, bundle: str, brief: DataFrame | None = None) -> None:
    """Validate items with their evidence, then append both, and a brief, as one bundle: all of it or nothing."""
    nested = evidence.groupBy("item_id").agg(F.collect_list(F.struct("document_id", "page_start", "page_end", "quote", "validation_status")).alias("evidence"))
    whole = items.join(nested, "item_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(nested.schema["evidence"].dataType)))
    bad = records.problems(whole).where("problem is not null").select("item_id", "problem").first()
    if bad is not None:
        raise ValueError(f"{bad['item_id']}: {bad['problem']}")
    store.append_bundle(bundle, {"discovery_items": items, "discovery_evidence": evidence} | ({"document_briefs": brief} if brief is not None else {}))


def append_briefs(store: records.Store, briefs: DataFrame, bundle: str, created_at: str | None = None) -> DataFrame:
    """Append finished briefs with ids made from their document and text; the rows."""
    rows = brief_rows(briefs, created_at)
    store.append_bundle(bundle, {"document_briefs": rows})
    return rows


def brief_rows(briefs: DataFrame, created_at: str | None = None, extractor: str = "rules") -> DataFrame:
    now = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    brief_id = F.concat(F.lit("brief-"), F.substring(F.sha2(F.concat_ws("|", "document_id", "summary", "significance"), 256), 1, 16))
    return briefs.where("status = 'draft'").select(brief_id.alias("brief_id"), "document_id", "summary", "significance", "open_questions", F.lit(extractor).alias("extractor"), "status", now.alias("created_at"))


def folder_problem(path: str) -> str | None:
    """What keeps a watched folder from being read."""
    p = Path(path)
    if not p.exists():
        return f"missing watched folder {p}; recreate it or remove/re-add the watch"
    if not p.is_dir():
        return f"watched path {p} is not a directory; remove/re-add the watch"
    return None if os.access(p, os.R_OK | os.X_OK) else f"watched folder {p} is not readable; fix permissions"


def watch_check(folders: list[str], problem: Callable[[str], str | None] = folder_problem) -> tuple[str, str, str]:
    if not folders:
        return "watcher", "ok", "no watched folders configured"
    bad = [x for f in sorted(folders) if (x := problem(f))]
    return ("watcher", "warn", "; ".join(bad)) if bad else ("watcher", "ok", f"{len(folders)} watched folder(s) ready")


def folder_check(path: str, absent: str = "warn") -> tuple[str, str, str]:
    p = Path(path)
    if p.exists() and not p.is_dir():
        return "data_dir", "error", f"{p} exists but is not a directory"
    at = p
    while not at.exists() and at != at.parent:
        at = at.parent
    if not os.access(at, os.W_OK | os.X_OK):
        return "data_dir", "error", f"{at} is not writable"
    return ("data_dir", "ok", f"{p} exists") if p.exists() else ("data_dir", absent, f"{p} does not exist yet; parent {at} is writable")


def status(spark: SparkSession, path: str, queue: jobs.Queue | None = None) -> DataFrame:
    """name, level, detail: the folder, its parts, the tables, the queue and the watched folders; nothing is changed."""
    local = path.removeprefix("file://")
    rows = [folder_check(local)]
    if rows[0][1] != "error":
        rows += [(n, "ok", f"present at {p}") if p.is_dir() else (n, "error", f"{p} exists but is not a directory") if p.exists() else (n, "warn", f"missing directory {p}") for n in FOLDERS for p in [Path(local, n)]]
        store = records.Store(spark, path)
        required = spark.createDataFrame([(n,) for n in TABLES], "name string")
        lacking = sorted(r[0] for r in missing_tables(required, existing_tables(store)).collect())
        rows.append(("tables", "warn", f"missing tables: {', '.join(lacking)}") if lacking else ("tables", "ok", f"schema ready at {path}"))
        if not lacking:
            if queue is not None:
                n = {r["status"]: r["n"] for r in jobs.status_counts(jobs.state(queue.log())).collect()}
                rows.append(("jobs", "warn" if n["failed"] else "ok", " ".join(f"{s}={n[s]}" for s in ("pending", "running", "failed", "done"))))
            rows.append(watch_check([r["path"] for r in store.read("watches").select("path").collect()]))  # registered folders, a handful
    return spark.createDataFrame([Row(*r) for r in rows], CHECK)
