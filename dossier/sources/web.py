"""Direct PDF downloads and manifests of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import date, datetime, timezone
from urllib.request import Request, urlopen

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from dossier.sources.files import MAGIC, SourceError, put

TIMEOUT = 30
FIELDS = "url title meeting_date body document_type jurisdiction".split()
LANDED = ["url", "path", "source_hash", "bytes", "retrieved_at", "error"]
MANIFEST = ", ".join(f"{f} string" for f in FIELDS)


class ManifestError(ValueError):
    """A manifest isn't valid; none of it is used."""


def fetch(url: str) -> tuple[bytes, str]:
    """Content and content type; redirects are followed."""
    if not url.startswith(("http://", "https://")):
        raise SourceError(f"{url} isn't an http address")
    with urlopen(Request(url, headers={"Accept": "application/pdf"}), timeout=TIMEOUT) as r:  # noqa: S310
        return r.read(), r.headers.get("Content-Type", "")


def download(urls: DataFrame, get: Callable[[str], tuple[bytes, str]] = fetch) -> DataFrame:
    """url, name (by content hash), source_hash, content of each url; one that isn't a PDF ends the job."""

    def run(batches):
        for b in batches:
            rows = []
            for url in b.column(0).to_pylist():
                content, kind = get(url)
                if "application/pdf" not in kind.lower() and not content.startswith(MAGIC.encode()):
                    raise SourceError(f"{url} isn't a PDF")
                digest = hashlib.sha256(content).hexdigest()
                rows.append((url, f"{digest}.pdf", digest, content))
            columns = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.string(), pa.string(), pa.string(), pa.binary()))], names=["url", "name", "source_hash", "content"])

    return urls.select("url").mapInArrow(run, "url string, name string, source_hash string, content binary")


def land(urls: DataFrame, folder: str, get: Callable[[str], tuple[bytes, str]] = fetch) -> DataFrame:
    """url, path, source_hash, bytes, retrieved_at, error: each PDF written to `<hash>.pdf` in a shared folder, unless it is there.

    One download is held at a time, and a url that fails gets its error instead of ending the job.
    """

    def run(batches):
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        for b in batches:
            for url in b.column(0).to_pylist():
                row = [url, None, None, None, datetime.now(timezone.utc).isoformat(timespec="seconds"), None]
                try:
                    content, kind = get(url)
                    if "application/pdf" not in kind.lower() and not content.startswith(MAGIC.encode()):
                        raise SourceError(f"{url} isn't a PDF")
                    digest = hashlib.sha256(content).hexdigest()
                    row[1:4] = f"{root.rstrip('/')}/{digest}.pdf", digest, len(content)
                    put(target, row[1], content)
                except Exception as e:  # noqa: BLE001 - the error is the row's result
                    row[1:4], row[5] = [None] * 3, str(e)
                types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], x) for v, x in zip(row, types)], names=LANDED)

    return urls.select("url").mapInArrow(run, "url string, path string, source_hash string, bytes long, retrieved_at string, error string")


def parse_manifest(text: str) -> list[dict[str, str | None]]:
    """Rows of a YAML manifest; strict, and all or nothing."""
    import yaml

    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ManifestError(f"not YAML: {e}") from e
    if not isinstance(data, dict) or set(data) != {"documents"}:
        raise ManifestError("the only key of a manifest is documents")
    entries = data["documents"]
    if not isinstance(entries, list) or not entries:
        raise ManifestError("documents must be a list with entries")
    rows: list[dict[str, str | None]] = []
    seen: set[str] = set()
    for k, entry in enumerate(entries, 1):
        if not isinstance(entry, dict):
            raise ManifestError(f"entry {k} isn't a mapping")
        if unknown := sorted(set(map(str, entry)) - set(FIELDS)):
            raise ManifestError(f"entry {k} has unknown fields: {', '.join(unknown)}")
        row: dict[str, str | None] = {}
        for f in FIELDS:
            v = entry.get(f)
            if f == "meeting_date" and isinstance(v, date):
                v = v.isoformat()[:10]
            if v is not None and not isinstance(v, str):
                raise ManifestError(f"entry {k}: {f} must be text")
            v = v.strip() or None if v is not None else None
            if f == "meeting_date" and v is not None:
                try:
                    date.fromisoformat(v)
                except ValueError as e:
                    raise ManifestError(f"entry {k}: meeting_date must be YYYY-MM-DD") from e
            row[f] = v
        if row["url"] is None:
            raise ManifestError(f"entry {k} has no url")
        if row["url"] in seen:
            raise ManifestError(f"{row['url']} comes twice")
        seen.add(row["url"])
        rows.append(row)
    return rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        rows = parse_manifest(f.read())
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], MANIFEST)
