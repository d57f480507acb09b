"""Settings: options over a file over environment over defaults, and a health report."""

from __future__ import annotations

import json
import os
import shutil
import stat
from collections.abc import Callable
from dataclasses import dataclass, replace
from importlib.util import find_spec
from pathlib import Path
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.sources import embed

LEVELS = ("info", "ok", "warn", "error")


@dataclass(frozen=True)
class Config:
    data_dir: str
    embed_provider: str = "ollama"
    embed_model: str = embed.MODEL
    embed_url: str = embed.ENDPOINT
    api_key_env: str | None = None
    socket_path: str | None = None


def load(path: str | None = None, **options: str | None) -> Config:
    """Options win over the file's values, those over XDG_DATA_HOME, that over ~/.local/share."""
    home = os.environ.get("XDG_DATA_HOME") or str(Path.home() / ".local/share")
    config = Config(str(Path(home) / "dossier"))
    values: dict[str, str] = {}
    if path is not None:
        import yaml

        data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        if not isinstance(data, dict):
            raise ValueError("a configuration is a mapping")
        unknown = set(data) - set(Config.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(map(str, unknown)))}")
        values.update(data)
    values.update({k: v for k, v in options.items() if v is not None})
    return replace(config, **values)


def worst(checks: DataFrame) -> DataFrame:
    """The worst level of checks (name, level, detail), and how many there are of each."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return checks.agg(F.coalesce(F.nullif(F.max_by("level", rank), F.lit("info")), F.lit("ok")).alias("level"), *(F.count_if(F.col("level") == x).alias(x) for x in LEVELS))


def command_check(name: str, command: str, which: Callable[[str], str | None] = shutil.which) -> tuple[str, str, str]:
    at = which(command)
    return (name, "ok", f"found {at}") if at else (name, "warn", f"missing command '{command}'")


def fetch_json(url: str, headers: dict[str, str]) -> object:
    with urlopen(Request(url, headers=headers), timeout=2) as r:  # noqa: S310
        return json.loads(r.read())


def embedding_check(config: Config, get: Callable[[str, dict[str, str]], object] = fetch_json) -> tuple[str, str, str]:
    """Whether the embedding service answers and has the model."""
    kind = (config.embed_provider or "").lower()
    where = f"provider={kind} base_url={config.embed_url} model={config.embed_model}"
    if not kind:
        return "embedding", "warn", "no embedding provider configured"
    if kind not in ("ollama", "openai", "openai_compatible"):
        return "embedding", "error", f"unsupported provider '{config.embed_provider}'"
    if not config.embed_model:
        return "embedding", "warn", f"provider={kind} is configured but its model is missing"
    headers = {}
    if kind != "ollama":
        name = config.api_key_env or ("OPENAI_API_KEY" if kind == "openai" else None)
        if name and not os.environ.get(name):
            return "embedding", "warn", f"provider={kind} expects environment variable {name}"
        headers = {"Authorization": f"Bearer {os.environ[name]}"} if name else {}
    try:
        answer = get(config.embed_url.rstrip("/") + ("/api/tags" if kind == "ollama" else "/models"), headers)
        rows = answer["models" if kind == "ollama" else "data"]
        names = {str(r.get("name") or r.get("model") or r.get("id")) for r in rows}
    except Exception as e:  # noqa: BLE001 - the report says what went wrong
        return "embedding", "warn", f"{where} doesn't answer: {e}"
    there = config.embed_model in names or f"{config.embed_model}:latest" in names
    return ("embedding", "ok", f"{where} is available") if there or (not names and kind != "ollama") else ("embedding", "warn", f"{where} isn't installed there")


def socket_check(path: str | None) -> tuple[str, str, str]:
    if path is None:
        return "daemon", "info", "not configured"
    try:
        mode = os.stat(path).st_mode
    except FileNotFoundError:
        return "daemon", "warn", f"configured socket {path} not found"
    return ("daemon", "ok", f"socket available at {path}") if stat.S_ISSOCK(mode) else ("daemon", "warn", f"configured path {path} exists but is not a socket")


def health(spark: SparkSession, config: Config, path: str | None = None, error: str | None = None, get: Callable[[str, dict[str, str]], object] = fetch_json, which: Callable[[str], str | None] = shutil.which) -> DataFrame:
    """name, level, detail: configuration, folder, commands, embedding service, socket, watched folders, and Python modules."""
    from dossier.operators import records, storage

    rows = [("config", "error", error) if error else ("config", "ok", f"loaded {path}" if path and Path(path).exists() else f"missing {path}; using defaults")]
    rows.append(storage.folder_check(config.data_dir, "ok"))
    rows += [command_check(n, c, which) for n, c in (("ocrmypdf", "ocrmypdf"), ("tesseract", "tesseract"), ("ghostscript", "gs"), ("qpdf", "qpdf"))]
    rows += [embedding_check(config, get), socket_check(config.socket_path)]
    store = records.Store(spark, config.data_dir)
    made = storage.existing_tables(store).where("name = 'watches'").count()
    rows.append(storage.watch_check([r["path"] for r in store.read("watches").select("path").collect()]) if made else ("watcher", "info", "storage is not initialized; no watches to inspect"))
    rows.append(("spark", "ok", spark.version))
    for module, need in (("pyarrow", "error"), ("pandas", "error"), ("yaml", "warn"), ("pymupdf", "warn"), ("pdfplumber", "warn")):
        there = find_spec(module) is not None
        rows.append((module, "ok" if there else need, "installed" if there else "not installed"))
    return spark.createDataFrame(rows, "name string, level string, detail string")
