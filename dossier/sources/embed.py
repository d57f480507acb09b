"""Embedding providers: a batch of texts to vectors, as a column."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH, TIMEOUT = 32, 30
MODEL = "nomic-embed-text"
ENDPOINT = "http://127.0.0.1:11434"

#: texts -> one vector a text
Provider = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class EmbeddingError(ValueError):
    """A provider's answer isn't vectors of numbers."""


def identity(model: str) -> tuple[str, str]:
    """Model and version from `model:version`; the version defaults to latest."""
    name, _, version = model.partition(":")
    return name, version or "latest"


def checked(vectors, count: int) -> list[list[float]]:
    if not isinstance(vectors, Sequence) or isinstance(vectors, (str, bytes)) or len(vectors) != count:
        raise EmbeddingError(f"expected {count} vectors")
    out = []
    for v in vectors:
        if not isinstance(v, Sequence) or isinstance(v, (str, bytes)) or not len(v):
            raise EmbeddingError("a vector is empty or no list")
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in v):
            raise EmbeddingError("a vector holds something that isn't a number")
        out.append([float(x) for x in v])
    return out


def http_provider(base_url: str = ENDPOINT, model: str = MODEL) -> Provider:
    """POSTs {model, input} to `/api/embed` and reads `embeddings`."""

    def run(texts: Sequence[str]):
        body = json.dumps({"model": model, "input": list(texts)}).encode()
        request = Request(f"{base_url.rstrip('/')}/api/embed", body, {"Content-Type": "application/json"})
        with urlopen(request, timeout=TIMEOUT) as r:  # noqa: S310
            answer = json.loads(r.read())
        if not isinstance(answer, dict) or "embeddings" not in answer:
            raise EmbeddingError("the answer has no embeddings")
        return answer["embeddings"]

    return run


def hashing_provider(dims: int = 64) -> Provider:
    """Unit vectors from signed hashes of words: deterministic, and near for texts that share words."""

    def run(texts: Sequence[str]):
        out = []
        for text in texts:
            v = [0.0] * dims
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return run


def embed(rows: DataFrame, provider: Provider, text: str = "text", batch: int = BATCH) -> DataFrame:
    """All columns and `vector`, array<float>. Null texts get null vectors and aren't sent."""
    names = rows.columns

    def run(batches):
        for b in batches:
            texts = b.column(names.index(text)).to_pylist()
            at = [k for k, x in enumerate(texts) if x is not None]
            vectors: list = [None] * len(texts)
            for i in range(0, len(at), batch):
                part = at[i : i + batch]
                for k, v in zip(part, checked(provider([texts[k] for k in part]), len(part))):
                    vectors[k] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, "vector"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
