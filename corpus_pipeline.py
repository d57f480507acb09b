"""The corpus pipeline: quality, near-duplicates, secrets, mixing, tokens, one operator a stage.

Defined cases, for each stage as for its operator: null and empty texts are scored like any
other and, if kept, link as near duplicates of each other, hold no secret, count no token and
encode to no id. Rows without a doc_id pass the near-duplicate stage, and share one fate in
mixing. Of repeated rows the near-duplicate stage keeps one; of different texts with one doc_id
the smallest. Ties don't arise: thresholds include their value, groups keep their smallest
doc_id. Very long texts are handled whole. All columns but those that a stage is about stay,
whatever their names. Empty tables give empty tables; without usable labels all are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dossier.llm import bpe, mixing, quality_net, secrets, simhash
from dossier.llm.shared import written

VOCABULARY = "word_bpe_49k.json"
#: Part of the tokens that the mixing stage keeps.
MIX_BUDGET = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_net.accept(docs, quality_net.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return simhash.distinct_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in them replaced."""
    return secrets.redact(docs, secrets.compile_grammar(secrets.labelled_credentials()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities that bring sources, languages and topics to their target weights."""
    return mixing.sample(docs, budget=MIX_BUDGET)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text that they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("BPE encoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs


#: A trained classifier and inferred grammars aren't SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
