"""The passage queries with Porter stems, as the reference's passage index (`porter unicode61`) has them.

The queries of the same kind in `dossier.plans.queries` compare whole words, since their SQL
has no stemmer. These have no SQL; tests hold them against it with a stemmer added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.operators import hybrid
from dossier.plans import queries as words


def passage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words._neighbours(spark, sf_dir, "rest", stemmed=True)


def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words._hybrid(spark, sf_dir, "rest", 10, 1.9, stemmed=True)


def passage_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are taken first, then the filter applies."""
    return words._hybrid(spark, sf_dir, "rest", 10, 1.9, hybrid.Filters(body=" COUNCIL ", since="2024-01-20"), stemmed=True)


def passage_vector_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No keyword hit: vector candidates stand alone."""
    return words._hybrid(spark, sf_dir, "qqq", 10, 1.9, stemmed=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (passage_neighbours, passage_search, passage_filtered, passage_vector_only)}
ORACLES: dict[str, str] = {}
