"""Tables of records: validation, incremental appends, upserts, and bundles that become visible at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions import text as t


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def first_of_content(rows: DataFrame, hash_column: str, order: Sequence[str]) -> DataFrame:
    """One row for each content hash, the first by `order`; pre-aggregated in each task, so a hot hash is one row a task."""
    columns = rows.columns
    best = rows.groupBy(hash_column).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def unseen(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key `existing` lacks. Null keys count as unseen."""
    return rows.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def missing_embeddings(passages: DataFrame, records: DataFrame, provider: str, model: str, version: str, kind: str = "passage", id_column: str = "passage_id") -> DataFrame:
    """Passages without a provenance record of this provider, model and version."""
    have = records.where((F.col("source_kind") == kind) & (F.col("provider") == provider) & (F.col("model") == model) & (F.col("version") == version))
    return passages.join(have.select(F.col("source_key").alias(id_column)), id_column, "left_anti")


def embedding_records(vectors: DataFrame, provider: str, model: str, version: str = "latest", kind: str = "passage", id_column: str = "passage_id") -> DataFrame:
    """Provenance of vectors: source_kind, source_key, provider, model, version, dimensions."""
    return vectors.select(F.lit(kind).alias("source_kind"), F.col(id_column).alias("source_key"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(version).alias("version"), F.size("vector").cast("long").alias("dimensions"))


def upsert(current: DataFrame, changes: DataFrame, key: str, keep: Sequence[str] = (), touched: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """`current` with `changes` applied by key: new values win, `keep` columns stay those of the first version.

    Of several changes to a key the last by `order` counts; for `keep` the first. Columns of
    `touched` take the change's value.
    """
    columns = current.columns
    if order:
        last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_new"), F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    else:
        last = changes.groupBy(key).agg(F.max(F.struct(*columns)).alias("_new"), F.min(F.struct(*columns)).alias("_first"))
    old = current.select(key, F.struct(*columns).alias("_old"))
    both = old.join(last, key, "full_outer")
    new = F.col("_new").isNotNull()

    def pick(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c in keep:
            return F.coalesce(F.col(f"_old.{c}"), F.col(f"_first.{c}"))
        return F.when(new, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))

    return both.select(*(pick(c).alias(c) for c in columns))


def latest(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key of an append-only log; an aggregate, so a hot key is one row a task."""
    columns = log.columns
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")).select("_row.*")


def problems(items: DataFrame) -> DataFrame:
    """Items (document_id, item_type, label, extractor, confidence, evidence: array of document_id, page_start, page_end, quote, validation_status) with `problem`, null if valid."""
    empty = lambda c: t.optional(F.col(c)).isNull()
    problem = None
    for c in ("document_id", "item_type", "label", "extractor"):
        problem = F.when(empty(c), f"{c} is empty") if problem is None else problem.when(empty(c), f"{c} is empty")
    problem = problem.when(~F.col("confidence").between(0, 1), "confidence isn't from 0 to 1")
    e = F.col("evidence")
    tests = (
        (lambda x: x["document_id"] != F.col("document_id"), "evidence is of another document"),
        (lambda x: x["page_start"] < 1, "page_start is less than 1"),
        (lambda x: x["page_end"] < x["page_start"], "page_end comes before page_start"),
        (lambda x: t.optional(x["quote"]).isNull(), "a quote is empty"),
        (lambda x: t.optional(x["validation_status"]).isNull(), "validation_status is empty"),
    )
    for test, what in tests:
        problem = problem.when(F.exists(e, test), what)
    return items.withColumn("problem", problem)


def require_valid(items: DataFrame) -> DataFrame:
    checked = problems(items)
    return checked.withColumn("label", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem"))).otherwise(F.col("label"))).drop("problem")


class Store:
    """Tables under one folder. A bundle's parts are written first and its commit last; readers see committed bundles only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append_bundle(self, bundle_id: str, tables: dict[str, DataFrame]) -> None:
        """Write the parts, then the commit. A repeated bundle id overwrites its own parts, so a retry makes no second copy."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/bundle={bundle_id}")
        names = [(bundle_id, n) for n in sorted(tables)]
        self.spark.createDataFrame(names, "bundle string, name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_commits/{bundle_id}")

    def read(self, name: str, schema=None) -> DataFrame:
        """Rows of the committed bundles of a table; an empty frame if there are none and a schema is given."""
        from pyspark.errors import AnalysisException

        try:
            commits = self.spark.read.parquet(f"{self.path}/_commits/*").where(F.col("name") == name).select("bundle")
            rows = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/bundle=*")
        except AnalysisException:
            if schema is None:
                raise
            return self.spark.createDataFrame([], schema)
        return rows.withColumn("bundle", F.col("bundle").cast("string")).join(F.broadcast(commits.distinct()), "bundle", "left_semi").drop("bundle")

    def read_bundle(self, name: str, bundle: str) -> DataFrame:
        """A table's rows of one bundle."""
        return self.spark.read.parquet(f"{self.path}/{name}/bundle={bundle}")


def ordered(table: DataFrame, kind: str) -> DataFrame:
    """A table scan in its documented order."""
    keys = {"documents": ["created_at", "document_id"], "pages": ["document_id", "page_number", "page_id"], "chunks": ["document_id", "page_start", "chunk_id"], "jobs": ["created_at", "job_id"], "watches": ["created_at", "watch_id"], "embedding_records": ["created_at", "record_id"]}[kind]
    return table.orderBy(*keys)


def lookup(table: DataFrame, key: str, value: str, order: Sequence[str] = ()) -> DataFrame:
    """The first row with a key, by `order`; fails when there is none."""
    rows = table.where(F.col(key) == value)
    rows = rows.orderBy(*order).limit(1) if order else rows.limit(1)
    if rows.isEmpty():
        raise KeyError(f"no row with {key} {value!r}")
    return rows


def catalog(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """Tables and their columns."""
    return [(x.name, [c.name for c in spark.catalog.listColumns(x.name)]) for x in spark.catalog.listTables()]


def adjacent(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Rows with the ids before and after within their group."""
    w = Window.partitionBy(group).orderBy(ordinal)
    return rows.withColumn("previous", F.lag(ordinal).over(w)).withColumn("next", F.lead(ordinal).over(w))
