"""The folder that all executors share, and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session without that setting, as in tests, gets one of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="dossier-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    files, at = _hadoop(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def discard(df: DataFrame) -> None:
    """Delete the table of a frame from `written`, once nothing reads it any more."""
    files, at = _hadoop(df.sparkSession, df.scratch)
    files.delete(at, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows after writing them to the shared folder: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


#: A key with more rows than both this and one in HOT_KEYS of all rows is hot.
HOT_ROWS, HOT_KEYS = 1 << 16, 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join to `right`, which has one row a key and in `rows` the key's number of rows in `left`; `total`: all of these, or more.

    Rows of hot keys meet them by broadcast, fewer than HOT_KEYS rows as their numbers add up to
    `total`; all others by a join of keys none of which holds more than a thousandth.
    """
    limit = max(hot_rows, total // HOT_KEYS)
    hot = right.where(F.col(rows) > limit)
    fast = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(rows) <= limit), key)
    return fast.unionByName(rest)


def training_rows(documents: DataFrame, labels: DataFrame, column: str, folds: int, out: int, limit: int, max_bytes: int = 64 << 20):
    """At most `limit` labelled rows (and `max_bytes` of text) that aren't held out, as pandas (doc_id, text, y).

    A row is held out if crc32 of its doc_id as text, modulo `folds`, is `out`. Rows are taken
    in the order of a hash of doc_id, the same at each run, up to both bounds; the driver sees
    ids and sizes first and no text beyond the bounds. Rows whose label, id or text is null are
    left out, as are ids with contradicting labels; of different texts of one id the smallest
    counts. Texts over a tenth of `max_bytes` aren't used for training.
    """
    place = F.xxhash64("doc_id")
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where(F.crc32(F.col("doc_id").cast("string")) % folds != out)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("y_max"))
        .where("y = y_max")
        .drop("y_max")
        .orderBy(place, "doc_id")
        .limit(limit)
    )
    rows = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes // 10))
        .join(F.broadcast(ids), "doc_id")  # at most `limit` rows of two numbers
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
    )
    rows = written(rows, "labelled")  # at most `limit` texts, each of at most a tenth of `max_bytes`
    sizes = rows.select("doc_id", "y", F.octet_length("text").alias("size"), place.alias("place")).toPandas().sort_values(["place", "doc_id"], ignore_index=True)
    taken = sizes[sizes["size"].cumsum() <= max_bytes]
    texts = rows.join(F.broadcast(documents.sparkSession.createDataFrame(taken[["doc_id"]].values.tolist(), "doc_id long")), "doc_id", "left_semi").select("doc_id", "text").toPandas()
    text_of = dict(zip(texts["doc_id"].tolist(), texts["text"].tolist()))
    out = taken[["doc_id", "y"]].copy()
    out.insert(1, "text", [text_of[d] for d in out["doc_id"].tolist()])
    return out
