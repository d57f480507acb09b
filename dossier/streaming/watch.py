"""The watched folder as a stream: debounce by path, each stable (path, signature) once, then a job.

Spark's file source doesn't report a file that was rewritten, so changes come from a log of
listings: `list_changes` appends (path, signature, observed_at), with a null signature for a
file that went away, and the stateful query reads that log. State is one small row a path:
the version that waits, and the one that was told last, which isn't told again. A busy path
costs what an idle one does.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossier.operators.jobs import Queue

CHANGE = "path string, signature string, observed_at timestamp"
STABLE = "path string, signature string, ready_at timestamp"
STABILITY = 1.0


def signature(path: str) -> str | None:
    """size:mtime in nanoseconds, or None if the file is gone."""
    try:
        s = os.stat(path)
    except FileNotFoundError:
        return None
    return f"{s.st_size}:{s.st_mtime_ns}"


def list_changes(spark: SparkSession, folders: list[str], log: str, observed_at) -> int:
    """Append the state of all PDFs in local folders to the log, and those of the log that are gone; how many there are."""
    rows = []
    for folder in folders:
        for root, _, names in os.walk(folder):
            rows += [(p, s, observed_at) for n in sorted(names) if n.lower().endswith(".pdf") and (s := signature(p := os.path.join(root, n)))]
    now = spark.createDataFrame(rows, CHANGE)
    try:
        known = spark.read.schema(CHANGE).parquet(log).groupBy("path").agg(F.max_by("signature", "observed_at").alias("signature")).where("signature is not null")
        now = now.unionByName(known.join(now, "path", "left_anti").select("path", F.lit(None).cast("string").alias("signature"), F.lit(observed_at).cast("timestamp").alias("observed_at")))
    except AnalysisException:  # no log yet
        pass
    now.coalesce(1).write.mode("append").parquet(log)
    return len(rows)


def stable_batch(changes: DataFrame, seconds: float = STABILITY) -> DataFrame:
    """The batch form: path, signature, ready_at of each version that stayed unchanged for `seconds`, but for the one told last of its path.

    A repeat of the same signature doesn't reset the timer; a null one, of a file that went
    away, ends it. The last version of a path counts as unchanged from then on.
    """
    order = Window.partitionBy("path").orderBy("observed_at", "signature")
    marked = changes.withColumn("_new", ~F.col("signature").eqNullSafe(F.lag("signature").over(order)) | F.lag("path").over(order).isNull())
    starts = marked.where("_new")
    ready = F.col("observed_at") + F.make_dt_interval(secs=F.lit(float(seconds)))
    held = starts.withColumn("_until", F.lead("observed_at").over(order)).withColumn("ready_at", ready).where("signature is not null and (_until is null or _until >= ready_at)")
    told = F.lag("signature").over(order)
    return held.withColumn("_told", told).where("_told is null or _told <> signature").select("path", "signature", "ready_at")


def stable_stream(changes: DataFrame, seconds: float = STABILITY, watermark: str = "0 seconds") -> DataFrame:
    """The streaming form over a stream of CHANGE rows, with event-time timers; append mode."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, since, told = state.get if state.exists else (None, 0, None)
        out: list[tuple[str, str, pd.Timestamp]] = []
        wait = int(seconds * 1000)

        def settle(now: int) -> None:
            nonlocal pending, told
            if pending is not None and now >= since + wait:
                if pending != told:
                    told = pending
                    out.append((key[0], pending, pd.Timestamp(since + wait, unit="ms")))
                pending = None

        if state.hasTimedOut:
            settle(since + wait)
        else:
            rows = pd.concat(list(batches)).sort_values(["observed_at", "signature"])
            current = pending or told
            for sig, at in zip(rows["signature"], rows["observed_at"]):
                now = int(pd.Timestamp(at).value // 1_000_000)
                settle(now)
                if sig is None:
                    pending = current = None
                elif sig != current:
                    pending, since, current = sig, now, sig
        state.update((pending, since, told))
        if pending is not None:
            state.setTimeoutTimestamp(max(since + wait, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["path", "signature", "ready_at"])

    rows = changes.withWatermark("observed_at", watermark)
    return rows.groupBy("path").applyInPandasWithState(step, STABLE, "pending string, since long, told string", "append", GroupStateTimeout.EventTimeTimeout)


def matching_watch(paths: DataFrame, watches: DataFrame) -> DataFrame:
    """path and the first watch (created_at, watch_id) whose folder holds it.

    Each path's own prefixes are looked up, without a theta join, among folders that were
    reduced to their first watch before: many watches of one folder don't multiply its paths.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    first = F.min_by(F.struct("watch_id", "folder", "created_at"), F.struct("created_at", "watch_id"))
    folders = watches.groupBy(F.rtrim(F.col("folder"), F.lit("/")).alias("_prefix")).agg(first.alias("_w"))
    probe = paths.select("path", F.explode(F.array_distinct(prefixes)).alias("_prefix"))
    found = probe.join(folders, "_prefix")
    return found.groupBy("path").agg(F.min_by(F.struct("_w.watch_id", "_w.folder"), F.struct("_w.created_at", "_w.watch_id")).alias("_w")).select("path", "_w.*")


def job_rows(stable: DataFrame, watches: DataFrame | None = None) -> DataFrame:
    """job_key and payload_json of stable versions, one a (path, signature, ready_at), with the metadata of the watch that holds the path."""
    rows = stable
    if watches is not None:
        rows = rows.join(matching_watch(stable.select("path").distinct(), watches.select("watch_id", F.col("path").alias("folder"), "created_at")), "path", "left").join(watches.select("watch_id", "metadata_json"), "watch_id", "left")
    else:
        rows = rows.withColumns({"watch_id": F.lit(None).cast("string"), "metadata_json": F.lit(None).cast("string")})
    meta = F.from_json(F.coalesce("metadata_json", F.lit("{}")), "map<string,string>")
    payload = F.to_json(F.struct(meta.alias("metadata"), "path", "signature", F.lit("watch").alias("source"), "watch_id"))
    return rows.select(F.concat_ws("|", "path", "signature", F.col("ready_at").cast("string")).alias("job_key"), payload.alias("payload_json"))


def enqueue_stable(stable: DataFrame, queue: Queue, checkpoint: str, kind: str = "ingest_pdf", watches: DataFrame | None = None, every: str | None = None):
    """Start a query that makes one job a stable version, also when a batch is replayed; for ever at an interval, or once over what is there."""

    def each(batch: DataFrame, _: int) -> None:
        queue.enqueue_frame(kind, job_rows(batch, watches))

    writer = stable.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch_loop(spark: SparkSession, folders: list[str], log: str, checkpoint: str, queue: Queue, seconds: float = STABILITY, pause: float = 1.0, max_loops: int | None = None, clock: Callable[[], datetime] | None = None) -> int:
    """List, settle and enqueue again and again; the number of loops."""
    clock = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
    loops = 0
    while max_loops is None or loops < max_loops:
        list_changes(spark, folders, log, clock())
        changes = spark.readStream.schema(CHANGE).parquet(log)
        enqueue_stable(stable_stream(changes, seconds), queue, checkpoint).awaitTermination()
        loops += 1
        if max_loops is None or loops < max_loops:
            time.sleep(pause)
    return loops
