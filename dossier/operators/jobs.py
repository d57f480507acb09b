"""The job queue as an append-only status log with a latest-state view; one driver claims jobs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.records import latest

STATUSES = ("pending", "running", "done", "failed")
LOG = "job_id string, kind string, status string, payload_json string, error string, created_at string, updated_at string, seq long"


def state(log: DataFrame) -> DataFrame:
    """Each job's last row by (updated_at, seq)."""
    return latest(log, "job_id", ["updated_at", "seq"])


def status_counts(jobs: DataFrame) -> DataFrame:
    """status, n for every status, zeros included, and others that occur."""
    spark = jobs.sparkSession
    known = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def overall(counts: DataFrame) -> DataFrame:
    """One row `status`: warn if any job failed, else ok."""
    return counts.agg(F.when(F.coalesce(F.max(F.when(F.col("status") == "failed", F.col("n"))), F.lit(0)) > 0, "warn").otherwise("ok").alias("status"))


def next_pending(jobs: DataFrame) -> DataFrame:
    """The oldest pending job by (created_at, job_id), or no row; one row a task travels."""
    rows = jobs.where("status = 'pending'")
    return rows.agg(F.min_by(F.struct(*rows.columns), F.struct("created_at", "job_id")).alias("_row")).where("_row is not null").select("_row.*")


def retried(jobs: DataFrame, updated_at: Column) -> DataFrame:
    """Failed jobs as pending ones without their error; no other job can be retried."""
    return jobs.where("status = 'failed'").withColumns({"status": F.lit("pending"), "error": F.lit(None).cast("string"), "updated_at": updated_at})


def lines(jobs: DataFrame) -> DataFrame:
    """job_id and its display line."""
    path = F.nullif(F.trim(F.get_json_object("payload_json", "$.path")), F.lit(""))
    failed = F.when(F.col("status") == "failed", F.concat(F.lit("failed_at="), "updated_at"))
    said = F.concat(F.lit("error="), F.col("error"))
    return jobs.select("job_id", F.concat_ws(" ", "job_id", "status", "kind", F.concat(F.lit("updated_at="), "updated_at"), F.concat(F.lit("path="), path), F.when(F.col("error").isNotNull(), failed), said).alias("line"))


class Queue:
    """A queue over a Parquet log folder. Claims are safe within one driver, which holds the lock."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], str] | None = None):
        self.spark, self.path = spark, path
        self.clock = clock or (lambda: datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f"))
        self.lock = threading.Lock()
        self.seq = 0

    def log(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(LOG).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def jobs(self) -> DataFrame:
        return state(self.log()).orderBy("created_at", "job_id")

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(self.path)

    def _next(self) -> int:
        if not self.seq:
            self.seq = int(self.log().agg(F.max("seq")).first()[0] or 0)
        self.seq += 1
        return self.seq

    def enqueue(self, kind: str, payloads: list[str]) -> list[str]:
        with self.lock:
            now, rows = self.clock(), []
            for p in payloads:
                n = self._next()
                rows.append((f"job-{n:08d}", kind, "pending", p, None, now, now, n))
            if rows:
                self._append(rows)
            return [r[0] for r in rows]

    def enqueue_frame(self, kind: str, rows: DataFrame) -> int:
        """Append a pending job for each row (job_key, payload_json) whose key has none yet; how many.

        The id comes from the key, so the same rows again, as in a replayed batch, add nothing;
        rows stay distributed.
        """
        with self.lock:
            now = self.clock()
            job_id = F.concat(F.lit("job-"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), "job_key"), 256), 1, 16))
            new = rows.select(job_id.alias("job_id"), "payload_json").groupBy("job_id").agg(F.min("payload_json").alias("payload_json"))
            new = new.join(self.log().select("job_id").distinct(), "job_id", "left_anti")
            made = new.select("job_id", F.lit(kind).alias("kind"), F.lit("pending").alias("status"), "payload_json", F.lit(None).cast("string").alias("error"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(self._next()).cast("long").alias("seq"))
            before = self.log().count()
            made.write.mode("append").parquet(self.path)
            return self.log().count() - before

    def _set(self, job, status: str, error: str | None = None) -> None:
        self._append([(job["job_id"], job["kind"], status, job["payload_json"], error, job["created_at"], self.clock(), self._next())])

    def get(self, job_id: str):
        row = state(self.log().where(F.col("job_id") == job_id)).first()
        if row is None:
            raise KeyError(f"no job {job_id}")
        return row

    def claim(self):
        """The oldest pending job, now running, or None."""
        with self.lock:
            job = next_pending(state(self.log())).first()
            if job is not None:
                self._set(job, "running")
            return job

    def finish(self, job_id: str, error: str | None = None) -> None:
        with self.lock:
            self._set(self.get(job_id), "failed" if error is not None else "done", error)

    def retry(self, job_id: str) -> None:
        """Failed jobs become pending, without their error; others can't be retried."""
        with self.lock:
            job = self.get(job_id)
            if job["status"] != "failed":
                raise ValueError(f"{job_id} is {job['status']}, not failed")
            self._set(job, "pending")

    def run(self, handlers: dict[str, Callable[[str], None]], poll: float = 0.5, max_loops: int | None = None) -> int:
        """Work on and on: one job a loop, a pause when there is none; how many jobs were done in `max_loops`."""
        n = loops = 0
        while max_loops is None or loops < max_loops:
            done = self.work(handlers, 1)
            n, loops = n + done, loops + 1
            if not done and (max_loops is None or loops < max_loops):
                time.sleep(poll)
        return n

    def work(self, handlers: dict[str, Callable[[str], None]], at_most: int | None = None) -> int:
        """Run pending jobs one at a time; an exception fails its job with its text."""
        n = 0
        while (at_most is None or n < at_most) and (job := self.claim()) is not None:
            try:
                if job["kind"] not in handlers:
                    raise ValueError(f"no handler for {job['kind']}")
                handlers[job["kind"]](job["payload_json"])
            except Exception as e:  # noqa: BLE001 - the error is the job's result
                self.finish(job["job_id"], str(e))
            else:
                self.finish(job["job_id"])
            n += 1
        return n
