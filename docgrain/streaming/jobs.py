"""Jobs of many files: a log of events that is only ever appended to, block by block, with one more try and with cancelling.

A job's state is what its events say, so that a driver that is lost is replaced by another: :func:`run` goes on with
the files that have no result yet.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrain.sources.files import blob_exists

EVENT = "job_id string, corpus string, name string, path string, status string, chunks long, secs double, error string, at timestamp"
RESULTS = ("done", "skipped", "failed", "cancelled")
#: Files that one plan ingests and whose results are written together.
BLOCK = 1000
#: Jobs that a listing shows.
LISTED = 25


def events(spark: SparkSession, root: str) -> DataFrame:
    """All events of the jobs below ``root``."""
    if not blob_exists(spark, f"{root}/events"):
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(EVENT).parquet(f"{root}/events")


def _append(rows: DataFrame, root: str) -> None:
    names = [part.split()[0] for part in EVENT.split(", ")]
    types = dict(part.split() for part in EVENT.split(", "))
    full = rows.withColumn("at", F.current_timestamp())
    full.select(*[(F.col(n) if n in full.columns else F.lit(None)).cast(types[n]).alias(n) for n in names]).write.mode("append").parquet(f"{root}/events")


def _mark(spark: SparkSession, root: str, job_id: str, status: str, corpus: str | None = None) -> None:
    _append(spark.createDataFrame([(job_id, corpus, status)], "job_id string, corpus string, status string"), root)


def create(spark: SparkSession, root: str, corpus: str = "pdf") -> str:
    """A new job, to which files are added until it is finalised."""
    job_id = uuid.uuid4().hex[:12]
    _mark(spark, root, job_id, "created", corpus)
    return job_id


def add(files: DataFrame, root: str, job_id: str) -> None:
    """Queue files (name, path) of a job."""
    _append(files.select("name", "path", F.lit(job_id).alias("job_id"), F.lit("queued").alias("status")), root)


def finalise(spark: SparkSession, root: str, job_id: str) -> None:
    """No more files come: the job is complete when all have a result."""
    _mark(spark, root, job_id, "finalised")


def cancel(spark: SparkSession, root: str, job_id: str) -> bool:
    """Ask a job to stop after the block that is being worked on; False for one that is unknown or over."""
    job = states(events(spark, root)).where(F.col("job_id") == job_id).first()
    if job is None or job["status"] in ("completed", "cancelled"):
        return False
    _mark(spark, root, job_id, "cancel")
    return True


def pending(log: DataFrame, job_id: str) -> DataFrame:
    """Files (name, path) of a job that have no result yet, each once."""
    mine = log.where(F.col("job_id") == job_id)
    over = mine.where(F.col("status").isin(*RESULTS)).select("path")
    return mine.where("status = 'queued'").groupBy("path").agg(F.min("name").alias("name")).join(over, "path", "left_anti").select("name", "path")


def run(spark: SparkSession, root: str, job_id: str, ingest: Callable[[DataFrame], DataFrame], block: int = BLOCK, on_stage: Callable[[str, int], None] | None = None) -> None:
    """Ingest the files of a job that have no result yet, ``block`` files at a time.

    ``ingest`` takes files (name, path) and returns a row (path, status, chunks, error) for each: done, skipped or
    failed; a file without a row has failed. Failed files are tried once more. A block that raises has failed whole and
    is tried again in halves, so that one file does not take others with it. A request to cancel is looked for before every
    block; what is left then is cancelled. ``on_stage`` is told a stage and how many files it has.
    """

    def attempt(files: list, tries: int) -> list[tuple]:
        start, table = time.perf_counter(), spark.createDataFrame(files, "name string, path string")
        try:
            got = {r["path"]: r for r in ingest(table).select("path", "status", "chunks", "error").collect()}
        except Exception as error:  # noqa: BLE001  a file that cannot be read is a result
            if len(files) > 1:
                half = len(files) // 2
                return attempt(files[:half], tries) + attempt(files[half:], tries)
            got = {files[0][1]: {"status": "failed", "chunks": 0, "error": str(error)[:1000]}}
        secs = (time.perf_counter() - start) / len(files)
        rows = [(name, path, *((got[path]["status"], got[path]["chunks"], got[path]["error"]) if path in got else ("failed", 0, "no result")), secs) for name, path in files]
        failed = [r for r in rows if r[2] == "failed"]
        if not failed or tries <= 1:
            return rows
        return [r for r in rows if r[2] != "failed"] + attempt([r[:2] for r in failed], tries - 1)

    def write(rows: list[tuple]) -> None:
        table = spark.createDataFrame(rows, "name string, path string, status string, chunks long, error string, secs double")
        _append(table.withColumn("job_id", F.lit(job_id)), root)

    while True:
        log = events(spark, root)
        stop = not log.where((F.col("job_id") == job_id) & (F.col("status") == "cancel")).isEmpty()
        if stop:
            left = pending(log, job_id)
            if not left.isEmpty():
                _append(left.select("name", "path", F.lit(job_id).alias("job_id"), F.lit("cancelled").alias("status"), F.lit(0).alias("chunks"), F.lit(0.0).alias("secs")), root)
            return
        files = [tuple(r) for r in pending(log, job_id).orderBy("path").limit(block).collect()]
        if not files:
            return
        if on_stage:
            on_stage("ingesting", len(files))
        write(attempt(files, 2))
        if on_stage:
            on_stage("written", len(files))


def states(log: DataFrame) -> DataFrame:
    """A row for each job: corpus, files queued, done, skipped, failed and cancelled, chunks, mean seconds, ETA, times, status.

    A job is staging until it is finalised, then queued, running, completed; cancelling and cancelled after a request.
    """
    count = lambda s: F.count_if(F.col("status") == s)
    result = F.col("status").isin(*RESULTS)
    rows = log.groupBy("job_id").agg(
        F.max("corpus").alias("corpus"),
        F.count_distinct(F.when(F.col("status") == "queued", F.col("path"))).alias("total"),
        *[count(s).alias(s) for s in RESULTS],
        F.coalesce(F.sum(F.when(result, F.col("chunks"))), F.lit(0)).alias("chunks"),
        F.avg(F.when(result & (F.col("status") != "cancelled"), F.col("secs"))).alias("mean_secs"),
        F.max(F.col("status") == "finalised").alias("finalised"),
        F.max(F.col("status") == "cancel").alias("cancel"),
        F.min("at").alias("created"),
        F.max(F.when(result, F.col("at"))).alias("last"),
    )
    over = F.col("done") + F.col("skipped") + F.col("failed") + F.col("cancelled")
    left = F.col("total") - over
    status = F.when(F.col("cancel") & (left <= 0), "cancelled").when(F.col("cancel"), "cancelling").when(~F.col("finalised"), "staging").when(left <= 0, "completed").when(over > 0, "running").otherwise("queued")
    rows = rows.withColumns({"status": status, "remaining": left, "eta_secs": left * F.coalesce("mean_secs", F.lit(0.0))})
    return rows.drop("finalised", "cancel")


def listing(log: DataFrame, most: int = LISTED) -> DataFrame:
    """The newest jobs, newest first."""
    return states(log).orderBy(F.desc("created"), "job_id").limit(most)


def active(log: DataFrame) -> DataFrame:
    """The newest job that is not over; no row if there is none."""
    return states(log).where(~F.col("status").isin("completed", "cancelled")).orderBy(F.desc("created"), "job_id").limit(1)


def failures(log: DataFrame, job_id: str) -> DataFrame:
    """(path, name, error) of the files that failed, by their last event."""
    last = Window.partitionBy("path").orderBy(F.desc("at"))
    mine = log.where((F.col("job_id") == job_id) & F.col("status").isin(*RESULTS)).withColumn("r", F.row_number().over(last))
    return mine.where("r = 1 and status = 'failed'").select("path", "name", "error")
