"""Work as a stream: new documents are validated in micro-batches, each applied once, and running figures are kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docledger.operators import queue
from docledger.shared import checkpoint as settled


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(arrivals: DataFrame, work: Callable[[DataFrame], DataFrame], ledger: str, checkpoint: str) -> StreamingQuery:
    """Runs `work` over what has arrived until nothing is left, then stops.

    Each batch writes its own folder of the ledger (batch=N) and overwrites it if the batch is repeated, so a stream that
    was stopped or lost an executor in the middle gives the same ledger when it starts again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class Limits:
    """How many jobs a claim may take, how many may run in a workspace and overall, when a lock is stale, and how many claims a drain makes."""

    claim: int = 100
    per_workspace: int = 2
    overall: int = 5
    stale_seconds: int = 360
    claims: int = 1000


JOBS = (
    "id long, document_id long, workspace_id long, status string, attempts int, max_attempts int, created_at timestamp, run_after timestamp, "
    "locked_at timestamp, locked_by string, last_error string"
)


def drain_jobs(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], now: Column, runner: str = "drain", limits: Limits = Limits()) -> tuple[DataFrame, int, int]:  # noqa: B008
    """Sweeps stale locks, then claims and runs until nothing can be claimed: (jobs, how many were claimed, how many swept).

    `work` takes claimed jobs and gives their outcomes (id, attempts, kind, error, fatal, until), kind succeeded, failed,
    deferred or parked. Jobs that it says nothing about go on running, and are swept by a later drain. A parked job goes back
    to the queue and ends the drain, as a claim would only return it. Each claim takes as many jobs as the caps allow; they run
    at once, as a job of their own in Spark. What was claimed and what came of it is checkpointed before it is used.
    """
    before = jobs
    jobs = settled(queue.sweep(jobs, now, limits.stale_seconds))
    swept = before.filter("status = 'running'").join(jobs.filter("status <> 'running'"), "id", "left_semi").count()
    claimed = 0
    for _ in range(limits.claims):
        won = settled(queue.claimable(jobs, now, limits.claim, limits.per_workspace, limits.overall))
        took = won.count()
        if not took:
            break
        claimed += took
        running = queue.taken(jobs, won, runner, now)
        came = settled(work(running.join(F.broadcast(won), "id", "left_semi")))  # at most `limits.claim` rows
        parked = F.col("kind") == "parked"
        outcomes = came.withColumns({"until": F.when(parked, now).otherwise(F.col("until")), "kind": F.when(parked, "deferred").otherwise(F.col("kind"))})
        jobs = settled(queue.settle(running, outcomes, now))
        if not came.filter(parked).isEmpty() or not came.count():
            break
    return jobs, claimed, swept


def state_of(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The jobs after a batch; none before the first."""
    return spark.read.schema(JOBS).parquet(f"{path}/batch={batch}") if batch >= 0 else spark.createDataFrame([], JOBS)


def drain_queue(arrivals: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, limits: Limits = Limits()) -> StreamingQuery:  # noqa: B008
    """A queue as a stream: arriving jobs (id, document_id, workspace_id, at) are enqueued once, and each batch drains what is due.

    The clock is the latest `at` of a batch, so that leases, backoff and stale locks come out the same when a batch is repeated.
    Each batch reads the jobs after the last one and writes them anew, as caps hold across workspaces and every claim ranks all
    waiting jobs; a batch that was interrupted is overwritten, so that a stream that stops anywhere goes on with the same jobs.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = settled(batch)
        at = batch.agg(F.max("at")).first()[0]
        jobs = state_of(spark, path, number - 1)
        if at is not None:
            now = F.lit(at)
            new = batch.dropDuplicates(["id"]).join(jobs.select("id"), "id", "left_anti")
            jobs = queue.enqueue(jobs, new, now).select(*jobs.columns)
            jobs = drain_jobs(jobs, work, now, f"batch {number}", limits)[0]
        jobs.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(arrivals: DataFrame, within: str = "1 hour") -> DataFrame:
    """Uploads (workspace_id, sha256, arrived_at) of which only the first within the delay goes on."""
    return arrivals.withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(["workspace_id", "sha256"])


def spend_by_day(usage: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cost of each UTC day, final once the watermark has passed its end."""
    days = usage.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day")).agg(F.sum("cost_micros").cast("bigint").alias("cost_micros"))
    return days.select(F.to_date("window.start").alias("day"), "cost_micros")


def uploads_by_address(requests: DataFrame, length: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Requests of each address in windows of fixed length, for a limiter."""
    return requests.withWatermark("arrived_at", delay).groupBy(F.window("arrived_at", length), "address").agg(F.count("*").alias("requests"))
