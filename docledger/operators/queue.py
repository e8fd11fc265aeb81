"""The work queue as transitions of the jobs table: each takes the table and gives its next state. One driver owns it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.risk import backoff_seconds
from docledger.operators.ledger import behind_running, latest

#: The stages in order, and the seconds that each is allowed.
STAGES = {"parse": 140, "extract": 200, "ground": 5, "validate": 5, "reconcile": 200, "finalise": 5}
MAX_ATTEMPTS = 3


def later(now: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, now)


def claimable(jobs: DataFrame, now: Column, limit: int, per_workspace: int, overall: int) -> DataFrame:
    """Ids of the jobs a runner may claim: due, oldest first, within the caps on running jobs.

    A job that its workspace's cap blocks still takes a place in the overall order, so only the first `overall` jobs can be
    claimed. They are found by a limit; all jobs of their workspaces that come before them are among them, too, so that their
    places in both orders follow from these rows alone.
    """
    due = jobs.filter((F.col("status") == "queued") & (F.col("run_after") <= now))
    running = jobs.filter("status = 'running'").agg(F.count("*").alias("all_running"))
    first = due.orderBy("created_at", "id").limit(overall).select("id", "workspace_id", "created_at")
    order = Window.orderBy("created_at", "id")  # at most `overall` rows, as in the next
    placed = first.withColumns({"overall_place": F.row_number().over(order), "place": F.row_number().over(Window.partitionBy("workspace_id").orderBy("created_at", "id"))})
    ranked = behind_running(placed, jobs).join(F.broadcast(running))  # one row
    return ranked.filter((F.col("workspace_rank") <= per_workspace) & (F.col("overall_place") + F.col("all_running") <= overall)).orderBy("created_at", "id").limit(limit).select("id")


def claim(jobs: DataFrame, runner: str, now: Column, limit: int, per_workspace: int, overall: int) -> DataFrame:
    return taken(jobs, claimable(jobs, now, limit, per_workspace, overall), runner, now)


def taken(jobs: DataFrame, won: DataFrame, runner: str, now: Column) -> DataFrame:
    """Jobs of which those that were claimed (won: id) run."""
    won = won.select("id", F.lit(True).alias("won"))
    mine = F.coalesce(F.col("won"), F.lit(False))
    return jobs.join(F.broadcast(won), "id", "left").withColumns(  # at most `limit` rows
        {"status": F.when(mine, "running").otherwise(F.col("status")), "attempts": F.col("attempts") + mine.cast("int"), "locked_at": F.when(mine, now).otherwise(F.col("locked_at")), "locked_by": F.when(mine, F.lit(runner)).otherwise(F.col("locked_by"))}
    ).drop("won")


def sweep(jobs: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """Running jobs with a stale lock go back to the queue with backoff, or are dead once out of attempts."""
    stale = F.coalesce((F.col("status") == "running") & (F.col("locked_at") < later(now, F.lit(-stale_seconds))), F.lit(False))
    return jobs.withColumns(
        {
            "status": F.when(stale & (F.col("attempts") >= F.col("max_attempts")), "dead").when(stale, "queued").otherwise(F.col("status")),
            "run_after": F.when(stale, later(now, backoff_seconds(F.col("attempts")))).otherwise(F.col("run_after")),
            "last_error": F.when(stale, F.coalesce("last_error", F.lit("stale lock recovered"))).otherwise(F.col("last_error")),
            "locked_at": F.when(~stale, F.col("locked_at")), "locked_by": F.when(~stale, F.col("locked_by")),
        }
    )


def sweep_runs(runs: DataFrame, jobs: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """Old running stage runs whose job cannot come back are closed as stale."""
    ended = jobs.filter(F.col("status").isin("dead", "succeeded")).select(F.col("id").alias("job_id")).distinct().withColumn("ended", F.lit(True))
    old = (F.col("status") == "running") & (F.col("started_at") < later(now, F.lit(-stale_seconds))) & (F.col("job_id").isNull() | F.col("ended").isNotNull())
    return runs.join(ended, "job_id", "left").withColumns({"error": F.when(old, "stale"), "finished_at": F.when(old, now), "status": F.when(old, "failed").otherwise(F.col("status"))}).drop("ended").select(*runs.columns, "error", "finished_at")


def fail(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Applies failures (id, error, fatal): dead if fatal or out of attempts, else queued with backoff."""
    return failing(jobs.join(failures.select("id", "error", "fatal"), "id", "left"), now).drop("error", "fatal")


def failing(jobs: DataFrame, now: Column) -> DataFrame:
    """The same for jobs that carry their error, null if they did not fail."""
    bad = F.col("error").isNotNull()
    dead = bad & (F.col("fatal") | (F.col("attempts") >= F.col("max_attempts")))
    return jobs.withColumns(
        {
            "status": F.when(dead, "dead").when(bad, "queued").otherwise(F.col("status")), "run_after": F.when(bad & ~dead, later(now, backoff_seconds(F.col("attempts")))).otherwise(F.col("run_after")),
            "last_error": F.when(bad, F.substring("error", 1, 2000)).otherwise(F.col("last_error")), "locked_at": F.when(~bad, F.col("locked_at")), "locked_by": F.when(~bad, F.col("locked_by")),
        }
    )


def settle(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Applies what came of running jobs: outcomes (id, attempts, kind, error, fatal, until), kind succeeded, failed, or deferred.

    An outcome counts only for the attempt that it belongs to: one that comes after the job's lock went stale, or a second
    time, changes nothing. Jobs without an outcome go on running until their lock is stale.
    """
    came = outcomes.select("id", F.col("attempts").alias("attempt"), "kind", "error", "fatal", "until")
    own = (F.col("status") == "running") & (F.col("attempt") == F.col("attempts"))
    rows = jobs.join(came, "id", "left").withColumn("kind", F.when(own, F.col("kind")))
    is_ = lambda kind: F.coalesce(F.col("kind") == kind, F.lit(False))
    rows = failing(rows.withColumns({"error": F.when(is_("failed"), F.coalesce("error", F.lit(""))), "fatal": F.coalesce("fatal", F.lit(False))}), now)
    return defer(finish(rows, is_("succeeded")), is_("deferred"), F.col("until")).select(*jobs.columns)


def defer(jobs: DataFrame, which: Column, until: Column) -> DataFrame:
    """Puts jobs off without charging the attempt."""
    return jobs.withColumns({"attempts": F.when(which, F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts")), "run_after": F.when(which, until).otherwise(F.col("run_after")), "status": F.when(which, "queued").otherwise(F.col("status")), "locked_at": F.when(~which, F.col("locked_at")), "locked_by": F.when(~which, F.col("locked_by"))})


def requeue(jobs: DataFrame, which: Column, now: Column) -> DataFrame:
    return defer(jobs, which, now).withColumn("attempts", F.when(which, 0).otherwise(F.col("attempts")))


def finish(jobs: DataFrame, which: Column) -> DataFrame:
    return jobs.withColumns({"status": F.when(which, "succeeded").otherwise(F.col("status")), "locked_at": F.when(~which, F.col("locked_at")), "locked_by": F.when(~which, F.col("locked_by"))})


def enqueue(jobs: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Adds a job for each document (id, document_id, workspace_id)."""
    new = documents.select("id", "document_id", "workspace_id").withColumns({"status": F.lit("queued"), "attempts": F.lit(0), "max_attempts": F.lit(MAX_ATTEMPTS), "created_at": now, "run_after": now})
    return jobs.unionByName(new, allowMissingColumns=True)


def next_stages(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """The first stage of each document that has not succeeded; rejected documents and complete ones have none.

    Adds the seconds it is allowed, by which a runner decides whether it still fits before its deadline.
    """
    done = runs.filter("status = 'succeeded'").groupBy("document_id").agg(F.collect_set("stage").alias("done"))
    order = F.array(*map(F.lit, STAGES))
    left = F.array_except(order, F.coalesce("done", F.array().cast("array<string>")))
    seconds = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    rows = documents.filter(F.col("status") != "rejected").join(done, "document_id", "left").withColumn("stage", F.try_element_at(left, F.lit(1)))
    return rows.filter("stage is not null").select("document_id", "stage", seconds[F.col("stage")].alias("seconds"))


def reusable(extractions: DataFrame, runs: DataFrame) -> DataFrame:
    """Initial extractions that an abandoned run of the extract stage has paid for: newer than that run's start."""
    newest = latest(extractions.filter("kind = 'initial'").select("document_id", "id", "created_at"), ["document_id"])
    open_runs = latest(runs.filter("stage = 'extract' and status = 'running'").select("document_id", "id", "started_at"), ["document_id"], "started_at").select("document_id", "started_at")
    return newest.join(open_runs, "document_id").filter(F.col("created_at") > F.col("started_at")).select("document_id", F.col("id").alias("extraction_id"))


def adoption(initial: DataFrame, second: DataFrame) -> DataFrame:
    """Whether a second extraction (document_id, blocking, doc_type) replaces the first: it is an invoice and has fewer blocking issues."""
    joined = initial.select("document_id", F.col("blocking").alias("before")).join(second.select("document_id", F.col("blocking").alias("after"), "doc_type"), "document_id")
    return joined.withColumn("adopted", (F.col("doc_type") != "other") & (F.col("after") < F.col("before")))


def retry(jobs: DataFrame, runs: DataFrame, documents: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs and runs after documents are retried by hand: all their checkpoints go, the jobs start afresh."""
    ids = documents.select("document_id").distinct()
    marked = jobs.join(ids.withColumn("again", F.lit(True)), "document_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    return requeue(marked, F.col("again"), now).drop("again"), runs.join(ids, "document_id", "left_anti")


def with_duration(runs: DataFrame) -> DataFrame:
    return runs.withColumn("duration_ms", (F.unix_millis("finished_at") - F.unix_millis("started_at")))


def blocked_by_budget(usage: DataFrame, documents: DataFrame, day: Column, cap_micros: int, free: bool) -> DataFrame:
    """Documents with whether the day's budget stops them; a free provider never does."""
    from docledger.operators.ledger import spent_on

    spent = spent_on(usage, day).withColumnRenamed("cost_micros", "spent")
    return documents.join(F.broadcast(spent)).withColumn("blocked", F.lit(not free) & (F.col("spent") >= cap_micros))  # one row


def finalised(metadata: DataFrame, fields: DataFrame, invoices: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invoices with the drafts of finished documents put over theirs, and documents then waiting for review."""
    from docledger.operators.draft import header
    from docledger.operators.ledger import set_status
    from docledger.sources.tables import replaced

    worst = metadata.groupBy("document_id").agg(F.max("risk").alias("risk"), F.count("*").alias("n_fields"))
    drafts = header(fields).join(worst, "document_id", "left")
    done = drafts.select("document_id").distinct()
    waiting = set_status(documents.join(done, "document_id", "left_semi"), "needs_review")
    return replaced(invoices, drafts.select(*invoices.columns)), documents.join(done, "document_id", "left_anti").unionByName(waiting, allowMissingColumns=True)


def repaired(extractions: DataFrame, issues_of: DataFrame) -> DataFrame:
    """The issues of each document's newest adopted extraction (issues_of: extraction_id and the issue), whatever was stored before."""
    chosen = latest(extractions.filter("adopted").select("document_id", "id", "created_at"), ["document_id"]).select("document_id", F.col("id").alias("extraction_id"))
    return chosen.join(issues_of.drop("document_id"), "extraction_id").drop("extraction_id")
