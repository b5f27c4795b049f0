"""Index jobs as a fold of their events.

Every change of a job is an appended event; the row of a job is what its events say together.
One aggregation by job replaces the updates in place: partial on each task, no order needed
across tasks, and the same rows whenever it is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The step that each kind of event leaves a job in; PROGRESS and FAILED name their own.
STEPS = {"CREATED": "acquire-lock", "SUCCEEDED": "completed", "UNCHANGED": "no-op-already-indexed"}
TERMINAL = ("SUCCEEDED", "UNCHANGED", "FAILED")
COUNTS = ("filesTotal", "filesProcessed", "filesSkipped", "symbolsCreated", "edgesCreated")


def last_known(value: Column, order: Column) -> Column:
    """The value of the last row that has one."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def fold_jobs(events: DataFrame) -> DataFrame:
    """One row a jobId of (jobId, seq, at, event, repositoryId, mode, runId, step, progressPercent, targetCommitSha,
    previousCommitSha, code, message and COUNTS).

    Events are CREATED, RETRIED, PROGRESS, SUCCEEDED, UNCHANGED and FAILED, in the order of seq.  A
    column that an event leaves null keeps what it had; attempts count the creation and every retry.
    Events of a job that was never created are dropped.
    """
    event, seq = F.col("event"), F.col("seq")
    step = F.when(event == "FAILED", F.coalesce("step", F.lit("failed"))).when(event == "PROGRESS", F.col("step"))
    for kind, name in STEPS.items():
        step = step.when(event == kind, F.lit(name))
    progress = F.when(event == "CREATED", 0).when(event.isin("SUCCEEDED", "UNCHANGED"), 100).when(event == "PROGRESS", F.col("progressPercent"))
    terminal = F.when(event.isin(*TERMINAL), seq)
    status = F.when(event == "FAILED", "FAILED").otherwise("SUCCEEDED")
    error = F.to_json(F.struct("code", "message", "step"))
    born = F.when(event == "CREATED", seq)
    folded = events.groupBy("jobId").agg(
        F.count_if(event == "CREATED").alias("_born"),
        *(F.min_by(c, born).alias(c) for c in ("repositoryId", "mode", "runId")),
        F.coalesce(F.max_by(status, terminal), F.lit("RUNNING")).alias("status"),
        last_known(F.col("targetCommitSha"), seq).alias("targetCommitSha"),
        last_known(F.col("previousCommitSha"), seq).alias("previousCommitSha"),
        *(F.coalesce(last_known(F.col(c), seq), F.lit(0)).alias(c) for c in COUNTS),
        last_known(step, seq).alias("currentStep"),
        last_known(progress, seq).alias("progressPercent"),
        F.min_by("at", born).alias("startedAt"),
        F.max_by("at", terminal).alias("completedAt"),
        F.max_by(error, F.when(event == "FAILED", seq)).alias("error"),
        (F.count_if(event == "RETRIED") + 1).alias("attempts"),
    )
    return folded.where("_born > 0").drop("_born")
