"""Jobs whose project is deleted while they run: a left outer join of two streams.

The same plan runs on batches.  On streams both sides have watermarks: a job is given out as
cancelled at once, as not cancelled when no deletion in its lifetime can come any more, and then leaves
the state.  Jobs are joined by project, so a project's jobs and deletions meet in one task: only
those within a lifetime and the delay are held.

Defined results: a deletion that comes after the watermark has passed it changes nothing; of
several deletions of one project within the delay the first to come counts on streams, the
earliest in batches; jobs without a project run on; jobs and deletions without a time are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIFETIME_MINUTES = 30
DELAY = "1 hour"  # at least a lifetime, so that a deletion told twice cancels once


def first_deletions(deletions: DataFrame, delay: str) -> DataFrame:
    rows = deletions.where("deletedAt IS NOT NULL").select("projectId", "deletedAt")
    if rows.isStreaming:
        return rows.withWatermark("deletedAt", delay).dropDuplicatesWithinWatermark(["projectId"])
    return rows.groupBy("projectId").agg(F.min("deletedAt").alias("deletedAt"))


def cancel_deleted(jobs: DataFrame, deletions: DataFrame, minutes: int = LIFETIME_MINUTES, delay: str = DELAY) -> DataFrame:
    """Adds deletedAt and cancelled to (jobId, projectId, startedAt): the project was deleted in the job's lifetime, both ends included."""
    own = jobs.where("startedAt IS NOT NULL")
    own = own.withWatermark("startedAt", delay) if own.isStreaming else own
    gone = first_deletions(deletions, delay).withColumnRenamed("projectId", "_project")
    until = F.col("startedAt") + F.expr(f"INTERVAL {minutes} MINUTES")
    joined = own.join(gone, (F.col("projectId") == F.col("_project")) & (F.col("deletedAt") >= F.col("startedAt")) & (F.col("deletedAt") <= until), "left")
    return joined.withColumn("cancelled", F.col("deletedAt").isNotNull()).drop("_project")
