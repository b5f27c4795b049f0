from datetime import datetime, timedelta

from graphloom.streaming.cancel import cancel_deleted

T0 = datetime(2024, 1, 1)
JOBS, GONE = "jobId long, projectId long, startedAt timestamp", "projectId long, deletedAt timestamp"


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def told(frame):
    return sorted((r.jobId, r.deletedAt and int((r.deletedAt - T0).total_seconds() // 60), r.cancelled) for r in frame.collect())


MADE = [(1, 1, 0), (2, 1, 10), (3, 1, 11), (4, 1, 41), (5, 2, 10), (6, None, 10), (7, 3, None)]
DELETED = [(1, 40), (1, 40), (9, 5), (None, 12), (2, None)]


def test_batches(spark):
    jobs = spark.createDataFrame([(j, p, at(m)) for j, p, m in MADE], JOBS)
    gone = spark.createDataFrame([(p, at(m)) for p, m in DELETED], GONE)
    assert told(cancel_deleted(jobs, gone)) == [(1, None, False), (2, 40, True), (3, 40, True), (4, None, False), (5, None, False), (6, None, False)]
    assert told(cancel_deleted(jobs, gone.limit(0))) == [(j, None, False) for j in range(1, 7)]
    assert told(cancel_deleted(jobs.limit(0), gone)) == []


def test_streams_agree_and_late_deletions_change_nothing(spark, tmp_path):
    left, right, out = (f"file://{tmp_path}/{n}" for n in ("jobs", "gone", "out"))

    def run(jobs, gone):
        spark.createDataFrame([(j, p, at(m)) for j, p, m in jobs], JOBS).coalesce(1).write.mode("append").parquet(left)
        spark.createDataFrame([(p, at(m)) for p, m in gone], GONE).coalesce(1).write.mode("append").parquet(right)
        joined = cancel_deleted(spark.readStream.schema(JOBS).parquet(left), spark.readStream.schema(GONE).parquet(right))
        joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return told(spark.read.schema(f"{JOBS}, deletedAt timestamp, cancelled boolean").parquet(out))

    assert run(MADE, DELETED) == [(2, 40, True), (3, 40, True)]  # at once; the others may still be cancelled
    assert run([(8, 4, 50)], [(4, 60), (1, 40)]) == [(2, 40, True), (3, 40, True), (8, 60, True)]  # told again: cancelled once
    batch = cancel_deleted(spark.createDataFrame([(j, p, at(m)) for j, p, m in [*MADE, (8, 4, 50)]], JOBS), spark.createDataFrame([(p, at(m)) for p, m in [*DELETED, (4, 60)]], GONE))
    assert run([(100, 100, 9000)], [(100, 9000)])[:7] == told(batch)
    assert run([], [(2, 20)])[:7] == told(batch)
