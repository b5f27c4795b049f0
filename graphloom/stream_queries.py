"""Registered queries of streams: logs with offsets, sweeps and the outbox, cancellation."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from .queries import fresh_path, query, table
from .streaming import cancel, logs, outbox

PENDING_SQL = """l AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'IGNORED' ELSE 'PENDING' END AS status FROM events)"""


def append_logs(rows, folder: str, number: int) -> None:
    """Lines of (deliveryId, eventType, body, receivedAt) to one file a task, which takes its name when it is whole."""
    import pyarrow as pa
    from pyarrow import fs

    def write(batches):
        import json
        import uuid

        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        aside = f"{base}/{uuid.uuid4().hex}.part"
        with system.open_output_stream(aside) as out:
            for batch in batches:
                for i, event, body, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    entry = {"deliveryId": i, "eventType": event, "body": base64.b64encode(body).decode(), "receivedAt": at}
                    out.write(json.dumps(entry).encode() + b"\n")
        system.move(aside, f"{base}/s{TaskContext.get().partitionId()}-{number}.log")
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    at = F.date_format("receivedAt", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("receivedAt")
    rows.select("deliveryId", "eventType", F.col("body").cast("binary").alias("body"), at).mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


@query("""SELECT CAST(event_id AS VARCHAR) AS "deliveryId", event_type AS "eventType", sha256('{"id": ' || event_id || '}') AS body, epoch_us(ts) // 1000000 AS "receivedAt" FROM events""")
def delivery_log(spark, sf_dir):
    """Every event once, although the stream stops in between and goes on from its offsets."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i, i.cast("string").alias("deliveryId"), F.col("event_type").alias("eventType"), F.concat(F.lit('{"id": '), i, F.lit("}")).alias("body"), F.col("ts").cast("timestamp_ntz").alias("receivedAt"))
    folder, out, ck = (fresh_path(spark, n) for n in ("log", "read", "log-offsets"))
    for k in range(3):
        append_logs(rows.where(i % 3 == k), folder, k + 1)
        read = logs.deliveries(logs.read_lines(spark, folder, range_bytes=1 << 20))
        read.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("deliveryId", "eventType", F.sha2("body", 256).alias("body"), F.unix_seconds("receivedAt").alias("receivedAt"))


@query(f"""WITH {PENDING_SQL}, m AS (SELECT max(ts) AS now FROM l),
o AS (SELECT event_id, event_id % 3 = 0 AS good, row_number() OVER (ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM l, m WHERE status = 'PENDING' AND ts < now - INTERVAL 60 SECOND)
SELECT 'swept' AS what, CAST(event_id AS VARCHAR) AS key, CAST((n - 1) // 50 AS INTEGER) AS sweep, CASE WHEN NOT good THEN 'UNSWEEPABLE_DISPATCH_PAYLOAD' END AS error FROM o WHERE n <= 150
UNION ALL SELECT DISTINCT 'sent', 'k' || (event_id % 60), NULL, NULL FROM o WHERE n <= 150 AND good""")
def sweep_rounds(spark, sf_dir):
    """Three sweeps of all waiting deliveries, the second one repeated: what each takes and what the outbox has, each key once."""
    i = F.col("event_id")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "IGNORED").otherwise("PENDING")
    payload = F.when(i % 3 == 0, F.concat(F.lit('[{"prKey": "k'), i % 60, F.lit('", "repositoryId": "b", "projectId": "c"}]'))).otherwise("[]")
    rows = table(spark, sf_dir, "events").select(i.cast("string").alias("deliveryId"), status.alias("status"), F.col("ts").cast("timestamp").alias("createdAt"), payload.alias("dispatchPayload"))
    now = rows.agg(F.max("createdAt")).first()[0]  # the clock, one value
    folder = fresh_path(spark, "sweeps")
    outbox.follow(rows, outbox.waiting(spark, folder))
    for number in (0, 1, 1, 2):
        outbox.sweep(spark, folder, now, number)
    swept = spark.read.schema(f"{outbox.SWEPT}, part int").parquet(f"{folder}/sweeps")
    sent = outbox.outbox(spark, folder).snapshot()
    none = F.lit(None)
    return swept.select(F.lit("swept").alias("what"), F.col("deliveryId").alias("key"), F.col("part").alias("sweep"), "error").unionByName(
        sent.select(F.lit("sent").alias("what"), F.col("prKey").alias("key"), none.cast("int").alias("sweep"), none.cast("string").alias("error"))
    )


DAY = 1704067200
JOBS_SQL = f"""jobs AS (SELECT o_orderkey AS job, o_custkey AS project, {DAY} + o_orderkey * 7 % 1440 * 60 AS started FROM orders),
gone AS (SELECT c_custkey AS project, {DAY} + c_custkey * 13 % 1440 * 60 AS deleted FROM customer WHERE c_acctbal < 4000)"""


@query(f"""WITH {JOBS_SQL} SELECT job AS "jobId", jobs.project AS "projectId", started AS "startedAt", deleted AS "deletedAt", deleted IS NOT NULL AS cancelled
FROM jobs LEFT JOIN gone ON gone.project = jobs.project AND deleted BETWEEN started AND started + 1800""")
def jobs_cancelled(spark, sf_dir):
    """Two streams in three runs: the jobs and deletions of a day, told twice; a month later, so that all others are given out; deletions that come too late."""
    at = lambda seconds: F.timestamp_seconds(F.lit(DAY) + seconds)
    key, own = F.col("o_orderkey"), F.col("c_custkey")
    jobs = table(spark, sf_dir, "orders").select(key.alias("jobId"), F.col("o_custkey").alias("projectId"), at(key * 7 % 1440 * 60).alias("startedAt"))
    gone = table(spark, sf_dir, "customer").select(own.alias("projectId"), at(own * 13 % 1440 * 60).alias("deletedAt"), (F.col("c_acctbal") < 4000).alias("first"))
    later = F.lit(30 * 86400)
    runs = [
        (jobs, gone.where("first").unionByName(gone.where("first"))),
        (jobs.limit(1).select(F.lit(-1).cast("long").alias("jobId"), "projectId", at(later).alias("startedAt")), gone.limit(1).select(F.lit(-1).cast("long").alias("projectId"), at(later).alias("deletedAt"), "first")),
        (jobs.limit(0), gone.where("NOT first")),
    ]
    left, right, out, ck = (fresh_path(spark, n) for n in ("jobs", "deletions", "cancelled", "cancel-offsets"))
    for some, deleted in runs:
        some.write.mode("append").parquet(left)
        deleted.drop("first").write.mode("append").parquet(right)
        joined = cancel.cancel_deleted(spark.readStream.schema(jobs.schema).parquet(left), spark.readStream.schema(gone.drop("first").schema).parquet(right))
        joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out).where("jobId >= 0")
    return found.select("jobId", "projectId", F.unix_seconds("startedAt").alias("startedAt"), F.unix_seconds("deletedAt").alias("deletedAt"), "cancelled")
