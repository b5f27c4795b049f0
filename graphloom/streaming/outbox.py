"""What is sent on, once: an outbox by prKey, and sweeps that a clock drives.

The outbox is a keyed table.  A batch's events are a segment that nothing names before the batch
commits it, so a task or batch that fails leaves none; a repeated batch takes the place of what it had
put, and an event whose key an earlier batch has sent is not sent again.

Sweeps follow the ledger: ``follow_ledger`` keeps deliveries that wait in a keyed table, of
which ``sweep`` takes the oldest.  Each step of a sweep can be repeated: what it takes is written
first and, once written, is not chosen anew.

Defined results: events without a prKey share one key; of several of one key in a batch the
least by its other columns is sent; a sweep with nothing to do leaves empty parts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import GONE, KeyedTable
from ..sources.versions import Folder
from . import ledger

EVENT = "prKey string, deliveryId string, repositoryId string, projectId string, headSha string"
WAITING = "deliveryId string, status string, createdAt timestamp, dispatchPayload string"
SWEPT = "deliveryId string, createdAt timestamp, sweep string, error string, dispatchPayload string"


def outbox(spark: SparkSession, folder: str) -> KeyedTable:
    return KeyedTable(spark, f"{folder}/sent", EVENT, ["prKey"])


def waiting(spark: SparkSession, folder: str) -> KeyedTable:
    """Deliveries that were pending when they were last seen."""
    return KeyedTable(spark, f"{folder}/waiting", WAITING, ["deliveryId"])


def send(events: DataFrame, table: KeyedTable, batch_id: int) -> None:
    """Put the events of a batch whose keys no earlier batch has sent."""
    own = events.select(*table.schema.names)
    rest = [c for c in own.columns if c != "prKey"]
    once = own.groupBy("prKey").agg(F.min(F.struct(*rest)).alias("e")).select("prKey", "e.*")
    earlier = table.segments(batch_id)
    if earlier:
        sent = table.rows_of(once, earlier).select(F.col("prKey").alias("_sent"))
        once = once.join(sent, F.col("prKey").eqNullSafe(F.col("_sent")), "left_anti")
    table.put(once, batch_id)


def send_stream(events: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Send each micro-batch of a streaming frame of events; a folder belongs to one checkpoint."""
    spark = events.sparkSession
    writer = events.writeStream.foreachBatch(lambda batch, n: send(batch, outbox(spark, folder), n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def follow(rows: DataFrame, table: KeyedTable) -> int:
    """Note the pending ones of (deliveryId, status, createdAt, dispatchPayload) as waiting, the others as not; the last of each id counts."""
    columns = table.schema.names
    last = rows.groupBy("deliveryId").agg(F.max_by(F.struct(*(c for c in columns if c != "deliveryId")), F.struct("createdAt", F.col("status") != "PENDING")).alias("r"))
    return table.change(lambda _: last.select("deliveryId", "r.*").withColumn(GONE, ~F.col("status").eqNullSafe("PENDING")))


def follow_ledger(spark: SparkSession, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow the parts that ``ledger.ingest_batch`` writes below the folder."""
    rows = spark.readStream.schema(WAITING).parquet(f"{folder}/ledger")
    writer = rows.writeStream.foreachBatch(lambda batch, n: follow(batch, waiting(spark, folder)) and None).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def sweep(spark: SparkSession, folder: str, now: datetime, number: int, limit: int = ledger.PENDING_BATCH) -> DataFrame:
    """Sweep ``number``: send the oldest waiting deliveries again or fail them; returns what it took.

    Below the folder it leaves sweeps/part=<number>, transitions/part=<number> for
    ``ledger.apply_transitions``, and events in the outbox.
    """
    place, held = f"{folder}/sweeps/part={number}", waiting(spark, folder)
    if "_SUCCESS" not in Folder(spark, place).names():
        ledger.sweep_pending(held.snapshot(), F.lit(now), limit).write.mode("overwrite").parquet(place)
    taken = spark.read.schema(SWEPT).parquet(place)
    send(ledger.replayed_events(taken), outbox(spark, folder), number)
    none, replay = F.lit(None).cast("string"), F.col("sweep") == "REPLAY"
    moves = taken.select(
        "deliveryId", F.lit(number).cast("long").alias("seq"), F.lit(now).cast("timestamp").alias("at"), F.when(replay, "DISPATCHED").otherwise("FAILED").alias("to"),
        F.when(replay, F.col("dispatchPayload")).alias("payload"), none.alias("reason"), F.col("error").alias("code"), none.alias("message"),
    )
    moves.write.mode("overwrite").parquet(f"{folder}/transitions/part={number}")
    left = lambda segments: held.rows_of(taken, segments).join(taken.select("deliveryId", "createdAt"), ["deliveryId", "createdAt"], "left_semi")
    held.change(lambda segments: left(segments).withColumn(GONE, F.lit(True)))
    return taken


def on_clock(spark: SparkSession, work: Callable[[datetime, int], object], checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """Run ``work(now, number)`` at each tick; a tick that is repeated after a restart has the same time and number."""

    def tick(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("timestamp")).first()[0]
        if now is not None:
            work(now, number)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def sweep_on_clock(spark: SparkSession, folder: str, checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    return on_clock(spark, lambda now, number: sweep(spark, folder, now, number), checkpoint, every)


def stale_on_clock(spark: SparkSession, repositories: Callable[[], DataFrame], folder: str, checkpoint: str, every: str = "6 hours") -> StreamingQuery:
    """Ask for the index of repositories that are pending for too long: one part index_requests a tick, which a repeated tick replaces."""

    def work(now: datetime, number: int) -> None:
        found = ledger.stale_repositories(repositories(), F.lit(now)).select(F.col("id").alias("repositoryId"), "projectId", F.lit("sweep").alias("reason"))
        found.write.mode("overwrite").parquet(f"{folder}/index_requests/part={number}")

    return on_clock(spark, work, checkpoint, every)
