"""Rate limits over a stream, with one counter a key and window in the state store.

A counter is kept until its window has been quiet for some time and is then dropped by a timer, so
the state holds the windows that are in use, however long the stream runs; counts are in the
checkpoint and go on after a restart.  Windows are keyed one by one, so a busy key is dealt over
as many tasks as it has windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ledger import INSTALLATION_LIMIT, INSTALLATION_WINDOW, REPOSITORY_LIMIT, REPOSITORY_WINDOW, bucket_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Counter(StatefulProcessor):
    """The count of one key and window; rows of a batch are counted in their order."""

    def __init__(self, order: Sequence[str], quiet_ms: int):
        self.order, self.quiet_ms = list(order), quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable", na_position="first")
        before = self.seen.get()[0] if self.seen.exists() else 0
        batch["nth"] = range(before + 1, before + 1 + len(batch))
        self.seen.update((before + len(batch),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield batch

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def limit_stream(stream: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], seconds: int, limit: int, quiet_seconds: float | None = None) -> DataFrame:
    """Adds bucket, nth, allowed and retryAfter, as ``ledger.fixed_window`` does for one batch.

    Rows of a later batch count after those of earlier ones, late rows in their own window; null
    keys are one key.  A window's counter goes when no row has come for ``quiet_seconds`` of
    processing time (twice the window where none are given): a row that comes later still is counted from one.
    Needs the RocksDB state store (``require_rocks``) and a processing-time trigger, as timers ask for
    batches without end.
    """
    named = stream.withColumn("bucket", bucket_of(ts, seconds))
    shape = T.StructType([*named.schema.fields, T.StructField("nth", T.LongType())])
    quiet = 2 * seconds if quiet_seconds is None else quiet_seconds
    counted = named.groupBy(*keys, "bucket").transformWithStateInPandas(Counter([ts, *order], int(quiet * 1000)), shape, "Append", "ProcessingTime")
    left = (F.col("bucket") + 1) * seconds - F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000))
    return counted.withColumn("allowed", F.col("nth") <= limit).withColumn("retryAfter", F.when(F.col("allowed"), F.lit(0)).otherwise(left).cast("long"))


def require_rocks(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def limit_installations(deliveries: DataFrame) -> DataFrame:
    """Deliveries of (installationId, receivedAt, deliveryId): 100 a minute and installation."""
    return limit_stream(deliveries, ["installationId"], "receivedAt", ["deliveryId"], INSTALLATION_WINDOW, INSTALLATION_LIMIT)


def limit_index_triggers(requests: DataFrame) -> DataFrame:
    """Requests of (repositoryId, requestedAt, requestId) to index a repository: 10 an hour and repository."""
    return limit_stream(requests, ["repositoryId"], "requestedAt", ["requestId"], REPOSITORY_WINDOW, REPOSITORY_LIMIT)
