"""How rows are dealt over tasks before work that costs more than moving them."""

from __future__ import annotations

from pyspark.sql import DataFrame

LEAST_BYTES = 1 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the session has cores, dealt over all of them.

    A file of one row group is one task however large it is.  Anything but a plain scan, and
    inputs below LEAST_BYTES, stay as they are; a scan with enough partitions costs no shuffle.
    """
    execution = rows._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString() or int(execution.optimizedPlan().stats().sizeInBytes()) < LEAST_BYTES:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < execution.toRdd().getNumPartitions() < cores else rows
