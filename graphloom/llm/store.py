"""Shared scratch space: where lineage is cut and archives are kept.

Everything that one task writes for another goes below the folder named by
``spark.checkpoint.dir``.  A private folder is made only where that setting is absent, as
in unit tests on a single machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_private: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path."""
    try:
        found = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - an absent key is reported differently by session kinds
        found = None
    if found:
        return found.rstrip("/")
    key = id(spark)
    if key not in _private:
        _private[key] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _private[key]


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which others may share as well."""
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result has no lineage beyond the files, so a lost executor costs a re-read, not a
    recomputation, and nondeterministic plans are pinned.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Remove everything that this application wrote below the shared folder; frames not yet read are lost with it.

    Results are lazy, so only the caller knows when the last of them has been read.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Estimates above this are checked by a count: joins and local rows are estimated wildly.
TRUSTED_BYTES = 1 << 40


def plan_bytes(df: DataFrame) -> int:
    """About how many bytes ``df`` has, to size groups and shards.

    Catalyst's own estimate, the file sizes for a pruned scan, costs no job; one that is
    beyond TRUSTED_BYTES is replaced by the summed length of the texts.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > TRUSTED_BYTES:
        size = int(df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 16 * F.count("*")).first()[0])
    return size


def whole_row(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns as one struct named ``row``, so that none can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in without)).alias("row")


def carried_schema(schema: str, source: DataFrame) -> T.StructType:
    """An operator's schema with the ``row`` of its source."""
    return T.StructType([*T._parse_datatype_string(schema).fields, source.schema["row"]])
