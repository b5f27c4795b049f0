"""Keyset pages of a large table from files by range, of which a page opens those it needs.

Rows are written in the order of the pages, in files that follow each other; a table beside them
has each file's bounds and number of rows.  A page asks that table for the file that the cursor is in
and for as many after it as hold a page, and reads nothing else.

Defined results: ``by`` must tell rows apart and have no nulls (``write_pages`` refuses others); an
empty table has an empty page; a cursor need not be a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import keyset_page


def below(by: Sequence[str], cursor: Sequence) -> Column:
    first, second = (F.col(c) for c in by)
    return (first < F.lit(cursor[0])) | ((first == F.lit(cursor[0])) & (second < F.lit(cursor[1])))


def write_pages(rows: DataFrame, folder: str, by: Sequence[str] = ("createdAt", "id"), files: int = 32) -> None:
    """Write the rows into about ``files`` files by descending ranges of ``by``."""
    spark = rows.sparkSession
    order = [F.col(c).desc() for c in by]
    checked = rows.withColumn(by[0], F.when(F.col(by[0]).isNull() | F.col(by[1]).isNull(), F.raise_error(F.lit("a page's keys are not null"))).otherwise(F.col(by[0])))
    checked.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/rows")
    named = spark.read.schema(rows.schema).parquet(f"{folder}/rows").withColumn("file", F.input_file_name())
    key = F.struct(*by)
    bounds = named.groupBy("file").agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count("*").alias("rows"))
    bounds.select("file", "rows", *(F.col(f"{b}.{c}").alias(f"{b}_{n}") for b in ("least", "most") for n, c in enumerate(by))).coalesce(1).write.mode("overwrite").parquet(f"{folder}/bounds")


def files_of(spark: SparkSession, folder: str, size: int, cursor: Sequence | None) -> list[str]:
    """The files that a page of ``size`` + 1 rows after the cursor can be in: the cursor's, and those after it until their rows are enough."""
    bounds = spark.read.parquet(f"{folder}/bounds")
    if cursor is not None:
        bounds = bounds.where(below(("least_0", "least_1"), cursor)).withColumn("_whole", below(("most_0", "most_1"), cursor))
    else:
        bounds = bounds.withColumn("_whole", F.lit(True))
    # every file has a row, so no more than size + 2 are asked for
    near = bounds.orderBy(F.col("most_0").desc(), F.col("most_1").desc()).limit(size + 2).collect()
    found, left = [], size + 1
    for x in near:
        if left <= 0:
            break
        found.append(x.file)
        left -= x.rows if x["_whole"] else 0
    return found


def read_page(spark: SparkSession, folder: str, schema, size: int = 20, cursor: Sequence | None = None, by: Sequence[str] = ("createdAt", "id")) -> DataFrame:
    """What ``graph.keyset_page`` gives of the whole table."""
    files = files_of(spark, folder, size, cursor)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return keyset_page(rows, size, cursor, by)
