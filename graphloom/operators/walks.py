"""Long walks over import edges: a frontier that is written, and visited sets as bitmaps.

Files get numbers without gaps, so what a seed has visited is one bitmap for each shard of
numbers.  A round plans a few levels, keeps what its seeds had not visited, writes it, and
goes on from the last level; a plan is as large at depth 400 as at depth 4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096  # of the numbering
LEVELS, FEW = 8, 10_000  # levels in a round while the frontier has at most FEW rows; one beyond


def numbered(nodes: DataFrame) -> DataFrame:
    """(node, number) of distinct nodes, numbers from 0 without gaps; no task gets more than a bucket."""
    own = nodes.distinct().withColumn("_bucket", F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).cast("int"))
    sizes = own.groupBy("_bucket").agg(F.count("*").alias("_n"))
    first = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_first"))  # BUCKETS rows
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("node")) - 1
    return own.withColumn("_nth", nth).join(first, "_bucket").select("node", (F.col("_first") + F.col("_nth")).alias("number"))


def _holds(bits: Column, number: Column) -> Column:
    at = F.call_function("bitmap_bit_position", number)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.call_function("getbit", byte, (at % 8).cast("int")) == 1


def _bitmaps(rows: DataFrame) -> DataFrame:
    """(seed, shard, bits) of (seed, number)."""
    keyed = rows.select("seed", F.call_function("bitmap_bucket_number", "number").alias("shard"), F.call_function("bitmap_bit_position", F.col("number")).alias("at"))
    return keyed.groupBy("seed", "shard").agg(F.call_function("bitmap_construct_agg", F.col("at")).alias("bits"))


def walk_importers(edges: DataFrame, repository_id: str, seeds: DataFrame, max_depth: int, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(seed, fileId, depth) of the files that import a seed, directly or through others, by the fewest steps.

    As ``graph.importing_files``: a cycle returns its seed with the cycle's length.  ``cut`` writes a
    frame and reads it back; it is called twice a round, and rounds end with an empty frontier.
    """
    own = edges.where((F.col("repositoryId") == repository_id) & (F.col("kind") == "IMPORTS") & F.col("toFileId").isNotNull() & F.col("fromFileId").isNotNull())
    pairs = own.select(F.col("fromFileId").alias("source"), F.col("toFileId").alias("target")).distinct()
    start = seeds.select(F.col(seeds.columns[0]).alias("node")).where("node IS NOT NULL")
    numbers = cut(numbered(pairs.select(F.col("source").alias("node")).unionByName(pairs.select(F.col("target").alias("node"))).unionByName(start)), "numbers")
    by = lambda rows, column, name: rows.join(numbers.select(F.col("node").alias(column), F.col("number").alias(name)), column).drop(column)
    imports = cut(by(by(pairs, "source", "importer"), "target", "number"), "imports")
    frontier = cut(start.distinct().join(numbers, "node").select(F.col("number").alias("seed"), "number"), "frontier")
    visited, met, depth, size = None, None, 0, frontier.count()
    while size and depth < max_depth:
        levels = min(LEVELS if size <= FEW else 1, max_depth - depth)
        level, found = frontier, None
        for k in range(1, levels + 1):
            # dealt by number, so neither the distinct nor the next join moves rows again
            level = level.join(imports, "number").select("seed", F.col("importer").alias("number")).repartition("number").distinct()
            here = level.withColumn("depth", F.lit(depth + k))
            found = here if found is None else found.unionByName(here)
        found = found.groupBy("seed", "number").agg(F.min("depth").alias("depth"))
        if visited is not None:
            known = found.withColumn("shard", F.call_function("bitmap_bucket_number", "number")).join(visited, ["seed", "shard"], "left")
            found = known.where(F.col("bits").isNull() | ~_holds(F.col("bits"), F.col("number"))).select("seed", "number", "depth")
        found = cut(found, "level")
        met = found if met is None else met.unionByName(found)
        depth += levels
        frontier = found.where(F.col("depth") == depth).select("seed", "number")
        size = frontier.count()
        if size and depth < max_depth:
            fresh = _bitmaps(found)
            if visited is not None:
                fresh = visited.unionByName(fresh).groupBy("seed", "shard").agg(F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))
            visited = cut(fresh, "visited")
    if met is None:
        met = frontier.withColumn("depth", F.lit(0)).limit(0)
    named = lambda rows, number, name: rows.join(numbers.select(F.col("number").alias(number), F.col("node").alias(name)), number).drop(number)
    out = named(met.withColumnsRenamed({"seed": "_seed", "number": "_file"}), "_seed", "seed")
    return named(out, "_file", "fileId").select("seed", "fileId", "depth")
