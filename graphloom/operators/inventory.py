"""From archive entries to the file inventory and its summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .graph import ratio


ATTRIBUTES = ".gitattributes"


def with_rules(entries: DataFrame) -> DataFrame:
    """Adds _rules, the attribute rules of each repository's root file; a repository has one row of them."""
    own = entries.where((F.col("path") == ATTRIBUTES) & F.col("content").isNotNull())
    rules = own.groupBy("repositoryId").agg(F.max(F.decode("content", "UTF-8")).alias("_text")).select("repositoryId", P.attribute_rules("_text").alias("_rules"))
    return entries.join(rules, "repositoryId", "left").withColumn("_rules", F.coalesce("_rules", F.array().cast(P.RULES)))


def inventory(entries: DataFrame, rules: Sequence[P.AttributeRule] | None = None) -> DataFrame:
    """One row a path that is not hard-ignored of (repositoryId, path, size, content).

    Attribute rules come from each repository's own root file, or are ``rules`` for all.  Tests run in the order path, attributes, size, binary, minified; content is looked at only
    where the earlier ones let it pass.  A null content is a file that could not be read.
    """
    path, text = F.col("path"), F.decode("content", "UTF-8")
    rows = entries.where(~P.is_hard_ignored(path))
    if rules is None:
        rows = with_rules(rows)
    rows = rows.withColumn("_decision", P.ignore_decision(path, F.col("_rules") if rules is None else rules))
    unread = F.col("content").isNull()
    reason = F.when(F.col("_decision") != "KEEP", F.col("_decision")).when(~unread, P.content_skip_reason(F.col("size"), F.col("content"), F.decode("content", "UTF-8")))
    rows = rows.withColumn("skipReason", reason)
    kept = F.col("skipReason").isNull()
    return rows.select(
        "repositoryId", "path", P.content_hash(F.coalesce("content", F.lit(b""))).alias("contentHash"), F.col("size").cast("int").alias("sizeBytes"),
        F.when(kept & ~unread, P.line_count(text)).otherwise(0).alias("lineCount"), P.classification(path).alias("classification"), P.language(path).alias("language"),
        F.when(unread, "FAILED").when(kept, "INDEXED").otherwise("SKIPPED").alias("indexState"), "skipReason",
        P.is_test(path).alias("isTest"), P.is_generated(path).alias("isGenerated"), F.when(kept & ~unread, text).alias("text"),
    )


def summary(entries: DataFrame, files: DataFrame) -> DataFrame:
    """One row a repository: paths, hard-ignored share, bucket counts; processed + skipped = total."""
    walked = entries.groupBy("repositoryId").agg(F.count("*").alias("pathsConsidered"), F.count_if(P.is_hard_ignored(F.col("path"))).alias("hardIgnored"))
    counted = files.groupBy("repositoryId").agg(
        F.count("*").alias("filesTotal"), F.count_if(F.col("indexState").isin("INDEXED", "FAILED")).alias("filesProcessed"), F.count_if(F.col("indexState") == "SKIPPED").alias("filesSkipped")
    )
    return walked.join(counted, "repositoryId", "left").withColumn("hardIgnoreRatio", ratio(F.col("hardIgnored"), F.col("pathsConsidered"))).fillna(0)


def skip_reasons(files: DataFrame) -> DataFrame:
    return files.where(F.col("skipReason").isNotNull()).groupBy("repositoryId", "skipReason").agg(F.count("*").alias("files"))
