"""The index of repositories: archive entries to files, symbols and edges, end to end."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import paths as P
from ..operators import graph, imports, inventory, resolve
from ..parsing.scanner import parse
from ..partitions import spread
from ..sources import manifests


class Index(NamedTuple):
    files: DataFrame
    symbols: DataFrame
    attempted: DataFrame  # edges before dedup
    edges: DataFrame


def parse_files(files: DataFrame) -> DataFrame:
    """Adds ``facts``: the parsed imports, exports and symbols of each indexed file with a grammar."""
    from pyspark.sql.types import StructType

    shape = StructType.fromDDL(schemas.PARSED_FILE)

    @F.pandas_udf(shape)
    def facts(text: pd.Series, grammar: pd.Series) -> pd.DataFrame:
        rows = [parse(t if isinstance(t, str) else None, g if isinstance(g, str) else None) for t, g in zip(text, grammar, strict=True)]
        return pd.DataFrame(rows, columns=shape.names)

    grammar = F.when(F.col("indexState") == "INDEXED", P.grammar(F.col("path")))
    return files.withColumn("facts", facts("text", grammar))


def _id(*parts) -> F.Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def build_index(entries: DataFrame, commit_sha: str, rules=None, strict_identity: bool = False, cut=lambda df, name: df) -> Index:
    """Files, symbols and edges of (repositoryId, path, size, content).

    Attribute rules are each repository's own unless ``rules`` gives some for all.  Ids are
    digests of what they name, so a repeated run gives the same rows.  ``cut`` may write a frame
    and read it back: parsing is then done once, and lineage ends there.
    """
    found = inventory.inventory(spread(entries), rules).withColumn("id", _id("repositoryId", "path"))
    # of the texts only those of manifests are needed once the files are parsed
    parsed = cut(parse_files(found).withColumn("text", F.when(manifests.is_manifest(F.col("path")), F.col("text"))), "parsed")
    context = cut(manifests.contexts(parsed), "context")
    placed = cut(imports.place_files(parsed.select("repositoryId", "path", "id"), context), "placed")

    raw = parsed.select("repositoryId", F.col("id").alias("fileId"), F.col("path").alias("filePath"), F.posexplode("facts.symbols").alias("ordinal", "s"))
    raw = raw.join(placed.select("repositoryId", F.col("path").alias("filePath"), "packageName"), ["repositoryId", "filePath"])
    named = raw.select("repositoryId", "fileId", "filePath", "packageName", "ordinal", _id("fileId", "s.name", "s.kind", F.col("s.startLine").cast("string"), F.col("ordinal").cast("string")).alias("id"), "s.*")
    last = named.groupBy("fileId", F.col("name").alias("parentSymbol")).agg(F.max_by("id", "ordinal").alias("parentSymbolId"))
    symbols = cut(named.join(last, ["fileId", "parentSymbol"], "left"), "symbols")

    imported = parsed.select("repositoryId", F.col("id").alias("fileId"), F.col("path").alias("filePath"), F.posexplode("facts.imports").alias("ordinal", "i")).select("repositoryId", "fileId", "filePath", "ordinal", "i.*")
    resolved = cut(imports.resolve_imports(imported, placed, context), "imports")
    once = resolved.groupBy("repositoryId", "fileId", "filePath", "specifier").agg(F.min_by(F.struct("ordinal", "status", "targetFilePath", "packageName", "version"), "ordinal").alias("r")).select("repositoryId", "fileId", "filePath", "specifier", "r.*")

    tests = P.test_signal(F.col("path"), F.col("facts.imports.specifier")).isNotNull()
    files = parsed.select(*(c for c in found.columns if c not in ("isTest", "text")), tests.alias("isTest"), F.col("facts.parseState").alias("parseState"), F.size("facts.symbols").alias("symbolCount"))
    per_package = context.where("kind = 'package'").groupBy("repositoryId").agg(F.bool_or("workspace").alias("perPackage"))

    site = ["repositoryId", "filePath", "packageName", F.col("id").alias("fromSymbolId")]
    sites = symbols.select(*site, "kind", "parentSymbol", "ordinal", F.posexplode("calls").alias("_nth", "c"))
    order = F.concat_ws("|", "repositoryId", "filePath", F.lpad(F.col("ordinal").cast("string"), 8, "0"), F.lpad(F.col("_nth").cast("string"), 8, "0"))
    sites = sites.select("repositoryId", "filePath", "packageName", "fromSymbolId", order.alias("siteId"), F.col("c.name").alias("name"), F.col("c.receiver").alias("receiver"), F.when(F.col("kind") == "METHOD", F.col("parentSymbol")).alias("callerClass"))
    parents = None
    for relation, column in (("EXTENDS", "extends"), ("IMPLEMENTS", "implements")):
        rows = symbols.select(*site, "ordinal", F.posexplode(column).alias("_nth", "name")).withColumn("relation", F.lit(relation))
        parents = rows if parents is None else parents.unionByName(rows)
    parents = parents.select("repositoryId", "filePath", "packageName", "fromSymbolId", F.concat_ws("|", order, "relation").alias("siteId"), "name", F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("callerClass"), "relation")
    # a heritage name is a type: a namespace import never brings it
    carry = ("repositoryId", "fromSymbolId", "relation")
    asked = resolve.asking(sites.withColumn("relation", F.lit(None).cast("string")), carry=carry).unionByName(resolve.asking(parents, "type", ("type",), carry))
    sort = F.when(F.col("kind").isin(*resolve.HERITAGE_KINDS), "type").when(F.col("kind") == "METHOD", "method").otherwise("bare")
    known = symbols.where(F.col("kind").isin(*resolve.CALLABLE_KINDS, *resolve.HERITAGE_KINDS)).withColumn("sort", sort)
    decided = cut(resolve.decide(asked, known, resolved, per_package).select("siteId", "toSymbolId", "rule", "confidence", "site.*"), "decided")
    calls, heritage = decided.where("relation IS NULL"), decided.where("relation IS NOT NULL")

    exports = parsed.select("repositoryId", F.col("id").alias("fileId"), F.col("path").alias("filePath"), F.posexplode("facts.exports").alias("ordinal", "e")).select("repositoryId", "fileId", "filePath", "ordinal", "e.*")
    attempted = resolve.build_edges(files, symbols, exports, once, calls, heritage)
    attempted = attempted.withColumn("id", _id(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*graph.IDENTITY, "externalPackage", "rawSpecifier")))).withColumn("commitSha", F.lit(commit_sha))
    attempted = cut(attempted, "attempted")
    edges = cut(graph.dedup_edges(attempted, ["ordinal", "id"], strict_identity), "edges")
    inbound = graph.inbound_edge_counts(edges, symbols)
    files = files.join(inbound.withColumnRenamed("fileId", "id"), "id", "left").withColumn("inboundEdgeCount", F.coalesce("inboundEdgeCount", F.lit(0)).cast("int")).withColumn("commitSha", F.lit(commit_sha))
    files = files.join(placed.select("id", "packageName"), "id", "left")
    return Index(files, symbols.withColumn("commitSha", F.lit(commit_sha)), attempted, edges)
