"""Queries over the knowledge graph: callers, importers, summaries, counts and pages.

Every query names its repository first; the filter reaches the scan as a partition or row
group predicate.  ``symbols``, ``files`` and ``edges`` have the columns of the stored tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALLER_KINDS = ("CALLS", "REFERENCES", "EXTENDS", "IMPLEMENTS")
IDENTITY = ("repositoryId", "kind", "fromFileId", "toFileId", "fromSymbolId", "toSymbolId")
UNRESOLVED_WARNING, UNRESOLVED_LEAST = 0.15, 20
HARD_IGNORE_WARNING, HARD_IGNORE_LEAST = 0.5, 100


def ratio(part: Column, total: Column) -> Column:
    """0 where the total is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def inbound_callers(edges: DataFrame, symbols: DataFrame, files: DataFrame, repository_id: str, symbol_ids: Sequence | DataFrame, limit: int = 50) -> DataFrame:
    """The symbols that call, extend or implement any of some symbols, most confident first.

    ``symbol_ids``: a list, or a frame with one column of ids for sets too long for a literal.
    Ties are ordered by edge id.
    """
    scoped = edges.where((F.col("repositoryId") == repository_id) & F.col("kind").isin(*CALLER_KINDS))
    if isinstance(symbol_ids, DataFrame):
        wanted = symbol_ids.select(F.col(symbol_ids.columns[0]).alias("toSymbolId")).distinct()
        scoped = scoped.join(wanted, "toSymbolId", "left_semi")
    else:
        scoped = scoped.where(F.col("toSymbolId").isin(*symbol_ids) if len(symbol_ids) else F.lit(False))
    callers = symbols.select(F.col("id").alias("fromSymbolId"), F.col("name").alias("symbolName"), "fileId")
    places = files.select(F.col("id").alias("fileId"), F.col("path").alias("filePath"))
    return (
        scoped.join(callers, "fromSymbolId").join(places, "fileId")
        .select(F.col("id").alias("dependencyId"), "kind", "fromSymbolId", "toSymbolId", "confidence", "symbolName", "filePath")
        .orderBy(F.col("confidence").desc(), "dependencyId").limit(limit)
    )


def importing_files(edges: DataFrame, repository_id: str, file_id, max_depth: int = 2) -> DataFrame:
    """(fileId, depth) of the files that import a file, directly or through others.

    Breadth first: each level joins the frontier with the import edges, and files met before
    are left out, so cycles end and nothing is enumerated by path.  The start itself is not
    counted as met: a cycle returns it with the cycle's length.  ``file_id`` may be a frame of
    (seed) ids; the result then has a column ``seed``.
    """
    many = isinstance(file_id, DataFrame)
    imports = edges.where((F.col("repositoryId") == repository_id) & (F.col("kind") == "IMPORTS") & F.col("toFileId").isNotNull() & F.col("fromFileId").isNotNull())
    imports = imports.select(F.col("fromFileId").alias("source"), F.col("toFileId").alias("target")).distinct()
    if many:
        frontier = file_id.select(F.col(file_id.columns[0]).alias("seed"), F.col(file_id.columns[0]).alias("target")).distinct()
    else:
        frontier = imports.sparkSession.range(1).select(F.lit(file_id).alias("seed"), F.lit(file_id).alias("target"))
    met = None
    for depth in range(1, max_depth + 1):
        level = imports.join(frontier, "target").select("seed", F.col("source").alias("fileId")).distinct()
        if met is not None:
            level = level.join(met.select("seed", "fileId"), ["seed", "fileId"], "left_anti")
        level = level.withColumn("depth", F.lit(depth))
        met = level if met is None else met.unionByName(level)
        frontier = level.select("seed", F.col("fileId").alias("target"))
    return met if many else met.drop("seed")


def resolution_counts(edges: DataFrame) -> DataFrame:
    """One row: edges and unresolved share of the imports of all repositories given."""
    counted = edges.agg(
        F.count("*").alias("edges"),
        *(F.count_if((F.col("kind") == "IMPORTS") & (F.col("resolution") == r)).alias(r.lower()) for r in ("RESOLVED", "EXTERNAL", "UNRESOLVED")),
    )
    return counted.withColumn("unresolvedImportRatio", ratio(F.col("unresolved"), F.col("resolved") + F.col("external") + F.col("unresolved")))


def top_files(files: DataFrame, limit: int = 10) -> DataFrame:
    return files.select("path", "inboundEdgeCount").orderBy(F.col("inboundEdgeCount").desc(), "path").limit(limit)


def top_unresolved(edges: DataFrame, limit: int = 20) -> DataFrame:
    counted = edges.where(F.col("resolution") == "UNRESOLVED").groupBy("rawSpecifier").agg(F.count("*").alias("count"))
    return counted.orderBy(F.col("count").desc(), F.col("rawSpecifier").asc_nulls_first()).limit(limit)


def knowledge_summary(files: DataFrame, symbols: DataFrame, edges: DataFrame, repository_id: str, top_n: int = 10) -> DataFrame:
    """One row: file, symbol and edge counts, unresolved ratio and the most used files."""
    own = [t.where(F.col("repositoryId") == repository_id) for t in (files, symbols, edges)]
    top = top_files(own[0], top_n).agg(F.collect_list(F.struct((-F.col("inboundEdgeCount")).alias("order"), "path")).alias("t"))
    top = top.select(F.transform(F.sort_array("t"), lambda x: F.struct(x.path.alias("path"), (-x.order).alias("inboundEdgeCount"))).alias("topFiles"))
    return (
        own[0].agg(F.count("*").alias("files"))
        .join(own[1].agg(F.count("*").alias("symbols")))  # single rows
        .join(resolution_counts(own[2]))
        .join(top)
    )


def parse_state_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("parseState").agg(F.count("*").alias("files"))


def edge_totals(edges: DataFrame) -> DataFrame:
    """Counts for each kind and resolution, each kind, and all: one pass by ROLLUP."""
    return edges.rollup("kind", "resolution").agg(F.count("*").alias("edges"))


def knowledge_aggregates(files: DataFrame, symbols: DataFrame, edges: DataFrame, repository_id: str, top_n: int = 10, top_specifiers: int = 20) -> DataFrame:
    """One row with all that the knowledge view shows."""
    own = edges.where(F.col("repositoryId") == repository_id)
    scoped = files.where(F.col("repositoryId") == repository_id)
    states = parse_state_counts(scoped).agg(F.map_from_entries(F.collect_list(F.struct("parseState", "files"))).alias("parseStates"))
    kinds = own.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("edgesByKind"))
    unresolved = top_unresolved(own, top_specifiers).agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("order"), "rawSpecifier"))).alias("u"))
    unresolved = unresolved.select(F.transform("u", lambda x: F.struct(x.rawSpecifier.alias("specifier"), (-x.order).alias("count"))).alias("topUnresolved"))
    return knowledge_summary(files, symbols, edges, repository_id, top_n).join(states).join(kinds).join(unresolved)


def inbound_edge_counts(edges: DataFrame, symbols: DataFrame, repository_id: str | None = None) -> DataFrame:
    """(fileId, inboundEdgeCount): edges to a file itself and to any of its symbols; no zero rows."""
    own = edges if repository_id is None else edges.where(F.col("repositoryId") == repository_id)
    direct = own.where(F.col("toFileId").isNotNull()).select(F.col("toFileId").alias("fileId"))
    by_symbol = own.where(F.col("toSymbolId").isNotNull()).groupBy(F.col("toSymbolId").alias("id")).agg(F.count("*").alias("n"))
    through = by_symbol.join(symbols.select("id", "fileId"), "id").groupBy("fileId").agg(F.sum("n").alias("n"))
    return direct.groupBy("fileId").agg(F.count("*").alias("n")).unionByName(through).groupBy("fileId").agg(F.sum("n").alias("inboundEdgeCount"))


def dedup_edges(edges: DataFrame, order: Sequence[Column | str], strict_identity: bool = False) -> DataFrame:
    """The first edge of each identity in a total order; nulls in an identity are equal.

    ``strict_identity`` adds externalPackage and rawSpecifier, which the default identity lacks.
    """
    keys = [*IDENTITY, *(("externalPackage", "rawSpecifier") if strict_identity else ())]
    ranked = edges.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def insert_edges(existing: DataFrame, new: DataFrame, order: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, their counts by kind and resolution); what is there already is skipped."""
    fresh = dedup_edges(new, order)
    known = existing.select(*(F.col(k).alias(f"_{k}") for k in IDENTITY))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in IDENTITY]
    fresh = fresh.join(known, same, "left_anti")
    return fresh, fresh.groupBy("kind", "resolution").agg(F.count("*").alias("inserted"))


def health_flags(hard_ignore_ratio: Column, paths: Column, unresolved_ratio: Column, imports: Column) -> Column:
    return F.struct(
        ((hard_ignore_ratio > HARD_IGNORE_WARNING) & (paths > HARD_IGNORE_LEAST)).alias("mostlyIgnored"),
        ((unresolved_ratio > UNRESOLVED_WARNING) & (imports > UNRESOLVED_LEAST)).alias("mostlyUnresolved"),
    )


def latest(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The last row of each key; partial aggregation, no window sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(*keys, "_r.*")


def index_status(repositories: DataFrame, jobs: DataFrame) -> DataFrame:
    """The latest job's state, else the repository's own."""
    last = latest(jobs.select("repositoryId", "createdAt", "id", "status", "progressPercent"), ["repositoryId"], ["createdAt", "id"])
    last = last.select("repositoryId", F.col("id").alias("jobId"), F.col("status").alias("jobStatus"), "progressPercent")
    return repositories.select(F.col("id").alias("repositoryId"), "indexStatus").join(last, "repositoryId", "left").select(
        "repositoryId", "jobId", F.coalesce("jobStatus", "indexStatus").alias("status"), F.coalesce("progressPercent", F.lit(0)).alias("progressPercent")
    )


def keyset_page(rows: DataFrame, size: int = 20, cursor: tuple | None = None, by: Sequence[str] = ("createdAt", "id")) -> DataFrame:
    """A page in descending order after the cursor's values, one row more than ``size`` if there is a next page."""
    if cursor is not None:
        first, second = (F.col(c) for c in by)
        rows = rows.where((first < F.lit(cursor[0])) | ((first == F.lit(cursor[0])) & (second < F.lit(cursor[1]))))
    return rows.orderBy(*(F.col(c).desc() for c in by)).limit(size + 1)


def search_repositories(rows: DataFrame, text: str, column: str = "fullName") -> DataFrame:
    return rows.where(F.contains(F.lower(column), F.lit(text.lower())))


def older_than(rows: DataFrame, column: str, now: Column, seconds: int) -> DataFrame:
    return rows.where(F.col(column) < now - F.make_dt_interval(secs=F.lit(float(seconds))))


def tenant_decision(repositories: DataFrame, projects: DataFrame, user_id: str, project_id: str) -> DataFrame:
    """repositoryId and the first reason that denies access, or OK."""
    joined = repositories.select(F.col("id").alias("repositoryId"), "projectId").join(
        projects.select(F.col("id").alias("projectId"), "userId", "deletedAt"), "projectId", "left"
    )
    decision = (
        F.when(F.col("userId").isNull(), "MISSING")
        .when(F.col("userId") != user_id, "FOREIGN")
        .when(F.col("projectId") != project_id, "MISMATCH")
        .when(F.col("deletedAt").isNotNull(), "DELETED")
        .otherwise("OK")
    )
    return joined.select("repositoryId", decision.alias("decision"))
