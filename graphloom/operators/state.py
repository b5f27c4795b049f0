"""Mutations of the state tables as snapshot rewrites.

Plain Parquet has no MERGE: each operator returns the next snapshot of a table (and the count
of affected rows where the caller needs it); ``overwrite_partitions`` publishes it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_COLUMNS = ("commitSha", "language", "contentHash", "sizeBytes", "lineCount", "packageName", "classification", "indexState", "skipReason", "isTest", "isGenerated", "updatedAt")
PULL_REQUEST_COLUMNS = ("githubPrId", "headSha", "state", "isDraft")
INSTALLATION_COLUMNS = ("accountLogin", "accountType", "userId", "suspendedAt")
LOCKABLE = ("PENDING", "FAILED", "INDEXED")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Insert or update by key: ``update`` columns are taken from the change, all others stay as they are."""
    found = changes.withColumn("_new", F.lit(True)).select(*(F.col(c).alias(f"_n_{c}") for c in changes.columns), "_new")
    had = current.withColumn("_old", F.lit(True))
    joined = had.join(found, [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys], "full_outer")

    def pick(c: str) -> Column:
        if c not in changes.columns:
            return F.col(c)
        new = F.col(f"_n_{c}")
        if c in update:
            return F.when(F.col("_new"), new).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_old"), F.col(c)).otherwise(new).alias(c)

    return joined.select(*(pick(c) for c in current.columns))


def upsert_files(current: DataFrame, files: DataFrame) -> DataFrame:
    """By (repositoryId, path); ids, parse state and graph counts of known files stay."""
    return upsert(current, files, ["repositoryId", "path"], FILE_COLUMNS)


def upsert_pull_requests(current: DataFrame, changes: DataFrame) -> DataFrame:
    """By (repositoryId, number); ``changes`` has one row a key, the latest."""
    return upsert(current, changes, ["repositoryId", "number"], PULL_REQUEST_COLUMNS)


def upsert_installations(current: DataFrame, changes: DataFrame) -> DataFrame:
    """By installationId; the row goes to the user who synced it last."""
    return upsert(current, changes, ["installationId"], INSTALLATION_COLUMNS)


def update_installations(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, changes without a row); never creates, never moves a row to another user."""
    return update_if_exists(current, changes, ["installationId"], [c for c in INSTALLATION_COLUMNS if c != "userId"])


def set_suspended(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The suspension time alone, null to lift it."""
    return update_from(current, changes, "installationId", ["suspendedAt"])


def sweep_stale_files(files: DataFrame, repository_id: str, sha: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the count of dropped rows)."""
    stale = (F.col("repositoryId") == repository_id) & (F.col("commitSha") != sha)
    return files.where(~stale), files.agg(F.count_if(stale).alias("swept"))


def delete_repository_rows(rows: DataFrame, repository_id: str) -> tuple[DataFrame, DataFrame]:
    own = F.col("repositoryId") == repository_id
    return rows.where(~own), rows.agg(F.count_if(own).alias("deleted"))


def update_from(current: DataFrame, values: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM (VALUES ...): rows without a match stay."""
    found = values.select(F.col(key), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_n_{c}") for c in columns))
    joined = current.join(found, key, "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


def guarded_update(rows: DataFrame, guard: Column, values: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Set columns where the guard holds; one row with the count of affected rows."""
    changed = rows.withColumns({c: F.when(guard, v).otherwise(F.col(c)) for c, v in values.items()})
    return changed, rows.agg(F.count_if(guard).alias("affected"))


def disconnect(repositories: DataFrame, guard: Column) -> tuple[DataFrame, DataFrame]:
    return guarded_update(repositories, guard & (F.col("connectionStatus") != "DISCONNECTED"), {"connectionStatus": F.lit("DISCONNECTED")})


def access_lost(repositories: DataFrame, guard: Column) -> tuple[DataFrame, DataFrame]:
    return guarded_update(repositories, guard & (F.col("connectionStatus") == "ACTIVE"), {"connectionStatus": F.lit("ACCESS_LOST")})


def restore_access(repositories: DataFrame, guard: Column) -> tuple[DataFrame, DataFrame]:
    return guarded_update(repositories, guard & (F.col("connectionStatus") == "ACCESS_LOST"), {"connectionStatus": F.lit("ACTIVE")})


def can_lock(status: Column) -> Column:
    """Whether an index run may start; the compare-and-set itself belongs to the state store."""
    return status.isin(*LOCKABLE)


def acquire_lock(repositories: DataFrame, guard: Column) -> tuple[DataFrame, DataFrame]:
    """(next snapshot with the lockable of some repositories INDEXING, one row with how many were).

    Nothing was affected where another run holds the lock.  Two writers of one snapshot are kept
    apart by the store that publishes it, not here.
    """
    return guarded_update(repositories, guard & can_lock(F.col("indexStatus")), {"indexStatus": F.lit("INDEXING")})


def mark_indexed(repositories: DataFrame, repository_id: str, sha: str, now: Column) -> DataFrame:
    own = F.col("id") == repository_id
    values = {"indexStatus": F.lit("INDEXED"), "indexedCommitSha": F.lit(sha), "lastIndexedAt": now, "indexError": F.lit(None).cast("string")}
    return guarded_update(repositories, own, values)[0]


def mark_failed(repositories: DataFrame, repository_id: str, code: str, message: str) -> DataFrame:
    error = F.to_json(F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))
    return guarded_update(repositories, F.col("id") == repository_id, {"indexStatus": F.lit("FAILED"), "indexError": error})[0]


def soft_delete(projects: DataFrame, user_id: str, project_id: str, now: Column) -> tuple[DataFrame, DataFrame]:
    guard = (F.col("id") == project_id) & (F.col("userId") == user_id) & F.col("deletedAt").isNull()
    return guarded_update(projects, guard, {"deletedAt": now})


def insert_unique(current: DataFrame, new: DataFrame, keys: Sequence[str], conflict: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows refused with the conflict's name)."""
    known = current.select(*keys).distinct()
    return new.join(known, list(keys), "left_anti"), new.join(known, list(keys), "left_semi").withColumn("conflict", F.lit(conflict))


def insert_symbols(current: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, one row with the count of inserted symbols); ids that are there already are left alone."""
    fresh = symbols.dropDuplicates(["id"]).join(current.select("id"), "id", "left_anti").select(*current.columns)
    return current.unionByName(fresh), fresh.agg(F.count("*").alias("inserted"))


def update_if_exists(current: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, changes without a row as NOT_FOUND)."""
    known = changes.join(current.select(*keys), list(keys), "left_semi")
    missing = changes.join(current.select(*keys), list(keys), "left_anti").withColumn("result", F.lit("NOT_FOUND"))
    return upsert(current, known, keys, update), missing


def overwrite_partitions(rows: DataFrame, path: str, partition: str = "repositoryId") -> None:
    """Replace only the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
