"""Schemas of the stored tables and of intermediate frames, and the domains of their enums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the stored tables and of a walked file.
User = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("githubUserId", T.LongType(), False),
    T.StructField("githubLogin", T.StringType(), False),
    T.StructField("email", T.StringType(), True),
    T.StructField("avatarUrl", T.StringType(), True),
    T.StructField("plan", T.StringType(), False),
    T.StructField("createdAt", T.TimestampType(), False),
    T.StructField("updatedAt", T.TimestampType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("image", T.StringType(), True),
    T.StructField("emailVerified", T.TimestampType(), True),
])

Project = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("userId", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("slug", T.StringType(), False),
    T.StructField("settings", T.StringType(), False),
    T.StructField("deletedAt", T.TimestampType(), True),
    T.StructField("createdAt", T.TimestampType(), False),
    T.StructField("updatedAt", T.TimestampType(), False),
])

GithubInstallation = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("installationId", T.LongType(), False),
    T.StructField("accountLogin", T.StringType(), False),
    T.StructField("accountType", T.StringType(), False),
    T.StructField("userId", T.StringType(), False),
    T.StructField("suspendedAt", T.TimestampType(), True),
    T.StructField("createdAt", T.TimestampType(), False),
    T.StructField("updatedAt", T.TimestampType(), False),
])

Repository = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("projectId", T.StringType(), False),
    T.StructField("installationId", T.LongType(), False),
    T.StructField("githubRepoId", T.LongType(), False),
    T.StructField("owner", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("fullName", T.StringType(), False),
    T.StructField("defaultBranch", T.StringType(), False),
    T.StructField("isPrivate", T.BooleanType(), False),
    T.StructField("htmlUrl", T.StringType(), False),
    T.StructField("sizeBytes", T.IntegerType(), True),
    T.StructField("webhookId", T.LongType(), True),
    T.StructField("connectionStatus", T.StringType(), False),
    T.StructField("indexStatus", T.StringType(), False),
    T.StructField("indexedCommitSha", T.StringType(), True),
    T.StructField("indexVersion", T.IntegerType(), False),
    T.StructField("indexedFileCount", T.IntegerType(), False),
    T.StructField("skippedFileCount", T.IntegerType(), False),
    T.StructField("reviewProfile", T.StringType(), True),
    T.StructField("lastIndexedAt", T.TimestampType(), True),
    T.StructField("indexError", T.StringType(), True),
    T.StructField("settings", T.StringType(), False),
    T.StructField("createdAt", T.TimestampType(), False),
    T.StructField("updatedAt", T.TimestampType(), False),
])

RepositoryFile = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("repositoryId", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("commitSha", T.StringType(), False),
    T.StructField("language", T.StringType(), True),
    T.StructField("contentHash", T.StringType(), False),
    T.StructField("sizeBytes", T.IntegerType(), False),
    T.StructField("lineCount", T.IntegerType(), False),
    T.StructField("packageName", T.StringType(), True),
    T.StructField("classification", T.StringType(), False),
    T.StructField("indexState", T.StringType(), False),
    T.StructField("skipReason", T.StringType(), True),
    T.StructField("parseState", T.StringType(), False),
    T.StructField("symbolCount", T.IntegerType(), False),
    T.StructField("inboundEdgeCount", T.IntegerType(), False),
    T.StructField("isTest", T.BooleanType(), False),
    T.StructField("isGenerated", T.BooleanType(), False),
    T.StructField("updatedAt", T.TimestampType(), False),
])

CodeSymbol = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("repositoryId", T.StringType(), False),
    T.StructField("fileId", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("startLine", T.IntegerType(), False),
    T.StructField("endLine", T.IntegerType(), False),
    T.StructField("isExported", T.BooleanType(), False),
    T.StructField("isDefault", T.BooleanType(), False),
    T.StructField("signature", T.StringType(), True),
    T.StructField("docComment", T.StringType(), True),
    T.StructField("parentSymbolId", T.StringType(), True),
    T.StructField("complexity", T.IntegerType(), False),
    T.StructField("commitSha", T.StringType(), False),
])

CodeDependency = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("repositoryId", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("fromFileId", T.StringType(), True),
    T.StructField("toFileId", T.StringType(), True),
    T.StructField("fromSymbolId", T.StringType(), True),
    T.StructField("toSymbolId", T.StringType(), True),
    T.StructField("externalPackage", T.StringType(), True),
    T.StructField("rawSpecifier", T.StringType(), True),
    T.StructField("resolution", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("commitSha", T.StringType(), False),
])

IndexJob = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("repositoryId", T.StringType(), False),
    T.StructField("mode", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("targetCommitSha", T.StringType(), True),
    T.StructField("previousCommitSha", T.StringType(), True),
    T.StructField("inngestRunId", T.StringType(), True),
    T.StructField("filesTotal", T.IntegerType(), False),
    T.StructField("filesProcessed", T.IntegerType(), False),
    T.StructField("filesSkipped", T.IntegerType(), False),
    T.StructField("symbolsCreated", T.IntegerType(), False),
    T.StructField("edgesCreated", T.IntegerType(), False),
    T.StructField("chunksEmbedded", T.IntegerType(), False),
    T.StructField("embeddingCacheHits", T.IntegerType(), False),
    T.StructField("currentStep", T.StringType(), True),
    T.StructField("progressPercent", T.IntegerType(), False),
    T.StructField("startedAt", T.TimestampType(), True),
    T.StructField("completedAt", T.TimestampType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("attempts", T.IntegerType(), False),
    T.StructField("createdAt", T.TimestampType(), False),
])

WebhookEvent = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("deliveryId", T.StringType(), False),
    T.StructField("eventType", T.StringType(), False),
    T.StructField("action", T.StringType(), True),
    T.StructField("installationId", T.LongType(), True),
    T.StructField("repositoryFullName", T.StringType(), True),
    T.StructField("payloadRef", T.StringType(), True),
    T.StructField("dispatchPayload", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("dispatchedAt", T.TimestampType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("createdAt", T.TimestampType(), False),
])

PullRequest = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("repositoryId", T.StringType(), False),
    T.StructField("number", T.IntegerType(), False),
    T.StructField("githubPrId", T.LongType(), False),
    T.StructField("headSha", T.StringType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("isDraft", T.BooleanType(), False),
    T.StructField("createdAt", T.TimestampType(), False),
    T.StructField("updatedAt", T.TimestampType(), False),
])

WalkedFile = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("contentHash", T.StringType(), False),
    T.StructField("sizeBytes", T.IntegerType(), False),
    T.StructField("lineCount", T.IntegerType(), False),
    T.StructField("packageName", T.StringType(), True),
    T.StructField("classification", T.StringType(), False),
    T.StructField("language", T.StringType(), True),
    T.StructField("indexState", T.StringType(), False),
    T.StructField("skipReason", T.StringType(), True),
    T.StructField("isTest", T.BooleanType(), False),
    T.StructField("isGenerated", T.BooleanType(), False),
])

#: DDL of the parse result; StructType.fromDDL needs a running session.
PARSED_FILE = (
    "imports array<struct<specifier:string, named:array<string>, default:string, namespace:string, line:int, isTypeOnly:boolean, syntax:string>>, "
    "exports array<struct<name:string, isDefault:boolean, line:int, reExportFrom:string>>, "
    "symbols array<struct<name:string, kind:string, startLine:int, endLine:int, isExported:boolean, isDefault:boolean, signature:string, docComment:string, parentSymbol:string, "
    "complexity:int, calls:array<struct<name:string, receiver:string, line:int>>, extends:array<string>, implements:array<string>>>, "
    "parseErrors int, parseState string"
)

#: The members of each enum and pinned union.
DOMAINS: dict[str, tuple[str, ...]] = {
    "FileClassification": ("SOURCE", "TEST", "CONFIG", "DOCUMENTATION", "GENERATED", "ASSET", "DEPENDENCY_LOCK", "UNKNOWN"),
    "DependencyKind": ("IMPORTS", "EXPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "REFERENCES", "CONTAINS", "TESTS"),
    "DependencyResolution": ("RESOLVED", "EXTERNAL", "UNRESOLVED"),
    "IndexStatus": ("PENDING", "INDEXING", "INDEXED", "UPDATING", "FAILED", "PARTIAL"),
    "IndexState": ("INDEXED", "SKIPPED", "FAILED"),
    "ParseState": ("OK", "FAILED", "NOT_PARSED"),
    "SkipReason": ("SKIPPED_HARD_IGNORE", "SKIPPED_GENERATED", "SKIPPED_VENDORED", "SKIPPED_TOO_LARGE", "SKIPPED_BINARY", "SKIPPED_MINIFIED"),
    "IndexJobStatus": ("PENDING", "RUNNING", "SUCCEEDED", "FAILED"),
    "IndexJobMode": ("FULL", "INCREMENTAL"),
    "SymbolKind": ("FUNCTION", "ARROW_FUNCTION", "CLASS", "METHOD", "INTERFACE", "TYPE_ALIAS", "ENUM", "REACT_COMPONENT", "HOOK", "VARIABLE"),
    "WebhookEventStatus": ("PENDING", "DISPATCHED", "IGNORED", "FAILED"),
    "PullRequestState": ("open", "closed"),
    "ConnectionStatus": ("ACTIVE", "ACCESS_LOST", "DISCONNECTED"),
}


def in_domain(column: Column | str, domain: str) -> Column:
    """Whether a value is one of a domain's; null is not."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).isin(*DOMAINS[domain]), F.lit(False))
