"""What the views list: deliveries, repositories, installations, and where a connect request leads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import strings as S
from ..schemas import DOMAINS

RECENT_DELIVERIES = 15


def recent_deliveries(ledger: DataFrame, full_name: str, limit: int = RECENT_DELIVERIES) -> DataFrame:
    """The latest deliveries for a repository, ties by id; a top-k, not a sort."""
    own = ledger.where(F.col("repositoryFullName") == full_name)
    return own.orderBy(F.col("createdAt").desc(), F.col("deliveryId").desc()).limit(limit)


def repositories_of(repositories: DataFrame, project_id) -> DataFrame:
    """A project's repositories that are not disconnected, newest first."""
    own = repositories.where((F.col("projectId") == project_id) & (F.col("connectionStatus") != "DISCONNECTED"))
    return own.orderBy(F.col("createdAt").desc(), F.col("id").desc())


def installations_of(installations: DataFrame, user_id) -> DataFrame:
    return installations.where(F.col("userId") == user_id).orderBy("accountLogin", "installationId")


def iso(at: Column) -> Column:
    """ISO 8601 in UTC with milliseconds, for a session in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def repository_view(repositories: DataFrame) -> DataFrame:
    """Rows as shown: wide ids as text, an unknown connection status as ACTIVE, times as ISO text."""
    shown = {c: F.col(c).cast("string") for c in ("installationId", "githubRepoId")}
    shown |= {c: iso(F.col(c)) for c in ("lastIndexedAt", "createdAt", "updatedAt") if c in repositories.columns}
    shown["connectionStatus"] = F.when(F.col("connectionStatus").isin(*DOMAINS["ConnectionStatus"]), F.col("connectionStatus")).otherwise("ACTIVE")
    return repositories.withColumns(shown)


def installation_view(installations: DataFrame) -> DataFrame:
    """Rows as shown; of a suspension only that there is one."""
    shown = {"installationId": F.col("installationId").cast("string"), "suspended": F.col("suspendedAt").isNotNull()}
    return installations.withColumns(shown).drop("suspendedAt", "userId")


def connect_targets(requests: DataFrame, installations: DataFrame, visible: DataFrame) -> DataFrame:
    """(requestId, installationId, owner, name, error) of (requestId, userId, repoUrl, githubRepoId).

    A request names either a URL, whose owner must be the account of one of the user's
    installations in any case of letters, or the id of a repository that one of them sees
    (visible: installationId, githubRepoId, owner, name).  The first installation by account wins.
    """
    one_url, one_id = F.col("repoUrl").isNotNull() & F.col("githubRepoId").isNull(), F.col("repoUrl").isNull() & F.col("githubRepoId").isNotNull()
    # only a URL that counts is parsed, and where it is invalid it has no owner
    asked = requests.withColumn("_url", F.when(one_url, S.parse_repository_url(F.col("repoUrl"))))
    asked = asked.withColumn("_error", F.when(~(one_url | one_id), "EXACTLY_ONE_TARGET").when(F.col("_url.error").isNotNull(), "INVALID_URL"))
    own = installations.select("userId", "installationId", "accountLogin")
    by_url = asked.where(one_url).select("requestId", "userId", F.lower("_url.owner").alias("_account"), F.col("_url.owner").alias("owner"), F.col("_url.name").alias("name"))
    # the first installation of each account and of each repository that a user sees, before requests meet them
    accounts = own.groupBy("userId", F.lower("accountLogin").alias("_account")).agg(F.min(F.struct("accountLogin", "installationId")).alias("_own"))
    by_url = by_url.join(accounts, ["userId", "_account"]).select("requestId", F.struct("_own.accountLogin", "_own.installationId", "owner", "name").alias("_hit"))
    seen = visible.select("installationId", "githubRepoId", "owner", "name").join(own, "installationId")
    seen = seen.groupBy("userId", "githubRepoId").agg(F.min(F.struct("accountLogin", "installationId", "owner", "name")).alias("_hit"))
    by_id = requests.where(one_id).select("requestId", "userId", "githubRepoId").join(seen, ["userId", "githubRepoId"]).select("requestId", "_hit")
    hits = by_url.unionByName(by_id).groupBy("requestId").agg(F.min("_hit").alias("_hit"))
    found = asked.select("requestId", "_error").join(hits, "requestId", "left")
    error = F.coalesce("_error", F.when(F.col("_hit").isNull(), "NO_ACCESS"))
    return found.select("requestId", "_hit.installationId", "_hit.owner", "_hit.name", error.alias("error"))


def free_slugs(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(key, slug): the wanted (key, userId, base) if the user has no such slug, else base-N with the next free N.

    Numbered slugs meet their base by an equi-join on what precedes the number.
    """
    number = F.regexp_extract("slug", r"-([0-9]{1,9})$", 1)
    whole = taken.select("userId", F.col("slug").alias("base"), F.lit(1).alias("_n"))
    numbered = taken.where(number != "").select("userId", F.regexp_replace("slug", r"-[0-9]{1,9}$", "").alias("base"), number.cast("int").alias("_n"))
    used = whole.withColumn("_same", F.lit(1)).unionByName(numbered.withColumn("_same", F.lit(0))).groupBy("userId", "base").agg(F.max("_n").alias("_n"), F.max("_same").alias("_same"))
    found = wanted.join(used, ["userId", "base"], "left")
    return found.select("key", F.when(F.col("_same") == 1, S.next_slug(F.col("base"), F.col("_n"))).otherwise(F.col("base")).alias("slug"))


def find_by(rows: DataFrame, columns: Sequence[str] | None = None, **values) -> DataFrame:
    """Rows with the given values, a null meeting nulls: a point lookup that reaches the scan as a filter."""
    for name, value in values.items():
        rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return rows if columns is None else rows.select(*columns)


def files_at_commit(files: DataFrame, repository_id: str, sha: str) -> DataFrame:
    """What the graph needs of a repository's files at a commit."""
    return find_by(files, ("id", "path", "indexState", "isTest"), repositoryId=repository_id, commitSha=sha)


def parse_eligible(files: DataFrame) -> DataFrame:
    """Indexed files that a grammar reads, with the grammar."""
    return files.where(F.col("indexState") == "INDEXED").withColumn("grammar", P.grammar(F.col("path"))).where(F.col("grammar").isNotNull())


def latency_percentiles(rows: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The nearest-rank percentiles of each group: the least value that reaches the share.

    Values are counted before they are ranked, so a task holds a group's distinct values at most.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(column))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    ranked = counts.select(*keys, column, upto.alias("_upto"), total.alias("_total"))
    at = lambda share: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_total") * F.lit(share)), F.col(column)))
    return ranked.groupBy(*keys).agg(*(at(s).alias(f"p{round(100 * s)}") for s in shares))
