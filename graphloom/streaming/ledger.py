"""The webhook ledger: admission, rate limit, dedup, fan-out, routing, sweeping.

All steps are batch transformations; ``ingest_stream`` runs them for each micro-batch of a
stream.  What it appends are Parquet folders with one part a batch (``part=<batch>``), and what it
looks up are keyed tables of segments by batch: a batch reads what earlier batches left and
replaces its own, so one that failed between two writes, or is repeated, leaves what a single
run leaves.
"""

from __future__ import annotations

import hashlib
import hmac
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import strings as S
from ..operators.keyed import KeyedTable
from ..sources.versions import Folder

MAX_BODY_BYTES = 5 * 1024 * 1024
INSTALLATION_LIMIT, INSTALLATION_WINDOW = 100, 60
REPOSITORY_LIMIT, REPOSITORY_WINDOW = 10, 3600
PENDING_AGE, PENDING_BATCH, STALE_INDEX_AGE = 60, 50, 15 * 60

#: Allowed events and how their actions are handled.
EVENT_MATRIX = {
    "pull_request": {"dispatch": ("opened", "reopened", "synchronize", "ready_for_review"), "stateSync": ("closed", "converted_to_draft"), "metadataOnly": ("edited",)},
    "installation": {"sync": ("created", "deleted", "suspend", "unsuspend")},
    "installation_repositories": {"sync": ("added", "removed")},
    "repository": {"sync": ("renamed", "deleted", "archived", "unarchived")},
    "push": {},
    "ping": {},
}

#: The effect and reason of each synchronising action.
SYNC_EFFECTS = (
    ("installation", "created", "UPDATE_IF_EXISTS", "INSTALLATION_CREATED_UPDATED"),
    ("installation", "deleted", "ACCESS_LOST", "INSTALLATION_DELETED"),
    ("installation", "suspend", "ACCESS_LOST", "INSTALLATION_SUSPENDED"),
    ("installation", "unsuspend", "RESTORE", "INSTALLATION_UNSUSPENDED"),
    ("installation_repositories", "added", "NONE", "INSTALLATION_REPOSITORIES_ADDED"),
    ("installation_repositories", "removed", "ACCESS_LOST", "INSTALLATION_REPOSITORIES_REMOVED"),
    ("repository", "renamed", "RENAME", "REPOSITORY_RENAMED"),
    ("repository", "deleted", "ACCESS_LOST", "REPOSITORY_DELETED"),
    ("repository", "archived", "ACCESS_LOST", "REPOSITORY_ARCHIVED"),
    ("repository", "unarchived", "RESTORE", "REPOSITORY_UNARCHIVED"),
)

#: The members that each event's payload must have, by name and JSON type.
EVENT_FIELDS = {
    "pull_request": (
        ("$.action", "string"), ("$.number", "number"), ("$.pull_request.id", "number"), ("$.pull_request.number", "number"), ("$.pull_request.draft", "boolean"), ("$.pull_request.state", "string"),
        ("$.pull_request.head.sha", "string"), ("$.pull_request.base.sha", "string"), ("$.installation.id", "number"), ("$.repository.id", "number"), ("$.repository.full_name", "string"),
        ("$.repository.name", "string"), ("$.repository.owner.login", "string"), ("$.repository.html_url", "string"),
    ),
    "installation": (("$.action", "string"), ("$.installation.id", "number"), ("$.installation.account.login", "string"), ("$.installation.account.type", "string")),
    "installation_repositories": (("$.action", "string"), ("$.installation.id", "number")),
    "repository": (
        ("$.action", "string"), ("$.repository.id", "number"), ("$.repository.full_name", "string"), ("$.repository.name", "string"), ("$.repository.owner.login", "string"), ("$.repository.html_url", "string"),
    ),
    "ping": (),
}

PULL_REQUEST = (
    "action string, number bigint, pull_request struct<id:bigint, number:bigint, state:string, draft:boolean, head:struct<sha:string>, base:struct<sha:string>>, "
    "repository struct<id:bigint, full_name:string, name:string, owner:struct<login:string>, html_url:string>, installation struct<id:bigint>"
)


def verify_signature(secret: str):
    """A function of (body, header) columns: OK, MISSING_SIGNATURE, MALFORMED_SIGNATURE or MISMATCH.

    Spark has no HMAC; bodies go through Arrow in batches.
    """

    @F.pandas_udf(T.StringType())
    def verify(body: pd.Series, header: pd.Series) -> pd.Series:
        out = []
        for raw, given in zip(body, header, strict=True):
            if not given:
                out.append("MISSING_SIGNATURE")
                continue
            want = "sha256=" + hmac.new(secret.encode(), bytes(raw or b""), hashlib.sha256).hexdigest()
            if not given.startswith("sha256=") or len(given.encode()) != len(want):
                out.append("MALFORMED_SIGNATURE")
            else:
                out.append("OK" if hmac.compare_digest(want.encode(), given.encode()) else "MISMATCH")
        return pd.Series(out)

    return verify


def action_group(event: Column, action: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, groups in EVENT_MATRIX.items():
        for group, actions in groups.items():
            found = F.when((event == name) & action.isin(*actions), F.lit(group)).otherwise(found)
    return found


def bucket_of(ts: str, seconds: int) -> Column:
    """The number of the epoch-aligned window."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000) / seconds).cast("long")


def installation_of(payload: Column) -> Column:
    return S.typed_json(payload, "$.installation.id", "bigint")


def fixed_window(rows: DataFrame, keys: list[str], ts: str, order: list[str], seconds: int, limit: int, counted: DataFrame | None = None) -> DataFrame:
    """Adds bucket, nth, allowed and retryAfter: the first ``limit`` rows of a key in each epoch-aligned window pass.

    Ranks are per (key, window): a busy key is dealt over as many tasks as it has windows.
    ``counted``: (keys, bucket, n) of rows that came before, null keys being equal.
    """
    epoch = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000)
    rows = rows.withColumn("bucket", bucket_of(ts, seconds))
    nth = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(ts, *order))
    rows = rows.withColumn("nth", nth.cast("long"))
    if counted is not None:
        before = counted.select(*(F.col(k).alias(f"_{k}") for k in (*keys, "bucket")), F.col("n").alias("_n"))
        joined = rows.join(before, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "bucket")], "left")
        rows = joined.withColumn("nth", F.col("nth") + F.coalesce("_n", F.lit(0))).select(*rows.columns)
    rows = rows.withColumn("allowed", F.col("nth") <= limit)
    left = (F.col("bucket") + 1) * seconds - F.floor(epoch)
    return rows.withColumn("retryAfter", F.when(F.col("allowed"), F.lit(0)).otherwise(left).cast("long"))


def admit(deliveries: DataFrame, secret: str, counted: DataFrame | None = None) -> DataFrame:
    """Adds outcome and reason to (deliveryId, eventType, signature, body, receivedAt).

    The order of the tests is headers, size, signature, allow-list, ping, JSON, rate limit; what
    passes is SYNC or DISPATCH.  ``counted``: (installationId, bucket, n) of deliveries that
    were counted before.  Only rows that pass all other tests meet in the windows of the rate limit.
    """
    rows = deliveries.withColumn("reason", verify_signature(secret)("body", "signature")).withColumn("payload", F.decode("body", "UTF-8"))
    parsed = F.try_parse_json("payload")
    rows = rows.withColumns({
        "installationId": installation_of(F.col("payload")),
        "repositoryFullName": S.typed_json(F.col("payload"), "$.repository.full_name", "string"),
        "action": S.typed_json(F.col("payload"), "$.action", "string"),
    })
    early = (
        F.when(F.coalesce(F.col("deliveryId"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("eventType"), F.lit("")).eqNullSafe(""), "MISSING_HEADERS")
        .when(F.octet_length("body") > MAX_BODY_BYTES, "PAYLOAD_TOO_LARGE")
        .when(F.col("reason") != "OK", "SIGNATURE_REJECTED")
        .when(~F.col("eventType").isin(*EVENT_MATRIX), "UNKNOWN_EVENT")
        .when(F.col("eventType") == "ping", "PING")
        .when(parsed.isNull(), "INVALID_JSON")
    )
    rows = rows.withColumn("outcome", early)
    limited = fixed_window(rows.where("outcome IS NULL"), ["installationId"], "receivedAt", ["deliveryId"], INSTALLATION_WINDOW, INSTALLATION_LIMIT, counted)
    sync = F.col("eventType").isin("installation", "installation_repositories", "repository")
    limited = limited.withColumn("outcome", F.when(~F.col("allowed"), "RATE_LIMITED").when(sync, "SYNC").otherwise("DISPATCH")).drop("nth", "allowed")
    rejected = rows.where("outcome IS NOT NULL").withColumns({"bucket": F.lit(None).cast("long"), "retryAfter": F.lit(0).cast("long")})
    return limited.unionByName(rejected)


def new_deliveries(deliveries: DataFrame, ledger: DataFrame | None, order: list[str]) -> DataFrame:
    """The first row of each deliveryId that the ledger does not have: an exact, unbounded dedup."""
    first = deliveries.withColumn("_nth", F.row_number().over(Window.partitionBy("deliveryId").orderBy(*order))).where("_nth = 1").drop("_nth")
    return first if ledger is None else first.join(ledger.select("deliveryId"), "deliveryId", "left_anti")


def tenants(repositories: DataFrame, projects: DataFrame) -> DataFrame:
    """Connected repositories of projects that are not deleted."""
    open_projects = projects.where(F.col("deletedAt").isNull()).select(F.col("id").alias("projectId"), F.col("settings").alias("projectSettings"))
    connected = repositories.where(F.col("connectionStatus") != "DISCONNECTED").select(F.col("id").alias("repositoryId"), "projectId", "installationId", "githubRepoId")
    return connected.join(open_projects, "projectId")


def is_valid(event: str, payload: Column) -> Column:
    """Whether a payload has the members that its event needs, with their types."""
    value = F.try_parse_json(payload)
    tags = {"string": ["STRING"], "boolean": ["BOOLEAN"], "number": ["BIGINT", "DOUBLE", "FLOAT"]}
    valid = F.schema_of_variant(value).startswith("OBJECT")
    for path, kind in EVENT_FIELDS[event]:
        found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        good = found.isin(*tags[kind])
        valid &= F.coalesce(good | found.startswith("DECIMAL") if kind == "number" else good, F.lit(False))
    if event == "pull_request":
        valid &= F.coalesce(F.try_variant_get(value, "$.pull_request.state", "string").isin("open", "closed"), F.lit(False))
    return F.coalesce(valid, F.lit(False))


def _triggers(action: Column) -> Column:
    return F.coalesce(action.isin(*EVENT_MATRIX["pull_request"]["dispatch"]), F.lit(False))


def _ready(action: Column, pr: Column) -> Column:
    """Whether tenants that do not review drafts review it."""
    return F.coalesce((action == "ready_for_review") | ~pr.draft, F.lit(False))


def _verdict(events: Column, upserts: Column) -> tuple[Column, Column, Column]:
    """(decision, reason, status) of rows of valid and action, by the numbers of their events and upserts."""
    a = F.col("action")
    reason = (
        F.when(~F.col("valid"), "MALFORMED_PAYLOAD")
        .when(upserts == 0, "NO_CONNECTED_REPOSITORY")
        .when(a.isin(*EVENT_MATRIX["pull_request"]["metadataOnly"]), "EDITED_METADATA_ONLY")
        .when(~a.isin(*EVENT_MATRIX["pull_request"]["dispatch"]), "ACTION_NOT_TRIGGERING")
        .when(events == 0, "DRAFT_SKIPPED")
    )
    decision = F.when(reason == "MALFORMED_PAYLOAD", "FAIL").when(reason == "NO_CONNECTED_REPOSITORY", "IGNORE").when(reason.isNotNull(), "PERSIST_ONLY").otherwise("DISPATCH")
    return decision, reason, F.when(decision == "FAIL", "FAILED").when(decision == "DISPATCH", "PENDING").otherwise("IGNORED")


def route_pull_requests(deliveries: DataFrame, targets: DataFrame) -> DataFrame:
    """(deliveryId, decision, reason, status, events, upserts) of pull-request deliveries with a ``payload``.

    Targets are gathered by GitHub repository before they meet the deliveries, so a delivery
    stays one row; a repository's tenants are few beside its deliveries.  Where only their
    numbers are asked for, ``count_routes`` makes no lists.
    """
    rows = deliveries.withColumn("p", F.from_json("payload", PULL_REQUEST)).withColumn("valid", is_valid("pull_request", F.col("payload")))
    tenant = F.struct("repositoryId", "projectId", "installationId", S.review_drafts(F.col("projectSettings")).alias("drafts"))
    grouped = targets.groupBy(F.col("githubRepoId").alias("_repo")).agg(F.sort_array(F.collect_list(tenant)).alias("_tenants"))
    rows = rows.join(grouped, F.col("p.repository.id") == F.col("_repo"), "left")
    pr, action = F.col("p.pull_request"), F.col("p.action")
    triggers, ready = _triggers(action), _ready(action, pr)
    none = F.array().cast(grouped.schema["_tenants"].dataType)
    tenants_of = F.when(F.col("valid"), F.coalesce("_tenants", none)).otherwise(none)
    reviewed = F.when(triggers, F.filter(tenants_of, lambda t: ready | t.drafts)).otherwise(none)
    event = lambda t: F.struct(
        t.projectId.alias("projectId"), t.repositoryId.alias("repositoryId"), t.installationId.cast("string").alias("installationId"), pr.number.alias("pullRequestNumber"),
        pr.head.sha.alias("headSha"), pr.base.sha.alias("baseSha"), action.alias("trigger"), S.pr_key(t.repositoryId, pr.number, pr.head.sha).alias("prKey"),
    )
    change = lambda t: F.struct(t.repositoryId.alias("repositoryId"), pr.number.alias("number"), pr.id.alias("githubPrId"), pr.head.sha.alias("headSha"), pr.state.alias("state"), pr.draft.alias("isDraft"))
    routed = rows.select("deliveryId", "valid", action.alias("action"), F.transform(reviewed, event).alias("events"), F.transform(tenants_of, change).alias("upserts"))
    decision, reason, status = _verdict(F.size("events"), F.size("upserts"))
    return routed.select("deliveryId", decision.alias("decision"), reason.alias("reason"), status.alias("status"), "events", "upserts")


def count_routes(deliveries: DataFrame, targets: DataFrame) -> DataFrame:
    """``route_pull_requests`` with the numbers of events and upserts instead of their lists.

    Tenants are counted by GitHub repository, so the work does not grow with deliveries times tenants.
    """
    pr, action = F.col("p.pull_request"), F.col("p.action")
    rows = deliveries.select("deliveryId", F.from_json("payload", PULL_REQUEST).alias("p"), is_valid("pull_request", F.col("payload")).alias("valid"))
    rows = rows.select("deliveryId", "valid", action.alias("action"), F.col("p.repository.id").alias("_repo"), _triggers(action).alias("_triggers"), _ready(action, pr).alias("_ready"))
    counted = targets.groupBy(F.col("githubRepoId").alias("_repo")).agg(F.count("*").alias("_n"), F.count_if(S.review_drafts(F.col("projectSettings"))).alias("_drafts"))
    rows = rows.join(counted, "_repo", "left")
    number = lambda n, *conditions: F.when(reduce(and_, conditions, F.col("valid")), F.coalesce(n, F.lit(0))).otherwise(0).cast("int")
    events = number(F.when(F.col("_ready"), F.col("_n")).otherwise(F.col("_drafts")), F.col("_triggers"))
    rows = rows.select("deliveryId", "valid", "action", events.alias("events"), number(F.col("_n")).alias("upserts"))
    decision, reason, status = _verdict(F.col("events"), F.col("upserts"))
    return rows.select("deliveryId", decision.alias("decision"), reason.alias("reason"), status.alias("status"), "events", "upserts")


def latest_pull_requests(deliveries: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a (repositoryId, number): what the last delivery by (receivedAt, deliveryId) says.

    These are the upserts of ``route_pull_requests``, of which the last of each GitHub repository and
    number is found before it meets the tenants: no row a delivery and tenant is made.
    """
    pr, at = F.col("p.pull_request"), F.struct("receivedAt", "deliveryId")
    said = F.struct(pr.id.alias("githubPrId"), pr.head.sha.alias("headSha"), pr.state.alias("state"), pr.draft.alias("isDraft"), "receivedAt", "deliveryId")
    rows = deliveries.where(is_valid("pull_request", F.col("payload"))).select("deliveryId", "receivedAt", F.from_json("payload", PULL_REQUEST).alias("p"))
    last = rows.groupBy(F.col("p.repository.id").alias("githubRepoId"), pr.number.alias("number")).agg(F.max_by(said, at).alias("l"))
    met = targets.select("repositoryId", "githubRepoId").join(last, "githubRepoId")
    # a repository that is listed under several GitHub ids takes the last of them
    found = met.groupBy("repositoryId", "number").agg(F.max_by("l", F.struct("l.receivedAt", "l.deliveryId")).alias("l"))
    return found.select("repositoryId", "number", "l.*")


def sync_effects(deliveries: DataFrame) -> DataFrame:
    """(deliveryId, effect, reason) of installation and repository deliveries."""
    rows = ", ".join(str(x) for x in SYNC_EFFECTS)
    table = deliveries.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(eventType, action, effect, reason)")
    found = deliveries.select("deliveryId", "eventType", "action").join(table, ["eventType", "action"], "left")
    return found.select("deliveryId", F.coalesce("effect", F.lit("NONE")).alias("effect"), F.coalesce("reason", F.lit("UNHANDLED_ACTION")).alias("reason"))


REPOSITORY_REF = "struct<id:bigint, full_name:string, name:string, owner:struct<login:string>, html_url:string>"
SYNC_PAYLOAD = (
    f"action string, repository {REPOSITORY_REF}, repositories_removed array<{REPOSITORY_REF}>, "
    "installation struct<id:bigint, account:struct<login:string, type:string>, suspended_at:string>"
)
EFFECTS = "deliveryId string, receivedAt timestamp, effect string, installationId long, githubRepoId long, owner string, name string, fullName string, htmlUrl string, accountLogin string, accountType string, suspendedAt timestamp"


def is_sync(event: Column, payload: Column) -> Column:
    """Whether a delivery is one of the synchronising events, with a payload that it can be read from."""
    found = F.lit(False)
    for name in ("installation", "installation_repositories", "repository"):
        found |= (event == name) & is_valid(name, payload)
    return found


def connection_changes(deliveries: DataFrame) -> DataFrame:
    """What synchronising deliveries of (deliveryId, eventType, action, payload, receivedAt) do, one row an object.

    An installation's effect names the installation; a repository's, and that on each of the
    repositories that an installation lost, name the GitHub repository.  Malformed payloads do nothing.
    """
    rows = deliveries.where(is_sync(F.col("eventType"), F.col("payload"))).select("deliveryId", "receivedAt", "eventType", "action", F.from_json("payload", SYNC_PAYLOAD).alias("p"))
    effects = sync_effects(rows).where(F.col("effect") != "NONE").select("deliveryId", "effect")
    rows = rows.join(effects, "deliveryId")
    whole = F.col("eventType") == "installation"
    repos = F.when(F.col("eventType") == "repository", F.array("p.repository")).when(F.col("eventType") == "installation_repositories", F.coalesce("p.repositories_removed", F.array().cast(f"array<{REPOSITORY_REF}>")))
    rows = rows.select("*", F.explode_outer(F.when(~whole, repos)).alias("r")).where(whole | F.col("r.id").isNotNull())
    named = F.when(F.col("effect") == "RENAME", F.col("r"))
    refreshed = F.col("effect") == "UPDATE_IF_EXISTS"
    suspended = F.when(F.col("action") == "suspend", F.col("receivedAt")).when(refreshed, F.try_to_timestamp("p.installation.suspended_at"))
    return rows.select(
        "deliveryId", "receivedAt", "effect", F.when(whole, F.col("p.installation.id")).alias("installationId"), F.col("r.id").alias("githubRepoId"),
        named.owner.login.alias("owner"), named.getField("name").alias("name"), named.full_name.alias("fullName"), named.html_url.alias("htmlUrl"),
        F.when(refreshed, F.col("p.installation.account.login")).alias("accountLogin"), F.when(refreshed, F.col("p.installation.account.type")).alias("accountType"), suspended.alias("suspendedAt"),
    )


def sweep_pending(ledger: DataFrame, now: Column, limit: int = PENDING_BATCH) -> DataFrame:
    """Pending deliveries older than a minute, oldest first, and whether they can be sent again."""
    old = ledger.where((F.col("status") == "PENDING") & (F.col("createdAt") < now - F.make_dt_interval(secs=F.lit(float(PENDING_AGE)))))
    replay = S.is_replayable(F.col("dispatchPayload"))
    return old.orderBy("createdAt", "deliveryId").limit(limit).select(
        "deliveryId", "createdAt", F.when(replay, "REPLAY").otherwise("FAILED").alias("sweep"), F.when(~replay, F.lit("UNSWEEPABLE_DISPATCH_PAYLOAD")).alias("error"), "dispatchPayload"
    )


def replayed_events(swept: DataFrame) -> DataFrame:
    """One row an event to send again, its prKey the id that makes sending idempotent."""
    items = F.from_json("dispatchPayload", "array<struct<prKey:string, repositoryId:string, projectId:string, headSha:string>>")
    return swept.where(F.col("sweep") == "REPLAY").select("deliveryId", F.explode(items).alias("e")).select("deliveryId", "e.*")


def stale_repositories(repositories: DataFrame, now: Column) -> DataFrame:
    return repositories.where((F.col("indexStatus") == "PENDING") & (F.col("updatedAt") < now - F.make_dt_interval(secs=F.lit(float(STALE_INDEX_AGE)))))


def apply_transitions(ledger: DataFrame, transitions: DataFrame) -> DataFrame:
    """Next snapshot of the ledger after (deliveryId, seq, at, to, payload, reason, code, message).

    to: DISPATCHED, IGNORED or FAILED, or PAYLOAD, which only keeps what is to be sent.  What a
    transition does not set stays as it is; the last by seq decides.
    """
    to, seq = F.col("to"), F.col("seq")
    moved = F.when(to != "PAYLOAD", seq)
    error = F.when(to == "IGNORED", F.to_json(F.struct("reason"))).when(to == "FAILED", F.to_json(F.struct("code", "message")))
    last = transitions.groupBy("deliveryId").agg(
        F.max_by(to, moved).alias("_status"), F.max_by("at", F.when(to == "DISPATCHED", seq)).alias("_at"),
        F.max_by("payload", F.when(to.isin("DISPATCHED", "PAYLOAD"), seq)).alias("_payload"), F.max_by(error, F.when(to.isin("IGNORED", "FAILED"), seq)).alias("_error"),
    )
    new = {"status": "_status", "dispatchedAt": "_at", "dispatchPayload": "_payload", "error": "_error"}
    rows = ledger.join(last, "deliveryId", "left").withColumns({c: F.coalesce(n, c) for c, n in new.items()})
    return rows.select(*ledger.columns)


def project_deleted_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(projectId, userId) of the projects that one snapshot has and the next has deleted."""
    gone = after.where(F.col("deletedAt").isNotNull()).select("id")
    return before.where(F.col("deletedAt").isNull()).join(gone, "id").select(F.col("id").alias("projectId"), "userId")


def index_requested_events(before: DataFrame | None, after: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """(repositoryId, projectId, installationId, reason): connected since the last snapshot, or found stale by the sweep."""
    fresh = after.where(F.col("indexStatus") == "PENDING")
    fresh = fresh if before is None else fresh.join(before.select("id"), "id", "left_anti")
    columns = lambda rows, reason: rows.select(F.col("id").alias("repositoryId"), "projectId", "installationId", F.lit(reason).alias("reason"))
    events = columns(fresh, "connected")
    return events if stale is None else events.unionByName(columns(stale.join(fresh.select("id"), "id", "left_anti"), "sweep"))


def new_events(events: DataFrame, outbox: DataFrame | None) -> DataFrame:
    """Events that were not sent yet, one of each prKey: sending them again is harmless."""
    once = events.groupBy("prKey").agg(F.min(F.struct(*(c for c in events.columns if c != "prKey"))).alias("e")).select("prKey", "e.*").select(*events.columns)
    return once if outbox is None else once.join(outbox.select("prKey"), "prKey", "left_anti").select(*events.columns)


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A table's parts; None where there is none yet."""
    return spark.read.parquet(f"{folder}/{table}") if Folder(spark, f"{folder}/{table}").names() else None


def _write(rows: DataFrame, folder: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/{table}/part={batch_id}")


def known_deliveries(spark: SparkSession, folder: str) -> KeyedTable:
    """The ids of all deliveries so far, in segments: a look-up opens those that may hold one of its ids."""
    return KeyedTable(spark, f"{folder}/deliveries", "deliveryId string", ["deliveryId"])


def rate_counts(spark: SparkSession, folder: str) -> KeyedTable:
    """How many deliveries of an installation counted in each minute so far."""
    return KeyedTable(spark, f"{folder}/rates", "installationId long, bucket long, n long", ["installationId", "bucket"])


def connections(spark: SparkSession, folder: str) -> KeyedTable:
    """The effects folded: the last of each sort on each installation or repository."""
    return KeyedTable(spark, f"{folder}/connections", f"{EFFECTS}, sort string", ["installationId", "githubRepoId", "sort"])


def fold_effects(effects: DataFrame) -> DataFrame:
    """The last effect of each sort on an object: renaming, refreshing, or losing and regaining access."""
    sort = F.when(F.col("effect").isin("ACCESS_LOST", "RESTORE"), "ACCESS").otherwise(F.col("effect"))
    rows = effects.withColumn("sort", sort)
    keys = ["installationId", "githubRepoId", "sort"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("receivedAt", "deliveryId")).alias("_r")).select(*keys, "_r.*")


def ingest_batch(batch: DataFrame, repositories: DataFrame, projects: DataFrame, secret: str, folder: str, batch_id: int) -> None:
    """Admit, dedup against the ledger, apply, route and write one micro-batch.

    Parts by batch below ``folder``: effects (on connections), pull_requests (the last change of each
    in the batch), outbox, ledger.  Tables by key: deliveries, rates, connections.  Of these a batch
    reads what its own keys may be in, whatever the history; only earlier batches' rows count.  The
    rate limit counts on from earlier batches; routing sees connections as all effects so far,
    this batch's included, leave them.
    """
    spark = batch.sparkSession
    deliveries, rates, folded = known_deliveries(spark, folder), rate_counts(spark, folder), connections(spark, folder)
    named = batch.select(installation_of(F.decode("body", "UTF-8")).alias("installationId"), bucket_of("receivedAt", INSTALLATION_WINDOW).alias("bucket"))
    before = rates.segments(batch_id)
    counts = rates.rows_of(named, before).persist() if before else None
    admitted = admit(batch, secret, counts).persist()
    try:
        counted = admitted.where(F.col("outcome").isin("SYNC", "DISPATCH", "RATE_LIMITED"))
        passed = admitted.where(F.col("outcome").isin("SYNC", "DISPATCH"))
        earlier = deliveries.segments(batch_id)
        fresh = new_deliveries(passed, deliveries.rows_of(passed, earlier) if earlier else None, ["receivedAt", "signature"]).persist()
        changed = connection_changes(fresh.where(F.col("outcome") == "SYNC"))
        _write(changed, folder, "effects", batch_id)
        own = fold_effects(spark.read.schema(EFFECTS).parquet(f"{folder}/effects/part={batch_id}"))
        held = folded.rows_of(own, folded.segments(batch_id))
        folded.put(fold_effects(held.unionByName(own).drop("sort")), batch_id)
        targets = tenants(apply_connection_effects(repositories, folded.snapshot()), projects)
        pulls = fresh.where(F.col("eventType") == "pull_request")
        routed = route_pull_requests(pulls, targets)
        _write(latest_pull_requests(pulls, targets), folder, "pull_requests", batch_id)
        _write(routed.where(F.size("events") > 0).select("deliveryId", F.explode("events").alias("e")).select("deliveryId", "e.*"), folder, "outbox", batch_id)
        synced = fresh.where(F.col("outcome") == "SYNC").withColumn("readable", is_sync(F.col("eventType"), F.col("payload")))
        effects = sync_effects(synced).join(synced.select("deliveryId", "readable"), "deliveryId").select("deliveryId", "readable", F.when(F.col("readable"), F.col("reason")).otherwise("MALFORMED_PAYLOAD").alias("syncReason"))
        rows = fresh.join(routed.select("deliveryId", "status", F.col("reason").alias("routeReason"), F.to_json("events").alias("dispatchPayload")), "deliveryId", "left").join(effects, "deliveryId", "left")
        rows = rows.select(
            "deliveryId", "eventType", "action", "installationId", "repositoryFullName", "dispatchPayload",
            F.coalesce("status", F.when(F.col("readable"), "IGNORED").otherwise("FAILED")).alias("status"), F.coalesce("routeReason", "syncReason").alias("error"), F.col("receivedAt").alias("createdAt"),
        )
        _write(rows, folder, "ledger", batch_id)
        deliveries.put(spark.read.parquet(f"{folder}/ledger/part={batch_id}").select("deliveryId"), batch_id)
        now = counted.groupBy("installationId", "bucket").agg(F.count("*").alias("n"))
        rates.put(now if counts is None else now.unionByName(counts).groupBy("installationId", "bucket").agg(F.sum("n").alias("n")), batch_id)
        fresh.unpersist()
    finally:
        admitted.unpersist()
        if counts is not None:
            counts.unpersist()


def ingest_stream(stream: DataFrame, repositories: DataFrame, projects: DataFrame, secret: str, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run ``ingest_batch`` on each micro-batch of a streaming frame of deliveries.

    A folder belongs to one checkpoint: batch numbers name its parts.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, n: ingest_batch(batch, repositories, projects, secret, folder, n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_pull_requests(changes: DataFrame) -> DataFrame:
    """The last change of each pull request over all batches, as a snapshot."""
    rest = [c for c in changes.columns if c not in ("repositoryId", "number", "part")]
    return changes.groupBy("repositoryId", "number").agg(F.max_by(F.struct(*rest), F.struct("receivedAt", "deliveryId")).alias("r")).select("repositoryId", "number", "r.*").drop("receivedAt", "deliveryId")


def apply_connection_effects(repositories: DataFrame, effects: DataFrame | None) -> DataFrame:
    """Next snapshot of repositories after effects on installations or single GitHub repositories.

    effects: installationId or githubRepoId (the other null), effect, receivedAt, deliveryId, and
    for renames the new names.  Losing and regaining access only move ACTIVE and ACCESS_LOST into
    each other, so the last effect that meets a repository decides, and a DISCONNECTED one stays
    as it is; the last renaming gives the names.
    """
    if effects is None:
        return repositories
    at = ("receivedAt", "deliveryId")
    moved = effects.where(F.col("effect").isin("ACCESS_LOST", "RESTORE"))
    last = lambda key: moved.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*at, "effect")).alias(f"_{key}"))
    rows = repositories.join(last("installationId"), "installationId", "left").join(last("githubRepoId"), "githubRepoId", "left")
    effect = F.greatest("_installationId", "_githubRepoId").getField("effect")
    status = F.when(F.col("connectionStatus") == "DISCONNECTED", F.col("connectionStatus")).when(effect == "ACCESS_LOST", "ACCESS_LOST").when(effect == "RESTORE", "ACTIVE").otherwise(F.col("connectionStatus"))
    names = [c for c in ("owner", "name", "fullName", "htmlUrl") if c in effects.columns and c in repositories.columns]
    changed = {"connectionStatus": status}
    if names:
        renamed = effects.where(F.col("effect") == "RENAME").groupBy("githubRepoId").agg(F.max_by(F.struct(*names), F.struct(*at)).alias("_named"))
        rows = rows.join(renamed, "githubRepoId", "left")
        changed |= {c: F.coalesce(F.col(f"_named.{c}"), F.col(c)) for c in names}
    return rows.withColumns(changed).select(*repositories.columns)


def apply_installation_effects(installations: DataFrame, effects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next snapshot of installations, deliveries on installations without a row).

    ``created`` refreshes a row that exists and never makes one; suspending and unsuspending set
    and clear the time, deleting leaves it; the last effect on an installation decides.
    """
    rank = F.struct("receivedAt", "deliveryId")
    own = effects.where(F.col("installationId").isNotNull())
    last = own.groupBy("installationId").agg(
        F.max_by(F.struct("accountLogin", "accountType"), F.when(F.col("effect") == "UPDATE_IF_EXISTS", rank)).alias("_account"),
        F.max_by(F.struct("suspendedAt"), F.when(F.col("effect").isin("UPDATE_IF_EXISTS", "RESTORE") | F.col("suspendedAt").isNotNull(), rank)).alias("_suspended"),
    )
    rows = installations.join(last, "installationId", "left").withColumns({
        "accountLogin": F.coalesce("_account.accountLogin", "accountLogin"), "accountType": F.coalesce("_account.accountType", "accountType"),
        "suspendedAt": F.when(F.col("_suspended").isNotNull(), F.col("_suspended.suspendedAt")).otherwise(F.col("suspendedAt")),
    })
    created = own.where(F.col("effect") == "UPDATE_IF_EXISTS").join(installations.select("installationId"), "installationId", "left_anti")
    return rows.select(*installations.columns), created.select("deliveryId", F.lit("INSTALLATION_CREATED_NO_EXISTING_ROW").alias("reason"))
