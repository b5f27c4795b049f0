"""Registered queries on the webhook ledger, the state tables and small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import policy
from .operators import listing, state
from .queries import ACCOUNTS_SQL, FILES_SQL, REPOSITORIES_SQL, SYMBOLS_SQL, _accounts, files, projects, query, repositories, symbols, table
from .source_queries import values_sql
from .streaming import ledger

SECRET = "s3"


def hmac_sha256(body: Column, secret: str) -> Column:
    """Built-in hashes alone: how the test deliveries are signed."""
    pads = [bytes((b"" + secret.encode()).ljust(64, b"\0")[k] ^ x for k in range(64)) for x in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(F.lit(pads[0]), body), 256))
    return F.sha2(F.concat(F.lit(pads[1]), inner), 256)


#: What is odd about a delivery, by event_id % 20; all others are in order.
ADMISSION_SQL = """d AS (SELECT event_id, ts, CAST(event_id % 20 AS INTEGER) AS k, event_id % 6 AS installation, CAST(floor(epoch(ts) / 60) AS BIGINT) // 60 * 60 AS minute FROM events),
o AS (SELECT *, CASE k WHEN 0 THEN 'MISSING_HEADERS' WHEN 1 THEN 'MISSING_HEADERS' WHEN 2 THEN 'SIGNATURE_REJECTED' WHEN 3 THEN 'SIGNATURE_REJECTED' WHEN 4 THEN 'SIGNATURE_REJECTED' WHEN 5 THEN 'UNKNOWN_EVENT' WHEN 6 THEN 'PING'
  WHEN 7 THEN 'INVALID_JSON' END AS early, CASE k WHEN 2 THEN 'MISSING_SIGNATURE' WHEN 3 THEN 'MALFORMED_SIGNATURE' WHEN 4 THEN 'MISMATCH' ELSE 'OK' END AS reason FROM d),
c AS (SELECT event_id, row_number() OVER (PARTITION BY installation, minute ORDER BY ts, event_id) + CASE WHEN installation % 2 = 0 AND minute % 120 = 0 THEN 99 ELSE 0 END AS nth FROM o WHERE early IS NULL)"""


def deliveries(spark, sf_dir) -> DataFrame:
    """Signed deliveries, all of an hour in its first minute."""
    i = F.col("event_id")
    k = i % 20
    body = F.when(k == 7, F.lit("{oops")).otherwise(F.to_json(F.struct(F.when(k % 2 == 0, "opened").otherwise("created").alias("action"), F.struct((i % 6).alias("id")).alias("installation"), F.struct(F.concat(F.lit("o/r"), i % 9).alias("full_name")).alias("repository"))))
    raw = body.cast("binary")
    good = F.concat(F.lit("sha256="), hmac_sha256(raw, SECRET))
    signature = F.when(k == 2, F.lit(None).cast("string")).when(k == 3, F.concat(F.lit("sha1="), F.substring(good, 8, 64))).when(k == 4, F.concat(F.lit("sha256="), F.repeat(F.lit("0"), F.lit(64)))).otherwise(good)
    event = F.when(k == 1, "").when(k == 5, "issues").when(k == 6, "ping").when(k == 8, "installation").when(k == 9, "repository").otherwise("pull_request")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) * 3600
    within = F.unix_timestamp(F.col("ts").cast("timestamp")) % 3600 / 60
    at = F.timestamp_micros((hour * 1_000_000 + F.floor(within * 1_000_000)).cast("long"))
    return table(spark, sf_dir, "events").select(F.when(k != 0, i.cast("string")).alias("deliveryId"), event.alias("eventType"), signature.alias("signature"), raw.alias("body"), at.alias("receivedAt"), i.alias("event_id"), "ts")


@query(f"""WITH {ADMISSION_SQL}
SELECT o.event_id, coalesce(early, CASE WHEN nth > 100 THEN 'RATE_LIMITED' WHEN k IN (8, 9) THEN 'SYNC' ELSE 'DISPATCH' END) AS outcome, reason, CASE WHEN k <> 7 THEN 'o/r' || (o.event_id % 9) END AS "repositoryFullName",
  CASE WHEN k = 7 THEN NULL WHEN k % 2 = 0 THEN 'opened' ELSE 'created' END AS action, CASE WHEN k <> 7 THEN installation END AS "installationId" FROM o LEFT JOIN c ON c.event_id = o.event_id""")
def webhook_admission(spark, sf_dir):
    """The limit counts on from what earlier batches counted: 99 for half of the installations in every other hour."""
    rows = deliveries(spark, sf_dir)
    buckets = rows.select(F.floor(F.unix_timestamp("receivedAt") / 60).alias("bucket")).distinct().where("bucket % 120 = 0")
    counted = buckets.select(F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 2, 4)))).alias("installationId"), "bucket", F.lit(99).cast("long").alias("n"))
    return ledger.admit(rows, SECRET, counted).select("event_id", "outcome", "reason", "repositoryFullName", "action", "installationId")


@query("""WITH b AS (SELECT event_id, user_id % 50 AS key, ts, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket, event_id % 3 = 0 AS earlier FROM events),
n AS (SELECT key, bucket, count(*) AS n FROM b WHERE earlier GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.key, b.bucket ORDER BY ts, event_id) + coalesce(n.n, 0) AS nth FROM b LEFT JOIN n ON n.key = b.key AND n.bucket = b.bucket WHERE NOT earlier)
SELECT event_id, bucket, nth, nth <= 4 AS allowed, CAST(CASE WHEN nth <= 4 THEN 0 ELSE (bucket + 1) * 3600 - floor(epoch(ts)) END AS BIGINT) AS "retryAfter" FROM r""")
def rate_limit_over_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("key"), "ts")
    earlier = ledger.fixed_window(rows.where("event_id % 3 = 0"), ["key"], "ts", ["event_id"], 3600, 4).groupBy("key", "bucket").agg(F.count("*").alias("n"))
    return ledger.fixed_window(rows.where("event_id % 3 <> 0"), ["key"], "ts", ["event_id"], 3600, 4, earlier).select("event_id", "bucket", "nth", "allowed", "retryAfter")


_REF = '{"id": 7, "full_name": "o/r", "name": "r", "owner": {"login": "o"}, "html_url": "u"}'
_PULL = '{"id": 1, "number": 2, "state": "open", "draft": false, "head": {"sha": "a"}, "base": {"sha": "b"}}'
#: payload, and whether it is one of a pull request, an installation, its repositories, a repository, a ping; its action and installation
PAYLOADS = [
    (f'{{"action": "x", "number": 2, "pull_request": {_PULL}, "repository": {_REF}, "installation": {{"id": 3}}}}', True, False, True, True, True, "x", 3),
    (f'{{"action": "x", "number": "2", "pull_request": {_PULL}, "repository": {_REF}, "installation": {{"id": 3}}}}', False, False, True, True, True, "x", 3),
    (f'{{"action": "x", "number": 2, "pull_request": {_PULL.replace("open", "merged")}, "repository": {_REF}, "installation": {{"id": 3}}}}', False, False, True, True, True, "x", 3),
    (f'{{"action": "x", "number": 2, "pull_request": {_PULL.replace("false", "0")}, "repository": {_REF}, "installation": {{"id": 3}}}}', False, False, True, True, True, "x", 3),
    ('{"action": "created", "installation": {"id": 3, "account": {"login": "a", "type": "User"}}}', False, True, True, False, True, "created", 3),
    ('{"action": "created", "installation": {"id": 3, "account": {"login": "a"}}}', False, False, True, False, True, "created", 3),
    ('{"action": "removed", "installation": {"id": "3"}}', False, False, False, False, True, "removed", None),
    (f'{{"action": "renamed", "repository": {_REF}}}', False, False, False, True, True, "renamed", None),
    ('{"action": 5, "repository": {"id": 7}}', False, False, False, False, True, None, None), ("{}", False, False, False, False, True, None, None), ("[1]", False, False, False, False, False, None, None),
    ("{oops", False, False, False, False, False, None, None),
]


@query(f"""WITH {values_sql("v", "k, pull_request, installation, installation_repositories, repository, ping, action, installationId", [(k, *r[1:]) for k, r in enumerate(PAYLOADS)])}
SELECT event_id, pull_request, installation, installation_repositories, repository, ping, action, CAST(installationId AS BIGINT) AS "installationId" FROM events JOIN v ON event_id % {len(PAYLOADS)} = k""")
def webhook_payloads(spark, sf_dir):
    from .functions import strings as S

    text = F.element_at(F.array(*(F.lit(r[0]) for r in PAYLOADS)), (F.col("event_id") % len(PAYLOADS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("payload"))
    valid = [ledger.is_valid(e, F.col("payload")).alias(e) for e in ("pull_request", "installation", "installation_repositories", "repository", "ping")]
    return rows.select("event_id", *valid, S.typed_json(F.col("payload"), "$.action", "string").alias("action"), S.typed_json(F.col("payload"), "$.installation.id", "bigint").alias("installationId"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'UNAUTHENTICATED' WHEN 1 THEN 'NOT_ACCESSIBLE' WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 'UNAVAILABLE' ELSE 'NOT_ACCESSIBLE' END ELSE 'UNAVAILABLE' END AS reason,
  event_id % 41 <= 30 AND event_id % 4 < 2 AS retried, CAST(CASE WHEN event_id % 41 <= 30 AND event_id % 4 < 2 THEN event_id % 41 END AS BIGINT) AS wait FROM events""")
def call_retries(spark, sf_dir):
    """Why each call failed, and whether and after which wait it is made again."""
    from .functions import policy

    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (401, 404, 403, 429, 503))), (i % 5 + 1).cast("int"))
    calls = table(spark, sf_dir, "events").select("event_id", status.alias("status"), (i % 2 == 0).alias("limited"), (i % 41).alias("wait"), (i % 4).alias("retries"))
    again = policy.may_retry(F.col("wait"), F.col("retries"))
    return calls.select("event_id", policy.failure_reason(F.col("status"), F.col("limited")).alias("reason"), again.alias("retried"), F.when(again, F.col("wait")).alias("wait"))


SYNCS_SQL = """s AS (SELECT event_id, ts, CAST(event_id % 8 AS INTEGER) AS k, event_id % 90 AS inst, event_id % 700 AS repo FROM events WHERE event_id % 4 < 3),
x AS (SELECT event_id, ts, k, CASE WHEN k IN (0, 1, 4) THEN inst END AS inst, repo AS repo, CASE WHEN k IN (0, 2, 5) THEN 'ACCESS_LOST' WHEN k IN (1, 6) THEN 'RESTORE' ELSE 'UPDATE' END AS effect FROM s
  UNION ALL SELECT event_id, ts, k, NULL, repo + 1, 'ACCESS_LOST' FROM s WHERE k = 2),
e AS (SELECT event_id, ts, k, inst, CASE WHEN k IN (0, 1, 4) THEN NULL ELSE repo END AS repo, effect FROM x)"""


def syncs(spark, sf_dir) -> DataFrame:
    """Synchronising deliveries: suspend, unsuspend, removed (two repositories), created, deleted and unarchived."""
    i = F.col("event_id")
    k = i % 8
    ref = lambda n: F.struct(n.alias("id"), F.lit("o/r").alias("full_name"), F.lit("r").alias("name"), F.struct(F.lit("o").alias("login")).alias("owner"), F.lit("u").alias("html_url"))
    event = F.when(k.isin(0, 1, 4), "installation").when(k == 2, "installation_repositories").otherwise("repository")
    action = F.when(k == 0, "suspend").when(k == 1, "unsuspend").when(k == 2, "removed").when(k == 4, "created").when(k == 5, "deleted").otherwise("unarchived")
    account = F.struct(F.concat(F.lit("L"), i).alias("login"), F.lit("User").alias("type"))
    payload = F.to_json(F.struct(action.alias("action"), F.struct((i % 90).alias("id"), account.alias("account")).alias("installation"), F.when(event == "repository", ref(i % 700)).alias("repository"), F.when(k == 2, F.array(ref(i % 700), ref(i % 700 + 1))).alias("repositories_removed")))
    rows = table(spark, sf_dir, "events").where("event_id % 4 < 3")
    return rows.select(F.lpad(i.cast("string"), 12, "0").alias("deliveryId"), event.alias("eventType"), action.alias("action"), payload.alias("payload"), F.col("ts").cast("timestamp").alias("receivedAt"))


@query(f"""WITH {SYNCS_SQL} SELECT event_id, inst AS "installationId", repo AS "githubRepoId", CASE effect WHEN 'UPDATE' THEN 'UPDATE_IF_EXISTS' ELSE effect END AS effect, CASE WHEN k = 4 THEN 'L' || event_id END AS "accountLogin", k = 0 AS suspended FROM e""")
def connection_changes(spark, sf_dir):
    found = ledger.connection_changes(syncs(spark, sf_dir))
    return found.select(F.col("deliveryId").cast("long").alias("event_id"), "installationId", "githubRepoId", "effect", "accountLogin", F.col("suspendedAt").isNotNull().alias("suspended"))


@query(f"""WITH {REPOSITORIES_SQL}, {SYNCS_SQL}, m AS (SELECT * FROM e WHERE effect <> 'UPDATE'),
i AS (SELECT inst, max((ts, event_id)) AS at, arg_max(effect, (ts, event_id)) AS effect FROM m WHERE inst IS NOT NULL GROUP BY inst),
g AS (SELECT repo, max((ts, event_id)) AS at, arg_max(effect, (ts, event_id)) AS effect FROM m WHERE repo IS NOT NULL GROUP BY repo),
n AS (SELECT r.connectionStatus AS old, CASE WHEN g.at IS NULL OR (i.at IS NOT NULL AND i.at > g.at) THEN i.effect ELSE g.effect END AS effect FROM repositories r LEFT JOIN i ON i.inst = r.installationId LEFT JOIN g ON g.repo = r.githubRepoId)
SELECT CASE WHEN old = 'DISCONNECTED' THEN old WHEN effect = 'ACCESS_LOST' THEN 'ACCESS_LOST' WHEN effect = 'RESTORE' THEN 'ACTIVE' ELSE old END AS "connectionStatus", old, count(*) AS repositories FROM n GROUP BY ALL""")
def connection_status(spark, sf_dir):
    before = repositories(spark, sf_dir).withColumn("old", F.col("connectionStatus"))
    after = ledger.apply_connection_effects(before, ledger.connection_changes(syncs(spark, sf_dir)))
    return after.groupBy("connectionStatus", "old").agg(F.count("*").alias("repositories"))


@query(f"""WITH {ACCOUNTS_SQL}, {SYNCS_SQL}, l AS (SELECT inst, arg_max(event_id, (ts, event_id)) FILTER (k = 4) AS named, arg_max(k, (ts, event_id)) AS k FROM e WHERE inst IS NOT NULL GROUP BY inst)
SELECT CAST(i.installationId AS VARCHAR) AS "installationId", coalesce('L' || l.named, i.accountLogin) AS "accountLogin", coalesce(l.k = 0, false) AS suspended, NULL AS reason FROM installations i LEFT JOIN l ON l.inst = i.installationId
UNION ALL SELECT CAST(event_id AS VARCHAR), NULL, NULL, 'INSTALLATION_CREATED_NO_EXISTING_ROW' FROM e WHERE k = 4 AND inst NOT IN (SELECT installationId FROM installations)""")
def installation_effects(spark, sf_dir):
    held = _accounts(spark, sf_dir, "installations").withColumn("suspendedAt", F.lit(None).cast("timestamp"))
    after, missing = ledger.apply_installation_effects(held, ledger.connection_changes(syncs(spark, sf_dir)))
    none = F.lit(None).cast("string")
    rows = after.select(F.col("installationId").cast("string").alias("installationId"), "accountLogin", F.col("suspendedAt").isNotNull().alias("suspended"), none.alias("reason"))
    return rows.unionByName(missing.select(F.col("deliveryId").cast("long").cast("string").alias("installationId"), none.alias("accountLogin"), F.lit(None).cast("boolean").alias("suspended"), "reason"))


@query(f"""WITH {REPOSITORIES_SQL} SELECT id AS "repositoryId", projectId AS "projectId", 'connected' AS reason FROM repositories WHERE indexStatus = 'PENDING' AND id % 3 = 0
UNION ALL SELECT id, projectId, 'sweep' FROM repositories WHERE indexStatus = 'PENDING' AND id % 3 <> 0 AND updatedAt < TIMESTAMP '1996-06-01' - INTERVAL 15 MINUTE
UNION ALL SELECT NULL, id, 'project/deleted' FROM projects WHERE id % 4 = 1""")
def emitted_events(spark, sf_dir):
    """Index requests of repositories that are new or found stale, and deletions of projects."""
    after = repositories(spark, sf_dir)
    stale = ledger.stale_repositories(after, F.to_timestamp_ntz(F.lit("1996-06-01 00:00:00")))
    asked = ledger.index_requested_events(after.where("id % 3 <> 0"), after, stale).select("repositoryId", "projectId", "reason")
    before = projects(spark, sf_dir).withColumn("deletedAt", F.lit(None).cast("int"))
    gone = ledger.project_deleted_events(before, before.withColumn("deletedAt", F.when(F.col("id") % 4 == 1, 1)))
    return asked.unionByName(gone.select(F.lit(None).cast(asked.schema["repositoryId"].dataType).alias("repositoryId"), "projectId", F.lit("project/deleted").alias("reason")))


# State tables


@query(f"""WITH {SYMBOLS_SQL}, {FILES_SQL}
SELECT 'symbols inserted' AS what, count(*) FILTER (id % 3 = 0) AS rows FROM symbols UNION ALL SELECT 'symbols after', count(*) FROM symbols
UNION ALL SELECT 'symbols deleted', count(*) FROM symbols WHERE repositoryId = 'r1' UNION ALL SELECT 'edges deleted', count(*) FROM lineitem WHERE l_orderkey % 2 = 0
UNION ALL SELECT 'files at commit', count(*) FROM files WHERE repositoryId = 'r1' AND commitSha = 'sha2' UNION ALL SELECT 'eligible', count(*) FROM files WHERE id % 3 < 2""")
def graph_state(spark, sf_dir):
    from .queries import edges

    rows, placed = symbols(spark, sf_dir), files(spark, sf_dir)
    after, inserted = state.insert_symbols(rows.where("id % 3 <> 0"), rows.unionByName(rows.where("id % 5 = 0")))
    ending = F.when(F.col("id") % 3 == 0, ".ts").when(F.col("id") % 3 == 1, ".tsx").otherwise(".md")
    typed = placed.withColumn("path", F.concat("path", ending)).withColumn("indexState", F.lit("INDEXED"))
    shown = lambda what, counted: counted.select(F.lit(what).alias("what"), F.col(counted.columns[0]).alias("rows"))
    count = lambda df: df.agg(F.count("*").alias("n"))
    out = shown("symbols inserted", inserted).unionByName(shown("symbols after", count(after)))
    out = out.unionByName(shown("symbols deleted", state.delete_repository_rows(rows, "r1")[1])).unionByName(shown("edges deleted", state.delete_repository_rows(edges(spark, sf_dir), "r0")[1]))
    at_commit = listing.files_at_commit(placed.withColumns({"indexState": F.lit("INDEXED"), "isTest": F.lit(False)}), "r1", "sha2")
    return out.unionByName(shown("files at commit", count(at_commit))).unionByName(shown("eligible", count(listing.parse_eligible(typed))))


@query(f"""WITH {REPOSITORIES_SQL} SELECT id, CASE WHEN id = 7 THEN 'INDEXED' WHEN id = 32 THEN 'FAILED' ELSE indexStatus END AS "indexStatus", CASE WHEN id = 7 THEN 'sha9' END AS "indexedCommitSha",
  CASE WHEN id = 32 THEN 'REPO_TOO_LARGE' END AS code, CASE WHEN id = 7 THEN TIMESTAMP '2024-01-02' END AS "lastIndexedAt" FROM repositories""")
def terminal_writes(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = repositories(spark, sf_dir).withColumns({"indexedCommitSha": none, "lastIndexedAt": F.lit(None).cast("timestamp_ntz"), "indexError": none})
    rows = state.mark_failed(state.mark_indexed(rows, 7, "sha9", F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))), 32, "REPO_TOO_LARGE", "big")
    return rows.select("id", "indexStatus", "indexedCommitSha", F.get_json_object("indexError", "$.code").alias("code"), "lastIndexedAt")


@query(f"""WITH {REPOSITORIES_SQL} SELECT 'deleted' AS what, id FROM projects WHERE id = 11 AND userId = 'u1' AND deletedAt IS NULL
UNION ALL SELECT CASE WHEN id % 2 = 0 THEN 'DUPLICATE' ELSE 'inserted' END, id FROM projects WHERE id % 5 = 0 UNION ALL SELECT 'found', id FROM repositories WHERE projectId = 11 AND connectionStatus = 'ACTIVE'
UNION ALL SELECT 'matched', p_partkey FROM part WHERE contains(lower(p_name), 'ee')""")
def guarded_rows(spark, sf_dir):
    """A soft delete, unique inserts with a conflict, a point lookup and a search."""
    from .operators import graph

    rows = projects(spark, sf_dir)
    after, _ = state.soft_delete(rows, "u1", 11, F.lit(5))
    changed = after.where("deletedAt = 5").select(F.lit("deleted").alias("what"), "id")
    fresh, refused = state.insert_unique(rows.where("id % 2 = 0"), rows.where("id % 5 = 0"), ["id"], "DUPLICATE")
    out = changed.unionByName(fresh.select(F.lit("inserted").alias("what"), "id")).unionByName(refused.select(F.col("conflict").alias("what"), "id"))
    found = listing.find_by(repositories(spark, sf_dir), ("id",), projectId=11, connectionStatus="ACTIVE").select(F.lit("found").alias("what"), "id")
    matched = graph.search_repositories(table(spark, sf_dir, "part"), "EE", "p_name").select(F.lit("matched").alias("what"), F.col("p_partkey").alias("id"))
    return out.unionByName(found).unionByName(matched)


@query(f"""WITH {FILES_SQL} SELECT repositoryId AS "repositoryId", id, CASE WHEN repositoryId = 'r1' THEN sizeBytes + 1 ELSE sizeBytes END AS "sizeBytes" FROM files WHERE repositoryId <> 'r1' OR id % 3 = 0""")
def graph_replaced(spark, sf_dir):
    """Only the partitions that are written are replaced."""
    import uuid

    from .queries import cut

    rows = files(spark, sf_dir).select("id", "sizeBytes", "repositoryId")
    stored = cut(rows.limit(0), f"replaced-{uuid.uuid4().hex}").inputFiles()
    path = stored[0].rsplit("/", 1)[0] + "-table"
    state.overwrite_partitions(rows, path)
    state.overwrite_partitions(rows.where("repositoryId = 'r1' AND id % 3 = 0").withColumn("sizeBytes", F.col("sizeBytes") + 1), path)
    return spark.read.schema(rows.schema).parquet(path).select("repositoryId", "id", "sizeBytes")


@query("""SELECT event_type, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99 FROM (SELECT event_type, event_id * 7919 % 1009 AS v FROM events) GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") * 7919 % 1009).alias("v"))
    return listing.latency_percentiles(rows, ["event_type"], "v")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '[REDACTED]' WHEN 1 THEN '[REDACTED]' WHEN 2 THEN '[REDACTED]' WHEN 3 THEN '[REDACTED]' WHEN 4 THEN 'v' || event_id ELSE 'v' || event_id END AS value,
  'k' || event_id AS kept FROM events""")
def redaction(spark, sf_dir):
    i = F.col("event_id")
    name = F.element_at(F.array(*(F.lit(x) for x in ("accessToken", "DATABASE_URL", "MY_KEY", "set-cookie", "databaseUrl", "key"))), (i % 6 + 1).cast("int"))
    text = F.concat(F.lit('{"a": [{"'), name, F.lit('": "v'), i, F.lit('"}], "b": "k'), i, F.lit('"}'))
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("name"), policy.redact_json(text).alias("json"))
    value = F.from_json("json", "a array<map<string,string>>, b string")
    return rows.select("event_id", F.try_element_at(F.get(value.a, F.lit(0)), F.col("name")).alias("value"), value.b.alias("kept"))
