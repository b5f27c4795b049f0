import hashlib
import hmac
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.operators.keyed import KeyedTable
from graphloom.streaming import ledger

SECRET = "s3"
NOW = datetime(2026, 1, 1)
DELIVERY = "deliveryId string, eventType string, signature string, body binary, receivedAt timestamp"


def payload(action="opened", repo=7, draft=False, number=5, sha="h1", **more):
    return {"action": action, "number": number, "installation": {"id": 3}, "repository": {"id": repo, "full_name": "o/r", "name": "r", "owner": {"login": "o"}, "html_url": "u"},
            "pull_request": {"id": 11, "number": number, "state": "open", "draft": draft, "head": {"sha": sha}, "base": {"sha": "b"}}} | more


def delivery(id, event="pull_request", body=None, signature=None, at=0):
    raw = body if isinstance(body, bytes) else json.dumps(payload() if body is None else body).encode()
    good = "sha256=" + hmac.new(SECRET.encode(), raw, hashlib.sha256).hexdigest()
    return (id, event, good if signature is None else signature, raw, NOW + timedelta(seconds=at))


@pytest.fixture
def tables(spark):
    repos = spark.createDataFrame([("r1", "p1", 3, 7, "ACTIVE"), ("r2", "p2", 3, 7, "ACTIVE"), ("r3", "p3", 3, 7, "ACTIVE"), ("r4", "p1", 3, 8, "DISCONNECTED")], "id string, projectId string, installationId long, githubRepoId long, connectionStatus string")
    projects = spark.createDataFrame([("p1", None, "{}"), ("p2", None, '{"reviewDraftPullRequests": true}'), ("p3", NOW, "{}")], "id string, deletedAt timestamp, settings string")
    return repos, projects


@pytest.fixture
def targets(tables):
    return ledger.tenants(*tables)


def test_admission(spark):
    rows = [
        delivery("ok"), delivery("none", signature=""), delivery("form", signature="md5=1"), delivery("wrong", signature="sha256=" + "0" * 64), delivery("what", event="issues"), delivery("ping", event="ping", body=b"x"),
        delivery("json", body=b"{oops"), delivery("sync", event="repository"), delivery(None), delivery("e", event=None),
    ]
    found = {r.deliveryId: (r.outcome, r.reason) for r in ledger.admit(spark.createDataFrame(rows, DELIVERY), SECRET).collect()}
    assert found == {
        "ok": ("DISPATCH", "OK"), "none": ("SIGNATURE_REJECTED", "MISSING_SIGNATURE"), "form": ("SIGNATURE_REJECTED", "MALFORMED_SIGNATURE"), "wrong": ("SIGNATURE_REJECTED", "MISMATCH"),
        "what": ("UNKNOWN_EVENT", "OK"), "ping": ("PING", "OK"), "json": ("INVALID_JSON", "OK"), "sync": ("SYNC", "OK"), None: ("MISSING_HEADERS", "OK"), "e": ("MISSING_HEADERS", "OK"),
    }


def test_installation_rate_limit(spark):
    rows = [delivery(f"d{i:03}", at=i * 0.1) for i in range(103)] + [delivery("later", at=60)]
    found = [r for r in ledger.admit(spark.createDataFrame(rows, DELIVERY), SECRET).collect() if r.outcome == "RATE_LIMITED"]
    assert sorted(r.deliveryId for r in found) == ["d100", "d101", "d102"] and {r.retryAfter for r in found} == {50}


def test_fixed_windows_are_aligned_to_the_epoch(spark):
    rows = spark.createDataFrame([("k", NOW + timedelta(seconds=s)) for s in (58, 59, 60, 61)], "k string, ts timestamp")
    found = ledger.fixed_window(rows, ["k"], "ts", [], 60, 1).orderBy("ts").collect()
    assert [(r.allowed, r.retryAfter) for r in found] == [(True, 0), (False, 1), (True, 0), (False, 59)]


@pytest.mark.parametrize(
    ("body", "decision", "reason", "events", "upserts"),
    [
        (payload(), "DISPATCH", None, ["r1", "r2"], 2),
        (payload(draft=True), "DISPATCH", None, ["r2"], 2),
        (payload("ready_for_review", draft=True), "DISPATCH", None, ["r1", "r2"], 2),
        (payload("edited"), "PERSIST_ONLY", "EDITED_METADATA_ONLY", [], 2),
        (payload("closed"), "PERSIST_ONLY", "ACTION_NOT_TRIGGERING", [], 2),
        (payload("labeled"), "PERSIST_ONLY", "ACTION_NOT_TRIGGERING", [], 2),
        (payload(repo=8), "IGNORE", "NO_CONNECTED_REPOSITORY", [], 0),
        ({"action": "opened"}, "FAIL", "MALFORMED_PAYLOAD", [], 0),
        (payload(number="5"), "FAIL", "MALFORMED_PAYLOAD", [], 0),
        (payload(repository={"id": 7}), "FAIL", "MALFORMED_PAYLOAD", [], 0),
    ],
)
def test_router(spark, targets, body, decision, reason, events, upserts):
    rows = spark.createDataFrame([("d", json.dumps(body))], "deliveryId string, payload string")
    r = ledger.route_pull_requests(rows, targets).first()
    assert (r.decision, r.reason, [e.repositoryId for e in r.events], len(r.upserts)) == (decision, reason, events, upserts)
    assert all(e.prKey == f"{e.repositoryId}:5:h1" and e.installationId == "3" for e in r.events)


def test_drafts_are_skipped(spark, targets):
    rows = spark.createDataFrame([("d", json.dumps(payload(draft=True)))], "deliveryId string, payload string")
    r = ledger.route_pull_requests(rows, targets.where("repositoryId = 'r1'")).first()
    assert (r.decision, r.reason, r.status) == ("PERSIST_ONLY", "DRAFT_SKIPPED", "IGNORED")


def test_sync_effects(spark):
    rows = spark.createDataFrame([("1", "installation", "suspend"), ("2", "repository", "renamed"), ("3", "repository", "odd")], "deliveryId string, eventType string, action string")
    found = {r.deliveryId: (r.effect, r.reason) for r in ledger.sync_effects(rows).collect()}
    assert found == {"1": ("ACCESS_LOST", "INSTALLATION_SUSPENDED"), "2": ("RENAME", "REPOSITORY_RENAMED"), "3": ("NONE", "UNHANDLED_ACTION")}


def test_sweeper(spark):
    good = '[{"prKey": "k", "repositoryId": "r", "projectId": "p"}]'
    rows = [("a", "PENDING", 61, good), ("b", "PENDING", 59, good), ("c", "PENDING", 90, "[]"), ("d", "DISPATCHED", 99, good), ("e", "PENDING", 80, None), ("f", "PENDING", 70, '[{"prKey": 1, "repositoryId": "r"}]')]
    df = spark.createDataFrame([(i, s, NOW - timedelta(seconds=a), p) for i, s, a, p in rows], "deliveryId string, status string, createdAt timestamp, dispatchPayload string")
    found = ledger.sweep_pending(df, F.lit(NOW))
    assert [(r.deliveryId, r.sweep, r.error) for r in found.collect()] == [("c", "FAILED", "UNSWEEPABLE_DISPATCH_PAYLOAD"), ("e", "FAILED", "UNSWEEPABLE_DISPATCH_PAYLOAD"), ("f", "FAILED", "UNSWEEPABLE_DISPATCH_PAYLOAD"), ("a", "REPLAY", None)]
    assert [(r.deliveryId, r.prKey) for r in ledger.replayed_events(found).collect()] == [("a", "k")]
    assert ledger.sweep_pending(df, F.lit(NOW), limit=1).count() == 1


def part(spark, folder, table):
    return spark.read.parquet(f"{folder}/{table}")


def test_stream_counts_and_dedups_over_batches(spark, tables, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    frame = lambda *rows: spark.createDataFrame(list(rows), DELIVERY)
    frame(delivery("a"), delivery("b", body=payload("closed", sha="h2"), at=5), delivery("x", event="issues")).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ledger.ingest_stream(spark.readStream.schema(frame(delivery("a")).schema).parquet(source), *tables, SECRET, folder, f"file://{tmp_path}/ck").awaitTermination()
    run()
    frame(delivery("a"), delivery("c", event="repository", body=payload("renamed"), at=9)).coalesce(1).write.mode("append").parquet(source)
    run()
    rows = {r.deliveryId: r for r in part(spark, folder, "ledger").collect()}
    assert part(spark, folder, "ledger").count() == 3 == len(rows)
    assert {k: (r.status, r.error) for k, r in rows.items()} == {"a": ("PENDING", None), "b": ("IGNORED", "ACTION_NOT_TRIGGERING"), "c": ("IGNORED", "REPOSITORY_RENAMED")}
    assert part(spark, folder, "outbox").count() == 2
    latest = {(r.repositoryId, r.headSha) for r in ledger.current_pull_requests(part(spark, folder, "pull_requests")).collect()}
    assert latest == {("r1", "h2"), ("r2", "h2")}
    assert [(r.installationId, r.n) for r in ledger.rate_counts(spark, folder).snapshot().collect()] == [(3, 4)]


def test_rate_limit_counts_on_over_batches(spark, tables, tmp_path):
    folder = f"file://{tmp_path}/out"
    batch = lambda k: spark.createDataFrame([delivery(f"d{k}-{i:03}", at=10 * k + i * 0.1) for i in range(60)] + [delivery(f"late{k}", at=60 + k)], DELIVERY)
    for k in range(3):
        ledger.ingest_batch(batch(k), *tables, SECRET, folder, k)
    passed = [r.deliveryId for r in part(spark, folder, "ledger").collect()]
    assert len(passed) == 103 and sum(i.startswith("late") for i in passed) == 3
    assert sum(i.startswith("d1") for i in passed) == 40 and not any(i.startswith("d2") for i in passed)


def test_a_batch_that_failed_between_writes_is_repeated(spark, tables, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/out"
    batch = spark.createDataFrame([delivery("a"), delivery("b", body=payload(sha="h2"), at=5), delivery("s", event="installation_repositories", body=removed(7), at=1)], DELIVERY)
    whole = ledger._write

    for failing in ("pull_requests", "ledger"):

        def broken(rows, folder, table, *more, failing=failing):
            if table == failing:
                raise RuntimeError("lost")
            whole(rows, folder, table, *more)

        monkeypatch.setattr(ledger, "_write", broken)
        with pytest.raises(RuntimeError):
            ledger.ingest_batch(batch, *tables, SECRET, folder, 0)
    monkeypatch.setattr(ledger, "_write", whole)
    put = KeyedTable.put
    for failing in ("connections", "rates"):

        def lost(self, *more, failing=failing):
            if self.root.endswith(failing):
                raise RuntimeError("lost")
            return put(self, *more)

        monkeypatch.setattr(KeyedTable, "put", lost)
        with pytest.raises(RuntimeError):
            ledger.ingest_batch(batch, *tables, SECRET, folder, 0)
    monkeypatch.setattr(KeyedTable, "put", put)
    for _ in range(2):
        ledger.ingest_batch(batch, *tables, SECRET, folder, 0)
    assert [part(spark, folder, t).count() for t in ("ledger", "outbox", "pull_requests", "effects")] == [3, 4, 2, 1]
    assert [t(spark, folder).snapshot().count() for t in (ledger.known_deliveries, ledger.rate_counts, ledger.connections)] == [3, 1, 1]


def test_effects_fold_to_the_last_of_each_object(spark, tables, tmp_path):
    """A late effect of a later batch does not undo what came after it."""
    folder = f"file://{tmp_path}/out"
    one = lambda i, action, at: spark.createDataFrame([delivery(i, "repository", payload(action) | {"repository": {"id": 7, "full_name": "x/y", "name": "y", "owner": {"login": "x"}, "html_url": "v"}}, at=at)], DELIVERY)
    for k, (action, at) in enumerate([("unarchived", 9), ("deleted", 5), ("renamed", 7)]):
        ledger.ingest_batch(one(f"d{k}", action, at), *tables, SECRET, folder, k)
    held = {r["sort"]: r for r in ledger.connections(spark, folder).snapshot().collect()}
    assert {k: (r.effect, r.deliveryId) for k, r in held.items()} == {"ACCESS": ("RESTORE", "d0"), "RENAME": ("RENAME", "d2")}
    assert part(spark, folder, "effects").count() == 3


def removed(*ids):
    repos = [{"id": i, "full_name": "o/r", "name": "r", "owner": {"login": "o"}, "html_url": "u"} for i in ids]
    return {"action": "removed", "installation": {"id": 3}, "repositories_removed": repos}


def test_effects_reach_connections(spark, tables, tmp_path):
    folder = f"file://{tmp_path}/out"
    account = {"id": 3, "account": {"login": "new", "type": "User"}, "suspended_at": None}
    rows = [
        delivery("1", "installation_repositories", removed(7, 9), at=1), delivery("2", "repository", payload("renamed") | {"repository": {"id": 8, "full_name": "x/y", "name": "y", "owner": {"login": "x"}, "html_url": "v"}}, at=2),
        delivery("3", "installation", {"action": "suspend", "installation": account}, at=3), delivery("4", "installation", {"action": "created", "installation": account | {"id": 99}}, at=4),
        delivery("5", "repository", {"action": "deleted", "repository": {"id": 8}}, at=5), delivery("6", "installation_repositories", {"action": "added", "installation": {"id": 3}}, at=6),
    ]
    repos = tables[0].withColumns({"owner": F.lit("o"), "name": F.lit("r"), "fullName": F.lit("o/r"), "htmlUrl": F.lit("u")})
    ledger.ingest_batch(spark.createDataFrame(rows, DELIVERY), repos, tables[1], SECRET, folder, 0)
    effects = part(spark, folder, "effects")
    assert {r.deliveryId: (r.status, r.error) for r in part(spark, folder, "ledger").where("deliveryId IN (4, 5, 6)").collect()} == {
        "4": ("IGNORED", "INSTALLATION_CREATED_UPDATED"), "5": ("FAILED", "MALFORMED_PAYLOAD"), "6": ("IGNORED", "INSTALLATION_REPOSITORIES_ADDED"),
    }
    assert sorted((r.deliveryId, r.installationId, r.githubRepoId) for r in effects.collect()) == [("1", None, 7), ("1", None, 9), ("2", None, 8), ("3", 3, None), ("4", 99, None)]
    after = {r.id: r for r in ledger.apply_connection_effects(repos, effects).collect()}
    assert {k: r.connectionStatus for k, r in after.items()} == {"r1": "ACCESS_LOST", "r2": "ACCESS_LOST", "r3": "ACCESS_LOST", "r4": "DISCONNECTED"}
    assert after["r4"].fullName == "x/y" and after["r1"].fullName == "o/r"
    held = spark.createDataFrame([(3, "old", "User", None)], "installationId long, accountLogin string, accountType string, suspendedAt timestamp")
    snapshot, missing = ledger.apply_installation_effects(held, effects)
    assert snapshot.first().suspendedAt == NOW + timedelta(seconds=3) and snapshot.first().accountLogin == "old"
    assert [tuple(r) for r in missing.collect()] == [("4", "INSTALLATION_CREATED_NO_EXISTING_ROW")]


@pytest.mark.parametrize(
    ("event", "body", "valid"),
    [
        ("installation", {"action": "x", "installation": {"id": 1, "account": {"login": "a", "type": "b"}}}, True), ("installation", {"action": "x", "installation": {"id": 1}}, False),
        ("installation_repositories", {"action": "x", "installation": {"id": 1.5}}, True), ("installation_repositories", {"action": 3, "installation": {"id": 1}}, False),
        ("repository", payload(), True), ("repository", {"action": "x"}, False), ("ping", {}, True), ("ping", [1], False), ("pull_request", payload(), True),
        ("pull_request", payload(pull_request=payload()["pull_request"] | {"state": "merged"}), False),
    ],
)
def test_payload_schemas(spark, event, body, valid):
    rows = spark.createDataFrame([(json.dumps(body),)], "payload string")
    assert rows.select(ledger.is_valid(event, F.col("payload"))).first()[0] is valid
