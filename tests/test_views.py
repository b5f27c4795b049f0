import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from graphloom.functions.policy import Answer
from graphloom.operators import jobs, listing, state
from graphloom.sources import archives, connector
from graphloom.streaming import ledger

JOB = (
    "jobId string, seq int, at int, event string, repositoryId string, mode string, runId string, step string, progressPercent int, targetCommitSha string, "
    "previousCommitSha string, code string, message string, filesTotal int, filesProcessed int, filesSkipped int, symbolsCreated int, edgesCreated int"
)


def job(job_id, seq, event, **given):
    names = [x.split()[0] for x in JOB.split(", ")]
    return tuple((dict.fromkeys(names) | {"jobId": job_id, "seq": seq, "at": 10 * seq, "event": event} | given)[n] for n in names)


def test_jobs_fold_to_their_last_state(spark):
    events = [
        job("a", 1, "CREATED", repositoryId="r", mode="FULL", runId="x"), job("a", 2, "PROGRESS", step="fetch", progressPercent=20, targetCommitSha="s", filesTotal=9),
        job("a", 3, "RETRIED"), job("a", 4, "PROGRESS", step="parse", progressPercent=50), job("a", 5, "SUCCEEDED", filesTotal=10, filesProcessed=7, filesSkipped=3, symbolsCreated=4),
        job("b", 1, "CREATED", repositoryId="r"), job("b", 2, "FAILED", code="REPO_TOO_LARGE", message="m"),
        job("c", 1, "CREATED", repositoryId="q"), job("c", 2, "UNCHANGED"), job("d", 1, "CREATED", repositoryId="q"), job("e", 4, "PROGRESS", step="lost"),
    ]
    found = {r.jobId: r for r in jobs.fold_jobs(spark.createDataFrame(events, JOB)).collect()}
    assert set(found) == set("abcd")
    a, b, c, d = (found[k] for k in "abcd")
    assert (a.status, a.currentStep, a.progressPercent, a.attempts, a.filesTotal, a.filesProcessed, a.symbolsCreated, a.edgesCreated, a.targetCommitSha) == ("SUCCEEDED", "completed", 100, 2, 10, 7, 4, 0, "s")
    assert (a.startedAt, a.completedAt, a.error) == (10, 50, None)
    assert (b.status, b.currentStep, b.progressPercent, b.error) == ("FAILED", "failed", 0, '{"code":"REPO_TOO_LARGE","message":"m"}')
    assert (c.status, c.currentStep) == ("SUCCEEDED", "no-op-already-indexed")
    assert (d.status, d.currentStep, d.completedAt) == ("RUNNING", "acquire-lock", None)
    assert jobs.fold_jobs(spark.createDataFrame([], JOB)).count() == 0


def test_transitions_keep_what_they_do_not_set(spark):
    rows = spark.createDataFrame([("a", "PENDING", None, "old", None), ("b", "PENDING", None, None, None)], "deliveryId string, status string, dispatchedAt int, dispatchPayload string, error string")
    moves = [("a", 2, 7, "DISPATCHED", "p", None, None, None), ("a", 1, 6, "FAILED", None, None, "C", "m"), ("b", 1, 5, "PAYLOAD", "q", None, None, None), ("z", 1, 1, "IGNORED", None, "R", None, None)]
    moves = spark.createDataFrame(moves, "deliveryId string, seq int, at int, to string, payload string, reason string, code string, message string")
    found = {r.deliveryId: tuple(r)[1:] for r in ledger.apply_transitions(rows, moves).collect()}
    assert found == {"a": ("DISPATCHED", 7, "p", '{"code":"C","message":"m"}'), "b": ("PENDING", None, "q", None)}


def test_events_are_sent_once(spark):
    rows = spark.createDataFrame([("k", "x"), ("k", "x"), ("l", "y")], "prKey string, repositoryId string")
    assert [r.prKey for r in ledger.new_events(rows, spark.createDataFrame([("l",)], "prKey string")).collect()] == ["k"]
    assert ledger.new_events(rows, None).count() == 2


def test_installations(spark):
    kinds = "installationId long, accountLogin string, accountType string, userId string, suspendedAt timestamp"
    now = datetime.datetime(2024, 1, 1)
    current = spark.createDataFrame([(1, "a", "User", "u", None), (2, "b", "User", "u", now)], kinds)
    changes = spark.createDataFrame([(1, "A", "Organization", "v", now), (3, "c", "User", "v", None)], kinds)
    pick = lambda rows: sorted((r.installationId, r.accountLogin, r.userId, r.suspendedAt is not None) for r in rows.collect())
    assert pick(state.upsert_installations(current, changes)) == [(1, "A", "v", True), (2, "b", "u", True), (3, "c", "v", False)]
    updated, missing = state.update_installations(current, changes)
    assert pick(updated) == [(1, "A", "u", True), (2, "b", "u", True)]
    assert [(r.installationId, r.result) for r in missing.collect()] == [(3, "NOT_FOUND")]
    assert pick(state.set_suspended(current, spark.createDataFrame([(2, None)], "installationId long, suspendedAt timestamp"))) == [(1, "a", "u", False), (2, "b", "u", False)]
    assert [tuple(r) for r in listing.installation_view(listing.installations_of(current, "u")).select("installationId", "suspended").collect()] == [("1", False), ("2", True)]


def test_connect_targets(spark):
    asked = [("url", "u", "https://github.com/ACME/app.git", None), ("id", "u", None, 7), ("both", "u", "https://github.com/a/b", 7), ("none", "u", None, None), ("bad", "u", "x", None), ("foreign", "u", "https://github.com/other/b", None), ("unseen", "w", None, 7)]
    asked = spark.createDataFrame(asked, "requestId string, userId string, repoUrl string, githubRepoId long")
    own = spark.createDataFrame([("u", 2, "zed"), ("u", 1, "acme"), ("w", 3, "w")], "userId string, installationId long, accountLogin string")
    seen = spark.createDataFrame([(2, 7, "zed", "n"), (1, 7, "acme", "n"), (9, 7, "q", "n")], "installationId long, githubRepoId long, owner string, name string")
    found = {r.requestId: tuple(r)[1:] for r in listing.connect_targets(asked, own, seen).collect()}
    gone = (None, None, None)
    assert found == {
        "url": (1, "ACME", "app", None), "id": (1, "acme", "n", None), "both": (*gone, "EXACTLY_ONE_TARGET"), "none": (*gone, "EXACTLY_ONE_TARGET"), "bad": (*gone, "INVALID_URL"),
        "foreign": (*gone, "NO_ACCESS"), "unseen": (*gone, "NO_ACCESS"),
    }


def test_free_slugs(spark):
    taken = spark.createDataFrame([("u", "api"), ("u", "api-4"), ("u", "api-x"), ("u", "web-2"), ("v", "api")], "userId string, slug string")
    wanted = spark.createDataFrame([(1, "u", "api"), (2, "u", "web"), (3, "v", "api"), (4, "w", "api")], "key int, userId string, base string")
    assert sorted(tuple(r) for r in listing.free_slugs(wanted, taken).collect()) == [(1, "api-5"), (2, "web"), (3, "api-2"), (4, "api")]


def test_lists(spark):
    rows = spark.createDataFrame([("p", 5, 8, "ACTIVE", 1, "b"), ("p", 5, 8, "odd", 1, "c"), ("p", 5, 8, "DISCONNECTED", 9, "d"), ("q", 5, 8, "ACTIVE", 1, "e")], "projectId string, installationId long, githubRepoId long, connectionStatus string, at long, id string")
    rows = rows.withColumn("createdAt", F.timestamp_seconds("at"))
    found = listing.repository_view(listing.repositories_of(rows, "p")).select("id", "installationId", "connectionStatus", "createdAt").collect()
    assert [tuple(r) for r in found] == [("c", "5", "ACTIVE", "1970-01-01T00:00:01.000Z"), ("b", "5", "ACTIVE", "1970-01-01T00:00:01.000Z")]
    rows = spark.range(40).select(F.col("id").alias("deliveryId"), (F.col("id") % 2).alias("createdAt"), F.lit("o/r").alias("repositoryFullName"))
    assert [r.deliveryId for r in listing.recent_deliveries(rows, "o/r").collect()] == list(range(39, 10, -2))


def test_tree(spark, tmp_path):
    for name in ("a.ts", "b/c.ts", "node_modules/x.js"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        assert sorted((r.path, r.size, bytes(r.content).decode()) for r in archives.read_tree(spark, root).collect()) == [("a.ts", 4, "a.ts"), ("b/c.ts", 6, "b/c.ts"), ("node_modules/x.js", 17, "node_modules/x.js")]
    assert archives.read_tree(spark, str(tmp_path), content=False).columns == ["path", "size"]
    (tmp_path / "b" / "d.lock").write_text("")
    (tmp_path / "b" / "e" / "f").mkdir(parents=True)
    (tmp_path / "b" / "e" / "f" / "empty.ts").write_text("")
    kept = {r.path: (r.size, r.hardIgnored, r.content) for r in archives.read_kept(spark, f"file://{tmp_path}").collect()}
    assert kept == {"a.ts": (4, False, b"a.ts"), "b/c.ts": (6, False, b"b/c.ts"), "b/d.lock": (0, True, None), "b/e/f/empty.ts": (0, False, b""), "node_modules/x.js": (17, True, None)}
    assert sorted((r.path, len(r.content)) for r in archives.read_tree(spark, str(tmp_path)).collect()) == [("a.ts", 4), ("b/c.ts", 6), ("b/d.lock", 0), ("b/e/f/empty.ts", 0), ("node_modules/x.js", 17)]
    for name in (".gitattributes", "_app.ts", "__tests__/a.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    shutil.rmtree(tmp_path / "b")
    assert sorted(r.path for r in archives.read_kept(spark, str(tmp_path)).where("content IS NOT NULL").collect()) == [".gitattributes", "__tests__/a.ts", "_app.ts", "a.ts"]


def test_pages_stop_at_a_short_one():
    asked = []
    fetch = lambda page, size: asked.append(page) or list(range(size if page < 3 else 1))
    assert len(list(connector.paged(fetch, 5))) == 11 and asked == [1, 2, 3]
    assert len(list(connector.paged(lambda page, size: [0] * size, 2, 4))) == 8


def test_not_modified_answers_from_the_store():
    store, clock, sent = {}, [0.0], []

    def get(url, headers):
        sent.append(headers.get("if-none-match"))
        return Answer(304, {}) if sent[-1] else Answer(200, {"ETag": "t"}, b"x")

    call = lambda: connector.conditional_get(get, store, "s", "u", lambda: clock[0])
    assert [(call().status, call().body)] == [(200, b"x")] and sent == [None, "t"]
    clock[0] = 24 * 3600.0
    call()
    assert sent == [None, "t", None]


def test_tokens_are_kept_and_minting_is_tried_again():
    store, clock, minted, slept = {}, [0.0], [], []

    def mint(installation):
        minted.append(installation)
        if len(minted) < 3:
            raise OSError
        return f"t{len(minted)}", clock[0] + 600

    call = lambda: connector.cached_token(mint, store, 5, lambda: clock[0], slept.append)
    assert [call(), call()] == ["t3", "t3"] and slept == [0.25, 0.5]
    clock[0] = 540.0
    assert call() == "t4"

    def fail(installation):
        raise OSError

    with pytest.raises(OSError):
        connector.cached_token(fail, {}, 5, lambda: 0.0, slept.append)


def test_polling_and_health(spark):
    statuses = iter(["PENDING", "INDEXING", "INDEXED", "FAILED"])
    assert list(connector.until_final(lambda: next(statuses), sleep=lambda s: None)) == ["PENDING", "INDEXING", "INDEXED"]
    assert connector.healthy(spark)
