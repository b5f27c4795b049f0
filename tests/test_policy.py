import json

from pyspark.sql import functions as F

from graphloom.functions import policy
from graphloom.streaming import ledger


def test_failures_and_retries(spark):
    rows = spark.createDataFrame([(401, False), (404, True), (403, False), (403, True), (500, None)], "status int, limited boolean")
    assert [r.v for r in rows.select(policy.failure_reason(F.col("status"), F.col("limited")).alias("v")).collect()] == ["UNAUTHENTICATED", "NOT_ACCESSIBLE", "NOT_ACCESSIBLE", "UNAVAILABLE", "UNAVAILABLE"]
    rows = spark.createDataFrame([(30, 1), (31, 0), (1, 2)], "wait int, retries int")
    assert [r.v for r in rows.select(policy.may_retry(F.col("wait"), F.col("retries")).alias("v")).collect()] == [True, False, False]


def test_usability_and_triggers(spark):
    rows = spark.createDataFrame([(0, None, None), (0, "main", "EMPTY"), (0, "main", "OK"), (512001, "main", None), (9, None, None), (512000, "main", None)], "size int, branch string, probe string")
    found = [r.v for r in rows.select(policy.unusable_reason(F.col("size"), F.col("branch"), F.col("probe")).alias("v")).collect()]
    assert found == ["EMPTY_REPOSITORY", "EMPTY_REPOSITORY", None, "REPOSITORY_TOO_LARGE", "DEFAULT_BRANCH_UNRESOLVABLE", None]
    rows = spark.createDataFrame([("INCREMENTAL", True, "INDEXED"), ("FULL", False, "INDEXING"), ("FULL", True, "INDEXING"), ("FULL", True, "FAILED")], "m string, a boolean, s string")
    assert [r.v for r in rows.select(policy.index_refusal(F.col("m"), F.col("a"), F.col("s")).alias("v")).collect()] == ["UNSUPPORTED_MODE", "RATE_LIMITED", "ALREADY_INDEXING", None]


def test_redaction(spark):
    text = json.dumps({"accessToken": "x", "key": "cache", "a": [{"API-KEY": "y", "n": 1}], "DEPLOY_KEY": 2})
    rows = spark.createDataFrame([(text,), (None,), ("{bad",)], "t string")
    found = [r.v for r in rows.select(policy.redact_json("t").alias("v")).collect()]
    assert json.loads(found[0]) == {"accessToken": "[REDACTED]", "key": "cache", "a": [{"API-KEY": "[REDACTED]", "n": 1}], "DEPLOY_KEY": "[REDACTED]"} and found[1:] == [None, None]


def test_fetch_follows_one_host_without_the_credential():
    seen = []

    def get(url, headers):
        seen.append((url, "authorization" in headers))
        return policy.Answer(302, {"Location": "https://codeload.github.com/o/r"}) if len(seen) == 1 else policy.Answer(200, {}, b"tar")

    assert policy.fetch_archive(get, "https://api.github.com/x", "t") == (b"tar", None)
    assert seen == [("https://api.github.com/x", True), ("https://codeload.github.com/o/r", False)]
    answer = lambda *a: policy.fetch_archive(lambda url, headers: policy.Answer(*a), "u", "t")[1]
    assert answer(302, {"location": "https://evil.example/codeload.github.com/"}) == "UNEXPECTED_REDIRECT"
    assert [answer(s, h) for s, h in ((404, {}), (401, {}), (403, {}), (403, {"Retry-After": "1"}), (429, {"x-ratelimit-remaining": "0"}), (500, {}))] == [
        "REPO_NOT_FOUND", "ACCESS_REVOKED", "ACCESS_REVOKED", "RATE_LIMITED", "RATE_LIMITED", "UNAVAILABLE",
    ]


def test_connection_effects(spark):
    repos = spark.createDataFrame([("a", 1, 10, "ACTIVE"), ("b", 1, 11, "DISCONNECTED"), ("c", 2, 12, "ACCESS_LOST"), ("d", 3, 13, "ACTIVE")], "id string, installationId long, githubRepoId long, connectionStatus string")
    effects = spark.createDataFrame(
        [(1, None, "ACCESS_LOST", 1, "x"), (None, 10, "RESTORE", 2, "y"), (1, None, "ACCESS_LOST", 3, "z"), (2, None, "RESTORE", 1, "w"), (None, 13, "RENAME", 1, "v")],
        "installationId long, githubRepoId long, effect string, receivedAt int, deliveryId string",
    )
    found = {r.id: r.connectionStatus for r in ledger.apply_connection_effects(repos, effects).collect()}
    assert found == {"a": "ACCESS_LOST", "b": "DISCONNECTED", "c": "ACTIVE", "d": "ACTIVE"}


def test_repository_reads():
    import json

    from graphloom.functions.policy import Answer
    from graphloom.sources import connector

    seen = []

    def answering(status, body=b"", headers=None):
        def get(url, _):
            seen.append(url)
            return Answer(status, headers or {}, body if isinstance(body, bytes) else json.dumps(body).encode())

        return get

    good = {"id": 7, "owner": {"login": "o"}, "name": "r", "full_name": "o/r", "default_branch": "main", "private": False, "html_url": "u", "size": 12}
    found, reason = connector.repository_metadata(answering(200, good), "o", "r")
    assert reason is None and (found["githubRepoId"], found["owner"], found["sizeKib"], found["defaultBranch"]) == (7, "o", 12, "main") and seen == ["/repos/o/r"]
    bare, _ = connector.repository_metadata(answering(200, {"id": 7, "owner": {"login": "o"}, "name": "r", "default_branch": ""}), "o", "r")
    assert (bare["fullName"], bare["defaultBranch"], bare["isPrivate"], bare["sizeKib"], bare["archived"]) == ("o/r", None, True, 0, False)
    reads = [lambda g: connector.repository_metadata(g, "o", "r"), lambda g: connector.head_commit(g, "o", "r", "b")]
    for read in reads:
        assert [read(g)[1] for g in (answering(401), answering(404), answering(403), answering(403, headers={"Retry-After": "1"}), answering(500), answering(200, b"{"), answering(200, [1]), answering(200, {}))] == [
            "UNAUTHENTICATED", "NOT_ACCESSIBLE", "NOT_ACCESSIBLE", "UNAVAILABLE", "UNAVAILABLE", "UNAVAILABLE", "UNAVAILABLE", "UNAVAILABLE",
        ]
    assert connector.head_commit(answering(200, {"sha": "s"}), "o", "r", "b") == ("s", None)
    assert [connector.probe_branch(answering(s), "o", "r", "b") for s in (200, 404, 500)] == ["HAS_COMMITS", "EMPTY", "UNKNOWN"]
