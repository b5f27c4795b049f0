"""Fan-outs that must not be written out: as many deliveries as tenants of one repository, or requests as accounts."""

import json
import random

from pyspark.sql import functions as F

from graphloom import queries
from graphloom.operators import listing
from graphloom.operators.resolve import resolve_names
from graphloom.operators.search import SearchIndex
from graphloom.streaming import ledger
from tests.test_ledger import payload, tables, targets  # noqa: F401 - fixtures

BODIES = [
    payload(), payload(draft=True), payload("ready_for_review", draft=True), payload("edited"), payload("closed"), payload("labeled"), payload(repo=8), payload(repo=99), {"action": "opened"},
    payload(number="5"), payload(repository={"id": 7}), payload(sha="h2"),
]


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_router_counts_equal_its_lists(spark, targets):  # noqa: F811
    rows = spark.createDataFrame([(f"d{k}", json.dumps(b)) for k, b in enumerate(BODIES)] + [("none", None), ("odd", "{oops")], "deliveryId string, payload string")
    for some in (targets, targets.where("repositoryId = 'r1'"), targets.limit(0)):
        listed = ledger.route_pull_requests(rows, some).withColumns({"events": F.size("events"), "upserts": F.size("upserts")})
        assert sorted(map(str, ledger.count_routes(rows, some).collect())) == sorted(map(str, listed.collect()))


def test_pr_router_makes_no_lists_of_tenants(spark):
    assert "collect_list" not in plan(queries.QUERIES["pr_router"](spark, "/root/testdata/sf0.001"))


def test_latest_pull_requests_equal_the_upserts_of_all_routes(spark, targets):  # noqa: F811
    made = [payload(number=n, sha=f"h{k}", repo=7 + (k % 5 == 4)) for k, n in enumerate((5, 5, 6, 5, 6, 7, 5, None))] + [{"action": "opened"}]
    rows = [(f"d{k}", json.dumps(b), 100 - k % 4) for k, b in enumerate(made)] + [("none", None, 999)]
    rows = spark.createDataFrame(rows, "deliveryId string, payload string, receivedAt long")
    # r1 is listed under a second GitHub repository as well
    several = targets.unionByName(targets.where("repositoryId = 'r1'").withColumn("githubRepoId", F.lit(8).cast("long")))
    routed = ledger.route_pull_requests(rows, several).join(rows.select("deliveryId", "receivedAt"), "deliveryId")
    last = {}
    for r in sorted(routed.collect(), key=lambda r: (r.receivedAt, r.deliveryId)):
        last |= {(u.repositoryId, u.number): (*u, r.receivedAt, r.deliveryId) for u in r.upserts}
    found = ledger.latest_pull_requests(rows, several).select("repositoryId", "number", "githubPrId", "headSha", "state", "isDraft", "receivedAt", "deliveryId")
    assert sorted(map(tuple, found.collect())) == sorted(last.values()) and len(last) == 6


def test_pull_request_upsert_makes_no_row_a_delivery_and_tenant(spark):
    assert "Generate" not in plan(queries.QUERIES["pull_request_upsert"](spark, "/root/testdata/sf0.001"))


def test_connect_targets_meet_one_row_a_request(spark):
    asked = spark.range(600).select(F.col("id").alias("requestId"), F.lit("u").alias("userId"), F.when(F.col("id") % 2 == 0, F.lit("https://github.com/Acme/x")).alias("repoUrl"), F.when(F.col("id") % 2 == 1, F.col("id")).alias("githubRepoId"))
    own = spark.range(900).select(F.lit("u").alias("userId"), F.col("id").alias("installationId"), F.lit("acme").alias("accountLogin"))
    seen = spark.range(900).select((F.col("id") % 40).alias("installationId"), F.col("id").alias("githubRepoId"), F.lit("o").alias("owner"), F.lit("n").alias("name"))
    found = listing.connect_targets(asked, own, seen)
    # each account and each repository that a user sees is one row before requests meet it
    assert sum("Aggregate [userId" in x or "Aggregate [u," in x for x in found._jdf.queryExecution().analyzed().toString().splitlines()) == 2
    rows = found.collect()
    assert {tuple(r)[1:] for r in rows if r.requestId % 2 == 0} == {(0, "Acme", "x", None)}
    assert len(rows) == 600 and all(tuple(r)[1:] == (r.requestId % 40, "o", "n", None) for r in rows if r.requestId % 2)


def test_search_meets_distinct_texts(spark, tmp_path):
    names = ["Red bolt", "red BOLT", "blue ring", None, "ab"]
    rows = spark.createDataFrame([(k, names[k % 5]) for k in range(500)], "id long, name string")
    patterns = [(k, p) for k in range(40) for p in ("BOLT", "e ri", "d", "none", "")]
    index = SearchIndex(spark, f"file://{tmp_path}/s", "id", "name", folders=4)
    index.build(rows)
    # six trigrams of the one, seven of the other text, however many rows have them
    assert spark.read.parquet(f"file://{tmp_path}/s/postings").count() == 13
    found = index.search(rows, spark.createDataFrame(patterns, "patternId long, pattern string"))
    expected = [(n, k) for n, p in patterns for k in range(500) if names[k % 5] is not None and p.lower() in names[k % 5].lower()]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_sites_meet_the_first_import_of_their_name(spark):
    made = random.Random(5)
    symbols = [("r", k, k, f"n{k % 6}", "FUNCTION", None, f"d/f{k % 9}.ts", None) for k in range(40)]
    imports = [("r", f"d/f{made.randrange(5)}.ts", k, [f"n{made.randrange(6)}", f"n{made.randrange(6)}"], None, None, made.random() < 0.2, f"d/f{made.randrange(9)}.ts") for k in range(60)]
    sites = [("r", k, k, f"d/f{made.randrange(5)}.ts", None, f"n{made.randrange(6)}", None, None) for k in range(80)]
    frames = (
        spark.createDataFrame(sites, "repositoryId string, siteId long, fromSymbolId long, filePath string, packageName string, name string, receiver string, callerClass string"),
        spark.createDataFrame(symbols, "repositoryId string, id long, ordinal long, name string, kind string, parentSymbol string, filePath string, packageName string"),
        spark.createDataFrame(imports, "repositoryId string, filePath string, ordinal long, named array<string>, default string, namespace string, isTypeOnly boolean, targetFilePath string"),
        spark.createDataFrame([("r", False)], "repositoryId string, perPackage boolean"),
    )
    found = resolve_names(*frames)
    # no site looks through a list of all that its file imports
    assert "array_contains" not in plan(found)
    least = lambda file, name: min((s[2], s[1]) for s in symbols if s[6] == file and s[3] == name)[1] if any(s[6] == file and s[3] == name for s in symbols) else None
    expected = {}
    for _, site, _, file, _, name, _, _ in sites:
        target = next((i[7] for i in imports if i[1] == file and name in i[3] and not i[6]), None)
        near, told = least(file, name), least(target, name)
        if near is not None or told is not None:
            expected[site] = ("SAME_FILE", near) if near is not None else ("NAMED_IMPORT", told)
    rows = {r.siteId: (r.rule, r.toSymbolId) for r in found.collect() if r.rule in ("SAME_FILE", "NAMED_IMPORT")}
    assert rows == expected and {rule for rule, _ in rows.values()} == {"SAME_FILE", "NAMED_IMPORT"}


def test_heritage_ladder_searches_no_lists_of_imports(spark):
    assert "array_contains" not in plan(queries.QUERIES["heritage_ladder"](spark, "/root/testdata/sf0.001"))
