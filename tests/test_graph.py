import pytest
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.operators import graph, state


def edge(id, kind="IMPORTS", repo="r1", ff=None, tf=None, fs=None, ts=None, package=None, raw=None, resolution="RESOLVED", confidence=1.0):
    return (id, repo, kind, ff, tf, fs, ts, package, raw, resolution, confidence, "sha1")


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.CodeDependency)


def small(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def graph_tables(spark):
    files = small(spark, [("fa", "r1", "src/a.ts", 3, "OK"), ("fb", "r1", "src/b.ts", 3, "FAILED"), ("fx", "r2", "src/x.ts", 9, "OK")], "id string, repositoryId string, path string, inboundEdgeCount int, parseState string")
    symbols = small(spark, [("s1", "r1", "fa", "one"), ("s2", "r1", "fb", "two"), ("sx", "r2", "fx", "x")], "id string, repositoryId string, fileId string, name string")
    rows = edges(
        spark, edge("e1", "CALLS", fs="s1", ts="s2", confidence=0.9), edge("e2", "EXTENDS", fs="s2", ts="s2", confidence=0.95), edge("e3", "CONTAINS", ff="fa", ts="s2"),
        edge("e4", "CALLS", fs="gone", ts="s2"), edge("e5", "CALLS", repo="r2", fs="sx", ts="s2"), edge("e6", ff="fa", tf="fb"), edge("e7", ff="fa", package="p", resolution="EXTERNAL"), edge("e8", ff="fb", raw="./no", resolution="UNRESOLVED"),
    )
    return files, symbols, rows


def test_inbound_callers(spark, graph_tables):
    files, symbols, rows = graph_tables
    found = graph.inbound_callers(rows, symbols, files, "r1", ["s2"]).collect()
    assert [(r.dependencyId, r.symbolName, r.filePath) for r in found] == [("e2", "two", "src/b.ts"), ("e1", "one", "src/a.ts")]
    assert graph.inbound_callers(rows, symbols, files, "r1", []).collect() == []
    ids = small(spark, [("s2",), ("s2",)], "x string")
    assert graph.inbound_callers(rows, symbols, files, "r1", ids, limit=1).count() == 1


@pytest.mark.parametrize(
    ("pairs", "start", "depth", "expected"),
    [
        ([("a", "b"), ("b", "c")], "c", 2, {"b": 1, "a": 2}),
        ([("x", "y"), ("y", "x")], "x", 2, {"y": 1, "x": 2}),
        ([("x", "y"), ("y", "x")], "x", 9, {"y": 1, "x": 2}),
        ([("a", "b"), ("b", "c"), ("a", "c")], "c", 2, {"b": 1, "a": 1}),
        ([("a", "b"), ("b", "c"), ("c", "d")], "d", 2, {"c": 1, "b": 2}),
        ([("a", "b")], "a", 2, {}),
    ],
)
def test_importing_files(spark, pairs, start, depth, expected):
    rows = edges(spark, *(edge(f"e{i}", ff=a, tf=b) for i, (a, b) in enumerate(pairs)), edge("o", repo="r2", ff="z", tf=start))
    assert {r.fileId: r.depth for r in graph.importing_files(rows, "r1", start, depth).collect()} == expected


def test_importing_files_of_many(spark):
    rows = edges(spark, edge("1", ff="a", tf="b"), edge("2", ff="b", tf="c"))
    found = graph.importing_files(rows, "r1", small(spark, [("b",), ("c",)], "id string"), 2).collect()
    assert {(r.seed, r.fileId, r.depth) for r in found} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}


def test_summaries(spark, graph_tables):
    files, symbols, rows = graph_tables
    one = graph.knowledge_aggregates(files, symbols, rows, "r1").first()
    assert (one.files, one.symbols, one.edges, one.unresolvedImportRatio) == (2, 2, 7, pytest.approx(1 / 3))
    assert one.parseStates == {"OK": 1, "FAILED": 1} and one.edgesByKind["IMPORTS"] == 3
    assert [(x.path, x.inboundEdgeCount) for x in one.topFiles] == [("src/a.ts", 3), ("src/b.ts", 3)]
    assert [(x.specifier, x["count"]) for x in one.topUnresolved] == [("./no", 1)]
    none = graph.knowledge_aggregates(files, symbols, rows, "r9").first()
    assert (none.files, none.edges, none.unresolvedImportRatio, none.topFiles) == (0, 0, 0.0, [])


def test_inbound_counts(spark, graph_tables):
    _, symbols, rows = graph_tables
    assert {r.fileId: r.inboundEdgeCount for r in graph.inbound_edge_counts(rows, symbols, "r1").collect()} == {"fb": 5}


def test_edge_insert(spark):
    first = edges(spark, edge("1", ff="a", package="p", resolution="EXTERNAL"), edge("2", ff="a", package="q", resolution="EXTERNAL"), edge("3", ff="a", tf="b"))
    fresh, counts = graph.insert_edges(first.limit(0), first, ["id"])
    assert sorted(r.id for r in fresh.collect()) == ["1", "3"]  # null parts of an identity are equal
    assert {(r.kind, r.resolution): r.inserted for r in counts.collect()} == {("IMPORTS", "EXTERNAL"): 1, ("IMPORTS", "RESOLVED"): 1}
    assert graph.dedup_edges(first, ["id"], strict_identity=True).count() == 3
    again, counts = graph.insert_edges(fresh, edges(spark, edge("9", ff="a", tf="b"), edge("8", ff="a", tf="c")), ["id"])
    assert [r.id for r in again.collect()] == ["8"]


def test_pages_and_latest(spark):
    rows = small(spark, [(i, i // 2) for i in range(7)], "id int, createdAt int")
    page = graph.keyset_page(rows, 3, (2, 4)).collect()
    assert [r.id for r in page] == [3, 2, 1, 0]
    jobs = small(spark, [("r", "a", 1, "FAILED", 5), ("r", "b", 1, "RUNNING", 7)], "repositoryId string, id string, createdAt int, status string, progressPercent int")
    repos = small(spark, [("r", "PENDING"), ("q", "INDEXED")], "id string, indexStatus string")
    assert {r.repositoryId: (r.status, r.progressPercent) for r in graph.index_status(repos, jobs).collect()} == {"r": ("RUNNING", 7), "q": ("INDEXED", 0)}


def test_health_flags(spark):
    flags = lambda a, b, c, d: tuple(spark.range(1).select(graph.health_flags(F.lit(a), F.lit(b), F.lit(c), F.lit(d)).alias("h")).first().h)
    assert flags(0.6, 101, 0.2, 21) == (True, True) and flags(0.5, 101, 0.15, 21) == (False, False) and flags(0.6, 100, 0.2, 20) == (False, False)


FILE = "id string, repositoryId string, path string, commitSha string, sizeBytes int, parseState string"


def test_file_upsert_keeps_ids_and_graph_columns(spark):
    old = small(spark, [("1", "r", "a", "s1", 1, "OK"), ("2", "r", "b", "s1", 1, "OK")], FILE)
    new = small(spark, [("9", "r", "a", "s2", 5), ("8", "r", "c", "s2", 6)], "id string, repositoryId string, path string, commitSha string, sizeBytes int")
    found = {r.path: tuple(r) for r in state.upsert_files(old, new).collect()}
    assert found == {"a": ("1", "r", "a", "s2", 5, "OK"), "b": ("2", "r", "b", "s1", 1, "OK"), "c": ("8", "r", "c", "s2", 6, None)}
    kept, swept = state.sweep_stale_files(state.upsert_files(old, new), "r", "s2")
    assert sorted(r.path for r in kept.collect()) == ["a", "c"] and swept.first().swept == 1


def test_updates_and_guards(spark):
    rows = small(spark, [("1", "ACTIVE"), ("2", "ACCESS_LOST"), ("3", "DISCONNECTED")], "id string, connectionStatus string")
    for change, affected, expected in (
        (state.disconnect, 2, ["DISCONNECTED"] * 3),
        (state.access_lost, 1, ["ACCESS_LOST", "ACCESS_LOST", "DISCONNECTED"]),
        (state.restore_access, 1, ["ACTIVE", "ACTIVE", "DISCONNECTED"]),
    ):
        changed, count = change(rows, F.lit(True))
        assert [r.connectionStatus for r in changed.orderBy("id").collect()] == expected and count.first().affected == affected
    updated = state.update_from(rows, small(spark, [("2", None)], "id string, connectionStatus string"), "id", ["connectionStatus"])
    assert {r.id: r.connectionStatus for r in updated.collect()} == {"1": "ACTIVE", "2": None, "3": "DISCONNECTED"}
    inserted, refused = state.insert_unique(rows, small(spark, [("3", "x"), ("4", "y")], "id string, connectionStatus string"), ["id"], "ALREADY_CONNECTED")
    assert [r.id for r in inserted.collect()] == ["4"] and [(r.id, r.conflict) for r in refused.collect()] == [("3", "ALREADY_CONNECTED")]
    _, missing = state.update_if_exists(rows, small(spark, [("7", "z")], "id string, connectionStatus string"), ["id"], ["connectionStatus"])
    assert [(r.id, r.result) for r in missing.collect()] == [("7", "NOT_FOUND")]


def test_terminal_writes_and_partitions(spark, tmp_path):
    repos = small(spark, [("1", "INDEXING", None, None, "old")], "id string, indexStatus string, indexedCommitSha string, lastIndexedAt timestamp, indexError string")
    done = state.mark_indexed(repos, "1", "sha", F.current_timestamp()).first()
    assert (done.indexStatus, done.indexedCommitSha, done.indexError) == ("INDEXED", "sha", None)
    assert state.mark_failed(repos, "1", "UNKNOWN", "x").first().indexError == '{"code":"UNKNOWN","message":"x"}'
    path = f"file://{tmp_path}/edges"
    small(spark, [("r1", 1), ("r2", 2)], "repositoryId string, n int").write.partitionBy("repositoryId").parquet(path)
    state.overwrite_partitions(small(spark, [("r1", 9)], "repositoryId string, n int"), path)
    assert {r.repositoryId: r.n for r in spark.read.parquet(path).collect()} == {"r1": 9, "r2": 2}


def test_domains(spark):
    assert [r.v for r in small(spark, [("OK",), ("NO",), (None,)], "s string").select(schemas.in_domain("s", "ParseState").alias("v")).collect()] == [True, False, False]
