import io
import tarfile

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.operators import imports, inventory, resolve
from graphloom.plans.index import build_index
from graphloom.sources import archives, manifests

REPO = {
    "package.json": '{"name": "root-pkg", "private": true, "devDependencies": {"vitest": "^1"}} // comment',
    "pnpm-workspace.yaml": "packages:\n  - \"libs/*\"\n  - 'apps/web'\nother: x\n",
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["libs/lib/src/*"], "@lib/deep/*": ["libs/lib/deep/*"],},}, /* c */}',
    "apps/web/tsconfig.json": '{"extends": "../../tsconfig", "compilerOptions": {"paths": {"~/*": ["src/*"]}, "baseUrl": "./"}}',
    "apps/web/package.json": '{"name": "@x/web", "dependencies": {"react": "18"}, "imports": {"#own": {"default": "./src/own.ts"}}}',
    "libs/lib/package.json": '{"name": "@x/lib", "exports": {".": "./src/index.ts", "./sub/*": {"import": "./src/sub/*.ts"}}}',
    "libs/lib/src/index.ts": 'export * from "./math.js";\nexport { Base } from "./base";\n',
    "libs/lib/src/math.ts": "export function add(a: number, b: number) { return a + b }\nexport function twice(x: number) { return add(x, x) }\n",
    "libs/lib/src/base.ts": "export abstract class Base { run() { return this.step() } abstract step(): number }\nexport interface Shape { area(): number }\n",
    "libs/lib/src/sub/one.ts": "export const one = () => 1\n",
    "libs/lib/deep/a.ts": "export function render() { return 0 }\n",
    "apps/web/src/own.ts": "export function own() { return 1 }\n",
    "apps/web/src/main.ts": (
        'import { add } from "@x/lib";\nimport { one } from "@x/lib/sub/one";\nimport { own } from "#own";\nimport { Base } from "../../../libs/lib/src/base";\nimport React from "react";\nimport fs from "node:fs";\n'
        'import { helper } from "~/missing";\nimport "./gone";\n\nexport class Main extends Base {\n  step() { return add(one(), own()) }\n  go() { return this.run() }\n}\nexport function useMain() { return twice(2) }\n'
    ),
    "apps/web/src/main.test.ts": 'import { useMain } from "./main";\nimport { it } from "vitest";\nit("x", () => useMain());\n',
    "src/a/render.ts": "export function render() { return 1 }\n",
    "src/b/render.ts": "export function render() { return 2 }\n",
    "src/c/render.ts": "export function render() { return 3 }\n",
    "src/use.ts": "export function page() { return render() }\n",
    "src/broken.ts": "function foo( {\n  !!! ### nope\n  return 1\n",
    "README.md": "# hi\n",
    "node_modules/x/index.js": "module.exports = 1\n",
    "big.js": "x" * 600_000,
    "blob.ts": "a\x00b",
}


def entries(spark, repos=("r1",), files=None):
    rows = [(r, p, len(t.encode()), t.encode()) for r in repos for p, t in (files or REPO).items()]
    return spark.createDataFrame(rows, "repositoryId string, path string, size long, content binary")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("index")

    def cut(df, name):
        df.write.parquet(f"file://{folder}/{name}")
        return spark.read.parquet(f"file://{folder}/{name}")

    other = {"src/x.ts": "export function page() { return render() }\n", "src/y.ts": "export function render() {}\n"}
    return build_index(entries(spark).unionByName(entries(spark, ("r2",), other)), "sha", cut=cut)


def test_files(index):
    rows = {r.path: r for r in index.files.where("repositoryId = 'r1'").collect()}
    assert "node_modules/x/index.js" not in rows and len(rows) == len(REPO) - 1
    assert {p: rows[p].parseState for p in ("src/broken.ts", "README.md", "src/use.ts", "big.js")} == {"src/broken.ts": "FAILED", "README.md": "NOT_PARSED", "src/use.ts": "OK", "big.js": "NOT_PARSED"}
    assert (rows["big.js"].skipReason, rows["blob.ts"].skipReason) == ("SKIPPED_TOO_LARGE", "SKIPPED_BINARY")
    assert rows["apps/web/src/main.ts"].packageName == "@x/web" and rows["src/use.ts"].packageName == "root-pkg"
    assert rows["apps/web/src/main.ts"].inboundEdgeCount > 0 and rows["README.md"].inboundEdgeCount == 0


def named(index):
    symbols = {r.id: r for r in index.symbols.collect()}
    files = {r.id: r.path for r in index.files.collect()}
    return symbols, files, index.edges.collect()


def test_import_edges(index):
    _, files, edges = named(index)
    found = {(files[e.fromFileId], files.get(e.toFileId) or e.externalPackage or e.rawSpecifier, e.resolution) for e in edges if e.kind == "IMPORTS" and files[e.fromFileId].startswith(("apps", "libs"))}
    main = "apps/web/src/main.ts"
    expected = {
        (main, "libs/lib/src/index.ts", "RESOLVED"), (main, "libs/lib/src/sub/one.ts", "RESOLVED"), (main, "apps/web/src/own.ts", "RESOLVED"), (main, "libs/lib/src/base.ts", "RESOLVED"),
        ("libs/lib/src/index.ts", "libs/lib/src/math.ts", "RESOLVED"), ("libs/lib/src/index.ts", "libs/lib/src/base.ts", "RESOLVED"),
        ("apps/web/src/main.test.ts", main, "RESOLVED"), ("apps/web/src/main.test.ts", "vitest", "EXTERNAL"),
    }
    assert expected <= found
    # the identity of an edge lacks package, specifier and resolution: one row a file for all without a target
    assert sorted(r for f, _, r in found if f == main) == ["EXTERNAL"] + ["RESOLVED"] * 4
    assert index.attempted.where("kind = 'IMPORTS' AND resolution <> 'RESOLVED'").count() == 5


def test_call_and_heritage_edges(index):
    symbols, files, edges = named(index)
    calls = {(symbols[e.fromSymbolId].name, symbols[e.toSymbolId].name, files[symbols[e.toSymbolId].fileId], round(e.confidence, 4)) for e in edges if e.kind == "CALLS" and e.repositoryId == "r1"}
    assert ("twice", "add", "libs/lib/src/math.ts", 0.95) in calls
    assert ("step", "one", "libs/lib/src/sub/one.ts", 0.9) in calls and ("step", "own", "apps/web/src/own.ts", 0.9) in calls
    assert not any(a == "step" and b == "add" for a, b, _, _ in calls)  # a barrel is not followed, and the package index is per package
    assert ("run", "step", "libs/lib/src/base.ts", 0.95) in calls
    assert {(b, f, c) for a, b, f, c in calls if a == "page"} == {("render", f"src/{x}/render.ts", round(0.4 / 3, 4)) for x in "abc"}
    parents = [(symbols[e.fromSymbolId].name, symbols[e.toSymbolId].name, e.confidence) for e in edges if e.kind == "EXTENDS"]
    assert parents == [("Main", "Base", 0.9)]
    other = [(symbols[e.fromSymbolId].name, files[symbols[e.toSymbolId].fileId], e.confidence) for e in edges if e.kind == "CALLS" and e.repositoryId == "r2"]
    assert other == [("page", "src/y.ts", 0.7)]  # no leak from the other repository


def test_structure_edges(index):
    symbols, files, edges = named(index)
    tests = [(files[e.fromFileId], files[e.toFileId]) for e in edges if e.kind == "TESTS"]
    assert tests == [("apps/web/src/main.test.ts", "apps/web/src/main.ts")]
    assert sum(e.kind == "CONTAINS" for e in edges) == len(symbols)
    exported = {(files[e.fromFileId], symbols[e.toSymbolId].name) for e in edges if e.kind == "EXPORTS"}
    assert ("apps/web/src/main.ts", "Main") in exported and not any(f == "libs/lib/src/index.ts" for f, _ in exported)
    assert next(s for s in symbols.values() if s.name == "go").parentSymbolId == next(s.id for s in symbols.values() if s.name == "Main")


def test_inventory_summary(spark):
    rows = entries(spark)
    one = inventory.summary(rows, inventory.inventory(rows)).first()
    assert (one.pathsConsidered, one.hardIgnored, one.filesTotal, one.filesSkipped) == (len(REPO), 1, len(REPO) - 1, 2)
    assert one.filesProcessed + one.filesSkipped == one.filesTotal
    attributed = inventory.inventory(rows, P.parse_gitattributes("*.md linguist-generated\n"))
    assert {r.skipReason: r.files for r in inventory.skip_reasons(attributed).collect()} == {"SKIPPED_GENERATED": 1, "SKIPPED_TOO_LARGE": 1, "SKIPPED_BINARY": 1}


def test_attributes_are_each_repositorys_own(spark):
    files = {"a.md": "x\n", "gen/b.ts": "b\n", "lib/c.ts": "c\n"}
    one = files | {".gitattributes": "gen/* linguist-generated\nlib/** linguist-vendored\n*.md linguist-generated\n*.md -linguist-generated\n"}
    two = files | {".gitattributes": "*.md linguist-generated\n", "lib/.gitattributes": "c.ts linguist-generated\n"}
    rows = entries(spark, ("r1",), one).unionByName(entries(spark, ("r2",), two)).unionByName(entries(spark, ("r3",), files))
    found = {(r.repositoryId, r.path): r.skipReason for r in inventory.inventory(rows).where("skipReason IS NOT NULL").collect()}
    assert found == {("r1", "gen/b.ts"): "SKIPPED_GENERATED", ("r1", "lib/c.ts"): "SKIPPED_VENDORED", ("r2", "a.md"): "SKIPPED_GENERATED"}


def test_spread_deals_one_file_over_the_cores(spark, tmp_path, monkeypatch):
    from graphloom import partitions

    spark.range(1000).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    scan = spark.read.parquet(f"file://{tmp_path}/one")
    assert partitions.spread(scan).rdd.getNumPartitions() == 1
    monkeypatch.setattr(partitions, "LEAST_BYTES", 0)
    assert partitions.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert partitions.spread(scan.repartition(2)).rdd.getNumPartitions() == 2
    assert sorted(r.id for r in partitions.spread(scan).collect()) == list(range(1000))


# Manifests


def test_jsonc():
    assert manifests.parse_jsonc('{"a": "// no", /* x */ "b": [1, 2,], // y\n}') == {"a": "// no", "b": [1, 2]}
    assert manifests.parse_jsonc("[1]") is None and manifests.parse_jsonc("{bad") is None and manifests.parse_jsonc('{"a": "' + "x" * 300_000 + '"}') is None


def test_workspace_lists():
    assert manifests.pnpm_packages("x: 1\npackages:\n  - 'a/*'\n  - \"b\"\n\n  - c\ncatalog:\n  - no\n") == ["a/*", "b", "c"]
    assert manifests.npm_workspaces({"workspaces": {"packages": ["a", 1]}}) == ["a"] and manifests.npm_workspaces({"workspaces": ["b"]}) == ["b"]


def test_tsconfig_chain():
    texts = {"tsconfig.json": '{"extends": "./base", "compilerOptions": {"paths": {"a": ["x"]}}}', "base.json": '{"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "src", "paths": {"b": ["y"]}}}'}
    assert manifests.merge_tsconfig("tsconfig.json", texts) == {"paths": {"a": ["x"]}, "baseUrl": "src"}
    assert manifests.merge_tsconfig("gone.json", texts) is None


# Imports


@pytest.mark.parametrize(
    ("specifier", "bases", "otherwise", "package"),
    [
        ("./a", ["src/a"], "UNRESOLVED", None), ("../a", ["a"], "UNRESOLVED", None), ("../../a", [], "UNRESOLVED", None), ("..", [""], "UNRESOLVED", None), ("", [], "UNRESOLVED", None),
        ("/abs", [], "UNRESOLVED", None), ("C:\\x", [], "UNRESOLVED", None), ("fs/promises", [], "EXTERNAL", "fs"), ("node:test", [], "EXTERNAL", "node:test"), ("react/jsx", [], "EXTERNAL", "react"),
        ("@s/p/q", [], "EXTERNAL", "@s/p"), ("@s", [], "UNRESOLVED", None), ("#x", [], "UNRESOLVED", None),
    ],
)
def test_import_plan_without_manifests(specifier, bases, otherwise, package):
    assert imports.import_plan(specifier, "src", None, None, None, None, None, None, None)[:3] == (bases, otherwise, package)


def test_import_plan_with_manifests():
    config = '{"baseUrl": "", "paths": {"@a/*": ["one/*", "two/*"], "@a/b/*": ["three/*"], "exact": ["four"]}}'
    plan = lambda s, **m: imports.import_plan(s, "src", m.get("config"), "", m.get("owner"), "pkg", m.get("space"), "libs/p", m.get("root"))
    assert plan("@a/x", config=config)[:2] == (["one/x", "two/x"], "UNRESOLVED")
    assert plan("@a/b/x", config=config)[0] == ["three/x"] and plan("exact", config=config)[0] == ["four"]
    assert plan("lib/x", config=config)[:3] == (["lib/x"], "EXTERNAL", "lib")
    assert plan("react", owner='{"devDependencies": {"react": "18"}}', root='{"dependencies": {"react": "17"}}')[3] == "18"
    assert plan("@x/p", space='{"main": "m.js", "types": "t.d.ts"}')[:2] == (["libs/p/t.d.ts", "libs/p/m.js", "libs/p"], "UNRESOLVED")
    assert plan("@x/p/q", space="{}")[0] == ["libs/p/q"] and plan("@x/p/q", space='{"exports": "./i.js"}')[0] == []
    assert plan("@x/p/f/q", space='{"exports": {"./f/*": {"types": "./t/*.ts", "import": "./i/*.js"}}}')[0] == ["libs/p/i/q.js"]
    assert plan("#i", owner='{"imports": {"#i": "./x.ts", "#w/*": "./w/*"}}')[0] == ["pkg/x.ts"] and plan("#w/a", owner='{"imports": {"#w/*": "./w/*"}}')[0] == []


def test_probe_order(spark):
    files = spark.createDataFrame([("r", p) for p in ("a.ts", "a.js", "a/index.ts", "b/index.tsx", "c.d", "e.mts")], "repositoryId string, path string")
    rows = spark.createDataFrame([("r", i, [b]) for i, b in enumerate(("a", "a.js", "b", "c.d", "e.mjs", "none"))], "repositoryId string, k int, bases array<string>")
    found = {r.k: r.targetFilePath for r in resolve.probe(rows, files, ["k"]).collect()}
    assert found == {0: "a.ts", 1: "a.ts", 2: "b/index.tsx", 3: "c.d", 4: "e.mts", 5: None}


# Calls


def ladder(spark, sites, symbols, brought=(), per_package=False):
    s = spark.createDataFrame([("r", *x) for x in symbols], "repositoryId string, id string, ordinal int, name string, kind string, parentSymbol string, filePath string, packageName string")
    c = spark.createDataFrame([("r", *x) for x in sites], "repositoryId string, siteId string, fromSymbolId string, filePath string, packageName string, name string, receiver string, callerClass string")
    i = spark.createDataFrame([("r", *x) for x in brought], "repositoryId string, filePath string, ordinal int, named array<string>, default string, namespace string, isTypeOnly boolean, targetFilePath string")
    p = spark.createDataFrame([("r", per_package)], "repositoryId string, perPackage boolean")
    found = {}
    for r in resolve.resolve_names(c, s, i, p).collect():
        found.setdefault(r.siteId, []).append((r.toSymbolId, r.rule, r.confidence))
    return {k: sorted(v, key=str) for k, v in found.items()}


FN = lambda id, file, name="f", package=None, kind="FUNCTION", parent=None, n=0: (id, n, name, kind, parent, file, package)
SITE = lambda id, file, name="f", receiver=None, package=None, cls=None: (id, "from", file, package, name, receiver, cls)


def test_same_file_wins(spark):
    symbols = [FN("a", "x.ts", n=1), FN("b", "x.ts", kind="METHOD", parent="A", n=2), FN("c", "x.ts", kind="METHOD", parent="B", n=3), FN("d", "y.ts")]
    sites = [SITE("1", "x.ts"), SITE("2", "x.ts", receiver="this", cls="B"), SITE("3", "x.ts", receiver="this", cls="Z"), SITE("4", "x.ts", receiver="o")]
    found = ladder(spark, sites, symbols, [("x.ts", 0, ["f"], None, None, False, "y.ts")])
    assert {k: v[0][0] for k, v in found.items()} == {"1": "a", "2": "c", "3": "b", "4": "b"} and found["1"][0][1:] == ("SAME_FILE", 0.95)


def test_named_imports(spark):
    symbols = [FN("t", "t.ts"), FN("u", "u.ts")]
    brought = [("x.ts", 0, ["f"], None, None, True, "u.ts"), ("x.ts", 1, ["f"], None, None, False, "t.ts"), ("x.ts", 2, [], None, "ns", False, "u.ts")]
    found = ladder(spark, [SITE("1", "x.ts"), SITE("2", "x.ts", receiver="ns")], symbols, brought)
    assert found == {"1": [("t", "NAMED_IMPORT", 0.9)], "2": [("u", "NAMED_IMPORT", 0.9)]}


def test_unique_ambiguous_and_skipped(spark):
    many = [FN(f"m{i}", f"d{i}/m.ts", "many") for i in range(4)]
    three = [FN(f"t{i}", f"src/t{i}.ts", "three") for i in range(3)]
    narrowed = [FN("n1", "src/n.ts", "n"), FN("n2", "lib/n.ts", "n"), FN("n3", "lib/o.ts", "n")]
    found = ladder(spark, [SITE("1", "src/x.ts", "many"), SITE("2", "src/x.ts", "three"), SITE("3", "src/x.ts", "n"), SITE("4", "src/x.ts", "only"), SITE("5", "src/x.ts", "none")], [*many, *three, *narrowed, FN("o", "z/o.ts", "only")])
    assert found["1"] == [(None, "SKIPPED", None)] and "5" not in found
    assert found["2"] == [(f"t{i}", "AMBIGUOUS_TIEBREAK", pytest.approx(0.4 / 3)) for i in range(3)]
    assert found["3"] == [("n1", "AMBIGUOUS_TIEBREAK", 0.4)] and found["4"] == [("o", "UNIQUE_REPO_MATCH", 0.7)]


def test_receivers_need_their_class_in_scope(spark):
    symbols = [FN("m", "k.ts", kind="METHOD", parent="K")]
    assert ladder(spark, [SITE("1", "x.ts", receiver="k")], symbols) == {}
    assert ladder(spark, [SITE("1", "x.ts", receiver="k")], symbols, [("x.ts", 0, ["K"], None, None, False, None)]) == {"1": [("m", "UNIQUE_REPO_MATCH", 0.7)]}
    assert ladder(spark, [SITE("1", "x.ts", receiver="k")], symbols, [("x.ts", 0, [], "K", None, True, None)]) == {}


def test_packages_are_apart(spark):
    symbols = [FN("a", "p/a.ts", package="p"), FN("b", "q/b.ts", package="q")]
    sites = [SITE("1", "p/x.ts", package="p"), SITE("2", "s/x.ts", package=None)]
    assert ladder(spark, sites, symbols, per_package=True) == {"1": [("a", "UNIQUE_REPO_MATCH", 0.7)]}
    assert ladder(spark, sites, symbols)["2"] == [("a", "AMBIGUOUS_TIEBREAK", 0.2), ("b", "AMBIGUOUS_TIEBREAK", 0.2)]


# Archives


def tarball(*items, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, kind, data in items:
            info = tarfile.TarInfo(name)
            info.type = {"file": tarfile.REGTYPE, "dir": tarfile.DIRTYPE, "sym": tarfile.SYMTYPE, "hard": tarfile.LNKTYPE, "fifo": tarfile.FIFOTYPE}[kind]
            info.size = len(data) if kind == "file" else 0
            info.linkname = "x" if kind in ("sym", "hard") else ""
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def explode(spark, data, **caps):
    return archives.explode_archives(spark.createDataFrame([("a.tar.gz", bytearray(data))], "path string, content binary"), **caps).collect()


def test_archive_entries(spark):
    rows = explode(spark, tarball(("top", "dir", b""), ("top/a.ts", "file", b"x"), ("./top/b/c.ts", "file", b"yy"), ("lone", "file", b"z"), ("top/s", "sym", b""), ("top/h", "hard", b""), ("top/f", "fifo", b""), ("top/NUL.txt", "file", b"n")))
    assert {r.path: (r.kind, r.skipReason) for r in rows} == {
        "a.ts": ("file", None), "b/c.ts": ("file", None), "lone": ("skipped", "NO_TOP_LEVEL_PREFIX"), "s": ("skipped", "SYMLINK"), "h": ("skipped", "HARDLINK"), "f": ("skipped", "UNSUPPORTED_ENTRY_TYPE"), "NUL.txt": ("skipped", "INVALID_FILENAME"),
    }
    assert {r.path: bytes(r.content) for r in rows if r.kind == "file"} == {"a.ts": b"x", "b/c.ts": b"yy"}


@pytest.mark.parametrize(("name", "caps", "code"), [("top/../../x", {}, "UNSAFE"), ("/abs", {}, "UNSAFE"), ("C:/x", {}, "UNSAFE"), ("top/big", {"most_bytes": 10}, "REPO_TOO_LARGE"), ("top/two", {"most_files": 1}, "REPO_TOO_LARGE")])
def test_archives_are_refused_whole(spark, name, caps, code):
    data = tarball(("top/first", "file", b"1"), (name, "file", b"z" * 100))
    frame = archives.explode_archives(spark.createDataFrame([("bad.tar.gz", bytearray(data)), ("good.tar.gz", bytearray(tarball(("t/ok", "file", b""), mode="w:gz")))], "path string, content binary"), **({"most_bytes": 20000} | caps if "most_files" in caps else caps or {}))
    if "most_bytes" not in caps:
        assert [r.path for r in archives.accepted(frame).collect()] == ["ok"]
    assert [r.error[: len(code)] for r in frame.where("kind = 'refused'").collect() if r.archive == "bad.tar.gz"] == [code]


def test_damaged_archive(spark):
    rows = explode(spark, b"not a tarball")
    assert [r.kind for r in rows] == ["refused"]


def test_archives_from_files(spark, tmp_path):
    (tmp_path / "r.tar.gz").write_bytes(tarball(("t/a.ts", "file", b"export const a = 1\n"), ("t/s", "sym", b"")))
    found = archives.explode_archives(archives.read_archives(spark, f"file://{tmp_path}"))
    assert [r.path for r in archives.accepted(found).collect()] == ["a.ts"]
    assert {r.skipReason: r.entries for r in archives.skip_histogram(found).collect()} == {"SYMLINK": 1}
