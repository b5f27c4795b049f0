import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.functions import strings as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("path", "ignored"),
    [
        ("node_modules/a/index.js", True), ("src/node_modules.ts", False), ("dist/x", True), ("src/dist/x.ts", False), ("a/b.min.js", True), ("b.min.js", True), ("a/minjs.js", False),
        ("package-lock.json", True), ("sub/package-lock.json", False), ("sub/x.lock", True), ("a/__snapshots__/b", True), ("img/a.png", True), ("f/a.woff2", True), (".git/config", True),
        (".github/x.yml", False), ("a.svg.ts", False), (".venv/lib/a.py", True),
    ],
)
def test_hard_ignore(spark, path, ignored):
    assert value(spark, P.is_hard_ignored(F.lit(path))) is ignored


def test_hard_ignored_directories(spark):
    found = {d: value(spark, P.is_hard_ignored_directory(F.lit(d))) for d in ("node_modules", "dist", "src", "a/__snapshots__", "img.png")}
    assert found == {"node_modules": True, "dist": True, "src": False, "a/__snapshots__": True, "img.png": False}


@pytest.mark.parametrize(
    ("path", "kind", "language"),
    [
        ("src/a.ts", "SOURCE", "typescript"), ("a/yarn.lock", "DEPENDENCY_LOCK", None), ("src/__tests__/a.ts", "TEST", "typescript"), ("a.spec.js", "TEST", "javascript"), ("a_test.go", "TEST", "go"),
        ("latest/a.ts", "SOURCE", "typescript"), ("api.pb.go", "GENERATED", "go"), ("x/generated/a.ts", "GENERATED", "typescript"), ("README.md", "DOCUMENTATION", "markdown"), ("a.PNG", "ASSET", None),
        ("tsconfig.base.json", "CONFIG", "json"), (".eslintrc.js", "CONFIG", "javascript"), ("Dockerfile", "CONFIG", None), ("a/b.yaml", "CONFIG", "yaml"), (".env.local", "CONFIG", None), ("Makefile", "UNKNOWN", None),
        (".hidden", "UNKNOWN", None), ("vite.config.ts", "CONFIG", "typescript"),
    ],
)
def test_classification(spark, path, kind, language):
    row = spark.range(1).select(P.classification(F.lit(path)), P.language(F.lit(path))).first()
    assert tuple(row) == (kind, language)


def test_attributes_last_match_wins(spark):
    rules = P.parse_gitattributes("*.gen linguist-generated\n# no\nlib/** linguist-vendored\nlib/own/** -linguist-vendored linguist-generated=false\nboth linguist-vendored linguist-generated\n")
    found = {p: value(spark, P.attribute_flag(F.lit(p), rules)) for p in ("a/x.gen", "lib/a.c", "lib/own/a.c", "both", "a.c")}
    assert found == {"a/x.gen": "GENERATED", "lib/a.c": "VENDORED", "lib/own/a.c": None, "both": "GENERATED", "a.c": None}
    assert value(spark, P.ignore_decision(F.lit("dist/x.gen"), rules)) == "HARD_IGNORE"


@pytest.mark.parametrize(
    ("text", "lines", "minified"),
    [("", 0, False), ("a", 1, False), ("a\n", 1, False), ("a\n\n", 2, False), ("\n", 1, False), ("x" * 500, 1, False), ("x" * 501, 1, True), ("x" * 501 + "\n", 1, True), ("x" * 1001 + "\nab", 2, True), ("x" * 998 + "\nab", 2, False)],
)
def test_lines(spark, text, lines, minified):
    assert tuple(spark.range(1).select(P.line_count(F.lit(text)), P.is_minified(F.lit(text))).first()) == (lines, minified)


def test_content_skip_order(spark):
    reason = lambda size, content: value(spark, P.content_skip_reason(F.lit(size), F.lit(content), F.decode(F.lit(content), "UTF-8")))
    assert reason(512 * 1024 + 1, b"\x00") == "SKIPPED_TOO_LARGE"
    assert reason(512 * 1024, b"a\x00b") == "SKIPPED_BINARY"
    assert reason(9000, b"a" * 8192 + b"\x00") == "SKIPPED_MINIFIED"
    assert reason(5, b"\x30\x00"[:1]) is None


@pytest.mark.parametrize(
    ("folder", "specifier", "target"),
    [("a/b", "./c", "a/b/c"), ("a/b", "../c", "a/c"), ("a", "../../c", None), ("", "./c", "c"), ("a", "..", ""), ("a/b", "./x/./y/../z", "a/b/x/z"), ("", "../x", None)],
)
def test_relative(spark, folder, specifier, target):
    assert value(spark, P.resolve_relative(F.lit(folder), F.lit(specifier))) == target


def test_path_parts(spark):
    row = spark.range(1).select(P.directory(F.lit("a/b/c.ts")), P.directory(F.lit("c")), P.extension(F.lit("a/.b")), P.extension(F.lit("x.d.ts")), P.top_segment(F.lit("a/b")), P.ancestors(F.lit("a/b/c")), P.ancestors(F.lit("c"))).first()
    assert tuple(row) == ("a/b", "", "", ".ts", "a", ["a/b", "a", ""], [""])
    row = spark.range(1).select(P.strip_top_level(F.lit("./r/a/b")), P.strip_top_level(F.lit("r")), P.is_valid_relative_path(F.lit("a/CON.txt")), P.is_valid_relative_path(F.lit("a//b")), P.is_valid_relative_path(F.lit("a/b"))).first()
    assert tuple(row) == ("a/b", None, False, False, True)


def test_test_signals(spark):
    signal = lambda path, *imports: value(spark, P.test_signal(F.lit(path), F.array(*map(F.lit, imports))))
    assert signal("a.test.ts", "vitest") == "PATH_CONVENTION" and signal("a.ts", "@testing-library/react") == "FRAMEWORK_IMPORT" and signal("a.ts", "vitest/config") is None


def test_slugs(spark):
    names = {"Héllo, Wörld!": "hello-world", "  ": "project", "ﬁne": "fine", "a" * 79 + "-b": "a" * 79, "日本": "project"}
    assert {n: value(spark, S.slugify(F.lit(n))) for n in names} == names
    assert value(spark, S.slug_suffix(F.lit("web-12"), F.lit("web"))) == 12 and value(spark, S.slug_suffix(F.lit("web-x"), F.lit("web"))) is None
    assert value(spark, S.next_slug(F.lit("web"), F.lit(None).cast("int"))) == "web-2" and value(spark, S.next_slug(F.lit("web"), F.lit(12))) == "web-13"


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        (" https://github.com/o/r.git ", ("o", "r", None)), ("https://GITHUB.com/o/r/", ("o", "r", None)), ("", (None, None, "EMPTY")), ("http://github.com/o/r", (None, None, "NOT_HTTPS")),
        ("https://u@github.com/o/r", (None, None, "HAS_CREDENTIALS_OR_PORT")), ("https://gitlab.com/o/r", (None, None, "WRONG_HOST")), ("https://github.com/o", (None, None, "BAD_PATH")),
        ("https://github.com/o/r/tree/main", (None, None, "BAD_PATH")), ("o/r", (None, None, "NOT_A_URL")), ("https://github.com/o/" + "r" * 600, (None, None, "TOO_LONG")),
    ],
)
def test_repository_urls(spark, url, expected):
    assert tuple(value(spark, S.parse_repository_url(F.lit(url)))) == expected


def test_json_members(spark):
    assert value(spark, S.typed_json(F.lit('{"installation": {"id": 7}}'), "$.installation.id", "bigint")) == 7
    assert value(spark, S.typed_json(F.lit('{"installation": {"id": "7"}}'), "$.installation.id", "bigint")) is None
    assert value(spark, S.typed_json(F.lit("{bad"), "$.a", "string")) is None
    drafts = [value(spark, S.review_drafts(F.lit(x))) for x in ('{"reviewDraftPullRequests": true}', '{"reviewDraftPullRequests": "true"}', "[]", "nope")]
    assert drafts == [True, False, False, False]


def test_errors_and_specifiers(spark):
    assert tuple(value(spark, S.parse_error(F.lit("REPO_TOO_LARGE: too: big")))) == ("REPO_TOO_LARGE", "too: big")
    assert tuple(value(spark, S.parse_error(F.lit("oops: x")))) == ("UNKNOWN", "oops: x")
    split = {s: tuple(value(spark, S.split_bare_specifier(F.lit(s)))) for s in ("@a/b/c/d", "@a/b", "x/y", "x", "@a")}
    assert split == {"@a/b/c/d": ("@a/b", "c/d"), "@a/b": ("@a/b", ""), "x/y": ("x", "y"), "x": ("x", ""), "@a": (None, None)}
