"""Path predicates, classification and content measures as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE_CAP_BYTES = 512 * 1024
BINARY_SNIFF_BYTES = 8 * 1024
MINIFIED_LINE_LENGTH = 500

#: Paths that are never indexed.
HARD_IGNORE = (
    "node_modules/**", ".git/**", "vendor/**", "dist/**", "build/**", "out/**", ".next/**", "target/**", "__pycache__/**", "coverage/**", ".venv/**",
    "**/*.min.js", "**/*.min.css", "**/*.map", "**/*.bundle.js",
    "**/*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock", "composer.lock",
    "**/*.snap", "**/__snapshots__/**",
    "**/*.png", "**/*.jpg", "**/*.jpeg", "**/*.gif", "**/*.svg", "**/*.ico", "**/*.pdf", "**/*.zip", "**/*.woff*", "**/*.ttf", "**/*.mp4", "**/*.wasm",
)

#: Language of each extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".rb": "ruby", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "csharp", ".php": "php",
    ".swift": "swift", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".sql": "sql",
    ".css": "css", ".scss": "scss", ".less": "less", ".html": "html", ".htm": "html", ".vue": "vue", ".svelte": "svelte",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".mdx": "markdown",
    ".proto": "protobuf", ".graphql": "graphql", ".gql": "graphql",
}

#: Grammar of each parsed extension.
GRAMMARS = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
}

#: File name and extension rules of the classification, and path conventions.
LOCK_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock", "composer.lock", "Gemfile.lock")
DOCUMENT_EXTENSIONS = (".md", ".mdx", ".rst", ".txt")
ASSET_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".pdf", ".zip", ".woff", ".woff2", ".ttf", ".mp4", ".wasm")
CONFIG_EXTENSIONS = (".yaml", ".yml", ".toml", ".ini", ".cfg")
CONFIG_NAME = (
    r"(?i)^(\.[\w-]+rc(\.[a-z]+)?|[\w.-]+\.config\.[cm]?[jt]sx?|tsconfig.*\.json|package\.json|\.env(\..+)?|Dockerfile|docker-compose.*\.ya?ml|\.editorconfig|\.eslintrc.*|\.prettierrc.*)$"
)
TEST_SEGMENT, TEST_NAME = r"(?i)(^|/)(__tests__|tests?|spec)(/|$)", r"(?i)[.\-_](test|spec)\.[^/.]+$"
GENERATED_SEGMENT, GENERATED_NAME = r"(?i)(^|/)(generated|\.generated)(/|$)", r"(?i)\.(generated|gen|pb)\.[^/.]+$"
TEST_PACKAGES, TEST_PACKAGE_PREFIX = ("vitest", "jest", "mocha", "playwright", "@playwright/test", "ts-jest"), "@testing-library/"
RESERVED_NAMES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression; ``**`` spans directories, dots are ordinary."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "(?:/.*)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.sub(r"([^\w/ -])", r"\\\1", pattern[i]), i + 1
    return f"^{out}$"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The part before the last slash; empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """With its dot; a name's leading dot begins no extension."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def top_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def is_hard_ignored(path: Column) -> Column:
    return path.rlike("|".join(glob_regex(p) for p in HARD_IGNORE))


def is_hard_ignored_directory(path: Column) -> Column:
    return is_hard_ignored(F.concat(path, F.lit("/probe")))


def _lookup(key: Column, values: dict[str, str]) -> Column:
    """One map literal, folded once, instead of a branch for each member."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def language(path: Column) -> Column:
    return _lookup(F.lower(extension(path)), LANGUAGES)


def grammar(path: Column) -> Column:
    return _lookup(F.lower(extension(path)), GRAMMARS)


def is_test(path: Column) -> Column:
    return path.rlike(TEST_SEGMENT) | path.rlike(TEST_NAME)


def is_generated(path: Column) -> Column:
    return path.rlike(GENERATED_SEGMENT) | path.rlike(GENERATED_NAME)


def is_test_framework(specifier: Column) -> Column:
    return specifier.isin(*TEST_PACKAGES) | specifier.startswith(TEST_PACKAGE_PREFIX)


def test_signal(path: Column, specifiers: Column) -> Column:
    """PATH_CONVENTION, else FRAMEWORK_IMPORT, else null."""
    return F.when(is_test(path), F.lit("PATH_CONVENTION")).when(F.exists(specifiers, is_test_framework), F.lit("FRAMEWORK_IMPORT"))


def classification(path: Column) -> Column:
    name, ext = base_name(path), F.lower(extension(path))
    return (
        F.when(name.isin(*LOCK_NAMES), "DEPENDENCY_LOCK")
        .when(is_test(path), "TEST")
        .when(is_generated(path), "GENERATED")
        .when(ext.isin(*DOCUMENT_EXTENSIONS), "DOCUMENTATION")
        .when(ext.isin(*ASSET_EXTENSIONS), "ASSET")
        .when(name.rlike(CONFIG_NAME) | ext.isin(*CONFIG_EXTENSIONS), "CONFIG")
        .when(language(path).isNotNull(), "SOURCE")
        .otherwise("UNKNOWN")
    )


def strip_top_level(name: Column) -> Column:
    """An archive entry's path without its first component; null where there is none."""
    plain = F.regexp_replace(name, r"^\./", "")
    return F.when(F.instr(plain, "/") > 0, F.regexp_replace(plain, r"^[^/]*/", ""))


def is_valid_relative_path(path: Column) -> Column:
    """No empty segment, no control character, no reserved device name."""
    return F.forall(F.split(path, "/"), lambda s: (F.length(s) > 0) & ~s.rlike(r"[\x00-\x1F\x7F]") & ~s.rlike(RESERVED_NAMES))


def normalise(path: Column) -> Column:
    """Resolve ``.`` and ``..`` by a stack of segments; null where the path leaves the root."""
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("stack"))

    def push(state, segment):
        up = segment == ".."
        stack = (
            F.when((segment == "") | (segment == "."), state.stack)
            .when(up, F.slice(state.stack, F.lit(1), F.greatest(F.size(state.stack) - 1, F.lit(0))))
            .otherwise(F.concat(state.stack, F.array(segment)))
        )
        return F.struct((state.ok & ~(up & (F.size(state.stack) == 0))).alias("ok"), stack.alias("stack"))

    return F.aggregate(F.split(path, "/"), start, push, lambda s: F.when(s.ok, F.array_join(s.stack, "/")))


def resolve_relative(from_dir: Column, specifier: Column) -> Column:
    return normalise(F.when(from_dir == "", specifier).otherwise(F.concat_ws("/", from_dir, specifier)))


def ancestors(path: Column) -> Column:
    """Directories above a path, deepest first, the root as ''."""
    parts = F.split(directory(path), "/")
    dirs = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(directory(path) == "", F.array(F.lit(""))).otherwise(F.concat(dirs, F.array(F.lit(""))))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def is_binary(content: Column) -> Column:
    """A NUL among the first 8 KB of a binary column."""
    return F.contains(F.substring(content, 1, BINARY_SNIFF_BYTES), F.lit(b"\x00"))


def line_count(text: Column) -> Column:
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(breaks + F.when(text.endswith("\n"), 0).otherwise(1), F.lit(1))).cast("int")


def is_minified(text: Column) -> Column:
    """Average line longer than 500 code points; a trailing line break ends the last line."""
    size = F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.length(text) > 0) & (size > MINIFIED_LINE_LENGTH * line_count(text))


class AttributeRule(NamedTuple):
    """One attribute of a ``.gitattributes`` line."""

    regex: str
    flag: str
    value: bool


def parse_gitattributes(content: str) -> list[AttributeRule]:
    flags = {"linguist-generated": "GENERATED", "linguist-vendored": "VENDORED"}
    rules = []
    for line in content.splitlines():
        pattern, *tokens = line.split() or [""]
        if not pattern or pattern.startswith("#"):
            continue
        regex = glob_regex(pattern if "/" in pattern.rstrip("/") else f"**/{pattern}")
        for token in tokens:
            name, _, value = token.lstrip("-").partition("=")
            if name in flags:
                rules.append(AttributeRule(regex, flags[name], not token.startswith("-") and value != "false"))
    return rules


RULES = T.ArrayType(T.StructType([T.StructField("regex", T.StringType()), T.StructField("flag", T.StringType()), T.StructField("value", T.BooleanType())]))


@F.pandas_udf(RULES)
def attribute_rules(content: pd.Series) -> pd.Series:
    """The rules of ``.gitattributes`` texts, one array each."""
    return content.map(lambda text: [r._asdict() for r in parse_gitattributes(text)] if text else [])


def attribute_flag(path: Column, rules: Sequence[AttributeRule] | Column) -> Column:
    """GENERATED, VENDORED or null: the last matching rule of each attribute counts.

    ``rules``: the same for all rows, or a column of RULES.
    """

    def state(flag: str) -> Column:
        if isinstance(rules, Column):
            fits = F.filter(rules, lambda r: (r.flag == flag) & F.regexp_like(path, r.regex))
            return F.coalesce(F.try_element_at(fits, F.lit(-1)).value, F.lit(False))
        value = F.lit(False)
        for rule in rules:
            if rule.flag == flag:
                value = F.when(path.rlike(rule.regex), F.lit(rule.value)).otherwise(value)
        return value

    return F.when(state("GENERATED"), F.lit("GENERATED")).when(state("VENDORED"), F.lit("VENDORED"))


def ignore_decision(path: Column, rules: Sequence[AttributeRule] | Column = ()) -> Column:
    """HARD_IGNORE, SKIPPED_GENERATED, SKIPPED_VENDORED or KEEP."""
    flag = attribute_flag(path, rules)
    return F.when(is_hard_ignored(path), F.lit("HARD_IGNORE")).when(flag.isNotNull(), F.concat(F.lit("SKIPPED_"), flag)).otherwise(F.lit("KEEP"))


def content_skip_reason(size: Column, content: Column, text: Column) -> Column:
    """Why a kept path is not indexed, in the order size, binary, minified; null if it is."""
    return F.when(size > SIZE_CAP_BYTES, F.lit("SKIPPED_TOO_LARGE")).when(is_binary(content), F.lit("SKIPPED_BINARY")).when(is_minified(text), F.lit("SKIPPED_MINIFIED"))
