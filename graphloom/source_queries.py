"""Registered queries on sources: archives, manifests, parsing, imports, the whole graph.

Inputs are small fixed sources, one a document (its number modulo their count), in which ``§``
stands for the document's number.  The SQL lists what each of them must give, written down by
hand, so it owes nothing to the library.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import strings as S
from .queries import cut, fresh_path, query, table


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(name: str, columns: str, rows: Sequence[tuple]) -> str:
    """A common table expression of literal rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"


def _own(columns: str) -> str:
    """Columns of expected rows with the document's number in the place of §."""
    return ", ".join(f"replace({c}, '§', CAST(doc_id AS VARCHAR)) AS \"{c}\"" for c in columns.split(", "))


def case_of(spark, sf_dir, count: int) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % count).cast("int").alias("k"))


def given(k: Column, values: Sequence[str | None]) -> Column:
    """The k-th value with the document's number in the place of §."""
    chosen = F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), k + 1)
    return F.replace(chosen, F.lit("§"), F.col("doc_id").cast("string"))


# Paths

#: path, valid, without its top level, directory, extension, top segment, ignored as a directory, grammar, language
PATHS = [
    ("top/src/a§.ts", True, "src/a§.ts", "top/src", ".ts", "top", False, "typescript", "typescript"),
    ("./top/b§.TSX", True, "b§.TSX", "./top", ".TSX", ".", False, "tsx", "typescript"),
    ("lone§", True, None, "", "", "lone§", False, None, None),
    ("top//c.js", False, "/c.js", "top/", ".js", "top", False, "javascript", "javascript"),
    ("top/con.txt", False, "con.txt", "top", ".txt", "top", False, None, None),
    ("top/lpt1", False, "lpt1", "top", "", "top", False, None, None),
    ("top/lpt10", True, "lpt10", "top", "", "top", False, None, None),
    ("node_modules", True, None, "", "", "node_modules", True, None, None),
    ("a/node_modules", True, "node_modules", "a", "", "a", False, None, None),
    ("a/__snapshots__", True, "__snapshots__", "a", "", "a", True, None, None),
    (".venv/x§", True, "x§", ".venv", "", ".venv", True, None, None),
    ("a/.hidden", True, ".hidden", "a", "", "a", False, None, None),
    ("a/x.d.mts", True, "x.d.mts", "a", ".mts", "a", False, "typescript", "typescript"),
    ("a/tab\there.py", False, "tab\there.py", "a", ".py", "a", False, None, "python"),
]


@query(f"""WITH {values_sql("v", "k, path, valid, stripped, dir, ext, top, ignored, grammar, language", [(k, *r) for k, r in enumerate(PATHS)])}
SELECT doc_id, {_own("path, stripped, dir, ext, top")}, valid, ignored, grammar, language FROM documents JOIN v ON doc_id % {len(PATHS)} = k""")
def path_functions(spark, sf_dir):
    path = F.col("path")
    rows = case_of(spark, sf_dir, len(PATHS)).withColumn("path", given(F.col("k"), [r[0] for r in PATHS]))
    return rows.select(
        "doc_id", "path", P.is_valid_relative_path(path).alias("valid"), P.strip_top_level(path).alias("stripped"), P.directory(path).alias("dir"), P.extension(path).alias("ext"),
        P.top_segment(path).alias("top"), P.is_hard_ignored_directory(path).alias("ignored"), P.grammar(path).alias("grammar"), P.language(path).alias("language"),
    )


@query("""SELECT doc_id, doc_id % 3 = 0 AS "binary", 'r' || (doc_id % 7) || ':' || (doc_id % 11) || ':s' || doc_id AS "prKey" FROM documents""")
def content_and_keys(spark, sf_dir):
    """A NUL among the first 8 KB makes a file binary, one after them does not."""
    i = F.col("doc_id")
    far = F.concat(F.repeat(F.lit("x"), F.when(i % 3 == 0, 8191).otherwise(8192)).cast("binary"), F.lit(b"\x00"))
    return table(spark, sf_dir, "documents").select("doc_id", P.is_binary(far).alias("binary"), S.pr_key(F.concat(F.lit("r"), i % 7), i % 11, F.concat(F.lit("s"), i)).alias("prKey"))


# Archives: an entry a document, an archive for each 40; every fifth archive has an entry that refuses it

ENTRY_NAMES = ["./top/src/f§.ts", "top/lib/f§.js", "top/dir§/", "top/link§", "top/hard§", "top/pipe§", "lone§", "top/con.§", "top/deep/x/y/f§.md", "top/é§.txt"]
BAD_NAMES = ["top/../../x", "/abs", "C:/x"]
ARCHIVES_SQL = f"""e AS (SELECT doc_id, doc_id // 40 AS a, CAST(doc_id % 10 AS INTEGER) AS k, 'content ' || doc_id AS content, doc_id // 40 % 5 = 4 AS refused FROM documents),
{values_sql("v", "k, path, kind, reason", [
    (0, "src/f§.ts", "file", None), (1, "lib/f§.js", "file", None), (3, "link§", "skipped", "SYMLINK"), (4, "hard§", "skipped", "HARDLINK"), (5, "pipe§", "skipped", "UNSUPPORTED_ENTRY_TYPE"),
    (6, "lone§", "skipped", "NO_TOP_LEVEL_PREFIX"), (7, "con.§", "skipped", "INVALID_FILENAME"), (8, "deep/x/y/f§.md", "file", None), (9, "é§.txt", "file", None),
])},
rows AS (SELECT 'a' || a || '.tar.gz' AS archive, replace(path, '§', CAST(doc_id AS VARCHAR)) AS path, kind, CAST(CASE WHEN e.k IN (3, 4, 5) THEN 0 ELSE length(content) END AS BIGINT) AS size,
  CASE WHEN kind = 'file' THEN sha256(content) END AS hash, reason FROM e JOIN v ON v.k = e.k WHERE NOT refused)"""  # fmt: skip


def archive_frame(spark, sf_dir) -> DataFrame:
    """(path, content) of the archives."""
    import io
    import tarfile

    import pyarrow as pa

    kinds = {2: tarfile.DIRTYPE, 3: tarfile.SYMTYPE, 4: tarfile.LNKTYPE, 5: tarfile.FIFOTYPE}

    def pack(entries: pa.Table) -> pa.Table:
        entries = entries.sort_by("doc_id")
        a, out = entries.column("a")[0].as_py(), io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for k, name, content in zip(*(entries.column(c).to_pylist() for c in ("k", "name", "content")), strict=True):
                info = tarfile.TarInfo(name)
                info.type = kinds.get(k, tarfile.REGTYPE)
                info.size = 0 if k in kinds else len(content)
                info.linkname = "x" if k in (3, 4) else ""
                tar.addfile(info, io.BytesIO(content))
            if a % 5 == 4:
                tar.addfile(tarfile.TarInfo(BAD_NAMES[a % 3]))
        return pa.table({"path": [f"a{a}.tar.gz"], "content": pa.array([out.getvalue()], pa.binary())})

    rows = case_of(spark, sf_dir, 10).withColumn("name", given(F.col("k"), ENTRY_NAMES)).withColumn("a", F.floor(F.col("doc_id") / 40))
    rows = rows.withColumn("content", F.concat(F.lit("content "), F.col("doc_id")).cast("binary"))
    return rows.groupBy("a").applyInArrow(pack, "path string, content binary")


@query(f"""WITH {ARCHIVES_SQL} SELECT archive, path, kind, size, hash, reason FROM rows
UNION ALL SELECT DISTINCT 'a' || a || '.tar.gz', NULL, 'refused', CAST(NULL AS BIGINT), NULL, 'UNSAFE_ARCHIVE' FROM e WHERE refused""")
def archive_entries(spark, sf_dir):
    from .sources import archives

    found = archives.explode_archives(archive_frame(spark, sf_dir))
    kept = archives.accepted(found, ("file", "skipped")).unionByName(found.where("kind = 'refused'"))
    return kept.select("archive", "path", "kind", "size", F.sha2("content", 256).alias("hash"), F.coalesce("skipReason", F.substring_index("error", ":", 1)).alias("reason"))


@query(f"""WITH {ARCHIVES_SQL} SELECT reason AS "skipReason", count(*) AS entries FROM rows WHERE reason IS NOT NULL GROUP BY reason""")
def archive_skips(spark, sf_dir):
    from .sources import archives

    return archives.skip_histogram(archives.accepted(archives.explode_archives(archive_frame(spark, sf_dir)), ("skipped",)))


@query("""SELECT DISTINCT 'a' || (doc_id // 40) || '.tar.gz' AS archive, 'REPO_TOO_LARGE' AS code FROM documents GROUP BY ALL HAVING count(*) > 39""")
def archive_limits(spark, sf_dir):
    """With a limit of 39 entries every full archive is refused; directories count."""
    from .sources import archives

    found = archives.explode_archives(archive_frame(spark, sf_dir), most_files=39)
    return found.where("kind = 'refused' AND error LIKE 'REPO_TOO_LARGE%'").select("archive", F.substring_index("error", ":", 1).alias("code"))


# Archives on disk of whole texts, an archive for each 20 documents; those over a limit of bytes are refused before any row

STREAM_LIMIT = 80_000
STORED_SQL = f"""d AS (SELECT doc_id, doc_id // 20 AS a, coalesce(text, '') AS body FROM documents),
s AS (SELECT *, octet_length(encode(body)) AS size FROM d),
t AS (SELECT a, (CAST(sum(512 + (size + 511) // 512 * 512) AS BIGINT) + 1024 + 10239) // 10240 * 10240 > {STREAM_LIMIT} AS refused FROM s GROUP BY a)"""


def stored_archives(spark, sf_dir) -> str:
    """The folder of the archives, written by tasks; a repeated task puts the same archive in its place."""
    import io
    import tarfile

    import pyarrow as pa
    from pyarrow import fs

    folder = fresh_path(spark, "tarballs")

    def write(entries: pa.Table) -> pa.Table:
        import uuid

        entries = entries.sort_by("doc_id")
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"a{entries.column('a')[0].as_py()}.tar.gz"
        aside = f"{base}/{uuid.uuid4().hex}.part"
        with system.open_output_stream(aside, compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as tar:
            for doc_id, text in zip(entries.column("doc_id"), entries.column("text"), strict=True):
                body = (text.as_py() or "").encode()
                info = tarfile.TarInfo(f"top/{doc_id}.txt")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        system.move(aside, f"{base}/{name}")
        return pa.table({"name": [name]})

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 20).alias("a"))
    docs.groupBy("a").applyInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


@query(f"""WITH {STORED_SQL} SELECT 'a' || a || '.tar.gz' AS archive, doc_id || '.txt' AS path, size, sha256(body) AS hash, CAST(greatest(1, (size + 1023) // 1024) AS BIGINT) AS chunks, NULL AS code
FROM s JOIN t USING (a) WHERE NOT refused UNION ALL SELECT 'a' || a || '.tar.gz', NULL, NULL, NULL, CAST(0 AS BIGINT), 'REPO_TOO_LARGE' FROM t WHERE refused""")
def archive_stream(spark, sf_dir):
    """Whole texts out of archives by path, in chunks of 1 KB; digests told by the first reading."""
    from .sources.tarballs import stream_archives

    found = stream_archives(spark, stored_archives(spark, sf_dir), most_bytes=STREAM_LIMIT, chunk_bytes=1024)
    keys = ["archive", "path", "size", "hash", F.substring_index("error", ":", 1).alias("code")]
    return found.groupBy(*keys).agg(F.count("chunk").alias("chunks"))


# Parsing: path and text of each source, and the facts that each must give

SOURCES = [
    ("a§.ts", "function foo§(a: number): number {\n  if (a > 0) { return bar§(a) }\n  return a\n}\n"),
    ("b§.ts", "/** Adds. */\nexport const add§ = (a: number) => a + 1;\n"),
    ("c§.ts", "export class Foo§ extends Base implements IFoo, IBar {\n  /** Runs. */\n  run(x: number): void { this.step(x); other.go§(); }\n}\n"),
    ("d§.ts", "export interface Shape§ extends A, B<C> { area(): number }\nexport type T§ = 1 | 2;\nexport enum E§ { A, B }\n"),
    ("e§.tsx", "export default function Card§() {\n  return <Box a={1} />;\n}\n"),
    ("f§.ts", "export function useThing§(a: boolean) { return a && other§() ? 1 : 2 }\n"),
    ("g§.js", "const one§ = x => x + 1, two§ = 3\nfunction outer§() { function inner() {} inner() }\n"),
    ("h§.ts", "function over§(a: string): string;\nfunction over§(a: any) { return a }\nexport { over§ as renamed };\n"),
    ("i§.ts", "function broken§( {\n  !!! ### nope\n  return 1\n"),
    ("j§.md", "# hello §\n"),
    ("k§.ts", "\n// plain §\n\n@Deco({ a: 1 })\nabstract class K§ {\n  constructor(private a: number) {}\n  get x() { return 1 }\n  abstract z(): void;\n}\n"),
    ("l§.ts", "export async function loop§(xs: number[]) {\n  for (const x of xs) { while (x) { try { f§(x) } catch (e) { g() } } }\n  switch (xs.length) { case 1: return; case 2: break; default: }\n}\n"),
    ("m§.ts", 'import D§, { a, b as c } from "./m§";\nimport * as ns from "pkg";\nimport type { T } from "./t";\nimport { type U, v } from "./u";\nimport "./side§";\n'),
    ("n§.ts", 'const { x } = require("./cjs§");\nconst y = import("./dyn");\nconst p = "./no"; const z = import(p);\n'),
    ("o§.ts", 'export { a as b§ } from "./m";\nexport * from "./n§";\nexport * as all§ from "./o";\nexport default () => {};\nexport const q§ = 1, r = () => 2;\n'),
]
#: case, nth, name, kind, first and last line, exported, default, signature, comment, parent, complexity, calls, extends, implements
SYMBOLS = [
    (0, 0, "foo§", "FUNCTION", 1, 4, False, False, "function foo§(a: number): number", None, None, 2, "bar§@2", None, None),
    (1, 0, "add§", "ARROW_FUNCTION", 1, 2, True, False, "export const add§ = (a: number) =>", "Adds.", None, 1, "", None, None),
    (2, 0, "Foo§", "CLASS", 1, 4, True, False, "export class Foo§ extends Base implements IFoo, IBar", None, None, 1, "", "Base", "IFoo,IBar"),
    (2, 1, "run", "METHOD", 2, 3, False, False, "run(x: number): void", "Runs.", "Foo§", 1, "this.step@3,other.go§@3", None, None),
    (3, 0, "Shape§", "INTERFACE", 1, 1, True, False, "export interface Shape§ extends A, B<C>", None, None, 1, "", "A,B", None),
    (3, 1, "T§", "TYPE_ALIAS", 2, 2, True, False, "export type T§ = 1 | 2", None, None, 1, "", None, None),
    (3, 2, "E§", "ENUM", 3, 3, True, False, "export enum E§", None, None, 1, "", None, None),
    (4, 0, "Card§", "REACT_COMPONENT", 1, 3, True, True, "export default function Card§()", None, None, 1, "", None, None),
    (5, 0, "useThing§", "HOOK", 1, 1, True, False, "export function useThing§(a: boolean)", None, None, 3, "other§@1", None, None),
    (6, 0, "one§", "ARROW_FUNCTION", 1, 1, False, False, "const one§ = x =>", None, None, 1, "", None, None),
    (6, 1, "outer§", "FUNCTION", 2, 2, False, False, "function outer§()", None, None, 1, "inner@2", None, None),
    (7, 0, "over§", "FUNCTION", 2, 2, True, False, "function over§(a: any)", None, None, 1, "", None, None),
    (10, 0, "K§", "CLASS", 4, 9, False, False, "abstract class K§", None, None, 1, "", None, None),
    (10, 1, "constructor", "METHOD", 6, 6, False, False, "constructor(private a: number)", None, "K§", 1, "", None, None),
    (10, 2, "x", "METHOD", 7, 7, False, False, "get x()", None, "K§", 1, "", None, None),
    (10, 3, "z", "METHOD", 8, 8, False, False, "abstract z(): void", None, "K§", 1, "", None, None),
    (11, 0, "loop§", "FUNCTION", 1, 4, True, False, "export async function loop§(xs: number[])", None, None, 6, "f§@2,g@2", None, None),
    (14, 0, "r", "ARROW_FUNCTION", 5, 5, True, False, "r = () =>", None, None, 1, "", None, None),
]
#: case, nth, specifier, named, default, namespace, types only, syntax, line
IMPORTS = [
    (12, 0, "./m§", "a,c", "D§", None, False, "static", 1), (12, 1, "pkg", "", None, "ns", False, "static", 2), (12, 2, "./t", "T", None, None, True, "static", 3),
    (12, 3, "./u", "v", None, None, False, "static", 4), (12, 4, "./u", "U", None, None, True, "static", 4), (12, 5, "./side§", "", None, None, False, "static", 5),
    (13, 0, "./cjs§", "", None, None, False, "require", 1), (13, 1, "./dyn", "", None, None, False, "dynamic", 2),
    (14, 0, "./m", "", None, None, False, "static", 1), (14, 1, "./n§", "", None, None, False, "static", 2), (14, 2, "./o", "", None, None, False, "static", 3),
]
#: case, nth, name, default, from, line
EXPORTS = [
    (1, 0, "add§", False, None, 2), (2, 0, "Foo§", False, None, 1), (3, 0, "Shape§", False, None, 1), (3, 1, "T§", False, None, 2), (3, 2, "E§", False, None, 3), (4, 0, "Card§", True, None, 1),
    (5, 0, "useThing§", False, None, 1), (7, 0, "renamed", False, None, 3), (11, 0, "loop§", False, None, 1),
    (14, 0, "b§", False, "./m", 1), (14, 1, "", False, "./n§", 2), (14, 2, "all§", False, "./o", 3), (14, 3, "", True, None, 4), (14, 4, "q§", False, None, 5), (14, 5, "r", False, None, 5),
]


def parsed(spark, sf_dir) -> DataFrame:
    from .plans.index import parse_files

    rows = case_of(spark, sf_dir, len(SOURCES)).withColumns({"path": given(F.col("k"), [p for p, _ in SOURCES]), "text": given(F.col("k"), [t for _, t in SOURCES]), "indexState": F.lit("INDEXED")})
    return parse_files(rows)


@query(f"""WITH {values_sql("v", "k, nth, name, kind, startLine, endLine, isExported, isDefault, signature, docComment, parentSymbol, complexity, calls, extends, implements", SYMBOLS)}
SELECT doc_id, nth, {_own("name, signature, parentSymbol, calls")}, kind, startLine AS "startLine", endLine AS "endLine", isExported AS "isExported", isDefault AS "isDefault", docComment AS "docComment",
  complexity, "extends", implements FROM documents JOIN v ON doc_id % {len(SOURCES)} = k""")
def parsed_symbols(spark, sf_dir):
    call = lambda c: F.concat(F.concat_ws(".", c.receiver, c["name"]), F.lit("@"), c.line)
    listed = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, ","))
    rows = parsed(spark, sf_dir).select("doc_id", F.posexplode("facts.symbols").alias("nth", "s")).select("doc_id", "nth", "s.*")
    return rows.select(
        "doc_id", "nth", "name", "signature", "parentSymbol", F.array_join(F.transform("calls", call), ",").alias("calls"), "kind", "startLine", "endLine", "isExported", "isDefault", "docComment", "complexity",
        listed("extends").alias("extends"), listed("implements").alias("implements"),
    )


@query(f"""WITH {values_sql("v", "k, nth, specifier, named, deflt, namespace, isTypeOnly, syntax, line", IMPORTS)}
SELECT doc_id, nth, {_own("specifier, named, namespace")}, replace(deflt, '§', CAST(doc_id AS VARCHAR)) AS "default", isTypeOnly AS "isTypeOnly", syntax, line FROM documents JOIN v ON doc_id % {len(SOURCES)} = k""")
def parsed_imports(spark, sf_dir):
    rows = parsed(spark, sf_dir).select("doc_id", F.posexplode("facts.imports").alias("nth", "i")).select("doc_id", "nth", "i.*")
    return rows.withColumn("named", F.array_join("named", ","))


@query(f"""WITH {values_sql("v", "k, nth, name, isDefault, reExportFrom, line", EXPORTS)}
SELECT doc_id, nth, {_own("name, reExportFrom")}, isDefault AS "isDefault", line FROM documents JOIN v ON doc_id % {len(SOURCES)} = k""")
def parsed_exports(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", F.posexplode("facts.exports").alias("nth", "e")).select("doc_id", "nth", "e.*")


@query(f"""SELECT doc_id, CASE doc_id % {len(SOURCES)} WHEN 8 THEN 'FAILED' WHEN 9 THEN 'NOT_PARSED' ELSE 'OK' END AS "parseState", doc_id % {len(SOURCES)} = 8 AS errors,
  CASE WHEN doc_id % {len(SOURCES)} = 9 THEN NULL WHEN doc_id % {len(SOURCES)} = 4 THEN 'tsx' WHEN doc_id % {len(SOURCES)} = 6 THEN 'javascript' ELSE 'typescript' END AS grammar FROM documents""")
def parse_quality(spark, sf_dir):
    """A broken file fails by itself; a file without a grammar is not parsed."""
    rows = parsed(spark, sf_dir)
    return rows.select("doc_id", "facts.parseState", (F.col("facts.parseErrors") > 0).alias("errors"), P.grammar(F.col("path")).alias("grammar"))


# Manifests and imports: the same small workspace in every repository, one for each 20 documents

WORKSPACE = {
    "package.json": '{"name": "root§", "private": true, "devDependencies": {"vitest": "^§", "react": "17"}} // comment',
    "pnpm-workspace.yaml": "packages:\n  - \"libs/*\"\n  - 'apps/web'\n  - '!libs/old'\nother: x\n",
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["libs/lib/src/*"], "@lib/deep/*": ["libs/lib/deep/*"],},}, /* c */}',
    "apps/web/tsconfig.json": '{"extends": "../../tsconfig", "compilerOptions": {"paths": {"~/*": ["src/*"], "only": ["src/own.ts"]}, "baseUrl": "./"}}',
    "apps/web/package.json": '{"name": "@x/web§", "dependencies": {"react": "18"}, "imports": {"#own": {"default": "./src/own.ts"}, "#gone": "./no.ts"}}',
    "libs/lib/package.json": '{"name": "@x/lib", "exports": {".": "./src/index.ts", "./sub/*": {"types": "./no/*.d.ts", "import": "./src/sub/*.ts"}}}',
    "libs/old/package.json": '{"name": "@x/old", "main": "m.js"}',
    "libs/plain/package.json": '{"name": "@x/plain", "main": "lib/m.js"}',
    "bad/package.json": "{oops",
    "libs/lib/src/index.ts": "export const a = 1\n",
    "libs/lib/src/sub/one.ts": "export const one = 1\n",
    "libs/lib/deep/a.ts": "export const deep = 1\n",
    "libs/plain/lib/m.ts": "export const m = 1\n",
    "libs/plain/x.tsx": "export const x = 1\n",
    "apps/web/src/own.ts": "export const own = 1\n",
    "apps/web/src/main.ts": "\n",
    "apps/web/src/dir/index.js": "exports.a = 1\n",
    "apps/web/local.ts": "export const l = 1\n",
}
#: specifier in apps/web/src/main.ts, status, target, package, version
SPECIFIERS = [
    ("./own", "RESOLVED", "apps/web/src/own.ts", None, None), ("./own.js", "RESOLVED", "apps/web/src/own.ts", None, None), ("./dir", "RESOLVED", "apps/web/src/dir/index.js", None, None),
    ("./gone", "UNRESOLVED", None, None, None), ("../local", "RESOLVED", "apps/web/local.ts", None, None), ("../../../../out", "UNRESOLVED", None, None, None), ("", "UNRESOLVED", None, None, None),
    ("/abs/x", "UNRESOLVED", None, None, None), ("C:\\x", "UNRESOLVED", None, None, None), ("~/own", "RESOLVED", "apps/web/src/own.ts", None, None), ("~/none", "UNRESOLVED", None, None, None),
    ("only", "RESOLVED", "apps/web/src/own.ts", None, None), ("local", "RESOLVED", "apps/web/local.ts", None, None), ("@lib/index", "EXTERNAL", None, "@lib/index", None),
    ("node:test", "EXTERNAL", None, "node:test", None), ("fs/promises", "EXTERNAL", None, "fs", None), ("@x/lib", "RESOLVED", "libs/lib/src/index.ts", None, None),
    ("@x/lib/sub/one", "RESOLVED", "libs/lib/src/sub/one.ts", None, None), ("@x/lib/deep/a", "UNRESOLVED", None, None, None), ("@x/plain", "RESOLVED", "libs/plain/lib/m.ts", None, None),
    ("@x/plain/x", "RESOLVED", "libs/plain/x.tsx", None, None), ("@x/old", "EXTERNAL", None, "@x/old", None), ("#own", "RESOLVED", "apps/web/src/own.ts", None, None),
    ("#gone", "UNRESOLVED", None, None, None), ("#other", "UNRESOLVED", None, None, None), ("react/jsx", "EXTERNAL", None, "react", "18"), ("vitest", "EXTERNAL", None, "vitest", "^§"),
    ("@s", "UNRESOLVED", None, None, None), ("@s/p/q", "EXTERNAL", None, "@s/p", None),
]
REPOS_SQL = "repos AS (SELECT DISTINCT doc_id // 20 AS doc_id, 'w' || (doc_id // 20) AS repo FROM documents)"


def workspaces(spark, sf_dir, files: dict[str, str]) -> DataFrame:
    """(repositoryId, path, text) of the files in every repository."""
    repos = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("doc_id")).distinct()
    rows = repos.select("doc_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, files)), F.array(*map(F.lit, files.values())))).alias("path", "text"))
    return rows.select(F.concat(F.lit("w"), "doc_id").alias("repositoryId"), "path", F.replace("text", F.lit("§"), F.col("doc_id").cast("string")).alias("text"))


@query(f"""WITH {REPOS_SQL}, {values_sql("v", "kind, dir, name, workspace, baseUrl, aliases", [
    ("package", "", "root§", False, None, None), ("package", "apps/web", "@x/web§", True, None, None), ("package", "libs/lib", "@x/lib", True, None, None), ("package", "libs/old", "@x/old", False, None, None),
    ("package", "libs/plain", "@x/plain", True, None, None), ("tsconfig", "", None, False, "", "@lib/*,@lib/deep/*"), ("tsconfig", "apps/web", None, False, "apps/web", "only,~/*"), ("markers", "", None, False, None, None),
])}
SELECT repo AS "repositoryId", kind, dir, replace(name, '§', CAST(doc_id AS VARCHAR)) AS name, workspace, baseUrl AS "baseUrl", aliases, CASE WHEN kind = 'markers' THEN 1 END AS malformed FROM repos, v""")  # fmt: skip
def manifest_contexts(spark, sf_dir):
    from .sources import manifests

    body = F.from_json("body", "baseUrl string, paths map<string, array<string>>, malformed int")
    rows = manifests.contexts(workspaces(spark, sf_dir, WORKSPACE)).withColumn("b", body)
    return rows.select("repositoryId", "kind", "dir", "name", "workspace", "b.baseUrl", F.array_join(F.array_sort(F.map_keys("b.paths")), ",").alias("aliases"), "b.malformed")


@query(f"""WITH {REPOS_SQL}, {values_sql("v", "ordinal, specifier, status, target, package, version", [(k, *r) for k, r in enumerate(SPECIFIERS)])}
SELECT repo AS "repositoryId", ordinal, specifier, status, target, package, replace(version, '§', CAST(doc_id AS VARCHAR)) AS version FROM repos, v""")
def import_resolution(spark, sf_dir):
    from .operators import imports
    from .sources import manifests

    files = workspaces(spark, sf_dir, WORKSPACE)
    context = cut(manifests.contexts(files), "context")
    placed = cut(imports.place_files(files.select("repositoryId", "path"), context), "placed")
    wanted = F.posexplode(F.array(*(F.lit(r[0]) for r in SPECIFIERS))).alias("ordinal", "specifier")
    asked = files.where("path = 'apps/web/src/main.ts'").select("repositoryId", F.col("path").alias("filePath"), wanted)
    found = imports.resolve_imports(asked, placed, context)
    return found.select("repositoryId", "ordinal", "specifier", "status", F.col("targetFilePath").alias("target"), F.col("packageName").alias("package"), "version")


@query(f"""WITH {REPOS_SQL}, {values_sql("v", "path, owner, config", [
    ("apps/web/src/main.ts", "@x/web§", "apps/web"), ("libs/lib/deep/a.ts", "@x/lib", ""), ("libs/plain/x.tsx", "@x/plain", ""), ("package.json", "root§", ""), ("pnpm-workspace.yaml", "root§", ""), ("bad/package.json", "root§", ""),
])} SELECT repo AS "repositoryId", path, replace(owner, '§', CAST(doc_id AS VARCHAR)) AS "packageName", config AS "configDir" FROM repos, v""")  # fmt: skip
def file_packages(spark, sf_dir):
    from .operators import imports
    from .sources import manifests

    files = workspaces(spark, sf_dir, WORKSPACE)
    wanted = files.where(F.col("path").isin("apps/web/src/main.ts", "libs/lib/deep/a.ts", "libs/plain/x.tsx", "package.json", "pnpm-workspace.yaml", "bad/package.json")).select("repositoryId", "path")
    return imports.place_files(wanted, cut(manifests.contexts(files), "context")).select("repositoryId", "path", "packageName", "configDir")


# A checkout on disk: whole texts as files, some of them ignored by their folder or by their name

TREE_SQL = """t AS (SELECT doc_id, coalesce(text, '') AS body, doc_id % 4 IN (1, 2) AS ignored,
  CASE doc_id % 4 WHEN 0 THEN 'src/__d' || (doc_id // 30) || '/_f' || doc_id || '.ts' WHEN 1 THEN 'node_modules/d' || (doc_id // 30) || '/f' || doc_id || '.js'
    WHEN 2 THEN 'lib/dist/f' || doc_id || '.min.js' ELSE 'f' || doc_id || '.md' END AS path FROM documents)"""


def stored_tree(spark, sf_dir) -> str:
    """The folder of the files, written by tasks; a repeated task writes the same files again."""
    import pyarrow as pa
    from pyarrow import fs

    folder = fresh_path(spark, "tree")

    def write(batches):
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write(text.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    i, at = F.col("doc_id"), F.floor(F.col("doc_id") / 30)
    name = F.concat(F.lit("f"), i)
    path = (
        F.when(i % 4 == 0, F.concat(F.lit("src/__d"), at, F.lit("/_"), name, F.lit(".ts"))).when(i % 4 == 1, F.concat(F.lit("node_modules/d"), at, F.lit("/"), name, F.lit(".js")))
        .when(i % 4 == 2, F.concat(F.lit("lib/dist/"), name, F.lit(".min.js"))).otherwise(F.concat(name, F.lit(".md")))
    )
    files = table(spark, sf_dir, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    files.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    return folder


@query(f"""WITH {TREE_SQL} SELECT path, octet_length(encode(body)) AS size, CASE WHEN NOT ignored THEN sha256(body) END AS hash, ignored AS "hardIgnored" FROM t""")
def tree_files(spark, sf_dir):
    """Every regular file below a folder; ignored ones are listed without their content."""
    from .sources.archives import read_kept

    return read_kept(spark, stored_tree(spark, sf_dir)).select("path", "size", F.sha2("content", 256).alias("hash"), "hardIgnored")


# Workspaces named by the root manifest: as a list, as an object of a list, with members of other types, as neither

NPM = [
    ('["packages/*", 7, "!packages/b"]', True, True, False, False), ('{"packages": ["apps/**", null]}', True, False, False, True), ('{"nohoist": ["packages/*"]}', False, False, False, False),
    ('"packages/*"', False, False, False, False), ('["./packages/b/"]', True, False, True, False), ("[]", False, False, False, False),
]


@query(f"""WITH {REPOS_SQL}, {values_sql("v", "k, marked, a, b, c", [(k, *r[1:]) for k, r in enumerate(NPM)])}
SELECT repo AS "repositoryId", t.dir, CASE t.dir WHEN '' THEN false WHEN 'packages/a' THEN v.a WHEN 'packages/b' THEN v.b ELSE v.c END AS workspace, v.marked
FROM repos JOIN v ON doc_id % {len(NPM)} = k, (VALUES (''), ('packages/a'), ('packages/b'), ('apps/c/d')) t(dir)""")
def npm_workspaces(spark, sf_dir):
    """Which packages each root manifest takes into its workspace."""
    from .sources import manifests

    files = workspaces(spark, sf_dir, {f"{d}/package.json".lstrip("/"): f'{{"name": "n{k}"}}' for k, d in enumerate(("", "packages/a", "packages/b", "apps/c/d"))})
    nth = F.substring("repositoryId", 2, 20).cast("long") % len(NPM) + 1
    field = F.element_at(F.array(*(F.lit(r[0]) for r in NPM)), nth.cast("int"))
    rows = files.withColumn("text", F.when(F.col("path") == "package.json", F.concat(F.lit('{"name": "root", "workspaces": '), field, F.lit("}"))).otherwise(F.col("text")))
    found = cut(manifests.contexts(rows), "npm")
    marked = found.where("kind = 'markers'").select("repositoryId", F.coalesce(F.get_json_object("body", "$.npmWorkspaces") == "true", F.lit(False)).alias("marked"))
    return found.where("kind = 'package'").join(marked, "repositoryId").select("repositoryId", "dir", "workspace", "marked")


# The whole index: two kinds of repositories, one for each 20 documents; odd ones have no workspace

INDEXED = {
    "package.json": '{"name": "root", "devDependencies": {"vitest": "1"}}',
    "pnpm-workspace.yaml": "packages:\n  - 'libs/*'\n",
    ".gitattributes": "gen/* linguist-generated\n",
    "gen/made.ts": "export function made() { return only() }\n",
    "libs/one/package.json": '{"name": "@x/one", "main": "index.ts"}',
    "libs/one/index.ts": 'import { helper } from "./helper";\nexport class Base { run() { return this.step() } step() { return helper() } }\nexport interface Shape { area(): number }\n',
    "libs/one/helper.ts": "export function helper() { return helper() }\nfunction only() {}\n",
    "src/main.ts": (
        'import { Base, Shape } from "@x/one";\nimport * as tools from "./tools";\nimport React from "react";\nimport "./gone";\n'
        "export class Main extends Base implements Shape { area() { return tools.pick() } go() { return this.run() } }\nexport function page() { return render() + twice() + lots() + base() }\n"
    ),
    "src/tools.ts": "export function pick() {}\nexport function twice() {}\n",
    "src/main.test.ts": 'import { page } from "./main";\nimport { it } from "vitest";\nexport function check() { page() }\n',
    "a/render.ts": "export function render() {}\nexport function lots() {}\n",
    "b/render.ts": "export function render() {}\nexport function lots() {}\n",
    "c/lots.ts": "export function lots() {}\n",
    "d/lots.ts": "export function lots() {}\n",
    "e/base.ts": "export function base(k) { return k.run() }\n",
}
_MAIN, _TOOLS, _TEST, _ONE, _HELP = "src/main.ts", "src/tools.ts", "src/main.test.ts", "libs/one/index.ts", "libs/one/helper.ts"
#: which repositories (0 even: a workspace, 1 odd: none, null both), kind, from, to, resolution, confidence; a symbol is file#name
INDEX_EDGES = [
    *((None, "CONTAINS", f, f"{f}#{s}", "RESOLVED", 1.0) for f, names in (
        (_ONE, ("Base", "run", "step", "Shape")), (_HELP, ("helper", "only")), (_MAIN, ("Main", "area", "go", "page")), (_TOOLS, ("pick", "twice")), (_TEST, ("check",)),
        ("a/render.ts", ("render", "lots")), ("b/render.ts", ("render", "lots")), ("c/lots.ts", ("lots",)), ("d/lots.ts", ("lots",)), ("e/base.ts", ("base",)),
    ) for s in names),
    *((None, "EXPORTS", f, f"{f}#{s}", "RESOLVED", 1.0) for f, names in (
        (_ONE, ("Base", "Shape")), (_HELP, ("helper",)), (_MAIN, ("Main", "page")), (_TOOLS, ("pick", "twice")), (_TEST, ("check",)), ("a/render.ts", ("render", "lots")), ("b/render.ts", ("render", "lots")),
        ("c/lots.ts", ("lots",)), ("d/lots.ts", ("lots",)), ("e/base.ts", ("base",)),
    ) for s in names),
    (1, "CONTAINS", "gen/made.ts", "gen/made.ts#made", "RESOLVED", 1.0), (1, "EXPORTS", "gen/made.ts", "gen/made.ts#made", "RESOLVED", 1.0), (1, "CALLS", "gen/made.ts#made", f"{_HELP}#only", "RESOLVED", 0.7),
    (None, "IMPORTS", _ONE, _HELP, "RESOLVED", 1.0), (None, "IMPORTS", _MAIN, _TOOLS, "RESOLVED", 1.0), (None, "IMPORTS", _TEST, _MAIN, "RESOLVED", 1.0), (0, "IMPORTS", _MAIN, _ONE, "RESOLVED", 1.0),
    (None, "TESTS", _TEST, _MAIN, "RESOLVED", 1.0),
    # imports without a target have one identity a file: the first stays
    (0, "IMPORTS", _MAIN, "react", "EXTERNAL", 1.0), (1, "IMPORTS", _MAIN, "@x/one", "EXTERNAL", 1.0), (None, "IMPORTS", _TEST, "vitest", "EXTERNAL", 1.0),
    (0, "EXTENDS", f"{_MAIN}#Main", f"{_ONE}#Base", "RESOLVED", 0.9), (0, "IMPLEMENTS", f"{_MAIN}#Main", f"{_ONE}#Shape", "RESOLVED", 0.9),
    (1, "EXTENDS", f"{_MAIN}#Main", f"{_ONE}#Base", "RESOLVED", 0.7), (1, "IMPLEMENTS", f"{_MAIN}#Main", f"{_ONE}#Shape", "RESOLVED", 0.7),
    (None, "CALLS", f"{_ONE}#run", f"{_ONE}#step", "RESOLVED", 0.95), (None, "CALLS", f"{_ONE}#step", f"{_HELP}#helper", "RESOLVED", 0.9), (None, "CALLS", f"{_HELP}#helper", f"{_HELP}#helper", "RESOLVED", 0.95),
    (None, "CALLS", f"{_MAIN}#area", f"{_TOOLS}#pick", "RESOLVED", 0.9), (1, "CALLS", f"{_MAIN}#go", f"{_ONE}#run", "RESOLVED", 0.7),
    (None, "CALLS", f"{_MAIN}#page", "a/render.ts#render", "RESOLVED", 0.2), (None, "CALLS", f"{_MAIN}#page", "b/render.ts#render", "RESOLVED", 0.2),
    (None, "CALLS", f"{_MAIN}#page", f"{_TOOLS}#twice", "RESOLVED", 0.7), (None, "CALLS", f"{_MAIN}#page", "e/base.ts#base", "RESOLVED", 0.7),
    (None, "CALLS", f"{_TEST}#check", f"{_MAIN}#page", "RESOLVED", 0.9),
]


def index_of(spark, sf_dir):
    from .plans.index import build_index

    rows = workspaces(spark, sf_dir, INDEXED)
    odd = F.substring("repositoryId", 2, 20).cast("long") % 2 == 1
    rows = rows.where(~odd | ~F.col("path").isin("pnpm-workspace.yaml", ".gitattributes")).withColumn("content", F.col("text").cast("binary"))
    return build_index(rows.select("repositoryId", "path", F.octet_length("content").cast("long").alias("size"), "content"), "sha", cut=cut)


@query(f"""WITH {REPOS_SQL}, {values_sql("v", "odd, kind, source, target, resolution, confidence", INDEX_EDGES)}
SELECT repo AS "repositoryId", kind, source, target, resolution, CAST(confidence AS DOUBLE) AS confidence FROM repos, v WHERE odd IS NULL OR odd = doc_id % 2""")
def index_edges(spark, sf_dir):
    index = index_of(spark, sf_dir)
    files = index.files.select("id", "path")
    symbols = index.symbols.select("id", F.concat_ws("#", "filePath", "name").alias("symbol"))
    rows = index.edges
    for side in ("from", "to"):
        rows = rows.join(files.select(F.col("id").alias(f"{side}FileId"), F.col("path").alias(f"_{side}f")), f"{side}FileId", "left").join(symbols.select(F.col("id").alias(f"{side}SymbolId"), F.col("symbol").alias(f"_{side}s")), f"{side}SymbolId", "left")
    return rows.select("repositoryId", "kind", F.coalesce("_froms", "_fromf").alias("source"), F.coalesce("_tos", "_tof", "externalPackage", "rawSpecifier").alias("target"), "resolution", "confidence")


@query(f"""WITH {REPOS_SQL}, {values_sql("v", "odd, kind, source, target, resolution, confidence", INDEX_EDGES)}, {values_sql("f", "path", [(p,) for p in INDEXED])},
n AS (SELECT repo, split_part(target, '#', 1) AS path, count(*) AS n FROM repos, v WHERE (odd IS NULL OR odd = doc_id % 2) AND resolution = 'RESOLVED' GROUP BY ALL)
SELECT repos.repo AS "repositoryId", f.path, CASE WHEN doc_id % 2 = 0 AND f.path = 'gen/made.ts' THEN 'SKIPPED_GENERATED' END AS "skipReason", CAST(coalesce(n.n, 0) AS INTEGER) AS "inboundEdgeCount", f.path = 'src/main.test.ts' AS "isTest",
  CASE WHEN f.path LIKE '%.ts' AND (doc_id % 2 = 1 OR f.path <> 'gen/made.ts') THEN 'OK' ELSE 'NOT_PARSED' END AS "parseState", CASE WHEN f.path LIKE 'libs/%' THEN '@x/one' ELSE 'root' END AS "packageName"
FROM repos, f LEFT JOIN n ON n.repo = repos.repo AND n.path = f.path WHERE doc_id % 2 = 0 OR f.path NOT IN ('pnpm-workspace.yaml', '.gitattributes')""")
def index_files(spark, sf_dir):
    return index_of(spark, sf_dir).files.select("repositoryId", "path", "skipReason", "inboundEdgeCount", "isTest", "parseState", "packageName")


@query(f"""WITH {REPOS_SQL} SELECT repo AS "repositoryId", kind, resolution, n AS attempted FROM repos, (VALUES ('IMPORTS', 'RESOLVED', 4, 3), ('IMPORTS', 'EXTERNAL', 2, 3), ('IMPORTS', 'UNRESOLVED', 1, 1)) t(kind, resolution, even, odd),
  LATERAL (SELECT CAST(CASE WHEN doc_id % 2 = 0 THEN even ELSE odd END AS BIGINT) AS n)""")
def index_attempted_imports(spark, sf_dir):
    """Edges before their identity collapses them."""
    return index_of(spark, sf_dir).attempted.where("kind = 'IMPORTS'").groupBy("repositoryId", "kind", "resolution").agg(F.count("*").alias("attempted"))


# Names with receivers: the caller's own class, a namespace, a class in scope, buckets by package

LADDER = """
symbols AS (SELECT p_partkey AS id, p_partkey AS ordinal, 'm' || (p_partkey % 40) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'FUNCTION' ELSE 'METHOD' END AS kind, CASE WHEN p_partkey % 3 > 0 THEN 'C' || (p_partkey % 30) END AS parentSymbol,
  'd' || (p_partkey % 7) || '/f' || (p_partkey % 90) || '.ts' AS filePath, 'pk' || (p_partkey % 4) AS packageName FROM part),
sites AS (SELECT o_orderkey AS siteId, o_orderkey AS fromSymbolId, 'd' || (o_orderkey % 7) || '/f' || (o_custkey % 90) || '.ts' AS filePath, 'pk' || (o_orderkey % 4) AS packageName, 'm' || (o_custkey % 40) AS name,
  CASE o_orderkey % 4 WHEN 0 THEN 'this' WHEN 1 THEN 'ns' WHEN 2 THEN 'o' END AS receiver, CASE WHEN o_orderkey % 4 = 0 THEN 'C' || (o_custkey % 30) END AS callerClass FROM orders),
imports AS (SELECT filePath, row_number() OVER (ORDER BY filePath) AS ordinal, 'C' || (length(filePath) * 7 % 30) AS cls, replace(filePath, '/f', '/f1') AS targetFilePath FROM (SELECT DISTINCT filePath FROM sites))"""


@query(f"""WITH {LADDER},
near AS (SELECT s.siteId, arg_min(c.id, (CASE WHEN s.receiver = 'this' AND c.parentSymbol = s.callerClass THEN 0 ELSE 1 END, c.ordinal)) AS t FROM sites s JOIN symbols c ON c.filePath = s.filePath AND c.name = s.name
  AND c.kind = CASE WHEN s.receiver IS NULL THEN 'FUNCTION' ELSE 'METHOD' END GROUP BY s.siteId),
named AS (SELECT s.siteId, arg_min(c.id, c.ordinal) AS t FROM sites s JOIN imports i ON i.filePath = s.filePath JOIN symbols c ON c.filePath = i.targetFilePath AND c.name = s.name
  WHERE s.receiver = 'ns' AND s.siteId NOT IN (SELECT siteId FROM near) GROUP BY s.siteId),
pool AS (SELECT s.siteId, c.id, count(*) OVER w AS n, split_part(c.filePath, '/', 1) = split_part(s.filePath, '/', 1) AS st, c.packageName = s.packageName AS sp FROM sites s
  JOIN symbols c ON c.name = s.name AND c.packageName = s.packageName AND c.kind = CASE WHEN s.receiver IS NULL THEN 'FUNCTION' ELSE 'METHOD' END
  LEFT JOIN imports i ON i.filePath = s.filePath AND i.cls = c.parentSymbol
  WHERE s.siteId NOT IN (SELECT siteId FROM near) AND s.siteId NOT IN (SELECT siteId FROM named) AND (s.receiver IS NULL OR s.receiver = 'this' OR i.cls IS NOT NULL) WINDOW w AS (PARTITION BY s.siteId))
SELECT siteId AS "siteId", t AS "toSymbolId", 'SAME_FILE' AS rule, CAST(0.95 AS DOUBLE) AS confidence FROM near UNION ALL SELECT siteId, t, 'NAMED_IMPORT', 0.9 FROM named
UNION ALL SELECT siteId, id, CASE WHEN n = 1 THEN 'UNIQUE_REPO_MATCH' ELSE 'AMBIGUOUS_TIEBREAK' END, CASE WHEN n = 1 THEN 0.7 ELSE 0.4 / n END FROM pool WHERE n <= 3
UNION ALL SELECT DISTINCT siteId, NULL, 'SKIPPED', CAST(NULL AS DOUBLE) FROM pool WHERE n > 3""")
def receiver_ladder(spark, sf_dir):
    """Names are looked up package by package, so all candidates are of the site's own."""
    from .operators.resolve import resolve_names
    from .queries import _view

    sql = LADDER.replace("FROM sites)", "FROM sites) x")
    views = [_view(spark, sf_dir, sql, name, ("part", "orders")).withColumn("repositoryId", F.lit("r")) for name in ("symbols", "sites", "imports")]
    imports = views[2].withColumns({"named": F.array("cls"), "default": F.lit(None).cast("string"), "namespace": F.lit("ns"), "isTypeOnly": F.lit(False)})
    mode = spark.range(1).select(F.lit("r").alias("repositoryId"), F.lit(True).alias("perPackage"))
    return resolve_names(views[1], views[0], imports, mode).select("siteId", "toSymbolId", "rule", "confidence")


# Walks over cycles: every file imports the next of its ring of five

@query("""WITH f AS (SELECT doc_id, doc_id // 5 AS ring, doc_id % 5 AS nth, count(*) OVER (PARTITION BY doc_id // 5) AS size FROM documents)
SELECT s.doc_id AS seed, CAST(((s.nth - d) % s.size + s.size) % s.size + 5 * s.ring AS BIGINT) AS "fileId", CAST(d AS INTEGER) AS depth FROM f s, range(1, 6) t(d) WHERE d <= s.size""")
def importer_cycles(spark, sf_dir):
    """A ring returns its seed at the ring's length, and the walk ends there."""
    from .operators import graph

    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 5).alias("ring"), (F.col("doc_id") % 5).alias("nth"))
    sized = docs.join(docs.groupBy("ring").agg(F.count("*").alias("size")), "ring")
    edges = sized.select(F.lit("r").alias("repositoryId"), F.lit("IMPORTS").alias("kind"), F.col("doc_id").alias("fromFileId"), ((F.col("nth") + 1) % F.col("size") + 5 * F.col("ring")).alias("toFileId"))
    return graph.importing_files(edges, "r", docs.select("doc_id"), 5)
