"""From parsed facts to edges: roots, import targets, the call and heritage ladders, producers.

Calls and heritage climb one ladder: a site asks places for its name, one join answers all of
them, and the first rule with an answer decides.  Frames carry ``repositoryId``, and all joins
have it in their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

#: Confidences of the ladder's steps, the most candidates that are kept, and kinds of symbols.
SAME_FILE, NAMED_IMPORT, UNIQUE_MATCH, AMBIGUOUS, MOST_CANDIDATES = 0.95, 0.9, 0.7, 0.4, 3
BARE_KINDS = ("FUNCTION", "ARROW_FUNCTION", "HOOK", "REACT_COMPONENT")
CALLABLE_KINDS = (*BARE_KINDS, "METHOD")
HERITAGE_KINDS = ("CLASS", "INTERFACE")
#: Probed extensions, and what an emitted extension stands for.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
EMITTED = {".js": ".ts", ".jsx": ".tsx", ".mjs": ".mts", ".cjs": ".cts"}


def nearest_root(rows: DataFrame, roots: DataFrame, keys: Sequence[str], path: str = "path", repository: str | None = None) -> DataFrame:
    """Adds the columns of the deepest root directory (column ``dir``) that holds each path.

    Ancestors are exploded, so the prefix join is an equi-join; ``keys`` identify a row.
    """
    scope = [repository] if repository else []
    found = (
        rows.select(*dict.fromkeys([*keys, *scope]), F.posexplode(P.ancestors(F.col(path))).alias("_up", "dir"))
        .join(roots, [*scope, "dir"])
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*[c for c in roots.columns if c not in scope]), "_up").alias("_root"))
    )
    return rows.join(found, list(keys), "left").select(rows["*"], "_root.*")


def probe_paths(base: Column) -> Column:
    """The files a target path may mean, best first."""
    ext = P.extension(base)
    swapped = F.lit(None).cast("string")
    for emitted, source in EMITTED.items():
        swapped = F.when(ext == emitted, F.concat(F.substring(base, F.lit(1), F.length(base) - len(emitted)), F.lit(source))).otherwise(swapped)
    return F.array_compact(F.array(
        swapped, base,
        *(F.when(ext == "", F.concat(base, F.lit(e))) for e in EXTENSIONS),
        *(F.concat(base, F.lit(f"/index{e}")) for e in EXTENSIONS),
    ))


def probe(rows: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds targetFilePath: the first existing file of the array column ``bases`` (targets, best first)."""
    scope = ["repositoryId"]
    tried = rows.select(*dict.fromkeys([*keys, *scope]), F.posexplode("bases").alias("_nth", "_base"))
    tried = tried.select(*dict.fromkeys([*keys, *scope]), "_nth", F.posexplode(probe_paths(F.col("_base"))).alias("_pos", "path"))
    hits = tried.join(files.select("repositoryId", "path"), ["repositoryId", "path"]).groupBy(*keys).agg(F.min_by("path", F.struct("_nth", "_pos")).alias("targetFilePath"))
    return rows.join(hits, list(keys), "left")


#: What a site asks of a name, in the order in which answers count.
OWN_CLASS, FILE, BROUGHT, ALL, PACKAGE, TOP = range(6)


def _place(kind: str, *parts: Column) -> Column:
    """A key of a place; null where a part of it is."""
    return F.concat(F.lit(kind), *(x for p in parts for x in (F.lit("\x1f"), p)))


def _bucket(package: str) -> Column:
    return F.when(F.col("perPackage"), F.coalesce(package, F.lit(""))).otherwise(F.lit(""))


def _cards(symbols: DataFrame) -> DataFrame:
    """(repositoryId, name, sort, place, n, few): how many symbols of a name each place has, and the first of them.

    A symbol counts in its file, its class there, its package, its top directory and everywhere; a
    method with these once more for its class.  Counting combines before it shuffles and the
    ranking keeps MOST_CANDIDATES of a task, so a common name is no task's burden.
    """
    top, bucket = P.top_segment(F.col("filePath")), _bucket("packageName")
    owner = F.when(F.col("sort") == "method", F.col("parentSymbol"))
    places = [
        _place("f", F.col("filePath")), _place("o", F.col("filePath"), owner), _place("a", bucket), _place("p", bucket, F.col("packageName")), _place("t", bucket, top),
        _place("c", bucket, owner), _place("cp", bucket, owner, F.col("packageName")), _place("ct", bucket, owner, top),
    ]
    keys = ["repositoryId", "name", "sort", "place"]
    rows = symbols.select("repositoryId", "name", "sort", F.explode(F.array_compact(F.array(*places))).alias("place"), "ordinal", "id")
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal", "id"))).where(F.col("_nth") <= MOST_CANDIDATES)
    few = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ordinal", "id"))).alias("few"))
    return counted.join(few, keys)


def _asked(sites: DataFrame, imports: DataFrame) -> DataFrame:
    """The places that each site asks, one row a place: its own file, the file that an import names, the index."""
    valued = imports.where(~F.col("isTypeOnly"))
    rows = sites.withColumns({"_bucket": _bucket("packageName"), "_top": P.top_segment(F.col("filePath"))})
    plain, want, name = F.col("receiver").isNull(), F.col("want"), F.col("name")
    # the first import of a file that brings each name, and the first of each namespace: a site meets one row, not the file's list
    first = F.min(F.struct("ordinal", "targetFilePath")).alias("_first")
    names = valued.select("repositoryId", "filePath", F.lit("name").alias("_how"), F.explode("named").alias("_brought"), "ordinal", "targetFilePath")
    spaces = valued.select("repositoryId", "filePath", F.lit("space").alias("_how"), F.col("namespace").alias("_brought"), "ordinal", "targetFilePath")
    brought = names.unionByName(spaces).where("_brought IS NOT NULL").groupBy("repositoryId", "filePath", "_how", "_brought").agg(first)
    rows = rows.withColumns({"_how": F.when(plain, "name").otherwise("space"), "_brought": F.when(plain, name).otherwise(F.col("receiver"))})
    rows = rows.join(brought, ["repositoryId", "filePath", "_how", "_brought"], "left").withColumn("_target", F.col("_first.targetFilePath"))
    # the classes in scope are asked only by calls on an object
    listed = valued.groupBy("repositoryId", "filePath").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "targetFilePath", "named", "default", "namespace"))).alias("_imports")  # of one file
    )
    scope = F.array_distinct(F.array_compact(F.flatten(F.transform("_imports", lambda i: F.concat(F.coalesce(i.named, F.array().cast("array<string>")), F.array(i.default))))))
    listed = listed.select("repositoryId", "filePath", scope.alias("_scope")).withColumn("_object", F.lit(True))
    rows = rows.withColumn("_object", ~(plain | (F.col("receiver") == "this"))).join(listed, ["repositoryId", "filePath", "_object"], "left")
    ask = lambda level, sort, place: F.struct(F.lit(level).alias("level"), sort.alias("sort"), place.alias("place"))
    here = [
        ask(OWN_CLASS, want, F.when(F.col("receiver") == "this", _place("o", F.col("filePath"), F.col("callerClass")))), ask(FILE, want, _place("f", F.col("filePath"))),
    ]
    told = F.transform("brings", lambda sort: ask(BROUGHT, sort, _place("f", F.col("_target"))))
    index = F.array(ask(ALL, want, _place("a", F.col("_bucket"))), ask(PACKAGE, want, _place("p", F.col("_bucket"), F.col("packageName"))), ask(TOP, want, _place("t", F.col("_bucket"), F.col("_top"))))
    within = F.flatten(F.transform("_scope", lambda c: F.array(
        ask(ALL, want, _place("c", F.col("_bucket"), c)), ask(PACKAGE, want, _place("cp", F.col("_bucket"), c, F.col("packageName"))), ask(TOP, want, _place("ct", F.col("_bucket"), c, F.col("_top")))
    )))
    indexed = F.when(plain | (F.col("receiver") == "this"), index).otherwise(F.coalesce(within, F.array().cast(sites.sparkSession.createDataFrame([], "a array<struct<level:int,sort:string,place:string>>").schema["a"].dataType)))
    asked = F.filter(F.concat(F.array(*here), told, indexed), lambda a: a.place.isNotNull())
    return rows.select("repositoryId", "name", "siteId", "site", F.explode(asked).alias("a")).select("repositoryId", "name", "siteId", "site", "a.*")


def decide(sites: DataFrame, symbols: DataFrame, imports: DataFrame, per_package: DataFrame) -> DataFrame:
    """(siteId, toSymbolId, rule, confidence, site): all rules of the ladder in one pass.

    sites: repositoryId, siteId, filePath, packageName, name, receiver, callerClass, want (the sort
    of symbol), brings (sorts that an import may bring), site (a struct to carry along).
    symbols: repositoryId, id, ordinal, name, sort, parentSymbol, filePath, packageName.
    Every place that a site asks is a row with the name's key, whatever rule it is for; all meet
    the counted symbols in one join, and one aggregation a site lets the first rule that has an
    answer decide.
    """
    cards = _cards(symbols.join(per_package, "repositoryId", "left"))
    hits = _asked(sites.join(per_package, "repositoryId", "left"), imports).join(cards, ["repositoryId", "name", "sort", "place"])
    at = lambda level, value: F.when(F.col("level") == level, value)
    found = hits.groupBy("siteId").agg(
        F.first("site").alias("site"), *(F.min(at(k, F.get("few", F.lit(0)))).alias(f"_first{k}") for k in (OWN_CLASS, FILE, BROUGHT)),
        *(F.sum(at(k, F.col("n"))).alias(f"_n{k}") for k in (ALL, PACKAGE, TOP)), *(F.flatten(F.collect_list(at(k, F.col("few")))).alias(f"_few{k}") for k in (ALL, PACKAGE, TOP)),
    )
    near, told, n = F.coalesce(f"_first{OWN_CLASS}", f"_first{FILE}"), F.col(f"_first{BROUGHT}"), F.col(f"_n{ALL}")
    narrowed = lambda c: F.when((n > 1) & F.col(f"_n{PACKAGE}").isNotNull(), F.col(f"{c}{PACKAGE}")).when((n > 1) & F.col(f"_n{TOP}").isNotNull(), F.col(f"{c}{TOP}")).otherwise(F.col(f"{c}{ALL}"))
    left = narrowed("_n")
    few = left <= MOST_CANDIDATES
    rule = F.when(near.isNotNull(), "SAME_FILE").when(told.isNotNull(), "NAMED_IMPORT").when(n == 1, "UNIQUE_REPO_MATCH").when(few, "AMBIGUOUS_TIEBREAK").otherwise("SKIPPED")
    confidence = F.when(near.isNotNull(), F.lit(SAME_FILE)).when(told.isNotNull(), F.lit(NAMED_IMPORT)).when(n == 1, F.lit(UNIQUE_MATCH)).when(few, F.lit(AMBIGUOUS) / left)
    targets = F.when(near.isNotNull(), F.array(near)).when(told.isNotNull(), F.array(told)).when(few, narrowed("_few"))
    return found.select("siteId", "site", rule.alias("rule"), confidence.alias("confidence"), F.explode_outer(targets).alias("_t")).select("siteId", F.col("_t.id").alias("toSymbolId"), "rule", "confidence", "site")


def sorted_symbols(symbols: DataFrame, kinds: Sequence[str], bare: Sequence[str], sort: str = "bare") -> DataFrame:
    """Symbols of ``kinds`` with their ``sort``: what a plain name asks for, a method, or neither."""
    return symbols.where(F.col("kind").isin(*kinds)).withColumn("sort", F.when(F.col("kind").isin(*bare), sort).when(F.col("kind") == "METHOD", "method").otherwise("other"))


def asking(sites: DataFrame, sort: str = "bare", brings: Sequence[str] = ("bare", "method", "other"), carry: Sequence[str] = ("fromSymbolId",)) -> DataFrame:
    """Sites with what they want; of columns that the ladder does not need only ``carry`` comes along."""
    want = F.when(F.col("receiver").isNull(), sort).otherwise("method")
    return sites.select("repositoryId", "siteId", "filePath", "packageName", "name", "receiver", "callerClass", want.alias("want"), F.array(*map(F.lit, brings)).alias("brings"), F.struct(*carry).alias("site"))


def resolve_names(sites: DataFrame, symbols: DataFrame, imports: DataFrame, per_package: DataFrame, kinds: Sequence[str] = CALLABLE_KINDS, bare: Sequence[str] = BARE_KINDS) -> DataFrame:
    """(siteId, toSymbolId, rule, confidence, fromSymbolId): the ladder for calls or heritage.

    sites: repositoryId, siteId, fromSymbolId, filePath, packageName, name, receiver, callerClass.
    symbols: repositoryId, id, ordinal, name, kind, parentSymbol, filePath, packageName.
    imports: repositoryId, filePath, ordinal, named, default, namespace, isTypeOnly, targetFilePath.
    per_package: repositoryId, perPackage - whether names are looked up package by package.
    A site with more than three equal candidates gives a row without target, rule SKIPPED.
    """
    found = decide(asking(sites), sorted_symbols(symbols, kinds, bare), imports, per_package)
    return found.select("siteId", "toSymbolId", "rule", "confidence", "site.fromSymbolId")


EDGE_COLUMNS = ("repositoryId", "kind", "fromFileId", "toFileId", "fromSymbolId", "toSymbolId", "externalPackage", "rawSpecifier", "resolution", "confidence", "ordinal")


def _edge(rows: DataFrame, kind: str, ordinal: Column, **columns: Column) -> DataFrame:
    made = {c: F.lit(None).cast("string") for c in ("fromFileId", "toFileId", "fromSymbolId", "toSymbolId", "externalPackage", "rawSpecifier")}
    made |= {"repositoryId": F.col("repositoryId"), "kind": F.lit(kind), "resolution": F.lit("RESOLVED"), "confidence": F.lit(1.0), "ordinal": ordinal} | columns
    return rows.select(*(made[c].alias(c) for c in EDGE_COLUMNS))


def build_edges(files: DataFrame, symbols: DataFrame, exports: DataFrame, imports: DataFrame, calls: DataFrame, heritage: DataFrame) -> DataFrame:
    """All edges before dedup, with an ordinal that puts producers and their rows in one order.

    imports: one row a file and distinct specifier with status, targetFilePath, packageName.
    calls, heritage: results of the ladder with repositoryId and fromSymbolId (heritage also with relation).
    """
    step = lambda n, *by: F.concat_ws("|", F.lit(str(n)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c for c in by))
    ids = files.select("repositoryId", F.col("path").alias("targetFilePath"), F.col("id").alias("toFileId"), F.col("isTest").alias("targetIsTest"))
    contains = _edge(symbols, "CONTAINS", step(1, "filePath", F.lpad("ordinal", 8, "0")), fromFileId=F.col("fileId"), toSymbolId=F.col("id"))
    last = symbols.groupBy("repositoryId", "fileId", "name").agg(F.max_by("id", "ordinal").alias("symbolId"))
    local = exports.where((F.col("name") != "") & F.col("reExportFrom").isNull())
    exported = _edge(local.join(last, ["repositoryId", "fileId", "name"]), "EXPORTS", step(2, "filePath", F.lpad("ordinal", 8, "0")), fromFileId=F.col("fileId"), toSymbolId=F.col("symbolId"))
    targets = imports.join(ids, ["repositoryId", "targetFilePath"], "left")
    imported = _edge(
        targets, "IMPORTS", step(3, "filePath", F.lpad("ordinal", 8, "0")), fromFileId=F.col("fileId"), toFileId=F.col("toFileId"),
        externalPackage=F.when(F.col("status") == "EXTERNAL", F.col("packageName")), rawSpecifier=F.when(F.col("status") == "UNRESOLVED", F.col("specifier")), resolution=F.col("status"),
    )
    parents = [
        _edge(heritage.where((F.col("relation") == kind) & F.col("toSymbolId").isNotNull()), kind, step(n, "siteId", "toSymbolId"), fromSymbolId=F.col("fromSymbolId"), toSymbolId=F.col("toSymbolId"), confidence=F.col("confidence"))
        for n, kind in ((4, "EXTENDS"), (5, "IMPLEMENTS"))
    ]
    called = _edge(calls.where(F.col("toSymbolId").isNotNull()), "CALLS", step(6, "siteId", "toSymbolId"), fromSymbolId=F.col("fromSymbolId"), toSymbolId=F.col("toSymbolId"), confidence=F.col("confidence"))
    tested = targets.where((F.col("status") == "RESOLVED") & F.col("toFileId").isNotNull() & ~F.col("targetIsTest"))
    tested = tested.join(files.where("isTest").select("repositoryId", F.col("id").alias("fileId")), ["repositoryId", "fileId"], "left_semi")
    tests = _edge(tested, "TESTS", step(7, "filePath", F.lpad("ordinal", 8, "0")), fromFileId=F.col("fileId"), toFileId=F.col("toFileId"))
    out = contains.unionByName(exported).unionByName(imported)
    for part in (*parents, called, tests):
        out = out.unionByName(part)
    return out
