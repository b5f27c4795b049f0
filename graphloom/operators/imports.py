"""Import resolution: each specifier becomes targets to probe and what it is if none exists.

``import_plan`` reads one specifier with the manifests that bear on it (nearest tsconfig,
owner, workspace and root package); existence is not its business - targets are joined with
the files of the repository.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import strings as S
from . import resolve

MOST_CHARACTERS = 2000
#: Modules that come with Node.js.
BUILTINS = frozenset(
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks "
    "process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
)
PLAN = T.StructType([
    T.StructField("bases", T.ArrayType(T.StringType())), T.StructField("otherwise", T.StringType()),
    T.StructField("packageName", T.StringType()), T.StructField("version", T.StringType()), T.StructField("specifier", T.StringType()),
])


def normal(folder: str, path: str) -> str | None:
    stack: list[str] = []
    for part in f"{folder}/{path}".split("/"):
        if part == "..":
            if not stack:
                return None
            stack.pop()
        elif part not in ("", "."):
            stack.append(part)
    return "/".join(stack)


def split_package(specifier: str) -> tuple[str, str] | None:
    found = re.match(r"(@[^/]*/[^/]*|[^@/][^/]*)(?:/(.*))?$", specifier, re.S)
    return (found[1], found[2] or "") if found else None


def star(pattern: str, text: str) -> str | None:
    """What the star of a pattern stands for in a text."""
    before, found, after = pattern.partition("*")
    if found and text.startswith(before) and text.endswith(after) and len(text) >= len(before) + len(after):
        return text[len(before) : len(text) - len(after)]
    return None


def alias_targets(paths: dict[str, list[str]], specifier: str) -> list[str] | None:
    """Targets of the exact alias, else of the one with the longest part before its star, the first of equals."""
    if paths.get(specifier):
        return list(paths[specifier])
    fits = [(len(k.partition("*")[0]), -i, k) for i, k in enumerate(paths) if star(k, specifier) is not None]
    if not fits:
        return None
    key = max(fits)[2]
    return [t.replace("*", star(key, specifier) or "", 1) for t in paths[key]]


def conditional(value: Any, names: tuple[str, ...]) -> str | None:
    if isinstance(value, dict):
        value = next((value[n] for n in names if isinstance(value.get(n), str)), None)
    return value if isinstance(value, str) else None


def exports_target(exports: Any, subpath: str) -> str | None:
    """The file that a package's ``exports`` names for a subpath."""
    names = ("import", "default", "types")
    table = exports if isinstance(exports, dict) else {}
    if not any(k.startswith(".") for k in table):  # one entry for the package itself
        return conditional(exports, names) if subpath == "" else None
    key = f"./{subpath}" if subpath else "."
    if key in table:
        return conditional(table[key], names)
    for pattern, value in table.items() if subpath else ():
        part = star(pattern, key) if pattern.startswith("./") else None
        target = conditional(value, names) if part is not None else None
        if target:
            return target.replace("*", part or "", 1)
    return None


@lru_cache(maxsize=4096)
def _loads(text: str | None) -> dict[str, Any]:
    return json.loads(text) if text else {}


def import_plan(specifier: str, folder: str, config: str | None, config_dir: str | None, owner: str | None, owner_dir: str | None, space: str | None, space_dir: str | None, root: str | None) -> tuple:
    """(targets in order, status if none exists, package, version, specifier)."""
    specifier = specifier[:MOST_CHARACTERS]
    bases: list[str | None] = []

    def plan(otherwise: str, package: str | None = None, version: str | None = None) -> tuple:
        return [b for b in bases if b is not None], otherwise, package, version, specifier

    if specifier == "" or specifier.startswith("/") or re.match(r"[a-zA-Z]:[\\/]", specifier):
        return plan("UNRESOLVED")
    if specifier in (".", "..") or specifier.startswith(("./", "../")):
        bases.append(normal(folder, specifier))
        return plan("UNRESOLVED")
    if config is not None:
        settings = _loads(config)
        targets = alias_targets(settings.get("paths") or {}, specifier)
        base = settings.get("baseUrl")
        if targets is not None:
            bases += [normal(base if base is not None else config_dir or "", t) for t in targets]
            return plan("UNRESOLVED")
        if base is not None:
            bases.append(normal(base, specifier))
    package = split_package(specifier)
    if specifier.startswith("node:") or (package and package[0] in BUILTINS):
        return plan("EXTERNAL", specifier if specifier.startswith("node:") else package[0])
    if package and space is not None:
        manifest, sub = _loads(space), package[1]
        if "exports" in manifest:
            target = exports_target(manifest["exports"], sub)
            bases.append(normal(space_dir or "", target) if target else None)
        if sub == "":
            bases += [normal(space_dir or "", manifest[k]) for k in ("types", "module", "main") if isinstance(manifest.get(k), str) and manifest[k]]
            bases.append(space_dir)
        elif "exports" not in manifest:
            bases.append(normal(space_dir or "", sub))
        return plan("UNRESOLVED")
    if specifier.startswith("#"):
        table = _loads(owner).get("imports")
        target = conditional(table.get(specifier), ("import", "default")) if isinstance(table, dict) else None
        bases.append(normal(owner_dir or "", target) if target else None)
        return plan("UNRESOLVED")
    if package:
        fields = ("dependencies", "devDependencies", "peerDependencies")
        version = next((v for m in (owner, root) for f in fields if (v := _loads(m).get(f, {}).get(package[0]))), None)
        return plan("EXTERNAL", package[0], version)
    return plan("UNRESOLVED")


@F.pandas_udf(PLAN)
def _plans(specifier: pd.Series, folder: pd.Series, config: pd.Series, config_dir: pd.Series, owner: pd.Series, owner_dir: pd.Series, space: pd.Series, space_dir: pd.Series, root: pd.Series) -> pd.DataFrame:
    rows = [import_plan(*(None if isinstance(v, float) else v for v in r)) for r in zip(specifier, folder, config, config_dir, owner, owner_dir, space, space_dir, root, strict=True)]
    return pd.DataFrame(rows, columns=[f.name for f in PLAN.fields])


def place_files(files: DataFrame, context: DataFrame) -> DataFrame:
    """Adds to (repositoryId, path, ...) the nearest tsconfig and package and the packageName (name, else directory)."""
    config = context.where("kind = 'tsconfig'").select("repositoryId", "dir", F.col("body").alias("config"), F.col("dir").alias("configDir"))
    owner = context.where("kind = 'package'").select("repositoryId", "dir", F.col("body").alias("owner"), F.col("dir").alias("ownerDir"), F.coalesce("name", "dir").alias("packageName"))
    keys = ["repositoryId", "path"]
    placed = resolve.nearest_root(files, config, keys, repository="repositoryId").drop("dir")
    return resolve.nearest_root(placed, owner, keys, repository="repositoryId").drop("dir")


def resolve_imports(imports: DataFrame, placed: DataFrame, context: DataFrame) -> DataFrame:
    """Adds status, targetFilePath, packageName and version to (repositoryId, filePath, ordinal, specifier, ...)."""
    packages = context.where("kind = 'package'")
    spaces = packages.where("workspace AND name IS NOT NULL").withColumn("_nth", F.row_number().over(Window.partitionBy("repositoryId", "name").orderBy(F.length("dir").desc(), "dir"))).where("_nth = 1")
    spaces = spaces.select("repositoryId", F.col("name").alias("_package"), F.col("body").alias("space"), F.col("dir").alias("spaceDir"))
    roots = packages.where("dir = ''").select("repositoryId", F.col("body").alias("root"))
    rows = imports.withColumn("_package", S.split_bare_specifier(F.col("specifier")).packageName)
    near = placed.select("repositoryId", F.col("path").alias("filePath"), "config", "configDir", "owner", "ownerDir")
    rows = rows.join(near, ["repositoryId", "filePath"]).join(spaces, ["repositoryId", "_package"], "left").join(roots, "repositoryId", "left")
    plan = _plans("specifier", P.directory(F.col("filePath")), "config", "configDir", "owner", "ownerDir", "space", "spaceDir", "root")
    rows = rows.withColumn("_plan", plan).withColumn("bases", F.col("_plan.bases"))
    found = resolve.probe(rows, placed, ["repositoryId", "filePath", "ordinal"])
    hit = F.col("targetFilePath").isNotNull()
    external = ~hit & (F.col("_plan.otherwise") == "EXTERNAL")
    return found.select(
        *(c for c in imports.columns if c != "specifier"), F.col("_plan.specifier").alias("specifier"),
        F.when(hit, "RESOLVED").otherwise(F.col("_plan.otherwise")).alias("status"), "targetFilePath",
        F.when(external, F.col("_plan.packageName")).alias("packageName"), F.when(external, F.col("_plan.version")).alias("version"),
    )
