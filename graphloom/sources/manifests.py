"""Manifests of a repository: JSON with comments, workspace lists, tsconfig chains.

``contexts`` turns manifest texts into one row a package and one a tsconfig; a repository's
manifests are few (MOST_MANIFESTS, MOST_BYTES each), so they are read together.
"""

from __future__ import annotations

import json
import posixpath
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name, glob_regex

MOST_MANIFESTS, MOST_BYTES, MOST_EXTENDS = 3000, 256 * 1024, 20
_PIECES = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)
_TRAILING = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.S)


def parse_jsonc(text: str | None) -> dict[str, Any] | None:
    """An object from JSON with comments and trailing commas; None for anything else."""
    if text is None or len(text.encode()) > MOST_BYTES:
        return None
    plain = _TRAILING.sub(lambda m: m[1] or "", _PIECES.sub(lambda m: m[1] or " ", text.removeprefix("\ufeff")))
    try:
        found = json.loads(plain)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def pnpm_packages(text: str) -> list[str]:
    """The items of the top-level ``packages:`` list of a pnpm-workspace.yaml."""
    lines = [x.strip() for x in text.splitlines()]
    if "packages:" not in lines:
        return []
    found = []
    for line in lines[lines.index("packages:") + 1 :]:
        if line.startswith("- "):
            found.append(re.sub(r"""^(["'])(.*)\1$""", r"\2", line[2:].strip()))
        elif line:
            break
    return [x for x in found if x]


def npm_workspaces(manifest: dict[str, Any]) -> list[str]:
    value = manifest.get("workspaces")
    if isinstance(value, dict):
        value = value.get("packages")
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def _inside(path: str) -> str | None:
    """A normalised path in the repository, '' for its root; None outside."""
    path = posixpath.normpath(path)
    return None if path == ".." or path.startswith("../") else "" if path == "." else path


def merge_tsconfig(path: str, texts: dict[str, str | None]) -> dict[str, Any] | None:
    """baseUrl and paths of a tsconfig after its chain of relative ``extends``; None if it is unreadable."""
    merged: dict[str, Any] = {}
    seen: set[str] = set()
    at: str | None = path
    while at is not None and at not in seen and len(seen) < MOST_EXTENDS:
        seen.add(at)
        raw = parse_jsonc(texts.get(at))
        if raw is None:
            break
        folder = posixpath.dirname(at)
        options = raw.get("compilerOptions") if isinstance(raw.get("compilerOptions"), dict) else {}
        if isinstance(options.get("baseUrl"), str):  # the nearest setting wins
            merged.setdefault("baseUrl", _inside(posixpath.join(folder, options["baseUrl"])))
        if isinstance(options.get("paths"), dict):
            merged.setdefault("paths", {k: [x for x in v if isinstance(x, str)] for k, v in options["paths"].items() if isinstance(v, list)})
        parent = raw.get("extends")
        at = None
        if isinstance(parent, str) and parent.startswith(("./", "../")):
            at = _inside(posixpath.join(folder, parent))
            at = at if at is None or at.endswith(".json") else at + ".json"
    return merged if parse_jsonc(texts.get(path)) is not None else None


def is_manifest(path: Column) -> Column:
    return base_name(path).rlike(r"^(package\.json|pnpm-workspace\.yaml|nx\.json|turbo\.json|go\.work|jsconfig\.json|tsconfig(\..*)?\.json)$")


CONTEXT = "repositoryId string, kind string, dir string, name string, workspace boolean, body string"


def read_manifests(texts: dict[str, str]) -> list[tuple[str, str, str | None, bool, str]]:
    """(kind, dir, name, in a workspace, JSON body) of each package and tsconfig, and one row ``markers``."""
    packages, configs, globs = [], [], []
    markers = {"malformed": 0, "truncated": len(texts) > MOST_MANIFESTS}
    texts = dict(sorted(texts.items())[:MOST_MANIFESTS])
    for path, text in texts.items():
        folder, name = posixpath.split(path)
        if name in ("nx.json", "turbo.json", "go.work"):
            markers[name] = True
        elif name == "pnpm-workspace.yaml":
            markers[name] = True
            globs += pnpm_packages(text)
        elif name == "package.json":
            body = parse_jsonc(text)
            if body is None:
                markers["malformed"] += 1
                continue
            spaces = npm_workspaces(body)
            if spaces:
                markers["npmWorkspaces"] = True
                globs += spaces
            kept = {k: body[k] for k in ("main", "module", "types", "exports", "imports") if k in body}
            for k in ("dependencies", "devDependencies", "peerDependencies"):
                kept[k] = {a: b for a, b in body[k].items() if isinstance(b, str)} if isinstance(body.get(k), dict) else {}
            packages.append((folder, body.get("name") if isinstance(body.get("name"), str) and body.get("name") else None, kept))
        else:
            merged = merge_tsconfig(path, texts)
            if merged is None:
                markers["malformed"] += 1
            else:
                configs.append((folder, name, merged))
    wanted = [re.compile(glob_regex(g.strip("/").removeprefix("./"))) for g in globs if not g.startswith("!")]
    unwanted = [re.compile(glob_regex(g[1:])) for g in globs if g.startswith("!")]
    rows = []
    for folder, name, kept in packages:
        at = folder or "."
        rows.append(("package", folder, name, any(w.match(at) for w in wanted) and not any(u.match(at) for u in unwanted), json.dumps(kept)))
    one = {}
    for folder, name, merged in sorted(configs, key=lambda x: (x[0], x[1] != "tsconfig.json", x[1])):  # one a directory, tsconfig.json first
        one.setdefault(folder, ("tsconfig", folder, None, False, json.dumps(merged)))
    return [*rows, *one.values(), ("markers", "", None, False, json.dumps(markers))]


def contexts(files: DataFrame) -> DataFrame:
    """Packages and tsconfigs of each repository from (repositoryId, path, text)."""
    manifests = files.where(is_manifest(F.col("path")) & F.col("text").isNotNull()).select("repositoryId", "path", "text")

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = read_manifests(dict(zip(pdf["path"], pdf["text"], strict=True)))
        return pd.DataFrame([(pdf["repositoryId"].iloc[0], *r) for r in rows], columns=["repositoryId", "kind", "dir", "name", "workspace", "body"])

    return manifests.groupBy("repositoryId").applyInPandas(read, CONTEXT)
