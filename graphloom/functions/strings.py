"""Slugs, repository URLs, error codes and webhook JSON as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLUG_LENGTH = 80
#: Codes an index error may begin with.
ERROR_CODES = ("UNSAFE_ARCHIVE", "REPO_TOO_LARGE", "ACCESS_REVOKED", "REPO_NOT_FOUND", "UNKNOWN")


@F.pandas_udf(T.StringType())
def _unmarked(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks: Spark has no built-in for it."""
    strip = lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return names.map(strip)


def slugify(name: Column, ascii_only: bool = False) -> Column:
    """``ascii_only`` leaves out decomposition and with it Python."""
    plain = F.lower(name if ascii_only else _unmarked(name))
    dashed = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, SLUG_LENGTH), r"-+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit("project"))


def next_slug(base: Column, greatest: Column) -> Column:
    """``base`` with the next free number; greatest: the greatest number in use, null if none."""
    return F.concat(base, F.lit("-"), (F.greatest(F.coalesce(greatest, F.lit(1)), F.lit(1)) + 1).cast("string"))


def slug_suffix(slug: Column, base: Column) -> Column:
    """The number of ``base-N``; null for any other slug."""
    rest = F.substring(slug, F.length(base) + 2, F.length(slug))
    return F.when(slug.startswith(F.concat(base, F.lit("-"))) & rest.rlike(r"^[0-9]{1,9}$"), rest.try_cast("int"))


def parse_repository_url(url: Column) -> Column:
    """struct<owner, name, error> of a https://github.com/owner/name URL; error is null if it is one."""
    trimmed = F.trim(url)
    rest = F.regexp_extract(trimmed, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(rest, r"^.*@", ""))
    path = F.regexp_replace(F.regexp_extract(trimmed, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    parts = F.split(path, "/")
    owner, name = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    error = (
        F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, "EMPTY")
        .when(F.length(trimmed) > 512, "TOO_LONG")
        .when(~trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), "NOT_A_URL")
        .when(~F.lower(trimmed).startswith("https://"), "NOT_HTTPS")
        .when(F.contains(rest, F.lit("@")) | host.rlike(r":[0-9]*$"), "HAS_CREDENTIALS_OR_PORT")
        .when(host != "github.com", "WRONG_HOST")
        .when((F.size(parts) != 2) | ~owner.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})$") | ~name.rlike(r"^[A-Za-z0-9._-]{1,100}$"), "BAD_PATH")
    )
    good = error.isNull()
    return F.struct(F.when(good, owner).alias("owner"), F.when(good, name).alias("name"), error.alias("error"))


def parse_error(message: Column) -> Column:
    """struct<code, message>: split at the first ': ' if what precedes it is a known code."""
    at = F.instr(message, ": ")
    code = F.substring(message, F.lit(1), at - 1)
    known = (at > 0) & code.isin(*ERROR_CODES)
    return F.struct(F.when(known, code).otherwise("UNKNOWN").alias("code"), F.when(known, F.substring(message, at + 2, F.length(message))).otherwise(message).alias("message"))


def pr_key(repository: Column, number: Column, sha: Column) -> Column:
    return F.concat_ws(":", repository, number.cast("string"), sha)


def split_bare_specifier(specifier: Column) -> Column:
    """struct<packageName, subpath>; both null for a bare ``@scope``."""
    scoped = specifier.startswith("@")
    name = F.when(scoped, F.regexp_extract(specifier, r"^(@[^/]*/[^/]*)", 1)).otherwise(F.substring_index(specifier, "/", 1))
    name = F.when(~scoped | F.contains(specifier, F.lit("/")), name)
    return F.struct(name.alias("packageName"), F.substring(specifier, F.length(name) + 2, F.length(specifier)).alias("subpath"))


def typed_json(column: Column, path: str, kind: str) -> Column:
    """A JSON member if it has that type (string, boolean or integral), else null; bad JSON gives null."""
    value = F.try_variant_get(F.try_parse_json(column), path, "variant")
    tags = {"string": ["STRING"], "boolean": ["BOOLEAN"], "bigint": ["BIGINT"]}[kind]
    return F.when(F.schema_of_variant(value).isin(*tags), F.try_variant_get(F.try_parse_json(column), path, kind))


def review_drafts(settings: Column) -> Column:
    """The project's draft setting; anything but a boolean counts as false."""
    return F.coalesce(typed_json(settings, "$.reviewDraftPullRequests", "boolean"), F.lit(False))


def is_replayable(payload: Column) -> Column:
    """A non-empty array whose items all have the three string members a replay needs."""
    items = F.from_json(payload, "array<struct<prKey:string, repositoryId:string, projectId:string>>")
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda x: x.prKey.isNotNull() & x.repositoryId.isNotNull() & x.projectId.isNotNull()), F.lit(False))


def kib_to_mib(kib: Column) -> Column:
    return F.round(kib / 1024, 1)


def effective_ttl(expires_at: Column, now: Column) -> Column:
    """Seconds a token may be cached: 50 minutes, a minute before it expires at the latest."""
    return F.greatest(F.least(F.lit(3000).cast("long"), F.unix_timestamp(expires_at) - F.unix_timestamp(now) - 60), F.lit(0).cast("long"))
