"""Connector and admission policies as pure functions: columns in, decisions out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_WAIT_SECONDS, MOST_RETRIES = 30, 2
SIZE_CAP_KIB = 512_000
ARCHIVE_HOST = "codeload.github.com"
REDACTED, MOST_DEPTH = "[REDACTED]", 10
#: Exact names, normalised names, and name endings, whose values are never logged.
SECRET_EXACT = frozenset(("DATABASE_URL",))
SECRET_NAMES = frozenset(("authorization", "cookie", "setcookie", "credentials", "pem"))
SECRET_ENDINGS = ("token", "secret", "password", "passphrase", "privatekey", "apikey")


def failure_reason(status: Column, has_limit_headers: Column) -> Column:
    """Why a call failed: 401, 404, a plain 403, or something passing."""
    return (
        F.when(status == 401, "UNAUTHENTICATED")
        .when((status == 404) | ((status == 403) & ~F.coalesce(has_limit_headers, F.lit(False))), "NOT_ACCESSIBLE")
        .otherwise("UNAVAILABLE")
    )


def may_retry(wait_seconds: Column, retries: Column) -> Column:
    return (wait_seconds <= MOST_WAIT_SECONDS) & (retries < MOST_RETRIES)


def unusable_reason(size_kib: Column, default_branch: Column, branch_probe: Column) -> Column:
    """Why a repository can't be connected; null if it can. branch_probe: EMPTY, or anything else."""
    empty = (size_kib == 0) & (default_branch.isNull() | F.coalesce(branch_probe == "EMPTY", F.lit(False)))
    return F.when(empty, "EMPTY_REPOSITORY").when(size_kib > SIZE_CAP_KIB, "REPOSITORY_TOO_LARGE").when(default_branch.isNull(), "DEFAULT_BRANCH_UNRESOLVABLE")


def index_refusal(mode: Column, allowed_by_rate: Column, status: Column) -> Column:
    """Why an index run is not started; null if it is."""
    return F.when(mode != "FULL", "UNSUPPORTED_MODE").when(~allowed_by_rate, "RATE_LIMITED").when(status == "INDEXING", "ALREADY_INDEXING")


def _is_secret(key: str) -> bool:
    plain = re.sub(r"[^a-z0-9]", "", key.lower())
    return key in SECRET_EXACT or plain in SECRET_NAMES or plain.endswith(SECRET_ENDINGS) or key.endswith(("_KEY", "_SECRET", "_TOKEN"))


def redact(value, depth: int = 0):
    """A JSON value without the values of secret keys."""
    if depth >= MOST_DEPTH:
        return value
    if isinstance(value, list):
        return [redact(x, depth + 1) for x in value]
    if isinstance(value, dict):
        return {k: REDACTED if _is_secret(k) else redact(v, depth + 1) for k, v in value.items()}
    return value


@F.pandas_udf(T.StringType())
def redact_json(column: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else json.dumps(redact(json.loads(text)))
        except ValueError:
            return None

    return column.map(one)


class Answer(NamedTuple):
    status: int
    headers: dict[str, str]
    body: bytes = b""


def fetch_archive(get: Callable[[str, dict[str, str]], Answer], url: str, token: str) -> tuple[bytes | None, str | None]:
    """(archive, None) or (None, reason) over two requests that ``get`` makes without following redirects.

    The credential goes to the first address only, and the second must be the archive host.
    """
    first = get(url, {"authorization": f"Bearer {token}"})
    if first.status in (301, 302, 307, 308):
        target = {k.lower(): v for k, v in first.headers.items()}.get("location", "")
        if re.match(rf"https://{re.escape(ARCHIVE_HOST)}(/|$)", target) is None:
            return None, "UNEXPECTED_REDIRECT"
        first = get(target, {})
    if first.status == 200:
        return first.body, None
    names = {k.lower() for k in first.headers}
    if first.status in (403, 429) and names & {"x-ratelimit-remaining", "retry-after"}:
        return None, "RATE_LIMITED"
    return None, {404: "REPO_NOT_FOUND", 401: "ACCESS_REVOKED", 403: "ACCESS_REVOKED"}.get(first.status, "UNAVAILABLE")
