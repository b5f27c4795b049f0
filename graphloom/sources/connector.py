"""Calls of a remote host as plain functions of injected callables: pages, conditional reads, tokens, polling.

Nothing here touches the network or keeps state of its own; ``store`` is any mapping.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, MutableMapping
from typing import Any, NamedTuple

from pyspark.sql import SparkSession

from ..functions.policy import Answer

PAGE_SIZE, MOST_PAGES = 100, 50
ETAG_SECONDS = 24 * 3600
TOKEN_SECONDS, TOKEN_MARGIN = 3000, 60
MINT_ATTEMPTS, MINT_PAUSE = 3, 0.25
FINAL_STATUSES = ("INDEXED", "FAILED")


def paged(fetch: Callable[[int, int], list], size: int = PAGE_SIZE, most: int = MOST_PAGES) -> Iterator[Any]:
    """Rows of ``fetch(page, size)`` from page 1 up to a short page, at most ``most`` pages."""
    for page in range(1, most + 1):
        rows = fetch(page, size)
        yield from rows
        if len(rows) < size:
            return


class Cached(NamedTuple):
    tag: str
    body: bytes
    until: float


def conditional_get(get: Callable[[str, dict[str, str]], Answer], store: MutableMapping[tuple, Cached], scope: str, url: str, now: Callable[[], float] = time.time) -> Answer:
    """A read that sends the known tag; "not modified" comes back as 200 with the kept body."""
    key = (scope, "GET", url)
    kept = store.get(key)
    if kept is not None and kept.until <= now():
        kept = None
    answer = get(url, {"if-none-match": kept.tag} if kept else {})
    if answer.status == 304 and kept:
        return Answer(200, answer.headers, kept.body)
    tag = {k.lower(): v for k, v in answer.headers.items()}.get("etag")
    if answer.status == 200 and tag:
        store[key] = Cached(tag, answer.body, now() + ETAG_SECONDS)
    return answer


def cached_token(mint: Callable[[int], tuple[str, float]], store: MutableMapping[int, tuple[str, float]], installation: int, now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> str:
    """An installation's token: kept for 50 minutes, or until a minute before it expires; minting is tried three times.

    A store that fails is passed over: the token is minted then.
    """
    try:
        token, until = store[installation]
        if now() < until:
            return token
    except Exception:  # noqa: BLE001 - a cache is never a reason to fail
        pass
    for attempt in range(MINT_ATTEMPTS):
        try:
            token, expires = mint(installation)
            break
        except Exception:  # noqa: BLE001
            if attempt + 1 == MINT_ATTEMPTS:
                raise
            sleep(MINT_PAUSE * 2**attempt)
    seconds = max(0.0, min(TOKEN_SECONDS, expires - now() - TOKEN_MARGIN))
    if seconds:
        try:
            store[installation] = (token, now() + seconds)
        except Exception:  # noqa: BLE001
            pass
    return token


def until_final(read: Callable[[], str], pause: float = 2.0, sleep: Callable[[float], None] = time.sleep, final: tuple[str, ...] = FINAL_STATUSES) -> Iterator[str]:
    """Statuses as read, up to and including a final one."""
    while True:
        status = read()
        yield status
        if status in final:
            return
        sleep(pause)


def healthy(spark: SparkSession) -> bool:
    """Whether the session answers."""
    return spark.sql("SELECT 1 AS one").first().one == 1


def _failure(answer: Answer) -> str:
    """The reasons of ``policy.failure_reason`` for one answer."""
    limited = bool({k.lower() for k in answer.headers} & {"x-ratelimit-remaining", "retry-after"})
    if answer.status == 401:
        return "UNAUTHENTICATED"
    return "NOT_ACCESSIBLE" if answer.status == 404 or (answer.status == 403 and not limited) else "UNAVAILABLE"


def _read(get: Callable[[str, dict[str, str]], Answer], url: str) -> tuple[dict[str, Any] | None, str | None]:
    answer = get(url, {})
    if answer.status != 200:
        return None, _failure(answer)
    try:
        body = json.loads(answer.body)
    except ValueError:
        body = None
    return (body, None) if isinstance(body, dict) else (None, "UNAVAILABLE")


def repository_metadata(get: Callable[[str, dict[str, str]], Answer], owner: str, name: str) -> tuple[dict[str, Any] | None, str | None]:
    """(metadata, None) or (None, reason); a body without id, name or owner is not understood: UNAVAILABLE.

    What the host leaves out is private, not archived, not disabled, of size 0 and under its usual
    name and address; an empty default branch is none.
    """
    body, reason = _read(get, f"/repos/{owner}/{name}")
    if body is None:
        return None, reason
    login = body["owner"].get("login") if isinstance(body.get("owner"), dict) else None
    known = body.get("name")
    if not isinstance(body.get("id"), int) or not isinstance(login, str) or not isinstance(known, str):
        return None, "UNAVAILABLE"
    usual = {"full_name": f"{login}/{known}", "html_url": f"https://github.com/{login}/{known}", "private": True, "archived": False, "disabled": False}
    given = usual | {k: v for k, v in body.items() if v is not None}
    size = given.get("size")
    return {
        "githubRepoId": given["id"], "owner": login, "name": known, "fullName": given["full_name"], "defaultBranch": given.get("default_branch") or None, "isPrivate": given["private"],
        "htmlUrl": given["html_url"], "sizeKib": size if isinstance(size, (int, float)) else 0, "archived": given["archived"], "disabled": given["disabled"],
    }, None


def head_commit(get: Callable[[str, dict[str, str]], Answer], owner: str, name: str, branch: str) -> tuple[str | None, str | None]:
    """(sha, None) or (None, reason); NOT_ACCESSIBLE means that the branch is gone."""
    body, reason = _read(get, f"/repos/{owner}/{name}/commits/{branch}")
    if body is None:
        return None, reason
    sha = body.get("sha")
    return (sha, None) if isinstance(sha, str) and sha else (None, "UNAVAILABLE")


def probe_branch(get: Callable[[str, dict[str, str]], Answer], owner: str, name: str, branch: str) -> str:
    """HAS_COMMITS, EMPTY where the branch is not there, UNKNOWN for any other answer."""
    status = get(f"/repos/{owner}/{name}/branches/{branch}", {}).status
    return "HAS_COMMITS" if status == 200 else "EMPTY" if status == 404 else "UNKNOWN"
