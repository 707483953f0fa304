"""Opaque cursors, page requests, and pages that take and give them."""

import base64
import hashlib
import hmac
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

DOMAIN, MAX_CURSOR_BYTES = "tracegrid/page", 16 * 1024
DEFAULT_LIMIT, MAX_LIMIT, MAX_OFFSET = 100, 500, 10_000


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def encode_cursor(state: dict | list, revision: str, context: str) -> str:
    """A cursor ``v1.<json>.<digest>`` that only fits the revision and query it was made for."""
    body = json.dumps({"state": state, "revision": revision, "context": context}, sort_keys=True, separators=(",", ":")).encode()
    cursor = f"v1.{_b64(body)}.{_b64(hashlib.sha256(DOMAIN.encode() + body).digest())}"
    if len(cursor) > MAX_CURSOR_BYTES:
        raise ValueError("cursor too long")
    return cursor


def decode_cursor(cursor: str, revision: str, context: str) -> dict | list:
    """The state of a cursor. Raises ValueError if it is broken, foreign or stale."""
    if len(cursor) > MAX_CURSOR_BYTES or not cursor.isascii():
        raise ValueError("broken cursor")
    try:
        version, body, digest = cursor.split(".")
        raw = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
    except ValueError as e:
        raise ValueError("broken cursor") from e
    whole = _b64(raw) == body and hmac.compare_digest(digest, _b64(hashlib.sha256(DOMAIN.encode() + raw).digest()))
    if version != "v1" or not whole:
        raise ValueError("broken cursor")
    found = json.loads(raw)
    if found["revision"] != revision:
        raise ValueError("stale cursor")
    if found["context"] != context:
        raise ValueError("cursor of another query")
    return found["state"]


@dataclass(frozen=True)
class PageRequest:
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    cursor: str | None = None

    def validated(self) -> "PageRequest":
        """With the limit in bounds. Raises ValueError for an offset too far or beside a cursor."""
        if self.cursor and self.offset:
            raise ValueError("offset and cursor exclude each other")
        if not 0 <= self.offset <= MAX_OFFSET:
            raise ValueError(f"offset beyond {MAX_OFFSET}")
        return PageRequest(max(1, min(self.limit, MAX_LIMIT)), self.offset, self.cursor)


def histogram_buckets(requested: int) -> int:
    """The bucket count of a request: 60 if none is asked for, else 20 to 180."""
    return 60 if requested == 0 else max(20, min(requested, 180))


def context_of(kind: str, /, **asked) -> str:
    """What a cursor belongs to: a kind of query and all that was asked of it."""
    return f"{kind}:{hashlib.sha256(json.dumps(asked, sort_keys=True, default=str).encode()).hexdigest()}"


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    next_cursor: str | None


def _behind(rows: DataFrame, keys: list[tuple[str, bool]], state: list) -> Column:
    """Whether a row comes after the one whose keys are given. Nulls are least."""
    later = F.lit(False)
    for (name, down), told in reversed(list(zip(keys, state, strict=True))):
        column, at = F.col(name), F.lit(told).cast(rows.schema[name].dataType)
        if told is None:
            beyond = F.lit(False) if down else column.isNotNull()
        else:
            beyond = F.coalesce(column < at, F.lit(True)) if down else F.coalesce(column > at, F.lit(False))
        later = beyond | (column.eqNullSafe(at) & later)
    return later


def read_page(rows: DataFrame, keys: list[tuple[str, bool]], request: PageRequest, revision: str, context: str) -> Page:
    """A page in the order of keys (column, whether it descends), nulls least, and the cursor of the
    next one; None at the end. Keys together must tell rows apart.

    A cursor holds the keys of its page's last row, so a page further on is found by a predicate
    and a top-k, never by skipping. At most ``MAX_LIMIT`` + 1 rows come to the driver.
    """
    request = request.validated()
    if request.cursor:
        rows = rows.where(_behind(rows, keys, decode_cursor(request.cursor, revision, context)))
    ordered = rows.orderBy(*(F.desc(k) if down else F.asc(k) for k, down in keys)).offset(request.offset)
    told = F.struct(*(F.col(k).cast("string") for k, _ in keys))
    found = ordered.select(*rows.columns, told.alias("_told")).limit(request.limit + 1).collect()
    shown, more = found[: request.limit], len(found) > request.limit
    cursor = encode_cursor(list(shown[-1]["_told"]), revision, context) if more else None
    return Page(rows.sparkSession.createDataFrame([tuple(r)[:-1] for r in shown], rows.schema), cursor)
