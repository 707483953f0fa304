"""Summaries from one scan: counts and the first rows of each group as one mergeable aggregate."""

from collections.abc import Iterator
from heapq import heapify, heappushpop

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.variants import field_text

BEST = "array<struct<a:long,b:string,v:string>>"


class _Last:
    """An entry in reverse order, so the worst one stands first in a heap."""

    __slots__ = ("entry",)

    def __init__(self, entry: tuple):
        self.entry = entry

    def __lt__(self, other: "_Last") -> bool:
        return other.entry < self.entry


def counted_best(rows: DataFrame, k: int) -> DataFrame:
    """``key, n, best``: rows of each key, and the first ``k`` of them in order of ``a, b`` (not
    null, told apart by ``v``).

    ``rows`` has key, a, b, v. A task keeps ``k`` entries of each key while it reads, so what moves
    is bounded by keys, tasks and ``k``, however many rows a key has; partial results are merged
    and cut again.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        heaps: dict[str, list[_Last]] = {}
        for batch in batches:
            for key, *entry in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "v")), strict=True):
                counts[key] = counts.get(key, 0) + 1
                heap, item = heaps.setdefault(key, []), _Last(tuple(entry))
                if len(heap) < k:
                    heap.append(item)
                    if len(heap) == k:
                        heapify(heap)
                elif k:
                    heappushpop(heap, item)
        best = [[dict(zip("abv", x.entry, strict=True)) for x in heaps[key]] for key in counts]
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.string()), ("v", pa.string())]))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array(best, kind)], ["key", "n", "best"])

    found = rows.select("key", F.col("a").cast("long"), "b", "v").mapInArrow(partial, f"key string, n long, best {BEST}")
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, max(k, 1))
    return found.groupBy("key").agg(F.sum("n").alias("n"), merged.alias("best"))


def _path_rank(path: Column, *places: str) -> Column:
    """Which of several places a path is, from 0; their number for any other."""
    inner, rank = F.ltrim(path, F.lit("/")), F.lit(len(places))
    for i, p in reversed(list(enumerate(places))):
        rank = F.when((inner == p) | inner.endswith("/" + p), i).otherwise(rank)
    return rank


def linux_summary(artifacts: DataFrame, page: int = 50) -> DataFrame:
    """Counts and first pages of all families, and the facts of the system, from one scan.

    ``artifacts`` has id, family, created_at, attrs (JSON). Rows ``key, n, best``: for
    ``family:<name>`` the newest artifacts; ``system:os`` the release files, that of /etc before
    that of /usr/lib before others; ``system:hostname`` the lines of hostname files, lowest number
    first; ``system:account``, ``system:user`` (uid from 1000) and ``system:locked`` the accounts.
    Configurations of an overlay tell nothing of the system.
    """
    v = F.col("v")
    text = lambda f: field_text(v, f)
    path = F.coalesce(text("sourcePath"), F.lit(""))
    kind, id_ = text("configKind"), F.col("id").cast("string")
    line = F.trim(text("line"))
    own = (F.col("family") == "LinuxSystemConfig") & F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.overlayContext", "variant")) == "VOID", F.lit(True))
    entry = lambda key, a, b, value: F.struct(key.alias("key"), a.cast("long").alias("a"), b.alias("b"), value.alias("v"))
    when = lambda cond, *e: F.when(own & F.coalesce(cond, F.lit(False)), entry(*e))
    number = F.coalesce(text("lineNumber").try_cast("long"), F.lit(0))
    uid = text("uid").try_cast("long")
    is_host = _path_rank(path, "etc/hostname") == 0
    account = kind == "passwdAccount"
    entries = F.array(
        entry(F.concat(F.lit("family:"), "family"), F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)), id_, id_),
        when(kind == "osRelease", F.lit("system:os"), _path_rank(path, "etc/os-release", "usr/lib/os-release"), path, id_),
        when(is_host & (line != ""), F.lit("system:hostname"), number, line, line),
        when(account, F.lit("system:account"), F.coalesce(uid, F.lit(0)), id_, id_),
        when(account & (uid >= 1000), F.lit("system:user"), uid, id_, id_),
        when((kind == "shadowAccount") & text("locked").isin("true", "1"), F.lit("system:locked"), F.lit(0), id_, id_),
    )
    parsed = artifacts.where("family IS NOT NULL").select("id", "family", "created_at", F.try_parse_json("attrs").alias("v"))
    return counted_best(parsed.select(F.inline(F.array_compact(entries))), page)
