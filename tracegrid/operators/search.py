"""Search over names, paths, content and artifact text."""

import re
import unicodedata
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import has_phrase, search_form, snippets, words
from ..plans.paging import Page, PageRequest, context_of, read_page
from ..plans.tables import Tables


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    extensions: tuple[str, ...] = ()
    entry_type: str | None = None
    fields: tuple[str, ...] = ("name", "path", "content")


def split_terms(query: str) -> list[tuple[str, bool]]:
    """Terms of a query and whether they were quoted; double quotes keep phrases together."""
    return [(quoted or plain, bool(quoted)) for quoted, plain in re.findall(r'"([^"]+)"|(\S+)', query)]


def glob_pattern(term: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in term.lower()) + "$"


def term_matches(term: str, field: str) -> Column:
    """Whether a term is found in a field: in names and paths as part of the text, or as a glob
    over the whole name or path; in content as words in a row."""
    text, term = search_form(F.coalesce(F.col(field), F.lit(""))), unicodedata.normalize("NFKC", term)
    if field in ("name", "path"):
        return text.rlike("(?s)" + glob_pattern(term)) if re.search(r"[*?]", term) else text.contains(term.lower())
    return has_phrase(F.coalesce(F.col(field), F.lit("")), term)


def compile_search(request: SearchRequest) -> Column:
    """A predicate: every term in some field, and the wanted type and one of the extensions.
    No terms match everything."""
    wanted = F.lit(True)
    for term, _ in split_terms(request.query):
        found = F.lit(False)
        for field in request.fields:
            found |= term_matches(term, field)
        wanted &= found
    if request.entry_type:
        wanted &= F.col("entry_type") == request.entry_type
    if request.extensions:
        wanted &= F.lower("ext").isin(*(e.lower() for e in request.extensions))
    return wanted


def match_sources(request: SearchRequest) -> Column:
    """The fields in which any of the terms is found, joined by commas."""
    terms = [t for t, _ in split_terms(request.query)]
    hits = []
    for field in request.fields:
        found = F.lit(False)
        for t in terms:
            found |= term_matches(t, field)
        hits.append(F.when(found, F.lit(field)))
    return F.array_join(F.array_compact(F.array(*hits)), ",")


def _hits(documents: DataFrame, request: SearchRequest, sort: str) -> DataFrame:
    keys = {"name": F.lower("name"), "path": F.lower("path"), "size": F.coalesce("size", F.lit(0)), "modified": F.coalesce("modified_at", F.lit(-(2**63)))}
    return documents.where(compile_search(request)).withColumn("sort_key", keys[sort])


def search(documents: DataFrame, request: SearchRequest, sort: str = "name", limit: int = 100, after: tuple | None = None) -> DataFrame:
    """A page of hits in order of a key and id, behind ``after`` (key, id) if given. Missing sizes
    count as 0, missing times as the least."""
    hits = _hits(documents, request, sort)
    if after is not None:
        hits = hits.where((F.col("sort_key") > after[0]) | ((F.col("sort_key") == after[0]) & (F.col("id") > after[1])))
    return hits.orderBy("sort_key", "id").limit(limit)


def read_search(documents: DataFrame, request: SearchRequest, page: PageRequest, revision: str, sort: str = "name") -> Page:
    """As ``search``, by an opaque cursor that only goes on with the same request, order and revision."""
    keys = [("sort_key", False), ("id", False)]
    return read_page(_hits(documents, request, sort), keys, page, revision, context_of("search", sort=sort, **asdict(request)))


def _times(listed: Column, term: str) -> Column:
    return F.size(F.filter(listed, lambda x: x == term))


def ranked_search(documents: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 scores of documents (id, content) that hold any word of the query.

    Only words of the query are counted, in place; the corpus figures are one row of aggregates.
    """
    wanted = sorted({w for w in re.findall(r"\w+", query.lower())})
    # one pass over the texts: their lengths and the counts of the query's words
    tokens = documents.select("id", words(F.coalesce("content", F.lit(""))).alias("w"))
    counts = lambda w: F.array(F.size(w), *(_times(w, t) for t in wanted))
    counted = tokens.select("id", F.transform(F.array("w"), counts)[0].alias("c"))
    counted = Tables(documents.sparkSession, "ranked").put(counted.select("id", F.col("c")[0].alias("dl"), *(F.col("c")[i + 1].alias(f"tf{i}") for i in range(len(wanted)))))
    n_with = [F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"n{i}") for i in range(len(wanted))]
    corpus = counted.agg(F.count("*").alias("docs"), F.avg("dl").alias("avg_dl"), *n_with)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return counted.crossJoin(F.broadcast(corpus)).select("id", score.alias("score")).where("score > 0")


def with_snippets(hits: DataFrame, term: str, content: str = "content") -> DataFrame:
    return hits.withColumn("snippets", snippets(F.col(content), term))
