"""Text for comparison, search and export."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Words of content search: runs of letters and digits, lower-cased; longer ones are not indexed.
LONGEST_WORD_BYTES = 40


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def search_form(text: Column, ascii_only: bool = False) -> Column:
    """NFKC and lower case. ``ascii_only`` promises ASCII text, which needs no Python; else only
    texts that are not ASCII are handed over."""
    if ascii_only:
        return F.lower(text)
    return F.lower(F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text))


def canonical_label(label: Column, ascii_only: bool = False) -> Column:
    """Trimmed, lower-cased, NFKD; one leading ``mailto:`` or ``sid:`` goes."""
    form = F.lower(F.trim(label))
    return F.regexp_replace(form if ascii_only else _nfkd(form), "^(?:mailto:|sid:)", "")


def words(text: Column) -> Column:
    """The words of a text in order."""
    found = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: (w != "") & (F.octet_length(w) <= LONGEST_WORD_BYTES))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the words of the phrase stand one after the other in the text."""
    wanted = [w for w in re.split(r"[^\w]+|_", phrase.lower()) if w]
    joined = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    return joined.contains(" " + " ".join(wanted) + " ") if wanted else F.lit(True)


def grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def html_escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def csv_cell(c: Column) -> Column:
    """A quoted CSV cell. A tab goes before ``= + - @`` so that no program reads a formula."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    guarded = F.when(text.rlike("^[=+@-]"), F.concat(F.lit("\t"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def first_attr(attrs: Column, *keys: str) -> Column:
    """The first of several keys of a JSON object that has a value."""
    return F.coalesce(*(F.get_json_object(attrs, f"$.{k}") for k in keys))


def _cut(data: bytes, at: int) -> int:
    """The last place before a character, from byte ``at`` down."""
    at = max(0, min(at, len(data)))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def highlighted(text: str, query: str, radius: int = 60, most: int = 5, most_bytes: int = 512) -> list[tuple[str, list[tuple[int, int]]]]:
    """Snippets of one text around the words of a query, and where the words stand in them.

    Case does not matter; places are bytes of UTF-8. Hits of which each begins at most twice the
    radius behind the one before make one snippet, from a radius before the first to a radius
    behind the last, cut to ``most_bytes`` and between characters.
    """
    terms = [t.encode() for t in query.lower().split()]
    data, lower = text.encode(), text.lower().encode()
    places = lambda hay, term: [m.start() for m in re.finditer(re.escape(term), hay)]
    hits = sorted({p for t in terms for p in places(lower, t)})
    groups: list[list[int]] = []
    for p in hits:
        if groups and p - groups[-1][1] <= 2 * radius:
            groups[-1][1] = p
        elif len(groups) == most:
            break
        else:
            groups.append([p, p])
    out, longest = [], max(map(len, terms), default=0)
    for first, last in groups:
        piece = data[_cut(data, first - radius) : _cut(data, last + longest + radius)]
        piece = piece[: _cut(piece, most_bytes)]
        inside = piece.decode().lower().encode()
        out.append((piece.decode(), sorted((p, p + len(t)) for t in terms for p in places(inside, t))))
    return out


def highlights(text: Column, query: str, radius: int = 60, most: int = 5, most_bytes: int = 512) -> Column:
    """``array<struct<text, hits: array<struct<start, stop>>>>`` of ``highlighted`` for a column of
    texts; null for null, empty without hits or for a query without words. Texts
    without a hit are not handed to Python."""
    schema = "array<struct<text:string,hits:array<struct<start:int,stop:int>>>>"

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.Series:
        rows = lambda x: [{"text": t, "hits": [{"start": a, "stop": b} for a, b in hits]} for t, hits in highlighted(x, query, radius, most, most_bytes)]
        return texts.map(lambda x: None if x is None else rows(x))

    terms = query.lower().split()
    hit = F.lit(False)
    for t in terms:
        hit |= F.lower(text).contains(t)
    none = F.array().cast(schema)
    return F.when(text.isNull(), None).otherwise(F.coalesce(run(F.when(hit, text)), none))


def snippets(text: Column, term: str, radius: int = 60, most: int = 5) -> Column:
    """Up to ``most`` stretches of text around a term, as they stand; case does not matter."""
    quoted = re.escape(term)
    return F.slice(F.regexp_extract_all(text, F.lit(f"(?isu).{{0,{radius}}}{quoted}.{{0,{radius}}}"), F.lit(0)), 1, most)
