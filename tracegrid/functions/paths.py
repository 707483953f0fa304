"""Paths and names in the form in which they are compared."""

from pyspark.sql import Column, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What parts free text into tokens.
TOKEN_BREAKS = r"[\s,;|()\[\]]"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def normalize_path(c: Column) -> Column:
    """Trimmed, without quotes or brackets around it, with single forward slashes, in ASCII lower
    case, without a last slash unless the path is three characters or fewer."""
    bare = F.regexp_replace(F.trim(c), r"""^["'<\[(]+|["'>\])]+$""", "")
    slashed = ascii_lower(F.regexp_replace(F.regexp_replace(bare, r"\\", "/"), "/{2,}", "/"))
    return F.when(F.length(slashed) > 3, F.regexp_replace(slashed, "(?<=.{3})/+$", "")).otherwise(slashed)


def suffix_key(normalized: Column) -> Column:
    """A normalized path without its drive or first slashes."""
    return F.regexp_replace(normalized, "^(?:[a-z]:/|/+)", "")


def basename(normalized: Column) -> Column:
    return F.element_at(F.split(normalized, "/"), -1)


def extension(name: Column) -> Column:
    """What follows the last dot; null without one and for names that begin with the only dot."""
    found = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return F.when(~F.startswith(name, F.lit(".")) & (found != ""), found)


def is_hidden(name: Column, flag: Column) -> Column:
    return flag | F.startswith(name, F.lit("."))


def looks_like_path(c: Column) -> Column:
    return F.coalesce(c.contains("/") | c.contains("\\"), F.lit(False))


def _parts(text: Column) -> tuple[Column, Column]:
    """The trimmed text with its quoted segments, and its tokens."""
    whole = F.trim(text)
    quoted = F.concat(F.regexp_extract_all(whole, F.lit('"([^"]+)"'), F.lit(1)), F.regexp_extract_all(whole, F.lit("'([^']+)'"), F.lit(1)))
    return F.concat(F.array(whole), quoted), F.split(whole, TOKEN_BREAKS)


def _cleaned(found: Column) -> Column:
    """Distinct and sorted, without quotes around them or full stops and commas at their end."""
    bare = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"""^["']+|["']+$""", ""), r"[.,]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: x != "")))


def path_candidates(text: Column) -> Column:
    """What can be a path in free text: the whole of it, quoted segments (spaces and all), and
    tokens, where they hold a slash; as they stand, distinct and sorted."""
    longer, tokens = _parts(text)
    return _cleaned(F.filter(F.concat(longer, tokens), looks_like_path))


def posix_candidates(text: Column) -> Column:
    """As ``path_candidates``, for absolute paths of two components or more."""
    longer, tokens = _parts(text)
    return _cleaned(F.filter(F.concat(longer, tokens), lambda x: x.rlike("^/(?!/).*/")))


def name_candidates(text: Column) -> Column:
    """What can be a file name in free text: the last components of tokens, and of the whole text
    if it is no path, where they hold a dot."""
    whole = F.trim(text)
    base = lambda x: F.element_at(F.split(x, r"[/\\\\]"), -1)
    direct = F.when(~looks_like_path(whole), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return _cleaned(F.filter(F.concat(direct, F.transform(F.split(whole, TOKEN_BREAKS), base)), lambda x: x.contains(".")))


def natural_key(name: Column) -> Column:
    """A string whose byte order is the natural order of names.

    Runs of digits compare as numbers (leading zeros apart), everything else without ASCII case;
    equal values put shorter runs first, and then case decides. Each run of digits becomes its
    length without zeros, padded, and its digits.
    """
    folded = ascii_lower(name)
    runs = F.regexp_extract_all(folded, F.lit(r"\d+|\D+"), F.lit(0))

    def keyed(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 5, "0"), digits)).otherwise(run)

    widths = F.transform(F.regexp_extract_all(folded, F.lit(r"\d+"), F.lit(0)), lambda r: F.lpad(F.length(r).cast("string"), 5, "0"))
    return F.concat(F.array_join(F.transform(runs, keyed), ""), F.lit("\0"), F.array_join(widths, ""), F.lit("\0"), name)
