"""File content: what it is, its text, previews and byte patterns."""

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes that decide what a content is; bytes of text at most; bytes of a preview.
SNIFF_BYTES, TEXT_BYTES, PREVIEW_BYTES = 64 << 10, 10 << 20, 64 << 10
#: How texts are read, and the bytes of their mark.
CODECS = {"text_utf8": ("utf-8", 0), "text_utf16le": ("utf-16-le", 2), "text_utf16be": ("utf-16-be", 2)}


def _is_text(data: bytes, codec: str) -> bool:
    """Whether bytes decode; a last character may be cut off where the sample ends."""
    try:
        data.decode(codec)
    except UnicodeDecodeError as e:
        return e.end == len(data) and e.reason in ("unexpected end of data", "truncated data")
    return True


def kind_of(data: bytes | None) -> str:
    """text_utf8, text_utf16le, text_utf16be, binary or unsupported_encoding. A byte order mark
    means UTF-16; more than a tenth of zero bytes means binary."""
    sample = bytes(data or b"")[:SNIFF_BYTES]
    for mark, codec in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if sample.startswith(mark):
            even = sample[2 : len(sample) - len(sample) % 2]
            return "text_" + codec.replace("-", "") if _is_text(even, codec) else "unsupported_encoding"
    if sample.count(0) * 10 > len(sample):
        return "binary"
    return "text_utf8" if _is_text(sample, "utf-8") else "unsupported_encoding"


def text_mime(mime: Column) -> Column:
    """Whether a declared type leaves room for text; unknown ones do."""
    known = mime.startswith("text/") | mime.isin("application/json", "application/xml", "application/javascript")
    return F.coalesce(known, F.lit(True))


def decoded(data: bytes) -> tuple[str, str | None]:
    """What a content is and its text. All of it must decode, or it is none; of a last character
    that is cut off, what there is of it is left out."""
    kind = kind_of(data)
    if kind not in CODECS:
        return kind, None
    codec, mark = CODECS[kind]
    try:
        return kind, codecs.getincrementaldecoder(codec)().decode(data[mark:])
    except UnicodeDecodeError:
        return "unsupported_encoding", None


def extract_text(files: DataFrame) -> DataFrame:
    """``id, content_kind, text, byte_count`` of files (id, content, mime): the first
    ``TEXT_BYTES`` bytes as text; null where they are none. Null content is empty text. Each
    content goes to Python once."""

    def read(batches):
        for batch in batches:
            rows = [(None, None) if c is None else decoded(c) for c in batch.column("wanted").to_pylist()]
            found = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *found, batch.column("byte_count")], ["id", "content_kind", "text", "byte_count"])

    content = F.substring(F.coalesce("content", F.lit(b"")), 1, TEXT_BYTES)
    rows = files.select("id", F.when(text_mime(F.col("mime")), content).alias("wanted"), F.octet_length(content).alias("byte_count"))
    id_type = files.schema["id"].dataType.simpleString()
    return rows.mapInArrow(read, f"id {id_type}, content_kind string, text string, byte_count int").na.fill("binary", ["content_kind"])


def text_preview(files: DataFrame, size: int = PREVIEW_BYTES) -> DataFrame:
    """``id, preview, truncated``: the beginning of texts in UTF-8, with a sign for what does not
    decode, and whether there is more."""
    cut = F.substring("content", 1, size)
    return files.select("id", F.make_valid_utf8(cut.cast("string")).alias("preview"), (F.octet_length("content") > size).alias("truncated"))


def byte_pattern(files: DataFrame, pattern: bytes, most: int = 1000) -> DataFrame:
    """Offsets at which a byte pattern stands in each content, overlapping ones too: ``id, offsets,
    truncated`` with at most ``most`` of them in order. Contents without a hit have no row.

    Each content is searched up to one hit more than are kept.
    """
    if not pattern:
        raise ValueError("the pattern is empty")

    def places(data: bytes | None) -> list[int]:
        found, at = [], (data or b"").find(pattern)
        while at >= 0 and len(found) <= most:
            found.append(at)
            at = data.find(pattern, at + 1)
        return found

    def search(batches):
        for batch in batches:
            found = pa.array([places(c) for c in batch.column("content").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "all"])

    id_type = files.schema["id"].dataType.simpleString()
    hits = files.select("id", "content").mapInArrow(search, f"id {id_type}, all array<int>").where(F.size("all") > 0)
    return hits.select("id", F.slice("all", 1, most).alias("offsets"), (F.size("all") > most).alias("truncated"))
