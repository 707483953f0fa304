"""Quality rules by compression bands: repetitive text compresses too well, noise too badly.

Counts of words, symbols, repeated lines and repeated word windows give the plain rules. The
method's verdict compares zstandard ratios (compressed bytes over bytes), of the whole document
and of fixed chunks, with limits that depend on the length, as short texts compress less.
"""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Bands: from so many bytes on, the ratio must lie between these two limits.
BANDS = [
    (0, 0.0, 9.0),  # a frame's own bytes weigh too much for a verdict
    (64, 0.45, 1.30),
    (128, 0.42, 1.10),
    (256, 0.38, 0.95),
    (512, 0.33, 0.85),
    (1024, 0.29, 0.78),
    (2048, 0.26, 0.72),
    (4096, 0.24, 0.68),
    (16384, 0.20, 0.66),
]
#: Bytes of a chunk, and the share of a document's bytes in chunks out of band that rejects it.
CHUNK, BAD_SHARE = 4096, 0.25
LEVEL = 3
#: Plain rules: words at least, and percent of words in repeated windows of so many words at most.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_letters = np.array([b & 0xC0 != 0x80 and b not in SPACE for b in range(256)])
_starts = [b[0] for b in BANDS]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, bad_chunk_bytes long"
)


def in_band(n: int, compressed: int) -> bool:
    """Whether a text of ``n`` bytes that compresses to ``compressed`` is within its length's band."""
    _, low, high = BANDS[bisect_right(_starts, n) - 1]
    return low * n <= compressed <= high * n


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key, distinct = ids[:n], len(number)
    for i in range(1, window):  # windows are numbered anew after each word, so keys stay small and exact
        key = key * distinct + ids[i : i + n]
        if i + 1 < window and distinct ** (i + 2) >= 2**63:
            key = np.unique(key, return_inverse=True)[1]
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[at] > 1
    inside = np.zeros(len(words), bool)
    for i in range(window):
        inside[i : i + n] |= again
    return int(inside.sum())


def counted(text: bytes) -> list[int]:
    """The counts of ``COUNTS`` for one text."""
    words = text.split()
    of_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines, again = set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            again += line in lines
            lines.add(line)
    return [len(words), int(of_byte[_letters].sum()), int(of_byte[list(SYMBOLS)].sum()), again, repeated_words(words)]


def compressed_bands(text: bytes, compress) -> tuple[bool, float | None, int, int]:
    """Whether a text is within all bands, its ratio, its chunks, and the bytes of chunks out of band.

    A text of one chunk or less has the band of the whole document alone; the last chunk has the
    band of its own length.
    """
    n = len(text)
    if not n:
        return True, None, 0, 0
    whole = len(compress(text))
    if n <= CHUNK:
        return in_band(n, whole), whole / n, 1, 0
    chunks = [text[i : i + CHUNK] for i in range(0, n, CHUNK)]
    bad = sum(len(c) for c in chunks if not in_band(len(c), len(compress(c))))
    return in_band(n, whole) and bad <= BAD_SHARE * n, whole / n, len(chunks), bad


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, the plain rules and the verdict of compression bands for every row of ``docs``.

    Words are runs without ASCII white space. ``base_failed``: fewer than 50 words, or more than
    half of them in repeated windows of three. ``kept`` is false if the plain rules fail, else
    whether the document is within its bands. Null text counts as empty: no words, no ratio, not
    kept. Repeated rows each give a row, rows without a doc_id too; texts of any length are read
    whole; an empty table gives no rows. Other columns of ``docs`` are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                counts = counted(text or b"")
                words, repeats = counts[0], counts[-1]
                failed = words < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * words
                within, ratio, chunks, bad = compressed_bands(text or b"", compress)
                found.append((*counts, failed, within and not failed, ratio, chunks, bad))
            columns = [list(c) for c in zip(*found, strict=True)] or [[] for _ in range(10)]
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in RULES.split(", ")])

    text = F.col("text").cast("string").cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(judge, RULES)
