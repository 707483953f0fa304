"""Media columns: AVI motion-JPEG files, their frames, and timed clips between shots.

Texts are stored as files of 8-bit samples (``mjpeg``). A reader parses the RIFF index, decodes
each intra frame and compares histograms of neighbouring frames. A shot begins where the
difference exceeds a threshold that follows the differences just before it.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .mjpeg import read_avis, write_avis

HISTOGRAM_BINS = 16
#: A shot begins at a difference above the mean and this many deviations of the last ones.
DEVIATIONS, REMEMBERED, LEAST_DIFFERENCE = 3.0, 8, 0.1
#: Bytes that are coded at once.
CHUNK_BYTES = 1 << 21

STORED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)
CLIPS = "doc_id long, clip int, first_frame int, n_frames int, start_s double, end_s double, brightness double"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with zeros up to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (-len(data) % 64 if data else 64)


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of samples by brightness for each frame."""
    bins = (frames >> 4).astype(np.int64) + HISTOGRAM_BINS * np.arange(len(frames))[:, None]
    counts = np.bincount(bins.ravel(), minlength=HISTOGRAM_BINS * len(frames))
    return counts.reshape(len(frames), -1) / frames.shape[1]


def shot_starts(shares: np.ndarray) -> list[int]:
    """Frames at which shots begin."""
    difference = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    starts = [0]
    for i, d in enumerate(difference):
        recent = difference[max(starts[-1], i - REMEMBERED) : i]
        limit = recent.mean() + DEVIATIONS * recent.std() if len(recent) else 0.0
        if d > max(limit, LEAST_DIFFERENCE):
            starts.append(i + 1)
    return starts


def clip_rows(parsed: dict, frames: np.ndarray) -> list[tuple]:
    """``clip, first_frame, n_frames, start_s, end_s, brightness`` of one file."""
    starts = shot_starts(histograms(frames))
    seconds = parsed["microseconds"] / 1e6
    ends = [*starts[1:], len(frames)]
    return [
        (i, a, b - a, round(a * seconds, 6), round(b * seconds, 6), round(float(frames[a:b].mean()), 3))
        for i, (a, b) in enumerate(zip(starts, ends, strict=True))
    ]


def _parts(sizes: list[int]) -> Iterator[slice]:
    """Neighbouring rows of about CHUNK_BYTES together."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK_BYTES:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if len(sizes) > first:
        yield slice(first, len(sizes))


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as an AVI file; null text counts as empty.

    One row per row of ``docs``, with its doc_id (null ones too); equal texts give equal files,
    texts of any length are stored whole; an empty table gives no rows. Other columns are ignored,
    so their names cannot clash."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [payload_of(t) for t in batch.column("text").to_pylist()]
            for part in _parts([len(p) for _, p in payloads]):
                chosen = payloads[part]
                media = write_avis([p for _, p in chosen])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[part.start : part.stop],
                        pa.array([n for n, _ in chosen], pa.int64()),
                        pa.array(media, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "media"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(write, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """Timed clips of each file: ``doc_id, clip, first_frame, n_frames, start_s, end_s,
    brightness``. Null media gives no rows; bytes that aren't such a file raise an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files = batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()
            for part in _parts([len(f) for f in files]):
                rows = [
                    (i, *r)
                    for i, (p, x) in zip(ids[part], read_avis(files[part]), strict=True)
                    for r in clip_rows(p, x)
                ]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 3]
                names = [c.split()[0] for c in CLIPS.split(", ")]
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.where("media IS NOT NULL").select("doc_id", "media").mapInArrow(read, CLIPS)


def described(media: DataFrame) -> DataFrame:
    """Digests of each file and of the samples read back from it, and its clips as a string."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column("doc_id"), batch.column("n_bytes").to_pylist()
            files = batch.column("media").to_pylist()
            for part in _parts([len(f) for f in files]):
                out = []
                for f, n, (parsed, x) in zip(files[part], sizes[part], read_avis(files[part]), strict=True):
                    payload = x.tobytes()[: parsed["samples"]]
                    shown = ";".join(f"{s:.2f}-{e:.2f}:{b:.3f}" for _, _, _, s, e, b in clip_rows(parsed, x))
                    out.append(
                        (
                            n,
                            len(payload),
                            hashlib.sha256(payload).hexdigest(),
                            zlib.crc32(payload[-64:]),
                            len(f),
                            hashlib.sha256(f).hexdigest(),
                            f"frames={len(x)};{shown}",
                        )
                    )
                names = [c.split()[0] for c in STORED.split(", ")]
                kinds = [pa.string() if c.endswith("string") else pa.int64() for c in STORED.split(", ")][1:]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], *columns], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, STORED)
