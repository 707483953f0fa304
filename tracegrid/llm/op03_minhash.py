"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidates.

Documents with equal shingle sets form a class first, so copies cost a row each and no more. Classes
are what is linked: a text is found by its doc_id and a 128-bit key, as ids can be repeated.
One hash of each shingle fills ``BINS`` bins with their minima; empty bins are filled by optimal
densification, which draws a donor bin by a hash that all documents share. Bands of the
signature are buckets. A bucket links all its members to one center, so a bucket of m members
gives m - 1 candidates. The center is the member that shares most buckets, which in a family of
near copies is the text that they derive from.

A star can miss a link between two members that are both too far from the center; ``stars``
tells how those are found without comparing all pairs. Every link is confirmed on full sets.

A pair at a similarity of exactly 0.8 shares none of the 32 bands with a chance of 6e-5.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .scratch import Scratch
from .shingles import mix, overlap, shingle_set
from .stars import linked_components

BINS, BAND_ROWS = 192, 6
SIGNED = "doc_id long, content binary, n_shingles long, set_key binary, bands array<long>"


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Give each empty bin the value of the first filled one among its own draws of bins."""
    bins = len(values)
    empty, attempt = np.flatnonzero(~filled), 1
    while len(empty):
        draw = mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt))
        donor = (draw % np.uint64(bins)).astype(np.int64)
        found = filled[donor]
        values[empty[found]] = values[donor[found]]
        empty, attempt = empty[~found], attempt + 1
    return values


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The bins' minima for a sorted, non-empty set. Bins are ranges of the hash."""
    if len(shingles) == 1:
        return np.full(bins, shingles[0])
    bin_of = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, bin_of[1:] != bin_of[:-1]))
    values, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    at = bin_of[first].astype(np.int64)
    values[at], filled[at] = shingles[first], True
    return densify(values, filled)


def bands(values: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit bucket key for each band; the band's number is part of it."""
    grid = mix(values).reshape(-1, rows)
    place = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((grid * place).sum(axis=1, dtype=np.uint64) + np.arange(len(grid), dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """Set size, a 128-bit key of the set, and bucket keys, by row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, buckets = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                buckets.append(bands(signature(s) if len(s) else np.zeros(0, np.uint64)))
            offsets = np.cumsum([0, *map(len, buckets)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *buckets])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("content"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                ["doc_id", "content", "n_shingles", "set_key", "bands"],
            )

    return docs.mapInArrow(sign, SIGNED)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with both texts; a join by ``a`` comes last, so equal ones are neighbours."""
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")


def compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``a, b, na, nb, both``: sizes of both sets and of what they share."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_a = None, None
        for batch in batches:
            counts = np.zeros((3, batch.num_rows), np.int64)
            columns = [batch.column(c).to_pylist() for c in ("a", "ta", "tb")]
            for i, (a, ta, tb) in enumerate(zip(*columns, strict=True)):
                if a != last:
                    last, set_a = a, shingle_set(ta, k)
                set_b = shingle_set(tb, k)
                counts[:, i] = len(set_a), len(set_b), overlap(set_a, set_b)
            arrays = [batch.column("a"), batch.column("b"), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "na", "nb", "both"])

    return _with_texts(pairs, texts).mapInArrow(compare, "a long, b long, na long, nb long, both long")


def beyond(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``a, b, shingle``: what b's set has beyond a's."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                found.append(np.setdiff1d(shingle_set(tb, k), shingle_set(ta, k), assume_unique=True).view(np.int64))
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), values], ["a", "b", "shingle"])

    return _with_texts(pairs, texts).mapInArrow(rest, "a long, b long, shingle long")


def text_key(text: Column) -> Column:
    """A 128-bit key of a text, empty for null."""
    return F.coalesce(F.unhex(F.md5(text.cast("string").cast("binary"))), F.lit(b""))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, content, text``: rows with the key of their text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("content"), text.alias("text"))


def _classes(signs: DataFrame, scratch: Scratch) -> DataFrame:
    """``set_key, doc_id, content, id`` of each set: its first row, and a number in the order of rows."""
    first = F.min(F.struct("doc_id", "content")).alias("first")
    found = scratch.put(signs.groupBy("set_key").agg(first).select("set_key", "first.*"))
    order = ["doc_id", "content", "set_key"]
    ordered = found.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.put(ordered.withColumn("id", F.monotonically_increasing_id()))


def _linked(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, content, n_shingles, id of the class or null), labels (id, component) of classes
    that are linked, and the doc_ids that several rows share."""
    rows = keyed(docs)
    signs = scratch.put(signed(rows, k))
    usable = signs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    repeated = scratch.put(usable.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    classes = _classes(usable, scratch)
    heads = usable.join(classes, ["set_key", "doc_id", "content"]).select("id", "bands").dropDuplicates(["id"])
    heads = scratch.put(heads)
    in_buckets = heads.select(F.explode("bands").alias("bucket"), "id")
    sizes = scratch.put(in_buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    shared = scratch.put(in_buckets.join(sizes, "bucket"))
    scores = scratch.put(shared.groupBy("id").agg(F.sum("size").alias("score")))
    members = scratch.put(shared.join(scores, "id").select("bucket", "id", "score"))
    wanted = scratch.put(classes.join(scores, "id", "left_semi").select("id", "doc_id", "content"))
    # by a shuffle at every size: texts move once, and partitions hold a part of what is wanted
    texts = rows.join(wanted.hint("shuffle_hash"), ["doc_id", "content"]).select("doc_id", "id", "text")
    if not repeated.isEmpty():  # equal rows give one text
        again = texts.join(repeated, "doc_id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
        texts = texts.join(repeated, "doc_id", "left_anti").select("id", "text").unionAll(again)
    texts = scratch.put(texts.select("id", "text"))
    scratch.drop(shared, sizes, wanted)
    scratch.release()
    labels = linked_components(
        members,
        lambda pairs: compared(pairs, texts, k),
        lambda pairs: beyond(pairs, texts, k),
        percent,
        scratch,
    )
    scratch.drop(members, texts)
    ids = classes.select("set_key", "id")
    linkable = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key"))
    of_class = signs.select("doc_id", "content", "n_shingles", linkable.alias("set_key"))
    found = scratch.put(of_class.join(ids, "set_key", "left").select("doc_id", "content", "n_shingles", "id"))
    return found, labels, repeated


def _first_of_components(found: DataFrame, labels: DataFrame, first: Column) -> DataFrame:
    """``id, first`` for all classes: the least of ``first`` over the rows of their component."""
    least = found.where("id IS NOT NULL").groupBy("id").agg(F.min(first).alias("first"))
    least = least.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return least.join(least.groupBy("component").agg(F.min("first").alias("least")), "component").select("id", F.col("least").alias("first"))


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of ``k``-word shingles are similar.

    Returns doc_id, n_shingles, component_id, kept for every row of ``docs`` (``doc_id, text``;
    other columns are ignored). Documents without words, or with null text, are linked with
    nothing; so are rows without a doc_id, whose component is null and which are kept. Rows that
    share a doc_id are one document: what one of them is linked with, all are, so they have one
    component. Texts of any length are compared whole; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    found, labels, repeated = _linked(docs, k, percent, scratch)
    if not repeated.isEmpty():
        of_doc = found.where("id IS NOT NULL").join(repeated, "doc_id", "left_semi").groupBy("doc_id", "id").agg(F.count("*").alias("n"))
        lowest = of_doc.groupBy("doc_id").agg(F.min("id").alias("dst"))
        same = of_doc.join(lowest, "doc_id").select(F.col("id").alias("src"), "dst")
        labels = components(same.unionAll(labels.select("id", "component")), scratch)
    least = scratch.put(_first_of_components(found, labels, F.col("doc_id")))
    component = F.coalesce("first", "doc_id")
    return found.join(least, "id", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """One row of each component of near copies, with all columns of ``docs``.

    Rows count one by one here, whatever their doc_ids: of similar texts the row with the least
    doc_id stays (of several with that id, the one with the least key of its text; of rows equal in
    both, the least by their other columns). Rows without words or without a doc_id all stay; an
    empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "unique")
    found, labels, repeated = _linked(docs, k, percent, scratch)
    least = _first_of_components(found, labels, F.struct("doc_id", "content"))
    row = [F.col("doc_id").alias("_id"), F.col("content").alias("_key")]
    gone = found.join(least, "id").where(F.struct("doc_id", "content") != F.col("first"))
    gone = scratch.put(gone.select(*row).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_key"))
    kept = rows.join(gone, ["_id", "_key"], "left_anti")
    if not repeated.isEmpty():
        alike = found.where("id IS NOT NULL").groupBy(*row).agg(F.count("*").alias("n")).where("n > 1")
        alike = scratch.put(alike.select("_id", "_key"))
        one = kept.join(alike, ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(alike, ["_id", "_key"], "left_anti").select("row").unionAll(one.select("row"))
    return kept.select("row.*")
