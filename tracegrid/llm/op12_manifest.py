"""Merkle dataset manifest: a mountain range of base-16 carries for each indexed partition.

Leaves are sorted by source and document over range partitions and numbered within their source.
A partition holds a run of numbers that starts and ends anywhere. It keeps one stack of open runs
by level: sixteen nodes that belong together carry one node to the next level, and what is open
at the partition's edges leaves as loose peaks. Loose peaks of all partitions meet by parent, at
most sixteen each, level by level. The last run of a level may be short and is hashed as it is,
without padding. The subroots of the sources are leaves of one more tree of the same kind.

Proofs go down again: paths of blocks of 4096 leaves come from joins of node records; inside a
block they are made from its leaves.
"""

from binascii import hexlify, unhexlify
from collections.abc import Iterator
from hashlib import sha256
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

BASE = 16
#: Levels below which a proof is made inside of a block of BASE ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 3
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

RECORDS = "key string, total long, level int, index long, digest binary, loose boolean"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest_of(*parts: Column) -> Column:
    """SHA-256 of strings in a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def field(c: Column) -> Column:
    """A field of a leaf: ``-`` for null, else the bytes of its UTF-8 text, a colon and the text."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, every: int = 5) -> DataFrame:
    """``key, doc_id, leaf, tampered`` for every row of documents.

    ``key`` is the source in a form that keeps its order, null first. ``tampered`` is the leaf of a
    text with A-Z lower-cased where ``every`` divides the CRC-32 of the decimal doc_id, else null.
    """
    fields = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return docs.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        digest_of(*fields, field(text)).alias("leaf"),
        F.when(chosen, digest_of(*fields, field(F.translate(text, UPPER, LOWER)))).alias("tampered"),
    )


def indexed(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Number the rows of each ``key`` from 0 in the given order, as ``index``; ``total`` is their count.

    Rows are sorted over range partitions and written once with their places, so a hot key is
    spread; its offsets in partitions are sums over one row a partition. Rows that are equal in
    the order are told apart by their number in the input.
    """
    keys = ["key", *order, "row"]
    placed = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = scratch.put(placed.withColumn("place", F.monotonically_increasing_id()).drop("row"))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    of_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = placed.groupBy("key", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    runs = runs.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(of_key).alias("total"))
    found = placed.join(runs, ["key", "part"]).withColumn("index", F.col("place") + F.col("shift"))
    return scratch.put(found.drop("part", "place", "shift"))


def level_size(total: Column, level: Column | int) -> Column:
    """Nodes that a tree of ``total`` leaves has at a level."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.ceil(total / F.pow(F.lit(BASE), level)).cast("long")


class Stack:
    """Open runs by level for a run of leaves with consecutive numbers."""

    def __init__(self, key: str, total: int, out: list):
        self.key, self.out = key, out
        self.sizes = [total]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // BASE))
        self.runs: list[list[bytes]] = [[] for _ in self.sizes]
        self.next = [0] * len(self.sizes)

    def record(self, level: int, index: int, digest: bytes, loose: bool = False) -> None:
        self.out.append((self.key, self.sizes[0], level, index, digest, loose))

    def loosen(self, level: int) -> None:
        run = self.runs[level]
        for i, digest in enumerate(run, self.next[level] - len(run)):
            self.record(level, i, digest, True)
        run.clear()

    def push(self, index: int, digest: bytes) -> None:
        """Take a leaf and carry as far as runs are complete."""
        for level, size in enumerate(self.sizes):
            if level or size == 1:
                self.record(level, index, digest)
            if size == 1:
                return
            run = self.runs[level]
            run.append(digest)
            self.next[level] = index + 1
            if (index + 1) % BASE and index + 1 != size:
                return
            if (index + 1 - len(run)) % BASE:  # the run begins in another partition
                self.loosen(level)
                return
            digest = sha256(hexlify(b"".join(run))).digest()
            run.clear()
            index //= BASE

    def close(self) -> None:
        for level in range(len(self.runs)):
            self.loosen(level)


def _record_batch(found: list) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*found, strict=True)]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in RECORDS.split(", ")])


def node_records(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, total, level, index, digest``: all inner nodes, and leaves that are a tree alone.

    ``rows`` has key, total, index and leaf. Any split of the rows over tasks gives the same nodes.
    """

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, after, found = None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "total", "index", "leaf")]
            for key, total, index, leaf in zip(*columns, strict=True):
                if (key, index) != after:
                    if stack:
                        stack.close()
                    stack = Stack(key, total, found)
                stack.push(index, leaf)
                after = key, index + 1
            if found:
                yield _record_batch(found)
                found.clear()
        if stack:
            stack.close()
        if found:
            yield _record_batch(found)

    ordered = rows.select("key", "total", "index", "leaf").sortWithinPartitions("key", "index")
    records = scratch.put(ordered.mapInArrow(stacked, RECORDS))
    nodes = [records.where("NOT loose").drop("loose")]
    loose = records.where("loose").drop("loose")
    top = loose.agg(F.max("total")).first()[0] or 0
    made, level = None, 0
    while top > 1:
        here = loose.where(F.col("level") == level)
        if made is not None:
            here = here.unionAll(made.where(level_size(F.col("total"), level) > 1))
        kids = here.groupBy("key", "total", F.expr(f"index div {BASE}").alias("index")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("index").alias("i"), "digest"))).alias("kids")
        )
        joined = F.array_join(F.transform("kids", lambda k: F.lower(F.hex(k["digest"]))), "")
        level += 1
        made = scratch.put(kids.select("key", "total", F.lit(level).alias("level"), "index", digest_of(joined).alias("digest")))
        nodes.append(made)
        top = -(-top // BASE)
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionAll(more)
    return out


def paths(nodes: DataFrame, down_to: int, tops: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, total, index, lefts, rights`` and the columns of ``tops``: what stands left and right of the
    way from each node at level ``down_to`` (or the top, if it is lower) to the top, lowest first.

    ``nodes`` has key, total, level, index, digest down to that level. ``tops`` has, by key, the
    way on from the top (lefts, rights) and further columns that are passed on.
    """
    is_top = level_size(F.col("total"), F.col("level")) == 1
    whole = nodes.where(is_top & (F.col("level") <= down_to))
    highest = nodes.agg(F.max("level")).first()[0] or 0
    out = whole.select("key", "total", "index").join(tops, "key")
    above = None
    for level in range(highest, down_to, -1):
        here = nodes.where(is_top & (F.col("level") == level)).select("key", "total", "index").join(tops, "key")
        above = here if above is None else here.unionByName(above)
        kids = nodes.where((F.col("level") == level - 1) & ~is_top)
        kids = kids.groupBy("key", F.expr(f"index div {BASE}").alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("index").alias("i"), "digest"))).alias("kids")
        )
        way = above.withColumnRenamed("index", "parent").join(kids, ["key", "parent"]).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("kids") - 1)))
        joined = "aggregate(slice(kids, {}, {}), X'', (found, kid) -> concat(found, kid.digest))"
        rest = [c for c in tops.columns if c not in ("key", "lefts", "rights")]
        above = way.select(
            "key",
            "total",
            F.expr("kids[at].i").alias("index"),
            F.concat(F.array(F.expr(joined.format(1, "at"))), "lefts").alias("lefts"),
            F.concat(F.array(F.expr(joined.format("at + 2", BASE))), "rights").alias("rights"),
            *rest,
        )
        above = scratch.put(above)
    return out if above is None else out.unionByName(above)


class Block:
    """The proofs of the leaves of one block, whose way to the root is known."""

    def __init__(self, path: dict):
        self.lefts, self.rights = [[hexlify(x) for x in path[c]] for c in ("lefts", "rights")]
        self.subroot, self.root = (hexlify(path[c]).decode() for c in ("subroot", "root"))
        self.height = 0
        while self.height < BLOCK_LEVELS and -(-path["total"] // BASE**self.height) > 1:
            self.height += 1
        self.rows: list[tuple] = []

    def proofs(self) -> Iterator[tuple]:
        """Rows of ``PROOFS``; leaves are in order and all there."""
        nodes = [hexlify(row[1]) for row in self.rows]
        ways = []  # by level, for each node: what stands left and right of it
        for _ in range(self.height):
            runs = [list(run) for run in batched(nodes, BASE)]
            ways.append([(b"".join(run[:i]), b"".join(run[i + 1 :])) for run in runs for i in range(len(run))])
            nodes = [hexlify(sha256(b"".join(run)).digest()) for run in runs]
        upper = list(zip(self.lefts, self.rights, strict=True))
        tail = [b"".join(x + y for x, y in upper)]
        for way in reversed(ways):  # proofs from a level on, shared by what lies below
            tail = [x + y + tail[i // BASE] for i, (x, y) in enumerate(way)]
        for i, (doc_id, leaf, tampered) in enumerate(self.rows):
            folded, at = hexlify(leaf if tampered is None else tampered), i
            for way in ways:
                left, right = way[at]
                folded, at = hexlify(sha256(left + folded + right).digest()), at // BASE
            for left, right in upper:
                folded = hexlify(sha256(left + folded + right).digest())
            proof = sha256(tail[i]).hexdigest()
            folded = folded.decode()
            yield doc_id, leaf.hex(), self.subroot, self.root, proof, folded, folded == self.root


def proved(rows: DataFrame, block_paths: DataFrame) -> DataFrame:
    """Leaves with their proofs. A block's path comes first in its task, then its leaves in order."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PROOFS.split(", ")]
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

        def batch_of(block):
            columns = zip(*block.proofs(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        block = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["root"] is not None:
                    if block and block.rows:
                        yield batch_of(block)
                    block = Block(row)
                else:
                    block.rows.append((row["doc_id"], row["leaf"], row["tampered"]))
        if block and block.rows:
            yield batch_of(block)

    block = F.expr(f"index div {BASE**BLOCK_LEVELS}").alias("block")
    below = rows.select("key", block, "index", "doc_id", "leaf", "tampered")
    heads = block_paths.select("key", F.col("index").alias("block"), "total", "lefts", "rights", "subroot", "root")
    both = heads.unionByName(below, allowMissingColumns=True)
    dealt = both.repartition("key", "block").sortWithinPartitions("key", "block", F.col("root").isNull(), "index")
    return dealt.drop("key", "block", "index").mapInArrow(prove, PROOFS)


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The leaves of all documents, the node records of all sources, and the way of each source to the root.

    Leaves: key, doc_id, leaf, tampered, index, total. Records: key, total, level, index, digest.
    Sources: key, subroot, root, lefts, rights.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    rows = indexed(scratch.put(leaves(docs)), ["doc_id", "leaf"], scratch)
    nodes = node_records(rows, scratch)
    is_top = level_size(F.col("total"), F.col("level")) == 1
    subroots = nodes.where(is_top).select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("digest").alias("leaf"))
    subroots = indexed(subroots, ["of"], scratch)
    upper = node_records(subroots, scratch)
    none = F.expr("CAST(array() AS array<binary>)")
    root = upper.where(is_top).select("key", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("root"))
    lowest = subroots.where("total > 1").select("key", "total", F.lit(0).alias("level"), "index", F.col("leaf").alias("digest"))
    ways = paths(upper.unionByName(lowest), 0, root, scratch)
    named = subroots.select("index", F.col("of"), F.col("leaf").alias("subroot"))
    sources = ways.drop("key", "total").join(named, "index").select(F.col("of").alias("key"), "subroot", "root", "lefts", "rights")
    return rows, nodes, scratch.put(sources)


def verified(docs: DataFrame) -> DataFrame:
    """Every document's leaf, its proof, and whether it still folds to the root after tampering.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Null fields are
    hashed as ``-``; a null source is a source of its own and comes first, as rows without a doc_id
    do within theirs; those are never tampered with. Rows with equal doc_ids stand in the order of
    their leaves, equal rows are leaves each. Long texts are hashed whole; an empty table gives no
    rows. Other columns of ``docs`` are ignored.
    """
    rows, nodes, sources = manifest(docs)
    scratch = Scratch(docs.sparkSession, "proofs")
    return proved(rows, paths(nodes, BLOCK_LEVELS, sources, scratch))
