"""Best-fit packing by patterns of few lengths and non-negative least squares.

Documents are encoded, a closing id is appended, and those longer than a sequence are cut.
The histogram of piece lengths has at most ``capacity`` rows, whatever the input; from it the
driver enumerates patterns of two or three lengths, fits repeat counts by non-negative least
squares, rounds them down, and packs the residual counts best-fit, also into what patterns left
free. Patterns that leave something free are fitted with those that fill a sequence or after them,
at several prices of a free token; the fit that needs the fewest sequences counts.
The plan says, for each length, which ranks go where. Ranks are dealt without a global sort:
each length is split into slots of bounded size, slots are counted and offset, and a window
numbers the rows of a slot.
"""

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import DEFAULT_VOCABULARY, codec
from .scratch import Scratch

CAPACITY = 1024
CLOSING_ID = 2
#: Patterns kept for each largest length, of those that fill a sequence the ones that the histogram
#: can repeat most, and of the others the ones that leave least free.
PATTERNS_EACH = 10
FIT_ROUNDS = 400
#: Prices of a free token in the fit, as shares of a length's count on average; at the last one
#: patterns that leave anything free do not pay.
PRICES = (1e-4, 1e-3, 1e-2, np.inf)
#: Slots that the ranks are dealt by; rows in a slot at least.
SLOTS, SLOT_ROWS = 50_000, 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
COLUMNS = [x.split()[0] for x in PIECES.split(", ")]


def cuts(n: int, capacity: int) -> list[int]:
    """Where ``n`` ids are cut: all pieces are whole but the first, which takes what is over."""
    return [0, *range(n % capacity or capacity, n + 1, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The pieces of every document: its ids and the closing id, those of more than ``capacity``
    cut into pieces of ``capacity`` ids; the first piece may be shorter.

    Null text counts as empty and gives one piece with the closing id. Only ``doc_id`` and
    ``text`` are read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            found = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(code.encode(text), np.uint32(closing_id)).astype("<u4")
                at = cuts(len(ids), capacity)
                found += [(row, k, x, y - x, zlib.crc32(ids[x:y].tobytes())) for k, (x, y) in enumerate(pairwise(at))]
            rows, *columns = np.array(found, np.int64).reshape(-1, 5).T
            arrays = [batch.column("doc_id").take(pa.array(rows)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays, COLUMNS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


@dataclass
class Plan:
    """Runs of ranks by length: ``edges[l]`` are first ranks, then for each run its first
    sequence and the offset in it. A sequence's number grows with the rank."""

    edges: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int


def candidate_patterns(counts: np.ndarray, capacity: int, each: int = PATTERNS_EACH) -> np.ndarray:
    """Rows of three lengths (0: none) that occur and sum to ``capacity`` at most; the third is the
    longest that has room."""
    found = []
    lengths = np.flatnonzero(counts[:capacity])
    for a in lengths[::-1].tolist():
        rest = capacity - a
        if rest > 2 * a:
            break
        b = lengths[lengths <= min(a, rest)]
        at = np.searchsorted(lengths, np.minimum(b, rest - b), side="right")
        c = np.where(at > 0, lengths[at - 1], 0)
        free = rest - b - c
        room = np.minimum(counts[a], np.minimum(counts[b], np.where(c > 0, counts[c], counts[b])))
        full = np.flatnonzero(free == 0)
        loose = np.flatnonzero(free > 0)
        best = np.append(full[np.argsort(-room[full], kind="stable")[:each]], loose[np.lexsort((-room[loose], free[loose]))[:each]])
        found.append(np.column_stack([np.full(len(best), a), b[best], c[best]]))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit_repeats(counts: np.ndarray, patterns: np.ndarray, capacity: int, price: float = 0.0, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Repeat counts by non-negative least squares (accelerated projected gradient), rounded
    down and never using more of a length than there is. Patterns that leave tokens free pay for
    them; what the fit leaves of their lengths, they take then, those with the least free first."""
    if not len(patterns) or price == np.inf:
        return np.zeros(len(patterns), np.int64)
    size = len(counts)
    target = counts.astype(float)
    target[0] = 0
    free = capacity - patterns.sum(axis=1)
    costs = price * target.sum() / np.count_nonzero(target) * free if price else 0

    def used(x):
        y = np.zeros(size)
        for column in patterns.T:
            y += np.bincount(column, weights=x, minlength=size)
        y[0] = 0
        return y

    def gradient(x):
        r = used(x) - target
        return r[patterns].sum(axis=1) + costs

    probe = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue, for the step
        probe = used(probe)[patterns].sum(axis=1)
        scale = np.linalg.norm(probe)
        probe /= scale
    step = 1 / (1.05 * scale)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0, y - step * gradient(y))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    left, repeats = counts.copy(), np.zeros(len(patterns), np.int64)

    def take(i: int, most: int) -> None:
        lengths, need = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        n = min(most, int((left[lengths] // need).min()))
        repeats[i] += n
        left[lengths] -= n * need

    for i in np.argsort(-x, kind="stable").tolist():
        take(i, int(x[i] + 1e-6))
    for i in np.lexsort((-x, free)).tolist() if price else ():
        if x[i] >= 1:
            take(i, int(counts.max()))
    return repeats


def pack_residual(counts: np.ndarray, capacity: int, begun: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: contents of sequences and how many have them. Sequences that
    are ``begun`` take more where they have room."""
    open_by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for made, n in begun:
        open_by_room[capacity - sum(made)][made] = n
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        room = length
        while left:
            while room < capacity and not open_by_room.get(room):
                room += 1
            if room >= capacity:
                each = min(capacity // length, left)
                n = left // each
                made = (length,) * each
                left -= n * each
                free = capacity - each * length
                open_by_room[free][made] = open_by_room[free].get(made, 0) + n
                room = length
                continue
            made, n = next(iter(open_by_room[room].items()))
            fill = min(room // length, left)  # as many of this length as fit
            n_used = min(n, left // fill)
            if n == n_used:
                del open_by_room[room][made]
            else:
                open_by_room[room][made] = n - n_used
            after, free = made + (length,) * fill, room - fill * length
            open_by_room[free][after] = open_by_room[free].get(after, 0) + n_used
            left -= n_used * fill
    return [x for contents in open_by_room.values() for x in contents.items()]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where each rank of each length goes. ``histogram`` maps lengths 1 to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    begun = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    left = counts.copy()
    left[capacity] = 0

    def taken(patterns: np.ndarray, left: np.ndarray, price: float) -> tuple[list, np.ndarray]:
        repeats, left = fit_repeats(left, patterns, capacity, price), left.copy()
        used = [(tuple(x for x in row if x), n) for row, n in zip(patterns.tolist(), repeats.tolist(), strict=True) if n]
        for contents, n in used:
            for x in contents:
                left[x] -= n
        return used, left

    patterns = candidate_patterns(left, capacity)
    full, after = taken(patterns[patterns.sum(axis=1) == capacity], left, 0)
    loose = candidate_patterns(after, capacity)
    loose = loose[loose.sum(axis=1) < capacity]
    plans = []
    for price in PRICES:
        for done, counts, some in ((full, after, loose), ([], left, patterns))[: 2 if price < np.inf else 1]:
            used, rest = taken(some, counts, price)
            plans.append(pack_residual(rest, capacity, begun + done + used))
    runs = min(plans, key=lambda plan: sum(n for _, n in plan))
    edges, sequence, offset = defaultdict(list), defaultdict(list), defaultdict(list)
    next_rank: dict[int, int] = defaultdict(int)
    first = 0
    for contents, n in runs:
        at = 0
        for length in contents:
            edges[length].append(next_rank[length])
            sequence[length].append(first)
            offset[length].append(at)
            next_rank[length] += n
            at += length
        first += n
    as_arrays = lambda d: {k: np.array(v, np.int64) for k, v in d.items()}
    return Plan(as_arrays(edges), as_arrays(sequence), as_arrays(offset), first)


def ranked(rows: DataFrame, slots: int = SLOTS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Number the rows of each length from 0, as column ``rank``.

    A length's rows are dealt to slots by their number ``row``, so equal rows do not meet in one;
    the table of slots has at most ``slots`` rows and one for each length, so it is broadcast.
    """
    total = rows.count()
    per_slot = max(slot_rows, -(-total // slots))
    sizes = rows.groupBy("length").agg(F.ceil(F.count("*") / per_slot).alias("n_slots"))
    dealt = rows.join(F.broadcast(sizes), "length").withColumn(
        "slot", F.pmod(F.xxhash64("row"), "n_slots")
    )
    below = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slot_sizes = dealt.groupBy("length", "slot").agg(F.count("*").alias("n"))
    first = slot_sizes.select("length", "slot", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "slot").orderBy("row")
    return (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(first), ["length", "slot"])
        .withColumn("rank", F.col("first") + F.col("inside"))
    )


def pack(
    docs: DataFrame, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, path: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Pieces of equal length may change places. Repeated rows are packed each, rows without a doc_id
    too; null and empty texts give a piece with the closing id, texts of any length are cut; an
    empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.put(pieces(docs, capacity, closing_id, path).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(make_plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                here = np.flatnonzero(length == x)
                run = np.searchsorted(p.edges[x], rank[here], side="right") - 1
                sequence[here] = p.sequence[x][run] + rank[here] - p.edges[x][run]
                offset[here] = p.offset[x][run]
            arrays = [*(batch.column(c) for c in COLUMNS), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*COLUMNS, "sequence_id", "offset"])

    return ranked(rows).select(*COLUMNS, F.col("rank").cast("long")).mapInArrow(place, PIECES + ", sequence_id long, offset long")
