"""Conversation structure repair: Dijkstra on the lattice of turn and grammar state.

A repaired conversation's role initials follow ``(s?(ua)+)?``. Nodes of the lattice are (rows
consumed, grammar state), edges keep, rerole, delete or insert; the queue's key is (cost, audit),
and the search ends at the first accepting end node that is popped. Letters of an audit fix the
repaired rows, and of two audits of one cost at one node none begins the other, so the order of
whole audits is the order of their parts.

Rows are sorted over range partitions with a byte or two each, so a hot conversation is spread.
Its segments of bounded length are searched from each state to each state; up to sixteen
neighbours are then one lattice of segments, searched in the same way, and so on level by level.
Texts come last: they stream through in order behind their conversation's audit and are hashed.
"""

from collections.abc import Callable, Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch

#: Grammar: state 0 is the empty conversation, then after a system, a user, an assistant row.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 1, 2, 5, 5
#: Faults of a row; the first that holds counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows of a segment, and segments that are searched as one lattice.
SEGMENT, FAN = 512, 16

SPACES = r"\x20\x09-\x0D"
SUMMARY = "blank long, duplicate long, truncated long, illegal long, n long, first string, last string, low long, high long, turns long"
NAMES = [c.split()[0] for c in SUMMARY.split(", ")]
WAYS = "ways array<struct<entry:int,exit:int,cost:long,audit:string>>"
SEGMENTS = f"conv_id long, part int, k long, closed boolean, {SUMMARY}, {WAYS}"
PARTS = f"conv_id long, k long, n_parts long, {SUMMARY}, {WAYS}"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Edges = Callable[[int, int], Iterator[tuple[int, str, int, int]]]


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows with damage by the CRC-32 of ``conv_id:turn``.

    Of 20 remainders 0 drops a row (no copies), 1 empties its text, 2 takes out ``[.!?]``, 3 repeats
    it, 4 makes its role user. Nulls are one space in role, text and key.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    ).withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def with_faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct rows ``conv_id, turn, role, digest``, how many there are, and the first one's fault.

    Equal rows become one before they move; the first turn of each text is a minimum by key.
    """
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    truncated = ~F.col("text").rlike(rf"[.!?][{SPACES}]*\z")
    light = rows.where("copies > 0").select("conv_id", "turn", "role", "digest", "copies", F.when(blank, BLANK).when(truncated, TRUNCATED).otherwise(SOUND).alias("fault"))
    distinct = scratch.put(light.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("n")))
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = distinct.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    first = first.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")), F.col("first.turn").alias("_turn"))
    same = [F.col("digest") == F.col("_digest"), F.col("role") == F.col("_role"), F.col("conv_id").eqNullSafe(F.col("_conv_id"))]
    later = F.col("_digest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("fault") != BLANK)
    found = distinct.join(first, same, "left")
    return found.select("conv_id", "turn", "role", "digest", "n", F.when(later, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


def cheapest(entry: int, end: int, edges: Edges, stop: tuple[int, ...] = ()) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) by state of the end nodes, from state ``entry`` before the first row.

    With ``stop`` the search ends at the first popped end node in one of these states, which is
    then the only one returned; else it goes on until all that can be reached are found.
    """
    queue, done, found = [(0, "", 0, entry)], set(), {}
    while queue:
        cost, audit, at, state = heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == end:
            if state in stop:
                return {state: (cost, audit)}
            found[state] = cost, audit
            if len(found) == len(NEXT):
                break
        for more, letters, to_at, to_state in edges(at, state):
            if (to_at, to_state) not in done:
                heappush(queue, (cost + more, audit + letters, to_at, to_state))
    return {} if stop else found


def row_edges(rows: list[tuple[str, int]]) -> Edges:
    """Edits of rows, given as role initial and fault."""

    def edges(at: int, state: int):
        for initial, to in NEXT[state].items():
            if initial != "s":
                yield INSERT, "I", at, to
        if at < len(rows):
            initial, fault = rows[at]
            yield DELETE, "D", at + 1, state
            if fault in (SOUND, TRUNCATED):
                more = OPEN if fault == TRUNCATED else 0
                if initial in NEXT[state]:
                    yield KEEP + more, "K", at + 1, NEXT[state][initial]
                for role in "ua":
                    if role in NEXT[state]:
                        yield REROLE + more, "R", at + 1, NEXT[state][role]

    return edges


def segment_edges(segments: list[dict]) -> Edges:
    """Whole segments as edges, by the state in which they are entered."""
    ways = [[[] for _ in NEXT] for _ in segments]
    for of_segment, segment in zip(ways, segments, strict=True):
        for way in segment["ways"]:
            of_segment[way["entry"]].append(way)

    def edges(at: int, state: int):
        if at < len(segments):
            for way in ways[at][state]:
                yield way["cost"], way["audit"], at + 1, way["exit"]

    return edges


def all_ways(end: int, edges: Edges, whole: bool) -> list[dict]:
    """The cheapest ways between states; of a whole conversation the one from start to acceptance."""
    entries, stop = ((0,), ACCEPTING) if whole else (range(len(NEXT)), ())
    return [
        {"entry": entry, "exit": exit_, "cost": cost, "audit": audit}
        for entry in entries
        for exit_, (cost, audit) in cheapest(entry, end, edges, stop).items()
    ]


def merged(a: dict | None, b: dict) -> dict:
    """The counts of two neighbouring stretches as those of one."""
    if a is None:
        return dict(b)
    out = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated", "illegal", "n", "turns")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out |= {"first": a["first"], "last": b["last"]}
    return out | {"low": a["low"] if a["low"] is not None else b["low"], "high": b["high"] if b["high"] is not None else a["high"]}


def counted(initial: str, fault: int, turn: int | None) -> dict:
    """The counts of one row."""
    counts = {"blank": fault == BLANK, "duplicate": fault == DUPLICATE, "truncated": fault == TRUNCATED, "illegal": 0, "n": 1, "turns": turn is not None}
    return {c: int(x) for c, x in counts.items()} | {"first": initial, "last": initial, "low": turn, "high": turn}


def segments(rows: DataFrame) -> DataFrame:
    """Segments of at most ``SEGMENT`` rows, from rows that are sorted over partitions.

    A conversation of one segment that begins and ends inside of a partition is ``closed``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("k", pa.int64()), ("closed", pa.bool_())] + [(c, pa.string() if c in ("first", "last") else pa.int64()) for c in NAMES] + [("ways", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        key, started, k, held, counts = None, False, 0, [], None
        first_key = True

        def flush(closed: bool) -> None:
            ways = all_ways(len(held), row_edges(held), closed)
            out.append({"conv_id": key, "part": part, "k": k, "closed": closed, **counts, "ways": ways})
            held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "n")]
            for conv_id, turn, initial, fault, n in zip(*columns, strict=True):
                if not started or conv_id != key:
                    if started:
                        flush(k == 0 and not first_key)
                        first_key = False
                    key, started, k, counts = conv_id, True, 0, None
                for copy in range(n):
                    if len(held) == SEGMENT:
                        flush(False)
                        k, counts = k + 1, None
                    kind = fault if copy == 0 or fault == BLANK else DUPLICATE
                    held.append((initial, kind))
                    counts = merged(counts, counted(initial, kind, turn))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if started:
            flush(False)
            yield pa.RecordBatch.from_pylist(out, schema)

    keys = ["conv_id", "turn", "role", "digest"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "n").mapInArrow(cut, SEGMENTS)


def joined_segments(parts: DataFrame) -> DataFrame:
    """Up to ``FAN`` neighbouring stretches of a conversation as one."""

    def join(table: pa.Table) -> pa.Table:
        held = sorted(table.to_pylist(), key=lambda r: r["k"])
        whole = held[0]["n_parts"] <= FAN
        counts = None
        for r in held:
            counts = merged(counts, {c: r[c] for c in NAMES})
        ways = all_ways(len(held), segment_edges(held), whole)
        one = {"conv_id": held[0]["conv_id"], "k": held[0]["k"] // FAN, "n_parts": -(-held[0]["n_parts"] // FAN), **counts, "ways": ways}
        return pa.Table.from_pylist([one], table.schema.remove(table.schema.get_field_index("group")))

    return parts.withColumn("group", F.expr(f"k div {FAN}")).groupBy("conv_id", "group").applyInArrow(join, PARTS)


def searched(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id``, counts and the one way for every conversation that has rows."""
    cut = scratch.put(segments(rows))
    out = cut.where("closed").select("conv_id", *NAMES, "ways")
    rest = cut.where("NOT closed")
    of_conversation = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n_here").over(of_conversation.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rest.groupBy("conv_id", "part").agg(F.count("*").alias("n_here"))
    counts = counts.select(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"), before.alias("before"), F.sum("n_here").over(of_conversation).alias("n_parts"))
    parts = rest.join(counts, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv_id")))
    parts = scratch.put(parts.select("conv_id", (F.col("before") + F.col("k")).alias("k"), "n_parts", *NAMES, "ways"))
    most = parts.agg(F.max("n_parts")).first()[0] or 0
    while most:
        parts = scratch.put(joined_segments(parts))
        if most <= FAN:
            return out.unionAll(parts.select("conv_id", *NAMES, "ways"))
        out = out.unionAll(parts.where("n_parts = 1").select("conv_id", *NAMES, "ways"))
        parts, most = parts.where("n_parts > 1"), -(-most // FAN)
    return out


class Repair:
    """Replays an audit over a conversation's rows and hashes what it leaves."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.hash, self.some = sha256(), False

    def emit(self, initial: str, role: str, text: str) -> None:
        self.hash.update(f"\n{role}:{text}".encode() if self.some else f"{role}:{text}".encode())
        self.state, self.some = NEXT[self.state][initial], True

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.emit(*(("a", "assistant") if self.state == 2 else ("u", "user")), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.emit(role[:1], role, text)
        elif letter == "R":
            self.emit(*(("a", "assistant") if self.state == 2 else ("u", "user")), text)


def repaired(rows: DataFrame) -> DataFrame:
    """Every conversation's faults, cheapest repair and the hash of the repaired rows.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows
    are damaged first. They go by turn, nulls first; those of equal turn by role, then by the
    SHA-256 of role and text, so repeated rows are neighbours. Rows without a conv_id are a
    conversation of their own. Null roles and texts are one space, an empty role has no initial.
    Conversations whose rows are all dropped have zeros, an empty audit and the hash of nothing; an
    empty table gives no rows. Gaps beyond a long are null. Texts of any length are hashed whole,
    and a conversation's hash is one stream in one task, as SHA-256 has no parts; its 16 candidate
    audits, a letter a row, must fit a worker. Other columns of ``rows`` are ignored.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    whole = damaged(rows)
    found = searched(with_faults(whole, scratch), scratch)
    span = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("turns")
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), F.coalesce(span, F.lit(0)).try_cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit"),
    )
    texts = whole.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies")
    keys = ["conv_id", "kind", "turn", "role", "digest"]
    both = heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*keys)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in numbers), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        key, started, head, repair, out = None, False, [0] * len(numbers), None, []

        def flush() -> None:
            repair.inserts()
            out.append((key, *head, repair.audit, repair.hash.hexdigest()))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "copies", "audit", *numbers)]
            for conv_id, kind, role, text, copies, audit, *values in zip(*columns, strict=True):
                if not started or conv_id != key:
                    if started:
                        flush()
                    key, started = conv_id, True
                    head, repair = (values, Repair(audit)) if kind == 0 else ([0] * len(numbers), Repair(""))
                for _ in range(copies or 0):
                    repair.row(role, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()
        if started:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    schema = "conv_id long, " + ", ".join(f"{c} long" for c in numbers) + ", audit string, repaired_sha256 string"
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    return both.drop("turn", "digest").mapInArrow(replay, schema).select(*names)
