"""Hash chains and Merkle trees over ledger events."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.tables import Tables

GENESIS = "0" * 64
#: So many neighbouring numbers make a slot.
SLOT = 1 << 16
#: What leaf and inner hashes begin with; trees that were made elsewhere may need others.
LEAF_PREFIX, NODE_PREFIX = "leaf:", "node:"


def event_hash(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def verify_chain(events: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of each scope whose number isn't the one after the last, whose link isn't the hash of
    the event before, or whose own hash doesn't fit.

    ``events`` has scope_key, sequence, previous_hash, hash and the hashed fields. The event
    before is found by its number with an equi-join, so a scope may be of any length.
    """
    before = events.select("scope_key", (F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("hash_before"))
    checked = events.join(before, ["scope_key", "sequence"], "left")
    first = F.col("sequence") == 1
    problem = (
        F.when(~first & F.col("hash_before").isNull(), "gap")
        .when(F.col("previous_hash") != F.when(first, F.lit(GENESIS)).otherwise(F.col("hash_before")), "link")
        .when(F.col("hash") != event_hash(F.col("previous_hash"), *map(F.col, fields)), "hash")
    )
    return checked.withColumn("problem", problem).where("problem IS NOT NULL").select("scope_key", "sequence", "problem")


def numbered(rows: DataFrame, scope: str, order: str) -> DataFrame:
    """Adds ``at``: the place of a row in its scope, from 0, by a whole number that differs from
    row to row. Rows are numbered inside slots of that number, which begin where the slots before
    them end, so no window holds the rows of a hot scope."""
    cut = rows.withColumn("slot", F.expr(f"floor(`{order}` / {SLOT})"))
    counts = cut.groupBy(scope, "slot").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(scope).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(scope, "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy(scope, "slot").orderBy(order)) - 1
    return cut.withColumn("inside", inside).join(begins, [scope, "slot"]).withColumn("at", F.col("begin") + F.col("inside")).drop("slot", "begin", "inside")


def leaf_hash(data: Column, prefix: str = LEAF_PREFIX) -> Column:
    return F.sha2(F.concat(F.lit(prefix), data.cast("string")), 256)


def _leaf_nodes(leaves: DataFrame, prefix: str) -> tuple[DataFrame, int]:
    """``scope_key, at, hash, last`` (the highest place of the level), and the number of levels
    above the leaves."""
    ends = leaves.groupBy("scope_key").agg(F.max("at").cast("long").alias("last"))
    nodes = leaves.join(ends, "scope_key").select("scope_key", F.col("at").cast("long").alias("at"), leaf_hash(F.col("data"), prefix).alias("hash"), "last")
    longest = ends.agg(F.max("last")).head()[0]
    return nodes, int(longest).bit_length() if longest else 0


def _parents(nodes: DataFrame, prefix: str) -> DataFrame:
    """The next level; a root stays as it is. The height of a level comes with its rows, so a
    level reads the one below only once."""
    side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("hash")))
    pairs = nodes.groupBy("scope_key", F.expr("at div 2").alias("at"), "last").agg(side(0).alias("l"), side(1).alias("r"))
    parent = F.when(F.col("last") == 0, F.col("l")).otherwise(F.sha2(F.concat(F.lit(prefix), F.col("l"), F.coalesce("r", "l")), 256))
    return pairs.select("scope_key", "at", parent.alias("hash"), F.expr("last div 2").alias("last"))


def merkle_levels(leaves: DataFrame, leaf_prefix: str = LEAF_PREFIX, node_prefix: str = NODE_PREFIX) -> DataFrame:
    """All nodes of each scope's tree: ``scope_key, level, at, hash``.

    ``leaves`` has scope_key, at (from 0) and data. Leaf and inner hashes have prefixes; the last of an odd level is paired with itself. A level is one aggregate over pairs, so
    a scope of n leaves takes log2 n small shuffles; each level is written once and read by the next.
    """
    tables = Tables(leaves.sparkSession, "merkle")
    current, height = _leaf_nodes(leaves, leaf_prefix)
    current = tables.put(current)
    shown = lambda level: current.select("scope_key", F.lit(level).alias("level"), "at", "hash")
    out = shown(0)
    for level in range(1, height + 1):
        current = tables.put(_parents(current.where("last > 0"), node_prefix))
        out = out.unionAll(shown(level))
    return out


def merkle_roots(leaves: DataFrame, leaf_prefix: str = LEAF_PREFIX, node_prefix: str = NODE_PREFIX) -> DataFrame:
    """``scope_key, root``. Each level is written, so the plan does not grow with the height."""
    tables = Tables(leaves.sparkSession, "merkle")
    current, height = _leaf_nodes(leaves, leaf_prefix)
    for _ in range(height):
        current = tables.put(_parents(current, node_prefix))
    return current.select("scope_key", F.col("hash").alias("root"))


def merkle_proof(levels: DataFrame, scope_key, at: int) -> DataFrame:
    """The siblings on the way from a leaf to the root: ``level, hash, on_left``."""
    own = levels.where(F.col("scope_key") == scope_key)
    place = F.expr(f"bigint({at}) div (bigint(1) << level)")
    sibling = place.bitwiseXOR(F.lit(1).cast("long"))
    tops = own.groupBy("level").agg(F.max("at").alias("last"))
    wanted = tops.where("last > 0").select("level", F.least(sibling, F.col("last")).alias("at"), (sibling < place).alias("on_left"))
    return own.join(wanted, ["level", "at"]).select("level", "hash", "on_left")


def merkle_proofs(levels: DataFrame, wanted: DataFrame) -> DataFrame:
    """The proofs of many leaves (scope_key, at) at once: ``scope_key, at, level, hash, on_left``.

    A leaf asks for one node of each level below the root, by an equality of scope, level and place.
    """
    tops = levels.groupBy("scope_key", "level").agg(F.max("at").alias("last")).where("last > 0")
    place = F.expr("at div (bigint(1) << level)")
    sibling = place.bitwiseXOR(F.lit(1).cast("long"))
    asked = wanted.select("scope_key", F.col("at").cast("long").alias("at")).distinct().join(tops, "scope_key")
    asked = asked.select("scope_key", "level", F.col("at").alias("leaf_at"), F.least(sibling, F.col("last")).alias("at"), (sibling < place).alias("on_left"))
    return levels.join(asked, ["scope_key", "level", "at"]).select("scope_key", F.col("leaf_at").alias("at"), "level", "hash", "on_left")


def merkle_verify(leaves: DataFrame, proofs: DataFrame, roots: DataFrame, leaf_prefix: str = LEAF_PREFIX, node_prefix: str = NODE_PREFIX) -> DataFrame:
    """Whether leaves lead to the roots by their proofs: ``scope_key, at, verified``.

    ``leaves`` has scope_key, at and data, ``proofs`` is as from ``merkle_proofs``, ``roots`` has
    scope_key and root. A proof has one row a level, so a leaf's own fits a row. A leaf without a
    proof has to be the root itself; without a root nothing is verified.
    """
    paths = proofs.groupBy("scope_key", "at").agg(F.array_sort(F.collect_list(F.struct("level", "hash", "on_left"))).alias("path"))
    step = lambda h, s: F.sha2(F.concat(F.lit(node_prefix), F.when(s["on_left"], F.concat(s["hash"], h)).otherwise(F.concat(h, s["hash"]))), 256)
    none = F.array().cast("array<struct<level:int,hash:string,on_left:boolean>>")
    found = leaves.withColumn("at", F.col("at").cast("long")).join(paths, ["scope_key", "at"], "left").join(roots, "scope_key", "left")
    reached = F.aggregate(F.coalesce("path", none), leaf_hash(F.col("data"), leaf_prefix), step)
    return found.select("scope_key", "at", F.coalesce(reached == F.col("root"), F.lit(False)).alias("verified"))
