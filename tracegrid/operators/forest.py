"""Forests in walk order: numbers of a depth-first and a breadth-first walk, and searches along them.

Nothing walks. Subtree sizes double upwards (a round adds the sizes that stand twice as far below),
places double downwards (an entry's place is the sum of its own and its ancestors' offsets among
their siblings), so a forest of ``2 ** ROUNDS`` levels takes ``ROUNDS`` rounds of joins.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.tables import Tables
from .ranks import running_sums

#: Levels double so many times; what is deeper, or in a cycle, is left out.
ROUNDS = 8
#: Limits of a search: hits that are returned, levels of keys, bytes of a path, bytes of a query.
HITS, LEVELS, PATH_BYTES, QUERY_BYTES = 512, 64, 4096, 256


def _linked(entries: DataFrame) -> DataFrame:
    """``id, up`` and the other columns; ``up`` is null for a root, which has no parent in the table."""
    there = entries.select(F.col("id").alias("up")).distinct()
    return entries.withColumnRenamed("parent_id", "up").join(there.withColumn("_there", F.lit(True)), "up", "left").withColumn("up", F.when(F.col("_there"), F.col("up"))).drop("_there")


def _doubled(rows: DataFrame, value: str, join: Column, tables: Tables) -> DataFrame:
    """``id, value`` after going up to the root; ``join`` combines an entry's ``value`` with ``above``."""
    state = tables.put(rows.select("id", "up", value))
    for _ in range(ROUNDS):
        if state.where("up IS NOT NULL").isEmpty():
            break
        ends = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col(value).alias("above"), F.lit(True).alias("_found"))
        state = tables.put(state.join(ends, "up", "left").select("id", F.col("_up").alias("up"), F.when(F.col("_found"), join).otherwise(F.col(value)).alias(value)))
    return state.where("up IS NULL").select("id", value)


def _sizes(rows: DataFrame, tables: Tables) -> DataFrame:
    """``id, depth, size``: levels above an entry, and entries below it and itself."""
    state = tables.put(rows.select("id", "up", F.col("up").isNotNull().cast("long").alias("depth"), F.lit(1).cast("long").alias("size")))
    for _ in range(ROUNDS):
        if state.where("up IS NOT NULL").isEmpty():
            break
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("below"))
        ends = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("above"))
        farther = state.join(ends, "up", "left").join(below, "id", "left")
        state = tables.put(
            farther.select("id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("above", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("below", F.lit(0))).alias("size"))
        )
    return state.where("up IS NULL").select("id", "depth", "size")


def walk_order(entries: DataFrame, order: list[str]) -> DataFrame:
    """``id, depth, size, place``: each entry's level, the entries of its subtree, and its number in
    a depth-first walk, from 0.

    ``entries`` has id (each once), parent_id and the columns of ``order``, by which siblings and
    roots are visited, then by id. An entry without its parent in the table is a root. Entries in a
    cycle, and below the last level, are left out.
    """
    tables = Tables(entries.sparkSession, "walk-order")
    rows = tables.put(_linked(entries.select("id", "parent_id", *order)))
    sizes = tables.put(_sizes(rows, tables))
    sized = rows.join(sizes, "id").withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("up").cast("string")), F.lit("")))
    offsets = running_sums(sized, ["of"], [*order, "id"], "size", tables)
    offsets = offsets.select("id", "up", F.when(F.col("up").isNull(), F.col("before")).otherwise(F.col("before") + 1).alias("place"))
    return sizes.join(_doubled(offsets, "place", F.col("place") + F.col("above"), tables), "id")


def level_order(entries: DataFrame, order: list[str], key: str | None = None) -> DataFrame:
    """As ``walk_order``, with ``breadth``: the number in a breadth-first walk, of each ``key`` if given."""
    tables = Tables(entries.sparkSession, "level-order")
    placed = walk_order(entries, order)
    keys = [key] if key else []
    if key:
        placed = placed.join(entries.select("id", key), "id")
    return running_sums(placed.withColumn("_one", F.lit(1)), keys, ["depth", "place"], "_one", tables).withColumnRenamed("before", "breadth").drop("_one")


def first_objects(entries: DataFrame, order: list[str], per_source: int = 8) -> DataFrame:
    """The first entries of each source (data_source_id, not null) in a breadth-first walk."""
    return level_order(entries, order, "data_source_id").where(F.col("breadth") < per_source)


def paths(entries: DataFrame, separator: str = "\\") -> DataFrame:
    """``id, path``: the names from below the root to an entry; a root has an empty path."""
    tables = Tables(entries.sparkSession, "paths")
    rows = _linked(entries.select("id", "parent_id", "name")).withColumn("path", F.when(F.col("up").isNull(), "").otherwise(F.coalesce("name", F.lit(""))))
    longer = F.when(F.col("above") == "", F.col("path")).otherwise(F.concat("above", F.lit(separator), "path"))
    return _doubled(rows, "path", longer, tables)


def hive_search(keys: DataFrame, values: DataFrame, query: str, limit: int = HITS) -> DataFrame:
    """Keys and values that contain a text, without case, in walk order: ``number, kind, key_id,
    value_index, path, name, matched_field, preview, total``.

    ``keys`` has id, parent_id, name and position (among its siblings); ``values`` key_id,
    value_index, name and data (as text). A key is hit by its name or path and comes before its
    values; a value by its name, else by its data. The first ``limit`` hits come with the number of
    all. Keys of ``LEVELS`` levels or more below the root, or with longer paths than
    ``PATH_BYTES``, are left out with all below them, as is what hangs on no root.
    """
    wanted = query.strip().lower()
    if not wanted or len(wanted.encode()) > QUERY_BYTES:
        raise ValueError(f"a query has 1 to {QUERY_BYTES} bytes")
    tables = Tables(keys.sparkSession, "hive")
    has = lambda c: F.coalesce(F.lower(c).contains(wanted), F.lit(False))
    walked = walk_order(keys, ["position"]).where(F.col("depth") < LEVELS).join(paths(keys), "id").join(keys.select("id", "name"), "id")
    walked = tables.put(walked.where(F.octet_length("path") <= PATH_BYTES).select(F.col("id").alias("key_id"), "place", "path", "name"))
    none = F.lit(None)
    of_keys = walked.where(has(F.col("name")) | has(F.col("path"))).select(
        "place", F.lit(-1).cast("long").alias("at"), F.lit("key").alias("kind"), "key_id", none.cast("long").alias("value_index"), "path", "name", F.lit("key").alias("matched_field"), F.col("path").alias("preview")
    )
    field = F.when(has(F.col("name")), "valueName").when(has(F.col("data")), "valueData")
    hit = values.select("key_id", F.col("value_index").cast("long").alias("value_index"), "name", field.alias("matched_field"), F.col("data").alias("preview")).where("matched_field IS NOT NULL")
    of_values = hit.join(walked.select("key_id", "place", "path"), "key_id").select("place", F.col("value_index").alias("at"), F.lit("value").alias("kind"), "key_id", "value_index", "path", "name", "matched_field", "preview")
    hits = tables.put(of_keys.unionByName(of_values))
    total = hits.agg(F.count("*").alias("total"))
    first = hits.orderBy("place", "at", "name").limit(limit).crossJoin(F.broadcast(total))
    numbered = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", "at", "name", "kind", "key_id", "value_index", "path", "matched_field", "preview", "total"))).alias("rows"))
    return numbered.select(F.posexplode("rows").alias("number", "r")).select("number", "r.kind", "r.key_id", "r.value_index", "r.path", "r.name", "r.matched_field", "r.preview", "r.total")
