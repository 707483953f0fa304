"""The file catalog: what a listing shows, in which order, and boards over it."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.classify import family_of, type_of_extension
from ..functions.paths import ascii_lower, natural_key
from ..plans.tables import Tables


def visible_rows(files: DataFrame, show_hidden: bool = False) -> DataFrame:
    """Listing rows: hidden and system entries only on request; deleted ones stay."""
    return files if show_hidden else files.where("NOT hidden AND NOT system")


def visible_tree(files: DataFrame, show_hidden: bool = False) -> DataFrame:
    """Tree rows: only the hidden flag counts."""
    return files if show_hidden else files.where("NOT hidden")


def visible_repository(files: DataFrame, show_hidden: bool = False) -> DataFrame:
    """Counted rows: hidden and system only on request, deleted ones never."""
    return visible_rows(files, show_hidden).where("NOT deleted")


def status_rank() -> Column:
    """0 normal, 1 hidden or system, 2 deleted, 3 both."""
    shaded = F.col("hidden") | F.col("system")
    return shaded.cast("int") + 2 * F.col("deleted").cast("int")


def listing_order(sort: str = "name", descending: bool = False, natural: bool = True) -> list[Column]:
    """Directories first, then status, then the chosen key (only this is turned around), then
    name and id. Missing sizes are 0; missing times come first. ``natural`` compares digits as
    numbers."""
    name = natural_key(F.col("name")) if natural else ascii_lower(F.col("name"))
    by_ext = natural_key(F.coalesce("ext", F.lit(""))) if natural else ascii_lower(F.coalesce("ext", F.lit("")))
    key = {"name": name, "size": F.coalesce("size", F.lit(0)), "modified": F.col("modified_at"), "ext": by_ext}[sort]
    chosen = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return [(F.col("entry_type") != "Directory").cast("int").asc(), status_rank().asc(), chosen, name.asc(), F.col("name").asc(), F.col("id").asc()]


def listing(files: DataFrame, sort: str = "name", descending: bool = False, natural: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    ordered = files.orderBy(*listing_order(sort, descending, natural))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def under_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """Entries whose path begins with the prefix, case and all."""
    return files.where(F.col("path").startswith(prefix))


def with_fragments(files: DataFrame, fragments: list[str]) -> DataFrame:
    """Entries that aren't deleted and whose path contains all fragments; none without fragments."""
    if not fragments:
        return files.where(F.lit(False))
    wanted = F.lit(True)
    for f in fragments:
        wanted &= F.col("path").contains(f)
    return files.where(~F.col("deleted") & wanted)


def child_counts(files: DataFrame) -> DataFrame:
    """Entries and directories below each parent."""
    return files.groupBy("parent_id").agg(
        F.count("*").alias("children"), F.count(F.when(F.col("entry_type") == "Directory", 1)).alias("directories")
    )


def encryption_counts(files: DataFrame) -> DataFrame:
    """Encrypted, clear, and unknown files."""
    return files.where("entry_type = 'File'").agg(
        F.count(F.when(F.col("encrypted"), 1)).alias("encrypted"),
        F.count(F.when(~F.col("encrypted"), 1)).alias("clear"),
        F.count(F.when(F.col("encrypted").isNull(), 1)).alias("unknown"),
    )


def classified(files: DataFrame) -> DataFrame:
    kind = type_of_extension(F.col("ext"))
    return files.withColumn("file_type", kind).withColumn("family", family_of(F.col("file_type"), F.coalesce("ext", F.lit("")), F.col("name"), F.col("path")))


def classification_board(files: DataFrame) -> DataFrame:
    """Files and bytes by family and type."""
    return (
        classified(files.where("entry_type = 'File'"))
        .groupBy("family", F.coalesce("file_type", F.lit("")).alias("file_type"))
        .agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    )


def board_samples(files: DataFrame, each: int = 30) -> DataFrame:
    """The largest files of each family. Ranks are taken in parts of a family before the whole."""
    rows = classified(files.where("entry_type = 'File'")).select("family", "id", "path", F.coalesce("size", F.lit(0)).alias("size"))
    for part in ([F.pmod(F.xxhash64("id"), F.lit(64))], []):
        best = Window.partitionBy("family", *part).orderBy(F.desc("size"), "path", "id")
        rows = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= each)
    return rows


def ancestors(entries: DataFrame, starts: DataFrame, max_depth: int = 256) -> DataFrame:
    """The chain of parents of each start: ``start_id, depth, id``.

    ``entries`` has id and parent_id, ``starts`` an id. A chain ends at a root, a gap, a cycle or
    the depth. Chains double: a round appends to what is known of each chain the same again,
    seen from its last entry, so 256 levels take nine joins.
    """
    tables = Tables(entries.sparkSession, "ancestors")
    links = entries.where("parent_id IS NOT NULL").groupBy(F.col("id").alias("child")).agg(F.min("parent_id").alias("up"))
    jump = tables.put(links)
    known = starts.select(F.col("id").alias("start_id"), F.lit(0).alias("depth"), "id").distinct()
    span = 1
    while span <= max_depth:
        farther = known.join(jump, F.col("id") == F.col("child")).select("start_id", (F.col("depth") + span).alias("depth"), F.col("up").alias("id"))
        known = tables.put(known.unionAll(farther.where(F.col("depth") <= max_depth)))
        if known.where(F.col("depth") >= span).isEmpty():
            break
        then = jump.select(F.col("child").alias("up"), F.col("up").alias("farther"))
        jump = tables.put(jump.join(then, "up").select("child", F.col("farther").alias("up")))
        span *= 2
    # in a cycle an entry comes again; its first place counts
    return known.groupBy("start_id", "id").agg(F.min("depth").alias("depth")).select("start_id", "depth", "id")


def jump_page(files: DataFrame, target_id, limit: int = 100) -> DataFrame:
    """Where a file stands in its folder's listing, and the offset of the page that shows it: the
    count of siblings whose keys come before its own, so a folder of any size is one aggregate."""
    key = F.struct(
        (F.col("entry_type") != "Directory").cast("int").alias("kind"), status_rank().alias("rank"),
        natural_key(F.col("name")).alias("natural"), "name", "id",
    )
    keyed = files.select("parent_id", "id", key.alias("key"))
    target = keyed.where(F.col("id") == target_id).select("parent_id", F.col("id").alias("target"), F.col("key").alias("at"))
    before = F.count(F.when(F.col("key") < F.col("at"), 1)).cast("int").alias("position")
    counted = keyed.join(F.broadcast(target), "parent_id").groupBy("target", "parent_id").agg(before)
    return counted.select(F.col("target").alias("id"), "parent_id", "position", F.expr(f"position div {limit} * {limit}").alias("page_offset"))


def roots(files: DataFrame) -> DataFrame:
    """Entries without a parent."""
    return files.where("parent_id IS NULL")


def orphans(files: DataFrame) -> DataFrame:
    """Entries whose parent is not in the catalog."""
    ids = files.select(F.col("id").cast("string").alias("parent_id")).distinct()
    return files.where("parent_id IS NOT NULL").withColumn("parent_id", F.col("parent_id").cast("string")).join(ids, "parent_id", "left_anti")


def with_hash(files: DataFrame, column: str, digest: str) -> DataFrame:
    """Files with a digest, written in any case."""
    return files.where(F.lower(column) == digest.lower())


def in_partition(files: DataFrame, partition: str, path: str, any_case: bool = True) -> DataFrame:
    """Entries below a path of a partition (its first component), with or without case."""
    prefix = f"{partition}/{path.strip('/')}".rstrip("/") + "/"
    return files.where(F.lower("path").startswith(prefix.lower()) if any_case else F.col("path").startswith(prefix))


def point(files: DataFrame, entry_id) -> DataFrame:
    return files.where(F.col("id") == entry_id)


def of_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries of a table of ids, each once."""
    return files.join(ids.select("id").distinct(), "id", "left_semi")


def tree_page(files: DataFrame, parent, limit: int = 100, offset: int = 0, show_hidden: bool = False) -> DataFrame:
    """Directories below a parent in natural order, and whether each has directories itself."""
    directories = visible_tree(files.where("entry_type = 'Directory'"), show_hidden)
    above = directories.select(F.col("parent_id").cast("string").alias("key")).distinct().withColumn("has_directories", F.lit(True))
    ordered = directories.where(F.col("parent_id") == parent).orderBy(natural_key(F.col("name")), "id")
    page = (ordered.offset(offset) if offset else ordered).limit(limit)
    return page.withColumn("key", F.col("id").cast("string")).join(above, "key", "left").drop("key").na.fill(False, ["has_directories"])


def without(rows: DataFrame, gone: Column) -> DataFrame:
    """Rows for which the predicate does not hold; unknown ones stay."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


def replace_subtree(files: DataFrame, incoming: DataFrame, prefix: str) -> DataFrame:
    """All entries at or below a path swapped for new ones."""
    at = F.col("path")
    return without(files, (at == prefix.rstrip("/")) | at.startswith(prefix.rstrip("/") + "/")).unionByName(incoming)


def assign_subtrees(entries: DataFrame, tops: DataFrame) -> DataFrame:
    """``id, partition`` of entries (id, parent_id) below the tops (id, partition); an entry below
    several belongs to the nearest."""
    chain = ancestors(entries, entries).join(tops.select("id", "partition"), "id")
    return chain.groupBy(F.col("start_id").alias("id")).agg(F.min(F.struct("depth", "partition"))["partition"].alias("partition"))


def reachability(entries: DataFrame, top_ids: DataFrame) -> DataFrame:
    """One row: entries, those whose parent is missing, and those that reach a top."""
    ids = entries.select(F.col("id").alias("parent_id")).distinct()
    missing = entries.where("parent_id IS NOT NULL").join(ids, "parent_id", "left_anti").agg(F.count("*").alias("orphans"))
    reached = ancestors(entries, entries).join(top_ids.select("id").distinct(), "id").agg(F.count_distinct("start_id").alias("reachable"))
    return entries.agg(F.count("*").alias("entries")).crossJoin(missing).crossJoin(reached)
