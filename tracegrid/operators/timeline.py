"""The event timeline: filters, pages, counts, facets, histograms, clusters."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.paging import Page, PageRequest, context_of, read_page
from ..plans.tables import Tables
from .ranks import running_sums

#: Buckets of a histogram, and newest ids of a cluster, at most.
MAX_BUCKETS, SAMPLES_EACH = 180, 5
#: Event kinds that a timeline may hold, those that analysis shows first.
ANALYSIS_KINDS = ["REGISTRY_HIVE_LAST_WRITE", "REGISTRY_SAM_LAST_LOGIN", "REGISTRY_SAM_PASSWORD_LAST_SET", "REGISTRY_SYSTEM_SHUTDOWN", "FILE_EXECUTED"]
EVENT_KINDS = [*ANALYSIS_KINDS, "FILE_CREATED", "FILE_MODIFIED", "FILE_ACCESSED", "FILE_DELETED"]
SECOND = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def epoch_second() -> Column:
    """Whole seconds since 1970 of the column ``ts`` (a timestamp without time zone)."""
    return F.expr(SECOND)


def timeline_filter(events: DataFrame, start=None, end=None, event_type: str | None = None) -> DataFrame:
    """Events within both bounds, inclusive, and of one type. A start after the end is an error."""
    if start is not None and end is not None and start > end:
        raise ValueError("time_start is after time_end")
    if start is not None:
        events = events.where(F.col("ts") >= F.lit(start))
    if end is not None:
        events = events.where(F.col("ts") <= F.lit(end))
    return events if event_type is None else events.where(F.col("event_type") == event_type)


def facet_filter(events: DataFrame, start=None, end=None, event_type: str | None = None) -> DataFrame:
    """As ``timeline_filter``, but bounds and times are compared as whole seconds: an event in the
    second of the end is in. The end is turned to an open bound, which scans can prune by."""
    if start is not None:
        events = events.where(F.col("ts") >= F.date_trunc("second", F.lit(start)).cast("timestamp_ntz"))
    if end is not None:
        events = events.where(F.col("ts") < F.expr(f"TIMESTAMP_NTZ'{end:%Y-%m-%d %H:%M:%S}' + INTERVAL 1 SECOND"))
    return events if event_type is None else events.where(F.col("event_type") == event_type)


def supported(events: DataFrame, analysis_only: bool = False) -> DataFrame:
    """Events of the kinds that a timeline may hold, or of those that analysis shows."""
    return events.where(F.col("event_type").isin(*(ANALYSIS_KINDS if analysis_only else EVENT_KINDS)))


def of_objects(events: DataFrame, objects: DataFrame) -> DataFrame:
    """Events of a table of objects (source_object_id)."""
    return events.join(objects.select("source_object_id").distinct(), "source_object_id", "left_semi")


def oldest_page(events: DataFrame, limit: int = 100, after: tuple | None = None) -> DataFrame:
    """A page in the other direction: oldest first, then source and id, behind a cursor."""
    if after is not None:
        ts, source, event_id = F.lit(after[0]), after[1], after[2]
        later_id = (F.col("data_source_id") > source) | ((F.col("data_source_id") == source) & (F.col("id") > event_id))
        events = events.where((F.col("ts") > ts) | ((F.col("ts") == ts) & later_id))
    return events.orderBy("ts", "data_source_id", "id").limit(limit)


def newest_first() -> list[Column]:
    return [F.desc("ts"), F.asc("data_source_id"), F.asc("id")]


def page(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in timeline order: newest first, then source, then id."""
    ordered = events.orderBy(*newest_first())
    return (ordered.offset(offset) if offset else ordered).limit(min(limit, 500))


def after_cursor(events: DataFrame, ts, data_source_id, event_id) -> DataFrame:
    """Events behind a cursor in timeline order, as a predicate that reaches the scan."""
    at = F.lit(ts)
    return events.where(
        (F.col("ts") < at)
        | ((F.col("ts") == at) & (F.col("data_source_id") > data_source_id))
        | ((F.col("ts") == at) & (F.col("data_source_id") == data_source_id) & (F.col("id") > event_id))
    )


def read_timeline(events: DataFrame, request: PageRequest, revision: str, start=None, end=None, event_type: str | None = None) -> Page:
    """A page of filtered events in timeline order, by an opaque cursor that only goes on with the
    same bounds, type and revision."""
    found = timeline_filter(events, start, end, event_type)
    keys = [("ts", True), ("data_source_id", False), ("id", False)]
    return read_page(found, keys, request, revision, context_of("timeline", start=start, end=end, event_type=event_type))


def of_cluster(events: DataFrame, event_type: str, description: str | None) -> DataFrame:
    """The events of one cluster, as ``clusters`` forms them; a predicate that reaches the scan."""
    return events.where((F.col("event_type") == event_type) & F.col("description").eqNullSafe(F.lit(description)))


def facet_summary(events: DataFrame, filtered: DataFrame) -> DataFrame:
    """One row for the filtered events (total, first, last), and one for each type over all."""
    totals = filtered.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    types = events.groupBy("event_type").agg(F.count("*").alias("n"))
    return totals.select(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("event_type"), "n", "first_ts", "last_ts").unionByName(
        types.select(F.lit("type").alias("facet"), "event_type", "n"), allowMissingColumns=True
    )


def histogram(events: DataFrame, requested: int) -> DataFrame:
    """Equal-width buckets over the whole seconds from first to last event; empty ones stay.

    There are as many as requested, 1 to 180, and no more than seconds. Bucket i starts at
    first + floor(span * i / n). Events are counted by second before they meet the buckets.
    """
    seconds = events.groupBy(epoch_second().alias("second")).agg(F.count("*").alias("n"))
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
        F.expr(SECOND.replace("ts)", "lo)")).alias("first"), F.expr(SECOND.replace("ts)", "hi)")).alias("last")
    ).where("first IS NOT NULL")
    spans = ends.withColumn("span", F.expr("last - first + 1")).withColumn(
        "buckets", F.least(F.lit(max(1, min(requested, MAX_BUCKETS))), F.col("span"))
    )
    placed = seconds.crossJoin(F.broadcast(spans)).withColumn("guess", F.expr("(second - first) * buckets div span"))
    start = "first + span * {} div buckets"
    # the bucket by division, moved on where the floor of an edge says so
    index = F.expr(f"guess + CASE WHEN second >= {start.format('(guess + 1)')} THEN 1 ELSE 0 END")
    counted = placed.groupBy(index.alias("bucket")).agg(F.sum("n").alias("n"))
    frame = spans.select("*", F.explode(F.expr("sequence(0, int(buckets) - 1)")).alias("bucket"))
    return frame.join(counted, "bucket", "left").select(
        F.col("bucket").cast("long").alias("bucket"),
        F.expr(start.format("bucket")).alias("start_second"),
        F.expr(start.format("(bucket + 1)") + " - 1").alias("end_second"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def window_counts(events: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """Counts in up to 180 disjoint windows of whole seconds, inclusive; empty ones stay."""
    if len(windows) > MAX_BUCKETS:
        raise ValueError(f"more than {MAX_BUCKETS} windows")
    second = epoch_second()
    sums = [F.count(F.when(second.between(a, b), 1)).alias(f"n{i}") for i, (a, b) in enumerate(windows)]
    rows = [F.struct(F.lit(a).cast("long").alias("start_second"), F.lit(b).cast("long").alias("end_second"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(windows)]
    return events.agg(*sums).select(F.inline(F.array(*rows)))


def calendar_rollup(events: DataFrame) -> DataFrame:
    """Counts by source and type for each day, with totals by month, year and in all."""
    dated = events.select("data_source_id", "event_type", F.year("ts").alias("y"), F.month("ts").alias("m"), F.day("ts").alias("d"))
    daily = dated.groupBy("data_source_id", "event_type", "y", "m", "d").agg(F.count("*").alias("n"))
    return daily.rollup("data_source_id", "event_type", "y", "m", "d").agg(F.sum("n").alias("n"))


def clusters(events: DataFrame) -> DataFrame:
    """Events by type and description: count, first, last, the ids of the five newest, the rank
    among all clusters, and the events of the type in all clusters.

    The newest ids are chosen among each task's newest first, so a large cluster isn't gathered.
    """
    key = ["event_type", "description"]
    dealt = Window.partitionBy(*key, F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.desc("ts"), "id")
    newest = events.withColumn("r", F.row_number().over(dealt)).where(F.col("r") <= SAMPLES_EACH)
    order = F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("age"), "id")
    samples = newest.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(order)), 1, SAMPLES_EACH)["id"].alias("ids"))
    counted = events.groupBy(*key).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    of_type = events.groupBy("event_type").agg(F.count("*").alias("total_events"))
    return (
        counted.join(samples, key)
        .join(of_type, "event_type")
        .join(_cluster_ranks(counted), key)
        .select(*key, "n", "first_ts", "last_ts", F.array_join(F.col("ids").cast("array<string>"), ",").alias("sample_ids"), "total_events", "rank")
    )


def _cluster_ranks(counted: DataFrame) -> DataFrame:
    """``event_type, description, rank``: largest first, then by name."""
    cut = counted.select("event_type", "description", (-F.col("n")).alias("order"), F.lit(1).alias("one"))
    placed = running_sums(cut, [], ["order", "event_type", "description"], "one", Tables(counted.sparkSession, "ranks"))
    return placed.select("event_type", "description", (F.col("before") + 1).cast("int").alias("rank"))


def file_activity(files: DataFrame) -> DataFrame:
    """Up to four events of each file: created, modified and accessed where known, and deleted
    (at its change time, with less confidence) for deleted files. Directories have none; times
    that are exactly the epoch are no times."""
    kinds = [("FileCreated", "created_at", 1.0), ("FileModified", "modified_at", 1.0), ("FileAccessed", "accessed_at", 1.0)]
    rows = [F.struct(F.lit(k).alias("event_type"), F.col(c).alias("ts"), F.lit(x).alias("confidence")) for k, c, x in kinds]
    gone = F.struct(F.lit("FileDeleted").alias("event_type"), F.when(F.col("deleted"), F.col("changed_at")).alias("ts"), F.lit(0.65).alias("confidence"))
    made = files.where("entry_type = 'File'").select(F.col("id").alias("source_object_id"), F.inline(F.array(*rows, gone)))
    return made.where("ts IS NOT NULL AND ts <> TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def recent(events: DataFrame, per_source: int = 8, limit: int = 8) -> DataFrame:
    """The newest events of each source, merged to the newest of all."""
    best = Window.partitionBy("data_source_id").orderBy(F.desc("ts"), "id")
    return events.withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_source).drop("r").orderBy(*newest_first()).limit(limit)
