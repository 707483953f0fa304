"""Timeline and artifact queries."""

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import artifacts as art, joins, timeline as tl
from ..plans.paging import PageRequest
from ..sources.adapters import artifacts, timeline_events
from .registry import query

START, END = datetime(2024, 1, 5, 0, 0, 0), datetime(2024, 1, 20, 12, 0, 0)
_SECOND = "CAST(floor(epoch(ts)) AS BIGINT)"
_BOUNDS = "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"
_ORDER = "ORDER BY ts DESC, data_source_id, id"


@query(f"SELECT id, data_source_id, event_type, ts, description FROM t WHERE {_BOUNDS} AND event_type = 'click' {_ORDER} LIMIT 100")
def timeline_filter(spark, d):
    found = tl.timeline_filter(timeline_events(spark, d), START, END, "click")
    return tl.page(found).select("id", "data_source_id", "event_type", "ts", "description")


@query(f"SELECT id, ts FROM t {_ORDER} LIMIT 50 OFFSET 200")
def timeline_offset_page(spark, d):
    return tl.page(timeline_events(spark, d), 50, 200).select("id", "ts")


@query(f"SELECT id, ts FROM t WHERE ts < TIMESTAMP '2024-01-15 00:00:00' OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND data_source_id > 1) {_ORDER} LIMIT 100")
def timeline_keyset_page(spark, d):
    return tl.page(tl.after_cursor(timeline_events(spark, d), datetime(2024, 1, 15), 1, 2**62)).select("id", "ts")


@query(f"SELECT count(*) AS n FROM t WHERE {_BOUNDS}")
def timeline_count(spark, d):
    return tl.timeline_filter(timeline_events(spark, d), START, END).agg(F.count("*").alias("n"))


@query(f"SELECT event_type, count(*) AS n FROM t WHERE {_BOUNDS} GROUP BY event_type")
def timeline_count_by_type(spark, d):
    return tl.timeline_filter(timeline_events(spark, d), START, END).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """SELECT 'total' AS facet, CAST(NULL AS VARCHAR) AS event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM t
    WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:01'
    UNION ALL SELECT 'type', event_type, count(*), NULL, NULL FROM t GROUP BY event_type"""
)
def timeline_facets(spark, d):
    events = timeline_events(spark, d)
    return tl.facet_summary(events, tl.facet_filter(events, START, END))


@query("SELECT data_source_id, event_type, count(*) AS n FROM t GROUP BY data_source_id, event_type")
def timeline_source_facets(spark, d):
    return timeline_events(spark, d).groupBy("data_source_id", "event_type").agg(F.count("*").alias("n"))


@query(
    f""", s AS (SELECT {_SECOND} AS second FROM t WHERE event_type = 'click'),
    e AS (SELECT min(second) AS first, max(second) - min(second) + 1 AS span FROM s),
    n AS (SELECT first, span, least(60, span) AS n FROM e),
    b AS (SELECT CAST(i AS BIGINT) AS bucket, first + span * i // n AS start_second, first + span * (i + 1) // n - 1 AS end_second FROM n, range(60) r(i) WHERE i < n)
    SELECT bucket, start_second, end_second, count(second) AS n FROM b LEFT JOIN s ON second BETWEEN start_second AND end_second GROUP BY ALL"""
)
def timeline_histogram(spark, d):
    return tl.histogram(tl.timeline_filter(timeline_events(spark, d), event_type="click"), 60)


@query(
    f""", w AS (SELECT CAST(1704067200 + i * 86400 AS BIGINT) AS start_second, CAST(1704067200 + i * 86400 + 43199 AS BIGINT) AS end_second FROM range(30) r(i))
    SELECT start_second, end_second, count(id) AS n FROM w LEFT JOIN t ON {_SECOND} BETWEEN start_second AND end_second GROUP BY ALL"""
)
def timeline_window_counts(spark, d):
    windows = [(1704067200 + i * 86400, 1704067200 + i * 86400 + 43199) for i in range(30)]
    return tl.window_counts(timeline_events(spark, d), windows)


@query(
    """SELECT data_source_id, event_type, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, count(*) AS n
    FROM t GROUP BY ROLLUP (data_source_id, event_type, year(ts), month(ts), day(ts))"""
)
def timeline_calendar_rollup(spark, d):
    return tl.calendar_rollup(timeline_events(spark, d))


@query(
    """, c AS (SELECT event_type, description, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM t GROUP BY 1, 2),
    s AS (SELECT event_type, description, string_agg(CAST(id AS VARCHAR), ',' ORDER BY ts DESC, id) AS sample_ids FROM
      (SELECT *, row_number() OVER (PARTITION BY event_type, description ORDER BY ts DESC, id) AS r FROM t) WHERE r <= 5 GROUP BY 1, 2)
    SELECT c.*, sample_ids, CAST(sum(n) OVER (PARTITION BY c.event_type) AS BIGINT) AS total_events,
      CAST(row_number() OVER (ORDER BY n DESC, c.event_type, c.description) AS INTEGER) AS rank
    FROM c JOIN s ON c.event_type = s.event_type AND c.description = s.description"""
)
def timeline_clusters(spark, d):
    return tl.clusters(timeline_events(spark, d))


@query(
    f"""SELECT id, data_source_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY data_source_id ORDER BY ts DESC, id) AS r FROM t) WHERE r <= 8 {_ORDER} LIMIT 8"""
)
def timeline_recent(spark, d):
    return tl.recent(timeline_events(spark, d)).select("id", "data_source_id", "ts")


@query(
    """, x AS (SELECT doc_id AS id, doc_id % 2 = 0 AS deleted, CASE WHEN doc_id % 29 = 0 THEN 'Directory' ELSE 'File' END AS entry_type,
      TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ts FROM documents)
    SELECT id AS source_object_id, event_type, ts, CASE WHEN event_type = 'FileDeleted' THEN 0.65 ELSE 1.0 END::DOUBLE AS confidence FROM x,
      (VALUES ('FileCreated'), ('FileModified'), ('FileDeleted')) k(event_type)
    WHERE entry_type = 'File' AND (event_type <> 'FileDeleted' OR deleted)"""
)
def timeline_file_activity(spark, d):
    ts = "timestampadd(SECOND, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')"
    rows = spark.read.parquet(f"{d}/documents.parquet").selectExpr(
        "doc_id AS id", "doc_id % 2 = 0 AS deleted", "CASE WHEN doc_id % 29 = 0 THEN 'Directory' ELSE 'File' END AS entry_type",
        f"{ts} AS created_at", f"{ts} AS modified_at", "CAST(NULL AS TIMESTAMP_NTZ) AS accessed_at", f"{ts} AS changed_at",
    )
    return tl.file_activity(rows)


@query("SELECT family, count(*) AS n FROM a GROUP BY family")
def artifact_family_counts(spark, d):
    return art.family_counts(artifacts(spark, d))


@query("SELECT data_source_id, family, count(*) AS n FROM a GROUP BY 1, 2")
def artifact_source_family_counts(spark, d):
    return art.family_counts(artifacts(spark, d), by_source=True)


@query("SELECT count(*) AS n FROM a WHERE lower(family) LIKE '1-%' OR lower(family) LIKE '1-u%'")
def artifact_prefix_total(spark, d):
    return art.prefix_total(artifacts(spark, d), "1-")


@query(
    """SELECT family, count(*) AS total, count(*) FILTER (kind = 'O') AS n_o, count(*) FILTER (kind = 'F') AS n_f,
    greatest(count(*) - count(*) FILTER (kind IN ('O', 'F')), 0) AS other FROM a GROUP BY family"""
)
def artifact_kind_pivot(spark, d):
    return art.kind_pivot(artifacts(spark, d), ["O", "F"])


@query("SELECT id, family, kind FROM a WHERE kind IN ('O', 'P')")
def artifact_of_kinds(spark, d):
    return art.of_kinds(artifacts(spark, d), ["O", "P"]).select("id", "family", "kind")


@query("SELECT id, created_at FROM a ORDER BY created_at DESC, id LIMIT 200 OFFSET 100")
def artifact_created_page(spark, d):
    return art.created_page(artifacts(spark, d), 200, 100).select("id", "created_at")


@query("SELECT (SELECT count(*) FROM a) AS artifacts, (SELECT count(*) FROM t) AS timeline, (SELECT count(*) FROM f) AS files")
def case_metrics(spark, d):
    from ..sources.adapters import files

    return art.case_metrics(artifacts=artifacts(spark, d), timeline=timeline_events(spark, d), files=files(spark, d))


@query(
    """, x AS (SELECT source_object_id, count(*) AS artifacts FROM a GROUP BY 1), y AS (SELECT source_object_id, count(*) AS events FROM t GROUP BY 1),
    z AS (SELECT coalesce(x.source_object_id, y.source_object_id) AS source_object_id, coalesce(artifacts, 0) AS artifacts, coalesce(events, 0) AS events
      FROM x FULL JOIN y ON x.source_object_id = y.source_object_id)
    SELECT *, CASE WHEN artifacts > 0 AND events > 0 THEN 'direct' WHEN artifacts + events >= 3 THEN 'strong' WHEN artifacts + events >= 1 THEN 'weak' ELSE 'heuristic' END AS confidence FROM z"""
)
def correlation_object_groups(spark, d):
    return joins.object_groups(artifacts(spark, d), timeline_events(spark, d))


@query(
    f""", l AS (SELECT id, source_object_id, {_SECOND} AS second, event_type AS match_key FROM t)
    SELECT id, near_id, gap, CAST(r AS INTEGER) AS r FROM (SELECT l.id, r.id AS near_id, abs(l.second - r.second) AS gap,
      row_number() OVER (PARTITION BY l.id ORDER BY abs(l.second - r.second), r.id) AS r
      FROM l JOIN l r ON l.match_key = r.match_key AND l.source_object_id <> r.source_object_id AND abs(l.second - r.second) <= 86400) WHERE r <= 3"""
)
def correlation_temporal_proximity(spark, d):
    rows = timeline_events(spark, d).select("id", "source_object_id", tl.epoch_second().alias("second"), F.col("event_type").alias("match_key"))
    return joins.temporal_proximity(rows, rows)


def first_pages(read, limit: int, pages: int):
    """The first pages that ``read(request)`` gives, each by the cursor of the one before, numbered."""
    cursor, out = None, None
    for number in range(pages):
        found = read(PageRequest(limit, cursor=cursor))
        rows = found.rows.withColumn("page", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
        cursor = found.next_cursor
        if cursor is None:
            break
    return out


@query(
    f"""SELECT id, ts, CAST((row_number() OVER ({_ORDER}) - 1) // 70 AS INTEGER) AS page FROM (SELECT * FROM t WHERE {_BOUNDS} AND event_type = 'click' {_ORDER} LIMIT 280)"""
)
def timeline_cursor_pages(spark, d):
    """Four pages, each found by the cursor that the one before gave."""
    read = lambda request: tl.read_timeline(timeline_events(spark, d), request, "r1", START, END, "click")
    return first_pages(read, 70, 4).select("id", "ts", "page")


@query("SELECT id, ts FROM t WHERE event_type = 'view' AND description = 'view by user 7'")
def timeline_of_cluster(spark, d):
    return tl.of_cluster(timeline_events(spark, d), "view", "view by user 7").select("id", "ts")
