"""Cases: audit trails, processing steps, batches, scopes, ledgers, listings and case search."""

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.paging import Page, PageRequest, context_of, read_page
from .integrity import merkle_roots, numbered

#: Digests of recovered files, with the digits they have.
HASH_COLUMNS = {"md5": 32, "sha1": 40, "sha256": 64}
EVIDENCE_EACH, REPORT_ROWS = 2000, 100_000


def audit_filter(entries: DataFrame, case_id=None, action: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Audit entries of a case and action, newest first."""
    for column, value in (("case_id", case_id), ("action", action)):
        if value is not None:
            entries = entries.where(F.col(column) == value)
    ordered = entries.orderBy(F.desc("created_at"), F.desc("id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def audit_counts(entries: DataFrame) -> DataFrame:
    """Entries by action, and in all (a null action)."""
    return entries.rollup("action").agg(F.count("*").alias("n"))


def step_filter(steps: DataFrame, kind: str | None = None, success: bool | None = None) -> DataFrame:
    """Steps of a kind that went well or not."""
    if kind is not None:
        steps = steps.where(F.col("kind") == kind)
    return steps if success is None else steps.where(F.col("success") == success)


def batch_counts(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """Jobs of each batch by status, in one pass."""
    return jobs.groupBy("batch_id").agg(F.count("*").alias("total"), *(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in statuses))


def recovered_by_hash(recoveries: DataFrame, scans: DataFrame, data_source_id, algorithm: str, digest: str, limit: int = 100) -> DataFrame:
    """Recovered files of a source with a digest, in order of partition and inode (as a number)."""
    if algorithm not in HASH_COLUMNS or not re.fullmatch(rf"[0-9a-f]{{{HASH_COLUMNS.get(algorithm, 0)}}}", digest):
        raise ValueError("a digest is lower-case hexadecimal of a known algorithm")
    if not 1 <= limit <= 100:
        raise ValueError("the limit lies between 1 and 100")
    mine = scans.where(F.col("data_source_id") == data_source_id).select(F.col("id").alias("scan_id"), "partition_index")
    found = recoveries.where(F.col(algorithm) == digest).join(mine, "scan_id")
    return found.orderBy("partition_index", F.col("inode").try_cast("bigint"), "id").limit(limit)


def scope_members(scopes: DataFrame, members: DataFrame) -> DataFrame:
    """Every scope with the number of its members; those without have 0."""
    counted = members.groupBy("scope_id").agg(F.count("*").alias("members"))
    return scopes.join(counted.withColumnRenamed("scope_id", "id"), "id", "left").na.fill(0, ["members"])


def sources_of_scope(sources: DataFrame, members: DataFrame, scope_id) -> DataFrame:
    """Sources that belong to a scope."""
    mine = members.where(F.col("scope_id") == scope_id).select(F.col("source_id").alias("id")).distinct()
    return sources.join(mine, "id")


def annotated_counts(rows: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Rows with what is noted about them: the number of notes and the last one by time."""
    last = F.max(F.struct("noted_at", "note"))
    notes = annotations.groupBy(key).agg(F.count("*").alias("notes"), last.alias("last"))
    return rows.join(notes, key, "left").select("*", F.col("last.note").alias("last_note")).drop("last").na.fill(0, ["notes"])


def nodes_page(nodes: DataFrame, node_type: str | None = None, after=None, limit: int = 100) -> DataFrame:
    """Graph nodes in order of id, of a type, behind a cursor."""
    if node_type is not None:
        nodes = nodes.where(F.col("node_type") == node_type)
    return (nodes if after is None else nodes.where(F.col("id") > after)).orderBy("id").limit(limit)


def host_configs(artifacts: DataFrame, kind: str) -> DataFrame:
    """Configuration artifacts of a kind that come from no overlay."""
    attr = lambda name: F.get_json_object("attrs", f"$.{name}")
    return artifacts.where((attr("configKind") == kind) & attr("overlayContext").isNull())


def evidence_events(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """The newest evidence events over all sources: each source gives its newest, at most
    ``EVIDENCE_EACH``, and these are merged. Attributes that go by two names are read by either."""
    each = min(limit + offset, EVIDENCE_EACH)
    best = Window.partitionBy("data_source_id").orderBy(F.desc("event_time"), "id")
    newest = events.withColumn("r", F.row_number().over(best)).where(F.col("r") <= each).drop("r")
    attr = lambda name: F.get_json_object("attrs", f"$.{name}")
    shown = newest.select(
        "id", "data_source_id", "event_time", F.coalesce(attr("timezone"), attr("tzAssumed")).alias("timezone"),
        F.coalesce(attr("rawDigest"), attr("contentDigest")).alias("raw_digest"), F.coalesce(attr("completeness"), F.lit("parsed")).alias("completeness"),
    )
    ordered = shown.orderBy(F.desc("event_time"), "id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def report_timeline(events: DataFrame, most: int = REPORT_ROWS) -> DataFrame:
    """The whole timeline of a report; more rows than it may hold are an error, never a cut."""
    if events.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} timeline rows")
    return events.orderBy("ts", "id")


def case_search(hits: DataFrame, sources: DataFrame, limit: int = 50, offset: int = 0, after: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of hits (data_source_id, score, id) over the sources of a case, best first, and the
    coverage: for each source its status and the number of hits. Sources that are not ready give
    none. ``after`` is the score and id of the last hit seen."""
    ready = sources.where("status = 'ready'").select("data_source_id")
    found = hits.join(ready, "data_source_id", "left_semi")
    page = found if after is None else found.where((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("id") > after[1])))
    ordered = page.orderBy(F.desc("score"), "id")
    totals = found.groupBy("data_source_id").agg(F.count("*").alias("hits"))
    coverage = sources.join(totals, "data_source_id", "left").na.fill(0, ["hits"])
    return (ordered.offset(offset) if offset else ordered).limit(limit), coverage


def read_case_search(hits: DataFrame, sources: DataFrame, query: str, request: PageRequest, revision: str) -> Page:
    """The pages of ``case_search`` by an opaque cursor that only goes on with the same query, the
    same ready sources and the same revision."""
    ready = sources.where("status = 'ready'").select("data_source_id").distinct()
    state = ready.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("data_source_id")).alias("x")).head()
    found = hits.join(ready, "data_source_id", "left_semi")
    return read_page(found, [("score", True), ("id", False)], request, revision, context_of("case search", query=query, sources=[state["n"], state["x"]]))


def ledger_batches(events: DataFrame, size: int) -> DataFrame:
    """Sealed batches of ``size`` neighbouring ledger events (scope_key, sequence, data): ``batch_key,
    first, last, n, root``. Only full batches are sealed; the open one has no row."""
    rows = numbered(events, "scope_key", "sequence").withColumn("batch_key", F.expr(f"concat(scope_key, '/', at div {size})"))
    full = rows.groupBy("batch_key").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("n")).where(F.col("n") == size)
    leaves = rows.join(full.select("batch_key"), "batch_key", "left_semi").select(F.col("batch_key").alias("scope_key"), (F.col("at") % size).alias("at"), "data")
    return full.join(merkle_roots(leaves).withColumnRenamed("scope_key", "batch_key"), "batch_key")


def broken_batches(sealed: DataFrame, events: DataFrame, size: int) -> DataFrame:
    """Sealed batches whose events no longer give their root."""
    again = ledger_batches(events, size).select("batch_key", F.col("root").alias("root_now"))
    changed = F.col("root_now").isNull() | (F.col("root") != F.col("root_now"))
    return sealed.join(again, "batch_key", "left").where(changed).select("batch_key")


def family_summary(artifacts: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Counts, first and last time of each group of families, also of those without artifacts."""
    listed = [F.struct(F.lit(g).alias("summary"), F.lit(f).alias("family")) for g, families in groups.items() for f in families]
    names = artifacts.sparkSession.range(1).select(F.inline(F.array(*listed)))
    counted = artifacts.groupBy("family").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    return names.join(F.broadcast(counted), "family", "left").groupBy("summary").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )


def summary_pages(artifacts: DataFrame, each: int) -> DataFrame:
    """The first rows of each family, newest first, with the family's total. Ranks are taken in
    parts of a family before the whole."""
    rows = artifacts.select("family", "id", "created_at")
    for part in ([F.pmod(F.xxhash64("id"), F.lit(64))], []):
        best = Window.partitionBy("family", *part).orderBy(F.desc("created_at"), "id")
        rows = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= each)
    totals = artifacts.groupBy("family").agg(F.count("*").alias("total"))
    return rows.join(F.broadcast(totals), "family")


#: Which kinds of event-log records each view shows.
EVENT_VIEWS = {
    "boot": ["bootShutdown"], "logon": ["logonLogoff", "privilegeEscalation"], "process": ["processExecution"],
    "account": ["accountManagement", "scheduledTask"], "application": ["application"],
}


def event_page_total(counts: Column, view: str | None) -> Column:
    """Of a map from kind to count, the total that a view pages over; all without a view."""
    kinds = F.map_values(counts) if view is None else F.array(*(F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0)) for k in EVENT_VIEWS[view]))
    return F.aggregate(kinds, F.lit(0).cast("bigint"), lambda a, x: a + x)


def event_totals(records: DataFrame) -> DataFrame:
    """One row: the total of each view over records with a ``kind``."""
    kinds = sorted({k for v in EVENT_VIEWS.values() for k in v})
    counts = records.agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds))
    found = counts.select(F.create_map(*(x for k in kinds for x in (F.lit(k), F.col(k)))).alias("counts"))
    return found.select(*(event_page_total(F.col("counts"), v).alias(v) for v in EVENT_VIEWS), event_page_total(F.col("counts"), None).alias("all_views"))


def ordered_text(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Values of each key joined in order, with checks: ``first, last, n, gaps`` (missing numbers)."""
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    span = F.max(order) - F.min(order) + 1 - F.countDistinct(order)
    return rows.groupBy(key).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), span.alias("gaps"), F.array_join(parts[value], "").alias("joined")
    )
