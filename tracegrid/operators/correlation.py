"""Leads: candidates from artifacts, their best files, and how well families are covered."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import name_candidates, path_candidates, posix_candidates
from ..functions.text import first_attr
from ..plans.tables import Tables
from .joins import best_name_match, best_path_match
from .ranks import running_sums

LEAD_CONFIDENCE = {"direct": 1.0, "strong": 0.9, "weak": 0.5, "heuristic": 0.3}


#: Rules by artifact type: how candidates are read, from which attributes, what kind
#: of link a hit is, its confidence, and whether deleted files are preferred.
RULES = [
    ("LNK", "path", ("target_path", "targetPath"), "path_match", "direct", False),
    ("BrowserDownload", "path", ("targetPath",), "path_match", "direct", False),
    ("RecycleBin", "path", ("original_path", "originalPath"), "recovered_original_path", "direct", True),
    ("JumpList", "path", ("target_path", "targetPath"), "path_match", "direct", False),
    ("LinuxJournal", "path", ("executable",), "path_match", "direct", False),
    ("LinuxSystemConfig", "path", ("shell",), "path_match", "strong", False),
    ("LinuxSudoEvent", "command", ("command",), "path_match", "strong", False),
    ("LinuxCronJob", "command", ("command",), "path_match", "strong", False),
    ("LinuxBashCommand", "command", ("command",), "path_match", "strong", False),
    ("LinuxWebSite", "paths", ("accessLogs", "errorLogs"), "path_match", "strong", False),
    ("LinuxWebErrorLog", "posix text", ("message",), "path_match", "weak", False),
    ("RegistryValue", "path text", ("data",), "path_match", "strong", False),
    ("RegistryValue", "name text", ("data",), "name_match", "weak", False),
    ("BrowserHistory", "name text", ("title",), "name_match", "weak", False),
    ("BrowserHistory", "name text", ("url",), "name_match", "weak", False),
    ("Prefetch", "name", ("executable",), "name_match", "strong", False),
    ("LinuxSudoEvent", "command name", ("command",), "name_match", "weak", False),
    ("LinuxCronJob", "command name", ("command",), "name_match", "weak", False),
    ("LinuxBashCommand", "command name", ("command",), "name_match", "weak", False),
    ("EmailMessage", "names", ("attachments",), "name_match", "weak", False),
    ("EmailMessage", "name text", ("subject",), "name_match", "weak", False),
]
#: Paths taken from a free text at most, as rules for messages and registry values ask.
TEXT_PATHS = 2


def _read_candidates(how: str, fields: tuple[str, ...]) -> Column:
    value = first_attr(F.col("attrs"), *fields)
    listed = F.flatten(F.array(*(F.coalesce(F.from_json(F.get_json_object("attrs", f"$.{f}"), "array<string>"), F.array().cast("array<string>")) for f in fields)))
    first = F.split(F.trim(value), r"\s+")[0]
    one = lambda x: F.when(x.isNotNull() & (x != ""), F.array(x))
    return {
        "path": lambda: one(value), "paths": lambda: listed, "names": lambda: listed, "name": lambda: one(value),
        "command": lambda: F.when(first.startswith("/"), F.array(first)), "command name": lambda: F.when(~first.startswith("/"), one(first)),
        "path text": lambda: F.slice(path_candidates(value), 1, TEXT_PATHS), "posix text": lambda: F.slice(posix_candidates(value), 1, TEXT_PATHS),
        "name text": lambda: name_candidates(value),
    }[how]()


def _pointed(*told: Column):
    return lambda candidate: F.struct(candidate.alias("candidate"), *told)


def rule_candidates(artifacts: DataFrame) -> DataFrame:
    """What each artifact (id, artifact_type, attrs) points to by the rules of its type:
    ``artifact_id, artifact_type, candidate, kind, confidence, wants_deleted``."""
    none = F.array().cast("array<struct<candidate:string,kind:string,confidence:string,wants_deleted:boolean>>")
    found = none
    for artifact_type, how, fields, kind, confidence, deleted in RULES:
        told = F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(deleted).alias("wants_deleted")
        rows = F.transform(_read_candidates(how, fields), _pointed(*told))
        found = F.concat(found, F.when(F.col("artifact_type") == artifact_type, F.coalesce(rows, none)).otherwise(none))
    return artifacts.select(F.col("id").alias("artifact_id"), "artifact_type", F.inline(found))


def rule_matches(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """The best file of each candidate: ``artifact_id, file_id, kind, confidence``, one row for an
    artifact, file and kind. Registry values look for names only where no path hits."""
    tables = Tables(artifacts.sparkSession, "rules")
    found = tables.put(rule_candidates(artifacts)).withColumn("candidate_id", F.concat_ws("|", "artifact_id", "kind", "candidate"))
    by_path = found.where("kind <> 'name_match'")
    hits = tables.put(best_path_match(by_path, files).select("candidate_id", "file_id").join(by_path, "candidate_id"))
    with_path = hits.where("artifact_type = 'RegistryValue'").select("artifact_id").distinct()
    by_name = found.where("kind = 'name_match'").join(with_path, "artifact_id", "left_anti")
    names = best_name_match(by_name, files).select("candidate_id", "file_id").join(by_name, "candidate_id")
    rank = confidence_rank(F.col("confidence"))
    both = hits.unionByName(names).groupBy("artifact_id", "file_id", "kind").agg(F.max(F.struct(rank.alias("rank"), "confidence")).alias("c"))
    return both.select("artifact_id", "file_id", "kind", "c.confidence")


def confidence_rank(confidence: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in LEAD_CONFIDENCE.items() for x in pair)), confidence)


def rule_groups(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Matches by file, with the events of the file: ``file_id, matches, artifacts, events,
    confidence``. A path makes it direct; events, a second match or a strong one make it strong."""
    grouped = matches.groupBy("file_id").agg(
        F.count("*").alias("matches"), F.countDistinct("artifact_id").alias("artifacts"),
        F.max(F.col("kind").isin("path_match", "recovered_original_path")).alias("path"), F.max(F.col("confidence") == "strong").alias("strong"),
    )
    of_file = events.groupBy(F.col("source_object_id").alias("file_id")).agg(F.count("*").alias("events"))
    joined = grouped.join(of_file, "file_id", "left").na.fill(0, ["events"])
    strong = (F.col("events") > 0) | (F.col("matches") >= 2) | F.col("strong")
    return joined.withColumn("confidence", F.when(F.col("path"), "direct").when(strong, "strong").otherwise("weak")).drop("path", "strong")


def _row(df: DataFrame, part: str, key: Column, a: Column, b: Column, title: Column, confidence: Column, support: Column) -> DataFrame:
    return df.select(
        F.lit(part).alias("part"), key.alias("id"), a.cast("string").alias("a"), b.cast("string").alias("b"), title.alias("title"),
        confidence.alias("confidence"), support.cast("long").alias("support"),
    )


def match_rows(matches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The edges of matches and the nodes of their artifacts."""
    none = F.lit(None).cast("string")
    linked = matches.select("artifact_id").distinct().join(artifacts.select(F.col("id").alias("artifact_id"), "artifact_type"), "artifact_id")
    node = _row(linked, "node", F.concat(F.lit("artifact:"), "artifact_id"), F.col("artifact_id"), none, F.col("artifact_type"), none, F.lit(1))
    edge_id = F.concat_ws(":", F.lit("edge"), "artifact_id", "file_id", "kind")
    return node.unionAll(_row(matches, "edge", edge_id, F.col("artifact_id"), F.col("file_id"), F.col("kind"), F.col("confidence"), F.lit(1)))


def file_rows(groups: DataFrame, files: DataFrame) -> DataFrame:
    """The nodes of files with matches, clusters of those with several artifacts, and leads."""
    none = F.lit(None).cast("string")
    led = groups.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    key = lambda kind: F.concat(F.lit(f"{kind}:"), "file_id")
    node = _row(led, "node", key("file"), F.col("file_id"), none, F.col("path"), none, F.col("artifacts"))
    cluster = _row(led.where("artifacts > 1"), "cluster", key("cluster"), F.col("file_id"), none, F.col("path"), F.col("confidence"), F.col("artifacts"))
    return node.unionAll(cluster).unionAll(_row(led, "lead", key("lead"), F.col("file_id"), none, F.col("path"), F.col("confidence"), F.col("artifacts") + F.col("events")))


def correlation_snapshot(artifacts: DataFrame, files: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes, edges, clusters and leads of a source as rows ``part, id, a, b, title, confidence,
    support``: nodes are the artifacts and files that rules link, edges the links, clusters the
    files with several artifacts, leads all files with their support."""
    tables = Tables(artifacts.sparkSession, "snapshot")
    matches = tables.put(rule_matches(artifacts, files))
    return match_rows(matches, artifacts).unionAll(file_rows(tables.put(rule_groups(matches, events)), files))


def in_order(snapshot: DataFrame, key: str | None = None) -> DataFrame:
    """A snapshot with ``position`` (from 0) of each row in its part: nodes by kind, title and id,
    edges by confidence, clusters and leads by confidence, support and title; ids decide last. With
    ``key``, parts are ordered within each of its values.

    Positions are counted over range partitions, so no part is sorted in one task.
    """
    surest = F.coalesce(-confidence_rank(F.col("confidence")), F.lit(0.0))
    listed = F.col("part").isin("cluster", "lead")
    kind = F.when(F.col("part") == "node", F.substring_index("id", ":", 1)).otherwise("")
    most = F.when(listed, -F.col("support")).otherwise(0)
    title = F.when(F.col("part") == "edge", "").otherwise(F.coalesce("title", F.lit("")))
    rows = snapshot.select("*", kind.alias("_kind"), F.when(F.col("part") == "node", 0.0).otherwise(surest).alias("_sure"), most.alias("_most"), title.alias("_title"), F.lit(1).alias("_one"))
    order = ["_kind", "_sure", "_most", "_title", "id"]
    placed = running_sums(rows, ([key] if key else []) + ["part"], order, "_one", Tables(snapshot.sparkSession, "order"))
    return placed.select(*snapshot.columns, F.col("before").alias("position"))


def merged_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots of several sources (with data_source_id) as one, with ``position``: ids and what
    edges and clusters refer to get their source, so nothing of different sources meets. Nodes,
    edges and clusters go by id, leads by confidence, support and title."""
    of_source = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("/", "data_source_id", c))
    rows = snapshots.withColumns({c: of_source(c) for c in ("id", "a", "b")})
    lead = F.col("part") == "lead"
    keys = {"_sure": F.when(lead, F.coalesce(-confidence_rank(F.col("confidence")), F.lit(0.0))).otherwise(0.0), "_most": F.when(lead, -F.col("support")).otherwise(0), "_title": F.when(lead, F.coalesce("title", F.lit(""))).otherwise("")}
    placed = running_sums(rows.withColumns(keys).withColumn("_one", F.lit(1)), ["part"], ["_sure", "_most", "_title", "id"], "_one", Tables(snapshots.sparkSession, "merged"))
    return placed.select(*snapshots.columns, F.col("before").alias("position"))


def snapshot_totals(snapshot: DataFrame) -> DataFrame:
    """One row: ``node_count, edge_count, cluster_count, lead_count``, of one source or merged."""
    return snapshot.agg(*(F.count(F.when(F.col("part") == p, 1)).alias(f"{p}_count") for p in ("node", "edge", "cluster", "lead")))


def newest_inputs(rows: DataFrame, most: int | None, time: str) -> DataFrame:
    """What correlation of an interactive case looks at: the newest ``most`` rows of each source by
    a time (nulls last), then id; all of them with None. Ranks are taken in parts of a source
    before the whole."""
    if most is None:
        return rows
    for part in ([F.pmod(F.xxhash64("id"), F.lit(64))], []):
        best = Window.partitionBy("data_source_id", *part).orderBy(F.desc(time), "id")
        rows = rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most).drop("_r")
    return rows


def candidates(artifacts: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """``artifact_id, candidate, candidate_id``: paths in a text column; ``most`` keeps the first
    of the sorted ones, as message rules ask."""
    found = path_candidates(F.col(text))
    found = F.slice(found, 1, most) if most else found
    rows = artifacts.select(F.col("id").alias("artifact_id"), F.explode(found).alias("candidate"))
    return rows.withColumn("candidate_id", F.concat_ws("|", "artifact_id", "candidate")).withColumn("wants_deleted", F.lit(False))


def name_only(artifacts: DataFrame, text: str) -> DataFrame:
    rows = artifacts.select(F.col("id").alias("artifact_id"), F.explode(name_candidates(F.col(text))).alias("candidate"))
    return rows.withColumn("candidate_id", F.concat_ws("|", "artifact_id", "candidate")).withColumn("wants_deleted", F.lit(False))


def path_leads(artifacts: DataFrame, files: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """The best file of each path in a text: strong leads, one for each artifact and file."""
    found = candidates(artifacts, text, most)
    hits = best_path_match(found, files).join(found.select("candidate_id", "artifact_id"), "candidate_id")
    return hits.groupBy("artifact_id", "file_id").agg(F.min("how").alias("how")).withColumn("confidence", F.lit("strong"))


def path_or_name_leads(artifacts: DataFrame, files: DataFrame, text: str) -> DataFrame:
    """As ``path_leads``; artifacts without a path hit fall back to names, as weak leads."""
    strong = path_leads(artifacts, files, text)
    rest = artifacts.join(strong.select(F.col("artifact_id").alias("id")).distinct(), "id", "left_anti")
    names = name_only(rest, text)
    weak = best_name_match(names, files).join(names.select("candidate_id", "artifact_id"), "candidate_id")
    return strong.unionByName(weak.select("artifact_id", "file_id", F.lit("name").alias("how"), F.lit("weak").alias("confidence")).distinct())


def lead_edges(leads: DataFrame) -> DataFrame:
    """Leads as graph edges; of repeated ids one stays."""
    value = F.lit(None).cast("double")
    for word, number in LEAD_CONFIDENCE.items():
        value = F.when(F.col("confidence") == word, number).otherwise(value)
    edges = leads.select(F.concat_ws(":", F.lit("lead"), "artifact_id", "file_id").alias("id"), F.col("artifact_id").alias("source_id"), F.col("file_id").alias("target_id"), value.alias("confidence"))
    return edges.groupBy("id", "source_id", "target_id").agg(F.max("confidence").alias("confidence"))


def family_coverage(leads: DataFrame, families: DataFrame) -> DataFrame:
    """For every family of the list, also those without leads: leads, those of high confidence,
    those to review (with caveats, weak or heuristic), and missing, covered or review."""
    high = F.col("confidence").isin("direct", "strong")
    counted = leads.groupBy("family").agg(
        F.count("*").alias("leads"), F.count(F.when(high, 1)).alias("high"), F.count(F.when(~high | F.col("caveat"), 1)).alias("review")
    )
    out = families.join(counted, "family", "left").na.fill(0, ["leads", "high", "review"])
    return out.withColumn("status", F.when(F.col("leads") == 0, "missing").when(F.col("review") > 0, "review").otherwise("covered"))


def coverage_gate(coverage: DataFrame) -> DataFrame:
    """Blocked without any lead, warning below half of the families or without high confidence."""
    sums = coverage.agg(F.count("*").alias("families"), F.count(F.when(F.col("leads") > 0, 1)).alias("with_leads"), F.sum("high").alias("high"))
    gate = F.when(F.col("with_leads") == 0, "blocked").when((2 * F.col("with_leads") < F.col("families")) | (F.col("high") == 0), "warning").otherwise("passed")
    return sums.withColumn("gate", gate)


def new_ids(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows of the current state that the cached one doesn't have."""
    return current.join(cached.select("id"), "id", "left_anti")


def append_only(current: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: whether everything cached is still there, so that only new rows need work."""
    gone = cached.join(current.select("id"), "id", "left_anti")
    return gone.agg((F.count("*") == 0).alias("append_only"))
