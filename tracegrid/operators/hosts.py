"""Hosts: event-log kinds, web server sites, login records, network facts, topology."""

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Event-log kinds by id, with the provider or channel that they need.
EVENT_KINDS = [
    (12, "provider", "microsoft-windows-kernel-general", "boot", "OperatingSystemStarted"),
    (13, "provider", "microsoft-windows-kernel-general", "boot", "OperatingSystemShutdown"),
    (6005, None, None, "boot", "EventLogStarted"),
    (6006, None, None, "boot", "EventLogStopped"),
    (6008, None, None, "boot", "UnexpectedShutdown"),
    (1074, None, None, "boot", "PlannedShutdown"),
    (4104, "provider", "microsoft-windows-powershell", "boot", "PowerShellScriptBlock"),
    (1, "provider", "microsoft-windows-sysmon", "boot", "SysmonProcessCreate"),
    (21, "provider", "microsoft-windows-terminalservices-localsessionmanager", "boot", "RdpSessionConnect"),
    (1116, "provider", "microsoft-windows-windows defender", "boot", "DefenderThreatDetected"),
    (4624, "channel", "security", "security", "LogonSuccess"),
    (4625, "channel", "security", "security", "LogonFailure"),
    (4648, "channel", "security", "security", "ExplicitCredentials"),
    (4688, "channel", "security", "security", "ProcessCreated"),
    (4698, "channel", "security", "security", "ScheduledTaskCreated"),
    (4702, "channel", "security", "security", "ScheduledTaskModified"),
    (4720, "channel", "security", "security", "AccountCreated"),
    (4732, "channel", "security", "security", "GroupMemberAdded"),
    (1000, "channel", "application", "application", "ApplicationCrash"),
    (1001, "channel", "application", "application", "WindowsErrorReporting"),
    (1002, "channel", "application", "application", "ApplicationHang"),
    (1033, "channel", "application", "application", "SoftwareInstallation"),
    (11707, "channel", "application", "application", "SoftwareInstallation"),
    (11708, "channel", "application", "application", "SoftwareInstallation"),
]
#: The layouts of login records (record size: time format and its place).
LOGIN_LAYOUTS = {384: ("<i", 340), 400: ("<q", 344)}
#: Record layouts of files with a slot for each user id, the likelier first: size, form of the fields.
LAST_LOGIN_LAYOUTS = [(292, "<i32s256s"), (296, "<q32s256s")]
FAILURE_LAYOUTS = [(32, "<hh12sqq"), (24, "<hh12sii")]
#: The last second that a record may name, the year 2100.
LATEST_SECOND = 4_102_444_800
LOGIN_KINDS = {2: "boot", 7: "login", 8: "logout"}
#: Relations of the infrastructure graph and the kinds that they may join.
TOPOLOGY = [
    ("hosts", "pve", "virtualMachine"), ("hosts", "physicalHost", "osInstance"), ("hosts", "kubernetesNode", "pod"),
    ("providesStorage", "cephCluster", "pve"), ("providesStorage", "cephCluster", "virtualMachine"), ("providesStorage", "cephCluster", "kubernetes"),
    ("boots", "virtualMachine", "osInstance"), ("boots", "virtualDisk", "osInstance"), ("runs", "osInstance", "kubernetes"), ("manages", "pve", "physicalHost"),
    ("consumesStorage", "kubernetes", "cephRbd"), ("consumesStorage", "kubernetes", "cephFs"),
    ("contains", "cephCluster", "cephOsd"), ("contains", "cephCluster", "cephRbd"), ("contains", "cephCluster", "cephFs"),
    ("contains", "namespace", "pod"), ("contains", "pod", "container"), ("contains", "fileSystem", "fileEntry"),
    ("materializesAs", "cephRbd", "virtualDisk"), ("mountedFrom", "fileSystem", "logicalVolume"), ("mountedFrom", "fileSystem", "virtualDisk"),
]


#: The groups of kinds that relations with open ends name.
KIND_GROUPS = {
    "environment": "pve physicalHost virtualMachine osInstance kubernetes kubernetesNode namespace pod container".split(),
    "storage": "cephCluster cephOsd cephRbd cephFs virtualDisk logicalVolume fileSystem".split(),
    "analysis": "fileEntry artifact timelineEvent finding report".split(),
    "evidence": ["evidenceSource"],
}
#: Relations between any kinds of two groups.
OPEN_TOPOLOGY = [("derivedFrom", "analysis", "evidence"), ("derivedFrom", "analysis", "storage"), ("derivedFrom", "storage", "evidence"), ("produces", "environment", "analysis")]
TOPOLOGY += [("supportedBy", a, b) for a in ("finding", "report") for b in ("artifact", "timelineEvent")]


def event_kind(event_id: Column, provider: Column, channel: Column) -> Column:
    """A struct ``event_class, kind``; null for events of no interest."""
    found = F.lit(None).cast("struct<event_class:string,kind:string>")
    for number, field, value, event_class, kind in EVENT_KINDS:
        fits = event_id == number
        if field:
            fits &= F.lower(F.coalesce(provider if field == "provider" else channel, F.lit(""))) == value
        found = F.when(fits, F.struct(F.lit(event_class).alias("event_class"), F.lit(kind).alias("kind"))).otherwise(found)
    return found


def classified_events(records: DataFrame) -> DataFrame:
    """Event-log records (event_id, provider, channel) that are of interest, with their kind."""
    found = event_kind(F.col("event_id"), F.col("provider"), F.col("channel"))
    return records.withColumn("found", found).where("found IS NOT NULL").select("*", "found.event_class", "found.kind").drop("found")


def nginx_sites(lines: DataFrame) -> DataFrame:
    """Server blocks of ``file_id, line_number, line``: first line, names, ports, root.

    A running sum of braces gives the depth; a block lasts while the depth is above that at its
    start. Comments are cut off.
    """
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    order = Window.partitionBy("file_id").orderBy("line_number")
    delta = F.length(F.regexp_replace("t", r"[^{]", "")) - F.length(F.regexp_replace("t", r"[^}]", ""))
    rows = lines.withColumn("t", text).where("t <> ''").withColumn("depth", F.sum(delta).over(order) - delta)
    starts = F.col("t").rlike(r"^server\b[^;]*\{")
    rows = rows.withColumn("site", F.last(F.when(starts, F.col("line_number")), ignorenulls=True).over(order))
    rows = rows.withColumn("floor", F.last(F.when(starts, F.col("depth")), ignorenulls=True).over(order))
    inside = rows.where("site IS NOT NULL AND (line_number = site OR depth > floor)")
    value = lambda name: F.collect_list(F.when(F.col("t").rlike(rf"^{name}\s"), F.regexp_extract("t", rf"^{name}\s+([^;]*)", 1)))
    found = inside.groupBy("file_id", "site").agg(value("server_name").alias("n"), value("listen").alias("l"), value("root").alias("r"))
    return found.select("file_id", "site", F.array_join("n", " ").alias("server_names"), F.array_join("l", " ").alias("listen"), F.get("r", F.lit(0)).alias("root"))


def login_records(files: DataFrame) -> DataFrame:
    """Login records of ``id, content`` rows of wtmp files. The record size is the one that divides
    the file; files that fit none give no rows."""

    def text(data: bytes) -> str:
        return data.split(b"\0", 1)[0].decode("utf-8", "replace")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, data in zip(batch["id"], batch["content"], strict=True):
                data = bytes(data)
                size = next((s for s in LOGIN_LAYOUTS if data and len(data) % s == 0), None)
                for at in range(0, len(data) if size else 0, size or 1):
                    kind, pid = struct.unpack_from("<ii", data, at)
                    if kind in LOGIN_KINDS:
                        form, place = LOGIN_LAYOUTS[size]
                        when = struct.unpack_from(form, data, at + place)[0]
                        fields = (text(data[at + a : at + b]) for a, b in ((8, 40), (44, 76), (76, 332)))
                        rows.append((file_id, at // size, LOGIN_KINDS[kind], pid, *fields, when))
            yield pd.DataFrame(rows, columns=["file_id", "n", "kind", "pid", "terminal", "user", "host", "second"])

    schema = "file_id string, n long, kind string, pid long, terminal string, user string, host string, second long"
    return files.select(F.col("id").cast("string").alias("id"), "content").mapInPandas(parse, schema)


def _slots(files: DataFrame, layouts: list[tuple[int, str]], read: Callable, schema: str) -> DataFrame:
    """Rows of files that are arrays of slots by user id. ``read`` gives a slot's row, and whether it
    is plausible. The layout is the one that divides the file with most plausible slots among the
    first eight, else the first that fits half of them; empty slots and files that fit none give no rows."""
    names = [f.split()[0] for f in schema.split(", ")]

    def slots(data: bytes, size: int, form: str) -> Iterator[tuple]:
        for at in range(0, len(data) - size + 1, size):
            if any(data[at : at + size]):
                yield at // size, *read(struct.unpack_from(form, data, at))

    def layout_of(data: bytes) -> tuple[int, str] | None:
        scores = []
        for size, form in layouts:
            seen = list(slots(data[: 8 * size], size, form))
            good = sum(x[-1] for x in seen)
            if good and 2 * good >= len(seen):
                scores.append((len(data) % size == 0, good if len(data) % size == 0 else 0, (size, form)))
        return max(scores, key=lambda s: s[:2])[2] if scores else None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, content in zip(batch["id"], batch["content"], strict=True):
                data = bytes(content or b"")
                layout = layout_of(data)
                found = slots(data, *layout) if layout else iter(())
                while rows := [(file_id, *x[:-1]) for x in islice(found, 10_000)]:
                    yield pd.DataFrame(rows, columns=names).convert_dtypes()

    return files.select(F.col("id").cast("string").alias("id"), "content").mapInPandas(parse, schema)


def _slot_text(data: bytes) -> str:
    return data.split(b"\0", 1)[0].decode("utf-8", "replace")


def _slot_second(value: int) -> tuple[int | None, bool]:
    """A slot's time, if it names one, and whether it is a sound value."""
    known = 0 < value <= LATEST_SECOND
    return (value if known else None), known or value == 0


def last_logins(files: DataFrame) -> DataFrame:
    """``file_id, uid, terminal, host, second`` of ``id, content`` rows of lastlog files."""

    def read(fields: tuple) -> tuple:
        line, (second, sound) = _slot_text(fields[1]), _slot_second(fields[0])
        return line, _slot_text(fields[2]), second, sound and all(" " <= c <= "~" for c in line)

    return _slots(files, LAST_LOGIN_LAYOUTS, read, "file_id string, uid long, terminal string, host string, second long")


def login_failures(files: DataFrame) -> DataFrame:
    """Failure counters of ``id, content`` rows of faillog files; ``locked`` tells that the allowed number is reached."""

    def read(fields: tuple) -> tuple:
        failures, most, line, second, seconds = fields
        line, (second, sound) = _slot_text(line), _slot_second(second)
        good = sound and failures >= 0 and most >= 0 and all(" " <= c <= "~" for c in line)
        return failures, most, line, second, seconds, 0 < most <= failures, good

    return _slots(files, FAILURE_LAYOUTS, read, "file_id string, uid long, failures int, most int, terminal string, second long, lock_seconds long, locked boolean")


def network_facts(lines: DataFrame) -> DataFrame:
    """Addresses, gateways and names in configuration lines (path, line_number, line)."""
    line = F.trim("line")
    rules = [
        ("address", r"^(?:address|IPADDR)\s*[= ]\s*\"?([0-9A-Fa-f:.]+(?:/\d+)?)"),
        ("gateway", r"^(?:gateway|GATEWAY)\s*[= ]\s*\"?([0-9A-Fa-f:.]+)"),
        ("nameserver", r"^(?:nameserver|DNS\d*)\s*[= ]\s*\"?([0-9A-Fa-f:.]+)"),
        ("interface", r"^(?:iface|auto|DEVICE)\s*[= ]\s*\"?([\w.:-]+)"),
    ]
    facts = [F.when(line.rlike(p), F.struct(F.lit(k).alias("fact"), F.regexp_extract(line, p, 1).alias("value"))) for k, p in rules]
    host = r"^([0-9A-Fa-f:.]+)\s+([\w.-]+(?:\s+[\w.-]+)*)$"
    names = F.when(F.col("path").endswith("/hosts") & line.rlike(host), F.struct(F.lit("host").alias("fact"), F.concat_ws(" ", F.regexp_extract(line, host, 1), F.regexp_extract(line, host, 2)).alias("value")))
    return lines.select("path", "line_number", F.inline(F.array_compact(F.array(*facts, names))))


def allowed_relations(edges: DataFrame) -> DataFrame:
    """Edges (relation, source_kind, target_kind) that the topology allows."""
    wanted = F.concat_ws("|", "relation", "source_kind", "target_kind")
    allowed = wanted.isin(*("|".join(t) for t in TOPOLOGY))
    for relation, source, target in OPEN_TOPOLOGY:
        allowed |= (F.col("relation") == relation) & F.col("source_kind").isin(*KIND_GROUPS[source]) & F.col("target_kind").isin(*KIND_GROUPS[target])
    return edges.where(allowed)


def notebook_filter(entries: DataFrame, entry_type: str | None = None, status: str | None = None, text: str | None = None, tag: str | None = None) -> DataFrame:
    """Notebook entries by type, status, text in title or body (without case), and tag."""
    for column, value in (("entry_type", entry_type), ("status", status)):
        if value is not None:
            entries = entries.where(F.col(column) == value)
    if text is not None:
        entries = entries.where(F.lower("title").contains(text.lower()) | F.lower("body").contains(text.lower()))
    return entries if tag is None else entries.where(F.array_contains("tags", tag))


def unreferenced(objects: DataFrame, references: DataFrame) -> DataFrame:
    """Ready objects that nothing refers to."""
    return objects.where("status = 'ready'").join(references.select(F.col("object_id").alias("id")), "id", "left_anti")


def carved_search(artifacts: DataFrame, query: str, after_id=None, limit: int = 100) -> DataFrame:
    """Carved artifacts whose title or attributes contain the query, in order of id, with one row
    more than the limit to tell that there are more."""
    if len(query.encode()) > 128:
        raise ValueError("the query has more than 128 bytes")
    hits = artifacts.where(F.col("family").startswith("carving.") & F.lower(F.concat_ws("\n", "title", "attrs")).contains(query.lower()))
    hits = hits if after_id is None else hits.where(F.col("id") > after_id)
    return hits.orderBy("id").limit(limit + 1)
