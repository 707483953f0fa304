"""Log, session, time and integrity queries."""

from pyspark.sql import functions as F

from ..functions import times
from ..functions.digests import sha256_text
from ..operators import hosts, integrity as it, joins, logs as lg
from ..operators.timeline import epoch_second
from ..sources.adapters import read, timeline_events
from .registry import query

_URIS = "CASE event_id % 5 WHEN 0 THEN '/Login' WHEN 1 THEN '/item?id=1%20union%20select' WHEN 2 THEN '/a/../etc/passwd' WHEN 3 THEN '/p?q=<script>' ELSE '/index.html' END"


def _requests(spark, d):
    """Access-log lines made from events, and the requests read back from them."""
    events = read(spark, d, "events")
    line = F.expr(
        f"concat('10.0.0.', user_id % 3, ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"', CASE WHEN event_id % 2 = 0 THEN 'POST' ELSE 'GET' END, ' ',"
        f" {_URIS}, ' HTTP/1.1\" ', 200 + event_id % 5, ' ', event_id, ' \"-\" \"', CASE WHEN event_id % 11 = 0 THEN 'sqlmap/1.0' ELSE 'agent' END, '\"')"
    )
    return lg.parse_access(events.select(F.col("event_id").alias("line_number"), line.alias("line")))


_LOG = f""", q AS (SELECT event_id AS line_number, concat('10.0.0.', user_id % 3) AS client_ip, CASE WHEN event_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method,
  {_URIS} AS uri, CAST(200 + event_id % 5 AS INTEGER) AS status, event_id AS response_bytes, CASE WHEN event_id % 11 = 0 THEN 'sqlmap/1.0' ELSE 'agent' END AS user_agent,
  CAST(floor(epoch(ts)) AS BIGINT) AS second FROM events)"""


@query(_LOG + " SELECT * FROM q")
def log_web_access(spark, d):
    r = _requests(spark, d)
    return r.select("line_number", "client_ip", "method", "uri", "status", "response_bytes", "user_agent", F.unix_seconds(F.expr("CAST(ts AS TIMESTAMP)")).alias("second"))


@query(
    _LOG
    + """ SELECT line_number, client_ip, uri, 'sqlInjection' AS finding_kind, 'high' AS severity, 0.9::DOUBLE AS confidence FROM q WHERE line_number % 5 = 1
    UNION ALL SELECT line_number, client_ip, uri, 'localFileInclusion', 'high', 0.9 FROM q WHERE line_number % 5 = 2
    UNION ALL SELECT line_number, client_ip, uri, 'crossSiteScripting', 'medium', 0.75 FROM q WHERE line_number % 5 = 3
    UNION ALL SELECT line_number, client_ip, uri, 'scannerFingerprint', 'medium', 0.8 FROM q WHERE line_number % 11 = 0"""
)
def log_web_findings(spark, d):
    return lg.web_findings(_requests(spark, d))


@query(
    _LOG
    + """ SELECT client_ip, bucket, count(*) AS requests FROM (SELECT client_ip, method, uri, second // 300 AS bucket, unnest(range(1 + (line_number // 10) % 90)) AS again FROM q)
    WHERE method = 'POST' AND lower(uri) LIKE '%login%' GROUP BY 1, 2 HAVING count(*) >= 50"""
)
def log_brute_force(spark, d):
    """Every request is tried up to ninety times over, so that some clients reach the threshold."""
    tried = _requests(spark, d).withColumn("again", F.explode(F.expr("sequence(0, (line_number div 10) % 90)")))
    return lg.brute_force(tried, F.unix_seconds(F.expr("CAST(ts AS TIMESTAMP)")))


@query("SELECT doc_id AS line_number, 'accessDenied' AS finding_kind, 'medium' AS severity, 0.84::DOUBLE AS confidence, concat('Access denied for user ', doc_id) AS evidence FROM documents WHERE doc_id % 3 = 0")
def log_mysql_findings(spark, d):
    lines = read(spark, d, "documents").selectExpr("doc_id AS line_number", "CASE WHEN doc_id % 3 = 0 THEN concat('Access denied for user ', doc_id) ELSE 'all is well' END AS line")
    return lg.mysql_log_findings(lines)


@query("SELECT doc_id AS line_number, concat('u', doc_id) AS user, concat('/bin/run ', doc_id) AS command, concat('/home/u', doc_id) AS working_directory, 'root' AS target_user, 'pts/0' AS terminal, doc_id % 4 <> 0 AS success FROM documents")
def log_sudo(spark, d):
    lines = read(spark, d, "documents").selectExpr(
        "doc_id AS line_number",
        "concat('Jan  5 10:00:00 host sudo: u', doc_id, ' : ', CASE WHEN doc_id % 4 = 0 THEN '3 incorrect password attempts ; ' ELSE '' END,"
        " 'TTY=pts/0 ; PWD=/home/u', doc_id, ' ; USER=root ; COMMAND=/bin/run ', doc_id) AS line",
    )
    return lg.parse_sudo(lines)


@query("SELECT doc_id AS line_number, CASE WHEN doc_id % 2 = 0 THEN '@daily' ELSE concat('*/5 ', doc_id % 24, ' * * 1') END AS schedule, 'root' AS user, concat('/bin/job ', doc_id) AS command FROM documents WHERE doc_id % 5 <> 0")
def log_cron(spark, d):
    lines = read(spark, d, "documents").selectExpr(
        "doc_id AS line_number",
        "CASE WHEN doc_id % 5 = 0 THEN '# note' WHEN doc_id % 2 = 0 THEN concat('@daily root /bin/job ', doc_id) ELSE concat('*/5  ', doc_id % 24, ' * * 1 root /bin/job  ', doc_id) END AS line",
    )
    return lg.parse_cron(lines)


@query("SELECT doc_id // 10 AS file_id, doc_id AS line_number, concat('ls ', doc_id) AS command, CASE WHEN doc_id % 10 IN (1, 3) THEN 1700000000 + doc_id - 1 END AS second FROM documents WHERE doc_id % 10 NOT IN (0, 2)")
def log_bash_history(spark, d):
    lines = read(spark, d, "documents").selectExpr(
        "doc_id div 10 AS file_id", "doc_id AS line_number", "CASE WHEN doc_id % 10 IN (0, 2) THEN concat('#', 1700000000 + doc_id) ELSE concat('ls ', doc_id) END AS line"
    )
    return lg.parse_bash_history(lines).select("file_id", "line_number", "command", F.unix_seconds("ts").alias("second"))


@query("SELECT doc_id // 4 AS file_id, doc_id AS line_number, 'install' AS action, concat('pkg', doc_id, CASE WHEN i = 0 THEN 'a' ELSE 'b' END) AS package, concat('1.', doc_id) AS version, concat('2024-01-01  ', doc_id // 4) AS start_date FROM documents, (VALUES (0), (1)) v(i) WHERE doc_id % 4 = 2")
def log_apt_history(spark, d):
    lines = read(spark, d, "documents").selectExpr(
        "doc_id div 4 AS file_id", "doc_id AS line_number",
        "CASE doc_id % 4 WHEN 0 THEN concat('Start-Date: 2024-01-01  ', doc_id div 4) WHEN 2 THEN concat('Install: pkg', doc_id, 'a:amd64 (1.', doc_id, ', automatic), pkg', doc_id, 'b:amd64 (1.', doc_id, ')') ELSE '' END AS line",
    )
    return lg.parse_apt_history(lines).select("file_id", "line_number", "action", "package", "version", "start_date")


@query("SELECT doc_id // 4 AS file_id, doc_id AS line_number, 'mysqld' AS section, CASE doc_id % 4 WHEN 1 THEN 'bind-address' ELSE 'local-infile' END AS key, CASE doc_id % 4 WHEN 1 THEN 'bindAddressAny' ELSE 'localInfileEnabled' END AS finding_kind, 'medium' AS severity, CASE doc_id % 4 WHEN 1 THEN 0.86::DOUBLE ELSE 0.82::DOUBLE END AS confidence FROM documents WHERE doc_id % 4 IN (1, 2)")
def log_mysql_config(spark, d):
    lines = read(spark, d, "documents").selectExpr(
        "doc_id div 4 AS file_id", "doc_id AS line_number", "CASE doc_id % 4 WHEN 0 THEN '[mysqld]' WHEN 1 THEN 'bind_address = 0.0.0.0' WHEN 2 THEN 'local-infile=ON' ELSE 'port=3306' END AS line"
    )
    return lg.mysql_config_findings(lg.parse_mysql_config(lines)).select("file_id", "line_number", "section", "key", "finding_kind", "severity", "confidence")


@query("SELECT doc_id AS line_number, concat('u', doc_id) AS user, doc_id + 900 AS uid, doc_id >= 100 AS is_user FROM documents")
def log_passwd(spark, d):
    lines = read(spark, d, "documents").selectExpr("doc_id AS line_number", "concat('u', doc_id, ':x:', doc_id + 900, ':100:Name:/home/u', doc_id, ':/bin/sh') AS line")
    return lg.parse_passwd(lines).select("line_number", "user", "uid", "is_user")


@query(
    """, r AS (SELECT *, sum(CASE WHEN kind = 'login' THEN 1 ELSE -1 END) OVER w AS balance FROM (SELECT user_id AS pid, event_type AS terminal, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS second,
      CASE WHEN event_id % 2 = 0 THEN 'login' ELSE 'logout' END AS kind FROM events) WINDOW w AS (PARTITION BY pid, terminal ORDER BY second, CASE WHEN kind = 'login' THEN 0 ELSE 1 END, id ROWS UNBOUNDED PRECEDING)),
    u AS (SELECT *, least(min(balance) OVER w, 0) AS low FROM r WINDOW w AS (PARTITION BY pid, terminal ORDER BY second, CASE WHEN kind = 'login' THEN 0 ELSE 1 END, id ROWS UNBOUNDED PRECEDING)),
    v AS (SELECT *, kind = 'logout' AND low < coalesce(lag(low) OVER w, 0) AS alone FROM u WINDOW w AS (PARTITION BY pid, terminal ORDER BY second, CASE WHEN kind = 'login' THEN 0 ELSE 1 END, id)),
    n AS (SELECT *, row_number() OVER (PARTITION BY pid, terminal, kind, alone ORDER BY second, id) AS k FROM v)
    SELECT i.pid, i.terminal, i.id AS login_id, i.second AS login_second, o.id AS logout_id, o.second AS logout_second
    FROM (SELECT * FROM n WHERE kind = 'login') i LEFT JOIN (SELECT * FROM n WHERE kind = 'logout' AND NOT alone) o ON i.pid = o.pid AND i.terminal = o.terminal AND i.k = o.k
    UNION ALL SELECT pid, terminal, NULL, NULL, id, second FROM n WHERE alone"""
)
def session_pairs(spark, d):
    rows = timeline_events(spark, d).select(
        F.col("source_object_id").alias("pid"), F.col("event_type").alias("terminal"), "id", epoch_second().alias("second"),
        F.when(F.col("id") % 2 == 0, "login").otherwise("logout").alias("kind"),
    )
    return joins.pair_sessions(rows)


@query("SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS second FROM events")
def function_filetime(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("s"))
    ticks = F.col("s") * 10_000_000 + times.FILETIME_EPOCH_TICKS + 7
    return rows.select("id", F.unix_seconds(times.from_filetime(ticks)).alias("second"))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS second FROM events")
def function_webkit_time(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("s"))
    micros = F.when(F.col("id") % 2 == 0, F.col("s") * 1_000_000 + times.WEBKIT_EPOCH_MICROSECONDS).otherwise(0)
    return rows.select("id", F.unix_seconds(times.from_webkit(micros)).alias("second"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS digest, md5(text) AS md5 FROM documents")
def function_digests(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    shown = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), F.upper(F.sha2("text", 256)))).otherwise("no digest")
    return rows.select("id", sha256_text(shown).alias("digest"), F.md5("text").alias("md5"))


_LEDGER = """, b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
  n AS (SELECT concat(user_id, '/', pos // 64) AS scope_key, count(*) AS n FROM b GROUP BY 1)"""


@query(_LEDGER + " SELECT scope_key, 5 AS sequence, 'hash' AS problem FROM n WHERE n >= 5 UNION ALL SELECT scope_key, 6, 'link' FROM n WHERE n >= 6")
def integrity_chain(spark, d):
    """The ledgers of all users over all events, in segments of 64. In each the fifth event was
    changed after it was hashed, together with its hash, so its successor's link breaks too."""
    rows = it.numbered(read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")
    rows = rows.select(
        F.expr("concat(user_id, '/', at div 64)").alias("scope_key"), (F.col("at") % 64 + 1).alias("sequence"),
        F.concat_ws("|", "event_id", "event_type", "value").alias("details"),
    )
    segment = rows.groupBy("scope_key").agg(F.array_sort(F.collect_list(F.struct("sequence", "details"))).alias("events"))
    linked = F.expr(
        "aggregate(events, array(struct(repeat('0', 64) AS previous_hash, '' AS hash)), (acc, e) -> array_append(acc, struct("
        "if(size(acc) = 1, repeat('0', 64), element_at(acc, -1).hash) AS previous_hash,"
        " sha2(concat_ws(char(31), if(size(acc) = 1, repeat('0', 64), element_at(acc, -1).hash), e.details), 256) AS hash)))"
    )
    chained = segment.select("scope_key", F.explode(F.arrays_zip("events", F.slice(linked, 2, 64).alias("links"))).alias("x"))
    rows = chained.select("scope_key", F.col("x.events.sequence").cast("int").alias("sequence"), "x.events.details", "x.links.hash", "x.links.previous_hash")
    changed = rows.withColumn("hash", F.when(F.col("sequence") == 5, F.sha2("details", 256)).otherwise(F.col("hash")))
    return it.verify_chain(changed, ["details"])


_MERKLE = """, b AS (SELECT {scope} AS k, row_number() OVER (PARTITION BY {scope} ORDER BY event_id) - 1 AS pos, sha256('leaf:' || CAST(event_id AS VARCHAR)) AS h FROM events),
    tree AS (SELECT k, pos, h, max(pos) OVER (PARTITION BY k) AS last FROM b
      UNION ALL SELECT k, pos // 2, sha256('node:' || max(CASE WHEN pos % 2 = 0 THEN h END) || coalesce(max(CASE WHEN pos % 2 = 1 THEN h END), max(CASE WHEN pos % 2 = 0 THEN h END))), last // 2 FROM tree WHERE last > 0 GROUP BY k, pos // 2, last // 2)
    SELECT k AS scope_key, h AS root FROM tree WHERE last = 0"""


@query(_MERKLE.format(scope="user_id % 8"))
def integrity_merkle(spark, d):
    """A tree over all events of each of eight sources."""
    rows = it.numbered(read(spark, d, "events").selectExpr("user_id % 8 AS source", "event_id"), "source", "event_id")
    return it.merkle_roots(rows.select(F.col("source").alias("scope_key"), "at", F.col("event_id").alias("data")))


@query(_MERKLE.format(scope="event_type"))
def integrity_merkle_all(spark, d):
    """A tree over all events of each type."""
    rows = it.numbered(read(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id")
    return it.merkle_roots(rows.select(F.col("event_type").alias("scope_key"), "at", F.col("event_id").alias("data")))


@query(", e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events) SELECT event_type AS scope_key, pos AS at, event_id % 7 <> 0 AS verified FROM e")
def integrity_merkle_verify(spark, d):
    """The proof of each event; every seventh event was changed since."""
    rows = it.numbered(read(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id")
    leaves = rows.select(F.col("event_type").alias("scope_key"), "at", F.col("event_id").cast("string").alias("data"))
    levels = it.merkle_levels(leaves, "L", "N")
    changed = leaves.withColumn("data", F.when(F.col("data").cast("long") % 7 == 0, F.concat("data", F.lit("x"))).otherwise(F.col("data")))
    return it.merkle_verify(changed, it.merkle_proofs(levels, leaves), it.merkle_roots(leaves, "L", "N"), "L", "N")


@query("SELECT doc_id // 100 AS file_id, doc_id AS line_number, CASE doc_id % 4 WHEN 0 THEN 'install' WHEN 1 THEN 'upgrade' WHEN 2 THEN 'remove' END AS action, concat('pkg', doc_id, ':amd64') AS package, CASE doc_id % 4 WHEN 0 THEN concat('2.', doc_id) WHEN 1 THEN concat('2.', doc_id) ELSE concat('1.', doc_id) END AS version, concat('2024-01-15 10:', lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0'), ':00') AS at_time FROM documents WHERE doc_id % 4 <> 3")
def log_dpkg(spark, d):
    lines = read(spark, d, "documents").selectExpr(
        "doc_id div 100 AS file_id", "doc_id AS line_number",
        "concat('2024-01-15 10:', lpad(doc_id % 60, 2, '0'), ':00 ', CASE doc_id % 4 WHEN 0 THEN concat('install pkg', doc_id, ':amd64 <none> 2.', doc_id) WHEN 1 THEN concat('upgrade pkg', doc_id, ':amd64 1.', doc_id, ' 2.', doc_id)"
        " WHEN 2 THEN concat('remove pkg', doc_id, ':amd64 1.', doc_id, ' <none>') ELSE concat('status installed pkg', doc_id, ':amd64 1.0') END) AS line",
    )
    return lg.parse_dpkg(lines).select("file_id", "line_number", "action", "package", "version", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at_time"))


@query("SELECT doc_id // 100 AS file_id, doc_id AS line_number, CASE doc_id % 4 WHEN 0 THEN 'install' WHEN 1 THEN 'upgrade' ELSE 'remove' END AS action, CASE doc_id % 4 WHEN 2 THEN concat('plain', doc_id) ELSE concat('lib-x', doc_id) END AS package, CASE WHEN doc_id % 4 <> 2 THEN concat('1.', doc_id, '-3.el8.x86_64') END AS version, CASE WHEN doc_id % 2 = 0 THEN '2024-02-05 08:00:00' ELSE '2023-12-05 08:00:00' END AS at_time FROM documents WHERE doc_id % 4 <> 3")
def log_rpm(spark, d):
    lines = read(spark, d, "documents").selectExpr(
        "doc_id div 100 AS file_id", "doc_id AS line_number", "TIMESTAMP '2024-03-01 00:00:00' AS reference",
        "concat(CASE WHEN doc_id % 2 = 0 THEN 'Feb  5' ELSE 'Dec  5' END, ' 08:00:00 ', CASE doc_id % 4 WHEN 0 THEN concat('Installed: lib-x', doc_id, '-1.', doc_id, '-3.el8.x86_64') WHEN 1 THEN concat('Updated: lib-x', doc_id, '-1.', doc_id, '-3.el8.x86_64')"
        " WHEN 2 THEN concat('Erased: plain', doc_id) ELSE 'Cleanup' END) AS line",
    )
    return lg.parse_rpm(lines).select("file_id", "line_number", "action", "package", "version", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at_time"))


def _le(value: str, width: int) -> str:
    """SQL for the little-endian bytes of a number, in hex."""
    digits = f"lpad(hex(bigint({value})), {2 * width}, '0')"
    return "concat(" + ", ".join(f"substr({digits}, {2 * i + 1}, 2)" for i in reversed(range(width))) + ")"


@query("SELECT CAST(doc_id AS VARCHAR) AS file_id, 1 + i AS uid, concat('pts/', i) AS terminal, concat('10.0.0.', doc_id % 200) AS host, CASE WHEN i = 0 THEN 1700000000 + doc_id END AS second FROM documents, (VALUES (0), (1)) v(i)")
def log_last_logins(spark, d):
    """A file of three slots for each document; the first user never came, the last has no time."""
    slot = lambda time, line: f"{_le(time, 4)}, rpad(hex('{line}'), 64, '0'), rpad(hex(concat('10.0.0.', doc_id % 200)), 512, '0')"
    content = f"unhex(concat(repeat('00', 292), {slot('1700000000 + doc_id', 'pts/0')}, {slot('0', 'pts/1')}))"
    return hosts.last_logins(read(spark, d, "documents").selectExpr("doc_id AS id", f"{content} AS content"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file_id, 1 AS uid, doc_id % 9 AS failures, 5 AS most, 'tty1' AS terminal, 1700000000 + doc_id AS second, 600 AS lock_seconds, doc_id % 9 >= 5 AS locked FROM documents")
def log_login_failures(spark, d):
    """A file of two slots for each document, in one of both layouts."""
    slot = lambda width: f"concat(repeat('00', {16 + 2 * width}), {_le('doc_id % 9', 2)}, '0500', rpad(hex('tty1'), 24, '0'), {_le('1700000000 + doc_id', width)}, {_le('600', width)})"
    content = f"unhex(CASE WHEN doc_id % 2 = 0 THEN {slot(8)} ELSE {slot(4)} END)"
    return hosts.login_failures(read(spark, d, "documents").selectExpr("doc_id AS id", f"{content} AS content"))
