"""Log and configuration lines to rows, and what is found in them."""

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What marks requests and scripts as suspicious (kind, severity, confidence, texts).
REQUEST_RULES = [
    ("sqlInjection", "high", 0.9, ["union%20select", "union select", " or 1=1", "%27%20or%20", "information_schema", "sleep(", "benchmark("]),
    ("localFileInclusion", "high", 0.9, ["../", "..%2f", "/etc/passwd", "win.ini", "php://filter"]),
    ("crossSiteScripting", "medium", 0.75, ["<script", "%3cscript", "javascript:", "onerror=", "onload="]),
    ("scannerFingerprint", "medium", 0.8, ["sqlmap", "nikto", "dirbuster", "gobuster", "wfuzz", "acunetix"]),
]
#: Texts of web shells, and of addresses that log in.
WEB_SHELL_MARKERS = ["eval(", "assert(", "base64_decode", "shell_exec", "system(", "passthru(", "cmd.exe", "powershell", "runtime.getruntime"]
LOGIN_WORDS = ["login", "signin", "wp-login", "admin"]
BRUTE_FORCE_SECONDS, BRUTE_FORCE_REQUESTS = 300, 50
#: MySQL log findings, the first that fits (kind, severity, confidence, texts).
MYSQL_LOG_RULES = [
    ("accessDenied", "medium", 0.84, ["access denied for user"]),
    ("serverCrashSignal", "high", 0.82, ["mysqld got signal", "got signal"]),
    ("crashRecovery", "medium", 0.8, ["database was not shutdown normally", "crash recovery", "starting crash recovery"]),
    ("serviceStarted", "info", 0.7, ["ready for connections"]),
]
#: MySQL settings that are findings (key, test of the value, kind, severity, confidence).
MYSQL_CONFIG_RULES = [
    ("bind-address", "wildcard", "bindAddressAny", "medium", 0.86),
    ("general-log", "on", "generalLogEnabled", "low", 0.75),
    ("init-file", "any", "init-fileConfigured", "low", 0.72),
    ("local-infile", "on", "localInfileEnabled", "medium", 0.82),
    ("plugin-load", "any", "plugin-loadConfigured", "low", 0.72),
    ("plugin-load-add", "any", "plugin-load-addConfigured", "low", 0.72),
    ("secure-file-priv", "empty", "secureFilePrivEmpty", "medium", 0.78),
    ("skip-networking", "off", "networkingEnabled", "info", 0.7),
]
WILDCARD_ADDRESSES, SWITCHED_ON = ["0.0.0.0", "::", "*"], ["", "1", "on", "true", "yes"]

_ACCESS = r'^\s*(\S+)(?:\s+(\S+))?[^\[]*\[([^\]]*)\]\s*"([^"]*)"\s+(\d{1,5})(?:\s+(\S+))?(?:\s+"([^"]*)")?(?:\s+"([^"]*)")?'
_IP = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:]+)$"


#: Actions of package logs that count, and marks of the other family's with their actions, first match first.
DPKG_ACTIONS = ("install", "upgrade", "configure", "trigproc", "remove", "purge")
RPM_ACTIONS = [
    ("Installed:", "install"), ("Updated:", "upgrade"), ("Upgraded:", "upgrade"), ("Erased:", "remove"),
    ("Removed:", "remove"), ("Downgraded:", "downgrade"), ("Reinstalled:", "reinstall"),
]


def _contains_any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found |= text.contains(p)
    return found


def _or_null(c: Column, nothing: str = "") -> Column:
    return F.when(c != nothing, c)


def parse_access(lines: DataFrame) -> DataFrame:
    """``line_number, line`` of web access logs to requests. Lines without a bracketed time, a
    quoted request of three words or a numeric status are left out. A first word that is no
    address before one that is, is the virtual host."""
    # one pass over the line: its eight groups, parted by a sign that no line holds
    groups = F.split(F.regexp_replace("line", _ACCESS + r"(?s).*$", "\x01".join(f"${i}" for i in range(1, 9))), "\x01")
    rows = lines.select("line_number", groups.alias("g")).where(F.size("g") == 8)
    rows = rows.select(
        "line_number", F.col("g")[0].alias("first"), F.col("g")[1].alias("second"), F.col("g")[2].alias("when"),
        F.split(F.trim(F.col("g")[3]), r"\s+").alias("request"), F.col("g")[4].cast("int").alias("status"), F.col("g")[5].alias("bytes"),
        F.col("g")[6].alias("referer"), F.col("g")[7].alias("user_agent"),
    ).where((F.size("request") == 3) & F.col("status").between(0, 65535))
    hosted = ~F.col("first").rlike(_IP) & F.col("second").rlike(_IP)
    return rows.select(
        "line_number",
        F.when(hosted, F.col("second")).otherwise(F.col("first")).alias("client_ip"),
        F.when(hosted, F.col("first")).alias("vhost"),
        F.try_to_timestamp("when", F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"),
        F.col("request")[0].alias("method"), F.col("request")[1].alias("uri"), F.col("request")[2].alias("protocol"), "status",
        F.when(F.col("bytes").rlike(r"^\d+$"), F.col("bytes").cast("long")).alias("response_bytes"),
        _or_null(_or_null(F.col("referer")), "-").alias("referer"), _or_null(_or_null(F.col("user_agent")), "-").alias("user_agent"),
    )


def parse_error(lines: DataFrame) -> DataFrame:
    """Every line of an error log that isn't blank, with its time text and severity if it has them."""
    line = F.trim("line")
    return lines.where(line != "").select(
        "line_number", _or_null(F.regexp_extract(line, r"^\[?([A-Z][a-z]{2} [A-Z][a-z]{2} [^\]]*|\d{4}/\d\d/\d\d \d\d:\d\d:\d\d)\]?", 1)).alias("time_text"),
        _or_null(F.regexp_extract(line, r"\[(?:\w+:)?(emerg|alert|crit|error|warn|notice|info|debug)\]", 1)).alias("severity"), line.alias("message"),
    )


def web_findings(requests: DataFrame) -> DataFrame:
    """One row for each rule that a request's address, referer or agent meets."""
    text = F.lower(F.concat_ws(" ", "uri", F.coalesce("referer", F.lit("")), F.coalesce("user_agent", F.lit(""))))
    # one scan for all texts lets most requests go before each rule is tried
    any_part = "|".join(re.escape(p) for *_, parts in REQUEST_RULES for p in parts)
    requests = requests.select("line_number", "client_ip", "uri", text.alias("inspected")).where(F.col("inspected").rlike(any_part))
    inspected = F.col("inspected")
    found = [
        F.when(_contains_any(inspected, parts), F.struct(F.lit(kind).alias("finding_kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
        for kind, severity, confidence, parts in REQUEST_RULES
    ]
    return requests.select("line_number", "client_ip", "uri", F.inline(F.array_compact(F.array(*found))))


def looks_like_login(uri: Column) -> Column:
    return _contains_any(F.lower(uri), LOGIN_WORDS)


def brute_force(requests: DataFrame, second: Column, least: int = BRUTE_FORCE_REQUESTS) -> DataFrame:
    """Addresses with so many login posts in one bucket of five minutes. Counts combine in tasks
    before they move, so one busy address is no hot spot."""
    posts = requests.where((F.lower("method") == "post") & looks_like_login(F.col("uri")) & second.isNotNull())
    bucket = F.floor(second / BRUTE_FORCE_SECONDS).alias("bucket")
    return posts.groupBy("client_ip", bucket).agg(F.count("*").alias("requests")).where(F.col("requests") >= least)


def web_shells(files: DataFrame) -> DataFrame:
    """Lines of ``id, content`` that hold a marker of a web shell."""
    rows = files.select("id", F.posexplode(F.split("content", "\r?\n")).alias("at", "line"))
    return rows.where(_contains_any(F.lower("line"), WEB_SHELL_MARKERS)).select("id", (F.col("at") + 1).alias("line_number"), F.substring(F.trim("line"), 1, 240).alias("evidence"))


def parse_bash_history(lines: DataFrame) -> DataFrame:
    """``file_id, line_number, line`` to commands; a line ``#<seconds>`` is the time of the next."""
    stamp = F.regexp_extract(F.trim("line"), r"^#(\d{9,11})$", 1)
    order = Window.partitionBy("file_id").orderBy("line_number")
    rows = lines.where(F.trim("line") != "").withColumn("stamp", _or_null(stamp)).withColumn("before", F.lag("stamp").over(order))
    return rows.where(F.col("stamp").isNull() & ~F.trim("line").startswith("#")).select(
        "file_id", "line_number", F.trim("line").alias("command"), F.timestamp_seconds(F.col("before").cast("long")).alias("ts")
    )


def parse_sudo(lines: DataFrame) -> DataFrame:
    """Commands and failed attempts from authentication logs. The tag ``sudo`` has to be among the
    first five words; lines about sessions are left out."""
    message = F.regexp_extract("line", r"^(?:\S+\s+){1,4}?sudo(?:\[\d+\])?:\s+(.*)$", 1)
    rows = lines.select("line_number", message.alias("m")).where("m <> ''")
    rows = rows.where(~F.col("m").contains("session opened for user") & ~F.col("m").contains("session closed for user"))
    failed = F.lower("m").rlike("authentication failure|incorrect password|not in sudoers|not allowed|command not allowed")
    field = lambda name: _or_null(F.trim(F.regexp_extract("m", name + r"=([^;]*)", 1)))
    command = _or_null(F.trim(F.regexp_extract("m", "COMMAND=(.*)$", 1)))
    user = F.coalesce(_or_null(F.regexp_extract("m", r"^(\S+)\s+:", 1)), _or_null(F.regexp_extract("m", r"\buser=(\S+)", 1)))
    return rows.select(
        "line_number", user.alias("user"), F.coalesce(command, F.when(failed, "[authentication failure]")).alias("command"),
        field("PWD").alias("working_directory"), F.coalesce(field("USER"), F.when(failed, "root")).alias("target_user"), field("TTY").alias("terminal"), (~failed).alias("success"),
    ).where("command IS NOT NULL AND (success OR user IS NOT NULL)")


def parse_cron(lines: DataFrame, system: bool = True) -> DataFrame:
    """Jobs of a crontab; system tables name a user before the command. Comments and assignments
    are left out."""
    line = F.trim("line")
    keep = (line != "") & ~line.startswith("#") & ~(line.contains("=") & ~line.rlike(r"\s"))
    words = F.split(line, r"\s+")
    at = F.when(line.startswith("@"), 1).otherwise(5)
    rows = lines.where(keep).select("line_number", words.alias("w"), at.alias("at")).where(F.size("w") > F.col("at") + int(system))
    return rows.select(
        "line_number", F.array_join(F.slice("w", F.lit(1), F.col("at")), " ").alias("schedule"),
        (F.get("w", F.col("at")) if system else F.lit(None).cast("string")).alias("user"),
        F.array_join(F.slice("w", F.col("at") + 1 + int(system), F.size("w")), " ").alias("command"),
    )


def parse_apt_history(lines: DataFrame) -> DataFrame:
    """Package actions of apt's history: each package of an action line, with the date of its
    block. ``file_id, line_number, line``."""
    field = r"^(Start-Date|Commandline|Requested-By|Install|Upgrade|Remove|Purge|Reinstall|Downgrade|End-Date):\s*(.*)$"
    rows = lines.select("file_id", "line_number", F.regexp_extract("line", field, 1).alias("k"), F.regexp_extract("line", field, 2).alias("v")).where("k <> ''")
    order = Window.partitionBy("file_id").orderBy("line_number")
    rows = rows.withColumn("block", F.sum((F.col("k") == "Start-Date").cast("int")).over(order))
    inside = Window.partitionBy("file_id", "block").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda name: F.last(F.when(F.col("k") == name, F.col("v")), ignorenulls=True).over(inside)
    rows = rows.withColumn("start_date", of("Start-Date")).withColumn("command_line", of("Commandline")).withColumn("requested_by", of("Requested-By"))
    acts = rows.where(F.col("k").isin("Install", "Upgrade", "Remove", "Purge", "Reinstall", "Downgrade"))
    each = acts.select("file_id", "line_number", F.lower("k").alias("action"), "start_date", "command_line", "requested_by", F.explode(F.split("v", r"\),\s*")).alias("p"))
    return each.select(
        "file_id", "line_number", "action", F.regexp_extract("p", r"^([^:\s(]+)", 1).alias("package"), _or_null(F.regexp_extract("p", r"\(([^),]+)", 1)).alias("version"),
        "start_date", "command_line", "requested_by",
    ).where("package <> ''")


def parse_mysql_config(lines: DataFrame) -> DataFrame:
    """Settings with their section; keys in lower case with hyphens."""
    line = F.trim("line")
    order = Window.partitionBy("file_id").orderBy("line_number")
    rows = lines.where((line != "") & ~line.rlike("^[#;]")).withColumn("t", line)
    rows = rows.withColumn("section", F.last(_or_null(F.regexp_extract("t", r"^\[([^\]]+)\]", 1)), ignorenulls=True).over(order))
    pair = r"^([^=\s]+)\s*(?:=\s*(.*))?$"
    return rows.where(~F.col("t").startswith("[")).select(
        "file_id", "line_number", "section", F.translate(F.lower(F.regexp_extract("t", pair, 1)), "_", "-").alias("key"), F.regexp_extract("t", pair, 2).alias("value")
    )


def mysql_config_findings(settings: DataFrame) -> DataFrame:
    """Risky settings with ``finding_kind, severity, confidence, evidence``."""
    value = F.lower(F.trim("value"))
    tests = {"any": F.lit(True), "wildcard": value.isin(WILDCARD_ADDRESSES), "on": value.isin(SWITCHED_ON), "off": ~value.isin(SWITCHED_ON), "empty": value == ""}
    told = F.lit(None).cast("struct<finding_kind:string,severity:string,confidence:double>")
    for key, test, kind, severity, confidence in MYSQL_CONFIG_RULES:
        fits = F.struct(F.lit(kind).alias("finding_kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
        told = F.when((F.col("key") == key) & tests[test], fits).otherwise(told)
    evidence = F.when((F.col("key") == "secure-file-priv") & (value == ""), F.concat("key", F.lit(" is empty"))).otherwise(F.concat_ws("=", "key", "value"))
    return settings.withColumn("told", told).where("told IS NOT NULL").select(*settings.columns, "told.*", evidence.alias("evidence"))


def mysql_log_findings(lines: DataFrame) -> DataFrame:
    told = F.lit(None).cast("struct<finding_kind:string,severity:string,confidence:double>")
    for name, level, confidence, parts in reversed(MYSQL_LOG_RULES):
        fits = F.struct(F.lit(name).alias("finding_kind"), F.lit(level).alias("severity"), F.lit(confidence).alias("confidence"))
        told = F.when(_contains_any(F.lower("line"), parts), fits).otherwise(told)
    return lines.select("line_number", told.alias("told"), F.col("line").alias("evidence")).where("told IS NOT NULL").select("line_number", "told.*", "evidence")


def parse_passwd(lines: DataFrame) -> DataFrame:
    """Accounts; those from uid 1000 on are users."""
    f = F.split("line", ":")
    rows = lines.where((F.size(f) >= 7) & f[2].rlike(r"^\d+$"))
    return rows.select("line_number", f[0].alias("user"), f[2].cast("long").alias("uid"), f[3].cast("long").alias("gid"), f[5].alias("home"), f[6].alias("shell"), (f[2].cast("long") >= 1000).alias("is_user"))


def parse_os_release(lines: DataFrame) -> DataFrame:
    pair = r"""^([A-Z_0-9]+)=["']?([^"']*)["']?$"""
    return lines.select("line_number", F.regexp_extract(F.trim("line"), pair, 1).alias("key"), F.regexp_extract(F.trim("line"), pair, 2).alias("value")).where("key <> ''")


def parse_dpkg(lines: DataFrame) -> DataFrame:
    """Package actions of dpkg's log (file_id, line_number, line), times in the session's zone.

    The version is what an installation or upgrade brings, else the present one.
    """
    words = F.split(F.trim("line"), " ", 5)
    rows = lines.select("file_id", "line_number", words.alias("w")).where(F.get("w", F.lit(2)).isin(*DPKG_ACTIONS) & (F.size("w") >= 4))
    action, versions = F.get("w", F.lit(2)), F.filter(F.split(F.coalesce(F.get("w", F.lit(4)), F.lit("")), r"\s+"), lambda x: x != "")
    version = F.when(action.isin("install", "upgrade"), F.get(versions, F.size(versions) - 1)).otherwise(F.get(versions, F.lit(0)))
    when = F.try_to_timestamp(F.array_join(F.slice("w", 1, 2), " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    return rows.select("file_id", "line_number", action.alias("action"), F.get("w", F.lit(3)).alias("package"), F.when(version != "<none>", version).alias("version"), when.alias("ts"))


def parse_rpm(lines: DataFrame) -> DataFrame:
    """Package actions of yum's and dnf's logs. ``lines`` has file_id, line_number, line and
    ``reference``, a time (the file's own): dates without a year are of the last year in which they
    are not after it."""
    line = F.trim("line")
    hits = [F.when(F.contains(line, F.lit(mark)), F.struct(F.lit(action).alias("action"), F.regexp_extract(line, rf"^.*?{mark}\s*(\S*)", 1).alias("token"))) for mark, action in RPM_ACTIONS]
    rows = lines.select("file_id", "line_number", "reference", line.alias("line"), F.coalesce(*hits).alias("hit")).where("hit.token <> ''")
    parts = F.split(F.regexp_replace("hit.token", "^,+|,+$", ""), "-")
    named = (F.size(parts) >= 3) & (F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "-") != "")
    cut = F.when(named, F.size(parts) - 2).otherwise(F.size(parts))
    offset = F.regexp_extract("line", r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d):?(\d\d)(?:\s|$)", 1)
    minutes = F.regexp_extract("line", r"^\S+[+-]\d\d:?(\d\d)(?:\s|$)", 1)
    absolute = F.when(offset != "", F.concat(offset, F.lit(":"), minutes).try_cast("timestamp"))
    prefix = F.regexp_replace(F.substring("line", 1, 15), r"\s+", " ")
    of_year = lambda back: F.try_to_timestamp(F.concat_ws(" ", F.year("reference") - back, prefix), F.lit("yyyy MMM d HH:mm:ss"))
    when = F.coalesce(absolute, F.when(of_year(0) > F.col("reference"), of_year(1)).otherwise(of_year(0)))
    return rows.select(
        "file_id", "line_number", "hit.action", F.array_join(F.slice(parts, F.lit(1), cut), "-").alias("package"),
        F.when(named, F.array_join(F.slice(parts, cut + 1, F.lit(2)), "-")).alias("version"), when.alias("ts"),
    )
