"""Queries over data sources, incremental results, networks, forests and single-scan summaries."""

from pyspark.sql import functions as F

from ..functions.text import highlights
from ..functions.variants import with_fields
from ..operators import correlation as cor, forest, networks as nw, rules as ru
from ..operators.incremental import Snapshots
from ..operators.joins import temporal_text_matches
from ..operators.summaries import linux_summary
from ..plans.tables import Tables
from ..sources import bundle, extractors, generations, readers
from ..sources.adapters import artifacts, files, read, timeline_events
from .cases import _rule_artifacts
from .registry import query


def _more_artifacts(spark, d):
    """Those of the rule queries, and shortcuts to every fourth file, so some files have two."""
    second = files(spark, d).where("id % 4 = 1").select(
        (F.col("id") + 1_000_000_000).alias("id"), F.lit("LNK").alias("artifact_type"), F.to_json(F.struct(F.translate("path", "/", "\\").alias("target_path"))).alias("attrs")
    )
    return _rule_artifacts(spark, d).unionByName(second)


_SNAPSHOT = """, m AS (SELECT id AS artifact_id, id AS file_id, CASE WHEN id % 6 IN (2, 5) THEN 'name_match' ELSE 'path_match' END AS kind,
    CASE id % 6 WHEN 0 THEN 'direct' WHEN 2 THEN 'weak' ELSE 'strong' END AS confidence,
    CASE id % 6 WHEN 0 THEN 'LNK' WHEN 1 THEN 'LinuxSudoEvent' WHEN 2 THEN 'EmailMessage' WHEN 3 THEN 'RegistryValue' WHEN 4 THEN 'LinuxWebSite' ELSE 'Prefetch' END AS artifact_type FROM f
    UNION ALL SELECT 1000000000 + id, id, 'path_match', 'direct', 'LNK' FROM f WHERE id % 4 = 1),
  e AS (SELECT source_object_id AS file_id, count(*) AS events FROM t GROUP BY 1),
  g AS (SELECT m.file_id, count(*) AS artifacts, coalesce(max(events), 0) AS events,
    CASE WHEN bool_or(kind = 'path_match') THEN 'direct' WHEN coalesce(max(events), 0) > 0 OR count(*) >= 2 OR bool_or(confidence = 'strong') THEN 'strong' ELSE 'weak' END AS confidence
    FROM m LEFT JOIN e ON e.file_id = m.file_id GROUP BY 1),
  x AS (SELECT g.*, path FROM g JOIN f ON f.id = g.file_id)
  SELECT 'node' AS part, concat('file:', file_id) AS id, CAST(file_id AS VARCHAR) AS a, NULL::VARCHAR AS b, path AS title, NULL::VARCHAR AS confidence, artifacts AS support FROM x
  UNION ALL SELECT 'node', concat('artifact:', artifact_id), CAST(artifact_id AS VARCHAR), NULL, artifact_type, NULL, 1 FROM m
  UNION ALL SELECT 'edge', concat('edge:', artifact_id, ':', file_id, ':', kind), CAST(artifact_id AS VARCHAR), CAST(file_id AS VARCHAR), kind, confidence, 1 FROM m
  UNION ALL SELECT 'cluster', concat('cluster:', file_id), CAST(file_id AS VARCHAR), NULL, path, confidence, artifacts FROM x WHERE artifacts > 1
  UNION ALL SELECT 'lead', concat('lead:', file_id), CAST(file_id AS VARCHAR), NULL, path, confidence, artifacts + events FROM x"""


@query(_SNAPSHOT)
def correlation_snapshot_rows(spark, d):
    return cor.correlation_snapshot(_more_artifacts(spark, d), files(spark, d), timeline_events(spark, d))


@query(_SNAPSHOT)
def correlation_incremental(spark, d):
    """Two revisions: a part of the artifacts and events first, then all of them."""
    store = Snapshots(spark, Tables(spark, "snapshots").folder)
    artifacts, events = _more_artifacts(spark, d), timeline_events(spark, d)
    store.refresh(artifacts.where("id % 5 <> 0 AND id < 1000000000"), files(spark, d), events.where("id % 3 <> 0"))
    return store.refresh(artifacts, files(spark, d), events)


@query(
    "SELECT concat('<', id, '@box>') AS message_id, concat('Doc ', id) AS subject, sha256(trim(text, chr(10))) AS body FROM (SELECT doc_id AS id, coalesce(replace(replace(text, chr(13), ''), chr(12), ''), '') AS text FROM documents)"
)
def source_mailbox(spark, d):
    """All documents written as mailboxes, read back in byte ranges."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r")), F.lit("\f"))
    quoted = F.regexp_replace(text, "(?m)^(>*From )", ">$1")
    head = F.concat(F.lit("From box@x Mon Jan 1\nMessage-ID: <"), "doc_id", F.lit("@box>\nSubject: Doc "), "doc_id", F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"))
    path = Tables(spark, "mailboxes").folder
    read(spark, d, "documents").select(F.concat(head, quoted, F.lit("\n")).alias("value")).write.text(path)
    readers.register(spark)
    messages = spark.read.format("mailbox").option("split", 1 << 20).load(path)
    return messages.select("message_id", "subject", F.sha2(F.trim("body", F.lit("\n")), 256).alias("body"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS file_id, concat('/', source, '/', doc_id) AS path, doc_id % 11 = 0 AS deleted,
    CASE WHEN doc_id % 13 <> 0 THEN strlen(text) END AS size, CASE WHEN doc_id % 13 <> 0 THEN sha256(text) END AS sha256 FROM documents"""
)
def sink_file_bundle(spark, d):
    """All documents as a bundle of raw files, read back by its manifest; every thirteenth is skipped."""
    bundle.register(spark)
    path = f"{Tables(spark, 'bundle').folder}/files"
    rows = read(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("file_id"), F.concat_ws("/", F.lit(""), "source", "doc_id").alias("path"), (F.col("doc_id") % 11 == 0).alias("deleted"),
        F.when(F.col("doc_id") % 13 != 0, F.col("text").cast("binary")).alias("content"),
    )
    rows.write.format("file_bundle").mode("append").save(path)
    found = spark.read.format("file_bundle").load(path)
    return found.select("file_id", "path", "deleted", "size", F.when(F.sha2("content", 256) == F.col("sha256"), F.col("sha256")).alias("sha256"))


@query("SELECT id, event_type, data_source_id FROM t")
def sink_verified_generation(spark, d):
    """The timeline as a version, cloned to another root and read verified."""
    root = Tables(spark, "generations").folder
    generations.write_generation(timeline_events(spark, d), f"{root}/a", "1", ["data_source_id"])
    generations.clone_generation(spark, f"{root}/a", "1", f"{root}/b")
    return generations.read_generation(spark, f"{root}/b", "1").select("id", "event_type", F.col("data_source_id").cast("long").alias("data_source_id"))


@query(
    """, x AS (SELECT c_custkey AS id, c_nationkey AS n, c_custkey // 256 % 256 AS o, c_custkey % 3 = 0 AS six,
      CASE WHEN c_custkey % 3 = 0 THEN concat('fd00:', format('{:x}', c_nationkey), '::', format('{:x}', c_custkey % 65536)) ELSE concat('10.', c_nationkey, '.', c_custkey // 256 % 256, '.', c_custkey % 256) END AS address FROM customer),
    s AS (SELECT s_suppkey % 25 AS n, s_suppkey % 256 AS o, min(concat('s', s_suppkey)) AS id FROM supplier GROUP BY 1, 2)
    SELECT x.id, address, CASE WHEN six THEN concat('v', x.n) ELSE coalesce(s.id, concat('n', x.n)) END AS network_id, CASE WHEN six THEN 32 WHEN s.id IS NOT NULL THEN 24 ELSE 16 END AS prefix_length
    FROM x LEFT JOIN s ON s.n = x.n AND s.o = x.o"""
)
def network_longest_prefix(spark, d):
    customers, nations, suppliers = (read(spark, d, t) for t in ("customer", "nation", "supplier"))
    six = "concat('fd00:', lower(hex(c_nationkey)), '::', lower(hex(c_custkey % 65536)))"
    addresses = customers.selectExpr("c_custkey AS id", f"CASE WHEN c_custkey % 3 = 0 THEN {six} ELSE concat('10.', c_nationkey, '.', c_custkey div 256 % 256, '.', c_custkey % 256) END AS address")
    networks = (
        nations.selectExpr("concat('n', n_nationkey) AS network_id", "concat('10.', n_nationkey, '.0.0/16') AS cidr")
        .unionAll(nations.selectExpr("concat('v', n_nationkey)", "concat('fd00:', lower(hex(n_nationkey)), '::/32')"))
        .unionAll(suppliers.selectExpr("concat('s', s_suppkey)", "concat('10.', s_suppkey % 25, '.', s_suppkey % 256, '.0/24')"))
        .unionAll(spark.createDataFrame([("all", "10.0.0.0/8"), ("bad", "10.0.0.0/40"), ("none", "x/8")], "network_id string, cidr string"))
    )
    return nw.longest_prefix(addresses, networks)


_LINES = {
    0: ("/etc/hosts", ["concat('10.0.0.', k % 256, ' host', k, ' alias', k)", "concat('::', lower(hex(k % 65536)), ' six', k)", "'# none'", "'10.0.0.300 bad'"]),
    1: ("/etc/resolv.conf", ["concat('nameserver 10.1.1.', k % 256)", "'search lan'", "'nameserver bad'"]),
    2: ("/etc/network/interfaces", ["'  address 10.9.9.9'", "concat('iface eth', k % 3, ' inet static')", "concat('  address 10.2.', k % 256, '.1/24')", "concat('  gateway 10.2.', k % 256, '.254')", "'address 1.2.3.4/33'", "concat('iface br', k % 3, ' inet manual')", "'bridge-ports none eth0 eth1'"]),
    3: ("/etc/pve/corosync.conf", ["'totem {'", "'}'", "'node {'", "concat('  ring0_addr: 10.3.0.', k % 256)", "concat('  name: n', k)", "'  ring1_addr: bad'", "'}'", "'node {'", "'  ring0_addr: 10.3.1.1'"]),
}


@query(
    """, x AS (SELECT c_custkey AS k, c_custkey % 256 AS o FROM customer)
    SELECT concat('h', k, '/etc/hosts') AS path, 1 AS line_number, 0 AS at, 'hostname_mapping' AS kind, concat('host', k) AS subject, concat('10.0.0.', o) AS value FROM x WHERE k % 4 = 0
    UNION ALL SELECT concat('h', k, '/etc/hosts'), 1, 1, 'hostname_mapping', concat('alias', k), concat('10.0.0.', o) FROM x WHERE k % 4 = 0
    UNION ALL SELECT concat('h', k, '/etc/hosts'), 2, 0, 'hostname_mapping', concat('six', k), concat('::', format('{:x}', k % 65536)) FROM x WHERE k % 4 = 0
    UNION ALL SELECT concat('h', k, '/etc/resolv.conf'), 1, 0, 'dns_server', 'resolver', concat('10.1.1.', o) FROM x WHERE k % 4 = 1
    UNION ALL SELECT concat('h', k, '/etc/network/interfaces'), 3, 0, 'interface_address', concat('eth', k % 3), concat('10.2.', o, '.1/24') FROM x WHERE k % 4 = 2
    UNION ALL SELECT concat('h', k, '/etc/network/interfaces'), 4, 0, 'gateway', concat('eth', k % 3), concat('10.2.', o, '.254') FROM x WHERE k % 4 = 2
    UNION ALL SELECT concat('h', k, '/etc/network/interfaces'), 7, 0, 'bridge_member', concat('br', k % 3), 'eth0' FROM x WHERE k % 4 = 2
    UNION ALL SELECT concat('h', k, '/etc/network/interfaces'), 7, 1, 'bridge_member', concat('br', k % 3), 'eth1' FROM x WHERE k % 4 = 2
    UNION ALL SELECT concat('h', k, '/etc/pve/corosync.conf'), 4, 0, 'cluster_link', concat('n', k), concat('ring0_addr:10.3.0.', o) FROM x WHERE k % 4 = 3"""
)
def network_configured_facts(spark, d):
    k = read(spark, d, "customer").selectExpr("c_custkey AS k")
    parts = [k.where(f"k % 4 = {i}").selectExpr(f"concat('h', k, '{path}') AS path", f"posexplode(array({', '.join(lines)})) AS (at, line)") for i, (path, lines) in _LINES.items()]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionAll(p)
    return nw.configured_facts(lines.selectExpr("path", "at + 1 AS line_number", "line"))


def _resources(spark, d):
    customers, suppliers = read(spark, d, "customer"), read(spark, d, "supplier")
    pod = """to_json(named_struct('kind', 'Pod', 'metadata', named_struct('namespace', concat('ns', c_nationkey % 3), 'name', concat('p', c_custkey), 'labels', map('app', concat('a', c_nationkey), 'tier', c_mktsegment, 'all', 'x')),
      'spec', named_struct('nodeName', concat('m', c_custkey % 7)), 'status', named_struct('podIP', concat('10.', c_nationkey, '.0.', c_custkey % 256)))) AS document"""
    service = """to_json(named_struct('kind', 'Service', 'metadata', named_struct('namespace', concat('ns', s_nationkey % 3), 'name', concat('s', s_suppkey)),
      'spec', named_struct('selector', CASE WHEN s_suppkey % 2 = 0 THEN map('app', concat('a', s_nationkey), 'all', 'x', 'tier', 'BUILDING') ELSE map('all', 'x', 'app', concat('a', s_nationkey)) END))) AS document"""
    ingress = """to_json(named_struct('kind', 'Ingress', 'metadata', named_struct('namespace', concat('ns', s_nationkey % 3), 'name', concat('i', s_suppkey)),
      'spec', named_struct('rules', array(named_struct('host', concat('h', s_suppkey), 'http', named_struct('paths', array(named_struct('path', '/x', 'backend', named_struct('service', named_struct('name', concat('s', s_suppkey)))))))))) ) AS document"""
    rows = customers.selectExpr("concat('p', c_custkey) AS id", pod).unionAll(suppliers.selectExpr("concat('s', s_suppkey)", service)).unionAll(suppliers.where("s_suppkey % 5 = 0").selectExpr("concat('i', s_suppkey)", ingress))
    return nw.resources(rows.unionAll(spark.createDataFrame([("bad", "{"), ("none", None), ("empty", "{}")], "id string, document string")))


@query(
    """SELECT concat('Pod/ns', c_nationkey % 3, '/p', c_custkey) AS node_id, 'pod' AS node_type, concat('p', c_custkey) AS label, concat('10.', c_nationkey, '.0.', c_custkey % 256) AS address FROM customer
    UNION ALL SELECT concat('Service/ns', s_nationkey % 3, '/s', s_suppkey), 'service', concat('s', s_suppkey), NULL FROM supplier
    UNION ALL SELECT concat('Ingress/ns', s_nationkey % 3, '/i', s_suppkey), 'ingress', concat('i', s_suppkey), NULL FROM supplier WHERE s_suppkey % 5 = 0
    UNION ALL SELECT DISTINCT concat('Machine/m', c_custkey % 7), 'machine', concat('m', c_custkey % 7), NULL FROM customer""",
    relations="",
)
def cluster_resource_nodes(spark, d):
    return nw.resource_nodes(_resources(spark, d))


@query(
    """SELECT concat('Service/ns', s_nationkey % 3, '/s', s_suppkey) AS source_id, 'selects' AS relation, concat('Pod/ns', c_nationkey % 3, '/p', c_custkey) AS target_id, '' AS detail
      FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_suppkey % 2 = 1 OR c_mktsegment = 'BUILDING'
    UNION ALL SELECT concat('Pod/ns', c_nationkey % 3, '/p', c_custkey), 'runs_on', concat('Machine/m', c_custkey % 7), '' FROM customer
    UNION ALL SELECT concat('Ingress/ns', s_nationkey % 3, '/i', s_suppkey), 'routes_to', concat('Service/ns', s_nationkey % 3, '/s', s_suppkey), concat('h', s_suppkey, '/x') FROM supplier WHERE s_suppkey % 5 = 0""",
    relations="",
)
def cluster_resource_edges(spark, d):
    return nw.resource_edges(_resources(spark, d))


_HIVE = """WITH k AS (SELECT 'root' AS id, NULL AS parent_id, 'root' AS name, 0 AS position, -1 AS r, -1 AS n, -1 AS c, 0 AS depth, '' AS path
  UNION ALL SELECT concat('r', r_regionkey), 'root', r_name, r_regionkey, r_regionkey, -1, -1, 1, r_name FROM region
  UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name, -n_nationkey, n_regionkey, -n_nationkey, -1, 2, concat(r_name, chr(92), n_name) FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), c_name, c_custkey, n_regionkey, -n_nationkey, c_custkey, 3, concat(r_name, chr(92), n_name, chr(92), c_name) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
  z AS (SELECT *, row_number() OVER (ORDER BY depth <> 0, r, depth > 1, n, depth > 2, c) - 1 AS place FROM k)
"""


def _keys(spark, d):
    """Regions, nations and customers as the keys of a hive below one root."""
    return (
        read(spark, d, "region").selectExpr("concat('r', r_regionkey) AS id", "'root' AS parent_id", "r_name AS name", "r_regionkey AS position", "r_regionkey AS data_source_id")
        .unionAll(read(spark, d, "nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)", "n_name", "-n_nationkey", "n_regionkey"))
        .unionAll(read(spark, d, "customer").join(read(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).selectExpr("concat('c', c_custkey)", "concat('n', c_nationkey)", "c_name", "int(c_custkey)", "n_regionkey"))
        .unionAll(spark.createDataFrame([("root", None, "root", 0, -1)], "id string, parent_id string, name string, position int, data_source_id int"))
    )


@query(
    _HIVE
    + """SELECT id, CAST(depth AS BIGINT) AS depth, CASE depth WHEN 0 THEN (SELECT count(*) FROM k) WHEN 1 THEN (SELECT count(*) FROM k x WHERE x.r = z.r) WHEN 2 THEN (SELECT count(*) FROM k x WHERE x.r = z.r AND x.n = z.n AND x.depth >= 2) ELSE 1 END AS size,
    place, row_number() OVER (ORDER BY depth, place) - 1 AS breadth FROM z""",
    relations="",
)
def forest_walks(spark, d):
    return forest.level_order(_keys(spark, d), ["position"])


@query(
    _HIVE + "SELECT r AS data_source_id, id, breadth FROM (SELECT r, id, row_number() OVER (PARTITION BY r ORDER BY depth, place) - 1 AS breadth FROM z) WHERE breadth < 8",
    relations="",
)
def forest_first_objects(spark, d):
    return forest.first_objects(_keys(spark, d), ["position"]).select("data_source_id", "id", "breadth")


_HITS = """, v AS (SELECT concat('c', o_custkey) AS key_id, o_orderkey AS value_index, o_orderpriority AS name, concat('status ', o_orderstatus, ' urgency ', o_orderpriority = '3-MEDIUM') AS data FROM orders),
  h AS (SELECT place, -1 AS seq, 'key' AS kind, id AS key_id, NULL::BIGINT AS value_index, path, name, 'key' AS matched_field, path AS preview FROM z WHERE contains(lower(name), '{q}') OR contains(lower(path), '{q}')
    UNION ALL SELECT place, value_index, 'value', key_id, value_index, path, v.name, CASE WHEN contains(lower(v.name), '{q}') THEN 'valueName' ELSE 'valueData' END, data FROM v JOIN z ON z.id = v.key_id WHERE contains(lower(v.name), '{q}') OR contains(lower(data), '{q}'))
  SELECT CAST(row_number() OVER (ORDER BY place, seq) - 1 AS INTEGER) AS number, kind, key_id, value_index, path, name, matched_field, preview, (SELECT count(*) FROM h) AS total FROM h ORDER BY place, seq LIMIT 512"""


def _values(spark, d):
    return read(spark, d, "orders").selectExpr("concat('c', o_custkey) AS key_id", "o_orderkey AS value_index", "o_orderpriority AS name", "concat('status ', o_orderstatus, ' urgency ', o_orderpriority = '3-MEDIUM') AS data")


@query(_HIVE.rstrip() + _HITS.replace("{q}", "urgen"), relations="")
def hive_search(spark, d):
    return forest.hive_search(_keys(spark, d), _values(spark, d), " URGEN ")


@query(_HIVE.rstrip() + _HITS.replace("{q}", "asia"), relations="")
def hive_search_paths(spark, d):
    return forest.hive_search(_keys(spark, d), _values(spark, d), "Asia")


def _mixed(spark, d):
    """Artifacts whose field ``user`` is a number, a text, a list, a boolean, a fraction or nothing."""
    attrs = """CASE c_custkey % 6 WHEN 0 THEN concat('{"user":', c_custkey, '}') WHEN 1 THEN concat('{"user":"U', c_custkey, '"}') WHEN 2 THEN concat('{"user":["u', c_custkey, '",', c_custkey, ',"x"]}')
      WHEN 3 THEN '{"user":true}' WHEN 4 THEN concat('{"user":', c_custkey, '.5}') ELSE '{"user":{"name":"x"}}' END AS attrs"""
    return with_fields(read(spark, d, "customer").selectExpr("c_custkey AS id", "'Account' AS family", attrs), {"user": "user"})


_USER = """CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN concat('U', c_custkey) WHEN 2 THEN concat('u', c_custkey, ' x') WHEN 3 THEN 'true' WHEN 4 THEN concat(c_custkey, '.5') END"""


@query(f'SELECT c_custkey AS id, {_USER} AS "user" FROM customer', relations="")
def rule_field_values(spark, d):
    return _mixed(spark, d).select("id", "user")


@query(
    """SELECT concat('rp:p:same:', c_custkey, ':', c_custkey) AS id, CAST(c_custkey AS VARCHAR) AS source_id, CAST(c_custkey AS VARCHAR) AS target_id, 'correlates_with' AS edge_type, 0.9::DOUBLE AS confidence FROM customer WHERE c_custkey % 6 IN (0, 1, 2, 4)
    UNION ALL SELECT concat('rp:p:same:', a.c_custkey, ':', b.c_custkey), CAST(a.c_custkey AS VARCHAR), CAST(b.c_custkey AS VARCHAR), 'correlates_with', 0.9 FROM customer a JOIN customer b ON a.c_custkey % 6 = 3 AND b.c_custkey % 60 = 3""",
    relations="",
)
def rule_over_mixed_fields(spark, d):
    """Accounts to nodes of the same name, whatever type the field has."""
    name = "CASE c_custkey % 6 WHEN 1 THEN concat('u', c_custkey) WHEN 2 THEN concat('U', c_custkey, ' X') WHEN 3 THEN if(c_custkey % 60 = 3, 'TRUE', 'other') WHEN 4 THEN concat(c_custkey, '.5') ELSE string(c_custkey) END AS label"
    nodes = read(spark, d, "customer").selectExpr("c_custkey AS id", "'N' AS node_type", name)
    rule = ru.Rule("same", "Account", "N", "strong", (ru.Condition("user", "equals", "label"),))
    return ru.run_rule("p", rule, _mixed(spark, d), nodes)


@query()
def search_highlights(spark, d):
    """Snippets around near hits of two words in all documents, with byte places."""
    rows = read(spark, d, "documents").select("doc_id", highlights(F.col("text"), "the é").alias("snippets"))
    return rows.select("doc_id", F.size("snippets").alias("n"), F.to_json("snippets").alias("snippets"))


@query(
    """, n AS (SELECT c_custkey AS id, 1704067200 + c_custkey * 7919 % 2592000 AS second, concat('By User ', c_custkey % 40) AS needle FROM customer),
    x AS (SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS second, description FROM t)
    SELECT n.id AS needle_id, x.id AS text_id, abs(n.second - x.second) AS gap FROM n JOIN x ON x.second BETWEEN n.second - 3600 AND n.second + 3600 AND contains(lower(x.description), lower(n.needle))"""
)
def correlation_temporal_text(spark, d):
    needles = read(spark, d, "customer").selectExpr("c_custkey AS id", "1704067200 + c_custkey * 7919 % 2592000 AS second", "concat('By User ', c_custkey % 40) AS needle")
    texts = timeline_events(spark, d).selectExpr("id", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS second", "description AS text")
    return temporal_text_matches(needles, texts, 3600)


@query(
    """WITH x AS (SELECT o_orderkey AS id, o_orderkey % 8 AS m, -CAST(epoch_us(o_orderdate) AS BIGINT) AS age FROM orders),
    e AS (SELECT concat('family:', CASE WHEN m < 6 THEN 'LinuxSystemConfig' WHEN m = 6 THEN 'LinuxCronJob' ELSE 'LinuxBashCommand' END) AS key, age AS a, CAST(id AS VARCHAR) AS b, CAST(id AS VARCHAR) AS v FROM x
      UNION ALL SELECT 'system:os', CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, concat(CASE id % 3 WHEN 0 THEN '/etc/os-release' WHEN 1 THEN 'root/usr/lib/os-release' ELSE 'x/os-release' END), CAST(id AS VARCHAR) FROM x WHERE m = 0
      UNION ALL SELECT 'system:hostname', id % 1000, concat('host', id), concat('host', id) FROM x WHERE m = 1
      UNION ALL SELECT 'system:account', id % 2000, CAST(id AS VARCHAR), CAST(id AS VARCHAR) FROM x WHERE m = 2
      UNION ALL SELECT 'system:user', id % 2000, CAST(id AS VARCHAR), CAST(id AS VARCHAR) FROM x WHERE m = 2 AND id % 2000 >= 1000
      UNION ALL SELECT 'system:locked', 0, CAST(id AS VARCHAR), CAST(id AS VARCHAR) FROM x WHERE m = 3 AND id % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY a, b, v) AS r FROM e)
    SELECT key, count(*) AS n, string_agg(v, ',' ORDER BY a, b, v) FILTER (r <= 50) AS best FROM r GROUP BY key""",
    relations="",
)
def linux_summary_one_scan(spark, d):
    attrs = """CASE m WHEN 0 THEN concat('{"configKind":"osRelease","sourcePath":"', CASE id % 3 WHEN 0 THEN '/etc/os-release' WHEN 1 THEN 'root/usr/lib/os-release' ELSE 'x/os-release' END, '"}')
      WHEN 1 THEN concat('{"sourcePath":"/etc/hostname","lineNumber":', id % 1000, ',"line":" host', id, ' "}') WHEN 2 THEN concat('{"configKind":"passwdAccount","uid":', id % 2000, '}')
      WHEN 3 THEN concat('{"configKind":"shadowAccount","locked":', id % 2 = 1, '}') WHEN 4 THEN '{"configKind":"passwdAccount","uid":5000,"overlayContext":"x"}' ELSE '{}' END AS attrs"""
    rows = read(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 8 AS m", "o_orderdate AS created_at")
    rows = rows.selectExpr("id", "CASE WHEN m < 6 THEN 'LinuxSystemConfig' WHEN m = 6 THEN 'LinuxCronJob' ELSE 'LinuxBashCommand' END AS family", "created_at", attrs)
    return linux_summary(rows, 50).select("key", "n", F.array_join(F.col("best.v"), ",").alias("best"))


def _lines(path, content):
    return [("text", path, f'{{"n_bytes":{len(content)},"n_lines":{content.count(b"\n") + 1}}}'), ("undeclared", path, "{}")]


def _log_lines(path, content):
    return [("text", "log " + path, f'{{"n_lines":{content.count(b"\n") + 1}}}')]


@query(
    """SELECT CAST(id AS VARCHAR) AS source_object_id, 'text' AS family, path AS title, strlen(text) AS n_bytes, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, NULL::BIGINT AS dropped FROM f JOIN documents ON doc_id = id WHERE id % 5 <> 3
    UNION ALL SELECT NULL, 'dropped', NULL, NULL, NULL, count(*) FROM f WHERE id % 5 <> 3
    UNION ALL SELECT CAST(id AS VARCHAR), 'text', concat('log ', path), NULL, length(text) - length(replace(text, chr(10), '')) + 1, NULL FROM f JOIN documents ON doc_id = id WHERE id % 5 = 3"""
)
def extract_as_table_function(spark, d):
    """All documents through a built-in extractor and a plug-in that takes its family over for logs."""
    registry = extractors.Registry()
    registry.add(extractors.Extractor("lines", frozenset({"text"}), _lines, fragments=("/",), columns=(("n_bytes", "long"), ("n_lines", "long"))))
    registry.add(extractors.Extractor("logs", frozenset({"text"}), _log_lines, suffixes=(".log",), plugin=True, columns=(("n_lines", "long"),)))
    extractors.as_table_function(spark, registry)
    content = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    rows = files(spark, d).select("id", "path", "data_source_id").join(content, F.col("id") == F.col("doc_id")).drop("doc_id")
    call = "SELECT * FROM extract_artifacts(TABLE(SELECT * FROM {rows}) PARTITION BY data_source_id, extractor => '%s')"
    own, logs = (spark.sql(call % e, rows=rows) for e in ("lines", "logs"))
    counted = own.where("family = 'dropped'").groupBy("source_object_id", "family", "title", "n_bytes", "n_lines").agg(F.sum("dropped").alias("dropped"))
    return own.where("family <> 'dropped'").unionByName(counted).unionByName(logs.withColumn("n_bytes", F.lit(None).cast("long")))


_SURE = "CASE confidence WHEN 'direct' THEN 1.0 WHEN 'strong' THEN 0.9 WHEN 'weak' THEN 0.5 ELSE 0.0 END"


_ALL = _SNAPSHOT.replace("SELECT 'node' AS part", ", s AS (SELECT 'node' AS part", 1) + ")"


@query(
    _ALL
    + f""" SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY CASE WHEN part = 'node' THEN split_part(id, ':', 1) ELSE '' END, CASE WHEN part = 'node' THEN 0 ELSE {_SURE} END DESC,
    CASE WHEN part IN ('cluster', 'lead') THEN -support ELSE 0 END, CASE WHEN part = 'edge' THEN '' ELSE title END, id) - 1 AS position FROM s"""
)
def correlation_order(spark, d):
    rows = cor.correlation_snapshot(_more_artifacts(spark, d), files(spark, d), timeline_events(spark, d))
    return cor.in_order(rows).select("part", "id", "position")


_BY_SOURCE = _ALL + """, q AS (SELECT s.part, s.id AS own, CAST(f.data_source_id AS VARCHAR) AS src, s.a, s.b, s.title, s.confidence, s.support FROM s JOIN f ON f.id = CAST(CASE WHEN s.part = 'edge' THEN s.b WHEN starts_with(s.id, 'artifact:') THEN CAST(CAST(s.a AS BIGINT) % 1000000000 AS VARCHAR) ELSE s.a END AS BIGINT))"""


def _by_source(spark, d):
    """The snapshot's rows with the source of their file."""
    rows = cor.correlation_snapshot(_more_artifacts(spark, d), files(spark, d), timeline_events(spark, d))
    file_id = F.when(F.col("part") == "edge", F.col("b").cast("long")).when(F.col("id").startswith("artifact:"), F.col("a").cast("long") % 1_000_000_000).otherwise(F.col("a").cast("long"))
    sources = files(spark, d).select(F.col("id").alias("file_id"), "data_source_id")
    return rows.withColumn("file_id", file_id).join(sources, "file_id").drop("file_id")


@query(
    _BY_SOURCE
    + f""" SELECT part, concat(src, '/', own) AS id, CASE WHEN a IS NOT NULL THEN concat(src, '/', a) END AS a, CASE WHEN b IS NOT NULL THEN concat(src, '/', b) END AS b,
    row_number() OVER (PARTITION BY part ORDER BY CASE WHEN part = 'lead' THEN {_SURE} ELSE 0 END DESC, CASE WHEN part = 'lead' THEN -support ELSE 0 END, CASE WHEN part = 'lead' THEN title ELSE '' END, concat(src, '/', own)) - 1 AS position FROM q"""
)
def correlation_merged(spark, d):
    return cor.merged_snapshots(_by_source(spark, d)).select("part", "id", "a", "b", "position")


@query(_ALL + " SELECT count(*) FILTER (part = 'node') AS node_count, count(*) FILTER (part = 'edge') AS edge_count, count(*) FILTER (part = 'cluster') AS cluster_count, count(*) FILTER (part = 'lead') AS lead_count FROM s")
def correlation_merged_totals(spark, d):
    return cor.snapshot_totals(cor.merged_snapshots(_by_source(spark, d)))


@query("SELECT id, data_source_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY data_source_id ORDER BY created_at DESC, id) AS r FROM a) WHERE r <= 250")
def correlation_newest_inputs(spark, d):
    return cor.newest_inputs(artifacts(spark, d), 250, "created_at").select("id", "data_source_id", "created_at")
