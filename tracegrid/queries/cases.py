"""Queries over cases, content, correlation rules and hosts."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.classify import magic
from ..functions.digests import sm3_hex
from ..operators import artifacts as art, cases as ca, catalog as cat, content as co, correlation as cor, entities as en, hosts as ho, integrity as it, logs as lg, search as se, timeline as tl
from ..sources import sinks
from ..sources.adapters import artifacts, files, graph_nodes, read, timeline_events
from .registry import query
from .timeline import first_pages


@query("SELECT id, data_source_id, ts FROM t WHERE (ts, data_source_id, id) > (TIMESTAMP '2024-01-10 00:00:00', 2, 0) ORDER BY ts, data_source_id, id LIMIT 60")
def timeline_oldest_page(spark, d):
    return tl.oldest_page(timeline_events(spark, d), 60, (datetime(2024, 1, 10), 2, 0)).select("id", "data_source_id", "ts")


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'FILE_EXECUTED' ELSE 'REGISTRY_SYSTEM_SHUTDOWN' END AS event_type FROM t WHERE id % 4 IN (0, 1)")
def timeline_analysis_kinds(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("FILE_EXECUTED", "REGISTRY_SYSTEM_SHUTDOWN", "FILE_CREATED", "click"))), (F.col("id") % 4 + 1).cast("int"))
    return tl.supported(timeline_events(spark, d).withColumn("event_type", kinds), True).select("id", "event_type")


@query("SELECT id, source_object_id FROM t WHERE source_object_id IN (SELECT source_object_id FROM a)")
def timeline_of_objects(spark, d):
    return tl.of_objects(timeline_events(spark, d), artifacts(spark, d)).select("id", "source_object_id")


@query("SELECT id, path FROM f WHERE starts_with(lower(path), 'c:/src1/en/')")
def catalog_in_partition(spark, d):
    return cat.in_partition(files(spark, d), "c:", "SRC1/EN").select("id", "path")


_TREE = """, e AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN CASE WHEN doc_id % 50 = 49 THEN -doc_id ELSE doc_id // 3 END END AS parent_id FROM documents)"""


def _tree(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id AS id", "CASE WHEN doc_id > 0 THEN CASE WHEN doc_id % 50 = 49 THEN -doc_id ELSE doc_id div 3 END END AS parent_id")


@query(_TREE + " SELECT id, CAST(parent_id AS VARCHAR) AS parent_id FROM e WHERE parent_id NOT IN (SELECT id FROM e)")
def catalog_orphans(spark, d):
    return cat.orphans(_tree(spark, d)).select("id", "parent_id")


@query(_TREE + " SELECT id FROM e WHERE parent_id IS NULL")
def catalog_roots(spark, d):
    return cat.roots(_tree(spark, d)).select("id")


@query(
    _TREE
    + """, r AS (SELECT id FROM e WHERE parent_id IS NULL UNION ALL SELECT e.id FROM r JOIN e ON e.parent_id = r.id)
    SELECT (SELECT count(*) FROM e) AS entries, (SELECT count(*) FROM e WHERE parent_id NOT IN (SELECT id FROM e)) AS orphans, (SELECT count(DISTINCT id) FROM r) AS reachable"""
)
def catalog_reachability(spark, d):
    tree = _tree(spark, d)
    return cat.reachability(tree, cat.roots(tree))


@query(
    _TREE
    + """, r AS (SELECT id, id AS top FROM e WHERE id IN (0, 1, 2) UNION ALL SELECT e.id, CASE WHEN e.id IN (1, 2) THEN e.id ELSE r.top END FROM r JOIN e ON e.parent_id = r.id WHERE e.id NOT IN (0, 1, 2))
    SELECT DISTINCT id, concat('p', top) AS partition FROM r"""
)
def catalog_assign_subtrees(spark, d):
    tops = spark.createDataFrame([(0, "p0"), (1, "p1"), (2, "p2")], "id long, partition string")
    return cat.assign_subtrees(_tree(spark, d), tops)


@query("SELECT id, parent_id, id * 3 < (SELECT max(id) FROM g) AND EXISTS (SELECT 1 FROM g h WHERE h.parent_id = CAST(g.id AS VARCHAR)) AS has_directories FROM g WHERE parent_id = '1' ORDER BY CAST(id AS BIGINT)", relations="WITH g AS (SELECT doc_id AS id, CAST(doc_id // 3 AS VARCHAR) AS parent_id FROM documents WHERE doc_id % 2 = 1) ")
def catalog_tree_page(spark, d):
    tree = read(spark, d, "documents").selectExpr(
        "doc_id AS id", "CAST(doc_id div 3 AS STRING) AS parent_id", "concat('dir', doc_id) AS name", "CASE WHEN doc_id % 2 = 1 THEN 'Directory' ELSE 'File' END AS entry_type", "false AS hidden"
    )
    return cat.tree_page(tree, "1").select("id", "parent_id", "has_directories")


@query("SELECT id, path FROM f WHERE NOT starts_with(path, 'C:/src1/') UNION ALL SELECT id + 1000000, concat('C:/src1/new', id) FROM f WHERE starts_with(path, 'C:/src1/')")
def catalog_replace_subtree(spark, d):
    f = files(spark, d).select("id", "path")
    fresh = cat.under_prefix(f, "C:/src1/").selectExpr("id + 1000000 AS id", "concat('C:/src1/new', id) AS path")
    return cat.replace_subtree(f, fresh, "C:/src1")


@query("SELECT event_id AS id, event_type AS action, ts AS created_at FROM events WHERE user_id % 3 = 1 AND event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 40 OFFSET 10")
def case_audit_page(spark, d):
    log = read(spark, d, "events").selectExpr("event_id AS id", "user_id % 3 AS case_id", "event_type AS action", "ts AS created_at")
    return ca.audit_filter(log, 1, "click", 40, 10).select("id", "action", "created_at")


@query("SELECT event_type AS action, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def case_audit_counts(spark, d):
    return ca.audit_counts(read(spark, d, "events").selectExpr("event_type AS action"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'F'")
def case_steps(spark, d):
    steps = read(spark, d, "orders").selectExpr("o_orderkey AS id", "substr(o_orderpriority, 1, 1) AS kind", "o_orderstatus = 'F' AS success")
    return ca.step_filter(steps, "1", True).select("id")


@query("SELECT o_custkey % 50 AS batch_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F FROM orders GROUP BY 1")
def case_batch_counts(spark, d):
    return ca.batch_counts(read(spark, d, "orders").selectExpr("o_custkey % 50 AS batch_id", "o_orderstatus AS status"), ["O", "F"])


@query("SELECT doc_id AS id FROM documents WHERE source = 'src1' AND md5(lang) = md5('en') ORDER BY doc_id % 3, doc_id LIMIT 100")
def case_recovered_by_hash(spark, d):
    docs = read(spark, d, "documents")
    scans = spark.range(3).selectExpr("id", "id AS partition_index").crossJoin(F.broadcast(spark.createDataFrame([("src1",)], "data_source_id string")))
    rows = docs.where("source = 'src1'").selectExpr("doc_id AS id", "doc_id % 3 AS scan_id", "cast(doc_id AS string) AS inode", "md5(lang) AS md5")
    return ca.recovered_by_hash(rows, scans, "src1", "md5", "9cfefed8fb9497baa5cd519d7d2bb5d7").select("id")


@query("SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 3 = 0) AS members FROM nation")
def case_scope_members(spark, d):
    scopes = read(spark, d, "nation").selectExpr("n_nationkey AS id", "n_name AS name")
    return ca.scope_members(scopes, read(spark, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_nationkey AS scope_id"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 7")
def case_sources_of_scope(spark, d):
    customers = read(spark, d, "customer")
    return ca.sources_of_scope(customers.selectExpr("c_custkey AS id", "c_name AS name"), customers.selectExpr("c_custkey AS source_id", "c_nationkey AS scope_id"), 7)


@query("SELECT c_custkey AS id, count(o_orderkey) AS notes, max_by(o_orderpriority, (o_orderdate, o_orderpriority)) AS last_note FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def case_annotations(spark, d):
    notes = read(spark, d, "orders").selectExpr("o_custkey AS id", "o_orderdate AS noted_at", "o_orderpriority AS note")
    return ca.annotated_counts(read(spark, d, "customer").selectExpr("c_custkey AS id"), notes, "id")


@query("SELECT id, label FROM nodes WHERE node_type = 'supplier' AND id > 's:1' ORDER BY id LIMIT 30")
def graph_nodes_page(spark, d):
    return ca.nodes_page(graph_nodes(spark, d), "supplier", "s:1", 30).select("id", "label")


@query("SELECT id FROM a WHERE id % 3 = 1 AND id % 2 = 0")
def case_host_configs(spark, d):
    attrs = F.expr("concat('{\"configKind\":\"k', id % 3, '\"', CASE WHEN id % 2 = 1 THEN ',\"overlayContext\":\"x\"' ELSE '' END, '}')")
    return ca.host_configs(artifacts(spark, d).withColumn("attrs", attrs), "k1").select("id")


@query(
    """SELECT id, data_source_id, ts AS event_time, CASE WHEN id % 2 = 0 THEN 'UTC' ELSE 'assumed' END AS timezone, concat('d', id) AS raw_digest, 'parsed' AS completeness
    FROM (SELECT *, row_number() OVER (PARTITION BY data_source_id ORDER BY ts DESC, id) AS r FROM t) WHERE r <= 70 ORDER BY ts DESC, id LIMIT 50 OFFSET 20"""
)
def case_evidence_events(spark, d):
    attrs = F.expr("concat('{\"', CASE WHEN id % 2 = 0 THEN 'timezone\":\"UTC' ELSE 'tzAssumed\":\"assumed' END, '\",\"contentDigest\":\"d', id, '\"}')")
    return ca.evidence_events(timeline_events(spark, d).withColumn("attrs", attrs).withColumnRenamed("ts", "event_time"), 50, 20)


def _hits(spark, d):
    hits = artifacts(spark, d).selectExpr("id", "data_source_id", "CAST(id % 97 AS DOUBLE) AS score")
    sources = spark.range(5).selectExpr("id AS data_source_id", "CASE WHEN id = 2 THEN 'building' ELSE 'ready' END AS status")
    return ca.case_search(hits, sources, 40, after=(90.0, 500))


_HITS = ", h AS (SELECT id, data_source_id, CAST(id % 97 AS DOUBLE) AS score FROM a WHERE data_source_id <> 2)"


@query(_HITS + " SELECT * FROM h WHERE score < 90 OR (score = 90 AND id > 500) ORDER BY score DESC, id LIMIT 40")
def search_case_page(spark, d):
    return _hits(spark, d)[0].select("id", "data_source_id", "score")


@query(_HITS + " SELECT CAST(i AS BIGINT) AS data_source_id, CASE WHEN i = 2 THEN 'building' ELSE 'ready' END AS status, (SELECT count(*) FROM h WHERE data_source_id = i) AS hits FROM range(5) r(i)")
def search_case_coverage(spark, d):
    return _hits(spark, d)[1]


@query("SELECT id, name FROM f WHERE contains(lower(name), 'doc1') ORDER BY lower(name), id LIMIT 100")
def search_wide_names(spark, d):
    """Full-width letters and digits in names and in the query are the plain ones."""
    wide = F.translate("name", "Doc0123456789", "\uff24\uff4f\uff43" + "".join(chr(0xFF10 + i) for i in range(10)))
    found = se.search(files(spark, d).withColumn("plain", F.col("name")).withColumn("name", wide), se.SearchRequest("\uff44oc\uff11", fields=("name",)), limit=10**6)
    return found.select("id", F.col("plain").alias("name")).orderBy(F.lower("name"), "id").limit(100)


@query(
    """, s AS (SELECT scope_key, pos, event_id, sha256('leaf:' || CAST(event_id AS VARCHAR)) AS h FROM
      (SELECT user_id % 5 AS scope_key, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS pos FROM events)),
    b AS (SELECT concat(scope_key, '/', pos // 4) AS batch_key, min(event_id) AS first, max(event_id) AS last, count(*) AS n,
      max(CASE WHEN pos % 4 = 0 THEN h END) AS h0, max(CASE WHEN pos % 4 = 1 THEN h END) AS h1, max(CASE WHEN pos % 4 = 2 THEN h END) AS h2, max(CASE WHEN pos % 4 = 3 THEN h END) AS h3 FROM s GROUP BY 1)
    SELECT batch_key, first, last, n, sha256('node:' || sha256('node:' || h0 || h1) || sha256('node:' || h2 || h3)) AS root FROM b WHERE n = 4"""
)
def integrity_batches(spark, d):
    rows = read(spark, d, "events").selectExpr("user_id % 5 AS scope_key", "event_id AS sequence", "event_id AS data")
    return ca.ledger_batches(rows, 4)


@query(
    """, s AS (SELECT user_id % 5 AS k, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS pos FROM events)
    SELECT DISTINCT concat(k, '/', pos // 4) AS batch_key FROM s WHERE event_id % 101 = 7 AND pos // 4 < (SELECT count(*) FROM s s2 WHERE s2.k = s.k) // 4"""
)
def integrity_broken_batches(spark, d):
    rows = read(spark, d, "events").selectExpr("user_id % 5 AS scope_key", "event_id AS sequence", "event_id AS data")
    changed = rows.withColumn("data", F.when(F.col("sequence") % 101 == 7, -1).otherwise(F.col("data")))
    return ca.broken_batches(ca.ledger_batches(rows, 4), changed, 4)


@query(" SELECT CAST(ceil(log2(count(*))) AS INTEGER) AS levels, true AS leads_to_root FROM events", relations="")
def integrity_proof(spark, d):
    """The proof of the sixth of all events: its length, and whether it leads to the root."""
    rows = it.numbered(read(spark, d, "events").selectExpr("0 AS scope", "event_id"), "scope", "event_id")
    leaves = rows.select(F.col("scope").alias("scope_key"), "at", F.col("event_id").alias("data"))
    proof = it.merkle_proof(it.merkle_levels(leaves), 0, 5)
    steps = proof.agg(F.array_sort(F.collect_list(F.struct("level", "hash", "on_left"))).alias("steps"))
    start = leaves.where("at = 5").select(F.sha2(F.concat(F.lit("leaf:"), F.col("data").cast("string")), 256).alias("leaf"))
    up = F.expr("aggregate(steps, leaf, (h, s) -> sha2(concat('node:', if(s.on_left, s.hash, h), if(s.on_left, h, s.hash)), 256))")
    reached = steps.crossJoin(start).select(F.size("steps").alias("levels"), up.alias("hash"))
    return reached.crossJoin(it.merkle_roots(leaves)).select("levels", (F.col("hash") == F.col("root")).alias("leads_to_root"))


_GROUPS = {"urgent": ["1-URGENT", "2-HIGH"], "rest": ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "none": ["9-NONE"]}


@query(
    """, g AS (SELECT CASE WHEN family IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE 'rest' END AS summary, created_at FROM a)
    SELECT summary, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM g GROUP BY 1 UNION ALL SELECT 'none', 0, NULL, NULL"""
)
def case_family_summary(spark, d):
    return ca.family_summary(artifacts(spark, d), _GROUPS)


@query(
    """SELECT family, id, created_at, CAST(r AS INTEGER) AS r, total FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY created_at DESC, id) AS r, count(*) OVER (PARTITION BY family) AS total FROM a) WHERE r <= 10"""
)
def case_summary_pages(spark, d):
    return ca.summary_pages(artifacts(spark, d), 10)


@query(
    """, k AS (SELECT event_id % 7 AS k FROM events)
    SELECT count(*) FILTER (k = 0) AS boot, count(*) FILTER (k IN (1, 2)) AS logon, count(*) FILTER (k = 3) AS process, count(*) FILTER (k IN (4, 5)) AS account, count(*) FILTER (k = 6) AS application, count(*) AS all_views FROM k"""
)
def case_event_totals(spark, d):
    kinds = ["bootShutdown", "logonLogoff", "privilegeEscalation", "processExecution", "accountManagement", "scheduledTask", "application"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 7 + 1).cast("int"))
    return ca.event_totals(read(spark, d, "events").select(kind.alias("kind")))


@query(
    """SELECT doc_id // 16 AS id, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n, max(doc_id) - min(doc_id) + 1 - count(*) AS gaps, string_agg(lang, '' ORDER BY doc_id) AS joined
    FROM documents WHERE doc_id % 5 <> 2 GROUP BY 1"""
)
def case_ordered_text(spark, d):
    rows = read(spark, d, "documents").where("doc_id % 5 <> 2").selectExpr("doc_id div 16 AS id", "doc_id AS at", "lang")
    return ca.ordered_text(rows, "id", "at", "lang")


def _contents(spark, d):
    """Documents as files in four encodings, of which the last is none."""
    made = F.expr("CASE doc_id % 4 WHEN 0 THEN encode(text, 'UTF-8') WHEN 1 THEN concat(X'FFFE', encode(text, 'UTF-16LE')) WHEN 2 THEN X'00010203' ELSE concat(encode(text, 'UTF-8'), X'FFFE41') END")
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), made.alias("content"), F.lit(None).cast("string").alias("mime"), "text")


@query(
    """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'text_utf8' WHEN 1 THEN 'text_utf16le' WHEN 2 THEN 'binary' ELSE 'unsupported_encoding' END AS content_kind,
    CASE WHEN doc_id % 4 < 2 THEN md5(text) END AS digest FROM documents"""
)
def content_text(spark, d):
    return co.extract_text(_contents(spark, d)).select("id", "content_kind", F.md5("text").alias("digest"))


@query("SELECT doc_id AS id, text[:40] AS preview, len(text) > 40 AS truncated FROM documents WHERE lang = 'en' AND regexp_full_match(text, '[ -~\\s]*')")
def content_preview(spark, d):
    docs = read(spark, d, "documents").where(r"lang = 'en' AND text RLIKE '^[ -~\\s]*$'")
    return co.text_preview(docs.select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content")), 40)


@query(
    """SELECT id, CAST((len(x) - len(replace(x, 'tion', ''))) // 4 AS INTEGER) AS hits, CAST(instr(x, 'tion') - 1 AS INTEGER) AS first
    FROM (SELECT doc_id AS id, text AS x FROM documents WHERE regexp_full_match(text, '[ -~\\s]*')) WHERE contains(x, 'tion')"""
)
def content_byte_pattern(spark, d):
    docs = read(spark, d, "documents").where(r"text RLIKE '^[ -~\\s]*$'").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))
    found = co.byte_pattern(docs, b"tion", 10**9)
    return found.select("id", F.size("offsets").alias("hits"), F.get("offsets", F.lit(0)).alias("first"))


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'PNG' WHEN 1 THEN 'PDF' END AS file_type FROM documents")
def content_magic(spark, d):
    header = F.expr("CASE doc_id % 3 WHEN 0 THEN concat(X'89504E470D0A1A0A', encode(text, 'UTF-8')) WHEN 1 THEN encode(concat('%PDF-1.7 ', text), 'UTF-8') ELSE encode(concat('~~', text), 'UTF-8') END")
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), magic(header, F.lit("")).file_type.alias("file_type"))


@query("SELECT lang AS text, CASE WHEN lang = 'abc' THEN '' END AS wrong FROM (SELECT DISTINCT lang FROM documents)")
def function_sm3(spark, d):
    """The digest of ``abc`` is the published one; other texts differ from it."""
    langs = read(spark, d, "documents").select("lang").distinct()
    published = "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0"
    known = sm3_hex(F.encode(F.lit("abc"), "UTF-8")) == published
    return langs.select(F.col("lang").alias("text"), F.when(~known | (sm3_hex(F.encode("lang", "UTF-8")) == published), "wrong").alias("wrong"))


@query("SELECT doc_id AS id, 2 AS line_number, 'x = base64_decode(y)' AS evidence FROM documents WHERE doc_id % 9 = 0")
def log_web_shells(spark, d):
    made = F.expr("concat('plain ', doc_id, CASE WHEN doc_id % 9 = 0 THEN '\n  x = base64_decode(y)' ELSE '\nnothing' END)")
    return lg.web_shells(read(spark, d, "documents").select(F.col("doc_id").alias("id"), made.alias("content")))


@query("SELECT doc_id AS line_number, 'Mon Jan 01 10:00:00 2024' AS time_text, CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'warn' END AS severity FROM documents")
def log_web_errors(spark, d):
    line = F.expr("concat('[Mon Jan 01 10:00:00 2024] [', CASE WHEN doc_id % 2 = 0 THEN 'core:error' ELSE 'warn' END, '] file ', doc_id)")
    return lg.parse_error(read(spark, d, "documents").select(F.col("doc_id").alias("line_number"), line.alias("line"))).select("line_number", "time_text", "severity")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'LogonSuccess' WHEN 1 THEN 'EventLogStarted' END AS kind FROM events WHERE event_id % 3 < 2")
def host_event_kinds(spark, d):
    rows = read(spark, d, "events").selectExpr("event_id AS id", "CASE event_id % 3 WHEN 0 THEN 4624 WHEN 1 THEN 6005 ELSE 4624 END AS event_id", "'x' AS provider", "CASE WHEN event_id % 3 = 0 THEN 'Security' ELSE 'other' END AS channel")
    return ho.classified_events(rows).select("id", "kind")


@query("SELECT concat('/etc/', doc_id) AS path, CASE doc_id % 3 WHEN 0 THEN 'address' WHEN 1 THEN 'nameserver' ELSE 'gateway' END AS fact, concat('10.0.', doc_id % 250, '.1') AS value FROM documents")
def host_network_facts(spark, d):
    line = F.expr("concat(CASE doc_id % 3 WHEN 0 THEN ' address ' WHEN 1 THEN 'nameserver ' ELSE 'GATEWAY=' END, '10.0.', doc_id % 250, '.1')")
    rows = read(spark, d, "documents").select(F.concat(F.lit("/etc/"), "doc_id").alias("path"), F.lit(1).alias("line_number"), line.alias("line"))
    return ho.network_facts(rows).select("path", "fact", "value")


@query("SELECT doc_id // 6 AS file_id, CAST(min(doc_id) AS BIGINT) AS site, concat('h', doc_id // 6, '.org') AS server_names FROM documents GROUP BY doc_id // 6 HAVING count(*) = 6")
def host_sites(spark, d):
    docs = read(spark, d, "documents")
    full = docs.groupBy(F.expr("doc_id div 6").alias("k")).agg(F.count("*").alias("n")).where("n = 6").select("k")
    line = F.expr("CASE doc_id % 6 WHEN 0 THEN 'server {' WHEN 1 THEN concat('  server_name h', doc_id div 6, '.org;') WHEN 2 THEN 'location / {' WHEN 3 THEN '} # x' WHEN 4 THEN 'listen 80;' ELSE '}' END")
    rows = docs.select(F.expr("doc_id div 6").alias("file_id"), F.col("doc_id").alias("line_number"), line.alias("line"))
    return ho.nginx_sites(rows.join(full.withColumnRenamed("k", "file_id"), "file_id")).select("file_id", F.col("site").cast("long").alias("site"), "server_names")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 IN (0, 1, 2)")
def host_topology(spark, d):
    rows = [("derivedFrom", "artifact", "fileSystem"), ("produces", "pod", "report"), ("supportedBy", "finding", "artifact"), ("hosts", "pod", "pve")]
    pick = F.element_at(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("relation", "source_kind", "target_kind"), strict=True))) for r in rows)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return ho.allowed_relations(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), pick.alias("x")).select("id", "x.*")).select("id")


@query("SELECT id FROM a WHERE kind = 'O' AND contains(lower(title), 'order 7') ORDER BY id LIMIT 21")
def host_carved_search(spark, d):
    rows = artifacts(spark, d).withColumn("family", F.concat(F.lit("carving."), "kind")).where("kind = 'O'").withColumn("attrs", F.lit("{}"))
    return ho.carved_search(rows, "ORDER 7", limit=20).select("id")


@query("SELECT id FROM a WHERE kind = 'O' AND family = '1-URGENT' AND (contains(lower(title), '5') OR contains('body', '5'))")
def host_notebook(spark, d):
    notes = artifacts(spark, d).selectExpr("id", "kind AS entry_type", "family AS status", "title", "'body' AS body", "array('a', 'b') AS tags")
    return ho.notebook_filter(notes, "O", "1-URGENT", "5", "b").select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def host_unreferenced(spark, d):
    objects = read(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN 'ready' ELSE 'open' END AS status")
    return ho.unreferenced(objects, read(spark, d, "orders").where("o_orderstatus = 'P'").selectExpr("o_custkey AS object_id")).select("id")


def _rule_artifacts(spark, d):
    """Each file is pointed to by an artifact whose type goes with its id."""
    shown = F.translate("path", "/", "\\")
    quoted = lambda c: F.regexp_replace(c, r"\\", r"\\\\\\\\")
    attrs = (
        F.when(F.col("id") % 6 == 0, F.concat(F.lit('{"target_path":"'), quoted(shown), F.lit('"}')))
        .when(F.col("id") % 6 == 1, F.concat(F.lit('{"command":"/'), F.regexp_replace("path", "^C:/", ""), F.lit(' --all"}')))
        .when(F.col("id") % 6 == 2, F.concat(F.lit('{"attachments":["'), F.col("name"), F.lit('","none.zip"]}')))
        .when(F.col("id") % 6 == 3, F.concat(F.lit('{"data":"run '), quoted(shown), F.lit(' /s"}')))
        .when(F.col("id") % 6 == 4, F.concat(F.lit('{"accessLogs":["'), F.col("path"), F.lit('"],"errorLogs":[]}')))
        .otherwise(F.concat(F.lit('{"executable":"'), F.col("name"), F.lit('"}')))
    )
    kinds = F.array(*map(F.lit, ("LNK", "LinuxSudoEvent", "EmailMessage", "RegistryValue", "LinuxWebSite", "Prefetch")))
    return files(spark, d).select(F.col("id").alias("id"), F.element_at(kinds, (F.col("id") % 6 + 1).cast("int")).alias("artifact_type"), attrs.alias("attrs"))


_RULES = """, m AS (SELECT id AS artifact_id, id AS file_id, CASE WHEN id % 6 IN (2, 5) THEN 'name_match' ELSE 'path_match' END AS kind,
  CASE id % 6 WHEN 0 THEN 'direct' WHEN 2 THEN 'weak' ELSE 'strong' END AS confidence FROM f)"""


@query(_RULES + " SELECT * FROM m")
def correlation_rule_matches(spark, d):
    return cor.rule_matches(_rule_artifacts(spark, d), files(spark, d))


@query(
    _RULES
    + """, e AS (SELECT source_object_id AS file_id, count(*) AS events FROM t GROUP BY 1)
    SELECT m.file_id, 1::BIGINT AS matches, 1::BIGINT AS artifacts, coalesce(events, 0) AS events,
      CASE WHEN kind = 'path_match' THEN 'direct' WHEN events > 0 OR confidence = 'strong' THEN 'strong' ELSE 'weak' END AS confidence FROM m LEFT JOIN e ON e.file_id = m.file_id"""
)
def correlation_rule_groups(spark, d):
    return cor.rule_groups(cor.rule_matches(_rule_artifacts(spark, d), files(spark, d)), timeline_events(spark, d))


@query(
    _RULES
    + """, e AS (SELECT source_object_id AS file_id, count(*) AS events FROM t GROUP BY 1),
    x AS (SELECT m.*, path, coalesce(events, 0) AS events FROM m JOIN f ON f.id = m.file_id LEFT JOIN e ON e.file_id = m.file_id)
    SELECT 'node' AS part, count(*) * 2 AS n, CAST(sum(2) AS BIGINT) AS support FROM x UNION ALL SELECT 'edge', count(*), count(*) FROM x
    UNION ALL SELECT 'lead', count(*), CAST(sum(1 + events) AS BIGINT) FROM x"""
)
def correlation_snapshot_parts(spark, d):
    rows = cor.correlation_snapshot(_rule_artifacts(spark, d), files(spark, d), timeline_events(spark, d))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("support").alias("support"))


def _people(spark, d):
    """Persons, devices, artifacts and files over customers, suppliers and orders."""
    customers, suppliers = read(spark, d, "customer"), read(spark, d, "supplier")
    none = "CAST(NULL AS STRING)"
    nodes = (
        customers.selectExpr("concat('c', c_custkey) AS id", "'entity' AS node_type", "array('entity', 'person') AS tags", f"{none} AS label")
        .unionAll(suppliers.selectExpr("concat('s', s_suppkey)", "'entity'", "array('entity', 'device')", none))
        .unionAll(customers.selectExpr("concat('a', c_custkey)", "'artifact'", "array(CASE c_custkey % 4 WHEN 0 THEN 'Registry' WHEN 1 THEN 'x' WHEN 2 THEN 'Prefetch' ELSE 'EmailMessage' END)", "CASE WHEN c_custkey % 4 = 1 THEN 'var WTMP' ELSE 'y' END"))
        .unionAll(customers.selectExpr("concat('f', c_custkey)", "'file'", "array('file')", none))
    )
    edges = (
        customers.selectExpr("concat('e1:', c_custkey) AS id", "concat('c', c_custkey) AS source_id", "concat('a', c_custkey) AS target_id", "'derives_from' AS edge_type")
        .unionAll(customers.selectExpr("concat('e2:', c_custkey)", "concat('a', c_custkey)", "concat('f', c_custkey)", "'references'"))
        .unionAll(customers.selectExpr("concat('e3:', c_custkey)", "CASE WHEN c_custkey % 2 = 0 THEN concat('f', c_custkey) ELSE 's1' END", "CASE WHEN c_custkey % 2 = 0 THEN 's1' ELSE concat('f', c_custkey) END", "'links'"))
        .unionAll(customers.where("c_custkey % 4 = 3").selectExpr("concat('m1:', c_custkey)", "concat('c', c_custkey)", "concat('a', c_custkey)", "'correlates_with'"))
        .unionAll(customers.where("c_custkey % 4 = 3").selectExpr("concat('m2:', c_custkey)", "concat('c', c_custkey - 1)", "concat('a', c_custkey)", "'correlates_with'"))
    )
    return nodes, edges


@query(
    """, x AS (SELECT c_custkey AS k, concat('c', c_custkey) AS c FROM customer)
    SELECT c AS src, 's1' AS dst, CASE k % 4 WHEN 0 THEN 'owns' ELSE 'logged_into' END AS relation, concat('e1:', k, ',e2:', k, ',e3:', k) AS evidence, 0.95::DOUBLE AS confidence FROM x WHERE k % 4 IN (0, 1)
    UNION ALL SELECT c, concat('f', k), 'executed', concat('e1:', k, ',e2:', k), 0.85 FROM x WHERE k % 4 = 2
    UNION ALL SELECT least(c, concat('c', k - 1)), greatest(c, concat('c', k - 1)), 'communicates_with', concat('m1:', k, ',m2:', k), 0.85 FROM x WHERE k % 4 = 3"""
)
def entity_inferred_relations(spark, d):
    return en.inferred_relations(*_people(spark, d))


@query("SELECT id, path FROM f WHERE id = 57")
def catalog_point(spark, d):
    return cat.point(files(spark, d), 57).select("id", "path")


@query("SELECT id, path FROM f WHERE id IN (SELECT c_custkey FROM customer)")
def catalog_of_ids(spark, d):
    return cat.of_ids(files(spark, d), read(spark, d, "customer").selectExpr("c_custkey AS id")).select("id", "path")


@query("SELECT doc_id AS id FROM documents WHERE md5(lang) = md5('de')")
def catalog_with_hash(spark, d):
    rows = read(spark, d, "documents").selectExpr("doc_id AS id", "upper(md5(lang)) AS md5")
    return cat.with_hash(rows, "md5", "5F02F0889301FD7BE1AC972C11BF3E7D").select("id")


@query("SELECT id, encrypted FROM f WHERE NOT coalesce(encrypted, false)")
def catalog_without(spark, d):
    """Rows after a deletion by a predicate; unknown values stay."""
    return cat.without(files(spark, d), F.col("encrypted")).select("id", "encrypted")


@query("SELECT id, path FROM f WHERE id % 29 = 0 AND id >= 0")
def catalog_directories(spark, d):
    return files(spark, d).where("entry_type = 'Directory'").select("id", "path")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND o_custkey % 7 = 3")
def artifact_facts(spark, d):
    rows = read(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS family", "o_orderstatus AS kind", "concat('f', o_custkey % 7) AS field", "o_totalprice AS value")
    return art.facts(rows, "1-URGENT", "O", "f3").select("id")


@query("SELECT id, source_object_id FROM a WHERE source_object_id IN (SELECT source_object_id FROM t)")
def artifact_of_objects(spark, d):
    return art.of_objects(artifacts(spark, d), timeline_events(spark, d)).select("id", "source_object_id")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN concat('new ', id) ELSE name END AS name FROM f UNION ALL SELECT id + 1000000, concat('new ', id + 1000000) FROM f WHERE id % 3 = 1")
def sink_upsert(spark, d):
    f = files(spark, d).select("id", "name")
    fresh = f.where("id % 3 = 0").select("id").unionAll(f.where("id % 3 = 1").selectExpr("id + 1000000"))
    fresh = fresh.select("id", F.concat(F.lit("new "), "id").alias("name"))
    return sinks.upsert(f, fresh.unionAll(fresh.withColumn("name", F.concat(F.lit("a "), "name"))), ["id"])


@query("SELECT id, concat('mail.', id % 5) AS parser_id FROM f WHERE id % 5 <> 2 UNION ALL SELECT id, 'mail.2' FROM f WHERE id % 10 = 1")
def sink_replace_producer(spark, d):
    rows = files(spark, d).select("id", F.concat(F.lit("mail."), F.col("id") % 5).alias("parser_id"))
    return sinks.replace_producer(rows, rows.where("id % 10 = 1").withColumn("parser_id", F.lit("mail.2")), "mail.2")


@query(
    """, l AS (SELECT concat('lead:', id, ':', id) AS id, CAST(id AS VARCHAR) AS source_id, id AS target_id, CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM f)
    SELECT * FROM l"""
)
def correlation_lead_edges(spark, d):
    leads = files(spark, d).selectExpr("CAST(id AS STRING) AS artifact_id", "id AS file_id", "CASE WHEN id % 2 = 0 THEN 'strong' ELSE 'weak' END AS confidence")
    return cor.lead_edges(leads.unionAll(leads.withColumn("confidence", F.lit("heuristic"))))


@query("SELECT 7::BIGINT AS families, 5::BIGINT AS with_leads, (SELECT count(*) FROM f WHERE id % 2 = 0)::BIGINT AS high, 'passed' AS gate")
def correlation_coverage_gate(spark, d):
    leads = files(spark, d).selectExpr("concat('family', id % 5) AS family", "CASE WHEN id % 2 = 0 THEN 'strong' ELSE 'weak' END AS confidence", "false AS caveat")
    return cor.coverage_gate(cor.family_coverage(leads, spark.range(7).selectExpr("concat('family', id) AS family")))


@query("SELECT id, 'my ' || name || ' end' AS snippet FROM f WHERE contains(lower(name), 'doc1')")
def search_snippets(spark, d):
    rows = files(spark, d).where(F.lower("name").contains("doc1")).withColumn("content", F.concat(F.lit("my "), "name", F.lit(" end")))
    return se.with_snippets(rows, "DOC1").select("id", F.get("snippets", F.lit(0)).alias("snippet"))


@query("SELECT id, lower(name) AS sort_key, CAST((row_number() OVER (ORDER BY lower(name), id) - 1) // 40 AS INTEGER) AS page FROM f WHERE contains(lower(name), 'doc') ORDER BY 2, 1 LIMIT 160")
def search_cursor_pages(spark, d):
    request = se.SearchRequest("doc", fields=("name",))
    return first_pages(lambda page: se.read_search(files(spark, d), request, page, "r1"), 40, 4).select("id", "sort_key", "page")


@query(_HITS + " SELECT id, data_source_id, score, CAST((row_number() OVER (ORDER BY score DESC, id) - 1) // 60 AS INTEGER) AS page FROM h ORDER BY score DESC, id LIMIT 300")
def search_case_cursor_pages(spark, d):
    hits = artifacts(spark, d).selectExpr("id", "data_source_id", "CAST(id % 97 AS DOUBLE) AS score")
    sources = spark.range(5).selectExpr("id AS data_source_id", "CASE WHEN id = 2 THEN 'building' ELSE 'ready' END AS status")
    return first_pages(lambda page: ca.read_case_search(hits, sources, "order", page, "r1"), 60, 5).select("id", "data_source_id", "score", "page")
