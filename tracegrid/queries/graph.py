"""Graph, entity and rule queries."""

from pyspark.sql import functions as F

from ..operators import entities as en, graph as gr, rules as ru
from ..sources.adapters import files, graph_edges, graph_nodes
from .registry import query


@query("SELECT edge_id, e.to_id AS to_id, label FROM (SELECT id AS edge_id, source_id AS at_id, target_id AS to_id FROM edges UNION ALL SELECT id, target_id, source_id FROM edges) e JOIN nodes n ON n.id = e.to_id WHERE at_id = 'n:3'")
def graph_neighbors(spark, d):
    found = gr.neighbors(graph_nodes(spark, d), graph_edges(spark, d), "n:3")
    return found.select("edge_id", F.col("to").alias("to_id"), "label")


@query("SELECT id AS edge_id, target_id AS to_id FROM edges WHERE source_id = 'n:3' AND edge_type IN ('owns') AND coalesce(confidence, 0) >= 0.5")
def graph_neighbors_filtered(spark, d):
    found = gr.neighbors(graph_nodes(spark, d), graph_edges(spark, d), "n:3", "out", ["owns"], 0.5)
    return found.select("edge_id", F.col("to").alias("to_id"))


@query(
    """, w AS (SELECT 'r:1' AS id, 0 AS depth UNION SELECT e.target_id, w.depth + 1 FROM w JOIN edges e ON e.source_id = w.id WHERE w.depth < 3)
    SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id"""
)
def graph_walk(spark, d):
    edges = graph_edges(spark, d)
    return gr.walk(edges, spark.createDataFrame([("r:1",)], "id string"), 3)


@query(
    """, b AS (SELECT source_id AS x, target_id AS y FROM edges UNION SELECT target_id, source_id FROM edges),
    w AS (SELECT 's:1' AS id, 0 AS depth UNION SELECT b.y, w.depth + 1 FROM w JOIN b ON b.x = w.id WHERE w.depth < 2),
    m AS (SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id)
    SELECT id, depth, (SELECT count(*) FROM m) > 500 AS truncated FROM m ORDER BY depth, id LIMIT 500"""
)
def graph_case_walk(spark, d):
    return gr.case_walk(graph_edges(spark, d), spark.createDataFrame([("s:1",)], "id string"), 2)


@query("SELECT 'node' AS what, node_type AS type, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2")
def graph_snapshot(spark, d):
    return gr.snapshot(graph_nodes(spark, d), graph_edges(spark, d))


@query("SELECT n AS nodes, e AS edges, round(2.0 * e / (CAST(n AS DOUBLE) * (n - 1)), 9) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS e FROM edges)")
def graph_density(spark, d):
    return gr.density(graph_nodes(spark, d), graph_edges(spark, d)).withColumn("density", F.round("density", 9))


@query("SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges) GROUP BY id")
def graph_degrees(spark, d):
    return gr.degrees(graph_edges(spark, d))


@query("SELECT id, edge_type FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE node_type <> 'customer') AND target_id IN (SELECT id FROM nodes WHERE node_type <> 'customer')")
def graph_edges_among(spark, d):
    return gr.edges_among(graph_edges(spark, d), graph_nodes(spark, d).where("node_type <> 'customer'")).select("id", "edge_type")


@query(
    """SELECT edge_id, concat(edge_id, '-', i) AS rule_id, concat('signal', i) AS signal FROM (SELECT id AS edge_id FROM edges WHERE edge_type = 'owns'), (VALUES (0), (1)) v(i)
    UNION ALL SELECT id, concat(id, '-0'), NULL FROM edges WHERE edge_type = 'communicates_with'"""
)
def graph_provenance(spark, d):
    edges = graph_edges(spark, d).where("edge_type IN ('owns', 'communicates_with')")
    provenance = F.when(F.col("edge_type") == "owns", F.lit('{"match_signals":["signal0","signal1"]}')).otherwise("{}")
    return gr.provenance_rows(edges.withColumn("provenance", provenance))


@query("SELECT concat('contains:', id) AS id, parent_id AS source_id, CAST(id AS VARCHAR) AS target_id, 'contains' AS edge_type FROM f")
def graph_containment(spark, d):
    return gr.containment(files(spark, d))


@query(
    """, e AS (SELECT DISTINCT conv_id, turn FROM conversations),
    i AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM e),
    w AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, island) AS root FROM i)
    SELECT concat(conv_id, ':', turn) AS id, concat(conv_id, ':', root) AS root_id, CAST(turn - root AS INTEGER) AS depth FROM w WHERE turn - root <= 64"""
)
def graph_thread(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return gr.threads(rows.selectExpr("concat(conv_id, ':', turn) AS id", "concat(conv_id, ':', turn - 1) AS parent_id"))


_ENTITIES = "(SELECT id, node_type AS entity_type, lower(trim(regexp_replace(label, '#.*', ''))) AS canonical, label FROM nodes)"


@query(
    f"""SELECT canonical, entity_type, count(*) AS sources, min(id) AS first_id, string_agg(DISTINCT shown, '|' ORDER BY shown) AS labels,
    CASE WHEN count(*) = 1 THEN 0.70 WHEN count(*) = 2 THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence
    FROM (SELECT id, node_type AS entity_type, lower(regexp_replace(label, '[0-9]{{4}}$', '')) AS canonical, regexp_replace(label, '[0-9]{{4}}$', '') AS shown FROM nodes) GROUP BY 1, 2"""
)
def entity_merge(spark, d):
    nodes = graph_nodes(spark, d).select("id", F.regexp_replace("label", "[0-9]{4}$", "").alias("label"), F.col("node_type").alias("entity_type"))
    prefixed = nodes.withColumn("label", F.concat(F.lit(" "), "label", F.lit(" ")))
    merged = en.merge_entities(prefixed, ascii_only=True)
    return merged.withColumn("labels", F.regexp_replace(F.trim("labels"), r" \| ", "|"))


@query(
    """, a1 AS (SELECT DISTINCT source_id AS src, target_id AS mid FROM edges WHERE edge_type = 'owns'),
    b1 AS (SELECT DISTINCT source_id AS mid, target_id AS dst FROM edges WHERE edge_type = 'communicates_with')
    SELECT src, dst, 'reaches' AS relation, count(*) AS evidence, CASE WHEN count(*) = 1 THEN 0.70 WHEN count(*) = 2 THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence
    FROM a1 JOIN b1 USING (mid) WHERE src <> dst GROUP BY 1, 2"""
)
def entity_relations(spark, d):
    return en.two_hop_relations(graph_edges(spark, d), "owns", "communicates_with", "reaches")


@query("SELECT source_id AS target_id, count(DISTINCT target_id) AS sources FROM edges WHERE edge_type = 'contains' GROUP BY 1 HAVING count(DISTINCT target_id) > 1")
def entity_shared_targets(spark, d):
    turned = graph_edges(spark, d).selectExpr("edge_type", "target_id AS source_id", "source_id AS target_id")
    return en.shared_target_counts(turned, "contains")


@query("SELECT id, CASE WHEN source_id LIKE 's:%' THEN 's:1' ELSE source_id END AS source_id, CASE WHEN target_id LIKE 's:%' THEN 's:1' ELSE target_id END AS target_id FROM edges")
def entity_repoint(spark, d):
    mapping = graph_nodes(spark, d).where("node_type = 'supplier'").select("id", F.lit("s:1").alias("kept_id"))
    return en.repoint(graph_edges(spark, d), mapping).select("id", "source_id", "target_id")


_CASES = """, e AS (SELECT id, c_custkey % 3 AS database, CASE WHEN c_custkey % 2 = 0 THEN 'email' ELSE 'account' END AS entity_type,
  CASE WHEN c_custkey % 2 = 0 THEN concat('u', c_custkey % 50, '@h', c_custkey % 7) ELSE concat('d', c_custkey % 5, chr(92), 'u', c_custkey) END AS canonical
  FROM (SELECT concat('c:', c_custkey) AS id, c_custkey FROM customer))"""


@query(
    _CASES
    + """, x AS (SELECT entity_type, canonical AS key, count(*) AS members, count(DISTINCT database) AS databases, min(id) AS first_id FROM e GROUP BY 1, 2 HAVING count(DISTINCT database) > 1),
    e2 AS (SELECT *, CASE WHEN entity_type = 'email' THEN split_part(canonical, '@', 1) ELSE split_part(canonical, chr(92), 2) END AS k2 FROM e
      WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.entity_type = e.entity_type AND x.key = e.canonical)),
    y AS (SELECT entity_type, k2 AS key, count(*) AS members, count(DISTINCT database) AS databases, min(id) AS first_id FROM e2 GROUP BY 1, 2 HAVING count(DISTINCT database) > 1),
    e3 AS (SELECT * FROM e2 WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.entity_type = e2.entity_type AND y.key = e2.k2)),
    z AS (SELECT entity_type, 'fuzzy' AS key, count(*) AS members, count(DISTINCT database) AS databases, min(id) AS first_id FROM e3 GROUP BY 1 HAVING count(DISTINCT database) > 1)
    SELECT 'exact' AS wave, x.*, 0.95::DOUBLE AS confidence FROM x UNION ALL SELECT 'normalized', y.*, 0.85 FROM y UNION ALL SELECT 'fuzzy', z.*, 0.50 FROM z"""
)
def entity_cross_case(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr(
        "concat('c:', c_custkey) AS id", "c_custkey % 3 AS database", "CASE WHEN c_custkey % 2 = 0 THEN 'email' ELSE 'account' END AS entity_type",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('u', c_custkey % 50, '@h', c_custkey % 7) ELSE concat('d', c_custkey % 5, char(92), 'u', c_custkey) END AS canonical",
    )
    return en.cross_case_matches(rows)


@query("SELECT entity_type, canonical, count(DISTINCT data_source_id) AS sources, count(*) AS members FROM (SELECT c_mktsegment AS entity_type, concat('n', c_nationkey) AS canonical, c_custkey % 4 AS data_source_id FROM customer) GROUP BY 1, 2 HAVING count(DISTINCT data_source_id) >= 2")
def entity_source_overlay(spark, d):
    return en.source_overlay(spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_mktsegment AS entity_type", "concat('n', c_nationkey) AS canonical", "c_custkey % 4 AS data_source_id"))


PACK = """
[manifest]
id = "demo"
[[rules]]
id = "same-name"
family = "exe"
target_type = "File"
confidence = "strong"
conditions = [{source = "name", operator = "filename_equals", target = "path"}, {source = "kind", operator = "contains", target = "path"}]
[[rules]]
id = "never"
family = "exe"
target_type = "File"
conditions = [{source = "name", operator = "temporal_proximity", target = "path"}]
"""


@query("SELECT concat('rp:demo:same-name:', s.id, ':', t.id) AS id, CAST(s.id AS VARCHAR) AS source_id, CAST(t.id AS VARCHAR) AS target_id, 'correlates_with' AS edge_type, 0.9::DOUBLE AS confidence FROM f s JOIN f t ON lower(s.name) = lower(t.name) WHERE s.ext = 'exe' AND t.entry_type = 'File' AND contains(lower(t.path), 'src')")
def rule_pack(spark, d):
    pack, rules = ru.parse_pack(PACK, {"exe"})
    f = files(spark, d)
    art = f.select("id", F.col("ext").alias("family"), "name", F.lit("SRC").alias("kind"))
    return ru.run_pack(pack, rules, art, f.select("id", F.col("entry_type").alias("node_type"), "path"))


FREE_PACK = """
[manifest]
id = "free"
[[rules]]
id = "inside"
family = "exe"
target_type = "File"
confidence = "weak"
conditions = [{source = "stem", operator = "contains", target = "path"}]
[[rules]]
id = "pattern"
family = "log"
target_type = "Directory"
conditions = [{source = "pattern", operator = "regex", target = "path"}]
[[rules]]
id = "whole"
family = "jpg"
target_type = "File"
confidence = "direct"
conditions = [{source = "path", operator = "path_equals", target = "path"}, {source = "ext", operator = "equals", target = "ext"}]
"""


@query(
    """, p AS (SELECT *, regexp_extract(lower(name), '^doc[0-9]+') AS stem FROM f)
    SELECT concat('rp:free:inside:', s.id, ':', t.id) AS id, CAST(s.id AS VARCHAR) AS source_id, CAST(t.id AS VARCHAR) AS target_id, 'correlates_with' AS edge_type, 0.5::DOUBLE AS confidence
      FROM p s JOIN p t ON contains(lower(t.path), s.stem) WHERE s.ext = 'exe' AND t.entry_type = 'File'
    UNION ALL SELECT concat('rp:free:pattern:', s.id, ':', t.id), CAST(s.id AS VARCHAR), CAST(t.id AS VARCHAR), 'correlates_with', 0.5
      FROM p s JOIN p t ON regexp_matches(t.path, concat('Doc[0-9]*', s.id % 10, '\\.')) WHERE s.ext = 'log' AND t.entry_type = 'Directory'
    UNION ALL SELECT concat('rp:free:whole:', id, ':', id), CAST(id AS VARCHAR), CAST(id AS VARCHAR), 'correlates_with', 1.0 FROM p WHERE ext = 'jpg' AND entry_type = 'File'"""
)
def rule_pack_operators(spark, d):
    """Rules without an equality (contains, regex), and path and value equality."""
    pack, rules = ru.parse_pack(FREE_PACK, {"exe", "log", "jpg"})
    f = files(spark, d)
    art = f.selectExpr("id", "ext AS family", "regexp_extract(lower(name), '^doc[0-9]+', 0) AS stem", "concat('Doc[0-9]*', id % 10, '\\\\.') AS pattern", "translate(path, '/', '\\\\') AS path", "upper(ext) AS ext")
    return ru.run_pack(pack, rules, art, f.select("id", F.col("entry_type").alias("node_type"), "path", "ext"))
