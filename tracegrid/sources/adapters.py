"""The engine's relations, made from the star-schema and text tables.

Each relation is a list of select expressions that Spark and other SQL engines read alike.
"""

from pyspark.sql import DataFrame, SparkSession

TIMELINE = [
    "event_id AS id",
    "user_id % 4 AS data_source_id",
    "user_id AS source_object_id",
    "event_type",
    "ts",
    "concat(event_type, ' by user ', user_id % 40) AS description",
    "value",
    "props AS attrs",
]
FILES = [
    "doc_id AS id",
    "doc_id % 4 AS data_source_id",
    "concat(source, '/', lang) AS parent_id",
    "concat('C:/', source, '/', lang, '/Doc', doc_id, CASE doc_id % 5 WHEN 0 THEN '.exe' WHEN 1 THEN '.PDF'"
    " WHEN 2 THEN '.jpg' WHEN 3 THEN '.log' ELSE '' END) AS path",
    "concat('Doc', doc_id, CASE doc_id % 5 WHEN 0 THEN '.exe' WHEN 1 THEN '.PDF' WHEN 2 THEN '.jpg' WHEN 3 THEN '.log'"
    " ELSE '' END) AS name",
    "CASE WHEN doc_id % 29 = 0 THEN 'Directory' ELSE 'File' END AS entry_type",
    "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars END AS size",
    "CASE doc_id % 5 WHEN 0 THEN 'exe' WHEN 1 THEN 'PDF' WHEN 2 THEN 'jpg' WHEN 3 THEN 'log' END AS ext",
    "doc_id % 11 = 0 AS deleted",
    "doc_id % 7 = 0 AS hidden",
    "doc_id % 13 = 0 AS system",
    "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 6 = 1 END AS encrypted",
    "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE doc_id * 37 % 100003 END AS modified_at",
]
ARTIFACTS = [
    "o_orderkey AS id",
    "o_custkey % 4 AS data_source_id",
    "o_custkey AS source_object_id",
    "o_orderpriority AS family",
    "o_orderstatus AS kind",
    "o_orderdate AS created_at",
    "o_totalprice AS weight",
    "concat('Order ', o_orderkey) AS title",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*TIMELINE)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(*FILES)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*ARTIFACTS)


NODES_SQL = """
  SELECT concat('r:', r_regionkey) AS id, 'region' AS node_type, r_name AS label FROM region
  UNION ALL SELECT concat('n:', n_nationkey), 'nation', n_name FROM nation
  UNION ALL SELECT concat('c:', c_custkey), 'customer', c_name FROM customer
  UNION ALL SELECT concat('s:', s_suppkey), 'supplier', s_name FROM supplier"""
EDGES_SQL = """
  SELECT concat('rn:', n_nationkey) AS id, concat('r:', n_regionkey) AS source_id, concat('n:', n_nationkey) AS target_id,
    'contains' AS edge_type, CAST(1 AS DOUBLE) AS confidence FROM nation
  UNION ALL SELECT concat('nc:', c_custkey), concat('n:', c_nationkey), concat('c:', c_custkey), 'contains',
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 10 AS DOUBLE) / 10 END FROM customer
  UNION ALL SELECT concat('ns:', s_suppkey), concat('n:', s_nationkey), concat('s:', s_suppkey), 'owns',
    CAST(s_suppkey % 10 AS DOUBLE) / 10 FROM supplier
  UNION ALL SELECT concat('sc:', c_custkey), concat('s:', c_custkey % 10 + 1), concat('c:', c_custkey), 'communicates_with',
    CAST(c_custkey % 7 AS DOUBLE) / 7 FROM customer WHERE c_custkey % 5 = 0"""


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(
        "WITH " + ", ".join(f"{n} AS (SELECT * FROM {{{n}}})" for n in names) + text,
        **{n: read(spark, sf_dir, n) for n in names},
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, NODES_SQL, "region", "nation", "customer", "supplier")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EDGES_SQL, "nation", "customer", "supplier")
