"""The table of queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import ARTIFACTS, EDGES_SQL, FILES, NODES_SQL, TIMELINE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The relations as common table expressions for the comparing engine.
RELATIONS = f"""WITH RECURSIVE t AS (SELECT {", ".join(TIMELINE)} FROM events),
 f AS (SELECT {", ".join(FILES)} FROM documents),
 a AS (SELECT {", ".join(ARTIFACTS)} FROM orders),
 nodes AS ({NODES_SQL}),
 edges AS ({EDGES_SQL})
"""


def query(sql: str | None = None, relations: str = RELATIONS):
    """Register a function (spark, sf_dir) under its name. ``sql`` goes on from the relations t
    (timeline), f (files), a (artifacts), nodes and edges; text that begins with a comma adds
    further ones."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = relations + sql.strip()
        return run

    return add
