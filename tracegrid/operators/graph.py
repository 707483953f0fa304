"""The evidence graph: neighbours, bounded walks, snapshots, provenance, threads."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.tables import Tables

MAX_STARTS, MAX_DEPTH, MAX_NODES, MAX_EDGES = 64, 5, 500, 2000


def confident(edges: DataFrame, floor: float | None) -> DataFrame:
    """Edges with at least this confidence; unknown ones count as 0."""
    if floor is None:
        return edges
    if not 0 <= floor <= 1:
        raise ValueError("a confidence floor lies between 0 and 1")
    return edges.where(F.coalesce("confidence", F.lit(0.0)) >= floor)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as ``edge_id, at, to, edge_type, confidence`` in the asked direction."""
    out = edges.select(F.col("id").alias("edge_id"), F.col("source_id").alias("at"), F.col("target_id").alias("to"), "edge_type", "confidence")
    back = edges.select(F.col("id").alias("edge_id"), F.col("target_id").alias("at"), F.col("source_id").alias("to"), "edge_type", "confidence")
    return {"out": out, "in": back, "both": out.unionAll(back.where("at <> to"))}[direction]


def neighbors(nodes: DataFrame, edges: DataFrame, node_id, direction: str = "both", edge_types: list[str] | None = None, floor: float | None = None) -> DataFrame:
    """Edges at a node with the node on their other side, in order of the edge."""
    kept = directed(confident(edges, floor), direction).where(F.col("at") == node_id)
    if edge_types:
        kept = kept.where(F.col("edge_type").isin(*edge_types))
    return kept.join(nodes.select(F.col("id").alias("to"), "node_type", "label"), "to").orderBy("edge_id").dropDuplicates(["edge_id"])


def walk(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """Breadth-first: ``id, depth`` of all nodes within so many steps of the starts.

    A level is an equi-join of the newest nodes with the edges and an anti-join with what has been
    seen. Each is written once and read by the next, so the plan does not grow with the depth.
    """
    tables = Tables(edges.sparkSession, "walk")
    links = directed(edges, direction).select("at", "to")
    seen = newest = starts.select("id").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        reached = newest.join(links, F.col("id") == F.col("at")).select(F.col("to").alias("id")).distinct()
        newest = tables.put(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if newest.isEmpty():
            break
        seen = seen.unionAll(newest)
    return seen


def case_walk(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """A walk in both directions, cut to ``MAX_NODES`` in order of depth and id; a feature of
    views, which tell by ``truncated`` that there is more."""
    depth = max(1, min(depth, MAX_DEPTH))
    found = walk(edges, starts.orderBy("id").limit(MAX_STARTS), depth, "both")
    shown = found.orderBy("depth", "id").limit(MAX_NODES + 1)
    total = shown.agg(F.count("*").alias("n"))
    return shown.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("n") > MAX_NODES).drop("n").orderBy("depth", "id").limit(MAX_NODES)


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"
    )


def snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by type for nodes and edges."""
    n = nodes.groupBy(F.lit("node").alias("what"), F.col("node_type").alias("type")).agg(F.count("*").alias("n"))
    e = edges.groupBy(F.lit("edge").alias("what"), F.col("edge_type").alias("type")).agg(F.count("*").alias("n"))
    return n.unionAll(e)


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """2E / (N (N - 1)); 0 for fewer than two nodes."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    value = F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return n.crossJoin(e).withColumn("density", value)


def degrees(edges: DataFrame) -> DataFrame:
    """Edges out of and into each node."""
    ends = edges.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("target_id", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def provenance_rows(edges: DataFrame) -> DataFrame:
    """One row for each match signal in an edge's provenance JSON, or one where there is none:
    ``edge_id, rule_id, signal``."""
    signals = F.from_json(F.get_json_object("provenance", "$.match_signals"), "array<string>")
    lead = F.coalesce(F.get_json_object("provenance", "$.lead_id"), F.col("id"))
    rows = edges.select(F.col("id").alias("edge_id"), lead.alias("lead"), F.posexplode_outer(signals).alias("at", "signal"))
    return rows.select("edge_id", F.concat_ws("-", "lead", F.coalesce("at", F.lit(0))).alias("rule_id"), "signal")


def containment(files: DataFrame) -> DataFrame:
    """Edges from folders to what they contain."""
    return files.where("parent_id IS NOT NULL").select(
        F.concat(F.lit("contains:"), F.col("id")).alias("id"), F.col("parent_id").alias("source_id"),
        F.col("id").cast("string").alias("target_id"), F.lit("contains").alias("edge_type"),
    )


def thread(spark: SparkSession, entries: DataFrame, root_id, max_depth: int = 64) -> DataFrame:
    """A tree of entries (id, parent_id, created_at) from a root: depth, then time."""
    return spark.sql(
        """
        WITH RECURSIVE entry AS (SELECT id, parent_id, created_at FROM {entries}),
        tree AS (
          SELECT id, parent_id, created_at, 0 AS depth FROM entry WHERE id = :root
          UNION ALL
          SELECT e.id, e.parent_id, e.created_at, t.depth + 1 FROM entry e JOIN tree t ON e.parent_id = t.id
          WHERE t.depth < :deepest)
        SELECT * FROM tree ORDER BY depth, created_at, id""",
        args={"root": root_id, "deepest": max_depth},
        entries=entries,
    )


def threads(entries: DataFrame, max_depth: int = 64) -> DataFrame:
    """All trees of entries (id, parent_id): ``id, root_id, depth``.

    Entries whose parent is not there are roots; those deeper than ``max_depth``, or in a cycle,
    are left out. Pointers to ancestors double, so 64 levels take seven joins whatever the shapes.
    """
    tables = Tables(entries.sparkSession, "threads")
    ids = entries.select(F.col("id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    placed = entries.select("id", "parent_id").distinct().join(ids, "parent_id", "left")
    up = F.when(F.col("known"), F.col("parent_id")).otherwise(F.col("id"))
    pointers = tables.put(placed.select("id", up.alias("up"), F.coalesce("known", F.lit(False)).cast("int").alias("depth")))
    reach = 1
    while reach <= max_depth:
        then = pointers.select(F.col("id").alias("up"), F.col("up").alias("farther"), F.col("depth").alias("more"))
        pointers = tables.put(pointers.join(then, "up").select("id", F.col("farther").alias("up"), (F.col("depth") + F.col("more")).alias("depth")))
        reach *= 2
    roots = placed.where("known IS NULL").select(F.col("id").alias("up"))
    return pointers.join(roots, "up", "left_semi").where(F.col("depth") <= max_depth).select("id", F.col("up").alias("root_id"), "depth")
