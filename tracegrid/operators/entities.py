"""Entities: merging, relationships, matches across cases."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import canonical_label

CROSS_CASE_CONFIDENCE = {"exact": 0.95, "normalized": 0.85, "fuzzy": 0.50}


def key_of(*parts: Column) -> Column:
    """A stable id from its parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def count_confidence(n: Column, of_none: float = 0.7) -> Column:
    return F.when(n <= 0, of_none).when(n == 1, 0.70).when(n == 2, 0.85).otherwise(0.95)


def entity_type(tags: Column) -> Column:
    """The first tag other than ``entity``."""
    return F.coalesce(F.get(F.filter(tags, lambda t: t != "entity"), F.lit(0)), F.lit("unknown"))


def merge_entities(nodes: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Nodes (id, label, entity_type) with the same canonical label and type as one entity: its
    sources' count and least id, distinct labels, and confidence. Labels of a group are combined
    by partial sets before they move."""
    grouped = nodes.withColumn("canonical", canonical_label(F.col("label"), ascii_only)).groupBy("canonical", "entity_type")
    merged = grouped.agg(F.count("*").alias("sources"), F.min("id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))
    return merged.withColumn("confidence", count_confidence(F.col("sources")))


def repoint(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends moved to the kept node of ``mapping`` (id, kept_id)."""
    moved = edges
    for end in ("source_id", "target_id"):
        to = mapping.select(F.col("id").alias(end), F.col("kept_id").alias("kept"))
        moved = moved.join(to, end, "left").withColumn(end, F.coalesce("kept", end)).drop("kept")
    return moved


def two_hop_relations(edges: DataFrame, first: str, second: str, relation: str) -> DataFrame:
    """Pairs of nodes that ``first`` and ``second`` edges join over a node between, with the
    number of such nodes and a confidence by it. Edges are deduplicated before the join."""
    a = edges.where(F.col("edge_type") == first).select(F.col("source_id").alias("src"), F.col("target_id").alias("mid")).distinct()
    b = edges.where(F.col("edge_type") == second).select(F.col("source_id").alias("mid"), F.col("target_id").alias("dst")).distinct()
    pairs = a.join(b, "mid").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("evidence"))
    return pairs.select("src", "dst", F.lit(relation).alias("relation"), "evidence", count_confidence(F.col("evidence"), 0.0).alias("confidence"))


#: Relations that are inferred: artifacts of a tag (or with a word in their label)
#: between a person and what the last step leads to.
PATTERNS = [
    ("owns", "Registry", "registry", "device"), ("logged_into", "wtmp", "wtmp", "device"), ("executed", "Prefetch", "prefetch", "file"),
    ("communicates_with", "EmailMessage", "email", "person"),
]


def inferred_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations between entities over artifacts and files: ``src, dst, relation, evidence`` (the
    distinct edges behind it, sorted), with patterns that give the same pair united.

    ``nodes`` has id, node_type, tags (an array), label; ``edges`` id, source_id, target_id,
    edge_type. Edges next to a device are taken in both directions, so the last step is an
    equi-join. Evidence combines in tasks before it moves.
    """
    tagged = lambda tag: nodes.where((F.col("node_type") == "entity") & F.array_contains("tags", tag)).select("id")
    people, devices = tagged("person"), tagged("device")
    files = nodes.where("node_type = 'file'").select("id")
    of_type = lambda t, a, b, e: edges.where(F.col("edge_type") == t).select(F.col("source_id").alias(a), F.col("target_id").alias(b), F.col("id").alias(e))
    both = edges.select(F.col("source_id").alias("file"), F.col("target_id").alias("dst"), F.col("id").alias("e3")).unionAll(edges.select("target_id", "source_id", "id"))
    on_device = both.join(devices.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = None
    for relation, tag, word, last in PATTERNS:
        fits = F.array_contains("tags", tag) | F.lower("label").contains(word)
        art = nodes.where((F.col("node_type") == "artifact") & F.coalesce(fits, F.lit(False))).select(F.col("id").alias("art"))
        if last == "person":
            a = of_type("correlates_with", "src", "art", "e1").join(art, "art", "left_semi").join(people.withColumnRenamed("id", "src"), "src", "left_semi")
            found = a.join(a.select(F.col("src").alias("dst"), "art", F.col("e1").alias("e2")), "art").where("src < dst")
            evidence = F.array("e1", "e2")
        else:
            a = of_type("derives_from", "src", "art", "e1").join(people.withColumnRenamed("id", "src"), "src", "left_semi")
            b = of_type("references", "art", "file", "e2").join(art, "art", "left_semi").join(files.withColumnRenamed("id", "file"), "file", "left_semi")
            found = a.join(b, "art")
            found = found.withColumn("dst", F.col("file")) if last == "file" else found.join(on_device, "file").where("src <> dst")
            evidence = F.array("e1", "e2") if last == "file" else F.array("e1", "e2", "e3")
        rows = found.select("src", "dst", F.lit(relation).alias("relation"), F.explode(evidence).alias("edge")).distinct()
        out = rows if out is None else out.unionAll(rows)
    united = out.distinct().groupBy("src", "dst", "relation").agg(F.array_join(F.array_sort(F.collect_list("edge")), ",").alias("evidence"), F.count("*").alias("n"))
    return united.select("src", "dst", "relation", "evidence", count_confidence(F.col("n"), 0.0).alias("confidence"))


def shared_target_counts(edges: DataFrame, edge_type: str) -> DataFrame:
    """Targets that several sources point to, with their number: the hub form of pairs of sources,
    which grows with edges and not with pairs."""
    hits = edges.where(F.col("edge_type") == edge_type)
    return hits.groupBy("target_id").agg(F.count_distinct("source_id").alias("sources")).where("sources > 1")


def secondary_form(canonical: Column, kind: Column) -> Column:
    """Mail addresses to their local part, accounts to what follows the last backslash."""
    return F.when(kind == "email", F.substring_index(canonical, "@", 1)).when(kind == "account", F.element_at(F.split(canonical, r"\\"), -1)).otherwise(canonical)


def cross_case_matches(entities: DataFrame) -> DataFrame:
    """Groups of entities (id, database, canonical, entity_type) that span two databases or more.

    Three waves, each over what the one before left: equal canonical labels, equal secondary
    forms, and last all of a type together (named fuzzy, though nothing is compared).
    """
    out, left = None, entities
    forms = {"exact": F.col("canonical"), "normalized": secondary_form(F.col("canonical"), F.col("entity_type")), "fuzzy": F.lit("fuzzy")}
    for wave, form in forms.items():
        keyed = left.withColumn("key", form)
        groups = keyed.groupBy("entity_type", "key").agg(
            F.count("*").alias("members"), F.count_distinct("database").alias("databases"), F.min("id").alias("first_id")
        ).where("databases > 1")
        found = groups.select(F.lit(wave).alias("wave"), "entity_type", "key", "members", "databases", "first_id", F.lit(CROSS_CASE_CONFIDENCE[wave]).alias("confidence"))
        out = found if out is None else out.unionByName(found)
        left = keyed.join(groups.select("entity_type", "key"), ["entity_type", "key"], "left_anti").drop("key")
    return out


def source_overlay(entities: DataFrame) -> DataFrame:
    """Hubs for entities that several sources hold, ranked by sources, members and label."""
    hubs = entities.groupBy("entity_type", "canonical").agg(F.count_distinct("data_source_id").alias("sources"), F.count("*").alias("members"))
    rank = F.struct(F.col("sources"), F.col("members")).alias("by")
    return hubs.where("sources >= 2").withColumn("by", rank).orderBy(F.desc("by"), "canonical", "entity_type").drop("by")
