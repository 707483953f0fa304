"""Extracted artifacts: counts by family and kind, pages, metrics."""

from pyspark.sql import Column, DataFrame, functions as F

CASE_LIMIT = 1000


def family_counts(artifacts: DataFrame, by_source: bool = False) -> DataFrame:
    keys = ["data_source_id"] * by_source + ["family"]
    return artifacts.groupBy(*keys).agg(F.count("*").alias("n"))


def prefix_total(artifacts: DataFrame, prefix: str) -> DataFrame:
    """Artifacts whose family begins with the prefix, without ASCII case."""
    return artifacts.where(F.lower("family").startswith(prefix.lower())).agg(F.count("*").alias("n"))


def kind_pivot(artifacts: DataFrame, kinds: list[str], kind: str = "kind") -> DataFrame:
    """One counter for each kind, and ``other``: what is left of the total, never below 0."""
    counts = [F.count(F.when(F.col(kind) == k, 1)).alias(f"n_{k.lower()}") for k in kinds]
    table = artifacts.groupBy("family").agg(F.count("*").alias("total"), *counts)
    rest = F.col("total")
    for k in kinds:
        rest = rest - F.col(f"n_{k.lower()}")
    return table.withColumn("other", F.greatest(rest, F.lit(0)))


def of_kinds(artifacts: DataFrame, kinds: list[str]) -> DataFrame:
    return artifacts.where(F.col("kind").isin(*kinds))


def created_page(artifacts: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, then id; a case shows ``CASE_LIMIT`` at most."""
    ordered = artifacts.orderBy(F.desc("created_at"), "id")
    return (ordered.offset(offset) if offset else ordered).limit(min(limit, CASE_LIMIT))


def event_order() -> list[Column]:
    """Event time newest first with unknown ones last, record number, id."""
    return [F.col("event_time").desc_nulls_last(), F.col("record_id").desc_nulls_last(), F.asc("id")]


def case_metrics(**relations: DataFrame) -> DataFrame:
    """One row: the number of rows of each relation."""
    out = None
    for name, df in relations.items():
        n = df.agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(n)
    return out


def facts(rows: DataFrame, family: str | None = None, kind: str | None = None, field: str | None = None) -> DataFrame:
    """Facts that parsers found (family, kind, field, value), by any of the first three."""
    for column, value in (("family", family), ("kind", kind), ("field", field)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def of_objects(artifacts: DataFrame, objects: DataFrame) -> DataFrame:
    """Artifacts of a table of objects (source_object_id)."""
    return artifacts.join(objects.select("source_object_id").distinct(), "source_object_id", "left_semi")
