"""Writers for reports and datasets."""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import csv_cell, html_escape


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as lines of CSV: every cell quoted, formulas guarded."""
    return df.select(F.concat_ws(",", *(csv_cell(F.col(c)) for c in df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files; the unquoted header is a file of its own, ``header``, beside ``rows``."""
    spark = df.sparkSession
    spark.createDataFrame([(",".join(df.columns),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    csv_lines(df).write.mode("overwrite").text(f"{path}/rows")


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def html_rows(df: DataFrame) -> DataFrame:
    """Rows as table rows with escaped cells."""
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def write_html(df: DataFrame, path: str, title: str) -> None:
    """A table in part files below ``rows``, with what goes before in ``head``."""
    spark = df.sparkSession
    names = "".join(f"<th>{c}</th>" for c in df.columns)
    head = [(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body><table><tr>{names}</tr>",)]
    spark.createDataFrame(head, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    html_rows(df).write.mode("overwrite").text(f"{path}/rows")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows with those of the same key replaced; of repeated incoming rows the greatest
    in order of the other columns counts."""
    rest = [c for c in incoming.columns if c not in key]
    fresh = incoming.groupBy(*key).agg(F.max(F.struct(*rest)).alias("r")).select(*key, "r.*") if rest else incoming.distinct()
    return existing.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def replace_producer(existing: DataFrame, incoming: DataFrame, prefix: str) -> DataFrame:
    """One producer's rows (by prefix of parser_id) swapped for new ones."""
    return existing.where(~F.coalesce(F.col("parser_id").startswith(prefix), F.lit(False))).unionByName(incoming)
