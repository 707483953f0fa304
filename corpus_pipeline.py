"""The corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies
stays, and what is left is packed into training sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegrid.llm.op02_toxicity import keep_clean, train
from tracegrid.llm.op03_minhash import without_near_duplicates
from tracegrid.llm.op07_lines import dedup_lines
from tracegrid.llm.op10_packing import pack
from tracegrid.llm.scratch import Scratch

#: Near copies: shingles of so many words, and a Jaccard similarity of at least so many percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier chain does not find toxic."""
    return keep_clean(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of texts; documents that had nothing else go."""
    cleaned = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.where(~emptied).withColumn("n_chars", n_chars.cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies, that with the smallest doc_id.

    Rows are judged one by one: of two texts under one doc_id each stays unless it has a copy.
    """
    return without_near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents that are left; one row per piece."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("best-fit packing", packing),
]

#: Classifiers, MinHash and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order, each on what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
