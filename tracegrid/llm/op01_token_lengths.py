"""Exact length histogram: token totals, quantiles and truncated totals for every limit.

Documents are aggregated by encoded length. Suffix sums over the histogram then answer, for
any context limit, how many documents are longer, how many tokens remain after truncation, and
which length a quantile has, without another look at the documents.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import DEFAULT_VOCABULARY, codec
from .scratch import Scratch

#: Lengths in a bucket of the suffix sums. Buckets are summed first, so no window has more
#: rows than this or than the longest document's length divided by this.
BUCKET = 256


def lengths(docs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``n_tokens`` of every row; null text has none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codec(path)
        for batch in batches:
            yield pd.DataFrame({"n_tokens": [len(code.encode(t)) for t in batch["text"]]}, dtype="int64")

    return docs.select(F.col("text").cast("string")).mapInPandas(count, "n_tokens long")


def histogram(docs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``n_tokens, n_docs``: documents by exact length."""
    return lengths(docs, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Answers for each length L that occurs, as if it were the limit.

    Adds ``docs_at_least`` and ``tokens_at_least`` (documents of L tokens or more, and their
    tokens), ``docs_truncated`` (longer than L), ``tokens_kept`` and ``tokens_cut`` (what stays
    and goes when each document is cut to L), ``quantile`` (share of documents of at most L
    tokens). An empty histogram gives an empty table.
    """
    h = hist.withColumn("bucket", F.floor(F.col("n_tokens") / bucket)).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs")
    )
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = h.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = buckets.select(
        "bucket",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.withColumn("docs_in", F.sum("n_docs").over(inside))
        .withColumn("tokens_in", F.sum("tokens").over(inside))
        .join(buckets, "bucket")
        .withColumn("docs_at_least", F.col("docs_in") + F.col("docs_after"))
        .withColumn("tokens_at_least", F.col("tokens_in") + F.col("tokens_after"))
        .withColumn("docs_truncated", F.col("docs_at_least") - F.col("n_docs"))
        .withColumn(
            "tokens_kept",
            F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"),
        )
        .withColumn("tokens_cut", F.col("all_tokens") - F.col("tokens_kept"))
        .withColumn("quantile", (F.col("all_docs") - F.col("docs_truncated")) / F.col("all_docs"))
        .select(
            "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_truncated", "tokens_kept", "tokens_cut",
            "quantile",
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_truncated, tokens_kept, tokens_cut`` for any limits, from the suffix sums.

    One pass and one row of aggregates: between two lengths that occur, totals follow from the
    sums of the next one above.
    """
    aggregates = []
    for i, limit in enumerate(limits):
        above = F.col("n_tokens") > limit
        aggregates += [
            F.coalesce(F.sum(F.when(above, F.col("n_docs"))), F.lit(0)).alias(f"docs_{i}"),
            F.coalesce(F.sum(F.when(above, (F.col("n_tokens") - limit) * F.col("n_docs"))), F.lit(0)).alias(f"cut_{i}"),
        ]
    total = F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("total")
    rows = [
        F.struct(
            F.lit(limit).cast("long").alias("limit"),
            F.col(f"docs_{i}").alias("docs_truncated"),
            (F.col("total") - F.col(f"cut_{i}")).alias("tokens_kept"),
            F.col(f"cut_{i}").alias("tokens_cut"),
        )
        for i, limit in enumerate(limits)
    ]
    return sums.agg(total, *aggregates).select(F.inline(F.array(*rows)))


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that at least this share of documents do not exceed."""
    found = [F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))).alias(f"q_{i}") for i, s in enumerate(shares)]
    rows = [F.struct(F.lit(float(s)).alias("share"), F.col(f"q_{i}").alias("n_tokens")) for i, s in enumerate(shares)]
    return sums.agg(*found).select(F.inline(F.array(*rows)))


def token_lengths(docs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The suffix-sum table of a corpus; null text counts as a document without tokens."""
    return suffix_sums(Scratch(docs.sparkSession, "lengths").put(histogram(docs, path)))
