"""Numbers in an order, without a window that holds everything."""

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.tables import Tables

EARLIER = (Window.unboundedPreceding, -1)


def running_sums(rows: DataFrame, key: list[str], order: list[str], value: str, tables: Tables) -> DataFrame:
    """Rows with ``before``: the sum of ``value`` over the earlier rows of the same key, in the order.

    Rows are sorted over range partitions and written once with the number of theirs, so a key of
    any size is spread; the sums of partitions are a table with a row for each key and partition.
    Keys must not be null, the order must tell rows apart.
    """
    placed = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    placed = tables.put(placed.withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*key, "_part").agg(F.sum(value).alias("_sum"))
    begin = F.coalesce(F.sum("_sum").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(*EARLIER)), F.lit(0))
    begins = sums.select(*key, "_part", begin.alias("_begin"))
    inside = F.sum(value).over(Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(*EARLIER))
    found = placed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(begins, ["_part", *key])
    return found.withColumn("before", F.col("_begin") + F.col("_inside")).drop("_part", "_begin", "_inside")
