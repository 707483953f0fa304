"""Connected components as a distributed union-find over DataFrames."""

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _followed(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointers followed to their ends, again by doubling."""
    while True:
        ends = pointers.select(F.col("id").alias("component"), F.col("component").alias("end"))
        jumped = scratch.put(pointers.join(ends, "component").select("id", F.col("end").alias("component"), (F.col("component") != F.col("end")).alias("moved")))
        if jumped.where("moved").isEmpty():
            return jumped.drop("moved")
        pointers = jumped.drop("moved")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The smallest id reachable from each id that has a link.

    ``links`` has the columns ``src`` and ``dst``; direction, repeats and self-links do
    not matter, rows with a null end are ignored. Returns ``id, component``; no links give
    an empty table.

    Every id points to a smaller or equal id. A round hooks each pointer to the least
    pointer across its links, then follows pointers twice, so paths shorten by doubling.
    Links are rewritten to the pointers of their ends and vanish inside a component. Each
    join has plain tables on both sides, so adaptive execution can split a hot id.
    """
    ends = links.select("src", "dst").where("src <> dst")
    edges = scratch.put(
        ends.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    )
    both = edges.select(F.col("hi").alias("id"), F.col("lo").alias("to")).unionAll(edges.select("lo", "hi"))
    pointers = scratch.put(
        both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("component"))
    )
    while True:
        of_hi = pointers.select(F.col("id").alias("hi"), F.col("component").alias("p_hi"))
        of_lo = pointers.select(F.col("id").alias("lo"), F.col("component").alias("p_lo"))
        moved = edges.join(of_hi, "hi").join(of_lo, "lo").where("p_hi <> p_lo")
        left = scratch.put(
            moved.select(F.greatest("p_hi", "p_lo").alias("hi"), F.least("p_hi", "p_lo").alias("lo")).distinct()
        )
        if left.isEmpty():
            return _followed(pointers, scratch)
        hooks = left.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("hook"))
        hooked = scratch.put(pointers.join(hooks, "id", "left"))
        parents = hooked.select(F.col("id").alias("component"), F.least("component", "hook").alias("parent"))
        after = scratch.put(pointers.join(parents, "component").select("id", F.col("parent").alias("component")))
        # an id that pointed elsewhere before it was hooked still holds both ends together
        torn = hooked.where("hook IS NOT NULL AND component <> id AND component <> hook")
        torn = torn.select(F.greatest("component", "hook").alias("hi"), F.least("component", "hook").alias("lo"))
        edges, pointers = left.unionAll(torn), after
