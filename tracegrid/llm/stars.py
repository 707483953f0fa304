"""Links inside buckets, with candidates that grow with members and not with their square."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .scratch import Scratch

#: The width of classes of set sizes, as a factor.
SIZE_STEP = 1.05


def unfinished(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of those buckets that hold more than one component, with their components."""
    found = scratch.put(
        members.drop("label")
        .join(labels, "id", "left")
        .withColumn("label", F.coalesce("component", "id"))
        .drop("component")
    )
    ends = found.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    spanning = scratch.put(ends.where("lo <> hi").select("bucket"))
    out = scratch.put(found.join(spanning, "bucket"))
    scratch.drop(found, spanning)
    return out


def pairs_behind_center(inner: DataFrame, beyond: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch) -> DataFrame:
    """Pairs ``a, b`` of members with the same center that can still be links.

    ``inner`` has center, id, label, apart (not in the center's component), n (set size) and u
    (shared with the center). A link's sets share at least percent * (n1 + n2) / (100 + percent);
    at most min(u1, u2) of that lies in the center's set. What is missing, if anything, they must
    share beyond it. There the rarest come first, and a set that must share m of its e leads with
    a shared one among its first e - m + 1 (prefix filter); how many must be shared depends on the
    other's size, so members apart from the center probe one class of sizes after the other.
    Where nothing is missing, both lie in the center's set for the most part, and one is small
    enough for the other's u.
    """
    needed = f"ceil({percent} * ({{}} + {{}}) / {100 + percent}.0 - 1e-9)"
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(SIZE_STEP)) + 1e-9).cast("int")
    keys = ["center", "size"]

    def of(members: DataFrame, apart: bool) -> DataFrame:
        found = beyond(members.where("apart" if apart else "NOT apart").select(F.col("center").alias("a"), F.col("id").alias("b")))
        return found.select(F.col("a").alias("center"), F.col("b").alias("id"), "shingle", F.lit(apart).alias("apart"))

    alike = Window.partitionBy("center", "shingle")
    shared = of(inner, True).unionAll(of(inner, False)).select("*", F.count("*").over(alike).alias("df"), F.max("apart").over(alike).alias("probed"))
    # shingles that no pair can share come first in any order, so only their number counts
    shared = shared.where("df > 1 AND probed")
    ordered = F.array_sort(F.collect_list(F.struct("df", "shingle")))
    lists = shared.groupBy("center", "id").agg(ordered.alias("ordered")).join(inner, ["center", "id"])
    lists = lists.withColumn("e", F.col("n") - F.col("u")).withColumn("common", F.size("ordered"))
    # no set can do with less in common than with the smallest that it can be linked with
    first = F.expr(f"slice(ordered, 1, cast(greatest(common - greatest(ceil({percent} * n / 100.0 - 1e-9) - u, 1) + 1, 0) AS int))")
    rows = lists.select("center", "id", "label", "apart", "n", "u", "e", "common", F.posexplode_outer(first).alias("at", "of"))
    rows = rows.where("of IS NOT NULL").select("center", "id", "label", "apart", "n", "u", "e", "of.shingle", F.expr("e - common + at + 1").alias("rank"))
    rows = scratch.put(rows)

    sizes = F.explode(F.sequence(size_class(F.col("n") * percent / 100), size_class(F.col("n") * 100 / percent)))
    probes = rows.where("apart").withColumn("size", sizes)
    smallest = f"greatest(pow({SIZE_STEP}, size), n * {percent} / 100.0)"
    probes = probes.where(f"rank <= e - greatest({needed.format('n', smallest)} - u, 1) + 1")
    index = rows.withColumn("size", size_class(F.col("n")))
    side = lambda df, s, keys: df.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in ("id", "label", "n", "u")))
    different = f"a_label <> b_label AND 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
    missing = f"{needed.format('a_n', 'b_n')} - least(a_u, b_u)"
    share = side(probes, "a", [*keys, "shingle"]).join(side(index, "b", [*keys, "shingle"]), [*keys, "shingle"])
    share = share.where(f"{different} AND {missing} BETWEEN 1 AND least(a_n - a_u, b_n - b_u)")

    mostly = inner.where(f"100 * u >= {percent} * n")
    largest = F.col("u") * (100 + percent) / F.lit(float(percent)) - F.col("n")
    reach = mostly.where("apart").withColumn("lo", F.col("n") * percent / 100).withColumn("hi", F.least(largest, F.col("n") * 100 / percent))
    reach = reach.where("hi >= lo").withColumn("size", F.explode(F.sequence(size_class(F.col("lo")), size_class(F.col("hi")))))
    within = side(reach, "a", keys).join(side(mostly.withColumn("size", size_class(F.col("n"))), "b", keys), keys)
    within = within.where(f"{different} AND {missing} <= 0")
    ends = [F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")]
    return share.select(*ends).unionAll(within.select(*ends))


def linked_components(
    members: DataFrame,
    compare: Callable[[DataFrame], DataFrame],
    beyond: Callable[[DataFrame], DataFrame],
    percent: int,
    scratch: Scratch,
) -> DataFrame:
    """``id, component`` for ids that have a link to another member of one of their buckets.

    A link is a pair of sets with 100 * intersection >= percent * union. ``members`` has the
    columns bucket, id, score. ``compare`` adds to pairs ``a, b`` the size of both sets and of
    their intersection: na, nb, both. ``beyond`` gives for pairs ``a, b``, as rows with ``shingle``,
    what b's set has beyond a's.

    A bucket's first star joins all members to the one with the highest score. Buckets that are
    then within one component are finished: whatever else they hold would not change it. The
    others get a star around the best member of another component. Where a bucket is still split,
    pairs across components are compared that the distances to the center do not exclude.
    """
    members = members.withColumn("label", F.col("id"))

    def centers(rows: DataFrame) -> DataFrame:
        highest = F.max(F.struct("score", (-F.col("id")).alias("order"), "label"))
        best = rows.groupBy("bucket").agg(highest.alias("c"))
        return scratch.put(best.select("bucket", (-F.col("c.order")).alias("a"), F.col("c.label").alias("label_a")))

    def compared(pairs: DataFrame) -> DataFrame:
        found = scratch.put(pairs.distinct())
        out = scratch.put(compare(found))
        scratch.drop(found)
        scratch.release()
        return out

    def links_in(tested: DataFrame) -> DataFrame:
        similar = tested.where(f"both > 0 AND 100 * both >= {percent} * (na + nb - both)")
        return similar.select(F.col("a").alias("src"), F.col("b").alias("dst"))

    to_center = [F.col("a"), F.col("id").alias("b")]
    first = centers(members)
    tested = compared(members.join(first, "bucket").where("a <> id").select(*to_center))
    links = links_in(tested)
    labels = components(links, scratch)
    rest = unfinished(members, labels, scratch)
    if not rest.isEmpty():
        seen = centers(rest).select("bucket", F.col("label_a").alias("seen"))
        others = rest.join(seen, "bucket").where("label <> seen")
        star = rest.join(centers(others), "bucket").where("label <> label_a").select(*to_center)
        links = links.unionAll(links_in(compared(star)))
        labels = components(links, scratch)
        rest = unfinished(rest, labels, scratch)
    if not rest.isEmpty():
        placed = rest.join(first.select("bucket", F.col("a").alias("center")), "bucket").where("id <> center")
        inner = scratch.put(placed.select("center", "id", "label").distinct())
        known = tested.select(F.col("a").alias("center"), F.col("b").alias("id"), F.col("nb").alias("n"), F.col("both").alias("u"))
        of_center = labels.select(F.col("id").alias("center"), F.col("component").alias("at_center"))
        apart = (F.col("label") != F.coalesce("at_center", "center")).alias("apart")
        inner = inner.join(known, ["center", "id"]).join(of_center, "center", "left")
        inner = scratch.put(inner.select("center", "id", "label", apart, "n", "u"))
        links = links.unionAll(links_in(compared(pairs_behind_center(inner, beyond, percent, scratch))))
        labels = components(links, scratch)
    return labels
