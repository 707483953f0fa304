"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors form a class first. Vectors of each dimension have a forest of their own. Each tree splits space again and again by a random direction
at the median of a bounded sample; a vector near a split goes to both sides (spill), up to
``COPIES`` leaves in a tree. Directions come from a pool by a hash of the node, so they need no
table. The first levels take their medians from one sample of all vectors, as many levels as it
supports. Leaves with more than ``FULL`` vectors are then split again by medians of their own
bounded samples, which are taken in tasks, until none is too full. A leaf whose sample says that
a share of ``DENSE`` of its pairs are links is not split: comparing all of it costs no more than
a fixed multiple of the links that it holds. Vectors are compared within leaves in double
precision, large leaves in pairs of blocks. A pair that shares several
leaves is counted in the least of them only. A leaf returns one row per linked vector: how many
links it counted, and one neighbour of its local component, so output grows with vectors and
not with pairs. These links are then united.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .components import components
from .scratch import Scratch
from .shingles import mix

TREES, COPIES, POOL = 10, 4, 256
#: Vectors of a dimension that the medians are taken from, at most; a dimension that fits one leaf needs none.
SAMPLE = 16_384
#: Vectors in a leaf on average; in a block at most; in a node of the sample that has a median.
LEAF, BLOCK, LEAST = 256, 1024, 32
#: Vectors in a leaf that is not split again, at most; of a leaf's own sample, on average; share of pairs that are links in a leaf that stays.
FULL, RESAMPLE, DENSE = 2048, 1024, 0.01
#: Levels that a leaf's key has room for; a leaf so deep stays, and is compared in blocks.
DEEPEST = 44
#: Half the width of the spill zone, in deviations of a projected unit vector.
SPILL = 0.25

PREPARED = "vec_id long, vec_key binary, vector binary"
ROUTED = "width int, leaf long, vec_id long, copies long, room int, vector binary"
SPLITS = "width int, leaf long, levels int, medians binary"


@dataclass
class Forest:
    dimension: int
    depth: int
    directions: np.ndarray  # trees x pool x dimension
    nodes: np.ndarray  # sorted keys of nodes with a median
    medians: np.ndarray

    def project(self, tree: int, node: np.ndarray, unit: np.ndarray) -> np.ndarray:
        pick = (mix(node.astype(np.uint64) + np.uint64(tree << 48)) % np.uint64(POOL)).astype(np.int64)
        return np.einsum("ij,ij->i", self.directions[tree][pick], unit)

    def median(self, tree: int, node: np.ndarray) -> np.ndarray:
        key = node + (tree << 48)
        at = np.searchsorted(self.nodes, key)
        at[at == len(self.nodes)] = 0
        return np.where(self.nodes[at] == key, self.medians[at], 0.0) if len(self.nodes) else np.zeros(len(node))

    def descend(self, tree: int, node: np.ndarray, unit: np.ndarray, room: np.ndarray, levels: int, median: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take each vector from its node ``levels`` further down, to at most ``room`` leaves.

        ``median`` gives the medians of nodes of a level. Returns positions of vectors, their nodes, and
        the room that each has left there.
        """
        row, width = np.arange(len(unit)), SPILL / np.sqrt(self.dimension)
        for level in range(levels):
            away = self.project(tree, node, unit[row]) - median(node, level)
            copies = np.bincount(row, minlength=len(unit))
            # nearest splits first: a vector with no room left goes to its own side alone
            near = np.abs(away) <= width
            order = np.lexsort((np.abs(away), row))
            rank = np.cumsum(near[order])
            start = np.searchsorted(row[order], row[order])
            before = rank - near[order] - (rank - near[order])[start]
            both = np.zeros(len(row), bool)
            both[order] = near[order] & (before < (room - copies)[row[order]])
            side = (away > 0).astype(np.int64)
            node, row = (
                np.concatenate([2 * node + side, 2 * node[both] + 1 - side[both]]),
                np.concatenate([row, row[both]]),
            )
        order = np.lexsort((node, row))
        row, node = row[order], node[order]
        first = np.searchsorted(row, row) == np.arange(len(row))
        left = room - np.bincount(row, minlength=len(unit))
        return row, node, np.where(first, 1 + left[row], 1)

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of vectors, keys of their leaves in all trees, and the room left there."""
        found = []
        for tree in range(TREES):
            roots, room = np.ones(len(unit), np.int64), np.full(len(unit), COPIES)
            row, node, left = self.descend(tree, roots, unit, room, self.depth, lambda node, _, t=tree: self.median(t, node))
            found.append((row, node + (tree << 48), left))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def depth_for(total: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, total) / LEAF))))


def supported(sample: int) -> int:
    """Levels for which a sample of so many has medians."""
    return max(0, int(np.log2(max(1, sample) / LEAST)))


def fit(sample: np.ndarray, total: int, seed: int = 11) -> Forest:
    """Trees for ``total`` vectors from a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    dimension, depth = sample.shape[1], min(depth_for(total), supported(len(sample)))
    if not depth:
        return Forest(dimension, 0, np.zeros((TREES, POOL, 0)), np.zeros(0, np.int64), np.zeros(0))
    directions = rng.standard_normal((TREES, POOL, dimension))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    forest = Forest(dimension, depth, directions, np.zeros(0, np.int64), np.zeros(0))
    nodes, medians = [], []
    for tree in range(TREES):
        node = np.ones(len(sample), np.int64)
        for _ in range(depth):
            at = forest.project(tree, node, sample)
            order = np.argsort(node, kind="stable")
            names, first, counts = np.unique(node[order], return_index=True, return_counts=True)
            middle = np.zeros(len(names))
            for i in np.flatnonzero(counts >= LEAST):
                middle[i] = np.median(at[order[first[i] : first[i] + counts[i]]])
                nodes.append(int(names[i]) + (tree << 48))
                medians.append(middle[i])
            node = 2 * node + (at > middle[np.searchsorted(names, node)])
    order = np.argsort(nodes) if nodes else np.zeros(0, np.int64)
    forest.nodes, forest.medians = np.array(nodes, np.int64)[order], np.array(medians)[order]
    return forest


def _matrix(vectors, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each of ``n`` reaches over the pairs ``a, b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _by_tree(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted leaf keys of vectors as vectors x TREES x COPIES, -1 where there is none."""
    out = np.full((len(lists), TREES, COPIES), -1, np.int64)
    keys, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    place = row * TREES + (keys >> 48)
    out[row, keys >> 48, np.arange(len(keys)) - np.searchsorted(place, place)] = keys
    return out


def forest_leaves(heads: DataFrame, kind: str, threshold: float, sample: int, full: int, scratch: Scratch) -> DataFrame:
    """Each of ``heads`` (vec_id, copies, width, vector) in its leaves, as ``ROUTED``.

    The driver fits the first levels of a forest for each width from at most ``sample`` vectors. A
    leaf with more than ``full`` is split by up to ``supported(RESAMPLE)`` levels at a time, by
    medians that a task takes from some ``RESAMPLE`` of its vectors.
    """
    size = np.dtype(kind).itemsize
    forests = {}
    for w in heads.groupBy("width").agg(F.count("*").alias("n")).collect():
        x = np.ones((1, w["width"] // size))
        if depth_for(w["n"]):
            drawn = heads.where(F.col("width") == w["width"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
            x = _matrix([r["vector"] for r in drawn.select("vector").collect()], kind)
        forests[w["width"]] = fit(_unit(x), w["n"])
    model = heads.sparkSession.sparkContext.broadcast(forests)
    columns = ["width", "leaf", "vec_id", "copies", "room", "vector"]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby("width"):
                at, leaf, room = model.value[width].leaves(_unit(_matrix(list(part["vector"]), kind)))
                yield part.iloc[at].assign(leaf=leaf, room=room)[columns]

    def refit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Medians of the levels below a leaf in order of levels, or no levels where it shall stay."""
        width, leaf = (int(k) for k in key)
        unit = _unit(_matrix(list(group.sort_values("vec_id")["vector"]), kind))
        forest, tree, root = model.value[width], leaf >> 48, leaf & ((1 << 48) - 1)
        links = (unit @ unit.T >= threshold).sum() - len(unit)
        wanted = int(np.ceil(np.log2(group["n"].iloc[0] / full)))
        levels = min(wanted, supported(len(unit)), DEEPEST + 1 - root.bit_length())
        if links >= DENSE * len(unit) * (len(unit) - 1):
            levels = 0
        medians, node = [], np.full(len(unit), root, np.int64)
        for level in range(levels):
            at, first = forest.project(tree, node, unit), root << level
            middle = np.array([np.median(at[node == first + i]) if (node == first + i).any() else 0.0 for i in range(1 << level)])
            medians.append(middle)
            node = 2 * node + (at > middle[node - first])
        stored = np.concatenate(medians).astype("<f8").tobytes() if levels else None
        return pd.DataFrame({"width": [width], "leaf": [leaf], "levels": [levels], "medians": [stored]})

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (width, tree, levels), part in batch.groupby(["width", batch["leaf"].to_numpy() >> 48, "levels"]):
                root = part["leaf"].to_numpy() & ((1 << 48) - 1)
                known, first = np.unique(root, return_index=True)
                medians = _matrix(list(part["medians"].iloc[first]), "<f8")

                def below(node: np.ndarray, level: int, known: np.ndarray = known, medians: np.ndarray = medians) -> np.ndarray:
                    above = node >> level
                    return medians[np.searchsorted(known, above), node - (above << level) + (1 << level) - 1]

                unit = _unit(_matrix(list(part["vector"]), kind))
                at, node, room = model.value[width].descend(tree, root, unit, part["room"].to_numpy(), levels, below)
                yield part.iloc[at].assign(leaf=node + (tree << 48), room=room)[columns]

    keys = ["width", "leaf"]
    routed = scratch.put(heads.mapInPandas(route, ROUTED))
    done = []
    while True:
        depth = F.length(F.bin(F.col("leaf").bitwiseAND(F.lit((1 << 48) - 1)))) - 1
        crowded = routed.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > full) & (depth < DEEPEST))
        # the scramble is not that of the first sample, so that a leaf's own sample is a fresh one
        lot = F.pmod(F.xxhash64("vec_id", "leaf"), F.lit(1 << 40)) < F.lit(float(RESAMPLE << 40)) / F.col("n")
        drawn = routed.join(scratch.put(crowded), keys).where(lot)
        splits = scratch.put(drawn.select(*keys, "vec_id", "vector", "n").groupBy(*keys).applyInPandas(refit, SPLITS)).where("levels > 0")
        if splits.isEmpty():
            break
        done.append(routed.join(splits, keys, "left_anti"))
        routed = scratch.put(routed.join(splits, keys).mapInPandas(descend, ROUTED))
        scratch.release()
    for part in done:
        routed = routed.unionByName(part)
    return routed


def near_vectors(vectors: DataFrame, threshold: float = 0.9, sample: int = SAMPLE, full: int = FULL) -> DataFrame:
    """Link vectors with a cosine of at least ``threshold``, over all rows.

    ``vectors`` has ``vec_id`` and ``embedding`` (an array of floats or doubles); other columns
    are ignored. Returns vec_id, n_links, component_id, kept. Null, empty or zero vectors and
    those with null or non-finite components link with nothing; rows without a vec_id likewise,
    with a null component. Vectors of different dimensions link with nothing. Of several vectors
    with a vec_id the one whose key comes first stands for all. An empty table gives no rows. Links
    below the threshold are never returned; a few above it can be missed. Leaves of more than
    ``full`` vectors are split again, but for those that are full of links.
    """
    scratch = Scratch(vectors.sparkSession, "forest")
    kind = "<f8" if isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType) else "<f4"

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, stored = [], []
            for v in batch.column("embedding").to_pylist():
                x = np.array([np.nan if c is None else c for c in v], kind) if v else None
                ok = x is not None and np.isfinite(x).all() and x.any()
                x = x + 0 if ok else None  # -0.0 is 0.0
                keys.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else None)
                stored.append(x.tobytes() if ok else None)
            arrays = [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(stored, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "vec_key", "vector"])

    rows = scratch.put(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(prepare, PREPARED))
    usable = rows.where("vec_key IS NOT NULL AND vec_id IS NOT NULL")
    chosen = scratch.put(usable.groupBy("vec_id").agg(F.min("vec_key").alias("vec_key")))
    classes = scratch.put(chosen.groupBy("vec_key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    heads = usable.join(classes, ["vec_key", "vec_id"]).dropDuplicates(["vec_id"])
    heads = scratch.put(heads.select("vec_id", "copies", F.length("vector").alias("width"), "vector"))
    routed = forest_leaves(heads, kind, threshold, sample, full, scratch)
    sizes = scratch.put(
        routed.groupBy("width", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    )
    of_vector = scratch.put(routed.groupBy("vec_id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")))
    one = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = (
        routed.drop("room")
        .join(of_vector, "vec_id")
        .join(sizes, ["width", "leaf"])
        .withColumn("mine", one)
        .withColumn("other", F.explode(numbers))
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
        .drop("blocks", "other")
    )

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, leaf, i, j = key
        group = group.sort_values("vec_id").reset_index(drop=True)
        x = _matrix(list(group["vector"]), kind)
        x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
        norm = np.linalg.norm(x, axis=1)
        ids, copies = group["vec_id"].to_numpy(), group["copies"].to_numpy()
        mine = group["mine"].to_numpy()
        leaves = _by_tree(list(group["leaves"]))
        counted, all_a, all_b = np.zeros(len(ids), np.int64), [], []
        for at in range(0, len(ids), BLOCK):
            dots = x[at : at + BLOCK] @ x.T
            cosine = dots / norm[at : at + BLOCK, None] / norm[None, :]
            a, b = np.nonzero(cosine >= threshold)
            a = a + at
            keep = (a < b) & ((mine[a] != mine[b]) if i != j else True)
            a, b = a[keep], b[keep]
            all_a.append(a)
            all_b.append(b)
            for part in range(0, len(a), 65_536):
                pa, pb = a[part : part + 65_536], b[part : part + 65_536]
                fresh = np.ones(len(pa), bool)
                for tree in range((leaf >> 48) + 1):
                    la, lb = leaves[pa, tree], leaves[pb, tree]
                    same = (la[:, :, None] == lb[:, None, :]) & (la >= 0)[:, :, None]
                    if tree == leaf >> 48:
                        same &= (la < leaf)[:, :, None]
                    fresh &= ~same.any(axis=(1, 2))
                counted += np.bincount(pa[fresh], weights=copies[pb[fresh]], minlength=len(ids)).astype(np.int64)
                counted += np.bincount(pb[fresh], weights=copies[pa[fresh]], minlength=len(ids)).astype(np.int64)
        a, b = np.concatenate(all_a), np.concatenate(all_b)
        label = _local_components(len(ids), a, b)
        linked = np.zeros(len(ids), bool)
        linked[a] = linked[b] = True
        return pd.DataFrame({"src": ids[linked], "dst": ids[label[linked]], "n": counted[linked]})

    found = scratch.put(dealt.groupBy("width", "leaf", "i", "j").applyInPandas(compare, "src long, dst long, n long"))
    scratch.drop(sizes, of_vector)
    scratch.release()
    labels = components(found, scratch).withColumnRenamed("id", "head")
    counts = found.groupBy(F.col("src").alias("head")).agg(F.sum("n").alias("n"))
    classes = classes.withColumnRenamed("vec_id", "head")
    told = chosen.join(classes, "vec_key").join(counts, "head", "left").join(labels, "head", "left").drop("vec_key")
    component = F.coalesce("component", "head", "vec_id")
    can_link = rows.select("vec_id", F.col("vec_key").isNotNull().alias("usable"))
    return can_link.join(scratch.put(told), "vec_id", "left").select(
        "vec_id",
        F.when(F.col("usable"), F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("usable"), component).otherwise(F.col("vec_id")).alias("component_id"),
        F.coalesce(~F.col("usable") | (F.col("vec_id") == component), F.lit(True)).alias("kept"),
    )
