"""BPE encoding and decoding by tree concatenation.

Short texts are encoded whole. A long one is cut at special tokens and then into leaves, which
Spark deals out over tasks; the leaves of a text meet again in one task, which joins neighbours
level by level (``bpe.Codec.join``). Long copies are encoded once.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bpe import DEFAULT_VOCABULARY, LEAF_CHARS, Codec, codec
from .scratch import Scratch

ENCODED = "ids array<int>, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_tree(code: Codec, text: str | None, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
    """The ids of one text, by joining leaves of ``leaf_chars`` characters."""
    out = [np.zeros(0, np.uint32)]
    for part, special in code.segments(text or ""):
        if special:
            out.append(np.array([code.special[part]], np.uint32))
        else:
            cuts = range(0, len(part), leaf_chars)
            out.append(code.join_all([code.leaf(part[i : i + leaf_chars]) for i in cuts]).ids)
    return np.concatenate(out)


def _digest(code: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    listed = ids.tolist()
    joined = ",".join(map(str, listed)).encode()
    decoded = code.encoding.decode_bytes(listed).decode("utf-8", "replace")
    return len(listed), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _whole(code: Codec, ids: np.ndarray) -> tuple[list[int], str]:
    return ids.tolist(), code.decode(ids)


def _run(docs: DataFrame, path: str, leaf_chars: int, finish, schema: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow.names
    is_long = F.length("text") > leaf_chars
    # a piece has at most four tokens a character
    step_kind = "<u2" if 4 * leaf_chars < 1 << 16 else "<u4"
    id_kind = lambda code: "<u2" if code.encoding.n_vocab <= 1 << 16 else "<u4"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            out = [finish(code, code.encode(t)) for t in batch.column("text").to_pylist()]
            columns = zip(*out, strict=True) if out else [()] * len(names)
            arrays = [pa.array(c, kind.type) for c, kind in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codec(path)
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                at, out = 0, []
                for run, (part, special) in enumerate(code.segments(text)):
                    step = len(part) if special else leaf_chars
                    for i in range(0, len(part), step):
                        out.append((key, at, run, special, part[i : i + step]))
                        at += 1
                yield pd.DataFrame(out, columns=["key", "at", "run", "special", "leaf"])

    def encode_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codec(path)
        for batch in batches:
            nodes = [code.leaf(x) if not s else None for x, s in zip(batch["leaf"], batch["special"], strict=True)]
            steps = lambda x, end: np.diff(x, append=end).astype(step_kind).tobytes()
            yield batch.assign(
                chars=[b"" if n is None else steps(n.starts, len(n.text)) for n in nodes],
                tokens=[b"" if n is None else steps(n.first, len(n.ids)) for n in nodes],
                ids=[b"" if n is None else n.ids.astype(id_kind(code)).tobytes() for n in nodes],
            )

    def join_leaves(group: pd.DataFrame) -> pd.DataFrame:
        from .bpe import Node

        code, out, runs = codec(path), [], {}
        for r in group.sort_values("at").itertuples():
            runs.setdefault(r.run, []).append(r)

        def firsts(steps: bytes) -> np.ndarray:
            x = np.frombuffer(steps, step_kind).astype(np.int64)
            return np.cumsum(x) - x

        for parts in runs.values():
            if parts[0].special:
                out.append(np.array([code.special[parts[0].leaf]], np.uint32))
            else:
                nodes = [
                    Node(p.leaf, firsts(p.chars), firsts(p.tokens), np.frombuffer(p.ids, id_kind(code)).astype(np.uint32))
                    for p in parts
                ]
                out.append(code.join_all(nodes).ids)
        done = finish(code, np.concatenate(out))
        return pd.DataFrame([(group["key"].iloc[0], *done)], columns=["key", *names])

    scratch = Scratch(docs.sparkSession, "bpe")
    long_docs = rows.where(is_long).withColumn("key", F.sha2("text", 256))
    owners = long_docs.select("doc_id", "key")
    leaf_rows = (
        long_docs.select("key", "text")
        .mapInPandas(leaves, "key string, at int, run int, special boolean, leaf string")
        .dropDuplicates(["key", "at"])
        .mapInPandas(
            encode_leaves,
            "key string, at int, run int, special boolean, leaf string, chars binary, tokens binary, ids binary",
        )
    )
    joined = scratch.put(leaf_rows.groupBy("key").applyInPandas(join_leaves, "key string, " + schema))
    return (
        rows.where(~is_long)
        .mapInArrow(short, "doc_id long, " + schema)
        .unionByName(owners.join(joined, "key").select("doc_id", *names))
    )


def encode(docs: DataFrame, path: str = DEFAULT_VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``docs``; null text counts as empty.

    Ids are those of the tokenizer file's library with add_special_tokens=False; ``decoded``
    keeps special tokens. Other columns are ignored; repeated rows stay.
    """
    return _run(docs, path, leaf_chars, _whole, ENCODED)


def encode_digests(docs: DataFrame, path: str = DEFAULT_VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """As ``encode``, but with digests in place of ids and text: ``doc_id, n_tokens,
    ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256``."""
    return _run(docs, path, leaf_chars, _digest, DIGESTS)
