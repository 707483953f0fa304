"""Token lengths, BPE trees and packing."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tracegrid.llm import op01_token_lengths as op1, op06_bpe as op6, op10_packing as op10
from tracegrid.llm.bpe import DEFAULT_VOCABULARY, codec

TEXTS = [
    "", " ", "\n\n", "Hello world's end  ", "a" * 50, "ab" * 400, "é日本 " * 40, "x <|endoftext|> y<|endoftext|>", "  indented\n\tcode = 1",
    "don't we'RE 'll", "1234567890" * 9, "   wide", "word " * 300,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(DEFAULT_VOCABULARY)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_codec_is_the_tokenizer(tokenizer):
    code = codec()
    for t in TEXTS:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert code.encode(t).tolist() == ids
        assert code.decode(np.array(ids, np.uint32)) == tokenizer.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from(["a", "b", "the ", "in", "'s", "'re", "'", " ", "  ", "\n", "é", "日", "1", "!", "ing", "r", "e", "ab", "zz", "<|endoftext|>"]), max_size=50),
    st.integers(1, 9),
)
def test_trees_join_to_the_encoding_of_the_whole(parts, leaf):
    text, code = "".join(parts), codec()
    assert op6.encode_tree(code, text, leaf).tolist() == code.encode(text).tolist()


def test_unsplit_text_joins_in_windows():
    code, text = codec(), "".join(random.Random(5).choice("abcdeinrst") for _ in range(20_000))
    assert op6.encode_tree(code, text, 1000).tolist() == code.encode(text).tolist()


@pytest.mark.parametrize("leaf_chars", [16_000, 30])
def test_encode_digests(spark, tokenizer, leaf_chars):
    texts = [*TEXTS, None, TEXTS[3], "long " * 50, "long " * 50]
    found = {r["doc_id"]: r for r in op6.encode_digests(docs_of(spark, texts), leaf_chars=leaf_chars).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_gives_ids_and_text(spark):
    row = op6.encode(docs_of(spark, ["a b"])).head()
    assert row["decoded"] == "a b" and row["ids"] == codec().encode("a b").tolist()
    assert op6.encode(docs_of(spark, [])).count() == 0


def test_lengths_and_limits(spark):
    texts = [*TEXTS, None, TEXTS[3]]
    n = sorted(len(codec().encode(t)) for t in texts)
    sums = op1.token_lengths(docs_of(spark, texts))
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert set(rows) == set(n)
    for limit, r in rows.items():
        assert r["n_docs"] == n.count(limit)
        assert r["docs_at_least"] == sum(x >= limit for x in n)
        assert r["tokens_at_least"] == sum(x for x in n if x >= limit)
        assert r["tokens_kept"] == sum(min(x, limit) for x in n)
        assert r["tokens_cut"] == sum(max(0, x - limit) for x in n)
        assert r["quantile"] == sum(x <= limit for x in n) / len(n)
    limits = [0, 1, 7, 100, 10**6]
    found = {r["limit"]: (r["docs_truncated"], r["tokens_kept"]) for r in op1.at_limits(sums, limits).collect()}
    assert found == {x: (sum(y > x for y in n), sum(min(x, y) for y in n)) for x in limits}
    shares = {r["share"]: r["n_tokens"] for r in op1.quantile_lengths(sums, [0.5, 1.0]).collect()}
    assert shares == {0.5: n[-(-len(n) // 2) - 1], 1.0: n[-1]}


def test_lengths_of_nothing(spark):
    sums = op1.token_lengths(docs_of(spark, []))
    assert sums.count() == 0 and op1.at_limits(sums, [5]).head()["tokens_kept"] == 0


def test_suffix_sums_do_not_depend_on_buckets(spark):
    hist = spark.createDataFrame([(x, x % 5 + 1) for x in range(0, 900, 7)], "n_tokens long, n_docs long")
    assert sorted(op1.suffix_sums(hist, 1).collect()) == sorted(op1.suffix_sums(hist, 4096).collect())


def check_packing(rows, texts, capacity):
    code, by_sequence = codec(), {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = np.append(code.encode(texts[r["doc_id"]]), np.uint32(2)).astype("<u4")[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and len(ids) == r["length"]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_covers_every_document(spark):
    texts = [*TEXTS, None, "word " * 2100, TEXTS[3]]
    rows = op10.pack(docs_of(spark, texts)).collect()
    check_packing(rows, texts, 1024)
    for i, t in enumerate(texts):
        mine = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        total = len(codec().encode(t)) + 1
        assert [p for p, _, _ in mine] == list(range(len(mine))) and sum(n for _, _, n in mine) == total
        assert len(mine) == -(-total // 1024)
        assert all(n == 1024 for _, _, n in mine[1:]) and [at for _, at, _ in mine] == [sum(n for _, _, n in mine[:k]) for k in range(len(mine))]


def test_packing_small_slots_and_repeated_rows(spark):
    texts = ["word " * (i % 40) for i in range(400)]
    twice = docs_of(spark, texts).unionAll(docs_of(spark, texts[:20]))
    rows = op10.pack(twice, capacity=64).collect()
    assert len(rows) == 420
    sequences = check_packing(rows, texts, 64)
    assert sequences <= 1.03 * -(-sum(r["length"] for r in rows) // 64) + 1


def test_cuts_leave_the_remainder_in_front():
    assert [op10.cuts(n, 8) for n in (1, 8, 9, 20)] == [[0, 1], [0, 8], [0, 1, 9], [0, 4, 12, 20]]


def test_packing_keeps_ids_that_doubles_cannot_hold(spark):
    rows = [(2**60 + 1, "a"), (None, ""), (None, None), (None, "")]
    got = op10.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 0, 2**60 + 1] and len({(r["sequence_id"], r["offset"]) for r in got}) == 4
    digests = op6.encode_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] or 0 for r in digests) == [0, 0, 0, 2**60 + 1]


def test_packing_without_documents(spark):
    assert op10.pack(docs_of(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plans_use_every_piece_once(histogram):
    plan = op10.make_plan(histogram, 64)
    filled = {}
    for length, n in histogram.items():
        run = np.searchsorted(plan.edges[length], np.arange(n), side="right") - 1
        for r, k in enumerate(run):
            sequence = plan.sequence[length][k] + r - plan.edges[length][k]
            filled.setdefault(int(sequence), []).append((int(plan.offset[length][k]), length))
    assert len(filled) == plan.sequences
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_patterns_with_room_left_are_used():
    """Few lengths of which none fill a sequence: 700 with 300, 400 twice, 350 with 330 twice, 350 twice."""
    assert op10.make_plan({700: 1000, 400: 1000, 300: 1000, 330: 500, 350: 500}).sequences <= 1875
    assert op10.make_plan({600: 300, 420: 300, 5: 100}).sequences == 301
    assert op10.make_plan({500: 10, 24: 5}).sequences == 5


def test_plans_are_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.geometric(0.003, 60_000), 1024)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    assert op10.make_plan(histogram).sequences <= 1.002 * lengths.sum() / 1024
