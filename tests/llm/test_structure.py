"""Conversation repair, the Merkle manifest and compression bands against brute force."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tracegrid.llm import op11_conversations as op11, op12_manifest as op12, op13_compression as op13

CONVERSATIONS = "conv_id long, turn long, role string, text string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def hashed(text):
    return sha256(text.encode()).hexdigest()


# conversations


def plain_damage(rows):
    out = []
    shown = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = shown(role), shown(text)
        fate = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))


def plain_repair(rows):
    """Row by row: the least (cost, audit) of each state, inserts relaxed until nothing gets better."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    rows = plain_damage(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def better(best, state, cost, audit):
        if state not in best or (cost, audit) < best[state]:
            best[state] = cost, audit
            return True

    def inserted(best):
        again = True
        while again:
            again = False
            for state, (cost, audit) in list(best.items()):
                for r in "ua":
                    if (state, r) in step:
                        again |= bool(better(best, step[state, r], cost + 5, audit + "I"))
        return best

    best = inserted({"": (0, "")})
    for (_, role, _), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit) in best.items():
            better(after, state, cost + 2, audit + "D")
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                for letter, r, price in [("K", role[:1], 0), ("R", "u", 1), ("R", "a", 1)]:
                    if (state, r) in step:
                        better(after, step[state, r], cost + price + more, audit + letter)
        best = inserted(after)
    cost, audit = min(best[s] for s in ("", "a") if s in best)
    kept, state, left = [], "", iter(rows)
    for letter in audit:
        other = "assistant" if state == "u" else "user"
        role, text = (other, "") if letter == "I" else next(left)[1:]
        if letter == "D":
            continue
        role = other if letter == "R" else role
        kept.append(f"{role}:{text}")
        state = step[state, role[0]]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = Counter(faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashed("\n".join(kept))


def plain_conversations(rows):
    by_conversation = {}
    for r in rows:
        by_conversation.setdefault(r[0], []).append(r)
    return {k: plain_repair(v) for k, v in by_conversation.items()}


def made_conversations(n, rows, rng):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "open end", "", " \t\n", "Why?  \n", None, "ok.", "é.", "(done.)", "a b c.", "stop. more", "x" * 50 + "."]
    turns = lambda: rng.choice([None, *range(rows * 2)])
    return [(c, turns(), rng.choice(roles), rng.choice(texts)) for c in [None, *range(n)] for _ in range(rng.randrange(1, rows))]


def got_conversations(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_repair_against_brute_force(spark):
    rows = made_conversations(300, 12, random.Random(11))
    rows += [(1000, t, "user", "Hello.") for t in range(3)] * 2 + [(2**60, -(2**62), "assistant", "Far."), (2**60, 2**62, "user", "Farther.")]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("digest", F.lit(1)).withColumn("n", F.lit("x")).withColumn("audit", F.lit(None))
    got = got_conversations(op11.repaired(df.repartition(7)))
    assert got == plain_conversations(rows)


def test_one_long_conversation_is_searched_in_segments(spark):
    rng = random.Random(12)
    roles, texts = ["user", "assistant", "assistant", "tool"], ["Yes.", "open end", "No."]
    rows = [(7, t, rng.choice(roles), f"{t} {rng.choice(texts)}") for t in range(12_000)] + [(8, 1, "user", "Only.")]
    rows += [(9, 5, "tool", "Same.")] * 1500
    got = got_conversations(op11.repaired(spark.createDataFrame(rows, CONVERSATIONS)))
    assert got == plain_conversations(rows)


def test_repair_of_nothing(spark):
    assert op11.repaired(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = op11.repaired(spark.createDataFrame([(dropped, 0, "user", "Gone.")], CONVERSATIONS)).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashed(""))


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_segments_give_what_the_whole_gives(size):
    rng = random.Random(size)
    for _ in range(40):
        rows = [(rng.choice("suat"), rng.choice([op11.SOUND, op11.SOUND, op11.BLANK, op11.TRUNCATED])) for _ in range(rng.randrange(1, 30))]
        whole = op11.all_ways(len(rows), op11.row_edges(rows), True)
        cut = [{"ways": op11.all_ways(len(x), op11.row_edges(x), False)} for x in (rows[i : i + size] for i in range(0, len(rows), size))]
        assert op11.all_ways(len(cut), op11.segment_edges(cut), True) == whole


# manifest


def plain_manifest(rows):
    def h(*parts):
        return hashed("".join(parts))

    def enc(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(doc_id, text, lang, source, n_chars):
        return h(*map(enc, (doc_id, source, lang, n_chars, text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, i):
        for nodes in levels[:-1]:
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            yield run[: i % 16], run[i % 16 + 1 :]
            i //= 16

    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {s: tree([leaf(*r) for r in by_source[s]]) for s in sources}
    roots = tree([trees[s][-1][0] for s in sources])
    root, out = roots[-1][0], []
    for k, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            steps = [*way(trees[s], i), *way(roots, k)]
            changed = r
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                changed = (r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:])
            folded = leaf(*changed)
            for left, right in steps:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in steps for x in left + right))
            out.append((r[0], leaf(*r), trees[s][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def made_documents(counts, rng):
    rows = [(None, "lost", None, "s1", 4), (5, None, None, None, None), (5, "", "en", None, 0)]
    for source, n in counts.items():
        rows += [(rng.randrange(10 * n + 10), rng.choice(["Tall Äpfel", "flat", "", None, "A\n" * 9]), "en", source, rng.choice([None, 7])) for _ in range(n)]
    return rows


def test_manifest_against_brute_force(spark):
    rng = random.Random(1)
    rows = made_documents({f"s{i}": i for i in range(40)} | {"hot": 5000, "Z": 256, "é": 257, "": 4096}, rng)
    df = spark.createDataFrame(rows, DOCUMENTS).withColumn("leaf", F.lit(1)).withColumn("key", F.lit(1)).withColumn("index", F.lit(0))
    got = sorted((tuple(r) for r in op12.verified(df.repartition(9)).collect()), key=str)
    assert got == plain_manifest(rows)


@pytest.mark.parametrize("counts", [{}, {"one": 1}, {"two": 17}])
def test_small_manifests(spark, counts):
    rows = [(i, f"Text {i}", "en", s, 6) for s, n in counts.items() for i in range(n)]
    got = sorted((tuple(r) for r in op12.verified(spark.createDataFrame(rows, DOCUMENTS)).collect()), key=str)
    assert got == (plain_manifest(rows) if rows else [])


@pytest.mark.parametrize("seed", range(6))
def test_stacks_of_any_split_give_the_same_nodes(spark, seed):
    """Runs that begin and end anywhere complete what they can; all the rest is loose, once."""
    rng = random.Random(seed)
    total = rng.choice([1, 2, 16, 17, 255, 256, 300, 4097])
    leaves = [sha256(bytes([i % 251, seed])).digest() for i in range(total)]
    cuts = sorted({0, total, *(rng.randrange(total + 1) for _ in range(rng.randrange(12)))})
    found = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        stack = op12.Stack("k", total, found)
        for i in range(a, b):
            stack.push(i, leaves[i])
        stack.close()
    whole = []
    stack = op12.Stack("k", total, whole)
    for i, x in enumerate(leaves):
        stack.push(i, x)
    stack.close()
    want = {r[2:4]: r[4] for r in whole}
    assert not any(r[5] for r in whole) and len(want) == len(whole)
    done = [r for r in found if not r[5]]
    assert all(want[r[2:4]] == r[4] for r in done) and len({r[2:4] for r in done}) == len(done)
    parents = {(r[2] + 1, r[3] // 16) for r in found if r[5]}
    missing = set(want) - {r[2:4] for r in done}
    assert {p for p in parents if p in want} <= missing | set()
    assert all(p[0] > 1 or p in parents for p in missing)


# quality rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeats = len(words), len(covered)
    failed = n < 50 or 100 * repeats > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeats, failed


def test_counts_against_brute_force(spark):
    rng = random.Random(13)
    alphabet = ["a", "b", "c", "dé", "#", "<x>", "𝄞", " ", "\x1c", "\x85"]
    texts = [None, "", " ", "\n\n", "a", "a a a a", "x y z x y z", "line\nline\n line\nline\r\nline\r"]
    texts += ["".join(rng.choice(alphabet) + rng.choice([" ", "\n", "\t", " ", "  "]) for _ in range(rng.randrange(200))) for _ in range(200)]
    texts += [" ".join(str(rng.randrange(40)) for _ in range(3000)), "word " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id"), (3, "\n\n")], "doc_id long, text string").withColumn("n_words", F.lit(0))
    rows = op13.quality_rules(df).collect()
    got = sorted((tuple(r)[:7] for r in rows), key=str)
    want = sorted([(i, *plain_counts(t)) for i, t in [*enumerate(texts), (None, "no id"), (3, "\n\n")]], key=str)
    assert got == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert op13.quality_rules(df.where("false")).collect() == []


def test_many_distinct_words_are_numbered_exactly():
    words = [str(i).encode() for i in range(3_000_000)]
    assert op13.repeated_words(words) == 0
    assert op13.repeated_words([*words, *words[:3]]) == 6


def test_bands(spark):
    """Prose is kept; texts that repeat or hold noise go, also where only some chunks do."""
    rng = random.Random(3)
    lexicon = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    prose = lambda n: " ".join(lexicon[int(3000 * rng.random() ** 3)] for _ in range(n))
    noise = lambda n: " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(60)) for _ in range(n))
    slogan = lambda n: " ".join(f"buy now cheap number {i % 7}" for i in range(n))
    kept = [prose(n) for n in (60, 150, 400, 1000, 3000, 20_000)]
    gone = [slogan(40), slogan(3000), noise(60), noise(400), prose(3000) + noise(300), prose(1000) + " " + " ".join(f"{i % 9}" for i in range(8000))]
    rows = op13.quality_rules(spark.createDataFrame(list(enumerate(kept + gone)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True] * len(kept) + [False] * len(gone)
    assert all(0 < r["ratio"] < 1.3 and r["n_chunks"] >= 1 for r in rows)
