"""Near copies of documents, vectors and lines, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import components as cc, op03_minhash as op3, op04_vector_forest as op4, op07_lines as op7, stars
from tracegrid.llm.scratch import Scratch


def united(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 200)
    pairs = {
        "path": list(zip(names, names[1:], strict=False)),
        "star": [(names[0], x) for x in names[1:]],
        "random": [(rng.choice(names), rng.choice(names)) for _ in range(150)],
        "none": [(names[0], names[0])],
    }[shape]
    links = spark.createDataFrame([*pairs, (None, 1)], "src long, dst long")
    got = {r["id"]: r["component"] for r in cc.components(links, Scratch(spark, "t")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    want = united(names, pairs)
    assert got == {x: want[x] for x in linked}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def family_texts(seed=7):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    texts = []
    for size in (8, 30, 90, 200):
        base = [word() for _ in range(size)]
        texts += [" ".join(base)] + [" ".join(mutated(rng, base, rng.randrange(1, max(2, size // 14)))) for _ in range(12)]
        drift = base
        for _ in range(6):  # a chain of copies of copies
            drift = mutated(rng, drift, max(1, size // 40))
            texts.append(" ".join(drift))
        texts += [" ".join(base[: int(size * x)]) for x in (0.9, 0.75, 0.7, 0.6, 0.55)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), texts[0].replace(" ", "\n\t"), "", " \n", None, "One", "one", "one two", "é É"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    texts = family_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in op3.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string"), k).collect()}
    sets = [shingles(t, k) for t in texts]
    pairs = [
        (i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    want = united(range(len(texts)), pairs)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_duplicates_odd_rows(spark):
    schema = "doc_id long, text string"
    assert op3.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "a b c d e"), (None, None)]
    got = op3.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [
        ("3", "3", True), ("3", "3", True), ("9", "3", False), ("None", "None", True), ("None", "None", True),
    ]


def test_rows_that_share_a_doc_id(spark):
    """Of one doc_id all texts have one component; without near copies rows go one by one."""
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(3, a, "en"), (5, a, "en"), (5, b, "en"), (8, b + " end", "de"), (9, c, "en"), (9, c, "en"), (9, c, "de"), (10, d, None), (10, None, None), (11, d, None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        got = op3.near_duplicates(docs).collect()
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["n_shingles"]} == {
            (3, 3, True), (5, 3, False), (8, 3, False), (9, 9, True), (10, 10, True), (11, 10, False),
        }
        assert len(got) == len(rows)
        kept = op3.without_near_duplicates(docs)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, a, "en"), (5, b, "en"), (9, c, "de"), (10, d, None), (10, None, None)], key=str)


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (16, 2, 2))
        x, y = (op3.signature(np.unique(np.concatenate([both, z]))) for z in (a, b))
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 0.8) < 0.03


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for size, spread in ((1, 0), (40, 0.02), (300, 0.05), (60, 0.3)):
        center = rng.standard_normal(32)
        out += list(center + spread * np.linalg.norm(center) / np.sqrt(32) * rng.standard_normal((size, 32)) * 5)
    out += list(rng.standard_normal((400, 32)))
    out += [out[0] * 3, out[1], out[1]]
    return [list(map(float, np.float32(v))) for v in out]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_against_brute_force(spark, kind):
    good = vectors()
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0, 2.0], [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(good + odd)]
    got = {r["vec_id"]: r for r in op4.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()}
    x = np.array(good)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[i]["n_links"] for i in range(len(good))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.98 * near.sum()
    want = united(range(len(good)), zip(*np.nonzero(near), strict=True))
    assert sum(got[i]["component_id"] != want[i] for i in want) <= 0.02 * len(want)
    n = len(good)
    assert [got[n + i]["n_links"] for i in range(7)] == [0, 0, 0, 0, 0, 1, 1] and got[n + 6]["component_id"] == n + 5
    assert op4.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_every_dimension_are_compared(spark):
    rng = np.random.default_rng(9)
    rows = []
    for dim, n in ((8, 900), (16, 700), (5, 40)):
        centers = rng.standard_normal((n // 20, dim))
        rows += [(c + 0.1 * rng.standard_normal(dim)).tolist() for c in np.repeat(centers, 20, axis=0)]
    rows += [[1e200] * 8, [1e200] * 7 + [1.1e200]]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in op4.near_vectors(frame).collect()}
    want, found = 0, 0
    for dim in (5, 8, 16):
        ids = [i for i, r in enumerate(rows) if len(r) == dim]
        x = np.array([rows[i] for i in ids])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = (x @ x.T >= 0.9).sum(axis=1) - 1
        n = np.array([got[i]["n_links"] for i in ids])
        assert (n <= near).all()
        want, found = want + near.sum(), found + n.sum()
        assert n.sum() >= 0.95 * near.sum()
    assert got[len(rows) - 1]["n_links"] >= 1


def clustered(n, dim, seed=21):
    """Loose clusters with near copies of some vectors."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((20, dim))[rng.integers(0, 20, n)] + 0.8 * rng.standard_normal((n, dim))
    near = rng.permutation(n)[: n // 2]
    x[near[::2]] = x[near[1::2]] + 0.35 * rng.standard_normal((n // 4, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_crowded_leaves_are_split_again(spark):
    """Deep trees: no leaf stays too full, each vector keeps its copies, and near pairs still meet."""
    x, full = clustered(40_000, 32).astype("<f4"), 70
    heads = spark.createDataFrame([(i, 1, 128, v.tobytes()) for i, v in enumerate(x)], "vec_id long, copies long, width int, vector binary")
    leaves = op4.forest_leaves(heads, "<f4", 0.9, 2048, full, Scratch(spark, "t")).select("leaf", "vec_id").toPandas()
    sizes = leaves.groupby("leaf").size()
    depth = [(int(k) & ((1 << 48) - 1)).bit_length() - 1 for k in sizes.index]
    assert sizes.max() <= full and max(depth) >= 12 and np.average(depth, weights=sizes) > 10
    assert not leaves.duplicated().any() and leaves["vec_id"].nunique() == len(x)
    assert leaves.groupby(["vec_id", leaves["leaf"] // (1 << 48)]).size().between(1, op4.COPIES).all()
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    of = leaves.groupby("vec_id")["leaf"].agg(set).sort_index().to_list()
    near = [(i + a, b) for i in range(0, len(x), 2000) for a, b in np.argwhere(x[i : i + 2000] @ x.T >= 0.9) if i + a < b]
    met = sum(not of[a].isdisjoint(of[b]) for a, b in near)
    print("recall", met / len(near), "of", len(near), "mean depth", np.average(depth, weights=sizes), "deepest", max(depth), "leaves", len(sizes))
    assert len(near) > 2500 and met >= 0.9 * len(near), met / len(near)


def test_links_are_counted_once_in_split_leaves(spark):
    x = clustered(3000, 16)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = op4.near_vectors(frame, sample=256, full=200).toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert (got <= near).all() and got.sum() >= 0.95 * near.sum() > 0


def test_leaves_full_of_links_stay_whole(spark):
    """A large group of near copies is compared whole, whatever the bound of a leaf."""
    rng = np.random.default_rng(5)
    x = np.ones((600, 16)) + 0.05 * rng.standard_normal((600, 16))
    x = np.concatenate([x, rng.standard_normal((600, 16))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = op4.near_vectors(frame, full=64).toPandas().set_index("vec_id").sort_index()
    assert (got["n_links"][:600] >= 599).all() and (got["component_id"][:600] == 0).all()


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (2**60 + 1, None), (None, [1.0, 0.0])]
    schema = "vec_id long, embedding array<double>, vec_key string"
    runs = [sorted(map(str, op4.near_vectors(spark.createDataFrame([(*r, "x") for r in x], schema)).collect())) for x in (rows, rows[::-1])]
    assert runs[0] == runs[1] and len(runs[0]) == 6 and str(2**60 + 1) in runs[0][-1] + "".join(runs[0])


def line_texts():
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 30)))
    base = [line() for _ in range(40)]
    texts = []
    for _ in range(60):
        lines = [line() for _ in range(rng.randrange(0, 4))]
        for x in rng.sample(base, rng.randrange(0, 4)):
            at = rng.randrange(len(x))
            lines.append(rng.choice([x, x.upper(), f"  {x} ", x[:at] + "q" + x[at:]]))
        rng.shuffle(lines)
        texts.append("\n".join([*lines, rng.choice(["", "short", base[0]])]))
    return [*texts, None, "", "\n", base[1], base[1], f"{base[2]}\n{base[2]}\nend"]


def test_dedup_lines_against_brute_force(spark):
    texts = line_texts()
    rows = [(i, t, "s", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rid long")
    got = {r["doc_id"]: r for r in op7.dedup_lines(docs).collect()}
    places = [(i, p, x.strip(" ").lower()) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n"))]
    places = [x for x in places if len(x[2]) >= op7.MIN_CHARS]
    lines = sorted({x for _, _, x in places})
    sets = {x: {x[i : i + 5] for i in range(len(x) - 4)} for x in lines}
    pairs = [(i, j) for i, x in enumerate(lines) for j, y in enumerate(lines[:i]) if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    label = united(range(len(lines)), pairs)
    seen, gone = set(), set()
    for i, p, x in sorted(places):
        c = label[lines.index(x)]
        if c in seen:
            gone.add((i, p))
        seen.add(c)
    wrong = 0
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        wrong += got[i]["text"] != want
        assert got[i]["source"] == "s" and got[i]["n_lines"] == (0 if t is None else t.count("\n") + 1)
    assert wrong <= 1, wrong  # banding may miss a pair near the threshold
    assert op7.dedup_lines(docs.limit(0)).count() == 0


def edited(rng, line):
    """A copy with one to some characters or words changed."""
    out = list(line)
    for _ in range(rng.randrange(1, max(2, len(line) // 38))):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([["q"], [out[at], "q"], [], list(" added ")])
    return "".join(out).strip(" ")


@pytest.mark.parametrize("spaces", [True, False])
def test_similar_lines_share_a_bucket_at_every_length(spark, spaces):
    rng = random.Random(11)
    pairs = []
    for low, high in ((20, 29), (30, 44), (45, 69), (70, 119), (120, 249), (250, 600)):
        for _ in range(300):
            n = rng.randrange(low, high + 1)
            x = "".join(rng.choice("abcdefghijklmnopqrstuvw" + "     " * spaces) for _ in range(n)).strip().ljust(n, "z")
            y = edited(rng, x)
            a, b = ({z[i : i + op7.SHINGLE] for i in range(len(z) - op7.SHINGLE + 1)} for z in (x, y))
            if len(y) >= op7.MIN_CHARS and 100 * len(a & b) >= 80 * len(a | b):
                pairs.append((low, x, y))
    frame = spark.createDataFrame(pairs, "low int, x string, y string")
    found = frame.select("low", F.arrays_overlap(F.expr(op7._bands("x")), F.expr(op7._bands("y"))).alias("ok"))
    recall = {r["low"]: (r["share"], r["n"]) for r in found.groupBy("low").agg(F.avg(F.col("ok").cast("int")).alias("share"), F.count("*").alias("n")).collect()}
    assert len(recall) == 6 and all(share >= 0.95 and n > 20 for share, n in recall.values()), recall


def test_lines_behind_a_center_are_linked(spark):
    """Copies of copies: neighbours of a chain are similar, its ends are not."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(3, 9)))
    lines = []
    for _ in range(8):
        words = [word() for _ in range(50)]
        for at in range(20):
            words[at * 2] = word()
            lines.append(" ".join(words))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    removed = op7.dedup_lines(docs).agg(F.sum("n_removed")).head()[0]
    assert removed == 8 * 19


@pytest.mark.parametrize("mixed", [False, True])
def test_no_link_behind_a_center_is_dropped(spark, mixed):
    """Sets of all sizes within, beside and beyond a center's set; some may be in its component."""
    rng = random.Random(17)
    center, sets = set(range(120)), []
    for _ in range(60):
        inside, beyond = rng.choice([5, 20, 60, 100, 118]), rng.choice([0, 1, 6, 30, 90])
        x = set(rng.sample(sorted(center), inside)) | set(rng.sample(range(1000, 1000 + rng.choice([100, 400])), beyond))
        sets.append(x)
        for _ in range(3):
            y = {v for v in x if rng.random() > 0.08} | set(rng.sample(range(2000, 2400), rng.randrange(0, 3 + len(x) // 12)))
            sets.append(y or x)
    of_center = [mixed and 100 * len(x & center) >= 80 * len(x | center) for x in sets]
    label = [-1 if near else i for i, near in enumerate(of_center)]
    rows = [(-1, i, label[i], not of_center[i], len(x), len(x & center)) for i, x in enumerate(sets)]
    inner = spark.createDataFrame(rows, "center long, id long, label long, apart boolean, n long, u long")
    rest = spark.createDataFrame([(i, v) for i, x in enumerate(sets) for v in x - center], "b long, shingle long")
    got = stars.pairs_behind_center(inner, lambda pairs: pairs.join(rest, "b").select("a", "b", "shingle"), 80, Scratch(spark, "t"))
    got = {(r["a"], r["b"]) for r in got.collect()}
    want = {(j, i) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if label[i] != label[j] and 100 * len(x & y) >= 80 * len(x | y)}
    assert len(want) > 80 and want <= got


@pytest.mark.parametrize("whole", [0, 10_000])
def test_one_bucket_of_all_lines_loses_no_link(spark, monkeypatch, whole):
    """Whatever shares a bucket with a link, by all pairs or behind the center: the links are those of brute force."""
    monkeypatch.setattr(op7, "_bands", lambda line: "array(1L)")
    monkeypatch.setattr(op7, "WHOLE", whole, raising=False)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 7)))
    common = " ".join(word() for _ in range(9))
    lines = []
    for i in range(45):
        x = " ".join([common] * (i % 3) + [word() for _ in range(rng.randrange(5, 14))])
        lines += [x, edited(rng, x), x + " " + word(), x[: len(x) * 5 // 6]]
    lines = sorted({x.strip(" ") for x in lines if len(x.strip(" ")) >= op7.MIN_CHARS}, key=lambda x: rng.random())
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = united(range(len(lines)), pairs)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"] for r in op7.dedup_lines(docs).where("n_removed > 0").collect()}
    assert got == {i for i in label if label[i] != i} and len(got) > 60


def test_few_lines_of_a_large_bucket_are_compared(spark, monkeypatch):
    """Long lines that all miss the limit with each other, near copies of some: pairs are told apart without their texts."""
    seen, links = [], op7._links
    monkeypatch.setattr(op7, "_bands", lambda line: "array(1L)")
    monkeypatch.setattr(op7, "_links", lambda pairs, texts: (seen.append(pairs.count()), links(pairs, texts))[1])
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 7)))
    base, lines = [word() for _ in range(100)], []
    for i in range(90):
        lines.append(" ".join(mutated(rng, base, 8)))
        if i % 3 == 0:
            lines.append(lines[-1] + " " + word())
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = united(range(len(lines)), pairs)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"] for r in op7.dedup_lines(docs).where("n_removed > 0").collect()}
    assert got == {i for i in label if label[i] != i} and len(got) >= 30
    assert sum(seen) < 10 * len(lines), seen


def test_dedup_lines_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (1, long, "a"), (2, long + " end", "b"), (None, long, "c"), (3, None, "d"), (None, None, "e"), (4, "", "f"),
        (5, "x" * 3000, "g"), (6, "x" * 50, "h"), (7, "same line, the same line", "i"), (7, "same line, the same line", "j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = {r["removed"]: r for r in op7.dedup_lines(docs).collect()}
    assert op7.dedup_lines(docs).columns == ["doc_id", "text", "removed", "n_lines", "n_removed"]
    assert {k: r["n_removed"] for k, r in got.items()} == dict(a=0, b=1, c=1, d=0, e=0, f=0, g=0, h=1, i=0, j=0)
    assert {k: r["n_lines"] for k, r in got.items()} == dict(a=1, b=1, c=1, d=0, e=0, f=1, g=1, h=1, i=1, j=1)
    assert got["d"]["text"] is None and got["b"]["text"] == "" and got["a"]["text"] == long
