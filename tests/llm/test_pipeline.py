"""The pipeline, stage by stage, against a plain version of each."""

import random
from itertools import pairwise

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RUDE = [f"rude{i}xyz" for i in range(6)]


def corpus(seed=8):
    """Documents with toxic ones, repeated and similar lines, near copies; and labels."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(3, 9))) for _ in range(700)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(8, 30)))
    shared = [line() for _ in range(12)]
    texts = []
    for i in range(420):
        lines = [line() for _ in range(rng.randrange(1, 5))]
        if i % 5 == 0:
            x = rng.choice(shared)
            at = rng.randrange(len(x))
            lines.append(rng.choice([x, x.upper(), x[:at] + "q" + x[at:]]))
        if i % 4 == 1:
            lines.append(" ".join(rng.sample(RUDE, 3)) + " " + line())
        texts.append("\n".join(lines))
    long = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(8)]
    for x in long:
        copy = x.split(" ")
        copy[rng.randrange(len(copy))] = "changed"
        texts += [x, "\n".join([" ".join(copy[:150]), " ".join(copy[150:])])]
    texts += [None, "", texts[0]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(any(w in (t or "") for w in RUDE))) for i, t in enumerate(texts[:400])]
    return rows, labels


def united(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def plain_line_dedup(docs):
    """``doc_id -> text`` after the stage."""
    places = [(i, p, x.strip(" ").lower()) for i, t in sorted(docs.items()) for p, x in enumerate((t or "").split("\n"))]
    places = [x for x in places if len(x[2]) >= 20]
    lines = sorted({x for *_, x in places})
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    label = united(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if similar(sets[i], sets[j])])
    seen, gone = set(), set()
    for i, p, x in places:
        c = label[lines.index(x)]
        (gone.add((i, p)) if c in seen else seen.add(c))
    out = {}
    for i, t in docs.items():
        left = t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        if not any(i == d for d, _ in gone) or left.strip():
            out[i] = left
    return out


def plain_near_dedup(docs):
    ids = sorted(docs)
    w = [(docs[i] or "").lower().split() for i in ids]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in w]
    label = united(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if similar(sets[i], sets[j])])
    return {i: docs[i] for k, i in enumerate(ids) if label[k] == k}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, (rows, labels) = str(tmp_path_factory.mktemp("corpus")), corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_and_run_equal_the_plain_version(spark, folder):
    path, rows = folder
    docs, texts = spark.read.parquet(f"{path}/documents.parquet"), {i: t for i, t, *_ in rows}
    clean = corpus_pipeline.toxicity(spark, docs, path)
    assert clean.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert kept == {i: t for i, t in texts.items() if not any(w in (t or "") for w in RUDE)}

    lines = corpus_pipeline.line_dedup(spark, spark.createDataFrame([r for r in rows if r[0] in kept], SCHEMA), path)
    assert lines.columns == docs.columns
    found, want = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}, plain_line_dedup(kept)
    assert found == {i: (t, len(t or "")) for i, t in want.items()}

    near = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", n) for i, (t, n) in found.items()], SCHEMA), path)
    assert near.columns == docs.columns
    last = {r["doc_id"]: r["text"] for r in near.collect()}
    assert last == plain_near_dedup(want) and len(last) < len(want)

    pieces = {}
    for r in corpus_pipeline.run(spark, path).collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert set(pieces) == set(last)
    for mine in pieces.values():
        mine.sort()
        assert all(a[1] + a[2] == b[1] for a, b in pairwise(mine)) and mine[0][1] == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_odd_tables(spark, folder, stage):
    path, _ = folder
    run = corpus_pipeline.STAGES[stage][1]
    rows = [(None, "same words here again and again", "en", "s", 31, "a"), (2**60 + 1, None, None, None, None, "b"), (1005, "", "en", "s", 0, "c"), (1005, "", "en", "s", 0, "c"), (1006, "long words " * 50_000, "en", "s", 9, "d")]
    docs = spark.createDataFrame(rows, SCHEMA + ", removed string")
    out = run(spark, docs, path)
    got = out.collect()
    assert {r["doc_id"] for r in got} == {None, 2**60 + 1, 1005, 1006}
    if stage < 3:
        assert out.columns == docs.columns and len(got) == 5
    assert run(spark, docs.limit(0), path).count() == 0


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None
