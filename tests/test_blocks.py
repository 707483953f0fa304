"""Operators whose pairs are many: pairs in blocks of a grid, whole and without a second look at them."""

import json
import random

import pytest

from tracegrid.operators import networks


@pytest.fixture
def small_blocks(monkeypatch):
    blocks = pytest.importorskip("tracegrid.operators.blocks")
    monkeypatch.setattr(blocks, "BLOCK", 7)
    monkeypatch.setattr(blocks, "PAIRS", 200)


def top(df):
    return df._jdf.queryExecution().optimizedPlan().nodeName()


def test_a_grid_makes_each_pair_once_in_tasks_of_like_size(spark, small_blocks, tmp_path):
    from pyspark.sql import functions as F

    from tracegrid.operators.blocks import block_join
    from tracegrid.plans.tables import Tables

    left = [(k, i) for k, n in (("hot", 150), ("wide", 3), ("high", 90), ("one", 1), (None, 9), ("left", 30)) for i in range(n)] + [("hot", 0)]
    right = [(k, i) for k, n in (("hot", 80), ("wide", 200), ("high", 2), ("one", 1), (None, 9), ("right", 30)) for i in range(n)]
    tables = Tables(spark, "test")
    a, b = tables.put(spark.createDataFrame(left, "k string, a int")), tables.put(spark.createDataFrame(right, "k string, b int"))
    pairs = block_join(a, b, ["k"], tables)
    got = sorted(tuple(r) for r in pairs.select("k", "a", "b").collect())
    assert got == sorted((k, i, j) for k, i in left for m, j in right if k is not None and k == m)
    tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(tasks) < len(got) / 10


def test_pods_told_several_times_are_selected_once(spark, small_blocks):
    rng, documents = random.Random(5), []
    for i in range(260):
        name = f"p{rng.randrange(200)}"
        labels = {"all": "x", "app": f"a{i % 2}"} | ({"tier": f"t{i % 3}"} if i % 4 else {}) | ({"own": f"o{i}"} if i % 10 == 0 else {})
        documents.append(("Pod", f"n{i % 2}", name, None if i % 50 == 7 else labels))
    for i in range(120):
        selector = [{"all": "x"}, {"app": f"a{i % 2}"}, {"app": "a1", "tier": f"t{i % 4}"}, {"own": f"o{i}"}, {}, {"all": None}, {"app": "a0", "gone": "x"}][rng.randrange(7)]
        documents.append(("Service", f"n{i % 2}", f"s{rng.randrange(80)}", selector))
    text = [
        (str(i), json.dumps({"kind": kind, "metadata": {"namespace": space, "name": name, **({"labels": x} if kind == "Pod" else {})}, "spec": {"selector": x} if kind == "Service" else {"nodeName": "m"}}))
        for i, (kind, space, name, x) in enumerate(documents)
    ]
    rows = spark.createDataFrame(text, "id string, document string")
    edges = [tuple(r) for r in networks.resource_edges(networks.resources(rows)).select("source_id", "relation", "target_id", "detail").collect()]
    want = {
        (f"Service/{a[1]}/{a[2]}", "selects", f"Pod/{b[1]}/{b[2]}", "")
        for a in documents for b in documents
        if a[0] == "Service" and b[0] == "Pod" and a[1] == b[1] and a[3] and b[3] and all(v is not None and b[3].get(k) == v for k, v in a[3].items())
    }
    want |= {(f"Pod/{s}/{n}", "runs_on", "Machine/m", "") for kind, s, n, _ in documents if kind == "Pod"}
    assert sorted(edges) == sorted(want)


def test_edges_of_pods_with_one_set_of_labels_are_not_compared(spark):
    pod = '{"kind":"Pod","metadata":{"name":"p%d","labels":{"app":"x"}}}'
    service = '{"kind":"Service","metadata":{"name":"s%d"},"spec":{"selector":{"app":"x"}}}'
    rows = spark.createDataFrame([(f"{t[9:12]}{i}", t % i) for t in (pod, service) for i in range(20)], "id string, document string")
    edges = networks.resource_edges(networks.resources(rows))
    assert edges.count() == 400
    assert top(edges) != "Aggregate"


def rule(*conditions):
    from tracegrid.operators import rules

    return rules.Rule("r", "A", "N", "strong", tuple(rules.Condition(*c) for c in conditions))


def ids_of(rule, artifacts, nodes, holds):
    ids = lambda a, b: ":".join(x for x in ("rp", "p", rule.id, a, b) if x is not None)
    return {ids(a[0], b[0]) for a in artifacts for b in nodes if a[1] == "A" and b[1] == "N" and a[2] is not None and b[2] is not None and holds(a, b)}


@pytest.mark.parametrize("nameless", [False, True])
@pytest.mark.parametrize("operator", ["equals", "contains", "regex"])
def test_edges_of_a_rule_have_an_id_once(spark, small_blocks, operator, nameless):
    from tracegrid.operators import rules

    rng = random.Random(3)
    words = ["x", "xy", "yx", "long word", "a long word", "words", None, ""]
    names = [*map(str, range(60)), "1:2", "1:2:3", "1", "a:b", "a:", "1", "7", "2", "3:4", *([None, None] if nameless else [])]
    artifacts = [(i, rng.choice("AAAB"), rng.choice(words), rng.choice("uv")) for i in names + names[:9]]
    nodes = [(i, rng.choice("NNNM"), rng.choice(words), rng.choice("uv")) for i in [*names, "2:3", "3:5", *names[-6:], None]]
    a, n = spark.createDataFrame(artifacts, "id string, family string, name string, w string"), spark.createDataFrame(nodes, "id string, node_type string, label string, w string")
    test = {"equals": lambda x, y: x == y, "contains": lambda x, y: x != "" and x in y, "regex": lambda x, y: x in y}[operator]
    one, two = rule(("name", operator, "label")), rule(("name", operator, "label"), ("w", "regex", "w"))
    for r, holds in ((one, lambda x, y: test(x[2], y[2])), (two, lambda x, y: test(x[2], y[2]) and x[3] == y[3])):
        got = [e["id"] for e in rules.run_rule("p", r, a, n).collect()]
        want = ids_of(r, artifacts, nodes, holds)
        assert len(got) == len(set(got))
        assert set(got) == want


def test_edges_of_rows_with_ids_of_their_own_are_not_compared(spark):
    from tracegrid.operators import rules

    a = spark.createDataFrame([(str(i), "A", "x") for i in range(20)], "id string, family string, name string")
    n = spark.createDataFrame([(f"n:{i}", "N", "wxyz") for i in range(20)], "id string, node_type string, label string")
    edges = [rules.run_rule("p", rule(("name", "equals", "label")), a, n.selectExpr("id", "node_type", "'X' AS label")), rules.run_rule("p", rule(("name", "regex", "label")), a, n), rules.run_rule("p", rule(("name", "contains", "label")), a, n)]
    for e in edges:
        assert e.count() == 400
        assert top(e) != "Aggregate"


def test_texts_of_all_lengths_are_found_by_grams(spark):
    from tracegrid.operators import rules

    rng = random.Random(11)
    texts = ["".join(rng.choices("abé", k=rng.randrange(150))) for _ in range(60)] + [None, "", "doc" + "0" * 130]
    sought = [x[i : i + n].upper() for x in texts if x for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 33, 64, 100, 129) if len(x) >= n for i in [rng.randrange(len(x) - n + 1)]] + ["", None, "doc1", "zz"]
    a = spark.createDataFrame([(i, "A", x) for i, x in enumerate(sought)], "id long, family string, name string")
    n = spark.createDataFrame([(i, "N", x) for i, x in enumerate(texts)], "id long, node_type string, label string")
    got = sorted((int(e["source_id"]), int(e["target_id"])) for e in rules.run_rule("p", rule(("name", "contains", "label")), a, n).collect())
    assert got == sorted((i, j) for i, x in enumerate(sought) for j, y in enumerate(texts) if x and y is not None and x.lower() in y)


def test_texts_near_in_time_are_found_once(spark, small_blocks):
    from tracegrid.operators.joins import temporal_text_matches

    rng = random.Random(2)
    needles = [(rng.randrange(100), rng.choice([rng.randrange(-300, 300), None, 50]), rng.choice(["User 1", "user 12", "by", "é", "", None, "by user 123 and"])) for _ in range(120)] + [(None, 50, "by")]
    texts = [(i, rng.choice([rng.randrange(-300, 300), None, 50]), rng.choice(["Seen BY User 12", "by user 123 and more", "by user 123 or", "É", "", None])) for i in range(150)] + [(7, 50, "by user 12"), (None, 50, "by user 1")]
    for ns, ts in ((needles, texts), (list({x[0]: x for x in needles}.values()), texts[:150])):
        a, b = spark.createDataFrame(ns, "id long, second long, needle string"), spark.createDataFrame(ts, "id long, second long, text string")
        got = [tuple(r) for r in temporal_text_matches(a, b, 60).select("needle_id", "text_id", "gap").collect()]
        want = {(x[0], y[0], abs(x[1] - y[1])) for x in ns for y in ts if x[2] and y[2] is not None and None not in (x[1], y[1]) and abs(x[1] - y[1]) <= 60 and x[2].lower() in y[2].lower()}
        assert len(got) == len(set(got))
        assert set(got) == want


def test_pairs_near_in_time_with_ids_of_their_own_are_not_compared(spark):
    from tracegrid.operators.joins import temporal_text_matches

    rows = spark.range(30).selectExpr("id", "id AS second", "concat('word ', id) AS text")
    found = temporal_text_matches(rows.selectExpr("id", "second", "'Word' AS needle"), rows, 60)
    assert found.count() == 900
    assert top(found) != "Aggregate"
