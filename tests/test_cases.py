"""Case, content and correlation operators on small inputs with odd rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracegrid.functions.paths import name_candidates, path_candidates, posix_candidates
from tracegrid.functions.text import snippets
from tracegrid.operators import cases, catalog, content, correlation, graph, joins, logs, rules, timeline
from tracegrid.plans import paging, tables
from tracegrid.sources import generations, mail, sinks


@pytest.mark.parametrize(
    ("data", "kind"),
    [
        (b"", "text_utf8"), (None, "text_utf8"), (b"plain", "text_utf8"), (("é" * 9).encode(), "text_utf8"),
        (b"\xff\xfea\0b\0", "text_utf16le"), (b"\xfe\xff\0a", "text_utf16be"), (b"\xff\xfe\x00\xd8a\0", "unsupported_encoding"),
        (b"a\0", "binary"), (b"abc\xff", "unsupported_encoding"), (b"x" * 70_000 + b"\xff", "text_utf8"), (b"x" * 65_535 + "é".encode(), "text_utf8"),
    ],
)
def test_content_kinds(data, kind):
    assert content.kind_of(data) == kind


def test_texts_and_patterns_of_odd_files(spark):
    rows = [(1, b"abab", None), (2, None, None), (3, b"", "text/plain"), (4, b"text", "image/png"), (5, b"\xff\xfea\0", "text/html"), (6, b"abc\xff", None)]
    files = spark.createDataFrame([(i, None if c is None else bytearray(c), m) for i, c, m in rows], "id int, content binary, mime string")
    got = {r["id"]: (r["content_kind"], r["text"], r["byte_count"]) for r in content.extract_text(files).collect()}
    assert got[1] == ("text_utf8", "abab", 4) and got[2] == ("text_utf8", "", 0) and got[4] == ("binary", None, 4)
    assert got[5] == ("text_utf16le", "a", 4) and got[6] == ("unsupported_encoding", None, 4)
    hits = {r["id"]: (r["offsets"], r["truncated"]) for r in content.byte_pattern(spark.createDataFrame([(1, bytearray(b"AAA\n\xffAA")), (2, bytearray(b"b"))], "id int, content binary"), b"AA", 2).collect()}
    assert hits == {1: ([0, 1], True)}
    with pytest.raises(ValueError):
        content.byte_pattern(files, b"")


def test_cut_and_late_bad_texts(spark, monkeypatch):
    whole = "\u00e4" * 40_000  # two bytes a sign
    rows = [(1, whole.encode()[:-1]), (2, whole.encode() + b"\xff\xff"), (3, b"\xff\xfe" + "\U0001f600".encode("utf-16-le")[:-2])]
    files = spark.createDataFrame([(i, bytearray(c), None) for i, c in rows], "id int, content binary, mime string")
    got = {r["id"]: (r["content_kind"], r["text"]) for r in content.extract_text(files).collect()}
    assert got == {1: ("text_utf8", whole[:-1]), 2: ("unsupported_encoding", None), 3: ("text_utf16le", "")}
    monkeypatch.setattr(content, "TEXT_BYTES", 5)
    assert {r["text"] for r in content.extract_text(files.where("id < 3")).collect()} == {"\u00e4\u00e4"}


def test_pattern_blocks(spark, monkeypatch):
    artifacts = spark.createDataFrame([(i, "f", f"^n{i}$") for i in range(40)] + [(99, "f", None), (98, "f", "^n1$")], "id int, family string, p string")
    nodes = spark.createDataFrame([(i, "t", f"n{i}") for i in range(0, 60, 2)] + [(1, "t", "n1"), (77, "t", None)], "id int, node_type string, name string")
    rule = rules.Rule("r", "f", "t", "weak", (rules.Condition("p", "regex", "name"),))
    want = {(str(i), str(i)) for i in [*range(0, 40, 2), 1]} | {("98", "1")}
    for size in (1 << 20, 20):
        monkeypatch.setattr(rules, "PATTERN_BYTES", size)
        assert {(r["source_id"], r["target_id"]) for r in rules.run_rule("p", rule, artifacts, nodes).collect()} == want
    assert rules.run_rule("p", rule, artifacts.where("false"), nodes).count() == 0


@pytest.mark.parametrize("down", [True, False])
def test_pages_by_cursor(spark, down):
    values = [None, 2.0, 1.5, None, 2.0, -0.5, 2.0]
    rows = spark.createDataFrame([(i, v, datetime(2024, 1, 1, 0, 0, i % 2, 5), i) for i, v in enumerate(values)], "id int, v double, ts timestamp_ntz, extra int")
    keys = [("v", down), ("ts", not down), ("id", False)]
    seen, cursor = [], None
    while True:
        page = paging.read_page(rows, keys, paging.PageRequest(2, cursor=cursor), "r", "c")
        seen += [r["id"] for r in page.rows.collect()]
        assert page.rows.schema == rows.schema
        cursor = page.next_cursor
        if cursor is None:
            break
    order = [F.desc(k) if d else F.asc(k) for k, d in keys]
    assert seen == [r["id"] for r in rows.orderBy(*order).collect()]
    assert paging.read_page(rows.where("false"), keys, paging.PageRequest(), "r", "c").next_cursor is None


def test_cursors_belong_to_their_query(spark):
    events = spark.createDataFrame([(i, 0, "k", datetime(2024, 1, 1)) for i in range(5)], "id int, data_source_id int, event_type string, ts timestamp_ntz")
    cursor = timeline.read_timeline(events, paging.PageRequest(2), "r1").next_cursor
    again = paging.PageRequest(2, cursor=cursor)
    assert [r["id"] for r in timeline.read_timeline(events, again, "r1").rows.collect()] == [2, 3]
    for revision, kind in (("r2", None), ("r1", "k")):
        with pytest.raises(ValueError):
            timeline.read_timeline(events, again, revision, event_type=kind)
    hits = events.selectExpr("id", "data_source_id", "1.0D AS score")
    sources = spark.createDataFrame([(0, "ready"), (1, "building")], "data_source_id int, status string")
    cursor = cases.read_case_search(hits, sources, "q", paging.PageRequest(2), "r1").next_cursor
    with pytest.raises(ValueError):
        cases.read_case_search(hits, sources.withColumn("status", F.lit("ready")), "q", paging.PageRequest(2, cursor=cursor), "r1")


def test_config_findings(spark):
    lines = ["bind-address=*", "skip-networking=0", "secure_file_priv=", "local-infile", "general-log=off", "init-file=/x", "port=1"]
    found = logs.mysql_config_findings(logs.parse_mysql_config(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "file_id int, line_number int, line string")))
    got = {(r["finding_kind"], r["severity"], r["confidence"], r["evidence"]) for r in found.collect()}
    assert got == {
        ("bindAddressAny", "medium", 0.86, "bind-address=*"), ("networkingEnabled", "info", 0.7, "skip-networking=0"), ("secureFilePrivEmpty", "medium", 0.78, "secure-file-priv is empty"),
        ("localInfileEnabled", "medium", 0.82, "local-infile="), ("init-fileConfigured", "low", 0.72, "init-file=/x"),
    }


def test_candidates(spark):
    text = 'run "C:\\Program Files\\a b.exe" /s, see C:\\x\\y.dll. (D:\\z)'
    found = spark.range(1).select(path_candidates(F.lit(text)).alias("p"), name_candidates(F.lit("my photo.jpg")).alias("n"), posix_candidates(F.lit("open '/var/log x/a' or //no /flag /usr/bin/x")).alias("u")).head()
    assert {"C:\\Program Files\\a b.exe", "C:\\x\\y.dll", "D:\\z"} <= set(found["p"])
    assert found["n"] == ["my photo.jpg", "photo.jpg"] and set(found["u"]) == {"/var/log x/a", "/var/log", "/usr/bin/x"} - {"/var/log"} | ({"/var/log"} & set(found["u"]))


def test_recycle_bin_prefers_deleted_files(spark):
    files = spark.createDataFrame([(1, "C:/a/x.txt", "x.txt", False), (2, "C:/a/x.txt", "x.txt", True)], "id long, path string, name string, deleted boolean")
    artifacts = spark.createDataFrame([("b", "RecycleBin", '{"originalPath":"C:\\\\a\\\\x.txt"}'), ("l", "LNK", '{"targetPath":"c:/A/x.txt"}'), ("n", "LNK", "{}"), ("z", None, None)], "id string, artifact_type string, attrs string")
    got = {r["artifact_id"]: (r["file_id"], r["kind"]) for r in correlation.rule_matches(artifacts, files).collect()}
    assert got == {"b": (2, "recovered_original_path"), "l": (1, "path_match")}


def test_registry_looks_for_names_only_without_a_path(spark):
    files = spark.createDataFrame([(1, "C:/a/x.exe", "x.exe", False), (2, "C:/b/y.exe", "y.exe", False)], "id long, path string, name string, deleted boolean")
    artifacts = spark.createDataFrame([("p", "RegistryValue", '{"data":"C:/a/x.exe y.exe"}'), ("q", "RegistryValue", '{"data":"start y.exe"}')], "id string, artifact_type string, attrs string")
    got = sorted((r["artifact_id"], r["file_id"], r["confidence"]) for r in correlation.rule_matches(artifacts, files).collect())
    assert got == [("p", 1, "strong"), ("q", 2, "weak")]


def test_proximity_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(6), rng.choice([rng.randrange(200), rng.randrange(400_000)]), rng.choice("ab")) for i in range(400)]
    rows += [(1000 + i, 99, 500, "a") for i in range(300)]  # one object in one second
    frame = spark.createDataFrame(rows, "id long, source_object_id long, second long, match_key string")
    got = sorted((r["id"], r["near_id"], r["gap"]) for r in joins.temporal_proximity(frame, frame).collect())
    want = []
    for i, o, s, k in rows:
        near = sorted((abs(s - s2), j) for j, o2, s2, k2 in rows if k2 == k and o2 != o and abs(s - s2) <= 86_400)[:3]
        want += [(i, j, g) for g, j in near]
    assert got == sorted(want)
    assert joins.temporal_proximity(frame.limit(0), frame.limit(0)).count() == 0


def test_best_paths_equal_all_pairs(spark):
    rng = random.Random(5)
    names = ["index.html", "a.txt", "ba.txt", "x"]
    paths = ["C:/" + "/".join([*rng.choices(["u", "www", "ww", "docs"], k=rng.randrange(0, 4)), rng.choice(names)]) for _ in range(120)]
    files = spark.createDataFrame([(i, p, i % 3 == 0) for i, p in enumerate(paths)], "id long, path string, deleted boolean")
    asked = ["index.html", "w/index.html", "ww/docs/a.txt", "C:\\www\\x", "tml", "none", "", "/", "s/ba.txt", "u/u/x"] * 2
    rows = [(i, c, i >= 10) for i, c in enumerate(asked)]
    got = {r["candidate_id"]: r["file_id"] for r in joins.best_path_match(spark.createDataFrame(rows, "candidate_id long, candidate string, wants_deleted boolean"), files).collect()}
    want = {}
    for i, c, deleted in rows:
        norm = c.replace("\\", "/").lower()
        key = norm[3:] if norm[1:3] == ":/" else norm.lstrip("/")
        exact = [j for j, p in enumerate(paths) if p.lower() == norm]
        hits = exact or [j for j, p in enumerate(paths) if p[3:].lower().endswith(key)]
        if key and hits:
            want[i] = min(hits, key=lambda j: (deleted != (j % 3 == 0), len(paths[j]), j))
    assert got == want


def test_chains_with_cycles_and_gaps(spark):
    links = [(1, 2), (2, 3), (3, 1), (4, 9), (5, 4), (6, None), (7, 6)] + [(100 + i, 99 + i if i else 6) for i in range(70)]
    entries = spark.createDataFrame(links, "id long, parent_id long")
    got = {}
    for r in catalog.ancestors(entries, entries).collect():
        got.setdefault(r["start_id"], []).append((r["depth"], r["id"]))
    assert sorted(got[1]) == [(0, 1), (1, 2), (2, 3)] and sorted(got[5]) == [(0, 5), (1, 4), (2, 9)] and len(got[169]) == 71
    roots = {r["id"]: (r["root_id"], r["depth"]) for r in graph.threads(entries).collect()}
    assert roots[7] == (6, 1) and roots[5] == (4, 1) and not {1, 2, 3} & roots.keys() and max(d for _, d in roots.values()) == 64
    assert catalog.ancestors(entries.limit(0), entries.limit(0)).count() == graph.threads(entries.limit(0)).count() == 0


def test_rules_without_equalities(spark):
    artifacts = spark.createDataFrame([("a", "x", "bc"), ("b", "x", "long text"), ("c", "x", None), ("d", "x", "")], "id string, family string, word string")
    nodes = spark.createDataFrame([("1", "N", "ABCD"), ("2", "N", "a long text here"), ("3", "N", None)], "id string, node_type string, body string")
    rule = rules.Rule("r", "x", "N", "weak", (rules.Condition("word", "contains", "body"),))
    got = sorted((r["source_id"], r["target_id"]) for r in rules.run_rule("p", rule, artifacts, nodes).collect())
    assert got == [("a", "1"), ("b", "2")]
    pattern = rules.Rule("r", "x", "N", "weak", (rules.Condition("word", "regex", "body"),))
    rows = artifacts.withColumn("word", F.when(F.col("id") == "a", "^A.*D$").when(F.col("id") == "b", "nothing"))
    assert [(r["source_id"], r["target_id"]) for r in rules.run_rule("p", pattern, rows, nodes).collect()] == [("a", "1")]


def test_generations_upserts_and_mail(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    merged = sinks.upsert(spark.createDataFrame([(1, "old"), (3, "kept")], "id int, v string"), rows, ["id"])
    assert sorted(map(tuple, merged.collect())) == [(1, "b"), (2, "c"), (3, "kept")]
    generations.write_generation(rows, str(tmp_path), "g1")
    assert generations.read_generation(spark, str(tmp_path), "g1").count() == 3
    rows.write.parquet(f"{tmp_path}/generation=g2")  # without its marker
    for name in ("g2", "g3"):
        with pytest.raises(ValueError):
            generations.read_generation(spark, str(tmp_path), name)
    mails = spark.createDataFrame([("x.eml", None), ("y.eml", bytearray(b"Subject: s\n\nbody"))], "path string, content binary")
    assert [r["subject"] for r in mail.messages(mails).collect()] == ["s"]


def test_checks_and_limits(spark):
    assert spark.range(1).select(snippets(F.lit("The Quick\nFox"), "quick").alias("s")).head()["s"] == ["The Quick\nFox"]
    nothing = spark.createDataFrame([], "id long, scan_id long, inode string, md5 string")
    scans = spark.createDataFrame([], "id long, data_source_id long, partition_index int")
    for algorithm, digest, limit in (("md5", "x", 1), ("crc", "0" * 32, 1), ("md5", "A" * 32, 1), ("md5", "0" * 32, 101)):
        with pytest.raises(ValueError):
            cases.recovered_by_hash(nothing, scans, 1, algorithm, digest, limit)
    with pytest.raises(ValueError):
        cases.report_timeline(spark.range(5).selectExpr("id", "id AS ts"), 4)
    assert cases.report_timeline(spark.range(5).selectExpr("id", "id AS ts"), 5).count() == 5


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        tables.shared_root(Cluster)
