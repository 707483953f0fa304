"""Functions and operators on small rows: edges, nulls, ties."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracegrid.functions import classify, digests, paths, text, times
from tracegrid.operators import entities, graph, integrity, joins, logs, rules, timeline
from tracegrid.plans import paging
from tracegrid.sources import extractors, generations, mail, sinks


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_normalize_path(spark):
    given = [' "C:\\A\\b.EXE" ', "/c//a/b.exe/", "C:/", "", None, "[x]"]
    assert column(spark, given, "string", paths.normalize_path) == ["c:/a/b.exe", "/c/a/b.exe", "c:/", "", None, "x"]


def test_extension(spark):
    assert column(spark, ["a.b.txt", ".bashrc", "none", "x.", None], "string", paths.extension) == ["txt", None, None, None, None]


def test_natural_key(spark):
    names = ["file10", "file9", "File9", "file009", "a", "file10b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in rows.orderBy(paths.natural_key(F.col("n"))).collect()]
    assert got == ["a", "File9", "file9", "file009", "file10", "file10b"]


def test_times(spark):
    ticks = [0, -1, 116_444_736_000_000_009, 133_485_408_000_000_000]
    assert column(spark, ticks, "long", lambda c: F.unix_micros(times.from_filetime(c))) == [None, None, 0, 1704067200000000]
    assert column(spark, [0, 13_348_540_800_000_000], "long", lambda c: F.unix_seconds(times.from_webkit(c))) == [None, 1704067200]
    dos = (44 << 25) | (1 << 21) | (2 << 16) | (3 << 11) | (4 << 5) | 5
    assert column(spark, [dos, 0], "long", lambda c: F.unix_seconds(times.from_dos(c))) == [1704164650, None]


def test_magic(spark):
    given = [b"MZ\x90", b"RIFF\0\0\0\0AVI ", b"RIFF\0\0\0\0NONE", b"PK\x03\x04", b"\0\0\0\0ftyp", b"", None]
    got = column(spark, given, "binary", lambda c: classify.magic(c, F.lit("docx"))["file_type"])
    assert got == ["PE", "AVI", None, "ZIP", "MP4", None, None]


def test_sm3(spark):
    want = "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0"
    assert digests.sm3(b"abc") == want
    assert column(spark, [b"abc", None], "binary", digests.sm3_hex) == [want, None]


def test_fingerprint(spark):
    raw = b"".join(len(x).to_bytes(8, "little") + x for x in (b"a", "é".encode(), b""))
    rows = spark.createDataFrame([("a", "é", None)], "a string, b string, c string")
    assert rows.select(digests.record_fingerprint(F.col("a"), F.col("b"), F.col("c"))).head()[0] == hashlib.sha256(raw).hexdigest()


def test_search_form(spark):
    assert column(spark, ["ＡＢc", "ﬁ", None], "string", text.search_form) == ["abc", "fi", None]


def test_phrase_and_snippets(spark):
    given = ["An Of-The end", "often the", "", None]
    assert column(spark, given, "string", lambda c: text.has_phrase(c, "of the")) == [True, False, False, None]
    assert column(spark, ["x" * 100 + "Needle" + "y" * 100], "string", lambda c: text.snippets(c, "needle"))[0] == ["x" * 60 + "Needle" + "y" * 60]


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, data_source_id long, event_type string, ts timestamp_ntz, description string")


def test_timeline_edges(spark):
    t = datetime(2024, 1, 1)
    rows = events(spark, [(1, 1, "a", t, "d"), (2, 0, "a", t, "d"), (3, 0, "b", datetime(2024, 1, 1, 0, 0, 9, 900000), "d")])
    assert [r["id"] for r in timeline.page(rows).collect()] == [3, 2, 1]
    assert timeline.timeline_filter(rows, end=datetime(2024, 1, 1, 0, 0, 9)).count() == 2
    assert timeline.facet_filter(rows, end=datetime(2024, 1, 1, 0, 0, 9)).count() == 3
    with pytest.raises(ValueError):
        timeline.timeline_filter(rows, datetime(2024, 1, 2), t)
    buckets = [(r["bucket"], r["start_second"] - 1704067200, r["n"]) for r in timeline.histogram(rows, 3).orderBy("bucket").collect()]
    assert buckets == [(0, 0, 2), (1, 3, 0), (2, 6, 1)]
    assert timeline.histogram(rows.where("id > 9"), 3).count() == 0
    assert timeline.histogram(rows.where("id < 3"), 180).count() == 1


def test_pair_sessions_is_first_in_first_out(spark):
    rows = [(1, "t", 1, 10, "logout"), (1, "t", 2, 20, "login"), (1, "t", 3, 30, "login"), (1, "t", 4, 40, "logout"), (1, "u", 5, 50, "login")]
    found = joins.pair_sessions(spark.createDataFrame(rows, "pid int, terminal string, id int, second int, kind string"))
    assert {(r["login_id"], r["logout_id"]) for r in found.collect()} == {(None, 1), (2, 4), (3, None), (5, None)}


def test_proximity_bounds(spark):
    left = spark.createDataFrame([(1, 1, 0, "k")], "id int, source_object_id int, second long, match_key string")
    right = [(2, 2, 86400, "k"), (3, 2, 86401, "k"), (4, 1, 5, "k"), (5, 3, -86400, "k"), (6, 3, 1, "other"), (7, 3, 2, "k"), (8, 3, 3, "k")]
    found = joins.temporal_proximity(left, spark.createDataFrame(right, left.schema))
    assert [(r["near_id"], r["gap"]) for r in found.orderBy("r").collect()] == [(7, 2), (8, 3), (2, 86400)]


def test_best_path_short_names(spark):
    files = spark.createDataFrame([(1, "C:/x/xfoo.exe", False), (2, "C:/y/foo.exe", True)], "id int, path string, deleted boolean")
    wanted = spark.createDataFrame([("a", "foo.exe", False), ("b", "y\\foo.exe", True), ("c", "none", False)], "candidate_id string, candidate string, wants_deleted boolean")
    assert {(r["candidate_id"], r["file_id"]) for r in joins.best_path_match(wanted, files).collect()} == {("a", 1), ("b", 2)}


def test_walk_with_cycle_and_loop(spark):
    e = spark.createDataFrame([("1", "a", "b", "x", None), ("2", "b", "a", "x", 1.0), ("3", "a", "a", "x", 1.0)], "id string, source_id string, target_id string, edge_type string, confidence double")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r["id"], r["depth"]) for r in graph.walk(e, start, 5).collect()} == {("a", 0), ("b", 1)}
    assert graph.confident(e, 0.5).count() == 2
    with pytest.raises(ValueError):
        graph.confident(e, 2)


def test_merkle_sizes(spark):
    def root(leaves):
        level = [hashlib.sha256(f"leaf:{x}".encode()).hexdigest() for x in leaves]
        while len(level) > 1:
            level = [hashlib.sha256(f"node:{level[i]}{level[min(i + 1, len(level) - 1)]}".encode()).hexdigest() for i in range(0, len(level), 2)]
        return level[0]

    rows = [(str(n), i, f"x{i}") for n in (1, 2, 3, 5) for i in range(n)]
    found = integrity.merkle_roots(spark.createDataFrame(rows, "scope_key string, at int, data string"))
    assert {r["scope_key"]: r["root"] for r in found.collect()} == {str(n): root([f"x{i}" for i in range(n)]) for n in (1, 2, 3, 5)}


def test_merkle_proof(spark):
    leaves = spark.createDataFrame([("s", i, f"x{i}") for i in range(5)], "scope_key string, at int, data string")
    levels = integrity.merkle_levels(leaves)
    root = integrity.merkle_roots(leaves).head()["root"]
    h = hashlib.sha256(b"leaf:x4").hexdigest()
    for r in integrity.merkle_proof(levels, "s", 4).orderBy("level").collect():
        h = hashlib.sha256(("node:" + (r["hash"] + h if r["on_left"] else h + r["hash"])).encode()).hexdigest()
    assert h == root


def test_rule_packs_refuse_mistakes():
    good = '[manifest]\nid = "p"\n[[rules]]\nid = "a"\nfamily = "f"\ntarget_type = "t"\n'
    assert rules.parse_pack(good)[0] == "p"
    for bad in ("[manifest]\n", good + good.split("\n", 2)[2], good + 'confidence = "sure"\n'):
        with pytest.raises(ValueError):
            rules.parse_pack(bad)
    with pytest.raises(ValueError):
        rules.parse_pack(good, {"other"})


def test_access_log_lines(spark):
    lines = [
        'www.host.org 10.0.0.1 - - [01/Jan/2024:00:00:00 +0100] "GET /a HTTP/1.1" 200 - "-" "agent"',
        '10.0.0.2 - - [bad] "POST /login HTTP/1.0" 404 12',
        '10.0.0.3 - - [01/Jan/2024:00:00:00 +0000] "GET /a" 200 1',
        "no brackets",
        None,
    ]
    found = logs.parse_access(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_number int, line string")).orderBy("line_number").collect()
    assert [(r["client_ip"], r["vhost"], r["status"], r["response_bytes"]) for r in found] == [("10.0.0.1", "www.host.org", 200, None), ("10.0.0.2", None, 404, 12)]
    assert found[0]["ts"] == datetime(2023, 12, 31, 23) and found[1]["ts"] is None


@pytest.mark.parametrize(("posts", "found"), [(49, 0), (50, 1)])
def test_brute_force_threshold(spark, posts, found):
    rows = spark.range(posts).selectExpr("'ip' AS client_ip", "'POST' AS method", "'/wp-LOGIN' AS uri", "299 AS s")
    other = spark.range(49).selectExpr("'ip' AS client_ip", "'POST' AS method", "'/wp-LOGIN' AS uri", "300 AS s")
    assert logs.brute_force(rows.unionAll(other), F.col("s")).count() == found


def test_cross_case_waves(spark):
    rows = [(1, "x", "a@h", "email"), (2, "y", "a@h", "email"), (3, "x", "b@h", "email"), (4, "y", "b@i", "email"), (5, "x", "c", "email"), (6, "y", "d", "email")]
    found = entities.cross_case_matches(spark.createDataFrame(rows, "id int, database string, canonical string, entity_type string"))
    assert {(r["wave"], r["first_id"], r["members"]) for r in found.collect()} == {("exact", 1, 2), ("normalized", 3, 2), ("fuzzy", 5, 2)}


def test_cursors():
    cursor = paging.encode_cursor({"id": 7}, "r1", "q")
    assert paging.decode_cursor(cursor, "r1", "q") == {"id": 7}
    for revision, context, c in (("r2", "q", cursor), ("r1", "z", cursor), ("r1", "q", cursor[:-1] + "x"), ("r1", "q", "x")):
        with pytest.raises(ValueError):
            paging.decode_cursor(c, revision, context)
    with pytest.raises(ValueError):
        paging.PageRequest(offset=1, cursor=cursor).validated()
    assert [paging.histogram_buckets(n) for n in (0, 1, 500)] == [60, 20, 180]


def test_mail(spark):
    box = b"From a@b Mon\nSubject: One\nFrom: a@b\n\nHello\n>From here\n\nFrom c@d Tue\nSubject: Re: One\n\nBye\n"
    files = spark.createDataFrame([("x.mbox", bytearray(box)), ("y.eml", bytearray(b"Subject: Two\n\nText\n"))], "path string, content binary")
    found = mail.messages(files)
    assert [(r["subject"], r["body"].strip()) for r in found.orderBy("path", "message_index").collect()] == [("One", "Hello\nFrom here"), ("Re: One", "Bye"), ("Two", "Text")]
    assert {(r["thread"], r["messages"]) for r in mail.thread_roots(found).collect()} == {("one", 2), ("two", 1)}


def test_extractor_registry(spark):
    r = extractors.Registry()
    r.add(extractors.Extractor("built-in", frozenset({"f"}), lambda p, d: [("f", "b", "{}"), ("other", "x", "{}")], suffixes=(".TXT",)))
    r.add(extractors.Extractor("plug", frozenset({"f"}), lambda p, d: [("f", p, "{}")], names=("special.txt",), plugin=True))
    files = spark.createDataFrame([("1", "a/b.txt", bytearray(b"")), ("2", "a\\special.txt", bytearray(b"")), ("3", "c", bytearray(b""))], "id string, path string, content binary")
    assert {(x["source_object_id"], x["extractor_id"]) for x in r.extract(files).collect()} == {("1", "built-in"), ("2", "plug")}


def test_upsert_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, "c"), (2, "c"), (3, "=d")], "id int, v string")
    merged = sinks.upsert(a, b, ["id"])
    assert {tuple(r) for r in merged.collect()} == {(1, "a"), (2, "c"), (3, "=d")}
    sinks.write_csv(merged, f"{tmp_path}/csv")
    assert '"3","\t=d"' in {r[0] for r in spark.read.text(f"{tmp_path}/csv/rows").collect()}
    generations.write_generation(merged, f"{tmp_path}/g", "1")
    assert spark.read.parquet(f"{tmp_path}/g").count() == 3


def test_streaming_brute_force(spark, tmp_path):
    from tracegrid.streaming.detectors import stream_brute_force

    rows = spark.range(60).selectExpr("timestamp'2024-01-01 00:01:00' AS ts", "'ip' AS client_ip", "'POST' AS method", "'/login' AS uri")
    late = spark.range(1).selectExpr("timestamp'2024-01-01 02:00:00' AS ts", "'ip' AS client_ip", "'GET' AS method", "'/login' AS uri")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = stream_brute_force(stream).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    late.withColumn("method", F.lit("POST")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    assert [r["requests"] for r in spark.table("found").collect()] == [60]


def test_merkle_of_many_leaves_numbered_by_slots(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(integrity, "SLOT", 16)
    sizes = {"hot": 700, "odd": 37, "one": 1, "two": 2}
    ids = {k: [(7 * i + len(k)) * 3 for i in range(n)] for k, n in sizes.items()}
    rows = spark.createDataFrame([(k, x) for k, xs in ids.items() for x in reversed(xs)], "scope_key string, data long")
    places = integrity.numbered(rows, "scope_key", "data")
    assert {(r["scope_key"], r["data"]): r["at"] for r in places.collect()} == {(k, x): i for k, xs in ids.items() for i, x in enumerate(xs)}

    def root(xs):
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        level = [sha(f"leaf:{x}") for x in xs]
        while len(level) > 1:
            level = [sha("node:" + level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        return level[0]

    assert {r["scope_key"]: r["root"] for r in integrity.merkle_roots(places).collect()} == {k: root(xs) for k, xs in ids.items()}


def plain_highlights(text, query):
    """Hits by a scan of every byte place; groups by their gaps."""
    data, terms = text.encode(), [t.encode() for t in query.lower().split()]
    lower = text.lower().encode()
    hits = []
    for t in terms:
        at = 0
        while at <= len(lower) - len(t):
            if lower[at : at + len(t)] == t:
                hits.append(at)
                at += len(t)
            else:
                at += 1
    if not (hits := sorted(set(hits))):
        return []
    starts = [i for i, p in enumerate(hits) if i == 0 or p - hits[i - 1] > 120]
    out = []
    for i, j in list(zip(starts, [*starts[1:], len(hits)], strict=True))[:5]:
        a, b = max(0, hits[i] - 60), min(len(data), hits[j - 1] + max(map(len, terms)) + 60)
        while a and data[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        piece = data[a:b]
        cut = min(512, len(piece))
        while cut < len(piece) and piece[cut] & 0xC0 == 0x80:
            cut -= 1
        shown = piece[:cut].decode()
        low, marks = shown.lower().encode(), []
        for t in terms:
            at = low.find(t)
            while at >= 0:
                marks.append((at, at + len(t)))
                at = low.find(t, at + len(t))
        out.append((shown, sorted(marks)))
    return out


def test_highlights_against_brute_force(spark):
    import random

    rng = random.Random(6)
    parts = ["the ", "é", "THE", "x" * 30, "日本語 ", "word ", "\n", "É ", "y" * 130, "th e"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(150)] + ["the" * 400, "", None, "none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", text.highlights(F.col("text"), "The É").alias("s")).collect()
    for r in rows:
        want = None if texts[r["id"]] is None else plain_highlights(texts[r["id"]], "The É")
        assert (None if r["s"] is None else [(x["text"], [tuple(h) for h in x["hits"]]) for x in r["s"]]) == want
    assert spark.createDataFrame([("a",)], "text string").select(text.highlights(F.col("text"), "  ")).first()[0] == []


def test_addresses_as_bits(spark):
    import ipaddress
    import random

    from tracegrid.operators import networks

    rng = random.Random(7)
    texts = ["", ":", "::", "1::", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1.2.3", "1.2.3.4.5", "00.1.2.3", "1:2:3:4:5:6:7:8:9", "1:::2", "ABCD::", "12345::", None]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([2**128 - 1, 2**64 - 1, 0xFFFF << 64]))) for _ in range(50)]
    texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(50)]

    def bits(x):
        try:
            ip = ipaddress.ip_address(x)
        except ValueError:
            return None
        return bin(int(ip))[2:].zfill(ip.max_prefixlen)

    rows = spark.createDataFrame([(x,) for x in texts], "address string").select("address", networks.address_bits("address").alias("bits"), networks.valid_address("address").alias("ok")).collect()
    assert {r["address"]: r["bits"] for r in rows} == {x: bits(x) if x is not None else None for x in texts}


def test_walks_of_odd_forests(spark):
    import random

    from tracegrid.operators import forest

    rng = random.Random(8)
    parents = {i: rng.choice([None, *range(i)]) if i else None for i in range(150)} | {i: i - 1 for i in range(150, 350)}
    parents |= {900: 901, 901: 900, 902: 900, 500: 7777}  # a cycle, what hangs on it, and an orphan
    ranks = {i: rng.randrange(5) for i in parents}
    rows = spark.createDataFrame([(i, p, ranks[i]) for i, p in parents.items()], "id long, parent_id long, rank int")
    kids = {}
    for i, p in parents.items():
        kids.setdefault(p if p in parents else None, []).append(i)
    order, sizes = [], {}

    def walk(i, depth):
        order.append((i, depth))
        sizes[i] = 1 + sum(walk(k, depth + 1) for k in sorted(kids.get(i, []), key=lambda k: (ranks[k], k)))
        return sizes[i]

    for r in sorted(kids[None], key=lambda k: (ranks[k], k)):
        walk(r, 0)
    got = {r["id"]: (r["depth"], r["size"], r["place"]) for r in forest.walk_order(rows, ["rank"]).collect()}
    assert got == {i: (d, sizes[i], n) for n, (i, d) in enumerate(order)}
    breadth = {r["id"]: r["breadth"] for r in forest.level_order(rows, ["rank"]).collect()}
    assert breadth == {i: n for n, (i, _) in enumerate(sorted(order, key=lambda x: x[1]))}
    assert forest.walk_order(rows.limit(0), ["rank"]).count() == 0
