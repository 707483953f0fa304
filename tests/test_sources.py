"""Data sources, generations, bundles and incremental correlation."""

import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracegrid.operators import correlation, incremental
from tracegrid.sources import generations, mail, readers


def mailbox(rng, n):
    """A mailbox with quoted lines, blank lines with spaces and lines that only look like a start."""
    out = []
    for i in range(n):
        body = [rng.choice(["text", "", "From here on", "   ", ">From quoted", "é日本" * 5, "x" * rng.randrange(300)]) for _ in range(rng.randrange(8))]
        body = [">" + x if x.lstrip(">").startswith("From ") else x for x in body]
        out.append(f"From a@b Mon Jan 1\nMessage-ID: <{i}>\nSubject: s {i}\nContent-Type: text/plain; charset=utf-8\n\n" + "\n".join(body) + "\n\n")
    return "".join(out).encode()


@pytest.mark.parametrize("split", [1, 7, 60, 1000, 10**9])
def test_messages_on_range_edges_come_once(tmp_path, split):
    rng = random.Random(split)
    data = mailbox(rng, 60)
    (tmp_path / "box").write_bytes(data)
    system, path = readers.opened(str(tmp_path / "box"))
    found = []
    with system.open_input_file(path) as file:
        for at in range(0, len(data), split):
            found += readers.messages_in(file, at, min(len(data), at + split))
    assert [raw for _, raw in found] == mail.split_mailbox(data)
    assert all(data[at : at + 5] == b"From " for at, _ in found)


def test_mailbox_source(spark, tmp_path):
    data = {name: mailbox(random.Random(name), n) for name, n in (("a", 300), ("b", 1), ("empty", 0))}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    readers.register(spark)
    rows = spark.read.format("mailbox").option("split", "2000").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 10
    got = sorted((r["path"].rsplit("/", 1)[1], r["offset"], r["message_id"], r["subject"]) for r in rows.collect())
    assert [g[2:] for g in got] == [(f"<{i}>", f"s {i}") for n in (300, 1) for i in range(n)]
    one = rows.where(F.col("path") == f"{tmp_path}/b")
    assert one.count() == 1 and one.rdd.getNumPartitions() == 1
    assert rows.where("path = 'nowhere'").count() == 0


def test_browser_source(spark, tmp_path):
    for name, script in {
        "chrome": """CREATE TABLE urls (id INTEGER, url TEXT, title TEXT, visit_count INT); CREATE TABLE visits (url INT, visit_time INT);
          INSERT INTO urls VALUES (1, 'http://a', 'A', 3); INSERT INTO visits VALUES (1, 10), (9, 20);
          CREATE TABLE downloads (id INTEGER, target_path TEXT, start_time INT, end_time INT, total_bytes INT, state INT);
          CREATE TABLE downloads_url_chains (id INT, chain_index INT, url TEXT); INSERT INTO downloads VALUES (5, 'C:/x.exe', 1, 2, 99, 1);
          INSERT INTO downloads_url_chains VALUES (5, 0, 'http://first'), (5, 1, 'http://last');""",
        "jar": """CREATE TABLE cookies (host_key TEXT, name TEXT, path TEXT, creation_utc INT, expires_utc INT, is_secure INT, is_httponly INT);
          INSERT INTO cookies VALUES ('.a', 'sid', '/', 1, 2, 1, 0), ('.b', 'x', '/p', 3, 4, 0, NULL);""",
        "fox": """CREATE TABLE moz_cookies (host TEXT, name TEXT, path TEXT, creationTime INT, expiry INT, isSecure INT, isHttpOnly INT);
          INSERT INTO moz_cookies VALUES ('c', 'n', '/', 7, 8, 0, 1);""",
    }.items():
        db = sqlite3.connect(tmp_path / name)
        db.executescript(script)
        db.close()
    (tmp_path / "text").write_text("no database")
    (tmp_path / "torn").write_bytes(b"SQLite format 3\0" + b"x" * 100)
    readers.register(spark)
    load = lambda table: [tuple(r)[1:] for r in spark.read.format("browser_db").option("table", table).load(str(tmp_path)).orderBy("path", "row_id").collect()]
    assert load("history") == [("chromium", 1, "http://a", "A", 3, 10), ("chromium", 2, None, None, None, 20)]
    assert load("downloads") == [("chromium", 1, "http://last", "C:/x.exe", 1, 2, 99, 1)]
    assert load("cookies") == [("firefox", 1, "c", "n", "/", 7, 8, False, True), ("chromium", 1, ".a", "sid", "/", 1, 2, True, False), ("chromium", 2, ".b", "x", "/p", 3, 4, False, None)]
    with pytest.raises(Exception, match="table"):
        spark.read.format("browser_db").option("table", "other").load(str(tmp_path)).count()


def test_generations_are_verified(spark, tmp_path):
    root = str(tmp_path / "a")
    rows = spark.range(100).selectExpr("id", "id % 3 AS part")
    generations.write_generation(rows, root, "1", ["part"])
    generations.write_generation(rows.limit(7), root, "2", ["part"])
    assert spark.read.parquet(root).count() == 107 and generations.latest(spark, root) == "2"
    generations.clone_generation(spark, root, "1", str(tmp_path / "b"))
    assert generations.read_generation(spark, str(tmp_path / "b"), "1").count() == 100
    folder = f"{root}/generation=1/part=0"
    name = next(n for n in os.listdir(folder) if n.endswith(".parquet"))
    whole = open(f"{folder}/{name}", "rb").read()
    for changed, problem in ((whole[:-9] + b"x" + whole[-8:], "changed"), (None, "missing")):
        if changed is None:
            os.remove(f"{folder}/{name}")
        else:
            open(f"{folder}/{name}", "wb").write(changed)
        for hidden in os.listdir(folder):
            if hidden.endswith(".crc"):
                os.remove(f"{folder}/{hidden}")
        with pytest.raises(generations.BrokenGeneration, match=problem):
            generations.read_generation(spark, root, "1")
        with pytest.raises(generations.BrokenGeneration):
            generations.clone_generation(spark, root, "1", str(tmp_path / "c"))
    with pytest.raises(generations.BrokenGeneration, match="whole"):
        generations.read_generation(spark, root, "3")


def test_added_artifacts_give_the_full_snapshot(spark, tmp_path):
    files = spark.createDataFrame([(i, f"C:/d/F{i}.exe", f"F{i}.exe", i == 3) for i in range(9)], "id long, path string, name string, deleted boolean")
    artifact = lambda k, i: (k, "LNK", f'{{"target_path":"C:\\\\\\\\d\\\\\\\\F{i}.exe"}}')
    artifacts = lambda rows: spark.createDataFrame(rows, "id long, artifact_type string, attrs string")
    events = lambda ids: spark.createDataFrame([(i,) for i in ids], "source_object_id long")
    store = incremental.Snapshots(spark, str(tmp_path / "s"))
    states = [
        ([artifact(1, 1), artifact(2, 2)], [1], "full"),
        ([artifact(1, 1), artifact(2, 2), artifact(3, 2), artifact(4, 5)], [1], "added"),  # a cluster and a new file
        ([artifact(1, 1), artifact(2, 2), artifact(3, 2), artifact(4, 5)], [1, 5, 5], "added"),  # events alone
        ([artifact(1, 1), artifact(2, 2), artifact(3, 2), artifact(4, 5)], [1, 5, 5], "added"),  # nothing
        ([artifact(1, 1), artifact(2, 4), artifact(3, 2), artifact(4, 5)], [1], "full"),  # one changed
        ([artifact(1, 1), artifact(3, 2)], [1], "full"),  # two vanished
    ]
    for rows, ids, how in states:
        got = store.refresh(artifacts(rows), files, events(ids))
        assert store.how == how
        want = correlation.correlation_snapshot(artifacts(rows), files, events(ids))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert store.revision() == "6"
    more = files.union(spark.createDataFrame([(20, "C:/d/G.exe", "G.exe", False)], files.schema))
    store.refresh(artifacts(rows), more, events(ids))
    assert store.how == "full"


def test_bundles(spark, tmp_path):
    from tracegrid.sources import bundle

    bundle.register(spark)
    root = str(tmp_path / "bundle")
    rows = [(str(i), f"C:\\x\\na me{i % 3}.bin", bytearray(os.urandom(i * 50)) if i % 7 else None, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "file_id string, path string, content binary, deleted boolean").repartition(5)
    df.write.format("file_bundle").mode("append").save(root)
    load = lambda: spark.read.format("file_bundle").load(root)
    got = {r["file_id"]: r for r in load().collect()}
    assert {k: (r["path"], r["content"], r["deleted"], r["hidden"]) for k, r in got.items()} == {i: (p, c, d, None) for i, p, c, d in rows}
    assert sum(r["exported"] is None for r in got.values()) == 6

    fails = df.select("file_id", "path", F.when(F.col("file_id") == "7", F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="lost"):
        fails.write.format("file_bundle").mode("append").save(root)
    assert load().count() == 40  # a failed write leaves nothing that counts
    df.limit(1).write.format("file_bundle").mode("append").save(root)
    assert load().count() == 41

    victim = next(r for r in got.values() if r["size"])
    with open(f"{root}/{victim['exported']}", "r+b") as f:
        f.write(b"changed!")
    with pytest.raises(Exception, match="changed"):
        load().count()
    with pytest.raises(Exception, match="needs the columns"):
        df.select("file_id").write.format("file_bundle").mode("append").save(root)
    df.limit(2).write.format("file_bundle").mode("overwrite").save(root)
    assert load().count() == 2
