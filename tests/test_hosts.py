"""Event kinds, sites, login records, network facts, topology, browser history."""

import sqlite3
import struct

from tracegrid.operators import hosts
from tracegrid.sources import browser


def test_event_kinds(spark):
    rows = [(4624, None, "SECURITY"), (4624, None, "System"), (12, "Microsoft-Windows-Kernel-General", None), (6005, None, None), (1001, None, "Application"), (7, None, None)]
    found = hosts.classified_events(spark.createDataFrame(rows, "event_id int, provider string, channel string"))
    assert sorted((r["event_id"], r["event_class"], r["kind"]) for r in found.collect()) == [
        (12, "boot", "OperatingSystemStarted"), (1001, "application", "WindowsErrorReporting"), (4624, "security", "LogonSuccess"), (6005, "boot", "EventLogStarted"),
    ]


def test_nginx_sites(spark):
    text = "http {\nserver { # one\n listen 80;\n server_name a.org b.org;\n location / { root /ignored; }\n root /srv/a;\n}\nlisten 99;\nserver {\n listen 443 ssl;\n}\n}"
    lines = [("f", i + 1, x) for i, x in enumerate(text.split("\n"))]
    found = hosts.nginx_sites(spark.createDataFrame(lines, "file_id string, line_number int, line string")).orderBy("site").collect()
    assert [(r["site"], r["server_names"], r["listen"], r["root"]) for r in found] == [(2, "a.org b.org", "80", "/srv/a"), (9, "", "443 ssl", None)]


def test_login_records(spark):
    def record(kind, pid, line, user, second):
        data = struct.pack("<ii32s4s32s256s", kind, pid, line, b"", user, b"host")
        return data + b"\0" * (340 - len(data)) + struct.pack("<i", second) + b"\0" * 40

    content = record(7, 5, b"pts/0", b"me", 100) + record(0, 0, b"", b"", 0) + record(8, 5, b"pts/0", b"", 200)
    files = spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(b"short")), ("c", bytearray(b""))], "id string, content binary")
    found = hosts.login_records(files).orderBy("n").collect()
    assert [(r["kind"], r["pid"], r["terminal"], r["user"], r["second"]) for r in found] == [("login", 5, "pts/0", "me", 100), ("logout", 5, "pts/0", "", 200)]


def test_network_facts(spark):
    rows = [("/etc/hosts", 1, "10.0.0.1 a b"), ("/etc/network/interfaces", 2, "  address 10.0.0.2/24"), ("/x", 3, 'GATEWAY="10.0.0.254"'), ("/x", 4, "nothing"), ("/x", 5, None)]
    found = hosts.network_facts(spark.createDataFrame(rows, "path string, line_number int, line string"))
    assert {(r["fact"], r["value"]) for r in found.collect()} == {("host", "10.0.0.1 a b"), ("address", "10.0.0.2/24"), ("gateway", "10.0.0.254")}


def test_topology_and_filters(spark):
    edges = spark.createDataFrame([("hosts", "pve", "virtualMachine"), ("hosts", "pod", "pve"), ("runs", None, "kubernetes")], "relation string, source_kind string, target_kind string")
    assert hosts.allowed_relations(edges).count() == 1
    notes = spark.createDataFrame([("t", "open", "Title", "Body", ["x"]), ("t", "open", "a", "b", [])], "entry_type string, status string, title string, body string, tags array<string>")
    assert hosts.notebook_filter(notes, "t", "open", "BODY", "x").count() == 1
    objects = spark.createDataFrame([(1, "ready"), (2, "ready"), (3, "new")], "id int, status string")
    assert [r["id"] for r in hosts.unreferenced(objects, spark.createDataFrame([(2,)], "object_id int")).collect()] == [1]
    carved = spark.createDataFrame([(1, "carving.jpg", "Cat", "{}"), (2, "other", "Cat", "{}"), (3, "carving.png", "x", '{"k":"CAT"}')], "id int, family string, title string, attrs string")
    assert [r["id"] for r in hosts.carved_search(carved, "cat").collect()] == [1, 3]


def test_browser_history(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "h")
    db.executescript("CREATE TABLE urls(id INTEGER, url TEXT, title TEXT, visit_count INTEGER); CREATE TABLE visits(id INTEGER, url INTEGER, visit_time INTEGER);"
                     "INSERT INTO urls VALUES (1, 'http://a', 'A', 3); INSERT INTO visits VALUES (1, 1, 13348540800000000), (2, 9, 0);")  # fmt: skip
    db.commit()
    db.close()
    files = spark.createDataFrame([("x", bytearray((tmp_path / "h").read_bytes())), ("y", bytearray(b"no")), ("z", None)], "id string, content binary")
    found = browser.history(files).orderBy("row_id").collect()
    assert [(r["url"], r["visit_count"], r["visit_time"] and r["visit_time"].year) for r in found] == [("http://a", 3, 2024), (None, None, None)]


def test_slots_by_user(spark):
    last = lambda form, second, line: struct.pack(form, second, line, b"h")
    narrow, wide = "<i32s256s", "<q32s256s"
    files = [
        ("a", bytearray(bytes(292) + last(narrow, 100, b"pts/0") + last(narrow, 0, b"tty1"))),
        ("b", bytearray(last(wide, 200, b"pts/1") + bytes(296))),
        ("c", bytearray(last(narrow, 300, b"pts/2") + b"cut off")),
        ("d", bytearray(b"\xff" * 292)), ("e", bytearray(b"")), ("f", None),
    ]
    found = hosts.last_logins(spark.createDataFrame(files, "id string, content binary")).collect()
    assert sorted((r["file_id"], r["uid"], r["terminal"], r["host"], r["second"]) for r in found) == [
        ("a", 1, "pts/0", "h", 100), ("a", 2, "tty1", "h", None), ("b", 0, "pts/1", "h", 200), ("c", 0, "pts/2", "h", 300),
    ]
    assert hosts.login_failures(spark.createDataFrame(files[3:], "id string, content binary")).count() == 0


def test_package_logs(spark):
    from tracegrid.operators import logs

    lines = [("f", i, x) for i, x in enumerate(["2024-01-15 10:30:00 upgrade a:all 1 2", "2024-01-15 10:30:00 configure b:all 3 <none>", "bad 10:30:00 purge c:all", "2024-01-15 10:30:00 status installed d", "", None])]
    found = logs.parse_dpkg(spark.createDataFrame(lines, "file_id string, line_number int, line string")).orderBy("line_number").collect()
    assert [(r["action"], r["package"], r["version"], r["ts"] is None) for r in found] == [("upgrade", "a:all", "2", False), ("configure", "b:all", "3", False), ("purge", "c:all", None, True)]
    lines = ["2024-01-15T10:30:00+0100 INFO Installed: a-b-1-2.x", "Feb 29 01:00:00 Updated: c-1", "Jan 02 01:00:00 Reinstalled: d-1-1,", "Jan 02 01:00:00 Installed:", None]
    frame = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file_id string, line_number int, line string").selectExpr("*", "TIMESTAMP '2024-02-01 00:00:00' AS reference")
    found = logs.parse_rpm(frame).selectExpr("*", "unix_seconds(ts) AS s").orderBy("line_number").collect()
    assert [(r["action"], r["package"], r["version"]) for r in found] == [("install", "a-b", "1-2.x"), ("upgrade", "c-1", None), ("reinstall", "d", "1-1")]
    assert found[0]["s"] == 1705311000 and found[1]["ts"] is None and found[2]["ts"].year == 2024
