"""Python data sources for evidence files: mailboxes in byte ranges, and browser databases.

``register(spark)`` makes them formats of ``spark.read``. Files are reached through Arrow's file
systems, so paths can be local, HDFS or object stores.

    spark.read.format("mailbox").load("hdfs://…/mail")
    spark.read.format("browser_db").option("table", "cookies").load("…/profiles")
"""

import os
import sqlite3
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .mail import MESSAGES, message_row, unquoted

#: Bytes of a mailbox that a task reads, unless the option ``split`` says otherwise.
SPLIT = 64 << 20
#: Bytes read at once.
BLOCK = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def files_below(path: str) -> list[fs.FileInfo]:
    """The files of a folder, at any depth and in order of their paths, or the one file."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(inner) :].split("/"))
    return sorted((f for f in found if f.is_file and not hidden(f.path)), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    """Bytes of a file, from ``start`` on and before ``end``."""

    path: str
    start: int
    end: int


class PathReader(DataSourceReader):
    """A reader of files whose filters on ``path`` choose the files before any is opened."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("path",), str(value)):
                    self.paths = {value} if self.paths is None else self.paths & {value}
                case In(("path",), values) if all(isinstance(v, str) for v in values):
                    self.paths = set(values) if self.paths is None else self.paths & set(values)
                case _:
                    yield f

    def chosen(self) -> list[fs.FileInfo]:
        return [f for f in files_below(self.root) if self.paths is None or f.path in self.paths]


class MailboxReader(PathReader):
    """Messages of mailboxes. A message belongs to the range in which its ``From `` line begins; a
    range reads on behind its end until its last message is whole, so each comes once."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        return [Range(f.path, at, min(f.size, at + self.split)) for f in self.chosen() for at in range(0, f.size, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        system, _ = opened(self.root)
        with system.open_input_file(part.path) as file:
            for offset, raw in messages_in(file, part.start, part.end):
                path, _, *rest = message_row(part.path, 0, raw)
                yield offset, path, *rest


def _lines(file, at: int) -> Iterator[tuple[int, bytes]]:
    """Lines from byte ``at`` on with their places; the first may be the rest of one."""
    file.seek(at)
    rest = b""
    while block := file.read(BLOCK):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield at, line + b"\n"
            at += len(line) + 1
    if rest:
        yield at, rest


def _line_start(file, at: int) -> int:
    """Where the line begins that holds byte ``at - 1``; 0 at the beginning."""
    while at > 0:
        size = min(BLOCK, at)
        file.seek(at - size)
        found = file.read(size).rfind(b"\n", 0, size)
        if found >= 0:
            return at - size + found + 1
        at -= size
    return 0


def messages_in(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``offset, message`` of the messages that begin from byte ``start`` on and before ``end``."""
    at = _line_start(file, start - 1) if start else 0  # the line before decides whether one begins
    blank, offset, held = True if at == 0 else None, None, []
    for place, line in _lines(file, at):
        if blank and line.startswith(b"From ") and place >= start:
            if offset is not None:
                yield offset, b"".join(held)
            if place >= end:
                return
            offset, held = place, []
        elif offset is not None:
            held.append(unquoted(line))
        elif place >= end:
            return
        blank = not line.strip()
    if offset is not None:
        yield offset, b"".join(held)


class MailboxSource(DataSource):
    """Messages with the file and the byte at which they begin."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return "offset long, " + MESSAGES.replace("message_index int, ", "")

    def reader(self, schema) -> MailboxReader:
        return MailboxReader(self.options)


#: Tables of browser databases, with columns named alike. Of each table the first
#: statement is used whose tables the file has.
TABLES = {
    "history": (
        "path string, browser string, row_id long, url string, title string, visit_count long, raw_time long",
        [
            ("chromium", {"visits", "urls"}, "SELECT v.rowid, u.url, u.title, u.visit_count, v.visit_time FROM visits v LEFT JOIN urls u ON u.id = v.url ORDER BY v.rowid"),
            ("firefox", {"moz_historyvisits", "moz_places"}, "SELECT v.rowid, p.url, p.title, p.visit_count, v.visit_date FROM moz_historyvisits v LEFT JOIN moz_places p ON p.id = v.place_id ORDER BY v.rowid"),
        ],
    ),
    "downloads": (
        "path string, browser string, row_id long, url string, target_path string, raw_start long, raw_end long, total_bytes long, state long",
        [
            ("chromium", {"downloads", "downloads_url_chains"}, "SELECT d.rowid, c.url, d.target_path, d.start_time, d.end_time, d.total_bytes, d.state FROM downloads d LEFT JOIN downloads_url_chains c ON c.id = d.id AND c.chain_index = (SELECT max(chain_index) FROM downloads_url_chains x WHERE x.id = d.id) ORDER BY d.rowid"),
            ("firefox", {"moz_annos", "moz_anno_attributes", "moz_places"}, "SELECT a.rowid, p.url, a.content, a.dateAdded, NULL, NULL, NULL FROM moz_annos a JOIN moz_anno_attributes n ON n.id = a.anno_attribute_id LEFT JOIN moz_places p ON p.id = a.place_id WHERE n.name = 'downloads/destinationFileURI' ORDER BY a.rowid"),
        ],
    ),
    "cookies": (
        "path string, browser string, row_id long, domain string, name string, cookie_path string, raw_created long, raw_expiry long, secure boolean, http_only boolean",
        [
            ("chromium", {"cookies"}, "SELECT rowid, host_key, name, path, creation_utc, expires_utc, is_secure, is_httponly FROM cookies ORDER BY rowid"),
            ("firefox", {"moz_cookies"}, "SELECT rowid, host, name, path, creationTime, expiry, isSecure, isHttpOnly FROM moz_cookies ORDER BY rowid"),
        ],
    ),
}


class BrowserReader(PathReader):
    """Rows of one table of all browser databases below a folder, a file in a task at a time.
    Files that aren't such databases, or broken ones, give no rows."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.table = options.get("table", "history")
        if self.table not in TABLES:
            raise ValueError(f"table must be one of {', '.join(TABLES)}")

    def partitions(self) -> list[Range]:
        return [Range(f.path, 0, f.size) for f in self.chosen()] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        schema, statements = TABLES[self.table]
        flags = [i for i, c in enumerate(schema.split(", ")) if c.endswith("boolean")]
        if not part.path:
            return
        system, _ = opened(self.root)
        with system.open_input_file(part.path) as file, tempfile.TemporaryDirectory() as folder:
            if file.read(15) != b"SQLite format 3":
                return
            file.seek(0)
            copy = os.path.join(folder, "db")  # a copy for this task alone
            with open(copy, "wb") as out:
                while block := file.read(BLOCK):
                    out.write(block)
            db = sqlite3.connect(f"file:{copy}?mode=ro&immutable=1", uri=True)
            try:
                there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
                for browser, needed, sql in statements:
                    if needed <= there:
                        for r in db.execute(sql).fetchall():
                            row = [part.path, browser, *r]
                            for i in flags:
                                row[i] = None if row[i] is None else bool(row[i])
                            yield tuple(row)
            except sqlite3.DatabaseError:
                return
            finally:
                db.close()


class BrowserSource(DataSource):
    """Tables of browser databases; the option ``table`` says which."""

    @classmethod
    def name(cls) -> str:
        return "browser_db"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "history")][0]

    def reader(self, schema) -> BrowserReader:
        return BrowserReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MailboxSource, BrowserSource):
        spark.dataSource.register(source)
