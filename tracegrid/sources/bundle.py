"""Bundles of raw files with a manifest: a Python data source that writes and reads them.

Tasks write files below names of their own and a list of what they wrote; a lost or failed task
leaves nothing that counts. The commit writes the bundle's manifest, which names the lists and
their digests, so the driver holds a line for each task and not for each file. Readers go by the
manifest alone and refuse what changed.

    df.write.format("file_bundle").mode("append").save(path)   # file_id, path, content, ...
    spark.read.format("file_bundle").load(path)
"""

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .readers import opened

FILES = "file_id string, path string, deleted boolean, hidden boolean, system boolean, content binary"
#: What the manifest tells of a file; null content is listed as skipped, with no export path.
ENTRY = ["file_id", "path", "deleted", "hidden", "system"]
MANIFEST = "manifest.json"


class BrokenBundle(ValueError):
    """A bundle without a manifest, or whose files are not as they were written."""


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its list, the digest of the list, and counts."""

    listed: str
    sha256: str
    exported: int
    skipped: int


@dataclass
class Part(InputPartition):
    listed: str
    sha256: str


def _read(system: fs.FileSystem, path: str) -> bytes:
    try:
        with system.open_input_file(path) as f:
            return f.read()
    except OSError as problem:
        raise BrokenBundle(f"{path} can't be read") from problem


def _write(system: fs.FileSystem, path: str, data: bytes) -> None:
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(path) as f:
        f.write(data)


@dataclass
class BundleWriter(DataSourceWriter):
    root: str
    overwrite: bool = False
    names: list[str] = field(default_factory=list)

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = opened(self.root)
        attempt, lines, exported = uuid.uuid4().hex, [], 0
        for n, row in enumerate(rows):
            entry = {c: row[c] if c in self.names else None for c in ENTRY}
            if row["content"] is None:
                lines.append(entry | {"exported": None, "size": None, "sha256": None})
                continue
            data = bytes(row["content"])
            name = re.sub(r"[^\w.-]", "_", posixpath.basename((row["path"] or "").replace("\\", "/")))[-100:]
            place = f"files/{attempt}/{n:07d}-{name}"
            _write(system, f"{root}/{place}", data)
            exported += 1
            lines.append(entry | {"exported": place, "size": len(data), "sha256": sha256(data).hexdigest()})
        listed = "\n".join(json.dumps(x) for x in lines).encode()
        place = f"lists/{attempt}.jsonl"
        _write(system, f"{root}/{place}", listed)
        return Written(place, sha256(listed).hexdigest(), exported, len(lines) - exported)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        parts = [{"list": m.listed, "sha256": m.sha256, "exported": m.exported, "skipped": m.skipped} for m in messages if m]
        if not self.overwrite and system.get_file_info(f"{root}/{MANIFEST}").is_file:
            parts = json.loads(_read(system, f"{root}/{MANIFEST}"))["parts"] + parts
        told = {"exported": sum(p["exported"] for p in parts), "skipped": sum(p["skipped"] for p in parts), "parts": parts}
        _write(system, f"{root}/{MANIFEST}.new", json.dumps(told).encode())
        system.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what finished tasks wrote; what failed ones left is in no list."""
        system, root = opened(self.root)
        for m in messages:
            if m:
                system.delete_file(f"{root}/{m.listed}")
                folder = f"{root}/files/{posixpath.basename(m.listed).removesuffix('.jsonl')}"
                if m.exported:
                    system.delete_dir(folder)


class BundleReader(DataSourceReader):
    """Files of a bundle with their content, each checked against the manifest."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Part]:
        system, root = opened(self.root)
        return [Part(p["list"], p["sha256"]) for p in json.loads(_read(system, f"{root}/{MANIFEST}"))["parts"]] or [Part("", "")]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.listed:
            return
        system, root = opened(self.root)
        listed = _read(system, f"{root}/{part.listed}")
        if sha256(listed).hexdigest() != part.sha256:
            raise BrokenBundle(f"{part.listed} changed")
        for line in listed.splitlines():
            entry, data = json.loads(line), None
            if entry["exported"]:
                data = _read(system, f"{root}/{entry['exported']}")
                if len(data) != entry["size"] or sha256(data).hexdigest() != entry["sha256"]:
                    raise BrokenBundle(f"{entry['exported']} changed")
            yield *(entry[c] for c in ENTRY), entry["exported"], entry["size"], entry["sha256"], data


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_bundle"

    def schema(self) -> str:
        return FILES.replace("content binary", "exported string, size long, sha256 string, content binary")

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        if missing := {"file_id", "path", "content"} - set(schema.names):
            raise ValueError(f"a bundle needs the columns {', '.join(sorted(missing))}")
        return BundleWriter(self.options["path"], overwrite, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BundleSource)
