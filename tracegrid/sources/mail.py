"""Mail files to rows: single messages and mailboxes."""

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

MESSAGES = "path string, message_index int, message_id string, sender string, recipients string, subject string, sent string, body string, attachments array<string>"


def message_row(path: str, index: int, raw: bytes) -> tuple:
    """A row of ``MESSAGES`` for one message."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    part = m.get_body(preferencelist=("plain", "html"))
    try:
        body = part.get_content() if part is not None else ""
    except (LookupError, ValueError, KeyError):
        body = ""
    names = [a.get_filename() or "" for a in m.iter_attachments()] if m.is_multipart() else []
    text = lambda x: None if x is None else str(x)
    return (path, index, *(text(m[h]) for h in ("message-id", "from", "to", "subject", "date")), body, names)


def unquoted(line: bytes) -> bytes:
    """A line of a mailbox without the sign that kept it from beginning a message."""
    return line[1:] if line.startswith(b">") and line.lstrip(b">").startswith(b"From ") else line


def split_mailbox(data: bytes) -> list[bytes]:
    """Messages of a mailbox: each begins with a line ``From `` behind a blank line or at the
    start; quoted ``>From `` lines lose their sign."""
    out: list[list[bytes]] = []
    blank = True
    for line in data.splitlines(keepends=True):
        if blank and line.startswith(b"From "):
            out.append([])
        elif out:
            out[-1].append(unquoted(line))
        blank = not line.strip()
    return [b"".join(m) for m in out]


def messages(files: DataFrame) -> DataFrame:
    """Messages of ``path, content`` rows, whether mailboxes or single messages; none for null."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MESSAGES.split(", ")]
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                if data is None:
                    continue
                parts = split_mailbox(data) if data.startswith(b"From ") else [data.split(b"\n", 1)[1] if path.endswith(".emlx") else data]
                yield pd.DataFrame([message_row(path, i, p) for i, p in enumerate(parts)], columns=names)

    return files.select("path", "content").mapInPandas(parse, MESSAGES)


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    return messages(spark.read.format("binaryFile").load(path))


def thread_roots(rows: DataFrame) -> DataFrame:
    """Messages by subject without reply marks, with the size of each thread."""
    subject = F.trim(F.regexp_replace(F.lower(F.coalesce("subject", F.lit(""))), r"^(?:\s*(?:re|fw|fwd)\s*:)+", ""))
    return rows.groupBy(subject.alias("thread")).agg(F.count("*").alias("messages"))
