"""Browser databases: history visits from SQLite files, one file in a task at a time."""

import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import from_firefox, from_webkit

VISITS = "file_id string, browser string, row_id long, url string, title string, visit_count long, raw_time long"
_SCHEMAS = {
    "chromium": ("visits", "SELECT v.rowid, u.url, u.title, u.visit_count, v.visit_time FROM visits v LEFT JOIN urls u ON u.id = v.url ORDER BY v.rowid"),
    "firefox": (
        "moz_historyvisits",
        "SELECT v.rowid, p.url, p.title, p.visit_count, v.visit_date FROM moz_historyvisits v LEFT JOIN moz_places p ON p.id = v.place_id ORDER BY v.rowid",
    ),
}


def visit_time(browser: Column, raw: Column) -> Column:
    return F.when(browser == "chromium", from_webkit(raw)).when(browser == "firefox", from_firefox(raw))


def history(files: DataFrame) -> DataFrame:
    """Visits of ``id, content`` rows that hold history databases, with their time in UTC. Files
    that aren't such databases give no rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, data in zip(batch["id"], batch["content"], strict=True):
                rows = []
                if data is not None and bytes(data[:15]) == b"SQLite format 3":
                    with tempfile.TemporaryDirectory() as folder:  # a copy for this task alone
                        path = os.path.join(folder, "db")
                        with open(path, "wb") as f:
                            f.write(bytes(data))
                        db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
                        try:
                            tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master")}
                            for browser, (table, sql) in _SCHEMAS.items():
                                if table in tables:
                                    rows += [(file_id, browser, *r) for r in db.execute(sql)]
                        except sqlite3.DatabaseError:
                            rows = []
                        finally:
                            db.close()
                columns = [c.split()[0] for c in VISITS.split(", ")]
                yield pd.DataFrame(rows, columns=columns).astype({"row_id": "Int64", "visit_count": "Int64", "raw_time": "Int64"})

    visits = files.select(F.col("id").cast("string").alias("id"), "content").mapInPandas(read, VISITS)
    return visits.withColumn("visit_time", visit_time(F.col("browser"), F.col("raw_time")))
