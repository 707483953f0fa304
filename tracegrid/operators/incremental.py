"""Correlation that goes on from its last snapshot.

A revision is three generations: the artifacts it knew, their matches, and the snapshot. The next
one looks only at artifacts that are new: rules run for these, and only the files that they touch,
or whose events changed in number, are grouped again. If an artifact vanished or changed, or files
did, everything is computed anew. Either way the result is the full snapshot.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.tables import Tables
from ..sources.generations import latest, read_generation, write_generation
from .correlation import file_rows, match_rows, rule_groups, rule_matches

PARTS = ["artifacts", "files", "events", "matches", "snapshot"]


def _keys(rows: DataFrame, *columns: str) -> DataFrame:
    """``id, key``: a row's id and a digest of what rules read of it."""
    return rows.select("id", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("key"))


def _differ(a: DataFrame, b: DataFrame) -> bool:
    """Whether ``a`` has rows (by all columns) that ``b`` lacks."""
    return not a.join(b, a.columns, "left_anti").isEmpty()


def _event_counts(events: DataFrame) -> DataFrame:
    return events.where("source_object_id IS NOT NULL").groupBy(F.col("source_object_id").alias("file_id")).agg(F.count("*").alias("n"))


class Snapshots:
    """Snapshots of one source below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, part: str, revision: str) -> DataFrame:
        return read_generation(self.spark, f"{self.root}/{part}", revision, verify=False)

    def _write(self, revision: str, **parts: DataFrame) -> None:
        for part in PARTS:  # the snapshot comes last, so a revision counts once it is whole
            write_generation(parts[part], f"{self.root}/{part}", revision)

    def revision(self) -> str | None:
        """The last revision, by number."""
        return latest(self.spark, f"{self.root}/snapshot", F.col("generation").cast("long"))

    def snapshot(self, revision: str | None = None) -> DataFrame:
        return self._read("snapshot", revision or self.revision())

    def refresh(self, artifacts: DataFrame, files: DataFrame, events: DataFrame) -> DataFrame:
        """The snapshot of the given state, kept as the next revision.

        Rows that are null in ``id`` are left out by the rules. ``how`` tells afterwards whether
        the revision was ``full`` or ``added``.
        """
        tables = Tables(self.spark, "refresh")
        now = {
            "artifacts": tables.put(_keys(artifacts, "artifact_type", "attrs")),
            "files": tables.put(_keys(files, "path", "name", "deleted")),
            "events": tables.put(_event_counts(events)),
        }
        last = self.revision()
        before = {part: self._read(part, last) for part in PARTS} if last else {}
        gone = last is None or any(_differ(before[p], now[p]) for p in ("artifacts", "files")) or _differ(now["files"], before["files"])
        self.how = "full" if gone else "added"
        if gone:
            matches = tables.put(rule_matches(artifacts, files))
            rows = match_rows(matches, artifacts).unionAll(file_rows(rule_groups(matches, events), files))
        else:
            fresh = tables.put(artifacts.join(before["artifacts"].select("id"), "id", "left_anti"))
            added = tables.put(rule_matches(fresh, files))
            matches = before["matches"].unionByName(added)
            counts = before["events"].withColumnRenamed("n", "was").join(now["events"], "file_id", "full_outer").where("NOT (n <=> was)")
            touched = tables.put(added.select("file_id").unionByName(counts.select("file_id")).distinct())
            again = rule_groups(matches.join(touched, "file_id", "left_semi"), events.join(touched.withColumnRenamed("file_id", "source_object_id"), "source_object_id", "left_semi"))
            old = before["snapshot"]
            of_file = F.when(F.col("part").isin("cluster", "lead") | F.col("id").startswith("file:"), F.col("a"))
            kept = old.withColumn("_file", of_file).join(touched.select(F.col("file_id").cast("string").alias("_file")), "_file", "left_anti").drop("_file")
            rows = kept.unionByName(match_rows(added, fresh)).unionByName(file_rows(again, files))
        revision = str(int(last) + 1) if last else "1"
        self._write(revision, **now, matches=matches, snapshot=rows)
        return self.snapshot(revision)
