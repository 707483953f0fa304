"""Extractors as plug-ins: which one reads a file, and running them in tasks."""

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

ARTIFACTS = "source_object_id string, extractor_id string, family string, title string, attrs string"


@dataclass(frozen=True)
class Extractor:
    """What reads files of some paths. ``run`` takes a path and bytes and gives (family, title,
    attributes as JSON); families outside of ``families`` are dropped. ``columns`` are attributes
    with their types (string, long, double, boolean) that a table function gives as columns."""

    id: str
    families: frozenset[str]
    run: Callable[[str, bytes], list[tuple[str, str, str]]]
    suffixes: tuple[str, ...] = ()
    fragments: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    plugin: bool = False
    columns: tuple[tuple[str, str], ...] = ()

    def takes(self, path: str) -> bool:
        """As ``supports``, for one path."""
        p = path.replace("\\", "/").lower()
        ends = any(p.endswith(s.lower()) for s in self.suffixes)
        return ends or any(f.lower() in p for f in self.fragments) or p.rsplit("/", 1)[-1] in {n.lower() for n in self.names}

    def supports(self, path: Column) -> Column:
        """Whether a path has one of the suffixes, fragments or names, without case."""
        p = F.lower(F.translate(path, "\\", "/"))
        found = F.lit(False)
        for s in self.suffixes:
            found |= p.endswith(s.lower())
        for f in self.fragments:
            found |= p.contains(f.lower())
        for n in self.names:
            found |= F.element_at(F.split(p, "/"), -1) == n.lower()
        return found


@dataclass
class Registry:
    extractors: list[Extractor] = field(default_factory=list)

    def add(self, extractor: Extractor) -> None:
        if any(e.id == extractor.id for e in self.extractors):
            raise ValueError(f"extractor {extractor.id} is there already")
        self.extractors.append(extractor)

    def chosen(self, path: Column) -> Column:
        """Ids of the extractors for a path. A plug-in replaces built-in ones of its families."""
        ids = []
        for e in self.extractors:
            wanted = e.supports(path)
            if not e.plugin:
                for other in self.extractors:
                    if other.plugin and other.families & e.families:
                        wanted &= ~other.supports(path)
            ids.append(F.when(wanted, F.lit(e.id)))
        return F.array_compact(F.array(*ids)) if ids else F.array().cast("array<string>")

    def chosen_for(self, path: str | None) -> list[str]:
        """As ``chosen``, for one path."""
        able = [e for e in self.extractors if path is not None and e.takes(path)]
        return [e.id for e in able if e.plugin or not any(o.plugin and o.families & e.families for o in able)]

    def extract(self, files: DataFrame) -> DataFrame:
        """Artifacts of ``id, path, content`` rows. An extractor that fails on a file gives an
        artifact of the family ``error``."""
        by_id = {e.id: e for e in self.extractors}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for r in batch.itertuples():
                    e = by_id[r.extractor_id]
                    try:
                        found = e.run(r.path, bytes(r.content))
                    except Exception as problem:  # one file must not end the job
                        rows.append((r.id, e.id, "error", type(problem).__name__, "{}"))
                        continue
                    rows += [(r.id, e.id, f, t, a) for f, t, a in found if f in e.families]
                yield pd.DataFrame(rows, columns=["source_object_id", "extractor_id", "family", "title", "attrs"])

        wanted = files.select(F.col("id").cast("string").alias("id"), "path", "content", F.explode(self.chosen(F.col("path"))).alias("extractor_id"))
        return wanted.mapInPandas(run, ARTIFACTS)


def as_table_function(spark: SparkSession, registry: Registry, name: str = "extract_artifacts") -> None:
    """Make the extractors of a registry a table function of SQL:

        SELECT * FROM extract_artifacts(TABLE(files) PARTITION BY id, extractor => 'shell-history')

    Its columns come from the extractor that is named: ``source_object_id, family, title`` and the
    attributes that it declares, then ``dropped``. Files (id, path, content) that it doesn't
    support, or that a plug-in takes over, give no rows; artifacts of families that it doesn't
    declare are counted, in a row of the family ``dropped`` for each partition that has some. A
    file that fails gives a row of the family ``error``.
    """
    by_id = {e.id: e for e in registry.extractors}
    kinds = {"string": StringType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType()}

    class Extract:
        @staticmethod
        def analyze(files: AnalyzeArgument, extractor: AnalyzeArgument) -> AnalyzeResult:
            if not files.isTable or not {"id", "path", "content"} <= set(files.dataType.names):
                raise ValueError("the first argument is a table with id, path and content")
            if extractor.value not in by_id:
                raise ValueError(f"no extractor {extractor.value}")
            schema = StructType().add("source_object_id", StringType()).add("family", StringType()).add("title", StringType())
            for column, kind in by_id[extractor.value].columns:
                schema = schema.add(column, kinds[kind])
            return AnalyzeResult(schema=schema.add("dropped", LongType()))

        def __init__(self):
            self.dropped, self.columns = 0, 0

        def eval(self, row: Row, extractor: str):
            e = by_id[extractor]
            self.columns = len(e.columns)
            if extractor not in registry.chosen_for(row["path"]) or row["content"] is None:
                return
            key = str(row["id"])
            try:
                found = e.run(row["path"], bytes(row["content"]))
            except Exception as problem:  # one file must not end the job
                yield key, "error", type(problem).__name__, *[None] * self.columns, None
                return
            for family, title, attrs in found:
                if family in e.families:
                    read = json.loads(attrs)
                    yield key, family, title, *(read.get(c) for c, _ in e.columns), None
                else:
                    self.dropped += 1

        def terminate(self):
            if self.dropped:
                yield None, "dropped", None, *[None] * self.columns, self.dropped

    spark.udtf.register(name, udtf(Extract))
