"""Dataset versions that are verified when they are read.

A generation is a folder ``generation=<name>`` below a root. It counts once its manifest is there,
which is written last: digest and length of each file, in a hidden folder beside the data, so that
the root can be read as a plain table too. Files are hashed in tasks; the manifest stays a table.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class BrokenGeneration(ValueError):
    """A generation that was not written whole, or that changed since."""


def _folder(root: str, generation: str) -> str:
    return f"{root}/generation={generation}"


def _manifest(root: str, generation: str) -> str:
    return f"{root}/_generations/{generation}"


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``file, length, sha256`` of the Parquet files below a folder. A file must be below 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    name = F.element_at(F.split("path", "/generation=[^/]+/"), -1)
    return files.select(name.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def write_generation(df: DataFrame, root: str, generation: str, partition_by: list[str] | None = None) -> str:
    """Write a version and its manifest; one that exists is an error. Returns its folder."""
    path = _folder(root, generation)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    file_digests(df.sparkSession, path).write.parquet(_manifest(root, generation))
    return path


def broken_files(spark: SparkSession, root: str, generation: str) -> DataFrame:
    """``file, problem``: files of a written version that are missing, new or changed."""
    told = spark.read.parquet(_manifest(root, generation)).select("file", F.col("length").alias("was"), F.col("sha256").alias("had"))
    both = told.join(file_digests(spark, _folder(root, generation)), "file", "full_outer")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("sha256") != F.col("had"), "changed")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("file", "problem")


def read_generation(spark: SparkSession, root: str, generation: str, verify: bool = True) -> DataFrame:
    """A version that was written whole and, unless ``verify`` is off, whose files are as they were."""
    try:
        spark.read.parquet(_manifest(root, generation))
    except AnalysisException as missing:
        raise BrokenGeneration(f"generation {generation} was not written whole") from missing
    if verify and (bad := broken_files(spark, root, generation).head(3)):
        raise BrokenGeneration(f"generation {generation}: " + ", ".join(f"{r['file']} is {r['problem']}" for r in bad))
    return spark.read.parquet(_folder(root, generation))


def content_key(df: DataFrame) -> DataFrame:
    """One row that rows in any order share: their number and two sums of their hashes."""
    row = [F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}) for c in sorted(df.columns)]
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), total(F.xxhash64(*row)).alias("a"), total(F.xxhash64(F.lit("b"), *row)).alias("b"))


def clone_generation(spark: SparkSession, root: str, generation: str, target: str) -> str:
    """Copy a verified version to another root and compare what arrived, row by row in any order."""
    source = read_generation(spark, root, generation)
    path = write_generation(source, target, generation)
    if content_key(source).first() != content_key(read_generation(spark, target, generation)).first():
        raise BrokenGeneration(f"the copy of generation {generation} differs")
    return path


def latest(spark: SparkSession, root: str, order: Column | None = None) -> str | None:
    """The greatest name (or by ``order`` over ``generation``) of the versions that were written whole."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/_generations")
    except AnalysisException:
        return None
    names = files.select(F.regexp_extract("path", r"/_generations/([^/]+)/", 1).alias("generation")).distinct()
    row = names.agg(F.max_by("generation", order if order is not None else F.col("generation"))).first()
    return row[0]
