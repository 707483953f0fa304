"""Joins with rules of their own: best path match, temporal proximity, login pairing."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import basename, normalize_path, suffix_key
from ..plans.tables import Tables
from .blocks import block_join
from .grams import holding

PROXIMITY_SECONDS, PROXIMITY_KEEP = 86_400, 3
#: Rows in the fullest bucket of the first look, and how much wider each further look is.
PROXIMITY_ROWS, WIDER = 64, 8


def with_object(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Left join of rows to the file they come from, with a caveat where there is none."""
    known = files.select(F.col("id").alias("source_object_id"), F.col("path").alias("object_path"))
    return rows.join(known, "source_object_id", "left").withColumn(
        "caveat", F.when(F.col("object_path").isNull(), "source object not in catalog")
    )


def object_groups(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """Artifacts and events of each object, counted before a full outer join. Confidence: direct
    with both, strong from three, weak from one."""
    a = artifacts.groupBy("source_object_id").agg(F.count("*").alias("artifacts"))
    e = events.groupBy("source_object_id").agg(F.count("*").alias("events"))
    both = a.join(e, "source_object_id", "full_outer").na.fill(0, ["artifacts", "events"])
    total = F.col("artifacts") + F.col("events")
    confidence = F.when((F.col("artifacts") > 0) & (F.col("events") > 0), "direct").when(total >= 3, "strong").when(total >= 1, "weak").otherwise("heuristic")
    return both.withColumn("confidence", confidence)


def _best(matches: DataFrame, *key: str) -> DataFrame:
    """The best file of each key: same deleted state, shorter path, smaller id. An aggregate and
    not a window, so copies of a popular candidate combine before they move."""
    score = F.struct(
        (F.col("wants_deleted") != F.col("deleted")).cast("int").alias("mismatch"),
        F.length("file_path").alias("length"), F.col("file_id").alias("file_id"), F.col("file_path").alias("file_path"),
    )
    return matches.groupBy(*key).agg(F.min(score).alias("best")).select(*key, "best.file_id", "best.file_path")


def _least_file(files: DataFrame, key: str) -> DataFrame:
    """Of files that any candidate matches alike, the best for each deleted state."""
    best = F.min(F.struct(F.length("file_path").alias("length"), "file_id", "file_path")).alias("f")
    return files.groupBy(key, "deleted").agg(best).select(key, "deleted", "f.file_id", "f.file_path")


def best_path_match(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """For each ``candidate_id, candidate, wants_deleted`` the file with the same normalized path,
    else the best of those whose path ends with the candidate's (without drive and root).

    Suffixes need not begin at a component. Equal candidates are matched once. All but the first
    component of a candidate are whole, so one with a slash shares these, and the sign before them,
    with whatever it matches: a key that each file has once for each depth that occurs. Candidates
    of one component are matched by the ends of different file names, of lengths that occur.
    """
    key, tables = ["norm", "wants_deleted"], Tables(candidates.sparkSession, "best-path")
    # paths in their normal form are written once: as expressions they would be in each branch again
    c = tables.put(candidates.withColumn("norm", normalize_path(F.col("candidate"))))
    wanted = tables.put(c.select(*key).distinct().withColumn("key", suffix_key(F.col("norm"))).where("key <> ''"))
    f = files.select(F.col("id").alias("file_id"), normalize_path(F.col("path")).alias("file_path"), "deleted")
    f = _least_file(f.withColumn("path_key", F.col("file_path")), "path_key")
    f = tables.put(f.withColumn("file_key", suffix_key(F.col("file_path"))))
    exact = tables.put(_best(wanted.join(f, F.col("norm") == F.col("path_key")), *key).withColumn("how", F.lit("exact")))
    rest = tables.put(wanted.join(exact.select(*key), key, "left_anti"))
    named = f

    slashes = F.length("key") - F.length(F.replace("key", F.lit("/")))
    deep = rest.withColumn("depth", slashes).where("depth > 0").withColumn("end", F.expr("right(key, length(substring_index(key, '/', -depth)) + 2)"))
    depths = deep.agg(F.collect_set("depth").alias("depths"))
    tails = named.crossJoin(F.broadcast(depths)).select("file_id", "file_path", "deleted", "file_key", F.explode("depths").alias("depth"))
    tails = tails.withColumn("tail", F.expr("substring_index(file_key, '/', -depth)")).where("length(tail) < length(file_key)")
    tails = tails.select("file_id", "file_path", "deleted", "file_key", "depth", F.expr("right(file_key, length(tail) + 2)").alias("end"))
    by_tail = deep.join(tails, ["depth", "end"]).where(F.expr("endswith(file_key, key)"))

    flat = rest.where(~F.col("key").contains("/")).withColumn("n", F.length("key"))
    names = _least_file(named.withColumn("base", basename(F.col("file_key"))), "base")
    ends = names.crossJoin(F.broadcast(flat.agg(F.collect_set("n").alias("ns")))).select("base", "deleted", "file_id", "file_path", F.explode("ns").alias("n"))
    ends = ends.where("n <= length(base)").withColumn("key", F.expr("right(base, n)"))
    by_end = flat.join(ends, ["key", "n"])

    columns = [*key, "file_id", "file_path", "deleted"]
    suffix = _best(by_tail.select(*columns).unionAll(by_end.select(*columns)), *key).withColumn("how", F.lit("suffix"))
    return c.join(exact.unionByName(tables.put(suffix)), key).select("candidate_id", "file_id", "file_path", "how")


def best_name_match(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """The best file whose name is the last component of the candidate, without case."""
    c = candidates.withColumn("base", basename(normalize_path(F.col("candidate"))))
    f = files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "deleted", F.lower("name").alias("base"))
    return _best(c.join(_least_file(f, "base"), "base"), "candidate_id")


def _needed(right: DataFrame, keep: int) -> DataFrame:
    """Of each key and second the rows that can be among the nearest of a row of another object:
    the first ``keep`` of each object, of the first ``keep + 1`` objects."""
    rows = right.select("match_key", "second", F.col("id").alias("near_id"), F.col("source_object_id").alias("near_object"))
    of_object = Window.partitionBy("match_key", "second", "near_object").orderBy("near_id")
    first = rows.withColumn("r", F.row_number().over(of_object)).where(F.col("r") <= keep)
    first = first.withColumn("lead", F.min("near_id").over(Window.partitionBy("match_key", "second", "near_object")))
    objects = Window.partitionBy("match_key", "second").orderBy("lead")
    return first.withColumn("o", F.dense_rank().over(objects)).where(F.col("o") <= keep + 1).select("match_key", F.col("second").alias("near_second"), "near_id", "near_object")


def temporal_proximity(left: DataFrame, right: DataFrame, seconds: int = PROXIMITY_SECONDS, keep: int = PROXIMITY_KEEP) -> DataFrame:
    """For each row of ``left`` the nearest rows of ``right`` of other objects within so many
    seconds, inclusive, that also share ``match_key``: ``id, near_id, gap, r``.

    Both have id (one row each), source_object_id, second, match_key. Time is cut to buckets so
    narrow that the fullest holds ``PROXIMITY_ROWS`` rows that matter; a row looks at its own and
    both neighbours, an equi-join. Rows that find too few there look again in wider ones, so pairs
    grow with rows and not with their square.
    """
    tables = Tables(left.sparkSession, "proximity")
    near = tables.put(_needed(right, keep))
    width = seconds
    while width > 1:
        fullest = near.groupBy("match_key", F.expr(f"near_second div {width}")).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0]
        if (fullest or 0) <= PROXIMITY_ROWS:
            break
        width = max(1, width // WIDER)
    rest, out = left.select("id", "source_object_id", "second", "match_key"), None
    gap = F.abs(F.col("second") - F.col("near_second"))
    nearest = Window.partitionBy("id").orderBy("gap", "near_id")
    while True:
        here = F.expr(f"second div {width}")
        x = rest.withColumn("bucket", F.explode(F.array(here - 1, here, here + 1)))
        pairs = x.join(near.withColumn("bucket", F.expr(f"near_second div {width}")), ["match_key", "bucket"])
        pairs = pairs.where((gap <= width) & (F.col("source_object_id") != F.col("near_object"))).withColumn("gap", gap)
        found = pairs.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= keep).select("id", "near_id", "gap", "r")
        if width == seconds:
            return found if out is None else out.unionByName(found)
        found = tables.put(found)
        full = found.where(F.col("r") == keep).select("id")
        done = found.join(full, "id", "left_semi")
        out = done if out is None else out.unionByName(done)
        rest, width = tables.put(rest.join(full, "id", "left_anti")), min(seconds, width * WIDER)


def temporal_text_matches(needles: DataFrame, texts: DataFrame, seconds: int = PROXIMITY_SECONDS, gram: int = 4) -> DataFrame:
    """``needle_id, text_id, gap``: texts within so many seconds, inclusive, that contain the needle,
    without case.

    ``needles`` has id, second, needle; ``texts`` id (one row each), second, text. Time is cut to
    buckets of the width, of which a needle looks at its own and both neighbours. In each bucket
    different needles are found in different texts by grams (``gram`` is the signs of the shortest
    that a needle need not fill), and rows follow by the number of a bucket's needle, so pairs are
    made once, by time alone, and go nowhere. They can repeat only where ids do; only these are
    compared with each other. Empty or null needles match nothing.
    """
    tables = Tables(needles.sparkSession, "text-matches")
    bucket = F.expr(f"second div {seconds + 1}")
    here = texts.select(F.col("id").alias("text_id"), F.col("second").alias("text_second"), bucket.alias("bucket"), F.lower("text").alias("text")).where("bucket IS NOT NULL AND text IS NOT NULL")
    asked = needles.select(F.col("id").alias("needle_id"), "second", bucket.alias("bucket"), F.lower("needle").alias("sought")).where("bucket IS NOT NULL AND length(sought) > 0")
    around = F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket")
    different = tables.put(here.select("bucket", "text").distinct().withColumn("place", F.monotonically_increasing_id()))
    sought = tables.put(asked.select("bucket", "sought").distinct().select("sought", around).distinct().withColumn("number", F.monotonically_increasing_id()))
    met = tables.put(holding(sought, different, tables, ["bucket"], gram).select("number", "place"))
    left = asked.select("needle_id", "second", "sought", around).join(sought, ["bucket", "sought"]).select("needle_id", "second", "number")
    right = here.join(different.join(met, "place"), ["bucket", "text"]).select("text_id", "text_second", "number")
    left, right = tables.put(left), tables.put(right)
    gap = F.abs(F.col("second") - F.col("text_second"))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        return block_join(left, right, ["number"], tables).where(gap <= seconds).select("needle_id", "text_id", gap.alias("gap"))

    again = [tables.put(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("id"))) for rows, key in ((asked, "needle_id"), (here, "text_id"))]
    if all(ids.isEmpty() for ids in again):
        return pairs(left, right)

    def parted(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        once, more = (rows.join(ids, F.col(key).eqNullSafe(F.col("id")), how) for how in ("left_anti", "left_semi"))
        return tables.put(once), tables.put(more.distinct())

    (left_once, left_more), (right_once, right_more) = parted(left, "needle_id", again[0]), parted(right, "text_id", again[1])
    compared = pairs(left_more, right_once).unionAll(pairs(left_more, right_more)).unionAll(pairs(left_once, right_more)).distinct()
    return pairs(left_once, right_once).unionAll(compared)


def pair_sessions(records: DataFrame) -> DataFrame:
    """Logins with the logouts that end them, by terminal and process, first in first out.

    ``records`` has key columns pid and terminal, ``second``, ``id`` and ``kind`` (login or
    logout). A logout ends the earliest login that is still open; without one it stands alone,
    and so does a login that nothing ends. The number of open logins is a running sum with a
    floor at zero, so both sides can be numbered and joined without Python.
    """
    order = Window.partitionBy("pid", "terminal").orderBy("second", F.when(F.col("kind") == "login", 0).otherwise(1), "id")
    step = F.when(F.col("kind") == "login", 1).otherwise(-1)
    balance = records.withColumn("balance", F.sum(step).over(order))
    floor = F.least(F.min("balance").over(order), F.lit(0))
    numbered = balance.withColumn("floor", floor).withColumn("before", F.coalesce(F.lag("floor").over(order), F.lit(0)))
    # a logout that lowers the floor has nothing to end
    usable = numbered.withColumn("alone", (F.col("kind") == "logout") & (F.col("floor") < F.col("before")))
    rank = Window.partitionBy("pid", "terminal", "kind", "alone").orderBy("second", "id")
    ranked = usable.withColumn("n", F.row_number().over(rank))
    logins = ranked.where("kind = 'login'").select("pid", "terminal", "n", F.col("id").alias("login_id"), F.col("second").alias("login_second"))
    logouts = ranked.where("kind = 'logout' AND NOT alone").select("pid", "terminal", "n", F.col("id").alias("logout_id"), F.col("second").alias("logout_second"))
    alone = ranked.where("alone").select("pid", "terminal", F.col("id").alias("logout_id"), F.col("second").alias("logout_second"))
    return logins.join(logouts, ["pid", "terminal", "n"], "left").drop("n").unionByName(alone, allowMissingColumns=True)
