"""Fuzzy line dedup by MinHash, in DataFrame and SQL functions alone.

Lines are compared lower-cased and trimmed; those shorter than ``MIN_CHARS`` are never touched.
Two lines are similar if their sets of ``SHINGLE``-character shingles have a Jaccard similarity of
``PERCENT`` or more. Buckets come from signatures over character shingles:

* A line of few words is signed by all its shingles: ``SHORT_BANDS`` permutations of their hashes,
  the ``SHORT_HASHES`` least of each being a band; from ``SHORT_CIRCLE`` on by one order, as below.
* A line of more words is signed by the shingles that begin at its words and end ``BEYOND``
  characters into the next, by ``BANDS`` permutations in the same way. With many of them, one order
  does: hashes lie on a circle, fixed points divide it, and the ``BAND_HASHES`` hashes that follow a
  point are a band (one-permutation hashing).
* Lines near a limit have both kinds of bands, so that pairs across it are found.

In a bucket all members are compared with its center, and links are united (``components``). Buckets
that then hold several components are finished whole: those of at most ``WHOLE`` members by all pairs
across components. In larger ones each member outside of the largest component meets some members of
it; then come the pairs across components that the distances to a center do not exclude (``stars``),
which are found without comparing all. The center is now the best member of the largest component.

Each line that shares a bucket has ``marks``: the size of its set, and ``MARKS`` words of 64 bits in
which each shingle sets one. Sets differ in at least as many shingles as their marks do in bits, so
pairs whose marks differ too much are no links, and most are told so without their texts. Every link
is confirmed by the exact similarity of both sets. Of each component only the first line of the least
document stays.

Lines are known by a 64-bit hash of their compared form, beside which a second one is kept: lines
that share the first alone are repeated only where both hashes are, so none goes for another.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .scratch import Scratch
from .stars import pairs_behind_center, unfinished

MIN_CHARS, SHINGLE, PERCENT = 20, 5, 80
#: Lines of fewer different anchored shingles than the first are signed by all shingles, from the second on by anchored ones alone.
FEW, MANY = 12, 16
SHORT_BANDS, SHORT_HASHES = 8, 4
#: From the first number of shingles on their bands come from points, up to the second from permutations.
SHORT_CIRCLE = 48, 60
#: An anchored shingle is a word and so many characters of the next.
BEYOND, BANDS, BAND_HASHES = 3, 8, 3
#: From the first number of anchored shingles on bands come from points, up to the second from permutations.
CIRCLE = 24, 30
#: Buckets of so many members are finished by all pairs across components.
WHOLE = 32
#: Members of larger ones first meet so many members of the bucket's largest component.
PICKS = 4
#: Words of 64 bits that tell how much sets differ at least, a power of two; half full at some 700 shingles.
MARKS = 16


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``; a projected column would be
    put in place of each use and evaluated there again."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def compared(line: Column) -> Column:
    return F.lower(F.trim(line))


def _row_id() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _shingles(line: str) -> str:
    """SQL for the hashes of a line's different shingles."""
    return f"array_distinct(transform(regexp_extract_all({line}, '(?s)(?=(.{{{SHINGLE}}}))', 1), x -> xxhash64(x)))"


def _bands(line: str) -> str:
    """SQL for the bucket keys of a line."""

    def by_points(hashes: str, count: int, least: int) -> str:
        step = (1 << 64) // count
        points = ", ".join(f"bigint({-(1 << 63) + step // 2 + j * step})" for j in range(count))
        # s has hashes and points in order, the first ones again behind the last; a point's band follows it
        following = ", ".join(f"s[i + {k}]" for k in range(1, least + 1))
        marked = f"array_compact(transform(slice(s, 1, size({hashes}) + {count}), (x, i) -> if((x & {step - 1}L) = {step // 2}L, xxhash64(x, {following}), null)))"
        return _let(_let(f"sort_array(concat({hashes}, array({points})))", "c", f"concat(c, slice(c, 1, {least}))"), "s", marked)

    def permuted(hashes: str, first: int, count: int, least: int) -> str:
        kept = f"slice(sort_array(transform({hashes}, x -> xxhash64(x, k))), 1, {least})"
        return f"transform(sequence({first}, {first + count - 1}), k -> xxhash64(k, {kept}))"

    none = "cast(array() AS array<bigint>)"
    short = permuted("g", SHORT_BANDS, SHORT_BANDS, SHORT_HASHES)
    longer = by_points("g", SHORT_BANDS, SHORT_HASHES)
    both = f"concat(if(size(g) <= {SHORT_CIRCLE[1]}, {short}, {none}), if(size(g) >= {SHORT_CIRCLE[0]}, {longer}, {none}))"
    all_shingles = _let(_shingles(line), "g", both)
    few = permuted("h", 2 * SHORT_BANDS, BANDS, BAND_HASHES)
    bands = (
        f"concat(if(size(h) < {MANY}, {all_shingles}, {none}),"
        f" if(size(h) BETWEEN {FEW} AND {CIRCLE[1]}, {few}, {none}), if(size(h) >= {CIRCLE[0]}, {by_points('h', BANDS, BAND_HASHES)}, {none}))"
    )
    anchors = f"zip_with(w, slice(w, 2, size(w)), (x, y) -> xxhash64(x, left(y, {BEYOND})))"
    return _let(f"split({line}, ' ')", "w", _let(f"array_distinct({anchors})", "h", bands))


def _signed(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, pos, id, check, bands`` of lines that take part. ``rid`` tells rows apart by doc_id
    and text, ``id`` and ``check`` lines by their compared form."""
    exploded = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _row_id().alias("rid"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "raw")
    )
    # the filter repeats what it reads, so it reads no more than it must
    lines = exploded.where(F.length(F.trim("raw")) >= MIN_CHARS).select("rid", "doc_id", "pos", compared(F.col("raw")).alias("line"))
    second = F.xxhash64(F.lit("second"), "line").alias("check")
    return lines.select("rid", "doc_id", "pos", F.xxhash64("line").alias("id"), second, F.expr(_bands("line")).alias("bands"))


def _marked(texts: DataFrame) -> DataFrame:
    """``id, marks``: each line's set size n and its words of bits."""
    shingles = texts.select("id", F.explode_outer(F.expr(_shingles("line"))).alias("x"))
    bit = "shiftleft(1L, cast(shiftrightunsigned(x, 8) & 63 AS int))"
    words = [F.bit_or(F.expr(f"if((x & {MARKS - 1}) = {i}, {bit}, 0L)")) for i in range(MARKS)]
    return shingles.groupBy("id").agg(F.struct(F.count("x").alias("n"), F.array(*words).alias("bits")).alias("marks"))


def _likely(x: str, y: str) -> str:
    """SQL that is false only if the lines with the marks x and y are not similar: sets that differ in d
    shingles are similar if (100 + PERCENT) * d is at most (100 - PERCENT) times the size of both together."""
    differ = " + ".join(f"bit_count({x}.bits[{i}] ^ {y}.bits[{i}])" for i in range(MARKS))
    return f"{100 + PERCENT} * greatest(abs({x}.n - {y}.n), {differ}) <= {100 - PERCENT} * ({x}.n + {y}.n)"


def _texts(docs: DataFrame, signed: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, line``: the compared form of each of ``ids``, from one of its places."""
    spots = signed.select("id", "rid", "pos").join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("rid", "pos")).alias("at"))
    wanted = spots.groupBy("at.rid").agg(F.collect_list(F.struct("id", "at.pos")).alias("spots"))
    rows = docs.select(_row_id().alias("rid"), "text").join(wanted, "rid")
    found = _let("split(text, '\n')", "parts", "transform(spots, s -> struct(s.id AS id, lower(trim(get(parts, s.pos))) AS line))")
    return rows.select(F.explode_outer(F.expr(found)).alias("x")).groupBy("x.id").agg(F.first("x.line").alias("line"))


def _with_lines(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    ta = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    tb = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    return pairs.join(tb, "b").join(ta, "a")


def _of_sets(body: str) -> str:
    """SQL of both sets, t.x and t.y, each made once."""
    return _let(f"struct({_shingles('line_a')} AS x, {_shingles('line_b')} AS y)", "t", body)


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that are similar, as ``src, dst``."""
    counts = "struct(size(t.x) + size(t.y) AS n, size(array_intersect(t.x, t.y)) AS both)"
    similar = _of_sets(_let(counts, "u", f"100 * u.both >= {PERCENT} * (u.n - u.both)"))
    return _with_lines(pairs, texts).where(similar).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _shared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with the number of shingles they share, ``both``."""
    return _with_lines(pairs, texts).select("a", "b", F.expr(_of_sets("size(array_intersect(t.x, t.y))")).alias("both"))


def _beyond(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, shingle``: what b's set has beyond a's."""
    rest = F.explode_outer(F.expr(_of_sets("array_except(t.y, t.x)"))).alias("shingle")
    return _with_lines(pairs, texts).select("a", "b", rest).where("shingle IS NOT NULL")


def _likely_of(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that their marks do not exclude, each once."""
    of_a, of_b = (marks.select(F.col("id").alias(s), F.col("marks").alias(f"marks_{s}")) for s in "ab")
    return pairs.distinct().join(of_b, "b").join(of_a, "a").where(_likely("marks_a", "marks_b")).select("a", "b")


def _across(rest: DataFrame) -> DataFrame:
    """Likely pairs ``a, b`` across the components of each bucket, of all its members."""
    x, y = (rest.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "label", "marks"))) for s in "ab")
    pairs = x.join(y, "bucket").where(f"id_a < id_b AND label_a <> label_b AND {_likely('marks_a', 'marks_b')}")
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _with_largest(rest: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each bucket's members with some of its largest component, which are drawn by hash."""
    picks = F.array(*(F.min_by("id", F.xxhash64("bucket", "id", F.lit(i))) for i in range(PICKS)))
    parts = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"), picks.alias("picks"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("n", "label", "picks")).alias("most"))
    drawn = largest.select("bucket", F.col("most.label").alias("of"), F.explode_outer("most.picks").alias("drawn"))
    pairs = rest.join(drawn, "bucket").where("label <> of")
    return pairs.select(F.least("drawn", "id").alias("a"), F.greatest("drawn", "id").alias("b"))


def _united(rest: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of the buckets that more links leave split, with the components they now have."""
    labels = scratch.put(rest.select("id", "label").distinct())
    of_src, of_dst = (labels.select(F.col("id").alias(c), F.col("label").alias(f"of_{c}")) for c in ("src", "dst"))
    joined = links.join(of_src, "src").join(of_dst, "dst").select(F.col("of_src").alias("src"), F.col("of_dst").alias("dst"))
    merged = components(joined, scratch).withColumnRenamed("id", "label")
    now = labels.join(merged, "label", "left").select("id", F.coalesce("component", "label").alias("component"))
    return unfinished(rest, scratch.put(now), scratch)


def _behind_centers(rest: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``a, b`` across the components of each bucket that can be links by what they share with its
    center, which is now the best member of its largest component."""
    parts = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.max(F.struct("score", "id")).alias("top"))
    centers = parts.groupBy("bucket").agg(F.max(F.struct("n", "label", "top")).alias("most")).select("bucket", F.col("most.top.id").alias("center"))
    inner = rest.join(centers, "bucket").where("id <> center")
    inner = scratch.put(inner.select("center", "id", "label", F.col("marks.n").alias("n")).distinct())
    known = _shared(inner.select(F.col("center").alias("a"), F.col("id").alias("b")), texts)
    known = known.select(F.col("a").alias("center"), F.col("b").alias("id"), F.col("both").alias("u"))
    of_center = rest.select(F.col("id").alias("center"), F.col("label").alias("at_center")).distinct()
    apart = (F.col("label") != F.col("at_center")).alias("apart")
    inner = inner.join(known, ["center", "id"]).join(of_center, "center")
    inner = scratch.put(inner.select("center", "id", "label", apart, "n", "u"))
    return pairs_behind_center(inner, lambda pairs: _beyond(pairs, texts), PERCENT, scratch)


def _linked(members: DataFrame, texts: DataFrame, marks: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, component`` of lines with a link in one of their buckets. ``members`` has bucket, id, score."""

    def confirmed(pairs: DataFrame) -> DataFrame:
        return scratch.put(_links(scratch.put(pairs), texts))

    top = members.groupBy("bucket").agg(F.max(F.struct("score", "id")).alias("top"))
    centers = scratch.put(top.select("bucket", F.col("top.id").alias("center")))
    star = members.join(centers, "bucket").where("id <> center")
    links = confirmed(_likely_of(star.select(F.least("center", "id").alias("a"), F.greatest("center", "id").alias("b")), marks))
    labels = components(links, scratch)
    scratch.release()
    rest = unfinished(members, labels, scratch)
    sizes = scratch.put(rest.groupBy("bucket").agg(F.count("*").alias("size")))
    rest = rest.select("bucket", "id", "score", "label").join(sizes, "bucket")
    candidates = _across(rest.where(f"size <= {WHOLE}").join(marks, "id"))
    large = scratch.put(rest.where(f"size > {WHOLE}").drop("size"))
    if not large.isEmpty():
        met = confirmed(_likely_of(_with_largest(large), marks))
        links = links.unionAll(met)
        large = _united(large, met, scratch)
        behind = _behind_centers(large.join(marks, "id"), texts, scratch)
        candidates = candidates.unionAll(_likely_of(behind, marks))
    links = links.unionAll(confirmed(candidates.distinct()))
    scratch.release()
    return components(links, scratch)


def repeated_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``rid, doc_id, pos``: the lines to remove."""
    signed = scratch.put(_signed(docs))
    in_buckets = signed.select(F.explode_outer("bands").alias("bucket"), "id")
    ends = in_buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    crowded = scratch.put(ends.where("lo <> hi").select("bucket"))
    scratch.release()
    members = scratch.put(in_buckets.join(crowded, "bucket", "left_semi").distinct())
    scratch.release()
    counts = scratch.put(members.groupBy("id").agg(F.count("*").alias("score")))
    texts = scratch.put(_texts(docs, signed, counts))
    scratch.release()
    marks = scratch.put(_marked(texts))
    labels = _linked(scratch.put(members.join(counts, "id")), texts, marks, scratch)
    times = signed.groupBy("id").agg(F.count("*").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    unlike = F.col("lo") != F.col("hi")
    repeats = scratch.put(
        times.join(labels, "id", "left").where("n > 1 OR component IS NOT NULL").select("id", F.when(unlike, F.col("id")).otherwise(F.coalesce("component", "id")).alias("component"), unlike.alias("unlike"))
    )
    places = signed.select("rid", "doc_id", "pos", "id", "check").join(repeats, "id")
    places = scratch.put(places.select("rid", "doc_id", "pos", "component", F.when(F.col("unlike"), F.col("check")).otherwise(0).alias("of")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "pos")
    first = scratch.put(places.groupBy("component", "of").agg(F.min(place).alias("first")))
    scratch.release()
    return places.join(first, ["component", "of"]).where("rid <> first.rid OR pos <> first.pos").select("rid", "doc_id", "pos")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of ``text``.

    Keeps all columns and adds ``n_lines`` and ``n_removed``, which replace columns of these names. A line goes if an equal or similar line stands earlier in the text or in a
    document with a smaller doc_id. Null text stays null and has no lines; an empty text has one
    line; rows without a doc_id come last; rows that are equal in doc_id and text are one document;
    an empty table gives no rows. Texts and lines may be of any length. Lines are what newlines
    part; short lines and blank ones always stay.
    """
    rid, gone, of = "_row_of_lines", "_lines_to_remove", "_doc_of_lines"
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed", rid, gone, of)])
    scratch = Scratch(docs.sparkSession, "lines")
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    removed = scratch.put(repeated_lines(source, scratch).groupBy(F.col("rid").alias("_rid"), F.col("doc_id").alias(of)).agg(F.collect_set("pos").alias(gone)))
    scratch.release()
    rows = docs.withColumn("text", F.col("text").cast("string")).withColumn(rid, _row_id())
    kept = _let("split(text, '\n')", "parts", f"array_join(transform(array_except(sequence(0, size(parts) - 1), {gone}), i -> parts[i]), '\n')")
    return (
        rows.join(removed, (F.col(rid) == F.col("_rid")) & F.col("doc_id").cast("long").eqNullSafe(F.col(of)), "left")
        .withColumn("n_lines", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)))
        .withColumn("n_removed", F.coalesce(F.size(gone), F.lit(0)))
        .withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.expr(kept)))
        .drop(rid, gone, of, "_rid")
    )
