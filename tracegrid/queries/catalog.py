"""Catalog, search and join queries."""

from pyspark.sql import functions as F

from ..functions.paths import extension, name_candidates, natural_key, normalize_path, path_candidates, suffix_key
from ..functions.text import grams, has_phrase
from ..operators import catalog as cat, correlation as cor, joins, search as se
from ..sources.adapters import files, timeline_events
from ..sources.sinks import csv_lines, html_rows, json_lines
from .registry import query

_RANK = "(CASE WHEN entry_type = 'Directory' THEN 0 ELSE 1 END), (CASE WHEN hidden OR system THEN 1 ELSE 0 END) + (CASE WHEN deleted THEN 2 ELSE 0 END)"
_PLAIN = f"ORDER BY {_RANK}, {{}}, lower(name), name, id LIMIT 100"


def _content(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return files(spark, d).join(docs, "id")


@query("SELECT id, path FROM f WHERE NOT hidden AND NOT system")
def catalog_visible_rows(spark, d):
    return cat.visible_rows(files(spark, d)).select("id", "path")


@query("SELECT id, path FROM f WHERE NOT hidden")
def catalog_visible_tree(spark, d):
    return cat.visible_tree(files(spark, d)).select("id", "path")


@query("SELECT count(*) AS n FROM f WHERE NOT hidden AND NOT system AND NOT deleted")
def catalog_visible_count(spark, d):
    return cat.visible_repository(files(spark, d)).agg(F.count("*").alias("n"))


@query("SELECT id, name, entry_type FROM f " + _PLAIN.format("lower(name)"))
def catalog_by_name(spark, d):
    return cat.listing(files(spark, d), "name", natural=False).select("id", "name", "entry_type")


@query("SELECT id, name, size FROM f " + _PLAIN.format("coalesce(size, 0) DESC"))
def catalog_by_size(spark, d):
    return cat.listing(files(spark, d), "size", descending=True, natural=False).select("id", "name", "size")


@query("SELECT id, name, modified_at FROM f " + _PLAIN.format("modified_at ASC NULLS FIRST"))
def catalog_by_modified(spark, d):
    return cat.listing(files(spark, d), "modified", natural=False).select("id", "name", "modified_at")


@query("SELECT id, name, ext FROM f " + _PLAIN.format("lower(coalesce(ext, '')) DESC"))
def catalog_by_extension(spark, d):
    return cat.listing(files(spark, d), "ext", descending=True, natural=False).select("id", "name", "ext")


@query(f"SELECT id, name FROM f ORDER BY {_RANK}, CAST(regexp_extract(name, '[0-9]+') AS BIGINT), lower(name), id LIMIT 100")
def catalog_natural_names(spark, d):
    return cat.listing(files(spark, d), "name").select("id", "name")


@query("SELECT parent_id, count(*) AS children, count(*) FILTER (entry_type = 'Directory') AS directories FROM f GROUP BY parent_id")
def catalog_child_counts(spark, d):
    return cat.child_counts(files(spark, d))


@query("SELECT id, path FROM f WHERE starts_with(path, 'C:/src1/') ORDER BY path")
def catalog_path_prefix(spark, d):
    return cat.under_prefix(files(spark, d), "C:/src1/").select("id", "path")


@query("SELECT id, path FROM f WHERE NOT deleted AND contains(path, 'src1') AND contains(path, '/en/')")
def catalog_path_fragments(spark, d):
    return cat.with_fragments(files(spark, d), ["src1", "/en/"]).select("id", "path")


@query(
    """SELECT count(*) FILTER (encrypted) AS encrypted, count(*) FILTER (NOT encrypted) AS clear, count(*) FILTER (encrypted IS NULL) AS unknown
    FROM f WHERE entry_type = 'File'"""
)
def catalog_encryption(spark, d):
    return cat.encryption_counts(files(spark, d))


_KINDS = """, k AS (SELECT *, CASE ext WHEN 'exe' THEN 'PE' WHEN 'PDF' THEN 'PDF' WHEN 'jpg' THEN 'JPEG' ELSE '' END AS file_type,
  CASE ext WHEN 'exe' THEN 'executables' WHEN 'PDF' THEN 'documents' WHEN 'jpg' THEN 'images' WHEN 'log' THEN 'documents' ELSE 'other' END AS family
  FROM f WHERE entry_type = 'File')"""


@query(_KINDS + " SELECT family, file_type, count(*) AS files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM k GROUP BY 1, 2")
def catalog_classification(spark, d):
    return cat.classification_board(files(spark, d))


@query(
    _KINDS
    + """ SELECT family, id, path, coalesce(size, 0) AS size, CAST(r AS INTEGER) AS r FROM
    (SELECT *, row_number() OVER (PARTITION BY family ORDER BY coalesce(size, 0) DESC, path, id) AS r FROM k) WHERE r <= 30"""
)
def catalog_board_samples(spark, d):
    return cat.board_samples(files(spark, d))


@query(
    """SELECT id, parent_id, CAST(position AS INTEGER) AS position, position // 10 * 10 AS page_offset FROM (SELECT id, parent_id, row_number() OVER
      (PARTITION BY parent_id ORDER BY """
    + _RANK
    + """, CAST(regexp_extract(name, '[0-9]+') AS BIGINT), lower(name), id) - 1 AS position FROM f
      WHERE parent_id = (SELECT parent_id FROM f WHERE id = 57)) WHERE id = 57"""
)
def catalog_jump_page(spark, d):
    return cat.jump_page(files(spark, d), 57, 10).select("id", "parent_id", "position", F.col("page_offset").cast("long").alias("page_offset"))


@query(
    """, e AS (SELECT CAST(doc_id AS BIGINT) AS id, CASE WHEN doc_id > 0 THEN doc_id // 2 END AS parent_id FROM documents),
    c AS (SELECT id AS start_id, 0 AS depth, id FROM e
      UNION ALL SELECT c.start_id, c.depth + 1, e.parent_id FROM c JOIN e ON e.id = c.id WHERE e.parent_id IS NOT NULL)
    SELECT * FROM c"""
)
def catalog_ancestors(spark, d):
    entries = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id AS id", "CASE WHEN doc_id > 0 THEN doc_id div 2 END AS parent_id")
    return cat.ancestors(entries, entries)


@query(
    """SELECT id, lower(path) AS path, regexp_replace(lower(path), '^([a-z]:/|/+)', '') AS suffix, name,
    CASE WHEN regexp_extract(name, '^.+\\.([^.]+)$', 1) <> '' THEN regexp_extract(name, '^.+\\.([^.]+)$', 1) END AS ext FROM f"""
)
def function_paths(spark, d):
    norm = normalize_path(F.concat(F.lit(' "'), F.translate("path", "/", "\\"), F.lit('\\" ')))
    return files(spark, d).select("id", norm.alias("path"), suffix_key(norm).alias("suffix"), "name", extension(F.col("name")).alias("ext"))


@query(
    """SELECT id, concat_ws(',', concat(p, chr(92), 'My'), concat(p, chr(92), 'My ', name), concat('opened "', p, chr(92), 'My ', name, '" twice, then ', name)) AS paths,
    CASE WHEN ext IS NOT NULL THEN concat(name, ',saw (', name, ');') ELSE '' END AS names
    FROM (SELECT id, name, ext, replace(regexp_replace(path, '/[^/]*$', ''), '/', chr(92)) AS p FROM f)"""
)
def function_path_candidates(spark, d):
    folder = F.translate(F.regexp_replace("path", "/[^/]*$", ""), "/", "\\")
    text = F.concat(F.lit('opened "'), folder, F.lit("\\My "), F.col("name"), F.lit('" twice, then '), F.col("name"))
    return files(spark, d).select("id", F.array_join(path_candidates(text), ",").alias("paths"), F.array_join(name_candidates(F.concat(F.lit("saw ("), "name", F.lit(");"))), ",").alias("names"))


@query(
    """SELECT id, concat('doc0', lpad(CAST(len(n) AS VARCHAR), 5, '0'), n, lower(name[len(n) + 4:]), '|', lpad(CAST(len(n) AS VARCHAR), 5, '0'), '|', name) AS natural
    FROM (SELECT id, name, regexp_extract(name, '[0-9]+') AS n FROM f)"""
)
def function_natural_key(spark, d):
    return files(spark, d).select("id", F.translate(natural_key(F.col("name")), "\0", "|").alias("natural"))


@query("SELECT id, name FROM f WHERE contains(lower(name), 'doc1') AND contains(lower(name), '.pdf') ORDER BY lower(name), id LIMIT 100")
def search_names(spark, d):
    return se.search(files(spark, d), se.SearchRequest("Doc1 .pdf", fields=("name",))).select("id", "name")


@query("SELECT id, name FROM f WHERE regexp_matches(lower(name), '^doc.5\\..*$') ORDER BY lower(name), id LIMIT 100")
def search_glob(spark, d):
    return se.search(files(spark, d), se.SearchRequest("doc?5.*", fields=("name",))).select("id", "name")


@query("SELECT id, path FROM f WHERE contains(lower(path), 'src1') AND entry_type = 'File' AND lower(ext) IN ('exe', 'log') ORDER BY lower(path), id LIMIT 100")
def search_paths_by_type(spark, d):
    request = se.SearchRequest("SRC1", ("EXE", "log"), "File", ("path",))
    return se.search(files(spark, d), request, "path").select("id", "path")


_WORDS = "concat(' ', array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND strlen(x) <= 40), ' '), ' ')"


@query(f"SELECT doc_id AS id FROM documents WHERE contains({_WORDS}, ' of the ')")
def search_phrase(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where(has_phrase(F.col("text"), "Of the")).select(F.col("doc_id").alias("id"))


@query(f"SELECT id, lower(name) AS sort_key FROM f WHERE contains(lower(name), 'doc') AND (lower(name), id) > ('doc500', 500) ORDER BY 2, 1 LIMIT 50")
def search_after(spark, d):
    return se.search(files(spark, d), se.SearchRequest("doc", fields=("name",)), limit=50, after=("doc500", 500)).select("id", "sort_key")


@query(
    f"""SELECT doc_id AS id, concat_ws(',', CASE WHEN contains(lower(f.name), 'exe') THEN 'name' END, CASE WHEN contains(lower(f.path), 'exe') THEN 'path' END,
    CASE WHEN contains({_WORDS}, ' exe ') THEN 'content' END) AS sources FROM documents JOIN f ON f.id = doc_id"""
)
def search_match_sources(spark, d):
    return _content(spark, d).select("id", se.match_sources(se.SearchRequest("exe")).alias("sources"))


@query(
    f""", w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND strlen(x) <= 40) AS w FROM documents),
    c AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = 'license')) AS tf FROM w),
    g AS (SELECT count(*) AS docs, avg(dl) AS avg_dl, count(*) FILTER (tf > 0) AS n FROM c)
    SELECT id, round(ln(1 + (docs - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)), 6) AS score FROM c, g WHERE tf > 0"""
)
def search_ranked(spark, d):
    return se.ranked_search(_content(spark, d), "license").select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS id, len(text) AS n, len(text) - 2 AS grams FROM documents WHERE len(text) >= 3")
def search_grams(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("length(text) >= 3")
    n = F.length("text").cast("long")
    return docs.select(F.col("doc_id").alias("id"), n.alias("n"), F.size(grams(F.col("text"), 3)).cast("long").alias("grams"))


@query(
    """SELECT t.id, f.path AS object_path, CASE WHEN f.path IS NULL THEN 'source object not in catalog' END AS caveat
    FROM t LEFT JOIN f ON f.id = t.source_object_id * 40"""
)
def correlation_with_object(spark, d):
    events = timeline_events(spark, d).withColumn("source_object_id", F.col("source_object_id") * 40)
    return joins.with_object(events, files(spark, d)).select("id", "object_path", "caveat")


_CANDIDATES = """, c AS (SELECT id AS candidate_id, lower(path) AS norm, regexp_replace(lower(path), '^[a-z]:/', '') AS k FROM f WHERE id % 3 = 0
  UNION ALL SELECT id + 1000000, concat('/mnt/x/', regexp_replace(lower(path), '^[a-z]:/', '')), concat('mnt/x/', regexp_replace(lower(path), '^[a-z]:/', '')) FROM f WHERE id % 3 = 1
  UNION ALL SELECT id + 2000000, concat('/', lower(lang_name)), lower(lang_name) FROM (SELECT id, regexp_replace(path, '^[A-Z]:/[^/]*/', '') AS lang_name FROM f WHERE id % 3 = 2)
  UNION ALL SELECT id + 3000000, lower(substr(name, 3)), lower(substr(name, 3)) FROM f),
 g AS (SELECT id AS file_id, lower(path) AS file_path, regexp_replace(lower(path), '^[a-z]:/', '') AS file_key, deleted FROM f),
 m AS (SELECT candidate_id, file_id, file_path, CASE WHEN norm = file_path THEN 'exact' ELSE 'suffix' END AS how, deleted FROM c JOIN g ON norm = file_path OR suffix(file_key, k))
 SELECT candidate_id, file_id, file_path, how FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY how, deleted, length(file_path), file_id) AS r FROM m) WHERE r = 1"""


@query(_CANDIDATES)
def correlation_best_path(spark, d):
    f = files(spark, d)
    made = [
        f.where("id % 3 = 0").selectExpr("id AS candidate_id", "translate(path, '/', '\\\\') AS candidate"),
        f.where("id % 3 = 1").selectExpr("id + 1000000", "concat('/mnt/x/', regexp_replace(path, '^[A-Z]:/', ''))"),
        f.where("id % 3 = 2").selectExpr("id + 2000000", "concat('/', regexp_replace(path, '^[A-Z]:/[^/]*/', ''))"),
        f.selectExpr("id + 3000000", "substr(name, 3)"),
    ]
    rows = made[0]
    for m in made[1:]:
        rows = rows.unionAll(m)
    return joins.best_path_match(rows.withColumn("wants_deleted", F.lit(False)), f)


@query(
    """SELECT candidate_id, file_id, file_path FROM (SELECT c.id AS candidate_id, g.id AS file_id, lower(g.path) AS file_path,
      row_number() OVER (PARTITION BY c.id ORDER BY g.deleted, length(g.path), g.id) AS r FROM f c JOIN f g ON lower(c.name) = lower(g.name)) WHERE r = 1"""
)
def correlation_best_name(spark, d):
    f = files(spark, d)
    wanted = f.selectExpr("id AS candidate_id", "concat('/other/', name) AS candidate", "false AS wants_deleted")
    rows = joins.best_name_match(wanted, f.withColumn("path", normalize_path(F.col("path"))))
    return rows


@query("SELECT CAST(id AS VARCHAR) AS artifact_id, id AS file_id, 'exact' AS how, 'strong' AS confidence FROM f")
def correlation_path_leads(spark, d):
    f = files(spark, d)
    art = f.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("saw "), F.translate("path", "/", "\\")).alias("text"))
    return cor.path_leads(art, f, "text")


@query(
    """, l AS (SELECT concat('family', id % 5) AS family, CASE WHEN id % 2 = 0 THEN 'strong' ELSE 'weak' END AS confidence, id % 9 = 0 AS caveat FROM f),
    g AS (SELECT family, count(*) AS leads, count(*) FILTER (confidence = 'strong') AS high, count(*) FILTER (confidence <> 'strong' OR caveat) AS review FROM l GROUP BY family)
    SELECT concat('family', i) AS family, coalesce(leads, 0) AS leads, coalesce(high, 0) AS high, coalesce(review, 0) AS review,
      CASE WHEN leads IS NULL THEN 'missing' WHEN review > 0 THEN 'review' ELSE 'covered' END AS status FROM range(7) r(i) LEFT JOIN g ON g.family = concat('family', i)"""
)
def correlation_family_coverage(spark, d):
    leads = files(spark, d).selectExpr(
        "concat('family', id % 5) AS family", "CASE WHEN id % 2 = 0 THEN 'strong' ELSE 'weak' END AS confidence", "id % 9 = 0 AS caveat"
    )
    return cor.family_coverage(leads, spark.range(7).selectExpr("concat('family', id) AS family"))


@query("SELECT id FROM f WHERE id % 4 <> 0")
def correlation_new_ids(spark, d):
    f = files(spark, d)
    return cor.new_ids(f, f.where("id % 4 = 0")).select("id")


@query(
    """SELECT concat('"', id, '","', replace(path, '"', '""'), '","', CASE WHEN id % 2 = 0 THEN chr(9) || '=1+' || id ELSE '-' END, '"') AS value FROM f WHERE id % 2 = 0
    UNION ALL SELECT concat('"', id, '","', replace(path, '"', '""'), '","', chr(9), '-"') FROM f WHERE id % 2 = 1"""
)
def sink_csv(spark, d):
    rows = files(spark, d).selectExpr("id", "path", "CASE WHEN id % 2 = 0 THEN concat('=1+', id) ELSE '-' END AS formula")
    return csv_lines(rows)


@query("""SELECT concat('{"id":', id, ',"name":"', name, '","size":', coalesce(CAST(size AS VARCHAR), 'null'), '}') AS value FROM f""")
def sink_json(spark, d):
    return json_lines(files(spark, d).select("id", "name", "size"))


@query("SELECT concat('<tr><td>', id, '</td><td>&lt;', name, '&gt; &amp; &quot;x&quot;</td></tr>') AS value FROM f")
def sink_html(spark, d):
    return html_rows(files(spark, d).selectExpr("id", "concat('<', name, '> & \"x\"') AS shown"))
