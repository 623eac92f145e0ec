"""Queries of the text functions and span operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..operators import spans
from ..operators.lineage import numbered
from ..sources import chapters as sources
from .base import ENTITIES_SQL, NORMAL_SQL, TYPOGRAPHIC_SQL, chapters, entities, query, table, typographic


@query(f"SELECT doc_id AS chapter_id, sha256({NORMAL_SQL.format(TYPOGRAPHIC_SQL)}) AS text_sha256 FROM documents")
def normalize_docs(spark, sf_dir):
    return chapters(spark, sf_dir).select("chapter_id", F.sha2(T.normalize_text(typographic(F.col("text"))), 256).alias("text_sha256"))


@query(f"SELECT doc_id AS chapter_id, sha256(trim(regexp_replace({NORMAL_SQL.format(TYPOGRAPHIC_SQL)}, '\\s+', ' ', 'g'))) AS text_sha256 FROM documents")
def comparison_docs(spark, sf_dir):
    return chapters(spark, sf_dir).select("chapter_id", F.sha2(T.comparison_text(typographic(F.col("text"))), 256).alias("text_sha256"))


@query("SELECT doc_id AS chapter_id, CASE WHEN length(text) >= 100 THEN 'accepted' ELSE 'rejected' END AS status, length(text) AS n_chars FROM documents")
def short_doc_gate(spark, sf_dir):
    accepted, rejected = sources.length_gate(chapters(spark, sf_dir))
    rows = accepted.select("chapter_id", F.lit("accepted").alias("status"), F.length("text").cast("long").alias("n_chars"))
    return rows.unionByName(rejected.select("chapter_id", F.lit("rejected").alias("status"), F.col("n_chars").cast("long").alias("n_chars")))


@query("SELECT doc_id AS chapter_id, sha256(text) AS digest FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id % 3 <> 0 AND p.doc_id = d.doc_id AND sha256(p.text) = sha256(d.text))")
def changed_docs(spark, sf_dir):
    """Documents that are new against a previous digest table (here: ids not divisible by three were known)."""
    now = chapters(spark, sf_dir).select("chapter_id", F.sha2("text", 256).alias("digest"))
    return sources.changed(now, now.filter("chapter_id % 3 <> 0"), "chapter_id", "digest")


@query(
    """WITH s AS (SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(p_name, '[^\\pL\\pN_.-]+', '_', 'g'), '._'), 64), ''), 'chapter') AS slug FROM part),
    n AS (SELECT *, count(*) OVER (PARTITION BY slug) AS c, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s)
    SELECT p_partkey AS entity_id, CASE WHEN c = 1 THEN slug ELSE slug || '_' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') END AS chapter_id FROM n"""
)
def unique_slugs(spark, sf_dir):
    e = entities(spark, sf_dir).select("entity_id", T.slug(F.col("canonical_name")).alias("slug"))
    return sources.unique_ids(e, "entity_id", "slug").select("entity_id", F.col("unique_id").alias("chapter_id"))


QUOTES_SQL = """WITH d AS (SELECT doc_id, text, translate(text, chr(10) || chr(9), '  ') AS t FROM documents),
 b AS (SELECT item_id, trim(translate(text, chr(10) || chr(9), '  ')) AS q FROM benchmark),
 p AS (SELECT d.doc_id AS chapter_id, b.item_id, b.q AS quote, d.text, d.t FROM d JOIN b ON contains(d.t, b.q)),
 s AS (SELECT chapter_id, item_id, quote, text, unnest(range(0, length(t) - length(quote) + 1)) AS i, t FROM p),
 spans AS (SELECT chapter_id, item_id, text, CAST(i AS INTEGER) AS start_char, CAST(i + length(quote) AS INTEGER) AS end_char FROM s WHERE substring(t, i + 1, length(quote)) = quote)
"""


def quote_places(spark, sf_dir):
    return quote_details(spark, sf_dir).select("chapter_id", "item_id", "start_char", "end_char")


def quote_details(spark, sf_dir):
    return spans.locate(chapters(spark, sf_dir), table(spark, sf_dir, "benchmark"), "chapter_id", "text", "item_id", "text")


@query(QUOTES_SQL + "SELECT chapter_id, item_id, start_char, end_char FROM spans")
def quote_spans(spark, sf_dir):
    return quote_places(spark, sf_dir)


@query(QUOTES_SQL + "SELECT chapter_id, item_id, min(start_char) AS start_char, min(end_char) AS end_char FROM spans GROUP BY ALL HAVING count(*) = 1")
def unique_quote(spark, sf_dir):
    return spans.unique(quote_places(spark, sf_dir), ["chapter_id", "item_id"])


@query("SELECT b.item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON length(b.text) > 0 AND contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) GROUP BY b.item_id")
def quote_contained(spark, sf_dir):
    places = quote_places(spark, sf_dir).select("chapter_id", "item_id").distinct()
    counts = places.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))


@query(QUOTES_SQL + "SELECT chapter_id, item_id, min(substring(text, start_char + 1, end_char - start_char)) AS wording FROM spans GROUP BY ALL HAVING count(DISTINCT substring(text, start_char + 1, end_char - start_char)) = 1")
def restore_quote(spark, sf_dir):
    return spans.restored(quote_details(spark, sf_dir), ["chapter_id", "item_id"])


LINES_SQL = "length(left(text, {0})) - length(replace(left(text, {0}), chr(10), '')) + 1"


@query(QUOTES_SQL + f"SELECT chapter_id, item_id, start_char, end_char, CAST({LINES_SQL.format('start_char')} AS INTEGER) AS start_line, CAST({LINES_SQL.format('end_char - 1')} AS INTEGER) AS end_line FROM spans")
def locate_quotes(spark, sf_dir):
    return spans.with_lines(quote_details(spark, sf_dir), ["chapter_id", "item_id"])


@query(f"SELECT doc_id AS chapter_id, CAST({LINES_SQL.format('length(text) // 2')} AS INTEGER) AS mid_line, CAST({LINES_SQL.format('length(text)')} AS INTEGER) AS last_line FROM documents")
def offset_lines(spark, sf_dir):
    n = F.length("text")
    return chapters(spark, sf_dir).select("chapter_id", T.line_of(F.col("text"), (n / 2).cast("int")).alias("mid_line"), T.line_of(F.col("text"), n).alias("last_line"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY CAST(regexp_extract(s_name, '(\\d+)$', 1) AS BIGINT) % 37, s_suppkey) AS place FROM supplier")
def natural_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Chapter"), (F.regexp_extract("s_name", r"(\d+)$", 1).cast("long") % 37).cast("string")).alias("name"))
    rows = s.select("s_suppkey", T.natural_key(F.col("name")).alias("key"))
    return numbered(rows, [], ["key", "s_suppkey"]).select("s_suppkey", F.col("number").alias("place"))


FOLD_SQL = "replace(lower({0}), 'ß', 'ss')"


@query(f"SELECT doc_id AS chapter_id, sha256(trim(regexp_replace({FOLD_SQL.format('text')}, '[^\\pL\\pN]+', ' ', 'g'))) AS key FROM documents")
def name_keys(spark, sf_dir):
    return chapters(spark, sf_dir).select("chapter_id", F.sha2(T.name_key(F.col("text")), 256).alias("key"))


@query(f"SELECT doc_id AS chapter_id, sha256(regexp_replace(replace(trim(regexp_replace({FOLD_SQL.format('text')}, '\\s+', ' ', 'g')), '’', ''''), '^((le|la|les|the) |l'')', '')) AS key FROM documents")
def entity_keys(spark, sf_dir):
    return chapters(spark, sf_dir).select("chapter_id", F.sha2(T.entity_key(F.col("text")), 256).alias("key"))


@query(
    """WITH n AS (SELECT p_brand, p_partkey, unnest([p_name, upper(p_name), p_type]) AS name, unnest([1, 2, 3]) AS k FROM part),
    f AS (SELECT p_brand, name, p_partkey, k, row_number() OVER (PARTITION BY p_brand, lower(name) ORDER BY p_partkey, k) AS r FROM n),
    o AS (SELECT p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, k) AS place FROM f WHERE r = 1)
    SELECT p_brand AS brand, string_agg(name, '|' ORDER BY place) AS names FROM o WHERE place <= 20 GROUP BY p_brand"""
)
def alias_dedupe(spark, sf_dir):
    """Per brand the first spelling of each name in order, at most 20; names are reduced before they are gathered."""
    e = entities(spark, sf_dir).select("brand", "entity_id", F.posexplode(F.array("canonical_name", F.upper("canonical_name"), "p_type")).alias("k", "name"))
    first = e.groupBy("brand", F.lower("name").alias("_f")).agg(F.min(F.struct("entity_id", "k", "name")).alias("_o"))
    names = F.transform(F.array_sort(F.collect_list("_o")), lambda o: o["name"])
    return first.groupBy("brand").agg(F.array_join(T.dedupe_folded(names, 20), "|").alias("names"))


@query("SELECT doc_id AS chapter_id, 'e_' || left(sha256('v' || CAST(doc_id AS VARCHAR) || chr(31) || coalesce('v' || source, 'n') || chr(31) || coalesce('v' || text, 'n')), 24) AS evidence_id FROM documents")
def row_digests(spark, sf_dir):
    return chapters(spark, sf_dir).select("chapter_id", T.digest_id("e_", 24, F.col("chapter_id"), F.col("source"), F.col("text")).alias("evidence_id"))


@query(f"WITH {ENTITIES_SQL} SELECT brand, arg_min(importance, CASE importance WHEN 'major' THEN 1 WHEN 'recurring' THEN 2 ELSE 3 END) AS importance, arg_min(priority, CASE priority WHEN 'required' THEN 1 WHEN 'recommended' THEN 2 ELSE 3 END) AS priority FROM ents GROUP BY brand")
def enum_max(spark, sf_dir):
    importance, priority = T.ranked_value(F.col("importance"), ["major", "recurring", "minor"]), T.ranked_value(F.col("priority"), ["required", "recommended", "optional"])
    return entities(spark, sf_dir).groupBy("brand").agg(F.min_by("importance", importance).alias("importance"), F.min_by("priority", priority).alias("priority"))


@query("SELECT doc_id AS chapter_id, CAST(len(regexp_extract_all(text, '[\\pL\\pN_](?:[\\pL\\pN_''-]*[\\pL\\pN_])?')) AS INTEGER) AS n_words FROM documents")
def word_counts(spark, sf_dir):
    return chapters(spark, sf_dir).select("chapter_id", T.word_count(F.col("text")).alias("n_words"))


@query("SELECT doc_id AS chapter_id, regexp_matches(CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || ' Source_Excerpt : x' ELSE text END, '(?mi)^\\s*source_excerpt\\s*:') AS leaks FROM documents")
def leak_lines(spark, sf_dir):
    text = F.when(F.col("chapter_id") % 5 == 0, F.concat("text", F.lit("\n Source_Excerpt : x"))).otherwise(F.col("text"))
    return chapters(spark, sf_dir).select("chapter_id", T.leaks_metadata(text).alias("leaks"))


@query("SELECT doc_id AS chapter_id, sha256(strip_accents(text)) AS plain_sha256 FROM documents")
def plain_text(spark, sf_dir):
    return chapters(spark, sf_dir).select("chapter_id", F.sha2(udfs.plain(F.col("text")), 256).alias("plain_sha256"))


@query()
def name_ratio(spark, sf_dir):
    """Ratio and longest match of entity names against the name of the entity before them in their brand."""
    e = entities(spark, sf_dir).select("brand", "entity_id", F.lower("canonical_name").alias("name"))
    pairs = e.withColumn("other", F.lag("name").over(Window.partitionBy("brand").orderBy("entity_id"))).filter("other IS NOT NULL")
    return pairs.select("entity_id", udfs.seq_ratio("name", "other").alias("ratio"), udfs.longest_match("name", "other").alias("m")).select("entity_id", "ratio", "m.*")


@query(
    QUOTES_SQL
    + """SELECT chapter_id, item_id, sha256(coalesce(max(CASE WHEN w = q THEN q END), CASE WHEN min(w) = max(w) THEN min(w) END)) AS quote_sha256
 FROM (SELECT chapter_id, item_id, substring(s.text, start_char + 1, end_char - start_char) AS w, b.text AS q FROM spans s JOIN benchmark b USING (item_id)) GROUP BY ALL
 HAVING bool_or(w = q) OR min(w) = max(w)"""
)
def anchored_quotes(spark, sf_dir):
    """The wording that each document has for a passage: the passage itself, or the only one that stands for it."""
    out = spans.anchored(quote_details(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["chapter_id", "item_id"], "item_id", "text")
    return out.select("chapter_id", "item_id", F.sha2("quote", 256).alias("quote_sha256"))


@query(QUOTES_SQL + "SELECT chapter_id, item_id, 0 AS start_char, min(end_char) AS end_char FROM spans GROUP BY chapter_id, item_id, text HAVING trim(left(text, min(start_char)), ' ' || chr(9) || chr(10) || chr(13)) = ''")
def leading_quotes(spark, sf_dir):
    return spans.prefix_span(quote_details(spark, sf_dir), ["chapter_id", "item_id"])
