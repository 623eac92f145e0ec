"""Queries of the evidence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, evidence
from ..operators.lineage import numbered
from .base import chapters, query, table
from .text_queries import QUOTES_SQL, quote_places

STARTS_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in evidence.COMMON_STARTS)
FOLDED = "replace(lower({0}), 'ß', 'ss')"
WORDS_SQL = f"""WITH m AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '([^\\pL]*)(\\pL+(?:[-’'']\\pL+)*)', 1) AS seps, regexp_extract_all(text, '([^\\pL]*)(\\pL+(?:[-’'']\\pL+)*)', 2) AS words FROM documents),
 u AS (SELECT doc_id, unnest(seps) AS sep, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM m),
 p AS (SELECT doc_id, i, word, length(sep) AS gap, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev, sep,
   sum(length(sep) + length(word)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS end_char FROM u),
 b AS (SELECT *, end_char - length(word) AS start_char, regexp_replace(word, '^[ldLD][’'']', '') AS bare,
   right(rtrim(right(coalesce(prev, '') || sep, 64), ' ' || chr(9) || chr(10) || chr(13)), 1) AS before FROM p),
 j AS (SELECT doc_id, start_char, end_char, before, {FOLDED.format('bare')} AS name, regexp_matches(bare, '^\\p{{Lu}}') AS up, regexp_matches(bare, '^\\p{{Ll}}') AS low FROM b),
 f AS MATERIALIZED (SELECT *, up AND name NOT IN ({STARTS_SQL}) AS candidate, low AND before <> '' AND before NOT IN ('.', '!', '?') AS lowercase,
   up AND name NOT IN ({STARTS_SQL}) AND before <> '' AND before NOT IN ('.', '!', '?', chr(10), '"', '«', '—', '–', '-') AS interior FROM j),
 names AS (SELECT name FROM f GROUP BY name HAVING bool_or(candidate) AND (NOT bool_or(lowercase) OR bool_or(interior))),
 occ AS (SELECT doc_id AS chapter_id, name, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char FROM f JOIN names USING (name))
"""


def occurrences(spark, sf_dir):
    return evidence.index_names(chapters(spark, sf_dir), ["chapter_id"], "text")


@query(WORDS_SQL + "SELECT * FROM occ")
def name_index(spark, sf_dir):
    return occurrences(spark, sf_dir)


@query(
    WORDS_SQL
    + """, raw AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS l FROM documents)),
 cut AS (SELECT doc_id, i, CASE WHEN length(line) > 400 THEN regexp_split_to_array(regexp_replace(line, '([.!?]\\s+)', '\\1' || chr(1), 'g'), chr(1)) ELSE [line] END AS ps FROM raw),
 pcs AS (SELECT doc_id, i, unnest(range(1, len(ps) + 1)) AS k, unnest(ps) AS piece FROM cut),
 pl AS (SELECT doc_id, i, k, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i, k ROWS UNBOUNDED PRECEDING) AS e FROM pcs WHERE length(piece) > 0),
 pn AS (SELECT doc_id, i, k, e, e - length(piece) AS s FROM pl WHERE regexp_matches(piece, '\\S')),
 wide AS (SELECT doc_id, s, e, coalesce(lag(s) OVER w, s) AS f, coalesce(lead(e) OVER w, e) AS t, coalesce(lag(e) OVER w, 0) AS be FROM pn WINDOW w AS (PARTITION BY doc_id ORDER BY i, k)),
 win AS (SELECT o.chapter_id, greatest(f, start_char - 200) AS s, least(t, end_char + 200) AS e FROM occ o JOIN wide ON doc_id = chapter_id AND wide.e >= start_char + 1 AND be < start_char + 1),
 mm AS (SELECT chapter_id, s, e, max(e) OVER (PARTITION BY chapter_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM win WHERE s < e),
 gg AS (SELECT chapter_id, s, e, sum(CASE WHEN r IS NULL OR r < s THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_id ORDER BY s, e) AS g FROM mm)
 SELECT chapter_id, CAST(min(s) AS INTEGER) AS start_char, CAST(max(e) AS INTEGER) AS end_char FROM gg GROUP BY chapter_id, g"""
)
def name_windows(spark, sf_dir):
    out = chunking.name_windows(chapters(spark, sf_dir), occurrences(spark, sf_dir), ["chapter_id"], "text", 400)
    return out.select("chapter_id", F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"))


def raw_observations(spark, sf_dir):
    """Observations made from events, some of them malformed."""
    e = table(spark, sf_dir, "events")
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("observation_id"),
        F.when(F.col("event_id") % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("character"),
        F.col("event_type").alias("attribute"),
        F.when(F.col("value") < 5, F.lit("")).otherwise(F.floor("value").cast("string")).alias("value"),
        pick(4, ["explicit", "inferred", "contextual", "guess"]).alias("classification"),
        (F.col("value") / 300).alias("confidence"),
        pick(5, ["persistent", "temporary", "uncertain", "persistent", "always"]).alias("persistence"),
        F.when(F.col("event_id") % 13 == 0, F.lit("")).otherwise(F.col("props")).alias("quotation"),
    )


RAW_SQL = """raw AS (SELECT event_id AS observation_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'user ' || user_id END AS character, event_type AS attribute,
 CASE WHEN value < 5 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value, ['explicit', 'inferred', 'contextual', 'guess'][event_id % 4 + 1] AS classification,
 value / 300 AS confidence, ['persistent', 'temporary', 'uncertain', 'persistent', 'always'][event_id % 5 + 1] AS persistence,
 CASE WHEN event_id % 13 = 0 THEN '' ELSE props END AS quotation FROM events)"""
WARN_SQL = RAW_SQL + """, warned AS (SELECT *, concat_ws('|', CASE WHEN trim(character) = '' THEN 'missing character' END, CASE WHEN value = '' THEN 'missing value' END,
 CASE WHEN classification = 'guess' THEN 'unknown classification' END, CASE WHEN persistence = 'always' THEN 'unknown persistence' END,
 CASE WHEN confidence > 1 THEN 'confidence out of range' END, CASE WHEN quotation = '' THEN 'empty quotation' END) AS warnings FROM raw)"""


@query(f"WITH {WARN_SQL} SELECT observation_id, warnings FROM warned")
def obs_warnings(spark, sf_dir):
    return evidence.warnings(raw_observations(spark, sf_dir)).select("observation_id", F.array_join("warnings", "|").alias("warnings"))


@query(f"WITH {WARN_SQL} SELECT w AS reason, count(*) AS n FROM (SELECT unnest(string_split(warnings, '|')) AS w FROM warned WHERE warnings <> '') GROUP BY w")
def warning_counts(spark, sf_dir):
    rows = evidence.warnings(raw_observations(spark, sf_dir)).select(F.explode("warnings").alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WARN_SQL} SELECT attribute, count(*) AS total, count(*) FILTER (warnings <> '') AS to_review, count(*) FILTER (classification = 'explicit' AND warnings = '') AS corrected FROM warned GROUP BY attribute")
def review_counts(spark, sf_dir):
    rows = evidence.warnings(raw_observations(spark, sf_dir))
    return evidence.review_report(rows, ["attribute"], F.col("classification") == "explicit")


@query(f"WITH {RAW_SQL}, b AS (SELECT character, CASE WHEN classification = 'inferred' THEN 'inferred' WHEN persistence = 'temporary' THEN 'temporary' WHEN persistence = 'persistent' THEN 'stable' ELSE 'other' END AS bucket FROM raw) SELECT character, bucket, count(*) AS n FROM b GROUP BY ALL")
def attr_buckets(spark, sf_dir):
    rows = raw_observations(spark, sf_dir).withColumn("bucket", evidence.buckets(F.col("classification"), F.col("persistence")))
    return rows.groupBy("character", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH v AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'valid' ELSE 'invalid' END AS verdict, CASE WHEN toxic = 1 THEN 'tone' ELSE 'none' END AS issue FROM labels)
 SELECT d.doc_id AS chapter_id, CASE WHEN (v.verdict = 'valid') = (v.issue = 'none') THEN v.verdict ELSE 'uncertain' END AS verdict,
 CASE WHEN (v.verdict = 'valid') = (v.issue = 'none') THEN v.issue ELSE 'unavailable' END AS issue FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id"""
)
def apply_verdicts(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chapter_id"), F.when(F.col("quality") == 1, "valid").otherwise("invalid").alias("verdict"), F.when(F.col("toxic") == 1, "tone").otherwise("none").alias("issue"))
    return evidence.apply_verdicts(chapters(spark, sf_dir).select("chapter_id"), verdicts, "chapter_id")


@query(
    QUOTES_SQL
    + """SELECT s.chapter_id, s.item_id, s.start_char, CASE WHEN s.chapter_id % 10 = 0 THEN 'low' WHEN substring(s.text, start_char + 1, end_char - start_char) = b.text THEN 'high' ELSE 'medium' END AS confidence
 FROM spans s JOIN benchmark b USING (item_id)"""
)
def evidence_confidence(spark, sf_dir):
    """Each located passage's confidence; documents whose id ends in 0 stand for those with a warning."""
    rows = quote_places(spark, sf_dir).join(chapters(spark, sf_dir).select("chapter_id", F.col("text").alias("source_text")), "chapter_id").join(table(spark, sf_dir, "benchmark"), "item_id")
    cut = F.substring(F.col("source_text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    level = evidence.confidence(cut == F.col("text"), F.lit(True), F.col("chapter_id") % 10 == 0)
    return rows.select("chapter_id", "item_id", "start_char", level.alias("confidence"))


@query("SELECT p_type AS entity, k AS number, p_name AS trait FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part) WHERE k % 3 <> 0")
def drop_targets(spark, sf_dir):
    """Every third of all traits of a type is a review's target; a row for each trait that stays."""
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("entity"), "p_partkey", "p_name")
    traits = numbered(parts, ["entity"], ["p_partkey"])
    targets = traits.filter("number % 3 = 0").select("entity", "number")
    return evidence.drop_target_rows(traits, targets, ["entity"]).select("entity", "number", F.col("p_name").alias("trait"))
