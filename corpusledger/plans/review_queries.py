"""Queries of the review rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews
from .base import ENTITIES_SQL, SEQUENCES_SQL, entities, query, sequences, table


@query(
    f"""WITH RECURSIVE {SEQUENCES_SQL}, j AS (SELECT chapter_id, sequence, length(source) AS c, sequence % 7 AS k FROM seqs),
 f AS (SELECT chapter_id, sequence, c, k, 0 AS window_no, c AS chars, k AS cands, 1 AS n, CAST(NULL AS BIGINT) AS context FROM j WHERE sequence = 1
  UNION ALL SELECT j.chapter_id, j.sequence, j.c, j.k, CASE WHEN s THEN f.window_no + 1 ELSE f.window_no END, CASE WHEN s THEN j.c ELSE f.chars + j.c END, CASE WHEN s THEN j.k ELSE f.cands + j.k END, CASE WHEN s THEN 1 ELSE f.n + 1 END, CASE WHEN s THEN f.sequence ELSE f.context END
  FROM f JOIN j ON j.chapter_id = f.chapter_id AND j.sequence = f.sequence + 1, LATERAL (SELECT f.n >= 8 OR f.chars + j.c > 12000 OR f.cands + j.k > 32 AS s))
 SELECT chapter_id, CAST(sequence AS INTEGER) AS sequence, CAST(window_no AS INTEGER) AS window_no, context FROM f"""
)
def identity_windows(spark, sf_dir):
    jobs = sequences(spark, sf_dir).select("chapter_id", F.col("sequence").alias("ord"), F.length("source").alias("n_chars"), (F.col("sequence") % 7).alias("n_candidates"))
    return reviews.identity_windows(jobs, ["chapter_id"]).select("chapter_id", F.col("ord").alias("sequence"), "window_no", "context")


@query(
    f"""WITH {ENTITIES_SQL}, r AS (SELECT kind, canonical_name, count(*) AS n, min(entity_id) AS entity FROM ents GROUP BY ALL), d AS (SELECT entity_id AS design_id, kind, upper(canonical_name) AS canonical_name, count(*) OVER (PARTITION BY kind, upper(canonical_name)) AS k FROM ents)
 SELECT design_id, CASE WHEN n = 1 AND k = 1 THEN entity END AS entity, CASE WHEN n > 1 OR k > 1 THEN 'ambiguous' END AS reason FROM d JOIN r ON r.kind = d.kind AND r.canonical_name = lower(d.canonical_name)"""
)
def import_designs(spark, sf_dir):
    """A design of every entity against the whole registry; a rejected one has its reason."""
    e = entities(spark, sf_dir)
    designs = e.select(F.col("entity_id").alias("design_id"), F.upper("canonical_name").alias("canonical_name"), "kind")
    matched, rejects = reviews.import_designs(designs, e.select(F.col("entity_id").alias("entity"), "canonical_name", "kind"))
    return matched.select("design_id", "entity").unionByName(rejects.select("design_id", "reason"), allowMissingColumns=True)


@query(
    """WITH r AS (SELECT l_orderkey AS scene, l_partkey AS subject, 'v' || l_linenumber AS view FROM lineitem)
 SELECT 'not_approved' AS rule, scene || '/' || subject AS key, '' AS detail FROM r WHERE subject % 3 = 0
 UNION ALL SELECT 'repeated_request', scene || '/' || subject, CAST(count(*) AS VARCHAR) FROM r GROUP BY scene, subject HAVING count(*) > 1
 UNION ALL SELECT 'view_not_available', scene || '/' || subject, view FROM r WHERE view IN ('v6', 'v7')
 UNION ALL SELECT 'speaker_without_dialogue', scene || '/' || subject, '' FROM r WHERE scene % 20 <> 0"""
)
def metadata_rules(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_partkey").alias("subject"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("view"))
    approved = r.filter("subject % 3 <> 0").select("scene", "subject").distinct()
    views = r.filter("view NOT IN ('v6', 'v7')").select("subject", "view").distinct()
    return reviews.metadata_violations(r, approved, views, r.select("scene", "subject"), r.filter("scene % 20 = 0"))

