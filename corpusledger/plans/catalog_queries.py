"""Queries of the catalog operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogs, evidence, timeline
from .base import ENTITIES_SQL, OBSERVATIONS_SQL, SEQUENCES_SQL, chapters, entities, observations, query, sequences, table
from .text_queries import QUOTES_SQL, quote_places


@query(
    f"""WITH {SEQUENCES_SQL}, f AS (SELECT chapter_id, sequence AS event_index, source AS event, CASE WHEN sequence % 5 = 1 THEN NULL ELSE left(source, length(source) // 2) END AS a, CASE WHEN sequence % 5 = 1 THEN NULL WHEN sequence % 5 = 2 THEN 'x' ELSE substring(source, length(source) // 2 + 1) END AS b FROM seqs WHERE sequence % 7 <> 0)
 SELECT s.chapter_id, CAST(s.sequence AS INTEGER) AS event_index, CASE WHEN s.sequence % 7 = 0 THEN 'missing event' ELSE 'text differs' END AS rule FROM seqs s LEFT JOIN f ON f.chapter_id = s.chapter_id AND f.event_index = s.sequence
 WHERE s.sequence % 7 = 0 OR (f.a IS NOT NULL AND regexp_replace(f.a || f.b, '\\s+', '', 'g') <> regexp_replace(s.source, '\\s+', '', 'g'))"""
)
def fragment_cover(spark, sf_dir):
    """Each line is an event, given whole or in two halves; every seventh is left out, some halves are wrong."""
    events = sequences(spark, sf_dir).select("chapter_id", F.col("sequence").alias("event_index"), F.col("source").alias("event"))
    half = F.floor(F.length("event") / 2).cast("int")
    i = F.col("event_index")
    two = F.array(F.left("event", half), F.when(i % 5 == 2, F.lit("x")).otherwise(F.substring(F.col("event"), half + 1, F.length("event"))))
    parts = events.filter("event_index % 7 <> 0").select("chapter_id", "event_index", F.posexplode(F.when(i % 5 == 1, F.array(F.lit(None).cast("string"))).otherwise(two)).alias("k", "text"))
    fragments = parts.select("chapter_id", "event_index", (i * 2 + F.col("k")).alias("ord"), "text")
    return catalogs.fragment_violations(fragments, events, ["chapter_id"])


@query(f"WITH {OBSERVATIONS_SQL}, m AS (SELECT DISTINCT chapter, entity FROM obs WHERE event_id % 2 = 0 UNION SELECT chapter, entity FROM obs WHERE presence = 'visible'), b AS (SELECT chapter, entity, count(DISTINCT attribute) AS n FROM obs WHERE scope = 'scene' GROUP BY ALL) SELECT m.chapter, m.entity, coalesce(n, 0) AS n_assets FROM m LEFT JOIN b USING (chapter, entity) WHERE m.entity IN (SELECT c_custkey FROM customer)")
def chapter_catalog(spark, sf_dir):
    o = observations(spark, sf_dir)
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    bound = o.filter("scope = 'scene'").select("chapter", "entity", F.col("attribute").alias("asset_id"))
    return catalogs.chapter_catalog(o.filter("event_id % 2 = 0"), o.filter("presence = 'visible'"), known, bound)


@query(f"WITH {ENTITIES_SQL}, {OBSERVATIONS_SQL} SELECT entity_id AS entity, CASE WHEN NOT EXISTS (SELECT 1 FROM obs WHERE entity = entity_id AND presence = 'visible') THEN 'never visible' ELSE 'not described' END AS reason FROM ents WHERE kind <> 'character' AND (NOT EXISTS (SELECT 1 FROM obs WHERE entity = entity_id AND presence = 'visible') OR (kind = 'object' AND NOT EXISTS (SELECT 1 FROM obs WHERE entity = entity_id AND description > 2)))")
def retained_entities(spark, sf_dir):
    o = observations(spark, sf_dir)
    e = entities(spark, sf_dir).withColumnRenamed("entity_id", "entity")
    return catalogs.retained(e, o, o.filter("description > 2"))[1]


@query("WITH s AS (SELECT DISTINCT l_orderkey AS scene, l_partkey AS subject FROM lineitem WHERE l_returnflag = 'A'), p AS (SELECT DISTINCT l_orderkey AS scene, l_partkey AS subject FROM lineitem WHERE l_linestatus = 'F'), k AS (SELECT s.* FROM s JOIN p USING (scene, subject)) SELECT scene, subject, CAST(row_number() OVER (PARTITION BY scene ORDER BY subject) AS INTEGER) AS slot FROM k QUALIFY row_number() OVER (PARTITION BY scene ORDER BY subject) <= 3")
def audio_bindings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_partkey").alias("subject"), "l_returnflag", "l_linestatus")
    speaking = li.filter("l_returnflag = 'A'").select("scene", "subject", F.col("subject").alias("ord")).distinct()
    return catalogs.audio_bindings(speaking, li.filter("l_linestatus = 'F'"))


@query(f"WITH {OBSERVATIONS_SQL}, st AS (SELECT entity, chapter, sequence, arg_min(presence, CASE presence WHEN 'visible' THEN 1 WHEN 'offscreen' THEN 2 ELSE 3 END) AS presence, bool_or(event_id % 6 = 0) AS d FROM obs GROUP BY ALL) SELECT entity, chapter, sequence, CASE WHEN d THEN 'offscreen' ELSE presence END AS presence FROM st")
def presence_override(spark, sf_dir):
    o = observations(spark, sf_dir)
    decided = o.filter("event_id % 6 = 0").select("entity", "chapter", "sequence", F.lit("offscreen").alias("presence")).distinct()
    return catalogs.override_presence(timeline.scene_presence(o), decided)


@query(
    """WITH s AS (SELECT DISTINCT l_partkey AS location, l_orderkey AS scene FROM lineitem), p AS (SELECT DISTINCT l_partkey AS location, l_orderkey AS scene, 'v' || (l_orderkey % 2) AS view FROM lineitem WHERE NOT (l_partkey % 4 = 0 AND l_orderkey % 10 = 0) AND l_partkey % 5 <> 0),
 bad AS (SELECT DISTINCT s.location FROM s JOIN (SELECT DISTINCT location FROM p) q USING (location) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.location = s.location AND p.scene = s.scene))
 SELECT location, view, scene FROM p WHERE location NOT IN (SELECT location FROM bad)
 UNION ALL SELECT location, 'wide', scene FROM s WHERE location IN (SELECT location FROM bad) OR location NOT IN (SELECT location FROM p)"""
)
def location_views(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("location"), F.col("l_orderkey").alias("scene")).distinct()
    plan = li.filter("NOT (location % 4 = 0 AND scene % 10 = 0) AND location % 5 <> 0").withColumn("view", F.concat(F.lit("v"), (F.col("scene") % 2).cast("string")))
    return catalogs.location_views(plan, li)[0]


@query(
    QUOTES_SQL
    + """, w AS (SELECT chapter_id, greatest(0, start_char - 900) AS s, least(length(text), end_char + 900) AS e FROM spans),
 m AS (SELECT chapter_id, s, e, max(e) OVER (PARTITION BY chapter_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM w),
 g AS (SELECT chapter_id, s, e, sum(CASE WHEN r IS NULL OR r < s THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_id ORDER BY s, e) AS g FROM m)
 SELECT chapter_id, CAST(min(s) AS INTEGER) AS start_char, CAST(max(e) AS INTEGER) AS end_char FROM g GROUP BY chapter_id, g"""
)
def evidence_contexts(spark, sf_dir):
    return evidence.contexts(quote_places(spark, sf_dir), chapters(spark, sf_dir), ["chapter_id"], "text")


@query("WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN p_partkey - 1 END AS link, p_type AS trait, p_brand AS value FROM part) SELECT coalesce(link, id) AS principal, trait, array_to_string(list_sort(list(DISTINCT value)), ',') AS trait_values, count(DISTINCT value) > 1 AS conflict FROM p GROUP BY coalesce(link, id), trait")
def profile_links(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_partkey") - 1).alias("link"), F.col("p_type").alias("trait"), F.col("p_brand").alias("value"))
    return catalogs.project_links(p).select("principal", "trait", F.array_join("values", ",").alias("trait_values"), "conflict")


@query("SELECT p_brand AS chapter, count(*) AS n_entities, sum(p_partkey) AS id_sum FROM part GROUP BY p_brand")
def chapter_maps(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.col("p_brand").alias("chapter"), F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("local_id"), F.col("p_partkey").alias("entity"))
    ids = F.map_values("entities")
    return catalogs.chapter_map(m).select("chapter", F.size(ids).cast("long").alias("n_entities"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))
