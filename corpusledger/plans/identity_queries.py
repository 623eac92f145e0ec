"""Queries of the identity and asset operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assets, identity
from .base import ENTITIES_SQL, entities, query, spread, table

TOKENS = "list_filter(string_split({0}, ' '), lambda x: x <> '')"


def jac(a, b):
    x, y = TOKENS.format(a), TOKENS.format(b)
    return f"len(list_intersect({x}, {y})) * 1.0 / greatest(1, len(list_distinct(list_concat({x}, {y}))))"


NAMES_SQL = f"WITH {ENTITIES_SQL}, nm AS (SELECT DISTINCT brand, canonical_name AS name FROM ents)"
PAIRS_SQL = NAMES_SQL + f", pr AS (SELECT a.brand, a.name AS x, b.name AS y, {jac('a.name', 'b.name')} AS score FROM nm a JOIN nm b ON a.brand = b.brand AND a.name < b.name)"


@query(PAIRS_SQL + " SELECT brand, x, y, score FROM pr WHERE score >= 0.3")
def name_jaccard(spark, sf_dir):
    return identity.similar_pairs(entities(spark, sf_dir), "entity_id", "brand", "canonical_name", 0.3, ratio=False).withColumnRenamed("_type", "brand")


@query()
def fuzzy_pairs(spark, sf_dir):
    return identity.similar_pairs(entities(spark, sf_dir), "entity_id", "brand", "canonical_name").withColumnRenamed("_type", "brand")


EDGES_SQL = f"WITH RECURSIVE {ENTITIES_SQL}, e AS (SELECT a.entity_id AS a, b.entity_id AS b FROM ents a JOIN ents b ON a.brand = b.brand AND a.p_type = b.p_type AND a.canonical_name = b.canonical_name AND a.entity_id <> b.entity_id), r AS (SELECT entity_id AS id, entity_id AS root FROM ents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)"


def merge_edges(spark, sf_dir):
    e = entities(spark, sf_dir).withColumn("kind2", F.concat_ws("|", "brand", "p_type"))
    return identity.name_links(e, "entity_id", "kind2", "canonical_name", threshold=1.01, ratio=False)


@query(EDGES_SQL + " SELECT id, min(root) AS component FROM r GROUP BY id")
def components(spark, sf_dir):
    nodes = entities(spark, sf_dir).select(F.col("entity_id").alias("id"))
    return identity.components(merge_edges(spark, sf_dir), nodes)


@query("WITH RECURSIVE " + EDGES_SQL.removeprefix("WITH RECURSIVE ") + ", c AS (SELECT id, min(root) AS component FROM r GROUP BY id), s AS (SELECT component, id, CAST((row_number() OVER (PARTITION BY component ORDER BY id) - 1) // 3 AS INTEGER) AS slice FROM c) SELECT component, slice, id FROM s QUALIFY count(*) OVER (PARTITION BY component, slice) > 1")
def audit_clusters(spark, sf_dir):
    return identity.clusters(identity.components(merge_edges(spark, sf_dir)), most=3)


def similar_edges(spark, sf_dir):
    return identity.name_links(entities(spark, sf_dir), "entity_id", "brand", "canonical_name")


@query()
def components_all(spark, sf_dir):
    """Components by similar names of a type (brand), where the SQL of ``components`` can state equal ones only."""
    nodes = entities(spark, sf_dir).select(F.col("entity_id").alias("id"))
    return identity.components(similar_edges(spark, sf_dir), nodes)


@query()
def audit_clusters_all(spark, sf_dir):
    """Slices of those components, of the default size."""
    return identity.clusters(identity.components(similar_edges(spark, sf_dir)))


@query(
    f"""WITH {ENTITIES_SQL}, i AS (SELECT entity_id AS in_id, p_type, canonical_name AS n FROM ents WHERE entity_id % 20 = 0), p AS (SELECT entity_id AS pool_id, p_type, canonical_name AS m, count(*) OVER (PARTITION BY p_type) AS pool FROM ents),
 s AS (SELECT in_id, pool_id, pool, CASE WHEN n = m THEN 1.0 ELSE {jac('n', 'm')} END AS score FROM i JOIN p USING (p_type)),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY in_id ORDER BY score DESC, pool_id) AS INTEGER) AS place, count(*) FILTER (score >= 0.15) OVER (PARTITION BY in_id) AS o FROM s)
 SELECT in_id, pool_id, score, place FROM k WHERE pool <= 35 OR (place <= 12 AND score >= 0.15) OR (o = 0 AND place <= 3)"""
)
def topk_candidates(spark, sf_dir):
    """Entities whose id divides by 20 are searched among all."""
    e = entities(spark, sf_dir)
    incoming = e.filter("entity_id % 20 = 0").select(F.col("entity_id").alias("in_id"), "p_type", F.col("canonical_name").alias("in_name"))
    pool = e.select(F.col("entity_id").alias("pool_id"), "p_type", F.col("canonical_name").alias("pool_name"))
    return identity.top_candidates(incoming, pool, "p_type")


@query()
def topk_candidates_all(spark, sf_dir):
    """Every entity is searched among all."""
    e = entities(spark, sf_dir)
    incoming = e.select(F.col("entity_id").alias("in_id"), "p_type", F.col("canonical_name").alias("in_name"))
    pool = e.select(F.col("entity_id").alias("pool_id"), "p_type", F.col("canonical_name").alias("pool_name"))
    return identity.top_candidates(incoming, pool, "p_type")


MERGES_SQL = f"WITH {ENTITIES_SQL}, g AS (SELECT l_orderkey AS group_no, l_partkey AS id FROM lineitem), k AS (SELECT DISTINCT group_no, id, kind FROM g JOIN ents ON entity_id = id), f AS (SELECT id, min(group_no) AS group_no FROM k GROUP BY id), m AS (SELECT k.* FROM k JOIN f USING (id, group_no)), s AS (SELECT group_no, count(DISTINCT kind) AS t, count(*) AS n, min(id) AS kept_id FROM m GROUP BY group_no)"


@query(MERGES_SQL + " SELECT id, kept_id FROM m JOIN s USING (group_no) WHERE t = 1 AND n > 1")
def apply_merges(spark, sf_dir):
    groups = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_no"), F.col("l_partkey").alias("id"))
    return identity.apply_merges(entities(spark, sf_dir).withColumnRenamed("entity_id", "id"), groups, "id", "kind")[0]


@query(f"WITH {ENTITIES_SQL} SELECT entity_id, upper(left(kind, 3)) || '_' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS global_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY entity_id) + CASE kind WHEN 'character' THEN 40 WHEN 'location' THEN 7 ELSE 0 END AS k FROM ents)")
def assign_ids(spark, sf_dir):
    """Numbers 1 to 40 of characters and 1 to 7 of locations are taken, as the region and nation keys have it."""
    taken = table(spark, sf_dir, "nation").agg(F.max("n_nationkey").alias("n")).select(F.explode(F.array(F.struct(F.lit("character").alias("kind"), (F.col("n") + 16).alias("number")), F.struct(F.lit("location").alias("kind"), (F.col("n") - 17).alias("number")))).alias("s")).select("s.*")
    out = identity.assign_ids(entities(spark, sf_dir), taken, "kind", ["entity_id"], F.upper(F.left("kind", F.lit(3))))
    return out.select("entity_id", "global_id")


@query(f"WITH {ENTITIES_SQL}, a AS (SELECT DISTINCT brand, entity_id % 10 AS id, canonical_name AS alias FROM ents) SELECT brand, id, alias FROM a QUALIFY count(*) OVER (PARTITION BY brand, lower(alias)) = 1")
def ambiguous_aliases(spark, sf_dir):
    a = entities(spark, sf_dir).select("brand", (F.col("entity_id") % 10).alias("id"), F.col("canonical_name").alias("alias")).distinct()
    return identity.unambiguous(a, "id", "alias", ["brand"])


VALUES_SQL = "WITH v AS (SELECT user_id, event_type AS trait, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS value, min(event_id) AS id FROM events GROUP BY ALL)"


@query(VALUES_SQL + " SELECT a.user_id, a.trait, a.value AS left_value, a.id AS left_id, b.value AS right_value, b.id AS right_id FROM v a JOIN v b ON a.user_id = b.user_id AND a.trait = b.trait AND a.value < b.value")
def value_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("trait"), F.floor(F.col("value") / 50).cast("string").alias("value"), "event_id")
    return identity.value_pairs(rows, ["user_id", "trait"], "event_id", "value")


def trait_rows(spark, sf_dir):
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("evidence_id"), "user_id", F.col("event_type").alias("trait"), F.floor(F.col("value") / 50).cast("string").alias("value"), pick(2, ["explicit", "inferred"]).alias("classification"), pick(3, ["persistent", "temporary", "uncertain"]).alias("persistence"))


@query("SELECT user_id, event_type AS trait, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS value, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'global' ELSE 'temporary' END AS scope, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_id % 7 <> 0 GROUP BY ALL")
def trait_rollup(spark, sf_dir):
    rows = trait_rows(spark, sf_dir)
    return identity.roll_up(rows, rows.filter("evidence_id % 7 = 0"), ["user_id"])


@query(
    """WITH v AS (SELECT *, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS v FROM events), p AS (SELECT *, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS pv, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS pe FROM v),
 i AS (SELECT *, sum(CASE WHEN pe IS NULL OR pv = v THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM p),
 c AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type, run) AS component, count(*) OVER (PARTITION BY user_id, event_type, run) AS size FROM i),
 g AS (SELECT component, v AS value, count(*) AS n, min(event_id) AS first_id FROM c WHERE size > 1 GROUP BY component, v)
 SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY first_id) AS INTEGER) AS choice_no, row_number() OVER (PARTITION BY component ORDER BY first_id) = 1 AS selected FROM g"""
)
def conflict_groups(spark, sf_dir):
    """Evidence conflicts with the next of its user and trait if their values differ."""
    rows = trait_rows(spark, sf_dir)
    turn = Window.partitionBy("user_id", "trait").orderBy("evidence_id")
    steps = rows.select(F.col("evidence_id").alias("a"), "value", F.lead("evidence_id").over(turn).alias("b"), F.lead("value").over(turn).alias("_next"))
    return identity.conflict_groups(rows.select("evidence_id", "value"), steps.filter("b IS NOT NULL AND value <> _next").select("a", "b"), "evidence_id", "value")


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem), ed AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT CAST(a AS BIGINT) AS id, 0 AS steps FROM ed WHERE a % 97 = 0 UNION SELECT ed.b, r.steps + 1 FROM r JOIN ed ON ed.a = r.id WHERE r.steps < 12) SELECT id, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY id")
def seeded_reach(spark, sf_dir):
    """All parts and suppliers, from those whose id divides by 97; a supplier's id is below zero. The SQL's twelve steps are more than any path needs."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b"))
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).filter("id % 97 = 0")
    return identity.seeded_reach(edges, ids)


@query("WITH p AS (SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON string_split(c_name, '#')[-1] = string_split(s_name, '#')[-1]), a AS (SELECT *, count(*) OVER (PARTITION BY c_custkey) AS x, count(*) OVER (PARTITION BY s_suppkey) AS y FROM p) SELECT c_custkey, s_suppkey FROM a WHERE x = 1 AND y = 1")
def unique_match(spark, sf_dir):
    """All customers and suppliers by the number in their names."""
    number = lambda c: F.substring_index(c, "#", -1).alias("k")
    left = table(spark, sf_dir, "customer").select("c_custkey", number("c_name"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", number("s_name"))
    return identity.unique_match(left, right, "c_custkey", "s_suppkey", "k")


@query()
def constrained_merge(spark, sf_dir):
    """Decisions of each supplier on all its parts; the supplier's own id is below zero."""
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group"), order.alias("order"), F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b"), F.when(F.col("l_returnflag") == "R", "different").otherwise("same").alias("relation"))
    return identity.constrained_merge(rows, ["group"])


@query(
    f"""WITH {ENTITIES_SQL}, h AS (SELECT *, CASE p_size % 4 WHEN 0 THEN ['side'] WHEN 1 THEN ['back', 'detail'] WHEN 2 THEN [] ELSE ['three_quarter'] END AS hints, importance = 'major' OR priority = 'required' AS ma, importance = 'recurring' OR priority = 'recommended' AS mi FROM ents),
 b AS (SELECT entity_id, kind, hints, CASE kind WHEN 'character' THEN CASE WHEN ma THEN ['face', 'full_front', 'three_quarter', 'back'] WHEN mi THEN ['face', 'full_front', 'three_quarter'] ELSE ['face'] END
   WHEN 'location' THEN ['wide'] ELSE list_concat([CASE WHEN list_contains(hints, 'front') THEN 'front' WHEN list_contains(hints, 'three_quarter') THEN 'three_quarter' WHEN list_contains(hints, 'side') THEN 'side' ELSE 'front' END], CASE WHEN ma THEN ['detail'] ELSE [] END) END AS base FROM h),
 f AS (SELECT entity_id, kind, CASE kind WHEN 'location' THEN base ELSE list_concat(base, list_filter(CASE kind WHEN 'character' THEN ['face', 'full_front', 'three_quarter', 'back'] ELSE ['front', 'three_quarter', 'side', 'detail'] END, lambda v: list_contains(hints, v) AND NOT list_contains(base, v)))[:3] END AS views FROM b)
 SELECT entity_id, array_to_string(views, ',') AS views FROM f"""
)
def base_views(spark, sf_dir):
    lists = [["side"], ["back", "detail"], [], ["three_quarter"]]
    hints = F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in lists]), (F.col("p_size") % 4 + 1).cast("int"))
    e = entities(spark, sf_dir).withColumn("hints", hints)
    views = assets.base_views(F.col("kind"), F.col("importance"), F.col("priority"), F.col("hints"), 3)
    return e.select("entity_id", F.array_join(views, ",").alias("views"))


@query(f"WITH {ENTITIES_SQL} SELECT entity_id, priority FROM ents WHERE kind = 'character' AND p_size % 2 = 0 AND priority IN ('required', 'recommended')")
def audio_specs(spark, sf_dir):
    e = entities(spark, sf_dir).withColumn("speaks", F.col("p_size") % 2 == 0)
    return assets.audio_specs(e, "recommended").select("entity_id", "priority")


SLOTS_SQL = """WITH c AS (SELECT DISTINCT l_orderkey AS scene, l_partkey AS subject, l_partkey % 7 = 0 AS is_location, l_linenumber AS views, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS prominence FROM lineitem),
 s AS (SELECT scene, subject, bool_or(is_location) AS is_location, max(views) AS views, min(prominence) AS prominence FROM c GROUP BY scene, subject),
 r AS (SELECT scene, subject, is_location, prominence, subject AS ord, unnest(range(0, views)) AS level FROM s),
 f AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY is_location DESC, prominence, ord) AS p FROM r WHERE level = 0), f2 AS (SELECT * FROM f WHERE p <= 6), u AS (SELECT scene, count(*) AS used FROM f2 GROUP BY scene),
 l AS (SELECT r.*, used, row_number() OVER (PARTITION BY r.scene ORDER BY r.level, r.prominence, r.ord) AS p FROM r JOIN f2 ON f2.scene = r.scene AND f2.subject = r.subject JOIN u ON u.scene = r.scene WHERE r.level BETWEEN 1 AND 2),
 b AS (SELECT scene, subject, prominence, ord, level FROM f2 UNION ALL SELECT scene, subject, prominence, ord, level FROM l WHERE p + used <= 6),
 slots AS (SELECT scene, subject, CAST(level AS INTEGER) AS level, CAST(row_number() OVER (PARTITION BY scene ORDER BY prominence, ord, level) AS INTEGER) AS slot FROM b)"""


def scene_subjects(spark, sf_dir):
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    rank = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return li.groupBy(F.col("l_orderkey").alias("scene"), F.col("l_partkey").alias("subject")).agg(F.max("l_linenumber").alias("views"), F.min(rank).alias("prominence"))


def slot_candidates(spark, sf_dir):
    return scene_subjects(spark, sf_dir).select("scene", "subject", (F.col("subject") % 7 == 0).alias("is_location"), "prominence", F.col("subject").alias("ord"), F.explode(F.sequence(F.lit(0), F.col("views") - 1)).alias("level"))


@query(SLOTS_SQL + " SELECT * FROM slots")
def budgeted_slots(spark, sf_dir):
    return assets.budgeted_slots(slot_candidates(spark, sf_dir), ["scene"], 6, 3)


@query(SLOTS_SQL + " SELECT s.scene, s.subject, CASE WHEN s.subject % 5 = 0 THEN 'no image' ELSE 'budget exhausted' END AS reason FROM s WHERE NOT EXISTS (SELECT 1 FROM slots k WHERE k.scene = s.scene AND k.subject = s.subject AND k.subject % 5 <> 0)")
def coverage_gaps(spark, sf_dir):
    """Subjects whose number divides by five have no image and so no slot."""
    seen = scene_subjects(spark, sf_dir).select("scene", "subject")
    slots = assets.budgeted_slots(slot_candidates(spark, sf_dir), ["scene"], 6, 3).filter("subject % 5 <> 0")
    return assets.coverage_gaps(seen, seen.filter("subject % 5 <> 0").select("subject"), slots, ["scene"])


@query(f"WITH {ENTITIES_SQL} SELECT entity_id, a.l_orderkey AS asset_id, '<Picture ' || a.k || '>' AS label FROM ents LEFT JOIN (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS k FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) a ON a.l_partkey = entity_id")
def entity_assets(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("asset_id")).distinct()
    return entities(spark, sf_dir).select("entity_id").join(assets.numbered(a, ["entity_id"], ["asset_id"], "Picture"), "entity_id", "left")
