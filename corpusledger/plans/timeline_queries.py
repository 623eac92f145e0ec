"""Queries of the timeline, appearance and ledger operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalogs, quality, timeline
from .base import OBSERVATIONS_SQL, SEQUENCES_SQL, chapters, observations, query, sequences, table

COMPILE_SQL = f"""WITH {OBSERVATIONS_SQL},
 common AS (SELECT entity, attribute, CAST(min(description) AS VARCHAR) AS description FROM obs WHERE scope = 'intrinsic' GROUP BY entity, attribute HAVING count(DISTINCT description) = 1),
 cand AS (SELECT o.* FROM obs o LEFT JOIN common c USING (entity, attribute) WHERE o.scope = 'scene' OR c.entity IS NULL),
 has AS (SELECT *, bool_or(scope = 'scene') OVER (PARTITION BY entity, chapter, sequence, attribute) AS hs FROM cand),
 loc AS (SELECT entity, chapter, sequence, attribute, count(DISTINCT description) AS n, CAST(arg_max(description, ord) AS VARCHAR) AS description FROM has WHERE scope = 'scene' OR NOT hs GROUP BY ALL),
 state AS (SELECT o.entity, o.chapter, o.sequence, arg_min(presence, CASE presence WHEN 'visible' THEN 1 WHEN 'offscreen' THEN 2 ELSE 3 END) AS presence FROM obs o GROUP BY ALL),
 excl AS (SELECT entity, chapter, sequence, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS excluded FROM loc WHERE n > 1 GROUP BY ALL),
 st AS (SELECT s.*, coalesce(x.excluded, '') AS excluded FROM state s LEFT JOIN excl x USING (entity, chapter, sequence)),
 traits AS (SELECT coalesce(b.entity, l.entity) AS entity, coalesce(b.chapter, l.chapter) AS chapter, coalesce(b.sequence, l.sequence) AS sequence, coalesce(b.attribute, l.attribute) AS attribute, coalesce(l.description, b.description) AS description
   FROM (SELECT s.entity, s.chapter, s.sequence, c.attribute, c.description FROM st s JOIN common c USING (entity) WHERE presence = 'visible' AND NOT list_contains(string_split(excluded, ','), c.attribute)) b
   FULL OUTER JOIN (SELECT l.* FROM loc l JOIN st s USING (entity, chapter, sequence) WHERE l.n = 1 AND s.presence = 'visible') l
   ON b.entity = l.entity AND b.chapter = l.chapter AND b.sequence = l.sequence AND b.attribute = l.attribute)
"""


@query(f"WITH {OBSERVATIONS_SQL} SELECT entity, chapter, sequence, string_agg(attribute || '=' || description, '|' ORDER BY ord) AS observations FROM obs GROUP BY ALL")
def timeline_merge(spark, sf_dir):
    out = timeline.merge_timeline(observations(spark, sf_dir), ["entity", "chapter", "sequence"], ["ord"], F.concat_ws("=", "attribute", "description"))
    return out.withColumn("observations", F.array_join("observations", "|"))


@query(f"WITH {OBSERVATIONS_SQL} SELECT entity, min(chapter) AS first_chapter, arg_min(sequence, (chapter, sequence)) AS first_sequence FROM obs GROUP BY entity")
def first_occurrence(spark, sf_dir):
    return timeline.first_occurrence(observations(spark, sf_dir))


@query(f"WITH {OBSERVATIONS_SQL} SELECT entity, attribute, CAST(min(description) AS VARCHAR) AS description FROM obs WHERE scope = 'intrinsic' GROUP BY entity, attribute HAVING count(DISTINCT description) = 1")
def common_attr(spark, sf_dir):
    return timeline.common_traits(observations(spark, sf_dir))


@query(COMPILE_SQL + "SELECT entity, chapter, sequence, presence, excluded FROM st")
def compile_appearance(spark, sf_dir):
    return timeline.compile_appearance(observations(spark, sf_dir))[1].select("entity", "chapter", "sequence", "presence", F.array_join("excluded_attributes", ",").alias("excluded"))


@query(COMPILE_SQL + "SELECT * FROM traits")
def traits_at(spark, sf_dir):
    return timeline.traits_at(*timeline.compile_appearance(observations(spark, sf_dir)))


@query(
    COMPILE_SQL
    + """, sg AS (SELECT s.entity, s.chapter, s.sequence, coalesce(string_agg(DISTINCT t.attribute || '=' || lower(t.description), ';' ORDER BY t.attribute || '=' || lower(t.description)), '') AS sig
   FROM st s LEFT JOIN traits t USING (entity, chapter, sequence) WHERE s.presence = 'visible' GROUP BY ALL),
 base AS (SELECT entity, string_agg(DISTINCT attribute || '=' || lower(description), ';' ORDER BY attribute || '=' || lower(description)) AS b FROM common GROUP BY entity),
 v AS (SELECT sg.*, CASE WHEN sig = coalesce(b, '') THEN 'base' ELSE 'state_' || left(sha256(sig), 16) END AS variant FROM sg LEFT JOIN base USING (entity))
 SELECT entity, variant, count(*) AS n_scenes, min(chapter) AS first_chapter, arg_min(sequence, (chapter, sequence)) AS first_sequence FROM v GROUP BY entity, variant"""
)
def variant_groups(spark, sf_dir):
    common, state, local = timeline.compile_appearance(observations(spark, sf_dir))
    return timeline.variants(timeline.traits_at(common, state, local), state, common)


@query(f"WITH {OBSERVATIONS_SQL}, c AS (SELECT *, CASE WHEN description IN (1, 2) THEN 1 ELSE description END AS d FROM obs) SELECT entity, attribute, CAST(min(d) AS VARCHAR) AS description FROM c WHERE scope = 'intrinsic' GROUP BY entity, attribute HAVING count(DISTINCT d) = 1")
def equivalence_collapse(spark, sf_dir):
    """Descriptions 1 and 2 are confirmed equal."""
    rows = observations(spark, sf_dir)
    decisions = rows.filter("description IN (1, 2)").select("entity", "attribute", "description", F.lit(1).alias("selected")).distinct()
    return timeline.common_traits(timeline.collapse_equivalent(rows, decisions))


@query(f"WITH {OBSERVATIONS_SQL}, a AS (SELECT DISTINCT entity, chapter, sequence FROM obs WHERE event_id % 4 = 0) SELECT o.entity, o.chapter, o.sequence, count(*) AS n FROM obs o JOIN a USING (entity, chapter, sequence) GROUP BY ALL")
def at_address(spark, sf_dir):
    rows = observations(spark, sf_dir)
    address = ["entity", "chapter", "sequence"]
    return catalogs.selected(rows, rows.filter("event_id % 4 = 0"), address).groupBy(*address).agg(F.count(F.lit(1)).alias("n"))


PRESENCE_SQL = f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT chapter, sequence, entity AS local_id, CASE WHEN event_id % 9 = 0 THEN 'absent' WHEN event_id % 4 = 0 THEN 'uncertain' ELSE presence END AS presence, 'q' || (event_id % 3) AS quote, upper(attribute) AS label FROM obs),
 k AS (SELECT * FROM r WHERE presence <> 'absent'),
 i AS (SELECT chapter, sequence, quote, lower(label) AS ll, count(DISTINCT local_id) > 1 AS many FROM k GROUP BY ALL),
 k2 AS (SELECT k.chapter, k.sequence, k.local_id, CASE WHEN many THEN 'uncertain' ELSE presence END AS presence, k.quote, k.label FROM k JOIN i ON i.chapter = k.chapter AND i.sequence = k.sequence AND i.quote = k.quote AND i.ll = lower(k.label)),
 k3 AS (SELECT *, count(*) FILTER (presence = 'uncertain') OVER (PARTITION BY chapter, sequence, quote) AS u FROM k2)
"""


def presence_rows(spark, sf_dir):
    rows = observations(spark, sf_dir)
    presence = F.when(F.col("event_id") % 9 == 0, "absent").when(F.col("event_id") % 4 == 0, "uncertain").otherwise(F.col("presence"))
    return rows.select("chapter", "sequence", F.col("entity").alias("local_id"), presence.alias("presence"), F.concat(F.lit("q"), (F.col("event_id") % 3).cast("string")).alias("quote"), F.upper("attribute").alias("label"))


@query(PRESENCE_SQL + "SELECT chapter, sequence, local_id, presence, quote, label FROM k3 WHERE NOT (presence = 'uncertain' AND u > 1) UNION ALL SELECT DISTINCT chapter, sequence, NULL, 'unresolved', quote, 'Unidentified character' FROM k3 WHERE presence = 'uncertain' AND u > 1")
def presence_resolution(spark, sf_dir):
    kept, unresolved = timeline.resolve_presence(presence_rows(spark, sf_dir))
    rest = unresolved.select("chapter", "sequence", F.lit(None).cast("long").alias("local_id"), F.lit("unresolved").alias("presence"), "quote", "label")
    return kept.unionByName(rest)


def ledger_inputs(spark, sf_dir):
    """Facts from events: a chapter per user, an entity per event type, a sequence per event."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumn("sequence", F.row_number().over(order))
    entity = F.concat(F.lit("The "), F.col("event_type"), (F.col("event_id") % 8).cast("string"))
    updates = rows.select(F.col("user_id").alias("chapter"), "sequence", F.lit(1).alias("update_no"), entity.alias("entity"), (F.col("event_id") % 6).cast("string").alias("aspect"), F.col("props").alias("fact"))
    resets = rows.select(F.col("user_id").alias("chapter"), "sequence", ((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 0)).alias("reset"))
    return updates, resets


LEDGER_SQL = """WITH r AS (SELECT user_id AS chapter, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence, 'The ' || event_type || (event_id % 8) AS entity, CAST(event_id % 6 AS VARCHAR) AS aspect, props AS fact, event_type = 'signup' AND event_id % 50 = 0 AS reset FROM events)"""


@query(
    "WITH RECURSIVE " + LEDGER_SQL.removeprefix("WITH ") + f""", u AS (SELECT chapter, sequence, reset, {{'entity': entity, 'aspect': aspect, 'fact': fact, 'sequence': sequence}} AS f FROM r),
 state AS (SELECT chapter, sequence, [f] AS facts FROM u WHERE sequence = 1
  UNION ALL
  SELECT u.chapter, u.sequence, list_concat(CASE WHEN u.reset THEN [] ELSE list_filter(s.facts, lambda x: x.entity <> u.f.entity) END, [u.f])[-{timeline.MOST_FACTS}:] FROM state s JOIN u ON u.chapter = s.chapter AND u.sequence = s.sequence + 1)
 SELECT chapter, sequence, len(facts) AS n_facts, sha256(array_to_string(list_sort(list_transform(facts, lambda x: concat_ws('|', x.entity, x.aspect, x.fact, x.sequence))), ';')) AS facts_sha256 FROM state"""
)
def fact_ledger(spark, sf_dir):
    """After every sequence the number of facts and their digest."""
    rows = timeline.fact_ledger(*ledger_inputs(spark, sf_dir))
    line = F.concat_ws("|", "entity", "aspect", "fact", "from_sequence")
    return rows.groupBy("chapter", "sequence").agg(F.count(F.lit(1)).alias("n_facts"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";"), 256).alias("facts_sha256"))


@query(LEDGER_SQL + ", n AS (SELECT *, lead(sequence) OVER (PARTITION BY chapter, entity ORDER BY sequence) AS nx, (SELECT min(x.sequence) FROM r x WHERE x.chapter = r.chapter AND x.reset AND x.sequence > r.sequence) AS cut FROM r) SELECT chapter, sequence, entity, aspect, fact, least(nx, cut) AS until_sequence FROM n")
def unbounded_ledger(spark, sf_dir):
    return timeline.unbounded_facts(*ledger_inputs(spark, sf_dir)).select("chapter", "sequence", "entity", "aspect", "fact", "until_sequence")


@query(
    """WITH s AS (SELECT l_orderkey, sum(CAST(l_linenumber AS DOUBLE) / 4) AS s, count(*) AS n, count(*) % 3 * 0.5 AS pause, CASE WHEN l_orderkey % 10 = 0 THEN 1.0 END AS wrong FROM lineitem GROUP BY l_orderkey),
 t AS (SELECT *, s + pause AS total FROM s),
 r AS (SELECT l_orderkey, CASE WHEN total <= 0 OR abs(total - coalesce(wrong, total)) > 0.05 THEN 'total_mismatch' WHEN total > 6 THEN 'over_limit' WHEN n > 1 AND total * 1.25 > 6 THEN 'over_margin' END AS rule, total FROM t)
 SELECT l_orderkey AS scene, rule, total FROM r WHERE rule IS NOT NULL"""
)
def duration_issues(spark, sf_dir):
    """Beats are line items of an order; every tenth scene states a wrong total."""
    beats = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), (F.col("l_linenumber") / 4).alias("seconds"))
    scenes = beats.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("s")).select("scene", (F.col("n") % 3 * 0.5).alias("pause"), "s")
    scenes = scenes.select("scene", "pause", F.when(F.col("scene") % 10 == 0, F.lit(1.0)).otherwise(F.col("s") + F.col("pause")).alias("stated"))
    return timeline.duration_issues(beats, scenes, ["scene"], 6.0)


@query(
    f"""WITH {SEQUENCES_SQL}, p AS (SELECT chapter_id, string_agg(source, ' ' ORDER BY sequence) AS p, max(sequence) AS n FROM seqs GROUP BY chapter_id),
 q AS (SELECT d.doc_id AS chapter_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS w, n FROM documents d JOIN p ON p.chapter_id = d.doc_id),
 k AS (SELECT q.chapter_id, w, coalesce(trim(regexp_replace(string_agg(s.source, ' ' ORDER BY s.sequence) FILTER (NOT (q.chapter_id % 7 = 0 AND s.sequence = n) AND NOT (q.chapter_id % 11 = 0 AND s.sequence = 1)), '\\s+', ' ', 'g')), '') AS p FROM q JOIN seqs s USING (chapter_id) GROUP BY q.chapter_id, w)
 SELECT chapter_id, CASE WHEN starts_with(w, p) THEN 'deferred_suffix' ELSE 'not_covered' END AS rule FROM k WHERE p <> w"""
)
def source_cover(spark, sf_dir):
    """The lines must make up the document; some documents lose their last or first line."""
    s = sequences(spark, sf_dir)
    ends = s.groupBy("chapter_id").agg(F.max("sequence").alias("n"))
    lost = ((F.col("chapter_id") % 7 == 0) & (F.col("sequence") == F.col("n"))) | ((F.col("chapter_id") % 11 == 0) & (F.col("sequence") == 1))
    parts = s.join(ends, "chapter_id").filter(~lost).select("chapter_id", F.col("sequence").alias("number"), "source")
    return timeline.coverage_violations(parts, chapters(spark, sf_dir).select("chapter_id", "text"), ["chapter_id"], "source", "text")


@query("SELECT conv_id, turn, lag(turn) OVER w AS previous_turn, lag(role) OVER w AS previous_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_scene(spark, sf_dir):
    rows = timeline.previous(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["turn", "role"])
    return rows.select("conv_id", "turn", "previous_turn", "previous_role")


@query("SELECT conv_id, turn, coalesce(string_agg(CAST(length(text) AS VARCHAR), ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history, coalesce(string_agg(CAST(length(text) AS VARCHAR), ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS future FROM conversations")
def history_future(spark, sf_dir):
    rows = timeline.around(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.length("text").cast("string"))
    return rows.select("conv_id", "turn", F.array_join("history", ",").alias("history"), F.array_join("future", ",").alias("future"))


@query("WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT * FROM conversations WHERE (conv_id + turn) % 9 <> 0)) SELECT conv_id, turn, CASE WHEN turn <= p THEN 'not_increasing' ELSE 'gap' END AS rule FROM t WHERE turn <> k - 1")
def order_violations(spark, sf_dir):
    """Turns must be dense from 0; some turns are left out."""
    rows = table(spark, sf_dir, "conversations").filter("(conv_id + turn) % 9 <> 0")
    return quality.order_violations(rows, ["conv_id"], "turn", 0).select("conv_id", "turn", "rule")


PHASES_SQL = f"{SEQUENCES_SQL}, ph AS (SELECT chapter_id, sequence, unnest(['initial', 'event', 'ending']) AS phase, unnest([left(source, length(source) // 2), source, substring(source, length(source) // 2 + 1)]) AS text FROM seqs), ids AS (SELECT chapter_id, CAST(sequence AS INTEGER) AS sequence, phase, left(sha256('v' || chapter_id || chr(31) || 'v' || sequence || chr(31) || 'v' || phase || chr(31) || 'v' || text), 24) AS content_id FROM ph WHERE length(trim(text)) > 0)"


def phased(spark, sf_dir):
    """Lines with their halves as initial and final state."""
    half = F.floor(F.length("source") / 2).cast("int")
    phases = F.struct(F.left("source", half).alias("initial"), F.col("source").alias("event"), F.substring(F.col("source"), half + 1, F.length("source")).alias("ending"))
    return sequences(spark, sf_dir).select("chapter_id", "sequence", phases.alias("adaptation"))


@query(f"WITH {PHASES_SQL} SELECT * FROM ids")
def phase_rows(spark, sf_dir):
    return catalogs.phase_rows(phased(spark, sf_dir), "chapter_id").select("chapter_id", "sequence", "phase", "content_id")
