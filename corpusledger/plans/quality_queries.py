"""Queries of the quality and decision operators, joins, aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogs, decisions, quality
from .base import ENTITIES_SQL, OBSERVATIONS_SQL, chapters, entities, observations, query, table


@query("SELECT 'duplicate_key' AS rule, user_id || '/' || event_type || '/' || strftime(ts, '%Y-%m-%d') AS key, CAST(count(*) AS VARCHAR) AS detail FROM events GROUP BY user_id, event_type, strftime(ts, '%Y-%m-%d') HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return quality.duplicate_keys(rows, ["user_id", "event_type", "day"])


COVER_SQL = "WITH e AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1) GROUP BY doc_id)"


@query(COVER_SQL + " SELECT CASE WHEN r.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'foreign' ELSE 'repeated' END AS rule, CAST(coalesce(e.id, r.id) AS VARCHAR) AS key, CAST(coalesce(n, 0) AS VARCHAR) AS detail FROM e FULL OUTER JOIN r ON e.id = r.id WHERE r.id IS NULL OR e.id IS NULL OR n > 1")
def id_coverage(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    returned = labels.select(F.col("doc_id").alias("id")).unionAll(labels.filter("quality = 1 AND toxic = 1").select(F.col("doc_id").alias("id")))
    return quality.id_coverage(chapters(spark, sf_dir).filter("chapter_id % 2 = 0").select(F.col("chapter_id").alias("id")), returned, "id")


@query(
    """WITH e AS (SELECT user_id AS id, event_id, value, count(*) OVER (PARTITION BY user_id) AS n, user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS known FROM events)
 SELECT id, event_id, CASE WHEN NOT known THEN 'foreign id' WHEN n > 1 THEN 'repeated id' WHEN NOT value > 10 THEN 'invalid' END AS reason FROM e"""
)
def salvage_rows(spark, sf_dir):
    """Every event: kept if its user is known, occurs once and has a value above ten, else with the reason of its refusal."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "value")
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    kept, refused = quality.salvage(rows, known, "id", F.col("value") > 10)
    return kept.select("id", "event_id").unionByName(refused.select("id", "event_id", "reason"), allowMissingColumns=True)


@query("SELECT 'sha_mismatch' AS rule, CAST(doc_id AS VARCHAR) AS key, '' AS detail FROM documents WHERE doc_id % 9 = 0")
def sha_mismatch(spark, sf_dir):
    """Every ninth document's saved digest is that of another text."""
    text = F.when(F.col("chapter_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return quality.digest_mismatch(chapters(spark, sf_dir).withColumn("digest", F.sha2(text, 256)), "chapter_id", "text", "digest")


@query(
    """WITH l AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 11 = 1 THEN p_partkey WHEN p_size % 13 = 2 THEN -1 ELSE p_partkey // 2 END AS link FROM part)
 SELECT CASE WHEN l.id = l.link THEN 'self_link' WHEN t.id IS NULL THEN 'dangling_link' ELSE 'chained_link' END AS rule, CAST(l.id AS VARCHAR) AS key, CAST(l.link AS VARCHAR) AS detail
 FROM l LEFT JOIN l t ON t.id = l.link WHERE l.link IS NOT NULL AND (l.id = l.link OR t.id IS NULL OR t.link IS NOT NULL)"""
)
def link_chains(spark, sf_dir):
    link = F.when(F.col("p_size") % 3 == 0, None).when(F.col("p_size") % 11 == 1, F.col("p_partkey")).when(F.col("p_size") % 13 == 2, F.lit(-1)).otherwise(F.floor(F.col("p_partkey") / 2))
    return quality.link_chains(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), link.alias("link")), "id", "link")


@query(
    f"""WITH {OBSERVATIONS_SQL}, st AS (SELECT entity, chapter, sequence, min(CASE presence WHEN 'visible' THEN 1 WHEN 'offscreen' THEN 2 ELSE 3 END) AS p FROM obs GROUP BY ALL), b AS (SELECT entity, chapter, sequence FROM obs WHERE event_id % 5 < 2)
 SELECT 'not_visible' AS rule, entity || '/' || chapter || '/' || sequence AS key, '' AS detail FROM b JOIN st USING (entity, chapter, sequence) WHERE p > 1
 UNION ALL SELECT 'repeated_binding', entity || '/' || chapter || '/' || sequence, CAST(count(*) AS VARCHAR) FROM b GROUP BY entity, chapter, sequence HAVING count(*) > 1"""
)
def binding_violations(spark, sf_dir):
    from ..operators.timeline import scene_presence

    rows = observations(spark, sf_dir)
    address = ["entity", "chapter", "sequence"]
    return quality.binding_violations(rows.filter("event_id % 5 < 2").select(*address), scene_presence(rows), address)


@query(f"WITH {OBSERVATIONS_SQL} SELECT 'future_evidence' AS rule, chapter || '/' || sequence AS key, CAST(sequence + event_id % 3 - 1 AS VARCHAR) AS detail FROM obs WHERE event_id % 4 = 0 AND event_id % 3 = 2")
def future_evidence(spark, sf_dir):
    rows = observations(spark, sf_dir).select("chapter", "sequence", (F.col("sequence") + F.col("event_id") % 3 - 1).alias("source_sequence"), F.when(F.col("event_id") % 4 == 0, "explicit").otherwise("inferred").alias("evidence"))
    return quality.future_evidence(rows)


@query("WITH n AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, turn AS issue, CASE WHEN turn % 3 = 0 THEN 99 ELSE turn END AS t FROM conversations WHERE turn % 2 = 1) SELECT conv_id, issue, t AS target, 'issue' AS status FROM r JOIN n USING (conv_id) WHERE t BETWEEN 1 AND n UNION ALL SELECT conv_id, issue, unnest(range(1, n + 1)), 'doubt' FROM r JOIN n USING (conv_id) WHERE NOT t BETWEEN 1 AND n")
def spread_doubts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    reviews = c.filter("turn % 2 = 1").select("conv_id", F.col("turn").alias("issue"), F.when(F.col("turn") % 3 == 0, F.lit(99)).otherwise(F.col("turn")).alias("target"))
    return quality.spread_doubts(reviews, c.select("conv_id", (F.col("turn") + 1).alias("target")), "conv_id")


LINT_TEXT = "'Shot 1: <Subject 1> ' || c_name || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'Shot 3: At 00:04.000, <Picture ' || c_nationkey || '>' WHEN c_custkey % 3 = 1 THEN 'Shot 2: At 00:01.000, x' ELSE 'Shot 2: x ```' END"


@query(
    f"""WITH t AS (SELECT c_custkey, c_nationkey, {LINT_TEXT} AS text FROM customer)
 SELECT c_custkey, 'unbound_label' AS rule, '<Picture ' || c_nationkey || '>' AS detail FROM t WHERE c_custkey % 3 = 0 AND c_nationkey > 3
 UNION ALL SELECT c_custkey, 'shot_numbering', '1,3' FROM t WHERE c_custkey % 3 = 0
 UNION ALL SELECT c_custkey, 'short_shot', '' FROM t WHERE c_custkey % 3 = 1
 UNION ALL SELECT c_custkey, 'code_fence', '' FROM t WHERE c_custkey % 3 = 2
 UNION ALL SELECT c_custkey, 'missing_timestamp', '0' FROM t WHERE c_custkey % 3 = 2"""
)
def lint_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(LINT_TEXT.replace("chr(10)", "'\\n'")).alias("text"))
    bound = F.array(F.lit("<Subject 1>"), *[F.lit(f"<Picture {i}>") for i in range(4)])
    return quality.lint(c.withColumn("bound", bound), "c_custkey", "text", "bound", 10.0, 9)


@query("SELECT event_id, 'wrong_type' AS rule, 'k' AS detail FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 'missing_field', 'k' FROM events WHERE event_id % 4 = 2 UNION ALL SELECT event_id, 'unknown_field', 'z' FROM events WHERE event_id % 4 = 2")
def json_shape(spark, sf_dir):
    """Properties must be an object with an integer k; some events say true instead, or z."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 4 == 1, F.lit('{"k": true}')).when(F.col("event_id") % 4 == 2, F.lit('{"z": 1}')).otherwise(F.col("props"))
    return quality.json_rules(e.select("event_id", F.try_parse_json(text).alias("v")), "event_id", "v", {"k": "BIGINT"})


REUSE_SQL = "WITH r AS (SELECT event_id, event_type, props FROM events), now AS (SELECT event_type, props, max('now' || user_id) AS result FROM events WHERE event_id % 10 = 0 GROUP BY ALL), old AS (SELECT event_type, props, min('old' || user_id) AS result FROM events WHERE event_id % 3 = 0 GROUP BY ALL)"


@query(REUSE_SQL + " SELECT event_id, coalesce(now.result, old.result) AS result, CASE WHEN now.result IS NULL THEN 1 ELSE 0 END AS source_rank FROM r LEFT JOIN now USING (event_type, props) LEFT JOIN old USING (event_type, props) WHERE coalesce(now.result, old.result) IS NOT NULL")
def reuse_decisions(spark, sf_dir):
    e = decisions.fingerprints(table(spark, sf_dir, "events"), ["event_type", "props"], "v1")
    now = e.filter("event_id % 10 = 0").groupBy("fingerprint").agg(F.max(F.concat(F.lit("now"), F.col("user_id").cast("string"))).alias("result"))
    old = e.filter("event_id % 3 = 0").groupBy("fingerprint").agg(F.min(F.concat(F.lit("old"), F.col("user_id").cast("string"))).alias("result"))
    return decisions.reuse(e.select("event_id", "fingerprint"), [now, old])[0].select("event_id", "result", "source_rank")


@query("SELECT event_id, 'props' AS component FROM events WHERE event_id % 6 = 0 UNION ALL SELECT event_id, 'event_type' FROM events WHERE event_id % 10 = 0")
def changed_components(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    before = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit("other")).otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 6 == 0, None).otherwise(F.col("props")).alias("props"))
    parts = ["event_type", "props"]
    return decisions.changed_components(decisions.fingerprints(e, parts, "v1"), decisions.fingerprints(before, parts, "v1"), "event_id")


@query("SELECT event_id, CASE WHEN (event_id % 7) < 5 THEN event_type ELSE 'uncertain' END AS result, CASE WHEN event_id % 7 < 3 THEN 1 ELSE 2 END AS attempt, CASE WHEN event_id % 7 < 5 THEN 'decided' ELSE 'default' END AS status FROM events")
def retry_rounds(spark, sf_dir):
    """The function answers some requests at once, some at the second attempt, some never."""
    import pandas as pd

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        good = (pdf["event_id"] % 7 < 3) | ((pdf["event_id"] % 7 < 5) & (pdf["attempt"] > 1))
        return pd.DataFrame({"event_id": pdf["event_id"], "result": pdf["event_type"].where(good, "?")})

    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return decisions.decide_with_retries(e, "event_id", answer, "event_id long, result string", F.col("result") != "?", 2, F.lit("uncertain"), 8)


@query("SELECT l_orderkey AS scene, bool_and(l_linestatus = 'F') AND sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 AS approved FROM lineitem GROUP BY l_orderkey")
def approval(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed").alias("status"), (F.col("l_returnflag") == "R").cast("int").alias("issues"))
    return decisions.approval(rows, ["scene"])


@query("WITH r AS (SELECT l_orderkey AS scene, list(DISTINCT l_returnflag || l_linestatus) AS b, list(DISTINCT l_returnflag || l_linestatus) FILTER (l_linenumber > 2) AS a FROM lineitem GROUP BY ALL) SELECT scene, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AND len(a) < len(b) AS accepted FROM r WHERE a IS NOT NULL AND b IS NOT NULL")
def non_regression(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), F.concat("l_returnflag", "l_linestatus").alias("rule"), "l_linenumber")
    before = li.groupBy("scene").agg(F.collect_set("rule").alias("rules"))
    after = li.filter("l_linenumber > 2").groupBy("scene").agg(F.collect_set("rule").alias("rules"))
    return decisions.non_regression(before, after, "scene")


@query("SELECT event_type AS stage, count(*) AS calls, count(*) FILTER (event_id % 3 = 0) AS hits, count(*) FILTER (event_id % 3 <> 0) AS misses, CAST(sum(length(props)) AS BIGINT) AS n_bytes, CAST(sum(event_id % 5) AS BIGINT) AS seconds FROM events GROUP BY event_type")
def stage_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 3 == 0).alias("cached"), F.octet_length("props").cast("long").alias("n_bytes"), (F.col("event_id") % 5).alias("seconds"))
    return decisions.stage_metrics(rows)


@query("SELECT user_id, event_id, greatest(0, n - 50) AS dropped FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= 50")
def event_tail(spark, sf_dir):
    return decisions.event_tail(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 50)


@query("SELECT l_orderkey AS scene, count(*) FILTER (l_returnflag = 'R') AS failed, coalesce(max(l_linenumber) FILTER (l_returnflag <> 'R') > max(l_linenumber) FILTER (l_returnflag = 'R'), false) AS recovered FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'R') > 0")
def attempt_recovery(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") != "R").alias("ok"))
    return decisions.attempt_recovery(rows, ["scene"])


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS issue, l_partkey AS ord, l_returnflag = 'R' AS selected FROM lineitem), q AS (SELECT issue, ord, bool_or(selected) AS selected FROM p GROUP BY ALL),
 a AS (SELECT issue, count(*) FILTER (selected) AS n, min(ord) FILTER (selected) AS s, min(ord) AS f FROM q GROUP BY issue)
 SELECT o_orderkey AS issue, coalesce(CASE WHEN n = 1 THEN 'p' || s END, 'p' || f, 'own') AS adaptation FROM orders LEFT JOIN a ON issue = o_orderkey"""
)
def resolve_choice(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("issue"), F.col("l_partkey").alias("ord")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("selected"))
    proposals = li.withColumn("adaptation", F.concat(F.lit("p"), F.col("ord").cast("string")))
    issues = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("issue"), F.lit("own").alias("adaptation"))
    return decisions.resolve_choice(issues, proposals, ["issue"])


@query(f"WITH {ENTITIES_SQL} SELECT brand, count(*) FILTER (kind = 'character') AS characters, count(*) FILTER (kind = 'location') AS locations, count(*) FILTER (kind = 'object') AS objects FROM ents GROUP BY brand")
def kind_counts(spark, sf_dir):
    return catalogs.kind_summary(entities(spark, sf_dir), ["brand"], "kind", {"character": "characters", "location": "locations", "object": "objects"})


@query(f"WITH {ENTITIES_SQL}, d AS (SELECT brand, p_type, min(entity_id) AS f FROM ents GROUP BY ALL) SELECT brand, bool_or(p_size > 45) AS speaks, string_agg(p_type, '|' ORDER BY f) AS types FROM ents JOIN d USING (brand, p_type) WHERE entity_id = f GROUP BY brand".replace("bool_or(p_size > 45) AS speaks", "(SELECT bool_or(x.p_size > 45) FROM ents x WHERE x.brand = ents.brand) AS speaks").replace("GROUP BY brand", "GROUP BY ents.brand").replace("SELECT brand, (SELECT", "SELECT ents.brand AS brand, (SELECT"))
def ordered_union(spark, sf_dir):
    e = entities(spark, sf_dir)
    types = catalogs.ordered_union(e, ["brand"], "p_type", "entity_id").select("brand", F.array_join("values", "|").alias("types"))
    return e.groupBy("brand").agg(F.bool_or(F.col("p_size") > 45).alias("speaks")).join(types, "brand")


@query("SELECT doc_id AS chapter_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_docs(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("chapter_id"))
    return catalogs.selected(chapters(spark, sf_dir), good, ["chapter_id"]).select("chapter_id", "source")


@query("SELECT 'both' AS kind, id FROM (SELECT c_custkey AS id FROM customer INTERSECT SELECT user_id FROM events) UNION ALL SELECT 'customers', id FROM (SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events) UNION ALL SELECT 'all', id FROM (SELECT s_suppkey AS id FROM supplier UNION SELECT n_nationkey FROM nation)")
def set_ops(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    sides = catalogs.set_sides(c, e).filter("kind <> 'right'").select(F.when(F.col("kind") == "left", "customers").otherwise("both").alias("kind"), "id")
    every = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).union(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))).distinct()
    return sides.unionByName(every.select(F.lit("all").alias("kind"), "id"))


@query("SELECT p_brand AS folder, string_agg('[' || p_name || ']' || chr(10) || p_type, chr(10) || chr(10) ORDER BY p_name, p_partkey) AS block FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY p_brand")
def export_blocks(spark, sf_dir):
    from ..sources.export import text_blocks

    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part").join(used, "p_partkey", "left_semi")
    return text_blocks(parts, ["p_brand"], ["p_name", "p_partkey"], F.concat(F.lit("["), F.col("p_name"), F.lit("]\n"), F.col("p_type"))).withColumnRenamed("p_brand", "folder")


@query(
    r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\pL]+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) AS phrase FROM d),
 n AS (SELECT item_id, array_to_string(list_filter(string_split_regex(lower(text), '[^\pL]+'), lambda x: x <> '')[1:3], ' ') AS phrase FROM benchmark)
 SELECT doc_id AS chapter_id, item_id FROM n JOIN t USING (phrase)"""
)
def name_mentions(spark, sf_dir):
    """Documents that mention a passage's opening, its first three words, as a name: whole words, whatever their case."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 0)
    names = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(words, 1, 3), " ").alias("name"))
    return catalogs.mentions(chapters(spark, sf_dir), names, "chapter_id", "text", "item_id", "name")
