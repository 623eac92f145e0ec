"""Queries of text functions, sections of documents, review issues, and what later stages get."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogs, decisions, identity, reviews
from ..sources import export
from .base import SEQUENCES_SQL, query, sequences, table


@query("SELECT p_partkey AS part, trim(regexp_replace(lower(p_name || ' (' || p_type || '): ' || p_size), '[^\\pL\\pN_]+', '_', 'g'), '_') AS attribute FROM part")
def attribute_keys(spark, sf_dir):
    label = F.concat("p_name", F.lit(" ("), "p_type", F.lit("): "), "p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), T.attribute_key(label).alias("attribute"))


@query(
    """WITH v AS (SELECT p_partkey AS part, list_filter(list_transform(string_split(p_name || ' ' || p_type || ' ' || p_name, ' '), lambda x: left(trim(x), 5)), lambda x: x <> '') AS l FROM part)
 SELECT part, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[:4], '|') AS compact FROM v"""
)
def compact_values(spark, sf_dir):
    """Words of a part's name and type, the name's twice: five characters of each, four at most."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.array_join(T.compact_strings(words, 5, 4), "|").alias("compact"))


STAMP_SQL = "CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE (event_id % 90) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END"


@query(f"SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN (event_id % 90) * CAST(60 AS DOUBLE) + CAST(split_part({STAMP_SQL}, ':', 2) AS DOUBLE) END AS seconds FROM events")
def stamp_seconds(spark, sf_dir):
    """Time stamps of events, every eleventh not one."""
    pad = lambda n, width: F.lpad((F.col("event_id") % n).cast("string"), width, "0")
    stamp = F.when(F.col("event_id") % 11 == 0, "soon").otherwise(F.concat((F.col("event_id") % 90).cast("string"), F.lit(":"), pad(60, 2), F.lit("."), pad(1000, 3)))
    return table(spark, sf_dir, "events").select("event_id", T.timestamp_seconds(stamp).alias("seconds"))


@query("SELECT p_partkey AS part, lower(replace('C:/Books/' || p_type || '/' || upper(p_name) || '.TXT', '/', chr(92))) AS path FROM part")
def path_keys(spark, sf_dir):
    path = F.concat(F.lit("C:/Books/"), "p_type", F.lit("/"), F.upper("p_name"), F.lit(".TXT"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), T.path_key(path).alias("path"))


def part_documents(spark, sf_dir):
    """A document of every part; every third has no size."""
    size = F.when(F.col("p_partkey") % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"value": "s'), F.col("p_size"), F.lit('"}')))
    document = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "tags": ["'), "p_type", F.lit('", "'), "p_brand", F.lit('"], "size": '), size, F.lit("}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), document.alias("document"))


@query("SELECT p_partkey AS part, p_name AS name, p_brand AS second_tag, CASE WHEN p_partkey % 3 <> 0 THEN 's' || p_size END AS size, CAST(NULL AS VARCHAR) AS ghost FROM part")
def pointer_values(spark, sf_dir):
    rows = part_documents(spark, sf_dir).withColumn("_v", F.parse_json("document"))
    value = lambda p: T.pointer_value(F.col("_v"), p)
    return rows.select("part", value("/name").alias("name"), value("/tags/1").alias("second_tag"), value("/size/value").alias("size"), value("/tags/7/x").alias("ghost"))


@query("SELECT p_partkey AS part, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_name END AS name FROM part")
def reply_values(spark, sf_dir):
    """Replies with thinking and a fence, with words around the document, bare ones, and replies without any."""
    thought = F.concat(F.lit('<think>maybe {"name": "x"}</think>\n```json\n'), "document", F.lit("\n```"))
    reply = F.when(F.col("part") % 4 == 0, thought).when(F.col("part") % 4 == 1, F.concat(F.lit("Here it is: "), "document", F.lit(" as asked."))).when(F.col("part") % 4 == 2, F.col("document")).otherwise("no document")
    rows = part_documents(spark, sf_dir).withColumn("_v", T.reply_json(reply))
    return rows.select("part", T.pointer_value(F.col("_v"), "/name").alias("name"))


@query(f"WITH {SEQUENCES_SQL} SELECT chapter_id, sequence, length(source) AS n_chars FROM seqs")
def scene_structs(spark, sf_dir):
    """Scenes as structs without the source that the receiver has, and back."""
    rows = sequences(spark, sf_dir).withColumn("n_chars", F.length("source").cast("long")).withColumn("_request", F.lit("r"))
    packed = catalogs.as_struct(catalogs.without_context(rows), ["chapter_id", "sequence"], "scene", ["source"])
    return catalogs.from_struct(packed, ["chapter_id", "sequence"], "scene")


ISSUE_PATHS = ["/name", "/tags/1", "/size/value", "/ghost"]


@query(
    """WITH i AS (SELECT p_partkey AS issue_id, ['/name', '/tags/1', '/size/value', '/ghost'][p_partkey % 4 + 1] AS path, p_partkey FROM part)
 SELECT CASE WHEN path = '/ghost' THEN 'path_not_offered' ELSE 'path_not_found' END AS rule, CAST(issue_id AS VARCHAR) AS key, path AS detail FROM i WHERE path = '/ghost' OR (path = '/size/value' AND p_partkey % 3 = 0)"""
)
def review_paths(spark, sf_dir):
    """Issues cite a path of the part's document in turn; one path is not offered."""
    rows = part_documents(spark, sf_dir)
    issues = rows.select(F.col("part").alias("issue_id"), F.element_at(F.array(*map(F.lit, ISSUE_PATHS)), (F.col("part") % 4 + 1).cast("int")).alias("path"), F.lit("d").alias("description"), F.parse_json("document").alias("payload"))
    return reviews.review_violations(issues, "payload", ISSUE_PATHS[:3])[1]


@query(
    """SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS sequences,
 CASE WHEN conv_id % 5 <> 0 THEN '{"issues":[{"code":"c' || (conv_id % 3) || '","proposals":[{"ord":1},{"ord":2}]}]}' END AS narrative_review FROM conversations GROUP BY conv_id"""
)
def downstream_chapters(spark, sf_dir):
    """Turns with reviews; every fifth conversation has no review of its own."""
    turn = F.struct("turn", "role", F.struct(F.lit(3).alias("attempts")).alias("review"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("sequences"))
    proposals = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit("r").alias("review")) for k in (1, 2)])
    issue = F.struct(F.concat(F.lit("c"), F.col("conv_id") % 3).alias("code"), F.lit("x").alias("review"), proposals.alias("proposals"))
    reviewed = turns.withColumn("narrative_review", F.when(F.col("conv_id") % 5 != 0, F.struct(F.array(issue).alias("issues"), F.lit(7).alias("attempts"))))
    out = export.downstream_chapters(reviewed)
    return out.select("conv_id", F.to_json("sequences").alias("sequences"), F.to_json("narrative_review").alias("narrative_review"))


@query("SELECT event_id AS id, CASE WHEN user_id % 13 = 0 THEN 'none' ELSE event_type || (user_id % 13) END AS result, CASE WHEN user_id % 13 = 0 THEN 'default' ELSE 'decided' END AS status FROM events")
def halved_batches(spark, sf_dir):
    """A batch with an event of a user divisible by thirteen is not answered, so open rows are asked in halves until each such row is alone."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", (F.col("user_id") % 13).cast("int").alias("rest"))

    def answer(batch):
        answered = batch.slice(0, 0) if pc.min(batch["rest"]).as_py() == 0 else batch
        result = pc.binary_join_element_wise(answered["event_type"], answered["rest"].cast("string"), "")
        return pa.RecordBatch.from_arrays([answered["id"], result], ["id", "result"])

    out = decisions.decide_with_retries(rows, "id", answer, "id long, result string", F.lit(True), 5, F.lit("none"), None, batch_rows=16, arrow=True)
    return out.select("id", "result", "status")


NAMED_SQL = "SELECT p_partkey AS part, list_transform(string_split(p_name || ' ' || p_type, ' ')[1:3], lambda w: upper(left(w, 1)) || lower(substring(w, 2))) AS w FROM part"


@query(
    f"""WITH n AS ({NAMED_SQL}), k AS (SELECT part, w[1] AS a, w[2] AS b, w[3] AS c, w[1] || ' ' || w[2] AS ab FROM n),
 e AS (SELECT part, a AS x, b AS y FROM k WHERE part % 4 = 0 UNION ALL SELECT part, a, ab FROM k WHERE part % 4 = 0 UNION ALL SELECT part, b, ab FROM k WHERE part % 4 = 0
  UNION ALL SELECT part, c, ab FROM k WHERE part % 4 = 0 AND c IN (a, b)
  UNION ALL SELECT part, a, c FROM k WHERE part % 4 IN (1, 2))
 SELECT DISTINCT part, least(x, y) AS x, greatest(x, y) AS y FROM e WHERE x <> y"""
)
def alias_links(spark, sf_dir):
    """Three words of a part as names, and the first two as a full name; contexts show the full name, an alias, a naming, or nothing."""
    word = lambda i: F.initcap(F.element_at(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), i))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), word(1).alias("a"), word(2).alias("b"), word(3).alias("c"))
    full, kind = F.concat_ws(" ", "a", "b"), F.col("part") % 4
    names = rows.select("part", F.explode(F.array("a", "b", "c", full)).alias("name"))
    context = (
        F.when(kind == 0, F.concat(F.lit("then "), full, F.lit(" came.")))
        .when(kind == 1, F.concat(F.lit("there "), "a", F.lit(", also known as "), "c", F.lit(", came.")))
        .when(kind == 2, F.concat("c", F.lit(" était surnommé « "), "a", F.lit(" »")))
        .otherwise(F.concat("a", F.lit(" and "), "b", F.lit(" met "), "c"))
    )
    return identity.alias_edges(names, rows.select("part", context.alias("context")), ["part"])
