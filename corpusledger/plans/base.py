"""Registration of queries and their SQL, and the domain tables that queries derive from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import spread  # noqa: F401 - for the modules of queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_id"), "text", "source", "lang")


def typographic(c):
    """A text with the typography that normalization undoes, put in by rule."""
    return F.concat(F.lit("\u00ab"), F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("\r\n")), F.lit("the "), F.lit("the\u00a0")), F.lit(". "), F.lit(".\u2029")), F.lit("\u2019\u00bb"))


TYPOGRAPHIC_SQL = "'«' || replace(replace(replace(text, chr(10), chr(13) || chr(10)), 'the ', 'the' || chr(160)), '. ', '.' || chr(8233)) || '’»'"
NORMAL_SQL = "nfc_normalize(replace(translate(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '‘’“”«»' || chr(160) || chr(8239) || chr(8232), '''''\"\"\"\"  ' || chr(10)), chr(8233), chr(10) || chr(10)))"


def sequences(spark, sf_dir):
    """One row per line of a document: chapter_id, sequence (from 1), source."""
    return chapters(spark, sf_dir).select("chapter_id", F.posexplode(F.split("text", "\n")).alias("_p", "source")).select("chapter_id", (F.col("_p") + 1).alias("sequence"), "source")


SEQUENCES_SQL = "seqs AS (SELECT doc_id AS chapter_id, unnest(range(1, len(l) + 1)) AS sequence, unnest(l) AS source FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def observations(spark, sf_dir):
    """Reference observations from events: an entity (user) in a chapter (day) at a sequence, with a trait."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    order = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    presence = F.element_at(F.array(F.lit("visible"), F.lit("offscreen"), F.lit("mentioned")), (F.col("event_id") % 3 + 1).cast("int"))
    scope = F.when(F.col("event_id") % 2 == 0, "intrinsic").otherwise("scene")
    return e.select("event_id", F.col("user_id").alias("entity"), day.alias("chapter"), F.ceil(F.row_number().over(order) / 2).cast("int").alias("sequence"), F.row_number().over(order).alias("ord"), F.col("event_type").alias("attribute"), F.floor(F.col("value") / 100).cast("int").alias("description"), presence.alias("presence"), scope.alias("scope"))


OBSERVATIONS_SQL = """obs AS (SELECT event_id, user_id AS entity, strftime(ts, '%Y-%m-%d') AS chapter,
 CAST(ceil(row_number() OVER w / 2.0) AS INTEGER) AS sequence, row_number() OVER w AS ord, event_type AS attribute,
 CAST(floor(value / 100) AS INTEGER) AS description, ['visible', 'offscreen', 'mentioned'][event_id % 3 + 1] AS presence,
 CASE WHEN event_id % 2 = 0 THEN 'intrinsic' ELSE 'scene' END AS scope
 FROM events WINDOW w AS (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id))"""


def entities(spark, sf_dir):
    """Named entities from parts: type by brand, importance and priority by size."""
    importance = F.when(F.col("p_size") > 35, "major").when(F.col("p_size") > 15, "recurring").otherwise("minor")
    priority = F.when(F.col("p_partkey") % 3 == 0, "required").when(F.col("p_partkey") % 3 == 1, "recommended").otherwise("optional")
    kind = F.element_at(F.array(F.lit("character"), F.lit("location"), F.lit("object")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.col("p_brand").alias("brand"), kind.alias("kind"), importance.alias("importance"), priority.alias("priority"), "p_size", "p_type")


ENTITIES_SQL = """ents AS (SELECT p_partkey AS entity_id, p_name AS canonical_name, p_brand AS brand, ['character', 'location', 'object'][p_partkey % 3 + 1] AS kind,
 CASE WHEN p_size > 35 THEN 'major' WHEN p_size > 15 THEN 'recurring' ELSE 'minor' END AS importance,
 CASE p_partkey % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'recommended' ELSE 'optional' END AS priority, p_size, p_type FROM part)"""
