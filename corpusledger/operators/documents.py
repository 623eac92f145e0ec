"""Documents against a schema of nested objects, lists and values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a variant's own type begins for each type of a schema.
SHAPES = {"object": ["OBJECT"], "array": ["ARRAY"], "string": ["STRING"], "boolean": ["BOOLEAN"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "null": ["VOID"]}


def document_violations(rows: DataFrame, key: str, variant_col: str, schema: dict) -> DataFrame:
    """Every place where a variant breaks a schema: key, path ('$' is the document), rule, detail.

    A schema is a dict with ``type`` (of SHAPES, or a list of them), and, by type, ``properties``, ``required`` (all properties if not
    given) and ``additional`` (false if not given), ``items`` and ``min_items``, ``enum``. A boolean is not a number. A null document is
    'wrong_type'. Each level is one explosion of the values above it, so lists of any length are rows, not arrays.
    """
    start = rows.select(F.col(key), F.lit("$").alias("path"), F.coalesce(F.col(variant_col), F.parse_json(F.lit("null"))).alias("value"))
    out = _level(start, key, schema)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def first_violations(violations: DataFrame, key: str) -> DataFrame:
    """Of each document the first broken place in the order of paths."""
    return violations.groupBy(key).agg(F.min(F.struct("path", "rule", "detail")).alias("_f")).select(key, "_f.*")


def _level(nodes: DataFrame, key: str, schema: dict) -> list[DataFrame]:
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    shape = F.schema_of_variant("value")
    fits = F.lit(False)
    for kind in kinds:
        for begin in SHAPES[kind]:
            fits = fits | F.startswith(shape, F.lit(begin))
    row = lambda df, rule, detail, path="path": df.select(key, F.col(path).alias("path"), F.lit(rule).alias("rule"), detail.alias("detail"))
    out = [row(nodes.filter(~fits), "wrong_type", F.concat(F.lit(",".join(kinds) + " expected, not "), shape))]
    good = nodes.filter(fits)
    if "enum" in schema:
        text = F.try_variant_get("value", "$", "string")
        out.append(row(good.filter(~F.coalesce(text.isin(schema["enum"]), F.lit(False))), "not_in_enum", F.coalesce(text, F.lit(""))))
    if "object" in kinds:
        known, needed = schema.get("properties", {}), schema.get("required", list(schema.get("properties", {})))
        objects = good.filter(F.startswith(shape, F.lit("OBJECT")))
        for name in needed:
            out.append(row(objects.filter(F.try_variant_get("value", f"$.{name}", "variant").isNull()), "missing_field", F.lit(name)))
        fields = _exploded(objects, key).select(key, F.concat("path", F.lit("."), "key").alias("path"), F.col("key").alias("_name"), F.col("_item").alias("value"))
        if not schema.get("additional", False):
            out.append(row(fields.filter(~F.col("_name").isin(list(known))), "unknown_field", F.col("_name")))
        for name, part in known.items():
            out += _level(fields.filter(F.col("_name") == name).select(key, "path", "value"), key, part)
    if "array" in kinds and ("items" in schema or "min_items" in schema):
        lists = good.filter(F.startswith(shape, F.lit("ARRAY")))
        if schema.get("min_items"):
            out.append(row(lists.filter(F.try_variant_get("value", f"$[{schema['min_items'] - 1}]", "variant").isNull()), "too_few_items", F.lit(str(schema["min_items"]))))
        if "items" in schema:
            items = _exploded(lists, key).select(key, F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("path"), F.col("_item").alias("value"))
            out += _level(items, key, schema["items"])
    return out


def _exploded(nodes: DataFrame, key: str) -> DataFrame:
    """key, path, pos, key, _item: one row for each field or item of the values."""
    parts = nodes.sparkSession.tvf.variant_explode(F.col("value").outer()).withColumnRenamed("value", "_item")
    met = nodes.lateralJoin(parts)
    return met
