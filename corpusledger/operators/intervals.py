"""Intervals: merging, covered length, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str, end: str, touching: bool = True) -> DataFrame:
    """The rows that are not empty, with _island: the number (from 1, in order) of the union that holds them, per key."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = reach.isNull() | ((reach < F.col(start)) if touching else (reach <= F.col(start)))
    marked = df.filter(F.col(start) < F.col(end)).withColumn("_new", apart.cast("int"))
    # equal intervals count together
    return marked.withColumn("_island", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def merge(df: DataFrame, keys: list[str], start: str, end: str, touching: bool = True) -> DataFrame:
    """Unions of overlapping intervals per key; with ``touching`` also of those that share an end. Empty ones vanish; null bounds too."""
    marked = islands(df.select(*keys, start, end), keys, start, end, touching)
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def coverage(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of each key's intervals."""
    return merge(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], inner_span: tuple[str, str], outer_span: tuple[str, str], width: int | None = None) -> DataFrame:
    """Pairs whose inner interval lies within the outer one, per key.

    ``width`` cuts long axes: an outer interval is sent to every cell that it covers, an inner one to the cell of its start,
    so a key with many intervals is not one task's.
    """
    (a, b), (c, d) = inner_span, outer_span
    if width:
        inner = inner.withColumn("_cell", F.floor(F.col(a) / width))
        outer = outer.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(c) / width), F.floor(F.greatest(F.col(d) - 1, F.col(c)) / width))))
        keys = [*keys, "_cell"]
    return inner.join(outer, keys).filter((F.col(c) <= F.col(a)) & (F.col(b) <= F.col(d))).drop("_cell")
