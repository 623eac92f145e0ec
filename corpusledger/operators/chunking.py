"""Cutting texts into passages and packing passages into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .lineage import Batching, batched, numbered


def paragraph_chunks(df: DataFrame, text_col: str, most: int, separator: str = r"\n\s*\n", joint: str = "\n\n", overlap: int = 0) -> DataFrame:
    """Greedy chunks of whole paragraphs: chunk_no, chunk. A paragraph over the limit is a chunk of its own; a text without paragraphs is one chunk."""
    pieces = F.filter(F.transform(F.split(text_col, separator), lambda p: F.btrim(p, F.lit(" \n\r\t\f\v"))), lambda p: F.length(p) > 0)
    gap = len(joint)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("size"))

    def add(acc: Column, p: Column) -> Column:
        more = F.length(p) + F.when(F.size(acc["now"]) > 0, gap).otherwise(0)
        full = (F.size(acc["now"]) > 0) & (acc["size"] + more > most)
        tail = F.slice(acc["now"], F.greatest(F.lit(1), F.size(acc["now"]) - overlap + 1), F.lit(overlap)) if overlap else F.array().cast("array<string>")
        tail_size = F.aggregate(tail, F.lit(0), lambda s, x: s + F.length(x)) + F.greatest(F.lit(0), F.size(tail) - 1) * gap
        return F.when(full, F.struct(F.array_append(acc["done"], F.array_join(acc["now"], joint)).alias("done"), F.array_append(tail, p).alias("now"), (tail_size + more).alias("size"))).otherwise(
            F.struct(acc["done"].alias("done"), F.array_append(acc["now"], p).alias("now"), (acc["size"] + more).alias("size"))
        )

    packed = F.aggregate(pieces, empty, add, lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], F.array_join(acc["now"], joint))).otherwise(acc["done"]))
    chunks = F.when(F.size(packed) > 0, packed).otherwise(F.array(F.col(text_col)))
    return df.select(*[c for c in df.columns if c != text_col], F.posexplode(chunks).alias("chunk_no", "chunk"))


def fixed_passages(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """Windows of ``size`` characters with an overlap of min(500, size div 4): passage_no, start_char, passage. An empty text has none."""
    step, n = size - min(500, size // 4), F.length(text_col)
    last = F.when(n > size, F.ceil((n - size) / step)).otherwise(0).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = df.select("*", F.explode(numbers).alias("passage_no"))
    return rows.select(*[c for c in df.columns if c != text_col], "passage_no", (F.col("passage_no") * step).alias("start_char"), F.substring(F.col(text_col), F.col("passage_no") * step + 1, F.lit(size)).alias("passage"))


def segments(df: DataFrame, text_col: str) -> DataFrame:
    """Words with the white space around them: segment_no (from 1), segment; together they are the text."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"(?U)\s*\S+\s*"), F.lit(0))
    parts = F.when(F.size(words) > 0, words).otherwise(F.filter(F.array(F.col(text_col)), lambda t: F.length(t) > 0))
    return df.select(*[c for c in df.columns if c != text_col], F.posexplode(parts).alias("_p", "segment")).withColumn("segment_no", F.col("_p") + 1).drop("_p")


def spans_of_segments(ends: DataFrame, parts: DataFrame, keys: list[str], complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """(spans, violations) of rows that name the last segment of each span in order.

    Ends must rise and, if complete, the last be the last segment. ``ends``: keys, span_no, end; ``parts``: keys, segment_no, segment.
    """
    order = Window.partitionBy(*keys).orderBy("span_no")
    total = parts.groupBy(*keys).agg(F.max("segment_no").alias("_n"))
    rows = ends.withColumn("_from", F.coalesce(F.lag("end").over(order), F.lit(0))).withColumn("_last", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("span_no"))) == 1).join(total, keys)
    wrong = (F.col("end") <= F.col("_from")) | (F.col("end") > F.col("_n")) | ((F.col("_last") & (F.col("end") != F.col("_n"))) if complete else F.lit(False))
    bad = rows.filter(wrong).select(*keys, F.lit("span_order").alias("rule"), F.col("span_no").alias("detail"))
    good = rows.join(bad.select(*keys).distinct(), keys, "left_anti")
    # a segment belongs to the first span that ends at it or after it
    steps = parts.join(bad.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("segment_no").alias("_at"), F.lit(0).alias("_stop"), "segment")
    stops = good.select(*keys, F.col("end").alias("_at"), F.lit(1).alias("_stop"), "span_no")
    ahead = Window.partitionBy(*keys).orderBy("_at", "_stop").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = steps.unionByName(stops, allowMissingColumns=True).withColumn("span_no", F.first("span_no", ignorenulls=True).over(ahead))
    joined = placed.filter("_stop = 0 AND span_no IS NOT NULL").withColumnRenamed("_at", "segment_no")
    texts = joined.groupBy(*keys, "span_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_no", "segment"))), lambda s: s["segment"]), "").alias("span"))
    return texts, bad


def line_pieces(df: DataFrame, keys: list[str], text_col: str, size: int) -> DataFrame:
    """Non-blank lines, their line feed included; lines over ``size`` are cut after sentences: keys, piece_no, start_char, end_char."""
    lines = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    sentences = lambda l: F.when(F.length(l) > size, F.filter(F.split(l, r"(?U)(?<=[.!?]\s)(?!\s)"), lambda p: F.length(p) > 0)).otherwise(F.array(l))  # noqa: E731, E741
    rows = df.select(*keys, F.posexplode(F.flatten(F.transform(lines, sentences))).alias("_p", "_piece"))
    order = Window.partitionBy(*keys).orderBy("_p")
    ends = F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("end_char", ends).withColumn("start_char", F.col("end_char") - F.length("_piece")).filter(F.trim(F.regexp_replace("_piece", r"(?U)\s", "")) != "")
    return placed.select(*keys, F.row_number().over(order).alias("piece_no"), "start_char", "end_char")


def name_windows(texts: DataFrame, occurrences: DataFrame, keys: list[str], text_col: str, size: int) -> DataFrame:
    """Merged windows around name occurrences: keys, start_char, end_char.

    A window reaches one piece to each side of the piece of the occurrence, but at most size / 2 characters.
    """
    pieces, half = line_pieces(texts, keys, text_col, size), max(1, size // 2)
    order = Window.partitionBy(*keys).orderBy("piece_no")
    wide = pieces.withColumn("_from", F.coalesce(F.lag("start_char").over(order), F.col("start_char"))).withColumn("_to", F.coalesce(F.lead("end_char").over(order), F.col("end_char"))).withColumn("_before", F.coalesce(F.lag("end_char").over(order), F.lit(0)))
    o = occurrences.select(*keys, F.col("start_char").alias("_os"), F.col("end_char").alias("_oe"))
    cell = 4096
    o = o.withColumn("_cell", F.floor(F.col("_os") / cell))
    wide = wide.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_before") / cell), F.floor(F.col("end_char") / cell)))).drop("start_char")
    met = o.join(wide, [*keys, "_cell"]).filter((F.col("end_char") >= F.col("_os") + 1) & (F.col("_before") < F.col("_os") + 1))
    spans = met.select(*keys, F.greatest("_from", F.col("_os") - half).alias("start_char"), F.least("_to", F.col("_oe") + half).alias("end_char"))
    return intervals.merge(spans, keys, "start_char", "end_char", touching=True)


def pack(df: DataFrame, group: list[str], order: str, cost: Column, most: int, most_items: int | None = None, gap: int = 0, parts: int | None = None) -> DataFrame:
    """Greedy batches in order, per group: batch_no and status are added.

    A batch ends before the item that would take it over ``most`` (each further item costs ``gap`` more) or over
    ``most_items``. An item over the limit, or whose cost is null, is an error row and stands in no batch; nothing is cut. A large group lies in many ranges
    (``lineage.batched``).
    """
    known = F.coalesce(cost.cast("long"), F.lit(most + 1))
    rows = df.withColumn("cost_of_item", known + gap).withColumn("over_budget", known > most)
    out = batched(rows, group, [order], ["cost_of_item"], Batching([most + gap], most_items), "over_budget", parts)
    return out.withColumn("status", F.when(F.col("over_budget"), "over_budget").otherwise("packed")).drop("cost_of_item", "over_budget")


def fixed_batches(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("batch_no", F.floor((number - 1) / size).cast("int"))


def shared_contexts(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(contexts, references): overlapping spans of one source merged under an id, and each span's id and place within it.

    ``df``: keys, item, start_char, end_char. Spans that only touch stay apart.
    """
    rows = intervals.islands(df, keys, "start_char", "end_char", touching=False).withColumnRenamed("_island", "passage_id")
    contexts = rows.groupBy(*keys, "passage_id").agg(F.min("start_char").alias("context_start"), F.max("end_char").alias("context_end"))
    whole = Window.partitionBy(*keys, "passage_id")
    return contexts, rows.select(*keys, "item", "passage_id", (F.col("start_char") - F.min("start_char").over(whole)).alias("offset"))


def intern(df: DataFrame, value: str, order: list[str], least: int = 256) -> DataFrame:
    """Dictionary of values that repeat and are long: value_id by first use, value, uses. The order is unique; values are numbered by it alone."""
    long = df.filter(F.length(value) >= least)
    kept = long.groupBy(value).agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct(*order)).alias("_first")).filter("uses > 1")
    first = [f"_first.{c}" for c in order]
    places = numbered(kept.select(*[F.col(f).alias(f"_o{i}") for i, f in enumerate(first)]), [], [f"_o{i}" for i in range(len(order))])
    met = places.join(kept, [F.col(f) == F.col(f"_o{i}") for i, f in enumerate(first)])
    return met.select(F.col("number").alias("value_id"), value, "uses")


def top_costs(df: DataFrame, group: list[str], name: str, value: str, k: int = 5) -> DataFrame:
    """The k fields with most bytes per group."""
    sized = df.withColumn("n_bytes", F.octet_length(value).cast("long"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n_bytes"), name))
    return sized.withColumn("place", rank).filter(F.col("place") <= k).select(*group, name, "n_bytes", "place")


def halve(df: DataFrame, text_col: str, least: int = 500) -> DataFrame:
    """Both halves of texts that overflowed, with an overlap of min(250, length div 8); texts under ``least`` are error rows."""
    n = F.length(text_col)
    overlap, mid = F.least(F.lit(250), F.floor(n / 8).cast("int")), F.floor(n / 2).cast("int")
    parts = F.when(n < least, F.array(F.struct(F.lit(0).alias("part"), F.col(text_col).alias("piece"), F.lit("too_small").alias("status")))).otherwise(
        F.array(
            F.struct(F.lit(0).alias("part"), F.left(F.col(text_col), mid + overlap).alias("piece"), F.lit("split").alias("status")),
            F.struct(F.lit(1).alias("part"), F.substring(F.col(text_col), mid + 1, n).alias("piece"), F.lit("split").alias("status")),
        )
    )
    return df.select(*[c for c in df.columns if c != text_col], F.inline(parts))


def shrink_windows(df: DataFrame, size_col: str, least: int = 1000) -> DataFrame:
    """Window sizes for what was left unread: half as large, ``least`` at least; what had the least size already is an error row (status)."""
    size = F.col(size_col)
    return df.withColumn("status", F.when(size <= least, "too_small").otherwise("retry")).withColumn(size_col, F.greatest(F.lit(least), F.floor(size / 2).cast("int")))


def halve_groups(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Groups that overflowed in two halves, by order: part 0 has the smaller half of an odd number; a group of one stays whole (status)."""
    w = Window.partitionBy(*group)
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    return df.withColumn("part", F.when(k <= F.floor(n / 2), 0).otherwise(1)).withColumn("status", F.when(n == 1, "too_small").otherwise("split"))
