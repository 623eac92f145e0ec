"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within their source. A source takes whole passes over its documents as long as
its budget lasts; the rest is fitted by the length counts: an even share of every length, then a bounded knapsack over
what the shares leave. Documents of a length are picked in seeded order.

A source has at most sqrt(2 * words) different lengths, so the group in which a budget is fitted grows with the square
root of its words. Sources are few by nature (one row each); their targets are found in one window over them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, words_expr

#: Weights of the sources in code-point order, repeating; the share of all words to mix; the most uses of a document.
WEIGHTS, SHARE, MOST_USES = (3, 1, 2), 1.5, 2
SEED = 20_240_229
#: Rows of one length that are ranked together; a length with more is ranked in buckets by the seeded lot.
RANKED = 500


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """_id, _source, size (number of words; null text: 0)."""
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words_expr(F.col(text_col)).alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_USES) -> DataFrame:
    """One row per source: _source, source_size, target.

    Sources weigh in by code point, null last. A target stops at ``most`` times its source's size and the excess goes
    to the others by weight, until none is above: the fixed point is min(cap, level * weight), and the level follows
    from the sources in order of cap / weight. Sources without words get 0.
    """
    every = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = every.withColumn("_w", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    rows = rows.withColumn("_cap", F.col("source_size") * float(most))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole) * share
    rows = rows.withColumn("_level", (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(left))
    # the first source in that order whose cap its level does not pass sets the level of all after it
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    rows = rows.withColumn("_final", F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.col("_cap") / F.col("_w"))).over(whole))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap")))
    return rows.select("_source", "source_size", target.alias("target"))


def reach(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: how many of each length make a sum as near below ``budget`` as can be.

    Sums are bits of one integer; a count is split into powers of two. The search ends when the budget itself is
    reached, else the largest sum is taken.
    """
    mask, sums, items = (1 << (budget + 1)) - 1, 1, []
    for k in np.argsort(lengths, kind="stable"):
        left = min(int(counts[k]), budget // int(lengths[k])) if lengths[k] else 0
        many = 1
        while left > 0:
            many = min(many, left)
            items.append((int(k), many, sums))
            sums |= (sums << (many * int(lengths[k]))) & mask
            left, many = left - many, many * 2
        if sums >> budget & 1:
            break
    at, out = sums.bit_length() - 1, np.zeros(len(lengths), dtype=np.int64)
    for k, many, earlier in reversed(items):
        if not earlier >> at & 1:
            at -= many * int(lengths[k])
            out[k] += many
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length together hold ``budget`` words, or as near below as the lengths allow.

    The even share of every length comes first, then the longest that still fit; the knapsack gets what remains
    and the last few documents given back, so its budget is some multiples of the longest length at most.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total if total else 0 for c in counts], dtype=np.int64)
    left = budget - int((taken * lengths).sum())
    for k in np.argsort(-lengths, kind="stable"):
        if lengths[k]:
            more = min(int(counts[k] - taken[k]), left // int(lengths[k]))
            taken[k] += more
            left -= more * int(lengths[k])
    for k in np.argsort(lengths, kind="stable"):  # room to move in: give back some short documents
        if left and lengths[k] and taken[k] and left < 2 * int(lengths.max()):
            back = min(int(taken[k]), 1 + int(lengths.max()) // int(lengths[k]))
            taken[k] -= back
            left += back * int(lengths[k])
    return taken + reach(lengths, counts - taken, left) if left else taken


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    lengths, counts = rows["size"].to_numpy(np.int64), rows["_n"].to_numpy(np.int64)
    size, goal = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = int(goal // size) if size else 0
    picked = fit(lengths, counts, int(round(goal - passes * size)))
    return pd.DataFrame({"_source": rows["_source"], "size": lengths, "_n": counts, "_passes": passes, "_picked": picked, "source_size": size, "target": goal})


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words that the mix takes, repeats counted).

    Null texts have size 0 and are never taken; a null source is a source of its own. Rows that repeat an id tie and
    fall in an order that Spark repeats for the same rows; all else depends on ids and the seed only. An empty table gives
    an empty result; other columns are ignored.
    """
    sizes = settled(sized(docs, id_col, text_col, source_col), "sizes")
    goal = targets(sizes, weights, share)
    counts = sizes.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("_n"))
    wanted = counts.join(goal, counts["_source"].eqNullSafe(goal["_source"])).select(counts["_source"], "size", "_n", "source_size", "target")
    source_type = sizes.schema["_source"].dataType.simpleString()
    plan = settled(wanted.groupBy("_source").applyInPandas(_fit_source, f"_source {source_type}, size long, _n long, _passes long, _picked long, source_size long, target double"), "mix-plan")
    lot = F.xxhash64(F.lit(seed), F.col("_id"))
    p = plan.withColumnsRenamed({"_source": "_p_source", "size": "_p_size"})
    rows = sizes.join(p, sizes["_source"].eqNullSafe(p["_p_source"]) & (sizes["size"] == p["_p_size"])).drop("_p_source", "_p_size")
    # a length that is picked in part is ranked by lot, in buckets small enough for a task
    part = (F.col("_picked") > 0) & (F.col("_picked") < F.col("_n")) & (F.col("size") > 0)
    whole = rows.filter(~part).withColumn("_on", (F.col("_picked") > 0).cast("long"))
    drawn = rows.filter(part).withColumn("_lot", lot).withColumn("_bucket", F.pmod(F.shiftright("_lot", 8), F.ceil(F.col("_n") / RANKED)))
    ranks = Window.partitionBy("_source", "size", "_bucket").orderBy("_lot", "_id")
    ranked = drawn.withColumn("_rank", F.row_number().over(ranks))
    filled = drawn.groupBy("_source", "size", "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    upto = Window.partitionBy("_source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("_before", F.coalesce(F.sum("_in").over(upto), F.lit(0))).withColumnsRenamed({"_source": "_f_source", "size": "_f_size", "_bucket": "_f_bucket"})
    met = ranked["_source"].eqNullSafe(filled["_f_source"]) & (ranked["size"] == filled["_f_size"]) & (ranked["_bucket"] == filled["_f_bucket"])
    drawn = ranked.join(filled, met).withColumn("_on", (F.col("_rank") + F.col("_before") <= F.col("_picked")).cast("long"))
    columns = ["_id", "_source", "size", "source_size", "target", "_passes", "_on"]
    out = whole.select(columns).unionByName(drawn.select(columns))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", ((F.col("_passes") + F.col("_on")) * F.col("size")).alias("taken"))


def repeat_taken(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, with its own columns.

    Rows that repeat an id are each taken as often as the most taken of them.
    """
    taken = mix(docs, id_col=id_col, **options).filter("taken > 0")
    uses = taken.groupBy(F.col(id_col).alias("_mixed")).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("_uses"))
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_given"))
    joined = rows.join(uses, rows["_id"].eqNullSafe(uses["_mixed"]))
    return joined.select("_given", F.explode(F.sequence(F.lit(1), F.col("_uses")))).select("_given.*")
