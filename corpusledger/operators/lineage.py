"""Cutting lineages, and numbering and folding rows without one task for all of them or for a large key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, checkpointed: in the folder of spark.checkpoint.dir or of the context, else in one in the warehouse.

    On a cluster the warehouse must not lie on a machine's own disk: then it is an error that no folder is named.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        warehouse = df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not context.master.startswith("local") and warehouse.partition(":")[0] in (warehouse, "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(f"{warehouse}/_checkpoints")
    return df.checkpoint()


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with number: their place (from 1) within their keys, by order; keys and order together are unique and not null.

    Rows are dealt by ranges of keys and order and numbered within a range; what earlier ranges hold of the keys is added, so
    a key with very many rows, or a numbering of the whole table (no keys), is not one task's. Carry light rows only.
    """
    # the range is stored with the row: dealt again, rows could fall into other ranges
    dealt = checkpointed(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each range and key in it
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return dealt.withColumn("_k", place).join(before, [*keys, "_range"]).withColumn("number", F.col("_k") + F.col("_before")).drop("_k", "_before", "_range")


#: Bits of the bitmap by which rows with a wanted value are told from others.
BITMAP_BITS = 26


def maybe_in(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose value is in wanted's only column, and few others; what travels is a bitmap of 2**BITMAP_BITS bits at most."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    at = wanted.select(spot(wanted.columns[0]).alias("_spot"))
    bits = at.groupBy(F.shiftright("_spot", 6).alias("_row")).agg(F.expr("bit_or(shiftleft(1L, cast(_spot & 63 as int)))").alias("_bits"))
    rows = df.withColumn("_spot", spot(column)).withColumn("_row", F.shiftright("_spot", 6))
    met = rows.join(F.broadcast(bits), "_row").filter(F.expr("(shiftright(_bits, cast(_spot & 63 as int)) & 1) = 1"))
    return met.select(*df.columns)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has: a small file of many rows is one split, and its bytes do not tell their work.

    With columns it also keeps light rows from being put together by their few bytes into tasks that sort and group very many of them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


RANGE = "_range"


def in_ranges(rows: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows dealt by ranges of group and order, sorted, checkpointed, with their RANGE (the number of their partition).

    A group may lie in several ranges that follow one another; of the groups of a range only the first can have begun in
    an earlier one. So what is known at the borders of ranges is a bounded number of rows for each range.
    """
    keys = [*group, *order]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return checkpointed(dealt.sortWithinPartitions(*keys).withColumn(RANGE, F.spark_partition_id()))


def keyed_rows(batches: Iterator[pd.DataFrame], group: list[str]):
    """(batch, keys of its rows, nulls as None) of sorted batches."""
    for pdf in batches:
        yield pdf, list(pdf[group].astype(object).where(pdf[group].notna(), None).itertuples(index=False, name=None))


class Batching:
    """Greedy batches of items with integer costs: a batch ends before the item that takes it over a bound (``most`` of each cost,
    ``most_items``). An item over a bound by itself is a batch of its own.

    A state is (number of the open batch, its costs, its items).
    """

    def __init__(self, most: list[int], most_items: int | None = None):
        self.most, self.most_items = tuple(most), most_items

    def start(self) -> tuple:
        return 0, (0,) * len(self.most), 0

    def step(self, state: tuple, costs: tuple) -> tuple:
        batch, sums, items = state
        over = any(s + c > m for s, c, m in zip(sums, costs, self.most, strict=True)) or (self.most_items and items >= self.most_items)
        if items and over:
            return batch + 1, costs, 1
        return batch, tuple(s + c for s, c in zip(sums, costs, strict=True)), items + 1

    def segment(self, costs: np.ndarray) -> dict:
        """What a run of items does to any state that enters it (``leave``), from cumulative sums and pointers to the next batch's start.

        ``at``: items at which the open batch may end; they lie in the run's own first batch and cost something, so they are no more than the
        bounds. For each its cumulative costs, and what is open at the run's end if it begins a batch: costs, items, batches begun.
        """
        n, dims = len(costs), len(self.most)
        sums = np.concatenate([np.zeros((1, dims), np.int64), np.cumsum(costs, axis=0)])
        after = np.arange(1, n + 1)
        for d, most in enumerate(self.most):
            reach = np.searchsorted(sums[1:, d], sums[:-1, d] + most, "right")
            after = reach if d == 0 else np.minimum(after, reach)
        if self.most_items:
            after = np.minimum(after, np.arange(n) + self.most_items)
        after = np.maximum(after, np.arange(1, n + 1)).tolist()
        last, begun = list(range(n)), [1] * n
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                last[i], begun[i] = last[after[i]], begun[after[i]] + 1
        first = [i for i in range(min(n, (after[0] if n else 0) + 1)) if self.most_items or costs[i].any()]
        ends = [(sums[n] - sums[last[i]]).tolist() for i in first]
        fresh = [begun[0] - 1, *(sums[n] - sums[last[0]]).tolist(), n - last[0]] if n else [0] * (dims + 2)
        return {"n": n, "total": sums[n].tolist(), "at": first, "upto": [sums[i + 1].tolist() for i in first], "ends": ends, "left": [n - last[i] for i in first], "begun": [begun[i] for i in first], "fresh": fresh}

    def leave(self, state: tuple, run: dict) -> tuple:
        """The state after a run of items."""
        batch, sums, items = state
        if not items:
            fresh = run["fresh"]
            return fresh[0], tuple(fresh[1:-1]), fresh[-1]
        for i, upto, end, left, begun in zip(run["at"], run["upto"], run["ends"], run["left"], run["begun"], strict=True):
            if any(s + u > m for s, u, m in zip(sums, upto, self.most, strict=True)) or (self.most_items and items + i >= self.most_items):
                return batch + begun, tuple(end), left
        return batch, tuple(s + t for s, t in zip(sums, run["total"], strict=True)), items + run["n"]


RUN = "n long, total array<long>, at array<int>, upto array<array<long>>, ends array<array<long>>, left array<long>, begun array<long>, fresh array<long>"


def batched(rows: DataFrame, group: list[str], order: list[str], costs: list[str], batching: Batching, skipped: str | None = None, parts: int | None = None) -> DataFrame:
    """Rows with batch_no (from 0) of the greedy batches of each group in order; null for rows whose ``skipped`` is true, which stand in no batch.

    Costs are integers, not null or negative. A group may lie in many ranges (``parts`` in all, or as many as Spark makes): each range tells what it does
    to an open batch that enters it, which batches enter follows from these in turn, and all ranges then number their rows at once.
    """
    dealt = in_ranges(rows, group, order, parts)
    columns = [*costs, *([skipped] if skipped else [])]

    def taken(pdf: pd.DataFrame) -> np.ndarray:
        return ~pdf[skipped].to_numpy(bool) if skipped else np.ones(len(pdf), bool)

    def summary(batches):
        number, runs = None, []  # of the range's groups the first and the last: [is_first, keys, costs]
        for pdf, keys in keyed_rows(batches, group):
            if not len(pdf):
                continue
            number, values, kept = int(pdf[RANGE].iloc[0]), pdf[costs].to_numpy(np.int64), taken(pdf)
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(starts, starts[1:], strict=False):
                part = values[a:b][kept[a:b]]
                if runs and runs[-1][1] == keys[a]:
                    runs[-1][2].append(part)
                elif len(runs) > 1:
                    runs[1] = [False, keys[a], [part]]
                else:
                    runs.append([not runs, keys[a], [part]])
        if runs:
            found = [batching.segment(np.concatenate(parts)) for _, _, parts in runs]
            yield pd.DataFrame([(number, first, *[r[n] for n in found[0]]) for (first, _, _), r in zip(runs, found, strict=True)], columns=[RANGE, "is_first", *found[0]]).assign(**{f"_g{i}": pd.Series([k[i] for _, k, _ in runs], dtype=object) for i in range(len(group))})[[RANGE, "is_first", *[f"_g{i}" for i in range(len(group))], *found[0]]]

    kinds = ", ".join(f"_g{i} {dealt.schema[g].dataType.simpleString()}" for i, g in enumerate(group))
    known = dealt.select(RANGE, *group, *columns).mapInPandas(summary, f"{RANGE} int, is_first boolean, {kinds}, {RUN}")
    states: dict[int, tuple] = {}
    state, current = batching.start(), None
    for r in known.orderBy(RANGE, F.desc("is_first")).collect():  # two rows for each range at most
        key = tuple(r[f"_g{i}"] for i in range(len(group)))
        if not r["is_first"] or key != current:
            state = batching.start()
        else:
            states[r[RANGE]] = state
        state, current = batching.leave(state, r.asDict()), key

    def number(batches):
        of, state, begun = None, None, False
        for pdf, keys in keyed_rows(batches, group):
            if not begun and len(pdf):
                state = states.get(int(pdf[RANGE].iloc[0]), batching.start())
            out = []
            for key, row, kept in zip(keys, pdf[costs].itertuples(index=False, name=None), taken(pdf).tolist(), strict=True):
                if begun and key != of:
                    state = batching.start()
                begun, of = True, key
                if kept:
                    state = batching.step(state, row)
                out.append(state[0] if kept else None)
            yield pdf.drop(columns=RANGE).assign(batch_no=pd.Series(out, dtype=object, index=pdf.index))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["batch_no int"])
    return dealt.mapInPandas(number, schema)


def folded(rows: DataFrame, group: list[str], order: list[str], start, step, added: dict[str, str]) -> DataFrame:
    """Rows with columns of a fold over each group in order: ``step(state, row) -> (state, values)`` from ``start()``.

    For any step; where what a range does to a state can be told beforehand, ``in_ranges`` makes a large group many tasks'. Sorted
    partitions stream through, so a group is never gathered; its rows are one task's, as each depends on those before it.
    ``added``: column to type. Rows are named tuples.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"`{n}` {t}" for n, t in added.items()])

    def run(batches):
        of, state = None, None
        for pdf in batches:
            out = []
            keys = pdf[group].astype(object).where(pdf[group].notna(), None).itertuples(index=False, name=None)
            for key, row in zip(keys, pdf.itertuples(index=False), strict=True):
                if state is None or key != of:
                    of, state = key, start()
                state, values = step(state, row)
                out.append(values)
            yield pdf.assign(**{n: pd.Series([v[i] for v in out], dtype=object, index=pdf.index) for i, n in enumerate(added)})

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)
