"""Batched decision jobs: requests, reuse, the user's function, validation, bounded retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

from ..functions.text import digest_id


def fingerprints(requests: DataFrame, components: list[str], version: str) -> DataFrame:
    """Requests with the digest of each component and of all together."""
    parts = [F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")), 256) for c in components]
    return requests.withColumn("component_digests", F.map_from_arrays(F.array(*map(F.lit, components)), F.array(*parts))).withColumn("fingerprint", digest_id("", 64, F.lit(version), *parts))


def changed_components(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Why a request was not reused: key, component. Both have component_digests."""
    joined = now.select(key, F.col("component_digests").alias("_a")).join(before.select(key, F.col("component_digests").alias("_b")), key)
    return joined.select(key, F.explode("_a").alias("component", "_x"), "_b").filter(~F.try_element_at("_b", F.col("component")).eqNullSafe(F.col("_x"))).select(key, "component")


def reuse(requests: DataFrame, sources: list[DataFrame], valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(decided, open): a request takes the first valid decision of its fingerprint, in the order of the sources."""
    every = None
    for rank, source in enumerate(sources):
        rows = source.select("fingerprint", "result", F.lit(rank).alias("_rank"))
        every = rows if every is None else every.unionByName(rows)
    if valid is not None:
        every = every.filter(valid)
    best = every.groupBy("fingerprint").agg(F.min_by(F.struct("result", "_rank"), F.struct("_rank", "result")).alias("_d"))
    decided = requests.join(best, "fingerprint").select(*requests.columns, F.col("_d.result").alias("result"), F.col("_d._rank").alias("source_rank"))
    return decided, requests.join(best, "fingerprint", "left_anti")


#: Answers that leave a task together: handing on a batch of a row costs more than most answers do.
TOGETHER = 1_000
#: How batches are cut and joined.
PANDAS = (lambda b, at, rows: b.iloc[at : at + rows], lambda parts: pd.concat(parts, ignore_index=True))
ARROW = (lambda b, at, rows: b.slice(at, rows), pa.concat_batches)


def in_batches(function: Callable, rows: int, kind: tuple = PANDAS):
    """The function over batches of exactly so many rows (the last of a task may be smaller), however rows arrive; its answers leave in larger ones."""
    cut, joined = kind

    def answers(batches: Iterator) -> Iterator:
        held = None
        for batch in batches:
            held, at = batch if held is None else joined([held, batch]), 0
            while len(held) - at >= rows:
                yield function(cut(held, at, rows))
                at += rows
            held = cut(held, at, rows)
        if held is not None and len(held):
            yield function(held)

    def run(batches: Iterator) -> Iterator:
        waiting, many = [], 0
        for answer in answers(batches):
            if len(answer):
                waiting.append(answer)
                many += len(answer)
            if many >= TOGETHER:
                yield joined(waiting)
                waiting, many = [], 0
        if waiting:
            yield joined(waiting)

    return run


def decide(requests: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, partitions: int, batch_rows: int | None = None) -> DataFrame:
    """Run the user's function over batches of request rows; the rows are dealt evenly first, as calls are slow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch_rows or max(1, len(pdf))):
                yield function(pdf.iloc[at : at + (batch_rows or len(pdf))])

    return requests.repartition(partitions).mapInPandas(run, schema)


def decide_with_retries(requests: DataFrame, key: str, function, schema: str, valid: Column, attempts: int, default: Column, partitions: int | None, batch_rows: int | None = None, arrow: bool = False) -> DataFrame:
    """key, result, attempt, status: rows without exactly one valid answer are asked again, up to ``attempts`` times; then the default.

    With ``batch_rows`` the function gets batches of so many rows, and those still open half as many at each further attempt, one at
    least, so that a row that spoils its batch is met in ever smaller ones. Batches follow the key's order. ``partitions``: tasks that ask,
    as many as a shuffle has if None. With ``arrow`` (for batches of few rows) the function takes and gives Arrow record batches in place of pandas frames.
    """
    if arrow and batch_rows is None:
        raise ValueError("Arrow batches need batch_rows")
    partitions = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, done = requests, None
    for attempt in range(1, attempts + 1):
        asked = left.withColumn("attempt", F.lit(attempt))
        if batch_rows is None:
            answers = checkpointed(decide(asked, function, schema, partitions))
        else:
            rows = max(1, batch_rows >> (attempt - 1))
            dealt = asked.repartitionByRange(partitions, key).sortWithinPartitions(key)
            answers = checkpointed(dealt.mapInArrow(in_batches(function, rows, ARROW), schema) if arrow else dealt.mapInPandas(in_batches(function, rows), schema))
        once = answers.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("result").alias("result")).filter("_n = 1").drop("_n").filter(valid)
        good = checkpointed(once.join(left.select(key), key, "left_semi").select(key, "result", F.lit(attempt).alias("attempt"), F.lit("decided").alias("status")))
        done = good if done is None else done.unionByName(good)
        left = checkpointed(left.join(good, key, "left_anti"))
        if left.isEmpty():
            return done
    return done.unionByName(left.select(key, default.alias("result"), F.lit(attempts).alias("attempt"), F.lit("default").alias("status")))


def approval(batches: DataFrame, keys: list[str]) -> DataFrame:
    """A group is approved only if every batch was completed and none found an issue."""
    return batches.groupBy(*keys).agg((F.bool_and(F.col("status") == "completed") & (F.sum("issues") == 0)).alias("approved"))


def strictly_fewer(before: Column, after: Column) -> Column:
    """Whether an array's values are a strict part of another's before."""
    return (F.size(F.array_except(after, before)) == 0) & (F.size(F.array_distinct(after)) < F.size(F.array_distinct(before)))


def non_regression(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Candidates whose broken rules are a strict part of those before: key, accepted. Both: key, rules (array)."""
    joined = before.select(key, F.col("rules").alias("_b")).join(after.select(key, F.col("rules").alias("_a")), key)
    return joined.select(key, strictly_fewer(F.col("_b"), F.col("_a")).alias("accepted"))


def stage_metrics(requests: DataFrame) -> DataFrame:
    """Calls, hits, misses, bytes and seconds per stage. ``requests``: stage, cached, n_bytes, seconds."""
    return requests.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"), F.sum("n_bytes").alias("n_bytes"), F.sum("seconds").alias("seconds"))


def event_tail(events: DataFrame, keys: list[str], order: str, most: int = 100) -> DataFrame:
    """The last events of each group with the number that was left out."""
    w = Window.partitionBy(*keys)
    rows = events.withColumn("_r", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("dropped", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - most))
    return rows.filter(F.col("_r") <= most).drop("_r")


def attempt_recovery(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Per scene the number of failed attempts and whether a later one succeeded: keys, failed, recovered."""
    good = F.max(F.when(F.col("ok"), F.col("attempt")))
    bad = F.max(F.when(~F.col("ok"), F.col("attempt")))
    return attempts.groupBy(*keys).agg(F.count_if(~F.col("ok")).alias("failed"), good.alias("_g"), bad.alias("_b")).filter("failed > 0").select(*keys, "failed", F.coalesce(F.col("_g") > F.col("_b"), F.lit(False)).alias("recovered"))


def resolve_choice(issues: DataFrame, proposals: DataFrame, keys: list[str]) -> DataFrame:
    """One adaptation per issue: the selected proposal if exactly one is, else the first. ``proposals``: keys, ord, selected, adaptation."""
    agg = proposals.groupBy(*keys).agg(F.count_if("selected").alias("_n"), F.min_by("adaptation", F.when(F.col("selected"), F.col("ord"))).alias("_s"), F.min_by("adaptation", "ord").alias("_f"))
    return issues.join(agg, keys, "left").withColumn("adaptation", F.coalesce(F.when(F.col("_n") == 1, F.col("_s")), F.col("_f"), F.col("adaptation"))).drop("_n", "_s", "_f")
