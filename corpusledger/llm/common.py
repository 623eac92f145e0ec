"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the bitmap by which many rows are told apart from few.
BITMAP_BITS = 26
#: Rows and bytes of texts that a task works on at once; one longer text is worked on alone.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the context's checkpoint folder; where neither is set, a folder in the
    warehouse. On a cluster that folder must not lie on a machine's own disk: then it is an error that none is named."""
    context = spark.sparkContext
    named, given = context.getConf().get("spark.checkpoint.dir"), context._jsc.sc().getCheckpointDir()
    if named is None:
        named = given.get() if given.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        if not given.isDefined() and not context.master.startswith("local") and named.partition(":")[0] in (named, "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Few rows an Arrow batch while a job runs, as a row may be a whole book; the session's own setting comes back after it."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read again: a short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def portions(batch: pa.RecordBatch):
    """The batch in slices of at most BATCH_ROWS rows and, but for a row that is longer alone, BATCH_BYTES bytes of text."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = int(np.clip(np.searchsorted(ends, before + BATCH_BYTES, "right"), start + 1, start + BATCH_ROWS))
        yield batch.slice(start, stop - start)
        start = stop


#: What operators remember in a Python worker from one task to the next: operator -> how it is dropped.
REMEMBERED: dict[str, Callable[[], None]] = {}


RELEASE_SECONDS = 1.0


def released() -> None:
    """Memory that is free in this worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(run, operator: str = ""):
    """``run(batches)`` for a worker that outlives its task: what other operators remember in it is dropped first, and what is free goes
    back to the system every RELEASE_SECONDS and at the end, so that neither busy nor idle workers hold more than they use."""

    def whole(batches):
        others = [name for name in REMEMBERED if name != operator]
        for name in others:
            REMEMBERED.pop(name)()
        if others:
            released()
        last = time.monotonic()
        for out in run(batches):
            yield out
            if time.monotonic() - last > RELEASE_SECONDS:
                released()
                last = time.monotonic()
        released()

    return whole


def map_rows(df: DataFrame, make, schema: str, operator: str = "") -> DataFrame:
    """Apply ``make() -> function(dict of column lists) -> list of columns`` (lists or Arrow arrays) to portions of rows; make runs once a task.

    ``operator``: whose memory the worker keeps (``tidy``).

    What is returned has not run; texts go to Python in small batches when it is ``settled``.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    names = fields.names

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema, work = to_arrow_schema(fields), make()
        for batch in batches:
            for part in portions(batch):
                columns = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, out_schema.field(n).type) for n, c in zip(names, columns, strict=True)], schema=out_schema)

    return df.mapInArrow(tidy(run, operator), fields)


def flagged(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """df with _may: true where the column's value is in wanted's only column, and on few other rows.

    The values set bits of a bitmap of 2**BITMAP_BITS bits, kept as rows of 64; at most 2**(BITMAP_BITS - 6) rows go to all tasks.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    at = wanted.select(spot(wanted.columns[0]).alias("_spot"))
    bits = at.groupBy(F.shiftright("_spot", 6).alias("_row")).agg(F.expr("bit_or(shiftleft(1L, cast(_spot & 63 as int)))").alias("_bits"))
    rows = df.withColumn("_spot", spot(column)).withColumn("_row", F.shiftright("_spot", 6))
    met = rows.join(F.broadcast(bits), "_row", "left")
    return met.select(*df.columns, F.expr("(shiftright(coalesce(_bits, 0L), cast(_spot & 63 as int)) & 1) = 1").alias("_may"))


def words_expr(column):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as no text."""
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
