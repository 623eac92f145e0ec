"""Structured Streaming: incremental ingest and the streaming fact ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.udfs import entity_key_of
from ..operators.timeline import MOST_FACTS, advance

#: Input of the ledger stream: one row per sequence with its updates.
LEDGER_IN = "chapter long, sequence int, reset boolean, updates array<struct<entity:string,aspect:string,fact:string>>"
#: Its output: a fact after a sequence, or a note with the other columns null: "waiting" with how many sequences are held behind the one that
#: is missing, "no_sequence" for a row whose sequence is null, "expired" with how many were held when an idle chapter was dropped.
LEDGER_OUT = "chapter long, sequence int, entity string, aspect string, fact string, from_sequence int, n_held int, note string"
FACT = ("key", "entity", "aspect", "fact", "sequence")


class Ledger(StatefulProcessor):
    """Per chapter: the next sequence and how many wait, the facts alive (MOST_FACTS at most), and the waiting sequences in a map.

    A batch touches the map at the sequences that arrive or leave only, however many wait. A chapter that is idle for ``idle_ms`` is
    dropped with its state.
    """

    def __init__(self, most: int, idle_ms: int | None = None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next_sequence int, n_held int")
        self.facts = handle.getListState("facts", "key string, entity string, aspect string, fact string, sequence int")
        self.held = handle.getMapState("held", "sequence int", "reset boolean, updates array<struct<entity:string,aspect:string,fact:string>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cursor, waiting = self.place.get() if self.place.exists() else (1, 0)
        out = []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if pd.isna(r.sequence):
                    out.append((key[0], None, None, None, None, None, None, "no_sequence"))
                    continue
                at = (int(r.sequence),)
                if at[0] >= cursor and not self.held.containsKey(at):
                    self.held.updateValue(at, (bool(r.reset), [(u["entity"], u["aspect"], u["fact"]) for u in (r.updates if r.updates is not None else [])]))
                    waiting += 1
        if self.held.containsKey((cursor,)):
            facts = [dict(zip(FACT, f, strict=True)) for f in self.facts.get()]
            while self.held.containsKey((cursor,)):
                reset, updates = self.held.getValue((cursor,))
                self.held.removeKey((cursor,))
                given = [{"key": entity_key_of(e), "entity": e, "aspect": a, "fact": f} for e, a, f in updates]
                facts = advance(facts, cursor, reset, given, self.most)
                out += [(key[0], cursor, f["entity"], f["aspect"], f["fact"], f["sequence"], None, None) for f in facts]
                cursor, waiting = cursor + 1, waiting - 1
            self.facts.put([tuple(f[n] for n in FACT) for f in facts]) if facts else self.facts.clear()
        self.place.update((cursor, waiting))
        if waiting:
            out.append((key[0], cursor, None, None, None, None, waiting, "waiting"))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cursor, waiting = self.place.get() if self.place.exists() else (1, 0)
        for state in (self.place, self.facts, self.held):
            state.clear()
        yield self.frame([(key[0], cursor, None, None, None, None, waiting, "expired")])

    @staticmethod
    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER_OUT.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def stream_ledger(rows: DataFrame, most: int = MOST_FACTS, idle_ms: int | None = None) -> DataFrame:
    """Facts after each sequence, emitted once and in order; sequences start at 1 and those ahead of a gap are held (LEDGER_OUT).

    After each batch a chapter that waits for a sequence reports it, with how many are held behind it. A sequence that
    arrives again is ignored; a row without a sequence is reported. With ``idle_ms`` the state of a chapter that got no row for so long (processing time)
    is dropped and that is reported; a chapter that comes again after that starts anew. The state store must be RocksDB's
    (spark.sql.streaming.stateStore.providerClass).
    """
    return rows.groupBy("chapter").transformWithStateInPandas(Ledger(most, idle_ms), LEDGER_OUT, "Append", "None" if idle_ms is None else "ProcessingTime")


class Versions(StatefulProcessor):
    """Per chapter: the digest and number of its last version. Rows that repeat it are dropped; all others are the next version."""

    def __init__(self, digest: str, order: str | None):
        self.digest, self.order = digest, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))  # the versions of one chapter in one batch
        given = given.sort_values([self.order, self.digest] if self.order else [self.digest], kind="stable", na_position="first")
        digest, version = self.last.get() if self.last.exists() else (None, 0)
        kept, versions = [], []
        for at, value in enumerate(given[self.digest].astype(object).where(given[self.digest].notna(), None)):
            if version == 0 or value != digest:
                digest, version = value, version + 1
                kept.append(at)
                versions.append(version)
        if kept:
            self.last.update((digest, version))
        yield given.iloc[kept].assign(version=pd.Series(versions, dtype="int64", index=given.index[kept]))

    def close(self) -> None:
        pass


def versions(stream: DataFrame, key: str = "chapter_id", digest: str = "text_sha256", order: str | None = None) -> DataFrame:
    """The rows that change a chapter, with ``version`` (from 1): its digest differs from that of the chapter's last version.

    A return to an older text is a change. Versions of a chapter that arrive in one batch follow ``order`` (as a file's time of change), those
    that tie in it, and all without it, their digest. Chapters without a key are one chapter. The state store must be RocksDB's.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields] + ["version long"])
    return stream.groupBy(key).transformWithStateInPandas(Versions(digest, order), schema, "Append", "None")


def ingest(stream: DataFrame, table_path: str, checkpoint: str, key: str = "chapter_id", digest: str = "text_sha256", order: str | None = None):
    """Append new and changed chapters (``versions``) to a table, each batch to a partition of its own.

    What was seen last is state; the table is not read. A batch that runs twice starts from the same state and overwrites its partition.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch_no", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(table_path)

    rows = versions(stream, key, digest, order)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
