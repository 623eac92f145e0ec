"""WARC archives with a two-level capture index.

Pages are range-partitioned by their URL key, whose host is written in reverse, so that a site's captures lie together.
Each task writes archives of single gzip members in key order, index files of compressed blocks of index lines, and a
directory row per block: its first and last key, its place in the index file and the range of the archive it covers.

A lookup deals the wanted keys by ranges, sends each directory row to the ranges it touches, and searches the sparse
directory of a range by bisection for every key; each block found is then read by a task of its own choice: one range of
the index file, and one range of the archive for the records that are wanted. A key with very many captures is so
many blocks, not one task's.

Files go to the shared folder under a name of the attempt; only directory rows of attempts that succeeded are read, so
a task that runs twice does no harm.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import json
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, portions, settled

#: Payloads from this size on are kept once; effort of the compression.
LEAST_REVISIT, LEVEL = 1000, 2
#: Index lines and bytes of records, before compression, at which a block ends; bytes at which an archive does.
BLOCK_LINES, BLOCK_BYTES, ARCHIVE_BYTES = 500, 4 << 20, 1 << 30
#: Of equal payloads, groups of more than one record in this many are broadcast, at most this many groups.
LARGE = 4096
DATE = "2024-01-01T00:00:00Z"
DIRECTORY = "first_key string, last_key string, archive string, index_file string, block_at long, block_bytes long, data_at long, data_bytes long, n_lines long"


def url_key(url):
    """Sort key of a URL column: host labels in reverse, then path and query, in lower case; no scheme, port, leading www or fragment."""
    text = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(text, r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@]*@)?(?:www\d*\.)?([^/:?#]*)", 1)
    rest = F.regexp_extract(text, r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Light rows _id, _key, _digest, _type, _refers: which record holds a payload and which refer to it."""
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "utf-8")
    light = pages.select(F.col(id_col).alias("_id"), url_key(F.col(url_col)).alias("_key"), F.sha1(body).alias("_digest"), F.sha2(body, 256).alias("_same"), F.octet_length(body).cast("long").alias("_bytes"))
    light = settled(light, "payloads")
    small, large = light.filter(F.col("_bytes") < LEAST_REVISIT), light.filter(F.col("_bytes") >= LEAST_REVISIT)
    holders = settled(large.groupBy("_same").agg(F.max("_id").alias("_holder"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "holders")
    heavy = F.broadcast(holders.filter(F.col("_n") * LARGE > light.count()))  # LARGE rows at most
    met = large.join(heavy, "_same").unionByName(large.join(heavy, "_same", "left_anti").join(holders, "_same", "left"))
    met = met.unionByName(small, allowMissingColumns=True)
    revisit = F.col("_holder").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_holder"))
    return met.select("_id", "_key", "_digest", F.when(revisit, "revisit").otherwise("response").alias("_type"), F.when(revisit, F.col("_holder")).alias("_refers"))


def page_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, body: bytes, digest: str, kind: str, refers: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the response's headers, with the full length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + body
    uri = "".join(c for c in url or "" if c >= " ")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page_name(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_name(refers)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one uncompressed record: its headers, payload, and the payload's full length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    full = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    return {"page_id": page_number(named["WARC-Record-ID"]), "type": named["WARC-Type"], "digest": named["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": page_number(named.get("WARC-Refers-To")), "url": named["WARC-Target-URI"], "payload": body, "payload_bytes": full}


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Writer:
    """One task's archives and index files."""

    def __init__(self, folder: str, most_lines: int, most_bytes: int, archive_bytes: int):
        self.most_lines, self.most_bytes, self.archive_bytes = most_lines, most_bytes, archive_bytes
        self.folder, self.files, self.rows, self.out = folder, open_folder(folder)[0], [], None
        self.files.create_dir(open_folder(folder)[1], recursive=True)

    def begin(self) -> None:
        name = f"{self.folder}/{uuid.uuid4().hex}"
        self.archive, self.index = f"{name}.warc.gz", f"{name}.cdx.gz"
        self.out = [self.files.open_output_stream(open_folder(p)[1], compression=None) for p in (self.archive, self.index)]
        self.at, self.index_at, self.lines, self.begun, self.raw = 0, 0, [], 0, 0

    def add(self, key: str, page_id: int | None, data: bytes, kind: str) -> None:
        if self.out is None:
            self.begin()
        packed = gzip.compress(data, LEVEL, mtime=0)
        if not self.lines:
            self.begun, self.raw = self.at, 0
        self.lines.append((key, page_id, self.at, len(packed), kind))
        self.out[0].write(packed)
        self.at += len(packed)
        self.raw += len(data)
        if len(self.lines) == self.most_lines or self.raw >= self.most_bytes:
            self.end_block()
            if self.at >= self.archive_bytes:
                self.close()

    def end_block(self) -> None:
        if self.lines:
            block = gzip.compress("".join(json.dumps(line, ensure_ascii=True) + "\n" for line in self.lines).encode(), LEVEL, mtime=0)
            self.out[1].write(block)
            self.rows.append((self.lines[0][0], self.lines[-1][0], self.archive, self.index, self.index_at, len(block), self.begun, self.at - self.begun, len(self.lines)))
            self.index_at += len(block)
            self.lines = []

    def close(self) -> list[tuple]:
        if self.out is not None:
            self.end_block()
            for out in self.out:
                out.close()
            self.out = None
        return self.rows


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", partitions: int | None = None) -> DataFrame:
    """Write every page as a record; returns the sparse directory, one row per block, settled in the shared folder.

    Of payloads that are equal and have at least LEAST_REVISIT bytes the one with the largest id is a response, the
    others are revisits. Null payloads are empty, null URLs have an empty key. A row whose id is null is written without one;
    it is never the response of a group in which a row has an id, and rows of a group without any id are all responses.
    Rows that repeat an id are written as often as they occur. An empty table gives an empty directory; other columns are ignored.

    The payloads are shuffled once: the decisions travel as rows of their own and meet their page in the sort.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(body_col), F.lit(""))
    none = F.lit(None).cast("string")
    page_rows = pages.select(url_key(F.col(url_col)).alias("_key"), F.col(id_col).cast("long").alias("_id"), F.lit(1).alias("_part"), F.col(url_col).alias("_url"), body.alias("_body"), none.alias("_digest"), none.alias("_type"), F.lit(None).cast("long").alias("_refers"))
    decided = decide(pages, id_col, url_col, body_col)
    notes = decided.select("_key", F.col("_id").cast("long").alias("_id"), F.lit(0).alias("_part"), none.alias("_url"), none.alias("_body"), "_digest", "_type", F.col("_refers").cast("long").alias("_refers"))
    limits = BLOCK_LINES, BLOCK_BYTES, ARCHIVE_BYTES
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = page_rows.unionByName(notes).repartitionByRange(count, "_key", "_id").sortWithinPartitions("_key", "_id", "_part")

    def work(batches):
        out, notes, of = None, {}, None
        for row in (row for batch in batches for part in portions(batch) for row in part.to_pylist()):
            if (row["_key"], row["_id"]) != of:
                notes, of = {}, (row["_key"], row["_id"])
            if row["_part"] == 0:
                notes[row["_digest"]] = row
                continue
            out, body = out or Writer(folder, *limits), row["_body"].encode("utf-8", "surrogatepass")
            note = notes[hashlib.sha1(body).hexdigest()]
            out.add(row["_key"], row["_id"], record(row["_id"], row["_url"], body, note["_digest"], note["_type"], note["_refers"]), note["_type"])
        done = out.close() if out else []
        names = [x.split()[0] for x in DIRECTORY.split(", ")]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in done], pa.string() if i < 4 else pa.int64()) for i, n in enumerate(names)})

    return settled(rows.mapInArrow(work, DIRECTORY), "warc-directory")


def read_range(path: str, at: int, length: int) -> bytes:
    files, inner = open_folder(path)
    with files.open_input_file(inner) as f:
        return f.read_at(length, at)


CAPTURES = "url_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def captures_of(row: dict, wanted: list[str] | None, with_payload: bool) -> pa.RecordBatch:
    """The records of one block whose keys are wanted (sorted; None: all), by one range read of its index and one of its archive.

    Each payload is held against its digest; a difference raises an error.
    """
    lines = [json.loads(x) for x in gzip.decompress(read_range(row["index_file"], row["block_at"], row["block_bytes"])).splitlines()]
    if wanted is not None:
        keys = [line[0] for line in lines]
        lines = [line for k in wanted for line in lines[bisect.bisect_left(keys, k) : bisect.bisect_right(keys, k)]]
    out = []
    if lines:
        start = lines[0][2]
        data = read_range(row["archive"], start, lines[-1][2] + lines[-1][3] - start)
        for key, page_id, at, length, _ in lines:
            r = parse(gzip.decompress(data[at - start : at - start + length]))
            whole = r["type"] == "response"
            if r["page_id"] != page_id or (whole and hashlib.sha1(r["payload"]).hexdigest() != r["digest"]):
                raise ValueError(f"record of page {page_id} is damaged")
            out.append((key, page_id, r["payload_bytes"], r["digest"], r["type"], r["refers_to"], r["url"], r["payload"] if whole and with_payload else None))
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*[x.split() for x in CAPTURES.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[t]) for i, t in enumerate(types)], names=list(names))


def tasks_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_archives(directory: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record, block by block in no order (CAPTURES; payload is null for a revisit)."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield captures_of(row, None, with_payload)

    return settled(directory.repartition(tasks_of(directory.sparkSession), "archive", "block_at").mapInArrow(work, CAPTURES), "captures")


class Captures:
    """Lookups by key over a directory that one process holds: bisection, then two range reads."""

    def __init__(self, directory: list[dict]):
        self.rows = sorted(directory, key=lambda r: r["first_key"])
        self.keys = [r["first_key"] for r in self.rows]

    def find(self, key: str) -> list[dict]:
        """All records of a key, in the order of their ids; none if the key is absent."""
        out, at = [], max(0, bisect.bisect_left(self.keys, key) - 1)
        while at < len(self.rows) and self.keys[at] <= key:
            row = self.rows[at]
            at += 1
            if row["last_key"] < key:
                continue
            for line in io.BytesIO(gzip.decompress(read_range(row["index_file"], row["block_at"], row["block_bytes"]))):
                found, _, place, length, _ = json.loads(line)
                if found == key:
                    out.append(parse(gzip.decompress(read_range(row["archive"], place, length))))
        return sorted(out, key=lambda r: (r["page_id"] is not None, r["page_id"] or 0))


def blocks_wanted(directory: DataFrame, wanted: DataFrame) -> DataFrame:
    """Directory rows with ``wanted``, the sorted keys to look for in that block; a block may come more than once, with other keys.

    Keys are dealt by ranges; a range's bounds are one row (so as many rows go to all tasks as there are partitions). A task
    holds the sparse directory rows of its range, in order, and bisects them for each key that passes by.
    """
    spark = wanted.sparkSession
    dealt = settled(wanted.distinct().repartitionByRange(tasks_of(spark), "url_key").withColumn("_range", F.spark_partition_id()), "wanted")
    bounds = sorted(map(tuple, dealt.groupBy("_range").agg(F.min("url_key"), F.max("url_key")).select("min(url_key)", "max(url_key)", "_range").collect()))
    lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]
    names = [x.split()[0] for x in DIRECTORY.split(", ")]

    def touch(batches):
        for batch in batches:
            firsts, lasts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hits = [(i, bounds[j][2]) for i, (a, b) in enumerate(zip(firsts, lasts, strict=True)) for j in range(bisect.bisect_left(highs, a), bisect.bisect_right(lows, b))]
            rows = batch.take(pa.array([i for i, _ in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([r for _, r in hits], pa.int32())], names=[*names, "_range"])

    sparse = directory.select(names).mapInArrow(touch, DIRECTORY + ", _range int").withColumn("_key", F.col("first_key"))
    rows = sparse.withColumn("_part", F.lit(0)).unionByName(dealt.select("_range", F.col("url_key").alias("_key"), F.lit(1).alias("_part")), allowMissingColumns=True)
    rows = rows.repartition(tasks_of(spark), "_range").sortWithinPartitions("_range", "_part", "_key", "last_key", "archive", "block_at")

    def search(batches):
        of, held, firsts, ends, keys = None, [], [], [], []

        def found():
            done = [i for i in range(len(held)) if keys[i]]
            kinds = [pa.string() if i < 4 else pa.int64() for i in range(len(names))]
            arrays = [pa.array([held[i][n] for i in done], t) for n, t in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([keys[i] for i in done], pa.list_(pa.string()))], names=[*names, "wanted"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["_range"] != of:
                    yield found()
                    of, held, firsts, ends, keys = row["_range"], [], [], [], []
                if row["_part"] == 0:
                    held.append(row)
                    firsts.append(row["first_key"])
                    # blocks are in order of their first keys, and so of their last ones
                    ends.append(row["last_key"])
                    keys.append([])
                    continue
                for i in range(bisect.bisect_left(ends, row["_key"]), bisect.bisect_right(firsts, row["_key"])):
                    keys[i].append(row["_key"])
        yield found()

    return rows.mapInArrow(search, DIRECTORY + ", wanted array<string>")


def lookup(directory: DataFrame, wanted: DataFrame | list[str], with_payload: bool = True) -> DataFrame:
    """All captures of the wanted URL keys (a list, or a DataFrame whose first column holds them): CAPTURES.

    Null keys and keys that no record has give nothing; a key given twice counts once.
    """
    spark = directory.sparkSession
    if isinstance(wanted, list):
        wanted = spark.createDataFrame([(k,) for k in wanted], "url_key string")
    keys = wanted.select(F.col(wanted.columns[0]).alias("url_key")).filter("url_key IS NOT NULL")
    hit = blocks_wanted(directory, keys).repartition(tasks_of(spark), "archive", "block_at")

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield captures_of(row, row["wanted"], with_payload)

    return settled(hit.mapInArrow(work, CAPTURES), "captures")


def archive_round_trip(spark: SparkSession, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Write all pages to the shared folder and look every one of their keys up again; one row per page."""
    directory = write_archives(pages, new_folder(spark, "warc"), url_col=url_col)
    found = lookup(directory, pages.select(url_key(F.col(url_col)).alias("url_key")), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
