"""Alignment of two tokenizers' tokens.

A text is cut before every single space between two characters that are not white space: no token of either vocabulary holds
such a space behind another character, so both tokenizers encode such stretches independently of what stands beside them.
Each stretch is encoded once and looked up when it comes again. The character offsets of the first library and the byte
spans of the second one's proto (as the offset mapping that took the place of its immutable form) are coarse cuts; where a token's
span is not as long as its decoded bytes (a character cut into several tokens, a byte-fallback token, the space that is put
before a text), its end is counted on in decoded bytes.

Texts are encoded in one pass, which writes the id pairs of each text's links in a compact form; counts of pairs are summed
over the corpus from these. The most frequent pairs, a bounded number that holds most of all links, travel to all tasks; links
of other pairs meet their counts by a join.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, map_rows, settled, tidy

#: A pair that holds more than one link in LARGE travels to all tasks; at most LARGE pairs do.
LARGE = 1 << 20
#: Stretches whose encoding is remembered, and their bytes, before all are forgotten; bytes encoded by one call.
MOST_KNOWN, MOST_BYTES, CALL_BYTES = 400_000, 32 << 20, 1 << 16
#: Pairs that a task holds before it adds up equal ones.
MOST_PAIRS = 1 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r"\s | \s")


def byte_table() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Pair:
    """The two tokenizers with the bytes of each of their tokens."""

    path_a: str
    path_b: str

    def __post_init__(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(self.path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.path_b)
        table = byte_table()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes([table[c] for c in entry]) if all(c in table for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the vocabulary crosses a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a = np.array([len(x) for x in self.bytes_a])
        self.lengths_b = np.array([len(x) for x in self.bytes_b])
        # ids as text with what follows them in a list of groups: A's inside and at its end, then B's
        many_a, many_b = range(len(self.bytes_a)), range(len(self.bytes_b))
        self.names = [f"{i}{mark}".encode() for many, marks in ((many_a, ",|"), (many_b, ",;")) for mark in marks for i in many]
        self.name_lengths = np.array([len(x) for x in self.names])

    @staticmethod
    def _ends(begins: np.ndarray, stops: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ends of tokens in bytes: the coarse span's where it is as long as the token's bytes, else counted on from the last such end."""
        exact = stops - begins == lengths
        counted = np.cumsum(lengths)
        at = np.maximum.accumulate(np.where(exact, np.arange(1, len(exact) + 1), 0))  # one past the last exact token so far
        coarse, before = np.concatenate([[0], stops]), np.concatenate([[0], counted])
        return coarse[at] + counted - before[at]

    def encode(self, text: str) -> tuple | None:
        """(ids, ends) of each tokenizer for a text that begins with the space; None where joined bytes differ from the text."""
        raw = text.encode()
        e = self.a.encode(text, add_special_tokens=False)
        ids_a = np.array(e.ids, np.int64)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
        found = self.b.encode(raw[1:], return_type="offset_mapping")
        ids_b, (begins, stops) = np.array(found["ids"], np.int64), np.array(found["offsets"], np.int64).reshape(-1, 2).T
        if b"".join(map(self.bytes_a.__getitem__, e.ids)) != raw or b"".join(map(self.bytes_b.__getitem__, found["ids"])) != raw:
            return None
        if len(raw) != len(text):  # characters -> bytes
            lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            offsets = np.append(lead, len(raw))[offsets]
        return ids_a, self._ends(offsets[:, 0], offsets[:, 1], self.lengths_a[ids_a]), ids_b, self._ends(begins + 1, stops + 1, self.lengths_b[ids_b])


@functools.lru_cache(1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def packed(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted distinct pairs and how often each occurs: differences of A's ids, B's ids and times, four bytes each, compressed."""
    columns = np.diff(codes >> 32, prepend=0), codes & 0xFFFFFFFF, times
    return zlib.compress(np.stack(columns).astype("<u4").view(np.uint8).reshape(3 * len(codes), 4).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    steps, b, times = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(3, -1).astype(np.int64)
    return np.cumsum(steps) << 32 | b, times


class Stretches:
    """Encoded stretches by number: counts, groups as text, and the id pairs of their links as ``a << 32 | b`` in one array."""

    def __init__(self, own: Pair):
        self.own = own
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[bytes | None] = []
        #: tokens of A and of B, groups and links of each stretch, and where its links begin
        self.counts, self.starts = np.zeros((1024, 4), np.int32), np.zeros(1024, np.int64)
        self.links, self.held, self.size = np.zeros(4096, np.int64), 0, 0
        self.bad: set[int] = set()

    def full(self) -> bool:
        return len(self.numbers) > MOST_KNOWN or self.size > MOST_BYTES

    def learn(self, stretches: list[str]) -> None:
        """Encode stretches that are not known, many by one call; those that end in white space alone, as it would join what follows."""
        first, block, size = len(self.groups), [], 0
        self.numbers.update(zip(stretches, range(first, first + len(stretches)), strict=True))
        self.groups.extend([None] * len(stretches))
        if len(self.groups) > len(self.counts):
            grown = 2 * len(self.groups)
            self.counts, self.starts = np.resize(self.counts, (grown, 4)), np.resize(self.starts, grown)
        self.counts[first : len(self.groups)] = 0
        for s in stretches:
            if s[-1:].isspace():
                self._encode([s])
                continue
            block.append(s)
            size += len(s)
            if size > CALL_BYTES:
                self._encode(block)
                self.size += size
                block, size = [], 0
        if block:
            self._encode(block)
            self.size += size

    def _encode(self, block: list[str]) -> None:
        text = " " + " ".join(block)
        found = self.own.encode(text)
        if found is None:
            if len(block) > 1:  # one of them cannot be aligned; which one shows when each is alone
                for s in block:
                    self._encode([s])
            return
        ids_a, ends_a, ids_b, ends_b = found
        # between neighbouring ends of either kind lies the overlap of one token of each: a link
        cuts = np.union1d(ends_a, ends_b)
        codes = ids_a[np.searchsorted(ends_a, cuts)] << 32 | ids_b[np.searchsorted(ends_b, cuts)]
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        limits = np.cumsum([len(x) + 1 for x in block] if text.isascii() else [len(x.encode()) + 1 for x in block])
        # groups as text: A's tokens of a group, then B's, each token's id with the mark that follows it
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = shared[group_a] == ends_a, shared[group_b] == ends_b
        size_a, size_b = len(self.own.bytes_a), len(self.own.bytes_b)
        names = np.concatenate([ids_a + size_a * last_a, 2 * size_a + ids_b + size_b * last_b])
        names = names[np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")]
        line = b"".join(map(self.own.names.__getitem__, names.tolist()))
        upto = np.stack([np.searchsorted(x, limits, "right") for x in (ends_a, ends_b, shared, cuts)])
        ends = np.concatenate([[0], np.cumsum(self.own.name_lengths[names])])[upto[0] + upto[1]].tolist()
        at = np.fromiter(map(self.numbers.__getitem__, block), np.int64, len(block))
        self.counts[at] = np.diff(upto, axis=1, prepend=0).T
        self.starts[at] = self.held + np.concatenate([[0], upto[3][:-1]])
        if self.held + len(codes) > len(self.links):
            self.links = np.resize(self.links, 2 * (self.held + len(codes)))
        self.links[self.held : self.held + len(codes)] = codes
        self.held += len(codes)
        begin, groups = 0, self.groups
        for k, end in zip(at.tolist(), ends, strict=True):
            groups[k] = line[begin : end - 1]
            begin = end
        self.size += len(line)

    def numbered(self, texts: list[str | None]) -> list[list[int]]:
        """Numbers of each text's stretches; none for null and empty texts and those whose tokens' bytes differ from the text."""
        if self.full():
            self.clear()
        cut = [[] if not t else CUT.split(t) if ODD.search(t) or t[0] == " " or t[-1] == " " else t.split(" ") for t in texts]
        numbers, groups = self.numbers, self.groups
        new = [p for p in dict.fromkeys([p for parts in cut for p in parts]) if p not in numbers]
        if new:
            self.learn(new)
        out = [list(map(numbers.__getitem__, parts)) for parts in cut]
        self.bad.update(i for i in map(numbers.__getitem__, new) if groups[i] is None)
        return [[] if self.bad and not self.bad.isdisjoint(mine) else mine for mine in out]

    def pairs(self, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the stretches' links and how often each occurs."""
        at = np.array(numbers)
        many = self.counts[at, 3]
        places = np.arange(int(many.sum())) + np.repeat(self.starts[at] - np.cumsum(many) + many, many)
        return np.unique(self.links[places], return_counts=True)


@functools.lru_cache(1)
def _stretches(path_a: str, path_b: str) -> Stretches:
    return Stretches(pair(path_a, path_b))


def stretches(path_a: str, path_b: str) -> Stretches:
    """What the worker knows of the two tokenizers, until another operator's turn."""
    REMEMBERED["alignment"] = forget
    return _stretches(path_a, path_b)


def forget() -> None:
    _stretches.cache_clear()
    pair.cache_clear()


def encoded(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, id, n_a, n_b, n_groups, n_links, groups_sha256 and _pairs (``packed``) of every whole text, written once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        from pyspark import TaskContext

        own, row = stretches(path_a, path_b), TaskContext.get().partitionId() << 33

        def work(columns):
            nonlocal row
            out = []
            for doc, numbers in zip(columns[id_col], own.numbered(columns[text_col]), strict=True):
                row += 1
                if not numbers:
                    out.append((row, doc, 0, 0, 0, 0, "", None))
                    continue
                sha = hashlib.sha256(b";".join(map(own.groups.__getitem__, numbers))).hexdigest()
                out.append((row, doc, *own.counts[numbers].sum(0, dtype=np.int64).tolist(), sha, packed(*own.pairs(numbers))))
            return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(8)]

        return work

    fields = f"_row long, {id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs binary"
    return settled(map_rows(docs.select(id_col, text_col), make, fields, "alignment"), "encoded")


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return codes, np.bincount(at, np.concatenate(counts), len(codes)).astype(np.int64)


def _pairs_batch(codes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["_pair", "_n"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, links: how many links of the whole corpus hold an id pair; ``rows`` as ``encoded``. Added up in each task first."""

    def run(batches):
        pairs, counts, held = [], [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                codes, times = unpacked(data)
                pairs.append(codes)
                counts.append(times)
                held += len(codes)
                if held > MOST_PAIRS:
                    codes, times = _added(pairs, counts)
                    pairs, counts, held = [codes], [times], len(codes)
                    if held > MOST_PAIRS // 2:
                        yield _pairs_batch(codes, times)
                        pairs, counts, held = [], [], 0
        if pairs:
            yield _pairs_batch(*_added(pairs, counts))

    found = rows.select("_pairs").filter("_pairs IS NOT NULL").mapInArrow(tidy(run), "_pair long, _n long").groupBy("_pair").agg(F.sum("_n").alias("links"))
    return settled(found.select(F.shiftright("_pair", 32).cast("int").alias("a"), F.expr("cast(_pair & 4294967295 as int)").alias("b"), "links"), "pairs")


def spans(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of every whole text: id, groups (array of struct start, end, a, b), places in bytes of the text with a space before it.

    Same cases as ``align``; a text without tokens has an empty array.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        own = stretches(path_a, path_b)

        def groups(numbers):
            out, at = [], 0
            for n in numbers:
                for group in own.groups[n].decode().split(";"):
                    a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                    end = at + sum(len(own.own.bytes_a[i]) for i in a)
                    out.append({"start": at, "end": end, "a": a, "b": b})
                    at = end
            return out

        return lambda columns: [columns[id_col], list(map(groups, own.numbered(columns[text_col])))]

    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>", "alignment")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose tokens' joined bytes are not the text with a space before it, have zeros and the
    empty string. Texts are encoded whole, stretch by stretch. Repeated rows give repeated rows and count each time; pairs that tie for
    a B id's highest count are all best. Null ids stay. An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = encoded(docs, path_a, path_b, id_col, text_col)
    counts = pair_counts(rows)
    highest = counts.groupBy("b").agg(F.max("links").alias("_most"))  # one row for each id of B's vocabulary
    rated = settled(counts.join(highest, "b").select(F.expr("shiftleft(cast(a as long), 32) | b").alias("_pair"), "links", (F.col("links") == F.col("_most")).alias("_best")), "rated")
    total = counts.agg(F.sum("links")).first()[0] or 0
    hot = rated.filter(F.col("links") * LARGE > total).orderBy("_pair").toArrow()  # LARGE rows at most
    table = spark.sparkContext.broadcast([hot.column(i).to_numpy() for i in range(3)])

    def make():
        codes, links, best = table.value

        def rate(data):
            """(links that are best, sum of counts) of the pairs in the table, and the other pairs."""
            if data is None:
                return 0, 0, []
            mine, times = unpacked(data)
            at = np.minimum(np.searchsorted(codes, mine), max(0, len(codes) - 1))
            known = codes[at] == mine if len(codes) else np.zeros(len(mine), bool)
            at, many = at[known], times[known]
            rest = [{"_pair": p, "_n": n} for p, n in zip(mine[~known].tolist(), times[~known].tolist(), strict=True)]
            return int((best[at] * many).sum()), int((links[at] * many).sum()), rest

        def work(columns):
            out = list(map(rate, columns["_pairs"]))
            return [columns["_row"], *([x[i] for x in out] for i in range(3))]

        return work

    seen = settled(map_rows(rows.select("_row", "_pairs"), make, "_row long, _best long, _sum long, _rest array<struct<_pair:long,_n:long>>"), "rated-links")
    rest = seen.select("_row", F.explode("_rest").alias("_r")).select("_row", "_r.*").join(rated, "_pair")
    added = rest.groupBy("_row").agg(F.sum(F.col("_n") * F.col("links")).alias("_links"), F.sum(F.col("_n") * F.col("_best").cast("long")).alias("_n_best"))
    whole = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    found = seen.drop("_rest").join(added, "_row", "left").select("_row", whole("_best", "_n_best").alias("n_best"), whole("_sum", "_links").alias("count_sum"))
    return rows.drop("_pairs").join(found, "_row").select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
