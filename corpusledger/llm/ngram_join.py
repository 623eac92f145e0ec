"""Jaccard self-join of word n-gram sets by count vectors in packed R-trees.

The n-grams of a text are hashed into groups; the counts by group are a point. Two sets share at most the sum of the
coordinate minima of their points, and a box of points at most the sum of the minima with its upper corner, so a tree
over the points leaves few pairs to verify on the sets themselves.

The tree's top level is made for a cluster: two sets that link share one of their first n - ceil(t n) + 1 n-grams in any
common order, so each such n-gram is a block and a linked pair meets in one at least. N-grams of rare words come first,
by word counts of all documents. Blocks that are still large are split without losing a pair, in three steps:

1. Their n-grams are put behind all others in the order, and the documents that held them enter the blocks of their new
   first n-grams. Documents that merely share a passage part here. Nothing changes for other documents, as none of
   their first n-grams moved.
2. What still is large is cut by the size of the sets; linked sizes lie in one range or in neighbours.
3. A block is split by balls around a hub. Differences of count vectors are a metric, and no linked pair differs by more
   than some r: who is within 2 r of the hub is its family, who is beyond r goes on to the next hub, and a linked pair
   is together in one of the two. Blocks that hubs cannot split meet in pairs of tiles.

Each block packs a tree and keeps a spanning forest of the pairs that pass the bound. The components of those forests
and balls are families; every link lies within one. A family is verified in tiles of bounded size, each with the
family's hubs; what the hubs do not connect is then verified against all tiles. Pairs already connected are not verified
again, so a family of near copies costs about one verification a document instead of one a pair.

Sets of equal content are one node, and n-grams are 64-bit hashes. Texts are not shuffled: the sets of family members are
made where the texts lie, behind a bitmap of fixed size that lets few others through.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, settled, tidy

#: Groups of a count vector by the size of the set, each a multiple of the one before, for similarities from 0.85 on and
#: below: two unrelated sets of n n-grams differ by about 1.1 * sqrt(n * groups) in their counts, linked ones by at most a
#: share of n that grows as the similarity falls, so larger sets and lower similarities need more groups.
HIGH, LEVELS, LOW_LEVELS = 0.85, ((300, 32), (2000, 64), (1 << 62, 512)), ((300, 64), (2000, 256), (1 << 62, 2048))
#: Points of a tree node; documents of a tile; members above which a block is split; times that n-grams are put back,
#: and hubs that one block is split by before its tiles meet in pairs.
NODE, TILE, HOT, PUT_BACK, HUBS = 16, 512, 2048, 2, 8
#: A key with more than one row in HOT_KEYS is counted as hot; at most so many are.
HOT_KEYS = 4096
#: A word is frequent if it is one in this many words; so at most this many words are. Bits of the bitmap of a semi-join.
ONE_IN, BITMAP_BITS = 65_536, 26
#: Words whose hashes are remembered; bits of a word's hash that hold its class, and of an n-gram's its rank.
MOST_WORDS, CLASS_BITS, RANK_BITS = 200_000, 4, 6
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> CLASS_BITS


class WordHashes(dict):
    """Word -> hash, the low bits of which are its class: 0 for a rare word, more for frequent ones."""

    def __init__(self, classes: dict[int, int] | None = None):
        super().__init__()
        self.classes = classes or {}

    def __missing__(self, word: bytes) -> int:
        plain = word_hash(word)
        out = self[word] = plain << CLASS_BITS | self.classes.get(plain, 0)
        return out


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the hash of the whole sequence; of none, nothing.

    The top bits of a hash are its words' mean class, so that sorted hashes begin with the rarest words.
    """
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(hashes) > MOST_WORDS:
        hashes.clear()
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(k, len(words))
    n = len(words) - size + 1
    out, total = np.full(n, size, np.uint64), np.zeros(n, np.uint64)
    for j in range(size):
        part = ids[j : j + n]
        out = (out ^ part) * MULTIPLY
        out ^= out >> np.uint64(29)
        total += part & np.uint64((1 << CLASS_BITS) - 1)
    rank = total * np.uint64((1 << RANK_BITS) - 1) // np.uint64(size * ((1 << CLASS_BITS) - 1))
    return np.unique(out >> np.uint64(RANK_BITS) | rank << np.uint64(64 - RANK_BITS))


def levels_of(num: int, den: int) -> tuple[tuple[int, int], ...]:
    return LEVELS if num >= HIGH * den else LOW_LEVELS


def level_of(size: int, levels) -> int:
    return next(i for i, (most, _) in enumerate(levels) if size <= most)


def point(s: np.ndarray, levels) -> np.ndarray:
    """Count vector of a set, of its own level."""
    groups = levels[level_of(len(s), levels)][1]
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def packed(vector: np.ndarray) -> bytes:
    """The counts, two bytes each if they fit, compressed: most are small."""
    return zlib.compress(vector.astype("<u2" if vector.max() < 1 << 16 else "<u4").tobytes(), 1)


def unpacked(data: bytes, size: int, levels) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, f"<u{len(raw) // levels[level_of(size, levels)][1]}").astype(np.int32)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The vector over fewer groups."""
    return vector if len(vector) == groups else vector.reshape(-1, groups).sum(0, dtype=np.int32)


def halved(vectors: np.ndarray) -> np.ndarray:
    """An order of the points in which runs of NODE lie close together: halves along the widest coordinate, and so on."""
    out, todo = [], [np.arange(len(vectors))]
    while todo:
        at = todo.pop()
        if len(at) > NODE:
            part = vectors[at]
            at = at[np.argsort(part[:, int((part.max(0) - part.min(0)).argmax())], kind="stable")]
            cut = -(-len(at) // NODE // 2) * NODE
            todo += [at[cut:], at[:cut]]
        else:
            out.append(at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class CountTree:
    """A packed R-tree over count vectors; boxes keep upper corners and the range of sums.

    Points are halved along the widest of their coordinates and their sum until a node holds them, so that boxes are
    tight in several dimensions.
    """

    def __init__(self, vectors: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        sizes = vectors.sum(1)
        order = halved(np.concatenate([sizes[:, None], vectors], axis=1)) if len(vectors) > NODE else np.argsort(sizes, kind="stable")
        self.levels, upper, low, high = [], vectors[order], sizes[order], sizes[order]
        self.order = order
        self.levels.append((upper, low, high))
        while len(upper) > NODE:
            starts = np.arange(0, len(upper), NODE)
            upper, low, high = np.maximum.reduceat(upper, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((upper, low, high))

    def near(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, bounds) of the points that may link with this one, the largest bound first."""
        size = int(vector.sum())
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high = self.levels[depth]
            bound = np.minimum(upper[at], vector).sum(1)
            fits = (self.den * high[at] >= self.num * size) & (self.num * low[at] <= self.den * size) & (bound * (self.num + self.den) >= self.num * (size + low[at]))
            at, bound = at[fits], bound[fits]
            if depth:
                at = (at[:, None] * NODE + np.arange(NODE)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        best = np.argsort(-bound, kind="stable")
        return self.order[at[best]], bound[best]


class Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def candidates(vectors: list[np.ndarray], num: int, den: int):
    """Yield (i, j) of all pairs that pass the bound, by trees of one level and, at its coarser groups, the next."""
    table, sizes = levels_of(num, den), [int(v.sum()) for v in vectors]
    levels = [level_of(n, table) for n in sizes]
    for level in sorted(set(levels)):
        reach = den * table[level][0] // num
        at = [i for i, x in enumerate(levels) if x == level or (x > level and sizes[i] <= reach)]
        if len(at) < 2:
            continue
        rows = np.stack([folded(vectors[i], table[level][1]) for i in at])
        tree = CountTree(rows, num, den)
        for place, i in enumerate(at):
            for other in tree.near(rows[place])[0].tolist():
                if other < place and level in (levels[i], levels[at[other]]):
                    yield i, at[other]


def forest(vectors: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect the points as all pairs that pass the bound would."""
    joined = Sets(len(vectors))
    return [(i, j) for i, j in candidates(vectors, num, den) if joined.join(i, j)]


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b)) and den * shared >= num * (len(a) + len(b) - shared)


def verified(sets: list[np.ndarray], num: int, den: int, labels: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the true links; positions with one label are connected already."""
    joined, out = Sets(len(sets)), []
    if labels is not None:
        first: dict = {}
        for i, x in enumerate(labels):
            joined.join(i, first.setdefault(x, i))
    for i, j in candidates([point(s, levels_of(num, den)) for s in sets], num, den):
        if joined.find(i) != joined.find(j) and linked(sets[i], sets[j], num, den):
            joined.join(i, j)
            out.append((i, j))
    return out


def grouped(batches, keys: list[str]):
    """Groups of consecutive rows that agree in the keys, as dicts of lists; one group is held at a time."""
    held, names, current = None, None, None
    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        names = list(columns)
        marks = list(zip(*[columns[k] for k in keys], strict=True))
        start = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[start]:
                part = {n: columns[n][start:i] for n in names}
                if held is not None and marks[start] == current:
                    for n in names:
                        held[n] += part[n]
                else:
                    if held is not None:
                        yield held
                    held, current = part, marks[start]
                start = i
    if held is not None:
        yield held


def edge_batches(pairs):
    """Arrow batches of (a, b) rows."""
    rows: list[tuple[int, int]] = []
    for p in pairs:
        rows += p
        if len(rows) > 50_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in rows], pa.int64()), "b": pa.array([x for _, x in rows], pa.int64())})
            rows = []
    yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in rows], pa.int64()), "b": pa.array([x for _, x in rows], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """_doc, _root (the smallest member) of every node that has an edge, by alternating large and small stars.

    Each round aggregates by node and joins back, so a hub's rows are summed before the shuffle and its join may be
    split. Rounds are written to the shared folder.
    """

    def state(df):
        row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return row[0], row[1]

    now = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = settled(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    leaves = now.groupBy("a").agg(F.min("b").alias("_root")).withColumnRenamed("a", "_doc")
    return leaves.unionByName(now.select(F.col("b").alias("_doc"), F.col("b").alias("_root")).distinct())


def word_classes(rows: DataFrame) -> dict[int, int]:
    """Hash -> class (1 to 15, by the logarithm of its share) of every word that is one in ONE_IN of all words or more."""

    def work(columns):
        seen = Counter()
        for text in columns["_text"]:
            seen.update(words_of(text))
        return [[word_hash(w) for w in seen], list(seen.values())]

    counts = map_rows(rows.select("_text"), lambda: work, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    counts = settled(counts, "words")
    total = counts.agg(F.sum("c")).first()[0] or 0
    often = counts.filter(F.col("c") * ONE_IN >= total).collect()  # ONE_IN words at most
    return {w: min((c * ONE_IN // total).bit_length(), (1 << CLASS_BITS) - 1) for w, c in often}


def first_keys(n: int, num: int, den: int) -> int:
    """How many of the first n-grams of a set of n hold one of every set that links with it."""
    return n - -(-num * n // den) + 1 if n else 0


def signatures(rows: DataFrame, classes, k: int, num: int, den: int) -> DataFrame:
    """_doc, n_shingles, _set (128-bit hash of the set), _counts, _keys (the n-grams whose blocks the set enters)."""

    def make():
        hashes, levels = WordHashes(classes.value), levels_of(num, den)

        def work(columns):
            out = []
            for doc, text in zip(columns["_doc"], columns["_text"], strict=True):
                s = shingles(text, k, hashes)
                out.append((doc, len(s), xxhash.xxh128_digest(s.tobytes()), packed(point(s, levels)), s[: first_keys(len(s), num, den)].view(np.int64).tolist()))
            return [list(c) for c in zip(*out, strict=True)] if out else [[]] * 5

        return work

    return settled(map_rows(rows, make, "_doc long, n_shingles long, _set binary, _counts binary, _keys array<long>"), "signatures")


def marked(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose column is in wanted's only column, and few others.

    The values set bits of a bitmap of 2**BITMAP_BITS bits, kept as rows of 64; at most 2**(BITMAP_BITS - 6) rows go to all tasks.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    at = wanted.select(spot(wanted.columns[0]).alias("_spot"))
    bits = at.groupBy(F.shiftright("_spot", 6).alias("_row")).agg(F.expr("bit_or(shiftleft(1L, cast(_spot & 63 as int)))").alias("_bits"))
    rows = df.withColumn("_spot", spot(column)).withColumn("_row", F.shiftright("_spot", 6))
    met = rows.join(F.broadcast(bits), "_row").filter(F.expr("(shiftright(_bits, cast(_spot & 63 as int)) & 1) = 1"))
    return met.select(df.columns)


def sets_of(rows: DataFrame, docs: DataFrame, classes, k: int) -> DataFrame:
    """_doc, _shingles (bytes of the sorted hashes) of the rows whose id is in docs, made where the texts lie."""

    def make():
        hashes = WordHashes(classes.value)
        return lambda c: [c["_doc"], [shingles(t, k, hashes).tobytes() for t in c["_text"]]]

    made = map_rows(marked(rows, "_doc", docs), make, "_doc long, _shingles binary")
    return made.join(docs, "_doc", "left_semi")


def met(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key occurs more than once, with _n (its rows), _m (its smallest document) and _same (a hash of its members).

    Keys are summed up in each task before they are shuffled. A key with more than one row in HOT_KEYS meets its rows by a
    broadcast, of HOT_KEYS keys at most, so that no key's rows are one task's.
    """
    members = F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("_doc")), F.bit_xor(F.xxhash64("_doc", F.lit(1))), F.min("_doc"))
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_doc").alias("_m"), members.alias("_same")).filter("_n > 1")
    counts = settled(counts, "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    is_hot = F.col("_n") * HOT_KEYS > total
    hot = F.broadcast(counts.filter(is_hot))
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(counts.filter(~is_hot), key))


def merged(rows: DataFrame) -> DataFrame:
    """_block, _doc, _n, _m of rows that ``met``: blocks with the same members are one."""
    return rows.select(F.col("_same").alias("_block"), "_doc", "_n", "_m").distinct()


def put_back(rows: DataFrame, nodes: DataFrame, texts: DataFrame, classes, k: int, num: int, den: int) -> DataFrame:
    """_key, _doc, _n, _m with the n-grams of large blocks behind all others in the order."""
    behind = None
    for _ in range(PUT_BACK):
        large = rows.filter(F.col("_n") > HOT)
        if large.isEmpty():
            break
        keys = large.select("_key").distinct()
        behind = settled(keys if behind is None else behind.unionByName(keys).distinct(), "put-back")
        moved = settled(large.select("_doc").distinct(), "moved")
        hot = behind.withColumn("_last", F.lit(1))

        def ordered(batches):
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for doc, data in zip(ids, found, strict=True):
                    s = np.frombuffer(data, np.int64)
                    fixed = {"_doc": doc, "_which": xxhash.xxh64_intdigest(data) >> 1, "_first": first_keys(len(s), num, den)}
                    for at in range(0, len(s), 100_000):
                        part = s[at : at + 100_000]
                        same = {n: pa.array(np.full(len(part), v, np.int64)) for n, v in fixed.items()}
                        yield pa.RecordBatch.from_pydict(same | {"_at": pa.array(np.arange(at, at + len(part))), "_key": pa.array(part)})

        grams = sets_of(texts, moved, classes, k).mapInArrow(tidy(ordered), "_doc long, _which long, _first long, _at long, _key long").join(hot, "_key", "left")
        turn = Window.partitionBy("_doc", "_which").orderBy(F.col("_last").asc_nulls_first(), "_at")
        first = grams.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= F.col("_first"))
        new = settled(first.select("_key", "_doc"), "keys")
        others = nodes.select("_doc", F.explode("_keys").alias("_key")).join(moved, "_doc", "left_anti")
        touched = marked(others, "_key", new.select("_key").distinct()).select("_key", "_doc")
        kept = rows.join(moved, "_doc", "left_anti").select("_key", "_doc")
        rows = settled(met(kept.unionByName(touched).unionByName(new).distinct(), ["_key"]), "blocks")
    return rows


def balls(blocks: DataFrame, points: DataFrame, num: int, den: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Split large blocks: (edges from hubs to all within their balls, blocks of bounded size for the rest)."""
    edges, rest = [], []
    table = levels_of(num, den)
    for _ in range(HUBS):
        if blocks.isEmpty():
            return edges, rest
        hubs = blocks.select("_m").distinct().join(points.toDF("_m", "_hub_size", "_hub"), "_m")
        sized = blocks.join(points, "_doc")
        ends = blocks.join(points.drop("_counts"), "_doc").groupBy("_block").agg(F.min("n_shingles").alias("_low"), F.max("n_shingles").alias("_high"))

        def work(columns):
            out = [[], [], [], [], []]
            for block, doc, hub, n, counts, hub_n, hub_counts, low, high in zip(*columns.values(), strict=True):
                groups = table[level_of(low, table)][1]
                gap = int(np.abs(folded(unpacked(counts, n, table), groups) - folded(unpacked(hub_counts, hub_n, table), groups)).sum())
                r = (den - num) * high // num
                for values, value in zip(out, (block, doc, hub, gap <= 2 * r, gap > r), strict=True):
                    values.append(value)
            return out

        seen = sized.join(ends, "_block").join(hubs, "_m").select("_block", "_doc", "_m", "n_shingles", "_counts", "_hub_size", "_hub", "_low", "_high")
        seen = settled(map_rows(seen, lambda: work, "_block long, _doc long, _m long, _in boolean, _out boolean"), "balls")
        edges.append(seen.filter(F.col("_in") & (F.col("_doc") != F.col("_m"))).select(F.col("_doc").alias("a"), F.col("_m").alias("b")))
        beyond = settled(merged(met(seen.filter("_out").select("_block", "_doc"), ["_block"])), "blocks")
        rest.append(beyond.filter(F.col("_n") <= HOT).select("_block", "_doc"))
        blocks = beyond.filter(F.col("_n") > HOT)
    tiles = F.ceil(F.col("_n") * 2 / HOT).cast("int")
    own = F.pmod(F.xxhash64("_doc", F.lit(7)), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.xxhash64("_block", F.least(own, t), F.greatest(own, t)))
    return edges, [*rest, blocks.select(F.explode(pairs).alias("_block"), "_doc")]


def families(nodes: DataFrame, texts: DataFrame, classes, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) whose components hold every link."""
    points = nodes.select("_doc", "n_shingles", "_counts")
    rows = settled(met(nodes.select("_doc", F.explode("_keys").alias("_key")), ["_key"]), "blocks")
    rows = put_back(rows, nodes, texts, classes, k, num, den)
    small = [merged(rows.filter(F.col("_n") <= HOT)).select("_block", "_doc")]
    large, edges = settled(merged(rows.filter(F.col("_n") > HOT)), "large"), []
    if not large.isEmpty():
        # the base is a little above den / num, so that rounding parts no linked pair by more than one range
        band = F.floor(F.log("n_shingles") / math.log(den / num * (1 + 1e-9))).cast("long")
        bands = large.join(points.drop("_counts"), "_doc").select("_block", F.explode(F.array(band, band - 1)).alias("_band"), "_doc")
        large = settled(merged(met(bands, ["_block", "_band"])), "bands")
        small.append(large.filter(F.col("_n") <= HOT).select("_block", "_doc"))
        edges, rest = balls(large.filter(F.col("_n") > HOT), points, num, den)
        small += rest
    blocks = small[0]
    for more in small[1:]:
        blocks = blocks.unionByName(more)

    def work(batches):
        def each():
            for g in grouped(batches, ["_block"]):
                if len(g["_doc"]) > 1:
                    ids = g["_doc"]
                    vectors = [unpacked(c, n, levels_of(num, den)) for c, n in zip(g["_counts"], g["n_shingles"], strict=True)]
                    yield [(ids[i], ids[j]) for i, j in forest(vectors, num, den)]

        yield from edge_batches(each())

    dealt = blocks.join(points, "_doc").repartition("_block").sortWithinPartitions("_block", "_doc")
    out = dealt.mapInArrow(tidy(work), "a long, b long")
    for more in edges:
        out = out.unionByName(more)
    return out


def links(texts: DataFrame, family: DataFrame, classes, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect the members of each family as their links do."""
    size = family.groupBy("_root").agg(F.count(F.lit(1)).alias("_n"), F.max("_doc").alias("_last"))
    member = settled(family.join(size, "_root"), "families")
    tiles = F.ceil(F.col("_n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("_doc", F.lit(9)), tiles).cast("int")
    hub = (F.col("_n") > TILE) & ((F.col("_doc") == F.col("_root")) | (F.col("_doc") == F.col("_last")))
    placed = member.select("_doc", "_root", F.when(hub, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(own)).alias("_tiles"))
    made = settled(sets_of(texts, member.select("_doc"), classes, k), "sets")
    sets = made.join(placed, "_doc")

    def verify(keys, label=None):
        def work(batches):
            def each():
                for g in grouped(batches, keys):
                    found = [np.frombuffer(b, np.uint64) for b in g["_shingles"]]
                    ids = g["_doc"]
                    yield [(ids[i], ids[j]) for i, j in verified(found, num, den, g[label] if label else None)]

            yield from edge_batches(each())

        return work

    dealt = sets.select("_root", F.explode("_tiles").alias("_tile"), "_doc", "_shingles").repartition("_root", "_tile").sortWithinPartitions("_root", "_tile", "_doc")
    first = settled(dealt.mapInArrow(tidy(verify(["_root", "_tile"])), "a long, b long"), "links")
    large = member.filter(F.col("_n") > TILE).select("_doc", "_root", "_n")
    if large.isEmpty():
        return first
    # families of several tiles: what is not in the largest component meets every tile
    parts = large.join(components(first).withColumnRenamed("_root", "_part"), "_doc", "left").withColumn("_part", F.coalesce("_part", "_doc"))
    counts = parts.groupBy("_root", "_part").agg(F.count(F.lit(1)).alias("_c"))
    most = counts.groupBy("_root").agg(F.max(F.struct("_c", "_part")).alias("_top"), F.count(F.lit(1)).alias("_parts"), F.sum("_c").alias("_all"))
    most = most.filter("_parts > 1").select("_root", F.col("_top._part").alias("_main"), (F.col("_all") - F.col("_top._c")).alias("_rest"))
    if most.isEmpty():
        return first
    parts = parts.join(most, "_root").withColumn("_minor", F.col("_part") != F.col("_main"))
    sheaves = F.ceil(F.col("_rest") / TILE).cast("int")
    sheaf = F.pmod(F.xxhash64("_doc", F.lit(10)), sheaves).cast("int")
    both = parts.select(
        "_doc", "_root", "_part",
        F.array_distinct(F.concat(
            F.transform(F.sequence(F.lit(0), sheaves - 1), lambda s: F.struct(own.alias("_tile"), s.alias("_sheaf"))),
            F.when(F.col("_minor"), F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(t.alias("_tile"), sheaf.alias("_sheaf")))).otherwise(F.array().cast("array<struct<_tile:int,_sheaf:int>>")),
        )).alias("_cells"),
    )

    cells = made.join(both, "_doc").select("_root", F.explode("_cells").alias("_cell"), "_doc", "_part", "_shingles").select("_root", "_cell._tile", "_cell._sheaf", "_doc", "_part", "_shingles")
    cells = cells.repartition("_root", "_tile", "_sheaf").sortWithinPartitions("_root", "_tile", "_sheaf", "_doc")
    return first.unionByName(settled(cells.mapInArrow(tidy(verify(["_root", "_tile", "_sheaf"], "_part")), "a long, b long"), "links"))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two documents link when den * |A & B| >= num * |A | B| over their sets of k-word shingles. Null texts and texts
    without words have an empty set and link with nothing. Ids are integers; rows that repeat an id are one node with
    the links of any of them, and a row whose id is null has no component. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    classes = docs.sparkSession.sparkContext.broadcast(word_classes(rows))  # ONE_IN words at most
    signed = signatures(rows, classes, k, num, den)
    light = signed.select("_doc", "n_shingles", "_set")
    known = signed.filter(F.col("_doc").isNotNull() & (F.col("n_shingles") > 0))
    first = F.min_by(F.struct("n_shingles", "_counts", "_keys"), "_doc").alias("_node")
    nodes = settled(known.groupBy("_set").agg(F.min("_doc").alias("_doc"), first).select("_set", "_doc", "_node.*"), "nodes")
    reps = nodes.select("_set", F.col("_doc").alias("_rep"))
    known = known.select("_doc", "_set")
    texts = rows.filter(F.col("_doc").isNotNull())
    family = components(families(nodes, texts, classes, k, num, den))
    found = links(texts, family, classes, k, num, den)
    stars = components(found)
    mapped = known.join(reps, "_set").join(stars.withColumnRenamed("_doc", "_rep"), "_rep", "left")
    roots = mapped.groupBy("_doc").agg(F.min(F.coalesce("_root", "_rep")).alias("_root"))
    out = light.join(roots, "_doc", "left")
    return out.select(F.col("_doc").alias(id_col), "n_shingles", F.coalesce("_root", "_doc").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest of their component, with their own columns."""
    kept = join(docs, k, num, den, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_kept"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
