"""Approximate nearest neighbours by collision counting.

Rows lie in blocks of bounded size. Each block projects its vectors on random lines and keeps every line's values as a
sorted array. A query opens a window around its own value on each line and widens all windows together (virtual
rehashing); a vector that falls into enough windows has collided often enough and its true distance is computed. The
search in a block ends when the k-th true distance is within the radius that the windows stand for. The best of all
blocks meet by query.

The lines come in frames: the lines of one frame are at right angles, so that the squared gaps on them sum to the squared
distance and counts of collisions vary much less than on independent lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Vectors and queries of a block.
BLOCK, QUERY_BLOCK = 8192, 4096
#: Lines; collisions that make a candidate; half the width of a window at radius 1 (a vector at the radius falls into 0.81 of the
#: windows); factor by which windows widen; vectors whose own neighbours tell where a block's search begins.
LINES, COLLISIONS, HALF, WIDEN, PROBES = 128, 101, 1.3, 1.05, 8
SEED = 5


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id, _vec (array of double), _dim of the vectors that take part: none null, empty, zero or with a part null or not finite.

    Of rows that repeat an id the shortest vector stays, of equal lengths the first in order.
    """
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("_id"), vec.alias("_vec"), bad.alias("_bad"))
    rows = rows.filter((~F.col("_bad")) & F.exists("_vec", lambda x: x != 0))
    one = rows.groupBy("_id").agg(F.min(F.struct(F.size("_vec").alias("_dim"), "_vec")).alias("_least"))
    return one.select("_id", "_least._vec", "_least._dim")


def lines(dim: int, count: int = LINES, seed: int = SEED) -> np.ndarray:
    """Columns are lines, in frames at right angles; a gap of length s has the mean square s * s on them."""
    pick = np.random.default_rng([seed, dim])
    frames = [np.linalg.qr(pick.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(frames, axis=1)[:, :count] * np.sqrt(dim)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    gaps = vectors - query
    return np.sqrt((gaps * gaps).sum(1))


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.lines = ids, vectors, lines(vectors.shape[1])
        values = vectors @ self.lines
        order = np.argsort(values, axis=0, kind="stable").T
        self.values, self.order = np.take_along_axis(values.T, order, axis=1), order.astype(np.int32)
        # where searches begin: below what some vectors need for their own neighbours; it sets the cost, not the result
        probes = [np.partition(distances(vectors, vectors[i]), min(k, len(ids) - 1))[min(k, len(ids) - 1)] for i in np.linspace(0, len(ids) - 1, PROBES).astype(int)]
        self.radius = max(0.9 * min(probes), float(np.abs(values).max()) * 1e-6, 1e-300)

    def search(self, query: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(positions, distances) of the k nearest found, nearest first, ties to the smaller id; how many were verified.

        Every vector that collides often enough at a radius is verified, so equal vectors are all seen or none is.
        """
        at = query @ self.lines
        n, radius = len(self.ids), self.radius
        counts, seen = np.zeros(n, np.int64), self.ids == own
        low = high = np.array([v.searchsorted(x) for v, x in zip(self.values, at, strict=True)])
        rest = n - int(seen.sum())
        places, far = np.zeros(0, np.int64), np.zeros(0)
        while len(places) < rest:
            reach = HALF * radius
            new_low = np.minimum([v.searchsorted(x) for v, x in zip(self.values, at - reach, strict=True)], low)
            new_high = np.maximum([v.searchsorted(x, "right") for v, x in zip(self.values, at + reach, strict=True)], high)
            parts = [o[a:b] for o, a, b in zip(self.order, new_low, low, strict=True)] + [o[a:b] for o, a, b in zip(self.order, high, new_high, strict=True)]
            counts += np.bincount(np.concatenate(parts), minlength=n)
            low, high = new_low, new_high
            found = np.flatnonzero((counts >= COLLISIONS) & ~seen)
            if len(found):
                seen[found] = True
                places, far = np.concatenate([places, found]), np.concatenate([far, distances(self.vectors[found], query)])
            if len(places) >= k and np.partition(far, k - 1)[k - 1] <= radius:
                break
            radius = radius * WIDEN if ((low > 0) | (high < n)).any() else np.inf
        best = np.lexsort((self.ids[places], far))[:k]
        return places[best], far[best], len(places)


FOUND = "query_id long, vec_id long, score double, n_verified long"


def _search_block(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(vectors) and len(queries):
        vectors = vectors.sort_values("_id", kind="stable")
        index = Index(vectors["_id"].to_numpy(), np.stack(vectors["_vec"].to_numpy()).astype(np.float64), k)
        for own, query in zip(queries["_id"].to_numpy(), queries["_vec"].to_numpy(), strict=True):
            places, far, many = index.search(np.asarray(query, np.float64), own, k)
            # the count stands on the first row of a block
            out.append(pd.DataFrame({"query_id": own, "vec_id": index.ids[places], "score": far, "n_verified": [many] * (len(far) > 0) + [0] * (len(far) - 1)}))
    return pd.concat(out) if out else pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in ("query_id", "vec_id", "score", "n_verified")})


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query by Euclidean distance: query_id, rank (from 1), vec_id, score, n_verified.

    ``n_verified`` is how many vectors the query's true distance was computed to, over all blocks.

    Ids are integers. A query's own row takes no part; ties go to the smaller id; fewer candidates than k give all of
    them. Vectors that are null, empty, zero or have a part that is null or not finite take no part, as queries neither;
    vectors of different length are never compared. Of rows that repeat an id one counts (``usable``). Empty tables give an
    empty result; other columns are ignored.

    Every block of rows meets every block of queries, each pair in one task of bounded size; the queries are a stated
    set, not all rows.
    """
    rows = settled(usable(vectors, id_col, vec_col), "vectors")
    asked = settled(usable(queries, id_col, vec_col), "queries")
    n, q = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-q // QUERY_BLOCK))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")).withColumn("_q", each(query_blocks))
    right = asked.withColumn("_q", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("_b", each(blocks))
    pair = ["_dim", "_b", "_q"]

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _search_block(a, b, k)

    found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(work, FOUND)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    best = best.withColumn("n_verified", F.sum("n_verified").over(Window.partitionBy("query_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_verified")
