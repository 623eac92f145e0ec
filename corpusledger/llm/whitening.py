"""Whitening of embeddings by shifted CholeskyQR.

The distinct vectors are a tall matrix whose rows lie with the executors. A Gram pass sums the products of its centred rows,
task by task and then by place in the matrix; the driver sees one square matrix of the vectors' length. Its Cholesky factor R
orthogonalises the rows by a triangular solve. The first Gram matrix is shifted, so that the factor exists whatever the
condition; the later passes measure what the rows before them became and remove what orthogonality they lack. The
factors compose to one R with the singular values and right singular vectors of all rows, and the SVD of R gives the
whitening components. No row leaves its executor but for the distinct.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Steps of a unit in which a vector's entries are rounded down; entries from LARGEST on do not fit a long.
SCALE, LARGEST = 256, float(1 << 54)
#: Gram passes; the largest relative shift; what counts as a zero singular value, relative to the largest.
PASSES, MOST_SHIFT, ZERO = 3, 1e-6, 1e-12


@dataclass
class Whitening:
    """Mean as sums over n rows, unit components as columns by falling eigenvalue, eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows; NaN where a component has no variance."""
        scale = np.array([e**-0.5 if e > 0 else np.nan for e in self.eigenvalues])
        return (x - self.mean) @ self.components * scale


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id and _x (array of long) of the vectors that take part: not null, not empty, no entry null or not finite."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("_id"), vec.alias("_vec"), bad.alias("_bad")).filter("_vec IS NOT NULL AND NOT _bad AND size(_vec) > 0")
    fits = F.assert_true(F.forall("_vec", lambda c: F.abs(c) < LARGEST), F.lit("an entry is too large for a long"))
    return rows.filter(fits.isNull()).select("_id", F.transform("_vec", lambda c: F.floor(c * SCALE).cast("long")).alias("_x"))


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(batch.schema.names.index(name)).flatten().to_numpy().reshape(-1, dim)


def _sums(rows: DataFrame, dim: int, size: int, make, kind: str) -> np.ndarray:
    """Sums over all rows of what ``make(matrix of a batch)`` returns, ``size`` numbers: added up in each task, then by place."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch, "_x", dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.ravel())], ["_at", "_v"])

    found = rows.select("_x").mapInArrow(run, f"_at long, _v {kind}").groupBy("_at").agg(F.sum("_v").alias("_v")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in found:
        out[r["_at"]] = r["_v"]
    return out


def fit(rows: DataFrame, dim: int, most: int | None = None) -> Whitening | None:
    """Components of distinct rows _x (array of long, ``dim`` entries each), the first ``most``; None without rows.

    Sums are exact. A component whose singular value is below ZERO of the largest has the eigenvalue 0.
    """
    halves = _sums(rows, dim, 2 * dim + 1, lambda x: np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), [len(x)]]), "long")
    n = int(halves[-1])
    if not n:
        return None
    sums = [(int(h) << 32) + int(w) for h, w in zip(halves[:dim], halves[dim : 2 * dim], strict=True)]
    mean, factors = np.array([s / n for s in sums]), []

    def gram(x):
        q = x - mean
        for r in factors:
            q = np.linalg.solve(r.T, q.T).T
        return q.T @ q

    for turn in range(PASSES):
        g = _sums(rows, dim, dim * dim, gram, "double").reshape(dim, dim)
        g = (g + g.T) / 2
        if turn == 0:
            trace = float(np.trace(g)) / n
            if trace == 0:
                break
        shift = min(MOST_SHIFT, 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps) * np.linalg.norm(g, 2)
        try:
            factors.append(np.linalg.cholesky(g + shift * np.eye(dim) * (turn == 0)).T)
        except np.linalg.LinAlgError:  # rows without full rank
            factors.append(np.linalg.cholesky(g + shift * np.eye(dim)).T)
    whole = np.eye(dim) if factors else np.zeros((dim, dim))
    for r in factors:
        whole = r @ whole
    _, singular, right = np.linalg.svd(whole)
    singular[singular <= ZERO * singular[0]] = 0
    kept = min(dim, most or dim)
    out = Whitening(n, sums, right[:kept].T.copy(), singular[:kept] ** 2 / n, trace)
    live = np.flatnonzero(out.eigenvalues > 0)
    if len(live):
        middle = _sums(rows, dim, len(live), lambda x: out.project(x)[:, live].sum(0), "double") / n

        def products(x):
            w = out.project(x)[:, live] - middle
            return w.T @ w

        spread = _sums(rows, dim, len(live) ** 2, products, "double").reshape(len(live), -1) / n
        out.identity_error = float(np.abs(spread - np.eye(len(live))).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact sums over entries of (n * x - sum)^2; an error where one does not fit a long."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        gaps = n * x - np.array(sums, np.int64)
        return (gaps * gaps).sum(1)
    gaps = n * x.astype(object) - np.array(sums, object)
    return np.array([int(v) for v in (gaps * gaps).sum(1)], np.int64)


def whiten(vectors: DataFrame, most: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors null, empty, or with an entry null or not finite take no part; nor do those of another length than most have
    (of lengths held by equally many, the longer). A repeated vector counts once in the fit and each of its rows is
    returned, whatever its id, null ids too. Where a component has no variance, ``whitened`` is null and ``explained`` 0, or null
    where no component has any; ``identity_error`` is over the other components. Entries or deviations that do not fit a long are errors.
    An empty table, or one without usable vectors, gives an empty result; other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    fields = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = settled(integers(vectors, id_col, vec_col), "integers")
    common = rows.groupBy(F.size("_x").alias("_dim")).count().orderBy(F.desc("count"), F.desc("_dim")).limit(1).collect()
    if not common:
        return vectors.sparkSession.createDataFrame([], fields)
    dim = common[0]["_dim"]
    rows = rows.filter(F.size("_x") == dim)
    found = fit(settled(rows.select("_x").distinct(), "fit"), dim, most)
    k = len(found.eigenvalues)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, at = _matrix(batch, "_x", dim), pa.array(np.repeat(np.arange(batch.num_rows), k))
            whitened, size = found.project(x).ravel(), batch.num_rows * k
            explained = np.tile(found.eigenvalues / found.trace if found.trace else np.full(k, np.nan), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(size, found.n)),
                    pa.array(np.repeat(deviations(x, found.n, found.sums), k)),
                    pa.array(whitened, from_pandas=True),
                    pa.array(explained, from_pandas=True),
                    pa.array([found.identity_error] * size, pa.float64()),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, fields)
