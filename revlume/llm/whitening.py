"""Embedding whitening by spectral divide-and-conquer with QDWH polar decompositions.

Two passes over the vectors give the covariance: exact sums first, then products
of centred entries, summed in each task and then by Spark for each entry of the
matrix (its size depends on the dimensions alone). The symmetric matrix is parted
on the driver: the polar factor of ``V - shift`` (dynamically weighted Halley
iteration, by QR factors) is the matrix sign, so that half of it plus the identity
is the projector onto the eigenvectors above the shift. Its range and the range of
the rest are two invariant subspaces with blocks of their own, which are parted
again until each holds one direction. The directions are sent to all tasks, where
vectors are centred, projected and scaled.

Entries are taken as integers (``floor(1024 * c) + 100000``), so sums and
deviations are exact.

Nulls and edges: rows whose vector is null, has a null or non-finite entry, or is
of another length than most (of equally frequent lengths the longer one counts)
take no part; scaled entries beyond 2^52 count as 2^52; rows with equal or null ids are rows of their own; a component
without variance (rounding apart) can't be scaled and has no rows, so vectors that
are all equal, or a single one, give none; equal eigenvalues have any orthonormal
directions of their subspace; an exact deviation beyond 64 bits is null; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_EPS = np.finfo(np.float64).eps
#: Scaled entries beyond this take its value.
_LARGEST = 2.0**52
#: Rows whose products are formed at a time.
_ROWS = 4096


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH: each step's weights make the
    smallest singular value (at least ``low`` of the largest) grow as fast as a Halley step can."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    low = _EPS / n
    eye = np.eye(n)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        p = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        ortho, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
        new = q / r * x + (p - q / r) / np.sqrt(r) * ortho[:n] @ ortho[n:].T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if moved <= np.cbrt(4 * _EPS) and 1 - low < 10 * _EPS:
            break
    return x


def _parted(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Orthonormal bases of the eigenvectors above and below the shift, and what is left between them."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < n:
        return np.zeros((n, 0)), np.zeros((n, 0)), np.inf
    # fixed random vectors, brought into the projector's range twice
    above = np.random.default_rng(n).normal(size=(n, rank))
    for _ in range(2):
        above, _ = np.linalg.qr(projector @ above)
    full, _ = np.linalg.qr(np.hstack([above, np.eye(n)]))
    above, below = full[:, :rank], full[:, rank:n]
    return above, below, float(np.linalg.norm(below.T @ a @ above))


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    size = np.linalg.norm(v)
    values, vectors = [], []
    todo = [(v, np.eye(len(v)))]
    while todo:
        a, basis = todo.pop()
        n = len(a)
        mean = np.trace(a) / n if n else 0.0
        spread = np.linalg.norm(a - mean * np.eye(n)) if n else 0.0
        if n <= 1 or spread <= 4 * _EPS * size:  # one direction, or equal eigenvalues
            values += np.diag(a).tolist()
            vectors += list(basis.T)
            continue
        # the mean lies between the least and the largest eigenvalue; where one of them is too near
        # to it to tell the sides apart, other shifts in between do
        shifts = mean + spread / np.sqrt(n) * np.array([0.0, 0.11, -0.13, 0.29, -0.31, 0.53, -0.47, 0.71, -0.73])
        tried = []
        for shift in shifts:
            above, below, left = _parted(a, shift)
            tried.append((left, above, below))
            if left <= 20 * _EPS * size:
                break
        left, above, below = min(tried, key=lambda t: t[0])
        if not np.isfinite(left):
            raise ArithmeticError("no shift parts the spectrum")
        for side in (above, below):
            part = side.T @ a @ side
            todo.append(((part + part.T) / 2, basis @ side))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).T.reshape(len(v), len(v))[:, order]


def _whole(batch: pd.DataFrame, dims: int) -> np.ndarray:
    """The batch's vectors as integers (n x dims)."""
    if not len(batch):
        return np.zeros((0, dims), np.int64)
    entries = np.floor(SCALE * np.stack(batch["vector"].to_numpy()).astype(np.float64))
    return np.clip(entries, -_LARGEST, _LARGEST).astype(np.int64) + SHIFT


def fit_list(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, but for their length."""
    finite = ~F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite).select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("vector"))


class Whitener:
    """Means, directions and scales that turn integer vectors into uncorrelated components of variance one."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray):
        self.n, self.sums, self.dims = n, sums, len(sums)
        values, directions = eigenvectors(covariance)
        self.trace = float(np.trace(covariance))
        self.top = int((values[:COMPONENTS] > self.dims * _EPS * max(values[0], 0.0)).sum())
        self.values = values[: self.top]
        self.directions = directions[:, : self.top]
        # the mean in two parts: x - whole is exact
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([s % n for s in sums], np.float64) / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2 by row; None beyond 64 bits."""
        largest = self.n * (int(np.abs(x - self.whole).max(initial=0)) + 1)
        kind = np.int64 if self.dims * largest**2 < 1 << 63 else object
        off = self.n * (x - self.whole).astype(kind) - np.array([s % self.n for s in self.sums], kind)
        return [int(t) if t < 1 << 63 else None for t in (off * off).sum(axis=1).tolist()]


def _sums(batches: Iterator[pd.DataFrame], dims: int, centred) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of what ``centred`` gives for each row."""
    total, product = 0.0, 0.0
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            y = centred(_whole(batch.iloc[at : at + _ROWS], dims))
            total, product = total + y.sum(axis=0), product + y.T @ y
    return total, product


def _second_moments(rows: DataFrame, dims: int, width: int, centred) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and the matrix of products over all rows: summed in tasks, then entry by entry in Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, product = _sums(batches, dims, centred)
        if isinstance(product, float):
            return
        i, j = np.divmod(np.arange(width * width), width)
        yield pd.DataFrame({"i": np.append(i, np.full(width, -1)), "j": np.append(j, np.arange(width)), "value": np.append(product.ravel(), total)})

    found = rows.mapInPandas(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()  # width * (width + 1) rows
    total, product = np.zeros(width), np.zeros((width, width))
    mean = found["i"].to_numpy() < 0
    total[found["j"].to_numpy()[mean]] = found["value"].to_numpy()[mean]
    product[found["i"].to_numpy()[~mean], found["j"].to_numpy()[~mean]] = found["value"].to_numpy()[~mean]
    return total, product


def fit(rows: DataFrame) -> tuple[Whitener | None, DataFrame]:
    """The whitener of all rows of ``fit_list``, and the rows of its length."""
    lengths = rows.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return None, rows
    dims, n = lengths[0]
    rows = rows.where(F.size("vector") == dims)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(dims, object)
        for batch in batches:
            total = total + _whole(batch, dims).sum(axis=0)
        yield pd.DataFrame({"j": np.arange(dims), "s": [str(t) for t in total]})

    added = rows.mapInPandas(add, "j int, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).collect()  # dims rows
    sums = [int(s) for _, s in sorted((r["j"], r["s"]) for r in added)]
    whole, part = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.float64) / n
    _, product = _second_moments(rows, dims, dims, lambda x: (x - whole).astype(np.float64) - part)
    return Whitener(n, sums, (product + product.T) / (2 * n)), rows


def whiten(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, rows = fit(fit_list(vectors, vector))
    if model is None or not model.top:
        return vectors.sparkSession.createDataFrame([], schema)
    total, product = _second_moments(rows, model.dims, model.top, model.whiten)
    error = float(np.abs(product / model.n - np.outer(total, total) / model.n**2 - np.eye(model.top)).max())
    explained = model.values / model.trace
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                some = batch.iloc[at : at + _ROWS]
                x = _whole(some, m.dims)
                rows_each = np.repeat(np.arange(len(some)), m.top)
                deviation = pd.Series(m.deviations(x), dtype="Int64")
                yield pd.DataFrame(
                    {
                        "vec_id": some["vec_id"].astype("Int64").to_numpy()[rows_each], "component": np.tile(np.arange(1, m.top + 1), len(some)), "n": m.n,
                        "deviation": deviation.to_numpy()[rows_each], "whitened": m.whiten(x).ravel(), "explained": np.tile(explained, len(some)), "identity_error": error,
                    }
                )

    return rows.mapInPandas(apply, schema)
