"""Second moments, principal directions (uncentred), rotations and truncated singular vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import matrix


#: Matrices with more rows and columns than this are sketched first.
WIDE = 2048


def sample(df: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the same for the same seed."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def second_moment(vectors: DataFrame, column: str = "v") -> np.ndarray:
    """Sum of outer products: a matrix for each task, added on the driver."""

    def run(batches):
        out = None
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(0))
                out = m.T @ m if out is None else out + m.T @ m
        if out is not None:
            yield pa.RecordBatch.from_pydict({"row": np.arange(len(out)), "values": out.tolist()})

    parts = vectors.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "row long, values array<double>")
    # rows of all tasks meet by number, component by component
    sums = parts.select("row", F.posexplode("values").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x")).toArrow()
    d = 1 + max(sums["row"].to_pylist(), default=-1)
    out = np.zeros((d, d))
    out[sums["row"].to_numpy(), sums["col"].to_numpy()] = sums["x"].to_numpy()
    return out


def principal_components(moment: np.ndarray, s: int) -> np.ndarray:
    """The s eigenvectors of largest eigenvalues, as columns; signs are fixed by the largest entry."""
    _, vectors = np.linalg.eigh(moment)
    top = vectors[:, ::-1][:, :s]
    return top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])


def rotation(n: int, seed: int = 0, keep_first: bool = False) -> np.ndarray:
    """A random orthogonal matrix; with ``keep_first`` the first axis stays."""
    m = n - keep_first
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((m, m)))[0] if m else np.empty((0, 0))
    if not keep_first:
        return q
    out = np.eye(n)
    out[1:, 1:] = q
    return out


def compute_v(y: np.ndarray, r: int) -> np.ndarray:
    """The first r right singular vectors as columns; missing ones are zero. Large matrices by subspace iteration."""
    if not np.isfinite(y).all():
        raise ValueError("values must be numbers")
    if min(y.shape) > WIDE and r + 10 < min(y.shape) // 4:
        return randomized_v(y, r)
    vt = np.linalg.svd(y, full_matrices=False)[2][:r]
    return np.pad(vt, ((0, r - len(vt)), (0, 0))).T


def randomized_v(y: np.ndarray, r: int, oversample: int = 10, rounds: int = 4, seed: int = 0) -> np.ndarray:
    """The same by subspace iteration, for wide matrices."""
    q = np.random.default_rng(seed).standard_normal((y.shape[1], min(r + oversample, *y.shape)))
    for _ in range(rounds + 1):
        q = np.linalg.qr(y.T @ (y @ q))[0]
    return q @ compute_v(y @ q, min(r, q.shape[1]))
