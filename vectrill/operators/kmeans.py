"""k-means: Euclidean, spherical and balanced. Lloyd's steps are one scan and K sums each; only centroids reach the driver.

Ties go to the lowest cluster. Training is seeded and so repeatable. Balancing is sequential by nature and runs on the
driver over at most ``BALANCE_ROWS`` vectors; more are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import IP, L2, matrix
from .reduce import sample

BALANCE_ROWS, EPS = 1_000_000, 1 / 1024


def nearest(m: np.ndarray, centroids: np.ndarray, k: int, distance: str) -> np.ndarray:
    """Numbers of the k nearest centroids of each row, nearest first."""
    score = -(m @ centroids.T)
    if distance == L2:
        score = 2 * score + (centroids * centroids).sum(1)
    if k == 1:
        return score.argmin(1)[:, None]
    if k < len(centroids) // 4:  # the k least and all that tie with them, then in order
        edge = np.partition(score, k - 1, axis=1)[:, k - 1 : k]
        score = np.where(score <= edge, score, np.inf)
    return np.argsort(score, axis=1, kind="stable")[:, : min(k, len(centroids))]


class KMeans:
    """``train`` once, then ``assign`` any vectors of the same width."""

    def __init__(self, n_clusters: int, iters: int = 25, samples_per_cluster: int = 256, distance: str = IP, balanced: bool = False, max_balance_diff: int = 16, penalty_factor: float = 1.4, seed: int = 0) -> None:
        if min(n_clusters, iters, samples_per_cluster, max_balance_diff) < 1 or penalty_factor <= 1:
            raise ValueError("counts must be positive and the penalty factor above 1")
        if distance not in (IP, L2):
            raise ValueError("distance must be ip or l2")
        self.n_clusters, self.iters, self.per_cluster, self.distance = n_clusters, iters, samples_per_cluster, distance
        self.balanced, self.max_balance_diff, self.penalty_factor, self.seed = balanced, max_balance_diff, penalty_factor, seed
        self._centroids: np.ndarray | None = None

    @property
    def trained(self) -> bool:
        return self._centroids is not None

    @property
    def centroids(self) -> np.ndarray:
        if not self.trained:
            raise RuntimeError("the clustering isn't trained")
        return self._centroids

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def train(self, points: DataFrame, subsample: bool = True) -> DataFrame:
        """(id, cluster_id) of points (id, v)."""
        if self.trained:
            raise RuntimeError("the clustering is trained already")
        points = points.where("v IS NOT NULL").select("id", "v")
        n = points.count()
        if n < self.n_clusters:
            raise RuntimeError("fewer points than clusters")
        if self.balanced:
            return self._train_balanced(points, n)
        few = self.n_clusters * self.per_cluster
        taught = points
        if subsample and few < n:  # about few rows by a hash of the id: no sort, no single task
            taught = points.where(F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(1 << 30)) < int(few / n * (1 << 30)))
        taught = taught.cache()
        start = sample(points, self.n_clusters, seed=self.seed).toArrow().combine_chunks().to_batches()[0]
        centroids = self._finished(matrix(start.column(1)))
        for i in range(self.iters):
            sums, counts = step(taught, centroids, self.distance)
            centroids = self._split(np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids), counts, i)
        taught.unpersist()
        self._centroids = centroids
        return self.assign(points, 1).select("id", "cluster_id")

    def _finished(self, c: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(c, axis=1, keepdims=True)
        return c / np.where(n == 0, 1, n) if self.distance == IP else c

    def _split(self, c: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
        """Empty clusters take one half of a large one, chosen by size."""
        rng, counts = np.random.default_rng([self.seed, seed]), counts.astype(float)
        sign = np.where(np.arange(c.shape[1]) % 2, 1 - EPS, 1 + EPS)
        for e in np.flatnonzero(counts == 0):
            p = np.maximum(counts - 1, 0)
            if not p.sum():
                break
            big = int(rng.choice(len(c), p=p / p.sum()))
            c[e], c[big] = c[big] * sign, c[big] * (2 - sign)
            counts[e] = counts[big] / 2
            counts[big] /= 2
        return self._finished(c)

    def assign(self, points: DataFrame, k: int = 1) -> DataFrame:
        """id, rank, cluster_id of the k nearest clusters (at most all)."""
        c, distance = self.centroids, self.distance
        if k < 1:
            raise ValueError("k must be positive")

        def run(batches):
            for b in batches:
                if b.num_rows:
                    m = matrix(b.column(1))
                    if m.shape[1] != c.shape[1]:
                        raise ValueError(f"vectors have {m.shape[1]} components, centroids {c.shape[1]}")
                    near = nearest(m, c, k, distance)
                    w = near.shape[1]
                    yield pa.RecordBatch.from_pydict({"id": b.column(0).take(pa.array(np.repeat(np.arange(len(m)), w))), "rank": np.tile(np.arange(1, w + 1, dtype=np.int32), len(m)), "cluster_id": near.ravel().astype(np.int32)})

        return points.where("v IS NOT NULL").select(F.col("id").cast("long"), "v").mapInArrow(run, "id long, rank int, cluster_id int")

    def cost(self, points: DataFrame) -> float:
        """The mean of the squared distances of points (v) to their nearest centroids, or of their inner products with them."""
        c, distance = self.centroids, self.distance

        def run(batches):
            total, n = 0.0, 0
            for b in batches:
                if b.num_rows:
                    m = matrix(b.column(0), c.shape[1])
                    near = c[nearest(m, c, 1, distance)[:, 0]]
                    total, n = total + float(((m - near) ** 2).sum() if distance == L2 else (m * near).sum()), n + len(m)
            yield pa.RecordBatch.from_pydict({"total": [total], "n": [n]})

        r = points.where("v IS NOT NULL").select("v").mapInArrow(run, "total double, n long").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).first()
        return r["t"] / r["n"] if r["n"] else 0.0

    def _train_balanced(self, points: DataFrame, n: int) -> DataFrame:
        if n > BALANCE_ROWS:
            raise ValueError(f"balancing takes at most {BALANCE_ROWS} vectors")
        got = points.orderBy("id").toArrow()
        ids, m = got["id"].combine_chunks(), matrix(got["v"])
        rng = np.random.default_rng(self.seed)
        c = self._finished(m[np.sort(rng.choice(n, self.n_clusters, replace=False))].copy())
        for i in range(self.iters):
            own = nearest(m, c, 1, self.distance)[:, 0]
            counts = np.bincount(own, minlength=len(c))
            sums = by_cluster(m, own, len(c))
            c = self._split(np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c), counts, i)
        own, self._centroids = balance(m, c, self.distance, self.max_balance_diff, self.penalty_factor)
        return points.sparkSession.createDataFrame(pa.table({"id": ids, "cluster_id": own.astype(np.int32)}))


def balance(m: np.ndarray, c: np.ndarray, distance: str, most_diff: int, factor: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Assignments whose cluster sizes differ by ``most_diff`` at most: sizes cost, and the price rises until they fit."""
    cost = -(m @ c.T) if distance == IP else (c * c).sum(1)[None, :] - 2 * (m @ c.T)
    own = cost.argmin(1)
    size = np.bincount(own, minlength=len(c)).astype(float)
    price = 1e-4 * float(np.ptp(cost)) / max(len(m) / len(c), 1) or 1e-9
    for _ in range(rounds):
        for i in range(len(m)):
            size[own[i]] -= 1
            own[i] = int(np.argmin(cost[i] + price * size))
            size[own[i]] += 1
        if size.max() - size.min() <= most_diff:
            break
        price *= factor
    else:
        raise RuntimeError(f"the sizes of clusters still differ by {int(size.max() - size.min())} after {rounds} rounds")
    sums = by_cluster(m, own, len(c))
    c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    if distance == IP:
        n = np.linalg.norm(c, axis=1, keepdims=True)
        c = c / np.where(n == 0, 1, n)
    return own, c


def by_cluster(m: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The sum of each cluster's rows."""
    order = np.argsort(own, kind="stable")
    found, first = np.unique(own[order], return_index=True)
    out = np.zeros((k, m.shape[1]))
    if len(found):
        out[found] = np.add.reduceat(m[order], first, axis=0)
    return out


def step(points: DataFrame, centroids: np.ndarray, distance: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points (v) nearest to each centroid."""

    def run(batches):
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(0), centroids.shape[1])
                own = nearest(m, centroids, 1, distance)[:, 0]
                sums += by_cluster(m, own, len(sums))
                counts += np.bincount(own, minlength=len(counts))
        use = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster_id": use.astype(np.int32), "n": counts[use], "total": pa.array(list(sums[use]), pa.list_(pa.float64()))})

    def add(key, got):
        t = matrix(got["total"].combine_chunks())
        return pa.table({"cluster_id": pa.array([key[0].as_py()], pa.int32()), "n": [sum(got["n"].to_pylist())], "total": [t.sum(0).tolist()]})

    shape = "cluster_id int, n long, total array<double>"
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    for r in points.where("v IS NOT NULL").select("v").mapInArrow(run, shape).groupBy("cluster_id").applyInArrow(add, shape).collect():
        sums[r["cluster_id"]], counts[r["cluster_id"]] = r["total"], r["n"]
    return sums, counts
