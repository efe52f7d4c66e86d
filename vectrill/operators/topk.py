"""The k rows of least value in each group: ordered by (value, id), ranks from 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, group: str, value: str, item: str, k: int) -> DataFrame:
    """A window with a limit, which Spark applies before and after the exchange."""
    order = Window.partitionBy(group).orderBy(value, item)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def padded(df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k rows for each query: missing ones have id -1 and an infinite distance."""
    all_ranks = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return all_ranks.join(df, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def least(scores: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least of each row, and of all within ``slack`` of the k-th."""
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    edge = np.partition(scores, k - 1, axis=1)[:, k - 1 : k]
    return np.nonzero(scores <= edge + slack)


class Kept:
    """The k rows of least (value, id) for each of n numbered queries, from tiles of candidates. What can't be among them is
    dropped as it comes, and about 2 n k rows are held at most, besides one tile's."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k, self.edge = n, k, np.full(n, np.inf)  # edge: each query's k-th value so far
        self.rows, self.new, self.waiting = tuple(np.empty(0, t) for t in (np.int64, np.int64, float, float)), [], 0

    def near(self, scores: np.ndarray, queries: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the scores, a row for each of ``queries``, that may be among the least; infinite ones never are."""
        edge = self.edge[queries]
        if scores.shape[1] > self.k and np.isinf(edge).any():
            edge = np.minimum(edge, np.partition(scores, self.k - 1, axis=1)[:, self.k - 1])
        return np.nonzero((scores <= (edge + slack)[:, None]) & (scores < np.inf))

    def add(self, query: np.ndarray, item: np.ndarray, value: np.ndarray, other: np.ndarray) -> None:
        self.new.append((query, item, value, other))
        self.waiting += len(query)
        if self.waiting > max(len(self.rows[0]), 1 << 16):
            self.cut()

    def cut(self) -> tuple:
        """(query, id, value, other), ordered by the first, the third and the second."""
        query, item, value, other = (np.concatenate(x) for x in zip(self.rows, *self.new, strict=True))
        order = np.lexsort((item, value, query))
        place = np.arange(len(query)) - np.searchsorted(query[order], query[order])
        use = order[place < self.k]
        self.rows, self.new, self.waiting = (query[use], item[use], value[use], other[use]), [], 0
        last = order[place == self.k - 1]
        self.edge[query[last]] = value[last]
        return self.rows
