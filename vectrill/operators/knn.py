"""Exact k nearest neighbours: a stated set of queries against all rows, in blocks of queries.

Queries of at most ``BYTES`` together go to the tasks of one scan of the points. A task multiplies batches of points by
blocks of queries and keeps k candidates for each query, so that k rows for each query and task are shuffled.
Distances of candidates are computed anew in the order of components. More queries take more scans, one for each ``BYTES``.

Defined cases: fewer than k points give fewer rows; ties go to the smaller id; null vectors are skipped; vectors of another
width than the first query's, or with components that aren't numbers, are errors; an empty table on either side gives no rows. Any
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import COSINE, DISTANCES, HAMMING, IP, L2, dissimilarity, doubles, matrix, normalised, pair_distance, prepared
from .topk import least, top_k

BYTES, BLOCK, BATCH, WIDE = 64 << 20, 1024, 2048, 96
FOUND = "query_id long, id long, distance double"
_SHAPE = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def blocks(queries: DataFrame, size: int = BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of queries (query_id, q), as many at a time as fill ``size`` bytes."""
    ids, vectors, held = [], [], 0
    for r in queries.where("q IS NOT NULL").select("query_id", F.col("q").cast("array<double>").alias("q")).toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        held += 8 * len(r[1]) + 8
        if held >= size:
            yield _block(ids, vectors)
            ids, vectors, held = [], [], 0
    if ids:
        yield _block(ids, vectors)


def _block(ids: list, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array(ids), matrix(pa.array(vectors, pa.list_(pa.float64())))


def approximate(q: np.ndarray, v: np.ndarray, distance: str) -> np.ndarray:
    """All distances by one matrix product."""
    ip = q @ v.T
    if distance in (IP, COSINE):
        return -ip
    return (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * ip


def validate(k: int, distance: str) -> None:
    if k < 1:
        raise ValueError("k must be positive")
    if distance not in DISTANCES:
        raise ValueError(f"distance must be one of {DISTANCES}")


def exact_knn(points: DataFrame, queries: DataFrame, k: int, distance: str = IP) -> DataFrame:
    """query_id, rank, id, distance: points (id, v) nearest to each of queries (query_id, q)."""
    validate(k, distance)
    points = points.where("v IS NOT NULL").select(F.col("id").cast("long"), "v")
    out = points.sparkSession.createDataFrame([], FOUND)
    for ids, raw in blocks(queries):
        out = out.union(points.mapInArrow(_scan(ids, prepared(raw, distance), raw.shape[1], k, distance), FOUND))
    return top_k(out, "query_id", "distance", "id", k).select("query_id", "rank", "id", "distance")


def _scan(ids: np.ndarray, q: np.ndarray, width: int, k: int, distance: str):
    def run(batches):
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for _ in range(0, len(ids), BLOCK)]  # query number, id, distance
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                v, own = prepared(matrix(part.column(1), width), distance), ids_of(part.column(0))
                for n, first in enumerate(range(0, len(ids), BLOCK)):
                    some = q[first : first + BLOCK]
                    scores = approximate(some, v, distance)
                    i, j = least(scores, k, 1e-9 * (1 + float(np.abs(scores).max())))
                    new = (i + first, own[j], pair_distance(some[i], v[j], distance))
                    kept[n] = _best(*(np.concatenate(x) for x in zip(kept[n], new, strict=True)), k)
        for query, item, value in kept:
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), ids_back(item), pa.array(value)], schema=_SHAPE)

    return run


#: Stands for a null id among numbers: it is larger than any other.
NO_ID = (1 << 63) - 1


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == NO_ID)


def _best(query: np.ndarray, item: np.ndarray, value: np.ndarray, k: int) -> tuple:
    order = np.lexsort((item, value, query))
    query = query[order]
    first = np.searchsorted(query, query)
    use = order[np.arange(len(query)) - first < k]
    return query[np.arange(len(query)) - first < k], item[use], value[use]


def knn_join(points: DataFrame, queries: DataFrame, k: int, distance: str = IP, broadcast_rows: int = 10_000) -> DataFrame:
    """The same as one SQL plan of built-in functions; at most ``broadcast_rows`` queries are broadcast at a time, by blocks.

    All pairs are compared, but few are ranked: first each query meets about the square root of k times the number of points,
    and its k-th distance there bounds what it takes from all points, again that number. Vectors of up to ``WIDE`` numbers
    lie in columns, so that distances are compiled; wider ones and bits are folded by higher-order functions.
    """
    validate(k, distance)
    points = points.where("v IS NOT NULL").select(F.col("id").cast("long").alias("id"), "v")
    queries = queries.where("q IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "q")
    asked = queries.agg(F.count(F.lit(1)), F.min(F.size("q"))).first()
    n, width = points.count(), asked[1] or 0
    columns = distance != HAMMING and 0 < width <= WIDE
    points, queries = (_columns(df, x, width, distance, columns) for df, x in ((points, "v"), (queries, "q")))
    if columns:
        term = lambda i: (F.col(f"v{i}") - F.col(f"q{i}")) * (F.col(f"v{i}") - F.col(f"q{i}")) if distance == L2 else F.col(f"v{i}") * F.col(f"q{i}")
        value = F.lit(0.0)
        for i in range(width):
            value = value + term(i)
        value = value if distance == L2 else -value
    else:
        value = dissimilarity(F.col("q"), F.col("v"), HAMMING if distance == HAMMING else L2 if distance == L2 else IP)
    # many tasks, each with few of the points
    parts = max(4 * points.sparkSession.sparkContext.defaultParallelism, -(-n // 20_000))
    points, blocks = points.repartition(parts), -(-asked[0] // broadcast_rows)
    every, out = max(1, round((n / k) ** 0.5)), None
    for b in range(max(1, blocks)):
        some = queries if blocks < 2 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        if every > 1:
            few = points.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(every)) == 0)
            near = few.crossJoin(F.broadcast(some)).select("query_id", "id", value.alias("distance"))
            edge = top_k(near, "query_id", "distance", "id", k).where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("distance").alias("edge"))
            some = some.join(F.broadcast(edge), F.col("query_id").eqNullSafe(F.col("of")), "left").drop("of").withColumn("edge", F.coalesce("edge", F.lit(float("inf"))))
            pairs = points.join(F.broadcast(some), value <= F.col("edge"))
        else:
            pairs = points.crossJoin(F.broadcast(some))
        found = pairs.select("query_id", "id", value.alias("distance"))
        out = found if out is None else out.union(found)
    return top_k(out, "query_id", "distance", "id", k).select("query_id", "rank", "id", "distance")


def _columns(df: DataFrame, name: str, width: int, distance: str, columns: bool) -> DataFrame:
    """Vectors of one width as columns of numbers that can't be null, or as they are; others are errors."""
    v = F.col(name)
    bad = F.when(F.size(v) != width, F.raise_error(F.lit(f"vectors must have {width} components")).cast("boolean"))
    bad = bad.when(F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.raise_error(F.lit("vectors must hold numbers")).cast("boolean"))
    df = df.where(bad.otherwise(F.lit(True)))
    if distance == COSINE:
        df = df.withColumn(name, normalised(v))
    if not columns:
        return df
    return df.select(df.columns[0], *[F.coalesce(F.get(doubles(v), F.lit(i)), F.lit(0.0)).alias(f"{name}{i}") for i in range(width)])


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of the k exact ids that were found."""
    n = exact.select("query_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    hits = found.select("query_id", "id").distinct().join(exact.select("query_id", "id").distinct(), ["query_id", "id"]).agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(n).select((F.col("hits") / (F.col("n") * k)).alias("recall"))


def compute_recall(found: DataFrame, exact: DataFrame) -> float:
    """The mean share of exact (query_id, rank, id) that is in found; both must have the same queries and ranks."""
    shape = lambda df: tuple(df.agg(F.countDistinct("query_id"), F.countDistinct("rank"), F.count(F.lit(1))).first())
    a, b = shape(found), shape(exact)
    if a != b:
        raise ValueError(f"found and exact have different shapes: {a[:2]} and {b[:2]}")
    return recall(found, exact, b[1]).first()["recall"]
