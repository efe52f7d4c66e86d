"""The index: recall with a control that must fail, full budget, persistence, clustering, validation."""

import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from vectrill.functions import vectors as V
from vectrill.operators import knn
from vectrill.operators.index import Parameters, VectorIndex
from vectrill.operators.kmeans import KMeans
from vectrill.operators.reduce import compute_v, principal_components, randomized_v, rotation, second_moment


def frame(spark, m, first=0, names=("id", "v")):
    return spark.createDataFrame([(first + i, x) for i, x in enumerate(m.tolist())], f"{names[0]} long, {names[1]} array<double>")


@pytest.fixture(scope="module")
def hard(spark):
    """5,000 x 128 from a latent space of 24 dimensions, with noise; the queries are other rows of the same kind."""
    rng = np.random.default_rng(42)
    latent = rng.standard_normal(24) + 0.5 * rng.standard_normal((5050, 24))
    m = latent @ (rng.standard_normal((24, 128)) / np.sqrt(24)) + 0.3 * rng.standard_normal((5050, 128))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return frame(spark, m[:5000]).cache(), frame(spark, m[5000:], 10_000, ("query_id", "q")).cache()


@F.udf(BinaryType())
def noise(b, bits):
    rng = np.random.default_rng(zlib.crc32(b))
    return rng.bytes(len(b)) if bits else rng.standard_normal(len(b) // 4).astype("<f4").tobytes()


def control(index):
    """The same index with random codes: what re-ranking alone finds."""
    fix = F.when(F.col("b_fix").isNotNull(), (F.rand(1) - 0.5).cast("float"))
    index.points = index.points.withColumns({"b": noise("b", F.lit(index.params.quantization_bits or 0)), "b_fix": fix})
    return index


@pytest.mark.parametrize("bits,distance,rank,dtype", [(None, "l2", 32, "f32"), (None, "ip", 16, "bf16"), (8, "ip", 32, "f16"), (8, "l2", 64, "u8"), (4, "l2", 16, "bf16"), (4, "ip", 64, "f32")])
def test_recall(spark, hard, bits, distance, rank, dtype):
    """A covering part of the grid of distances, bits, ranks and types; a search of half of the clusters."""
    points, queries = (typed(df, c, dtype) for df, c in zip(hard, "vq", strict=True))
    index = VectorIndex(points, Parameters(64, 64, bits, rank, distance=distance, dtype=dtype)).build()
    exact = index.exact_search(queries, 10)
    found = index.search(queries, 10, 32, 100)
    share = knn.compute_recall(found, exact)
    assert share >= 0.9
    row = index.points.selectExpr("max(length(v)) as v", "max(length(b)) as b").first()
    assert row["v"] == 128 * {"f32": 8, "f16": 2, "bf16": 2, "u8": 1}[dtype]  # doubles were given here
    kept = min(rank, 63) if bits else rank  # one component more is kept apart, and all are 64
    assert row["b"] == (kept if bits == 8 else (kept + 1) // 2 if bits == 4 else 4 * kept)
    assert knn.recall(control(index).search(queries, 10, 32, 100), exact, 10).first()["recall"] < 0.6 < share


def typed(df, column, dtype):
    """The vectors in another type: bytes from 0 to 255, or the bit patterns of half floats."""
    @F.udf("array<int>")
    def patterns(v):
        x = np.array(v, np.float32)
        if dtype == "f16":
            return x.astype(np.float16).view(np.uint16).tolist()
        if dtype == "bf16":
            return ((x.view(np.uint32) + 0x8000) >> 16).tolist()
        return np.clip(np.round(x * 300 + 127), 0, 255).astype(int).tolist()

    return df if dtype == "f32" else df.withColumn(column, patterns(column)).cache()


def test_hamming_recall(spark, hard):
    points, queries = hard
    packed = lambda df, c: df.withColumn(c, V.pack_bits(F.transform(c, lambda x: (x > 0).cast("int"))))
    points, queries = packed(points, "v").cache(), packed(queries, "q").cache()
    index = VectorIndex(points, Parameters(64, 128, 8, 32, distance="hamming")).build()
    exact = index.exact_search(queries, 10)
    want = {(r.query_id, r.rank): r.distance for r in exact.collect()}
    hit = lambda: np.mean([r.distance <= want[r.query_id, 10] for r in index.search(queries, 10, 32, 200).collect()])  # noqa: E731  ties are many
    share = hit()
    assert share >= 0.9 and index.points.selectExpr("max(length(v)) as v").first()["v"] == 16
    control(index)
    assert hit() < 0.7


def test_joined_search_finds_what_a_scan_finds(spark, hard, monkeypatch):
    points, queries = hard
    for bits in (None, 4):
        index = VectorIndex(points, Parameters(16, 64, bits, 32, distance="l2")).build()
        want = sorted(map(tuple, index.search(queries, 7, 5, 60).collect()))
        for name, value in (("PART", 100), ("CHUNK", 8)):
            monkeypatch.setattr("vectrill.operators.index." + name, value)
        monkeypatch.setattr(knn, "BYTES", 1000)
        assert sorted(map(tuple, index.search(queries, 7, 5, 60).collect())) == want
        plans = [index.search(q, 7, 5, 60)._jdf.queryExecution().analyzed().treeString().count("\n") for q in (queries, queries.union(queries.withColumn("query_id", F.col("query_id") + 1000)))]
        assert plans[0] + 2 >= plans[1] - 4
        monkeypatch.undo()


def test_codes():
    """Integer products with compensation against the sums that they stand for."""
    rng = np.random.default_rng(1)
    z, b = rng.standard_normal((5, 17)), rng.standard_normal((40, 17))
    b[3, 1:] = 0
    for bits in (8, 4):
        q, c = V.Codes.of(z, 8), V.Codes.of(b, bits)
        again = V.Codes.unpacked(c.packed(), c.scale, c.fix, bits, 16)
        assert (again.codes == c.codes).all() and c.packed().shape[1] == (16 if bits == 8 else 8)
        got = q.product(again)
        for i in range(5):
            for j in range(40):
                ints = sum((int(x) - 128) * (int(y) - c.offset) for x, y in zip(q.codes[i], c.codes[j], strict=True))
                scale = float(q.scale[i]) * float(c.scale[j])
                assert got[i, j] == pytest.approx((ints / scale if scale else 0) + float(q.fix[i]) * float(c.fix[j]), rel=1e-12)
        assert np.abs(got - z @ b.T).max() < (0.15 if bits == 8 else 2.5)


def test_full_budget_saved_and_loaded(spark, tmp_path):
    m = np.random.default_rng(42).standard_normal((256, 64))
    points, queries = frame(spark, m), frame(spark, m[137:140], 0, ("query_id", "q"))
    for bits in (None, 8, 4):
        index = VectorIndex(points, Parameters(8, 64, bits, 16, distance="l2")).build()
        want = sorted(map(tuple, index.exact_search(queries, 5).collect()))
        assert sorted(map(tuple, index.search(queries, 5, 8, 256).collect())) == want
        index.save(f"file://{tmp_path}/{bits}")
        again = VectorIndex.load(spark, f"file://{tmp_path}/{bits}")
        assert (again.n_samples, again.dim, again.n_clusters) == (256, 64, 8)
        assert sorted(map(tuple, again.search(queries, 5, 8, 256).collect())) == want
    approximate = index.search(queries, 5, 8, 0).collect()
    assert {r["query_id"] for r in approximate if r["rank"] == 1 and r["id"] == 137 + r["query_id"]} == {0, 1, 2}
    assert VectorIndex(points, Parameters(8, 64, None, 16)).exact_search(queries, 1).count() == 3
    few = index.search(queries, 300, 100, 300, pad=True).collect()
    assert len(few) == 900 and sum(r["id"] == -1 for r in few) == 3 * 44


def test_exact_regression_training_queries_and_balance(spark, hard):
    points, queries = hard
    some = points.where("id < 1500")
    taught = queries.select(F.col("query_id").alias("id"), F.col("q").alias("v")).union(points.where("id >= 3000"))
    index = VectorIndex(some, Parameters(8, 32, None, 24, distance="ip", balanced=True)).build(approximate=False, training_queries=taught)
    sizes = [r["count"] for r in index.points.groupBy("cluster_id").count().collect()]
    assert sum(sizes) == 1500 and len(sizes) == 8 and max(sizes) - min(sizes) <= 32
    assert knn.recall(index.search(queries, 10, 8, 100), index.exact_search(queries, 10), 10).first()["recall"] >= 0.9


def test_hamming_and_cosine(spark):
    rng = np.random.default_rng(3)
    b = rng.integers(0, 256, (300, 16))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(b.tolist())], "id long, v array<int>")
    queries = rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    index = VectorIndex(rows, Parameters(8, 64, 8, 32, distance="hamming")).build()
    want = sorted(map(tuple, knn.exact_knn(rows, queries, 7, "hamming").collect()))
    assert sorted(map(tuple, index.search(queries, 7, 8, 300).collect())) == want == sorted(map(tuple, knn.knn_join(rows, queries, 7, "hamming").collect()))
    bits = np.unpackbits(b.astype(np.uint8), axis=1)
    assert [d for q, r, _, d in want if q == 0] == sorted((bits != bits[0]).sum(1))[:7]


def test_kmeans(spark):
    m = np.random.default_rng(0).random((1000, 8))
    m[500:] = m[0]  # half of the rows are one point: some clusters come out empty and are split
    points = frame(spark, m)
    for kw in ({"distance": "l2"}, {"distance": "ip"}, {"distance": "l2", "samples_per_cluster": 10}):
        k = KMeans(10, **kw)
        with pytest.raises(RuntimeError):
            _ = k.centroids
        own = k.train(points)
        assert sorted(r["id"] for r in own.collect()) == list(range(1000)) and k.centroids.shape == (10, 8) and k.dim == 8
        assert k.assign(points, 3).count() == 3000 and k.assign(points, 99).count() == 10_000
        with pytest.raises(RuntimeError):
            k.train(points)
        if kw["distance"] == "ip":
            assert np.allclose(np.linalg.norm(k.centroids, axis=1), 1)
    k = KMeans(16, distance="l2", balanced=True)
    sizes = [r["count"] for r in k.train(frame(spark, np.random.default_rng(1).random((1000, 8)))).groupBy("cluster_id").count().collect()]
    assert max(sizes) - min(sizes) <= 16 and sum(sizes) == 1000


def test_reduction(spark):
    m = np.random.default_rng(1).random((50, 6))
    assert np.allclose(second_moment(frame(spark, m)), m.T @ m)
    w = principal_components(m.T @ m, 3)
    assert np.allclose(w.T @ w, np.eye(3)) and np.allclose(np.linalg.norm(m @ w) ** 2, (np.linalg.svd(m)[1][:3] ** 2).sum())
    r = rotation(5, keep_first=True)
    assert np.allclose(r @ r.T, np.eye(5)) and r[0, 0] == 1
    v = compute_v(m, 3)
    assert v.shape == (6, 3) and np.allclose(v.T @ v, np.eye(3)) and compute_v(m[:2], 4)[:, 2:].sum() == 0
    assert np.allclose(np.abs(randomized_v(m, 3).T @ v), np.eye(3), atol=1e-6)


def test_decoding_and_recall(spark):
    x = np.array([1.5, -2.0, 0.0, 6e-8, 65504, -0.375], np.float32)
    for kind, bits in (("f16", x.astype("<f2").view(np.uint16)), ("bf16", (x.view(np.uint32) >> 16).astype(np.uint16))):
        for given in (bits.astype(int).tolist(), bits.view(np.int16).astype(int).tolist()):
            row = spark.createDataFrame([(given,)], "v array<int>").select(V.from_bits(F.col("v"), kind).alias("v")).first()
            assert row["v"] == V.from_half(bits.tobytes(), kind).astype(float).tolist()
    x = x[:3]
    assert (V.from_half(x.astype("<f2").tobytes()) == x).all() and (V.from_half((x.view(np.uint32) >> 16).astype("<u2").tobytes(), "bf16") == x).all()
    rows = lambda lists: spark.createDataFrame([(q, i) for q, ids in enumerate(lists) for i in ids], "query_id long, id long")
    for found, exact, want in (([[1, 2, 3]], [[3, 2, 1]], 1.0), ([[1, 2]], [[3, 4]], 0.0), ([[1, 2], [3, 4]], [[1, 5], [3, 6]], 0.5)):
        assert knn.recall(rows(found), rows(exact), len(exact[0])).first()["recall"] == want


def test_errors(spark):
    m = np.random.default_rng(1).standard_normal((40, 64))
    points, queries = frame(spark, m), frame(spark, m[:2], 0, ("query_id", "q"))
    for bad in ({"quantization_bits": 16}, {"rank": 48}, {"global_dim": 33}, {"distance": "l1"}, {"train_size": 0}):
        with pytest.raises(ValueError):
            Parameters(4, **bad)
    index = VectorIndex(points, Parameters(4, rank=16))
    for call in (lambda: index.search(queries, 1, 1, 1), lambda: index.save("/tmp/none"), lambda: VectorIndex(points, Parameters(41)).build()):
        with pytest.raises(RuntimeError):
            call()
    index.build()
    with pytest.raises(RuntimeError):
        index.build()
    for call in (lambda: index.search(queries, 0, 1, 1), lambda: index.search(queries, 1, 1, -1), lambda: index.search(frame(spark, m[:, :32], 0, ("query_id", "q")), 1, 1, 1)):
        with pytest.raises(ValueError):
            call()
    m[0, 0] = np.nan
    bad, short = frame(spark, m), points.withColumn("v", F.when(F.col("id") == 3, F.slice("v", 1, 63)).otherwise(F.col("v")))
    for rows, what in ((bad, "numbers"), (short, "components"), (points.limit(1).withColumn("v", F.lit(None).cast("array<double>")), "no points")):
        with pytest.raises(ValueError, match=what):
            VectorIndex(rows, Parameters(1, rank=16)).build()
    with pytest.raises(ValueError):
        VectorIndex(points, Parameters(4, rank=16)).build(training_queries=frame(spark, m[1:, :32]))
    for rows, what in ((bad, "numbers"), (short, "components")):
        with pytest.raises(Exception, match=what):
            knn.exact_knn(rows, queries, 3).count()
    with pytest.raises(Exception, match="components"):  # two rows whose lengths add up to two of 64
        V.matrix(pa.array([[0.0] * 63, [0.0] * 65]))
    assert knn.exact_knn(points.limit(0), queries, 3).count() == 0 and knn.exact_knn(points, queries.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        index.search(frame(spark, m[:1], 0, ("query_id", "q")), 1, 1, 1)


def test_one_rule_for_nulls_and_repeated_ids(spark):
    """Null vectors are skipped; every row is a point, whatever its id."""
    m = np.random.default_rng(2).standard_normal((64, 32))
    rows = [(i // 2, x) for i, x in enumerate(m.tolist())] + [(None, m[0].tolist()), (99, None)]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    queries = spark.createDataFrame([(0, m[5].tolist()), (1, None)], "query_id long, q array<double>")
    for balanced in (False, True):
        index = VectorIndex(points, Parameters(4, 32, 8, 16, distance="l2", balanced=balanced)).build()
        assert index.n_samples == 65 == index.points.count() and index.points.where("id IS NULL").count() == 1
        assert [(r.query_id, r.id) for r in index.search(queries, 1, 4, 65).collect()] == [(0, 2)]
    assert [(r.query_id, r.id) for r in knn.exact_knn(points, queries, 1, "l2").collect()] == [(0, 2)] == [(r.query_id, r.id) for r in knn.knn_join(points, queries, 1, "l2").collect()]
    k = KMeans(3, distance="l2")
    assert k.train(points).count() == 65 and k.assign(points, 2).count() == 130
    assert k.cost(points) == pytest.approx(np.mean([min(((x - c) ** 2).sum() for c in k.centroids) for x in [*m, m[0]]]))
    ip = KMeans(3)
    ip.train(points)
    assert ip.cost(points) == pytest.approx(np.mean([max(x @ c for c in ip.centroids) for x in [*m, m[0]]]))


def test_dissimilarity_recall_shapes_and_files(spark, tmp_path, caplog):
    m = np.random.default_rng(2).standard_normal((64, 32))
    points = frame(spark, m)
    index = VectorIndex(points, Parameters(2, 32, 8, 16, distance="l2"))
    with caplog.at_level("INFO"):
        index.build(verbose=True)
    assert "clusters are trained" in caplog.text
    assert index.get_dissimilarity(m[0], m[1]) == pytest.approx(((m[0] - m[1]) ** 2).sum())
    assert VectorIndex(points, Parameters(2, 32, None, 16)).get_dissimilarity(m[0], m[1]) == pytest.approx(-m[0] @ m[1])
    assert VectorIndex(None, Parameters(2, distance="hamming")).get_dissimilarity([1, 255], [0, 254]) == 2
    with pytest.raises(ValueError):
        index.get_dissimilarity(m[0], m[1][:31])
    rows = lambda k: spark.createDataFrame([(q, r, r) for q in range(2) for r in range(1, k + 1)], "query_id long, rank int, id long")
    assert knn.compute_recall(rows(3), rows(3)) == 1
    with pytest.raises(ValueError):
        knn.compute_recall(rows(3), rows(4))
    at = f"file://{tmp_path}"
    with pytest.raises(FileNotFoundError):
        VectorIndex.load(spark, f"{at}/none")
    spark.createDataFrame([("{}",)], "meta string").write.parquet(f"{at}/other/meta")
    points.write.parquet(f"{at}/kind/meta")
    for name in ("other", "kind"):
        with pytest.raises(ValueError):
            VectorIndex.load(spark, f"{at}/{name}")
    index.save(f"{at}/index")
    shutil.rmtree(tmp_path / "index/points")
    with pytest.raises(OSError, match="index"):
        VectorIndex.load(spark, f"{at}/index")
    (tmp_path / "bad/meta").mkdir(parents=True)
    (tmp_path / "bad/meta/part-0.parquet").write_bytes(b"no table")
    with pytest.raises(OSError, match="bad"):
        VectorIndex.load(spark, f"{at}/bad")


def test_full_budget_is_cut_in_the_tasks(spark, monkeypatch):
    """A budget of all points sends k rows of a query from each task, not all; so does the joined search."""
    m = np.random.default_rng(5).standard_normal((3000, 64))
    m[2000:] = m[:1000]  # ties
    points, queries = frame(spark, m).coalesce(2), frame(spark, m[:30], 0, ("query_id", "q"))
    index = VectorIndex(points, Parameters(4, 64, 8, 16, distance="l2")).build()
    want = sorted(map(tuple, index.exact_search(queries, 5).collect()))
    tasks = index.points.rdd.getNumPartitions()
    assert index._scanned(queries, 3000, 4, 5).count() <= 30 * 5 * tasks
    assert sorted(map(tuple, index.search(queries, 5, 4, 3000).collect())) == want
    monkeypatch.setattr("vectrill.operators.index.HELD", 7 * 2500)  # partial budgets, few queries at a time
    some = sorted(map(tuple, index.search(queries, 5, 4, 2500).collect()))
    monkeypatch.setattr(knn, "BYTES", 1000)
    assert sorted(map(tuple, index.search(queries, 5, 4, 3000).collect())) == want
    assert sorted(map(tuple, index.search(queries, 5, 4, 2500).collect())) == some


def test_recall_at_a_fixed_budget(spark, monkeypatch):
    """A budget that is too small for the number of points is raised until the recall holds; also by blocks of queries."""
    m = np.random.default_rng(6).standard_normal((6000, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    points, queries = frame(spark, m).cache(), frame(spark, m[:120], 0, ("query_id", "q")).cache()
    for bits, distance, clusters in ((8, "l2", 8), (None, "ip", 7)):
        index = VectorIndex(points, Parameters(8, 64, bits, 16, distance=distance)).build()
        exact = index.exact_search(queries, 10)
        assert knn.compute_recall(index.search(queries, 10, clusters, 50), exact) < 0.8
        assert knn.compute_recall(index.search(queries, 10, clusters, 50, recall=0.9), exact) >= 0.9
    monkeypatch.setattr(knn, "BYTES", 20_000)
    assert knn.compute_recall(index.search(queries, 10, 7, 50, recall=0.9), exact) >= 0.9
    with pytest.raises(ValueError):
        index.search(queries, 10, 7, 50, recall=1.5)


@pytest.mark.parametrize("distance", ["l2", "ip", "cosine"])
def test_sql_plan_takes_queries_by_blocks(spark, distance):
    m = np.random.default_rng(7).standard_normal((400, 12))
    m[300:] = m[:100]  # ties
    points, queries = frame(spark, m), frame(spark, m[:25], 0, ("query_id", "q"))
    want = sorted(map(tuple, knn.exact_knn(points, queries, 4, distance).collect()))
    assert sorted(map(tuple, knn.knn_join(points, queries, 4, distance, broadcast_rows=10).collect())) == want
    if distance == "l2":
        with pytest.raises(Exception, match="components"):
            knn.knn_join(points.withColumn("v", F.when(F.col("id") == 3, F.slice("v", 1, 11)).otherwise(F.col("v"))), queries, 4, distance).count()
