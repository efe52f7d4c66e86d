"""IDX files, and what a stream of queries finds."""
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrill.operators.index import Parameters, VectorIndex
from vectrill.sources.idx import read_idx
from vectrill.streaming.search import search_stream


def test_idx(spark, tmp_path):
    m = np.random.default_rng(1).integers(0, 256, (5000, 4, 3)).astype(np.uint8)
    (tmp_path / "a.idx").write_bytes(struct.pack(">4I", 0x803, *m.shape) + m.tobytes())
    rows = read_idx(spark, f"file://{tmp_path}/a.idx").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(5000)) and (np.array([r.v for r in rows]) == m.reshape(5000, -1)).all()
    for name, data in (("b.idx", b"nothing"), ("c.idx", struct.pack(">4I", 0x803, 2, 2, 2) + b"123")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="IDX"):
            read_idx(spark, f"file://{tmp_path}/{name}").count()


def test_stream(spark, tmp_path):
    m = np.random.default_rng(2).standard_normal((200, 32))
    points = spark.createDataFrame(list(enumerate(m.tolist())), "id long, v array<double>")
    index = VectorIndex(points, Parameters(4, 32, 8, 16, distance="l2")).build()
    queries = points.where("id < 6").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    queries.repartition(3).write.parquet(f"{tmp_path}/in")
    found = {}

    def sink(df, n):
        found[n] = [tuple(r) for r in df.collect()]

    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    search_stream(index, stream, sink, 3, 4, 200).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(x for rows in found.values() for x in rows) == sorted(map(tuple, index.search(queries, 3, 4, 200).collect()))
