"""IDX files of unsigned bytes: a big-endian header (magic number, one size for each dimension), then the values."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Type code of unsigned bytes in the third byte of the magic number; the fourth is the number of dimensions.
BYTES = 0x08


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """id, v of each entry along the first dimension, the others in one row. Files are read whole, by Spark, one a task;
    ids run on from 0 in each file. What isn't such a file is an error."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                raw = data.as_buffer().to_pybytes()
                if len(raw) < 4 or raw[:2] != b"\0\0" or raw[2] != BYTES or not raw[3]:
                    raise ValueError("not an IDX file of bytes")
                sizes = struct.unpack(f">{raw[3]}I", raw[4 : 4 + 4 * raw[3]])
                m = np.frombuffer(raw, np.uint8, offset=4 + 4 * raw[3])
                if len(m) != np.prod(sizes, dtype=np.int64):
                    raise ValueError("an IDX file of another length than its header says")
                m = m.reshape(sizes[0], -1)
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.int32()))], names=["id", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, v array<int>")
