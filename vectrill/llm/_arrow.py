"""Arrow plumbing: functions of record batches as Spark transformations."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of text that a Python worker holds at once.
BATCH = 512


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _type(t: str) -> pa.DataType:
    if t.startswith("array<"):
        return pa.list_(_type(t[6:-1]))
    if t.startswith("struct<"):
        return pa.struct([(n, _type(x)) for n, x in (f.split(": ") for f in t[7:-1].split(", "))])
    return _TYPES[t]


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow's form of a schema string; workers have no JVM to parse it. Commas inside <> belong to a type."""
    parts, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return pa.schema([(n, _type(t)) for n, t in (p.strip().split(" ", 1) for p in parts)])


def batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table(columns: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([batch(columns, schema)], schema=schema)


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``mapInArrow`` over batches of few rows, for rows may be long."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, BATCH):
                    yield b.slice(at, BATCH)

        return f(cut())

    return df.mapInArrow(small, ddl)


def release() -> None:
    """Give back to the system what a worker's earlier groups have freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def few_rows(spark) -> None:
    """Batches between the JVM and Python hold few rows, so that long texts don't add up.

    This is a setting of the session, read when a lazy plan runs, so it stays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(4 * BATCH))


def located(file: str) -> str:
    """Where a tokenizer file is on this machine: a path as given, or the place of a public file of this name."""
    if os.sep in file:
        return file
    import public_tokenizers

    return public_tokenizers.path(file)
