"""Longest-processing-time sharding: groups that must stay together go, largest first, to the least-loaded shard.

The groups are too many for one heap, so the heap gets two kinds of items, both few by construction: a group of
its own wherever a group holds more than 1/``FINE`` of a shard, of which there can be ``shards * FINE`` at most, and
``BUCKETS`` buckets into which a hash of the group's key deals all smaller groups. The item table has therefore at
most ``shards * FINE + BUCKETS`` rows at any input size and is what the driver sees and broadcasts.

Defined cases: a null text is a group of its own with size ``overhead``; an empty text likewise (they differ). Rows
repeated exactly stay in one shard and get slots of their own. An empty table gives no rows. Columns of the input
other than the id and the text are not read, so clashing names do no harm. A group larger than an even share
still stays whole: its shard then holds it alone, and the others share the rest evenly.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FINE, BUCKETS, CELL_ROWS = 100, 16384, 4096


def lpt(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Largest item first, each to the shard with least so far; ties by item key and by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def assign_shards(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text).

    ``size`` is the text's UTF-8 length plus ``overhead``; the law is ``bytes``: sizes of shards near equal.
    Slots run from 0 without gaps within a shard.
    """
    spark = docs.sparkSession
    utf8 = F.encode(F.col("text"), "UTF-8")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.crc32(utf8), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(utf8), F.lit("null")).alias("group"),
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    large = F.col("bytes") * (shards * FINE) > total
    # pmod: the bucket of a group is a function of its key alone, so equal texts share a bucket
    bucket = F.pmod(F.xxhash64("group"), F.lit(BUCKETS)).cast("string")
    items = (
        groups.select(F.when(large, F.col("group")).otherwise(bucket).alias("item"), "bytes", "n")
        .groupBy("item")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        .collect()
    )
    placed = lpt([(r["bytes"], r["item"]) for r in items], shards)
    table = [(r["item"], placed[r["item"]], -(-r["n"] // CELL_ROWS)) for r in items]
    where = spark.createDataFrame(table, "item string, shard int, cells int")
    alone = spark.createDataFrame([(r[0],) for r in table if len(r[0]) == 32 or r[0] == "null"], "own string")
    dealt = (
        rows.join(F.broadcast(alone), rows["group"] == alone["own"], "left")
        .withColumn("item", F.coalesce("own", bucket))
        .join(F.broadcast(where), "item")
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.col("cells")))
    )
    # A slot is the rows of the shard's earlier cells plus the row's place in its own cell of a few thousand rows.
    cells = dealt.groupBy("shard", "item", "cell").agg(F.count(F.lit(1)).alias("rows_here"))
    before = Window.partitionBy("shard").orderBy("item", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("item", "cell", F.coalesce(F.sum("rows_here").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("item", "cell").orderBy("doc_id", "text_crc32", "size"))
    return (
        dealt.withColumn("place", place)
        .join(starts, ["item", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
