"""Where intermediate tables go, and small plan helpers that several operators need."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ._arrow import release

#: ASCII white space, the only separator of words here.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master, as in tests, may do without: a temporary
    folder then serves until the interpreter ends. On a cluster its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        own = tempfile.mkdtemp(prefix="vectrill-")
        atexit.register(shutil.rmtree, own, True)
        found = "file://" + own
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Paths to remove at the end. Not the tables themselves: their plans would stay in the driver's memory.
_paths: dict[str, SparkSession] = {}


@atexit.register
def _clear() -> None:
    for path, spark in _paths.items():
        try:
            _remove(spark, path)
        except Exception:  # the session is gone
            return


class Cut:
    """A DataFrame written as Parquet to the shared folder and read again, so later steps don't repeat its lineage.

    The files survive the loss of any executor. ``drop`` removes them once nothing lazy reads them any more;
    otherwise they go when the driver's interpreter ends.
    """

    def __init__(self, df: DataFrame, name: str, **measures: Column) -> None:
        """``measures``: aggregates of all rows, taken as they are written, for ``self.found``."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/vectrill-{name}-{uuid.uuid4().hex}"
        told = Observation()
        (df.observe(told, *[c.alias(k) for k, c in measures.items()]) if measures else df).write.parquet(self.path)
        self.found = told.get if measures else {}
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _paths[self.path] = self.spark

    def drop(self) -> None:
        if _paths.pop(self.path, None):
            _remove(self.spark, self.path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower()`` would fold other letters too."""
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column, of: int, remainder: int = 2) -> Column:
    """crc32 of the id's decimal text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == remainder


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over the whole table: one scan, one number per task."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column)).cast("long")), F.lit(0)).alias("n")).first()["n"]


def forget(spark: SparkSession) -> None:
    """Shuffle files of finished plans go when the driver's collectors run, else after half an hour: after large steps they are asked to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of a ``Mask``: 4 MiB, whatever it is made of.
MASK = 25
#: A key with more than 1/HOT of the rows, and LEAST rows at least, is hot: there are HOT of them at most.
HOT, LEAST = 1000, 10_000


class Mask:
    """A filter ahead of an exact join: the high bits of 64-bit hashes, in a bitmap of fixed size.

    It never loses a hash. The more hashes it is made of, the more others pass too; these cost what they would cost
    without it, and the join that follows removes them.
    """

    def __init__(self, hashes: DataFrame, column: str) -> None:
        bit = F.shiftrightunsigned(F.col(column), 64 - MASK).cast("int")
        parts = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("block"))
        self.bits = np.zeros(1 << (MASK - 3), np.uint8)
        for r in parts.agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767)).cast("long")).alias("bits")).collect():
            self.bits[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
        release()

    def has(self, h: np.ndarray) -> np.ndarray:
        bit = (h >> np.uint64(64 - MASK)).astype(np.int64)
        return (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


class Counted(Cut):
    """A table with one row a key and n, the number of rows that will meet it, with what ``meet`` has to know of n."""

    def __init__(self, df: DataFrame, name: str) -> None:
        super().__init__(df, name, total=F.sum("n"), most=F.max("n"))
        self.plain = self.df.drop("n")

    def of(self, table: DataFrame, key: str) -> Counted:
        """These counts for a table with one row a key that isn't written again."""
        self.plain, self.df = table, table.join(self.df.select(key, "n"), key)
        return self


def meet(rows: DataFrame, counted: Counted, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a counted table, though a key may hold most rows.

    Rows of a hot key are dealt by a hash of the row over as many salts as it has times the rows that make a key hot, and
    its row of the table is repeated for each: at most 2 * HOT rows more, whatever the input. Only hot keys are broadcast.
    """
    total, table = counted.found["total"] or 0, counted.df
    size = max(total // HOT, LEAST)
    if (counted.found["most"] or 0) <= size:
        return rows.join(counted.plain, key, how)
    salts = F.ceil(F.col("n") / size).cast("int")
    hot = F.broadcast(table.where(F.col("n") > size).select(key, salts.alias("_salts")))
    salt = F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col("_salts")).cast("int"), F.lit(0))
    dealt = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of a row's id and text. Nulls differ from everything else; rows equal in both are one."""
    return F.struct(
        F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(text).isNull(), text).alias("a"),
        F.xxhash64(F.lit(1), text, F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).alias("b"),
    )


def without(docs: DataFrame, gone: DataFrame, most: int = 500_000) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) whose ``row_key`` isn't in ``gone`` (row). The keys are counted: up to ``most`` are
    broadcast, more are joined by shuffle. Rows that share an id, or have none, are told apart by their texts."""
    gone = Cut(gone.select("row").distinct(), "gone").df
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key().alias("row"))
    return keyed.join(F.broadcast(gone) if gone.count() <= most else gone, "row", "left_anti").select("doc.*")


def once(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each that is repeated with id and text: only these are shuffled with their texts."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key().alias("row"))
    repeated = Cut(keyed.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row"), "repeated")
    if not repeated.df.limit(1).count():
        return docs
    single = keyed.join(repeated.df, "row", "left_anti")
    return single.unionByName(keyed.join(repeated.df, "row", "left_semi").groupBy("row").agg(F.first("doc").alias("doc")).select("doc", "row")).select("doc.*")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
