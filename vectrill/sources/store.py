"""Tables that later steps read again, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and the master local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="vectrill-")
        atexit.register(shutil.rmtree, path, True)
        found = "file://" + path
        spark.sparkContext.setCheckpointDir(found)
    return found


_folders: dict[str, SparkSession] = {}


@atexit.register
def _clear() -> None:
    for path, spark in _folders.items():
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone
            return


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/vectrill-{name}-{uuid.uuid4().hex}"
    _folders[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read again: what follows doesn't repeat their lineage and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v, label of the table ``embeddings``."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v", "label")
