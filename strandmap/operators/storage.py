"""Intermediate tables in the folder that driver and executors share, and their end."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process that are not deleted yet.
_folders: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Only where the session names none (local tests) a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandmap-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one. It lasts as long as the driver's process, as lazy results
    may read it; at the end it is deleted, if not before."""
    path = f"{shared_dir(spark)}/strandmap/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(sweep)
    _folders[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    _folders.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep() -> None:
    """Delete the folders of new_path() that nothing dropped."""
    for path, spark in list(_folders.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage, computes each stage once, survives lost executors and tells the
    optimizer the table's size.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandmap_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote."""
    path = getattr(df, "_strandmap_path", None)
    if path:
        delete(df.sparkSession, path)
