"""Reading the Parquet tables and writing intermediate tables to the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all executors are threads of this process
    (as in tests) a temporary folder is made and recorded in the session; on a cluster
    a folder of one machine would lose rows, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, partition_by: tuple[str, ...] = (), row_group: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage beyond the files, so a lost executor costs only
    the tasks that were running, and a table that is used twice is computed once.
    Rows of many megabytes need a small ``row_group``, as a task holds one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if row_group:  # bytes
        writer = writer.option("parquet.block.size", row_group)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    atexit.register(_drop_local, path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`materialise` returned."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table this process has written; results that still read them must be consumed before."""
    while _written:
        _delete(spark, _written.pop())


#: Paths of the intermediate tables of this process.
_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _drop_local(path: str) -> None:
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        shutil.rmtree(local, ignore_errors=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
