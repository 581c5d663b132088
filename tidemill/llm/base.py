"""What the operators share: reading tables, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only when it was counted to have at most so many rows, and so many bytes in all.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: Rows of a narrow table that a task may write by itself.
ROWS_A_TASK = 250_000
#: While a table is stored, its shuffles go when it is done (it is read from its files from then on), and batches for
#: Python stay small, so that a worker's memory does not depend on the width of the rows.
WHILE_STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode a folder of our own will do where the session names none."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "tidemill-shared")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def make_folder(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    return path


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared folder, deleted when the driver's JVM ends."""
    path = make_folder(spark, f"{shared_dir(spark)}/tidemill/{what}-{uuid.uuid4().hex}")
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


@contextlib.contextmanager
def storing(spark: SparkSession):
    """A table that is written here is read only from its files afterwards; see WHILE_STORING."""
    before = {k: spark.conf.get(k, None) for k in WHILE_STORING}
    try:
        for k, v in WHILE_STORING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, what: str, most: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and survives lost executors. A narrow table that is
    known to have at most ``most`` rows is written by as few tasks as that takes, but by all cores."""
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-most // ROWS_A_TASK)))
    path = scratch(spark, what)
    with storing(spark):
        df.write.option("compression", "zstd").parquet(f"{path}/t")
    out = spark.read.schema(df.schema).parquet(f"{path}/t")
    out.stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of stored tables that no later step reads."""
    for df in frames:
        delete(df.sparkSession, df.stored_at)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, which for a plain scan is the size of its files. Where it has none, the bytes
    of all strings of df are summed, which reads it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.agg(F.sum(row_bytes(df))).first()[0] or 0


def row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row of df takes in memory."""
    each = [F.lit(16).cast("long")]
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            each.append(F.coalesce(F.octet_length(c), F.lit(0)).cast("long"))
        elif isinstance(f.dataType, T.ArrayType):
            each.append(F.coalesce(F.size(c), F.lit(0)).cast("long") * 64)
        else:
            each.append(F.lit(8).cast("long"))
    return reduce(lambda a, b: a + b, each)


def parts(df: DataFrame, each_mb: int = 16) -> int:
    """Partitions for a shuffle of all of df: the session's number, or more where they would get too large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // (each_mb << 20))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast when it is counted to be within both bounds; otherwise df, which the join then shuffles."""
    found = df.limit(rows + 1).select(row_bytes(df).alias("size")).agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(df) if found[0] <= rows and (found[1] or 0) <= size else df
