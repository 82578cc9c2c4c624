"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one is made where none is configured and everything runs in one process, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not configured and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return configured or context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a row group where each is of megabytes.
WIDE_ROWS = 4


def stored(df: DataFrame, path: str, wide: bool = False) -> None:
    """Write `df` as compressed Parquet. `wide`: for rows of megabytes each; readers take up to 4096 rows of a row group at once, so these get a few rows only."""
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.row.count.limit", WIDE_ROWS) if wide else out).parquet(path)


def written(df: DataFrame, name: str = "table", wide: bool = False) -> DataFrame:
    """Write `df` as compressed Parquet to the shared folder and go on from there, with pushed filters and projections. Partitions are not kept.

    `wide`: see `stored`."""
    path = new_path(df.sparkSession, name)
    stored(df, path, wide)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, most: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows, which are counted; else as it is. Give it a written table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something has been written to `path`, in any store that Spark can read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where)


def files(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of every file of a table, from the store's listing; nothing is read."""
    jvm, found = spark.sparkContext._jvm, []
    for name in sorted(spark.read.parquet(path).inputFiles()):
        where = jvm.org.apache.hadoop.fs.Path(name)
        status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)


def delete(spark: SparkSession, names: list[str]) -> None:
    """Delete files that `inputFiles` has named."""
    jvm = spark.sparkContext._jvm
    for name in names:
        where = jvm.org.apache.hadoop.fs.Path(name)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, False)
