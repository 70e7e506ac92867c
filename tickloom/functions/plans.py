"""Small helpers around plans: reading tables, size-checked broadcasts, shared folders, partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when Catalyst's size estimate is below this many bytes.
BROADCAST_LIMIT = 64 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's upper estimate of a DataFrame's size, from file sizes and projected columns; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Memory that a row of a compressed file may need, as a multiple of its bytes in the file.
EXPANSION = 8


def small_side(df: DataFrame, base: DataFrame | None = None, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its size is below ``limit``; otherwise unchanged, so that Catalyst takes a sort-merge
    join, which AQE splits where one key is skewed. ``base`` is a table of which ``df`` has at most as many rows: its file size
    times ``EXPANSION`` is then the bound, as Catalyst's estimate multiplies the sizes of joined tables."""
    size = estimated_bytes(df) if base is None else estimated_bytes(base) * EXPANSION
    return F.broadcast(df) if size <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores if it is so small that its files may give fewer: for work in Python that costs
    far more than moving these few megabytes. Anything larger is read in enough parts and stays as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    packed = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()) * cores
    return df.repartition(cores) if estimated_bytes(df) <= packed else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by all executors (spark.checkpoint.dir), or a temporary one in local runs that set none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tickloom-")
    context.setCheckpointDir(folder)
    return folder


class Scope:
    """The tables written while a scope is open; ``remove`` deletes them, after which DataFrames that read them can't be used."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def remove(self, spark: SparkSession) -> None:
        while self.paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The open scopes; the first holds what is written outside any.
_SCOPES = [Scope()]


@contextmanager
def scope() -> Iterator[Scope]:
    """Collects the tables written inside it, for its owner to remove when their readers are done."""
    own = Scope()
    _SCOPES.append(own)
    try:
        yield own
    finally:
        _SCOPES.remove(own)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and computes it once. Its scope removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCOPES[-1].paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Removes the tables written so far outside any scope."""
    _SCOPES[0].remove(spark)


def settled(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a projection below which no filter on its columns is pushed.

    A filter on a long chain of projections would otherwise be pushed to its foot with the whole chain written out in its condition: the
    work is done twice, in a generated method too large to be compiled. To Catalyst the partition's number isn't deterministic, so
    the filter stays above; the number itself is one per task and changes no value."""
    return df.withColumn(column, F.when(F.spark_partition_id() >= 0, F.col(column)))
