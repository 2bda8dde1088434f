"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a temporary one where that is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    place = tempfile.mkdtemp(prefix="scriptloom-")
    spark.sparkContext.setCheckpointDir(place)
    return place


_made: list[list[str]] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Once the block ends well, delete the tables that were made in it, all but the last one: its result."""
    _made.append([])
    try:
        yield
    except BaseException:
        _made.pop()
        raise
    for path in _made.pop()[:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _made:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table of short rows (under 100 bytes) is sent to every executor; beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has few enough rows, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    """The deployer's ``spark.sql.shuffle.partitions``: the size in which shuffled work is cut."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
