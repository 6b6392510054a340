"""Written intermediate tables and column-safe reads."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='pathspring-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a new folder of this machine, for a local master only.

    On a cluster each machine would have a folder of its own, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or _own_folder()


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read back.

    This cuts the lineage: what follows reads files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/pathspring/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame from written(). Nothing that is still to be computed may read it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BATCH_BYTES = 4 << 20
"""Bytes of an Arrow batch, where the session names none: batches of whole texts must not grow with the texts."""

_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow(run, schema):
    """For DataFrame.transform: mapInArrow with batches of bounded size, in workers that give their memory back after each task.

    Workers are used again by later stages; freed memory that they keep would add up.
    """

    def lean(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    def mapped(df: DataFrame) -> DataFrame:
        settings = df.sparkSession.conf
        if _BATCH_SETTING not in settings.getAll:
            settings.set(_BATCH_SETTING, str(BATCH_BYTES))
        return df.mapInArrow(lean, schema)

    return mapped


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
