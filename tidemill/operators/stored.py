"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are sent to all executors, numbers or short texts; with more, both sides of a join are shuffled.
FEW = 250_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only on one machine, where it is unset, as in tests, a temporary folder is taken and set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Seconds between two sweeps.
SWEEP_S = 10
_SWEPT = [0.0]


def swept(spark: SparkSession, every: float = SWEEP_S) -> None:
    """Spark deletes a shuffle's files once the driver's JVM collects the query that made them, which it does of itself only
    when its memory runs short. Asked for after stored tables, so that jobs of many steps hold the last ones' files alone."""
    if time.monotonic() - _SWEPT[0] >= every:
        spark._jvm.System.gc()
        _SWEPT[0] = time.monotonic()


#: Paths of stored tables and scratch folders, in the order they were made.
_PATHS: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder as Parquet and read again: cuts its lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append(path)
    swept(spark)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df as the side of a join that is never sent whole to the driver and every executor. Spark guesses a side's size from
    that of files, which knows neither how well these compress nor what is exploded from a row."""
    return df.hint("merge")


def are_few(keys: DataFrame) -> bool:
    return keys.limit(FEW + 1).count() <= FEW


def among(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows that have their `on` among keys (of that column; from a stored table). While keys are few, no row is shuffled."""
    return rows.join(F.broadcast(keys) if are_few(keys) else apart(keys), on, "left_semi")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, for files of other formats; dropped() deletes it as it does tables."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def mark() -> int:
    """A place in the list of stored tables, for dropped()."""
    return len(_PATHS)


def dropped(spark: SparkSession, since: int, but: int = 1) -> None:
    """Deletes the tables stored since a mark, but for the last ones. Nothing that still reads them may be used after."""
    end = max(since, len(_PATHS) - but)
    paths, _PATHS[since:end] = _PATHS[since:end], []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
