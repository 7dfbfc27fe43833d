"""Cutting lineage with tables in the shared folder, and dropping them again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables written since the innermost scope was opened; the first list is the session's.
_written: list[list[str]] = [[]]
#: The folder of a local session without a shared one.
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session (tests) gets one of its own; on a cluster that raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="strandkeep-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = _own[0]
    return folder.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, "stash")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, dropped with the tables."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written[-1].append(path)
    return path


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What build returns, written as a table; the tables written on the way are dropped."""
    _written.append([])
    try:
        out = build()
        inner = _written[-1]
        _written[-1] = own = []
        result = stash(out)
    finally:
        _written.pop()
    _written[-1].extend(own)
    _drop(spark, inner)
    return result


def release(spark: SparkSession) -> None:
    """Drops all tables written so far. Results that have not been written or collected are lost, so call it when they have."""
    for paths in _written:
        _drop(spark, paths)
        paths.clear()


def _drop(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        place = jvm.Path(path)
        place.getFileSystem(conf).delete(place, True)
