"""Session helpers: tables by name, and cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


# Folders of this process, in local mode, which go with it.
_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(rows: DataFrame, most: int, then: Callable[[DataFrame], DataFrame] = lambda some: some) -> DataFrame:
    """`then(rows)`, marked for broadcast if there are at most `most` rows; `then` must not add any. Beyond that it is joined as sizes at run time say."""
    out = then(rows)
    return F.broadcast(out) if rows.limit(most + 1).count() <= most else out


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a folder of this machine only in local mode, where the setting is missing."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"heliovox-{os.getuid()}-{os.getpid()}-checkpoints")
        if shared not in _OWN:
            _OWN.add(shared)
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there, which cuts its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_checkpoints(spark: SparkSession) -> None:
    """Deletes this application's checkpoints; for when its results have been written."""
    if folder := spark.sparkContext.getCheckpointDir():
        delete(spark, folder)
