"""Cutting the lineage of frames that loops build on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go with it."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def folder(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir, which the driver and all executors share. Where that is unset, a session on one machine gets a temporary one, any other has to set it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/loomline-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, so that the plan of what follows begins here. The shuffle files of the work go once it is done.

    The folder is spark.checkpoint.dir; where it is unset, a session on one machine gets a temporary one, any other has to set it."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="loomline-")
        sc.setCheckpointDir(at)
    spark = df.sparkSession
    with cleaned(spark):
        return df.select("*").checkpoint()  # a plan of its own, which heeds the setting


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept in a new folder as compressed files, which take a fraction of a checkpoint's room."""
    path = folder(df.sparkSession)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
