"""Session helpers: reading the tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by spark.checkpoint.dir.

    Only where nothing is set and all runs in one process, as in tests, a temporary folder is made and set for the
    session. On a cluster each executor would write to its own disk, so that there the setting must be made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tramaline.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master}")
        folder = tempfile.mkdtemp(prefix="tramaline-")
        spark.conf.set("tramaline.shared.dir", folder)
    return folder.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind once they have ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df once to the shared folder and read it back, so that its lineage ends there.

    Unlike a checkpoint, the rows are computed once and the copy keeps Parquet's column pruning. The shuffles that
    led to it are dropped, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Delete the written table that df, a result of cut, reads; nothing may read it any more."""
    if df is None:
        return
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
