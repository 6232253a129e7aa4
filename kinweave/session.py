"""Session helpers: runtime settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "kinweave.shipped"
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows may hold long texts, so batches for Python are bounded in bytes as well
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators count on (all are runtime-settable)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The driver may have it on its own path only; Spark then serves the archive to every executor.
    """
    if spark.conf.get(_SHIPPED, "") == spark.sparkContext.applicationId:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="kinweave-"), "kinweave.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one only for a local, unset session."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="kinweave-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the checkpoint folder.

    The rows survive a lost executor, and later scans read only the columns they need and know the
    table's size, so Catalyst broadcasts it only where it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the checkpoint folder, which goes with the open ``scratch`` scopes."""
    path = f"{checkpoint_dir(spark)}/kinweave-{uuid.uuid4().hex}"
    for paths in _scopes():
        paths.append(path)
    return path


_local = threading.local()


def _scopes() -> list[list[str]]:
    """The open scopes of this thread: other streams have their own."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end; nothing read later may need them."""
    paths: list[str] = []
    _scopes().append(paths)
    try:
        yield
    finally:
        _scopes().pop()
        delete(spark, *paths)


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove folders of the shared file system; those that are not there are passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
