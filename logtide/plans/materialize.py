"""Cutting lineage through reliable storage.

Intermediate tables with several readers are written once as Parquet into a folder that every executor
shares, and read from there ever after: a lost executor costs a re-read instead of a re-run, and readers
get column pruning and push-down.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process, by application; removed by ``forget`` and at exit.
_written: dict[str, list[str]] = {}
_scopes = threading.local()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: ``spark.checkpoint.dir`` when the cluster names one.

    Only a local-mode session without that setting gets a temporary folder; on a cluster a folder
    of one machine would be lost with it, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="logtide-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the checkpoint folder and read it from there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    application = spark.sparkContext.applicationId
    if application not in _written:
        _written[application] = []
        atexit.register(_at_exit, weakref.ref(spark), application)
    _written[application].append(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(stored)
    return stored


def release(stored: DataFrame) -> None:
    """Remove a table that ``materialize`` gave, once nothing reads it any more."""
    path, spark = stored._stored_at, stored.sparkSession
    known = _written.get(spark.sparkContext.applicationId, [])
    if path in known:
        _remove(spark, path)
        known.remove(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Remove the tables that this thread stores within, once it is left: nothing lazy may come out of it."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for stored in _scopes.open.pop():
            release(stored)


def forget(spark: SparkSession) -> None:
    """Remove all tables that this process has stored in the session's application."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _remove(spark, path)


def _at_exit(session: weakref.ref, application: str) -> None:
    spark = session()
    if spark is not None and spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == application:
        forget(spark)
