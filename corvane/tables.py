"""Materialised tables: cut lineage that survives the loss of executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
_local: dict[str, str] = {}  # temporary folders of local sessions, by application


def work_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir, or a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _local[app][7:], ignore_errors=True)
    return _local[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The written table survives the loss of any executor, and everything behind it is computed once.
    Files are removed by release() or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _written:
        atexit.register(release, spark)
    _written.setdefault(app, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() returned and that nothing will read any more; other DataFrames are left alone."""
    path = getattr(df, "_materialized_at", None)
    written = _written.get(df.sparkSession.sparkContext.applicationId, [])
    if path in written:
        written.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside the block are deleted at its end: for sessions that ask many queries. What the block makes must have been read or written by then."""
    app = spark.sparkContext.applicationId
    before = set(_written.get(app, []))
    try:
        yield
    finally:
        for path in [p for p in _written.get(app, []) if p not in before]:
            _written[app].remove(path)
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete every table that materialize() wrote for this application."""
    try:
        sc = spark.sparkContext
        for path in _written.pop(sc.applicationId, []):
            _delete(spark, path)
    except Exception:  # the JVM may already be gone
        pass
