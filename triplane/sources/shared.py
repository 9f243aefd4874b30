"""The folder that all executors share, for tables that a job writes between its steps."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_MADE: dict[str, tuple] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, deleted when the program ends. Only a local session may leave that unset: it
    gets a temporary folder, which other machines couldn't read."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="triplane-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark.sparkContext._jvm, spark.sparkContext._jsc
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tidy(spark: SparkSession):
    """Within it, a query's shuffle files are deleted when it has run, for its result is a written table; else they stay until the
    driver's JVM collects its garbage. The session's setting comes back after."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@atexit.register
def _delete_all() -> None:
    for path, (jvm, jsc) in _MADE.items():
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have gone first
            return
