"""Written tables that cut lineage, in the folder that every executor shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, object] = {}
_LIMITED: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session may leave it unset: it gets a temporary folder, which other
    machines couldn't read."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="triplane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/triplane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark.sparkContext._jvm, spark.sparkContext._jsc
    read = spark.read.schema(df.schema).parquet(path)
    read._triplane_path = path
    return read


def release(*dfs: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more."""
    for df in dfs:
        if (path := getattr(df, "_triplane_path", None)) in _WRITTEN:
            _delete(path)


class Kept:
    """A DataFrame written to the shared folder by a column of small whole numbers, whose parts are read and dropped apart."""

    def __init__(self, df: DataFrame, by: str):
        self.spark, self.schema, self.by = df.sparkSession, df.drop(by).schema, by
        self.path = f"{shared_dir(self.spark)}/triplane-{uuid.uuid4().hex}"
        df.write.partitionBy(by).parquet(self.path)
        _WRITTEN[self.path] = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc

    def _where(self, part: int):
        jvm, jsc = _WRITTEN[self.path]
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.by}={part}")
        return where.getFileSystem(jsc.hadoopConfiguration()), where

    def read(self, part: int) -> DataFrame:
        """The part's rows, none where nothing was written."""
        fs, where = self._where(part)
        if not fs.exists(where):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(where.toString())

    def drop(self, part: int) -> None:
        fs, where = self._where(part)
        fs.delete(where, True)


@contextmanager
def tidy(spark: SparkSession):
    """Within it, a query's shuffle files are deleted when it has run, for its result is a written table; the session's setting
    comes back after. Else they stay until the driver's JVM collects its garbage, which a driver of few objects seldom does."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(path: str) -> None:
    jvm, jsc = _WRITTEN.pop(path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_WRITTEN):
        try:
            _delete(path)
        except Exception:  # the JVM may have gone first
            return


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df, a written table, may be broadcast: its row count is read from Parquet footers."""
    return df.count() <= rows


def arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Arrow batches bounded in rows and bytes, for documents may be long. It changes the session's settings, but only those that
    still are Spark's own."""
    for name, own, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", None, size)):
        at = spark.sparkContext.applicationId, name
        if at in _LIMITED or spark.sparkContext.getConf().contains(name):
            continue
        _LIMITED.add(at)
        if own is None or spark.conf.get(name) in own:
            spark.conf.set(name, value)
