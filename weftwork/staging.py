"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query go when it ends. A staged table is read from its files, never from the shuffles behind it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: list[tuple[SparkSession, str]] = []
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of spark.checkpoint.dir, on the default file system if it names none; a temporary folder where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="weftwork-"))
        found = f"file://{os.path.abspath(_OWN[0])}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; release() removes it, or the driver's end."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str, *, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Removes staged tables that no later read needs."""
    for table in tables:
        remove(table.sparkSession, table._weft_path)


def release(spark: SparkSession) -> None:
    """Removes all that was staged in a session, for long ones: results that still read it must have been written by then."""
    for owner, path in list(_STAGED):
        if owner is spark:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _STAGED[:] = [x for x in _STAGED if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_STAGED):
        try:
            remove(spark, path)
        except Exception:  # the session has ended; local folders can still go
            if path.startswith("file:"):
                shutil.rmtree("/" + path.split("file:", 1)[1].lstrip("/"), ignore_errors=True)
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)
