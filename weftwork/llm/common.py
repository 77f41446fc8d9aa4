"""What the operators of this subpackage share: staged tables, files and partition counts."""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.staging import new_path, remove, shared_dir, stage, unstage

__all__ = ["file_system", "new_path", "parts_for", "put_file", "remove", "shared_dir", "stage", "table", "text_bytes", "unstage", "with_row", "without_rows"]


def file_system(uri: str):
    """(file system, path in it) of a URI, for files that Python writes and reads."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """Calls write(stream) on a file of another name and moves it to uri, so that a task that runs twice leaves one whole file."""
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(own, compression=None) as stream:
        write(stream)
    system.move(own, path)


def with_row(docs: DataFrame) -> DataFrame:
    """docs with __file and __at, which name each row for good: its place in the files that it is read from; other tables are staged first."""
    named = lambda df: df.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    try:
        return named(docs)
    except AnalysisException:
        return named(stage(docs, "rows"))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, from with_row(), without the rows that gone (__file, __at) names and without their names."""
    gone = gone.select(F.col("__file").alias("__f"), F.col("__at").alias("__a"))
    return docs.join(gone, (docs["__file"] == gone["__f"]) & (docs["__at"] == gone["__a"]), "left_anti").drop("__file", "__at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(spark: SparkSession, amount: float, each: float) -> int:
    """Partitions of about `each` for `amount` in all; at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / each), 1)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
