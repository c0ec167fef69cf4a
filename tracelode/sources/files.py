"""Opening and listing files from tasks, whatever the file system."""

from __future__ import annotations

from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20


def open_binary(path: str) -> BinaryIO:
    """A seekable reader for a local path or a URI that Arrow's file systems know."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path) if parsed.scheme else path, "rb", buffering=BLOCK)
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, size`` of the files under a path. Contents are not read."""
    return (
        spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    )


# Beyond this many, rows share tasks.
MAX_TASKS = 100_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """One row per task as far as the row count allows; used when a row stands for much work."""
    return df.repartition(min(max(1, rows), MAX_TASKS))
