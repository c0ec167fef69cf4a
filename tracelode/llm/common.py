"""What several corpus operators share: kept tables, text columns and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.runtime import scratch

#: White space of the word rules: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: later steps start from files
    that every executor sees, so a lost executor costs only its running tasks."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of hashes and ids (under 50 MB) that may be broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df`` (hashes and ids, kept as a table) marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_id(text: Column) -> Column:
    """16 bytes that stand for an exact text; null for a null text."""
    return F.unhex(F.md5(text))


def key_text(value: Column) -> Column:
    """A string that is never null and differs for null and any text."""
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), value.cast("string")))
