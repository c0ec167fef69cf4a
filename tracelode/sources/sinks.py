"""Writers. None replaces an earlier result: all fail when the target exists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import to_ts

NEVER_OVERWRITE = "errorifexists"


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab separated with header, every value quoted."""
    df.write.mode(NEVER_OVERWRITE).option("sep", "\t").option("header", True).option("quoteAll", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """JSON objects, one per row. Nulls are written, because an unknown is a result."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        NEVER_OVERWRITE
    ).text(path)


def write_events(events: DataFrame, path: str) -> None:
    """Normalised events as Parquet by day and source.

    The rows are rebalanced by day and source: Spark splits what is larger than its advisory partition size, so a
    busy day of one source is written by many tasks and a quiet one by one. Inside a file rows are sorted by host
    and time for row-group pruning.
    """
    dated = events.withColumn("event_date", F.to_date(to_ts(F.col("event_us"))))
    (
        dated.hint("rebalance", "event_date", "source")
        .sortWithinPartitions("event_date", "source", "source_ip", "event_us")
        .write.mode(NEVER_OVERWRITE)
        .partitionBy("event_date", "source")
        .parquet(path)
    )


def write_selected(selected: Mapping[str, DataFrame], path: str) -> None:
    """Selected records as JSON, one folder per source."""
    for name, df in selected.items():
        df.write.mode(NEVER_OVERWRITE).json(f"{path}/{name}")
