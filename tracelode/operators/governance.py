"""Retention, custody, coverage and claims as operators on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import DAY, HOUR, floor_us
from .. import __version__

# Days to keep after ingestion, and the longest hold an order may set.
KEEP_DAYS, HOLD_DAYS = 90, 730


def retention(records: DataFrame, holds: DataFrame, now_us: int, ingested: str = "ingested_us") -> DataFrame:
    """Class of each record: ``keep``, ``hold`` or ``due`` for deletion.

    ``holds``: ``source, hold_from_us``, at most one row per source. A hold ends after two years.
    """
    live = holds.groupBy("source").agg(F.max("hold_from_us").alias("__hold"))
    joined = records.join(live, "source", "left")
    age = F.lit(now_us) - F.col(ingested)
    held = F.col("__hold").isNotNull() & (F.lit(now_us) - F.col("__hold") <= HOLD_DAYS * DAY)
    verdict = F.when(age < KEEP_DAYS * DAY, "keep").when(held, "hold").otherwise("due")
    return joined.withColumn("retention", verdict).drop("__hold")


def with_custody(df: DataFrame, source: str, collected_us: int, sha256: str, job: str) -> DataFrame:
    """Carry the custody facts of the input on every result row."""
    return df.select(
        "*",
        F.lit(source).alias("custody_source"),
        F.lit(collected_us).cast("bigint").alias("custody_collected_us"),
        F.lit(sha256).alias("custody_sha256"),
        F.lit(__version__).alias("custody_parser"),
        F.lit(job).alias("custody_job"),
    )


def coverage(df: DataFrame, keys: list[str], ts: str = "ts_us", width_us: int = HOUR) -> DataFrame:
    """Records per key and hour over the key's time range, with silent hours as zero rows."""
    counts = df.groupBy(*keys, floor_us(F.col(ts), width_us).alias("slot_us")).agg(F.count(F.lit(1)).alias("records"))
    bounds = counts.groupBy(*keys).agg(F.min("slot_us").alias("__lo"), F.max("slot_us").alias("__hi"))
    slots = bounds.select(*keys, F.explode(F.sequence("__lo", "__hi", F.lit(width_us))).alias("slot_us"))
    return slots.join(counts, [*keys, "slot_us"], "left").select(
        *keys, "slot_us", F.coalesce("records", F.lit(0)).alias("records"), F.col("records").isNull().alias("silent")
    )


# What a claim may be.
STATUSES = ("confirmed", "hypothesis", "undetermined")


def claim_ledger(claims: DataFrame, locators: DataFrame, strict: bool = True) -> DataFrame:
    """Claims with the record ranges that support them, one row per range.

    ``claims``: ``claim, status, source, fields``; ``locators``: ``claim, source, first_line,
    last_line``. A claim without a locator, or with an unknown status, stops the job or,
    without ``strict``, stays as a row with status ``rejected``.
    """
    joined = claims.join(locators, ["claim", "source"], "left")
    bad = F.col("first_line").isNull() | ~F.col("status").isin(*STATUSES)
    if strict:
        why = F.concat(F.lit("claim without locator or status: "), F.col("claim"))
        return joined.where(F.when(bad, F.raise_error(why).cast("boolean")).otherwise(F.lit(True)))
    return joined.withColumn("status", F.when(bad, "rejected").otherwise(F.col("status")))


def late_records(df: DataFrame, delay_us: int, event: str = "ts_us", received: str = "receive_us") -> DataFrame:
    """Records that reached the collector later than the allowed delay."""
    lag: Column = F.col(received) - F.col(event)
    return df.withColumn("delay_us", lag).where(F.col("delay_us") > delay_us)
