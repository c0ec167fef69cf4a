"""Findings that need several records in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered
from .ordered import CHUNK


def sequence(steps: Sequence[tuple[str, DataFrame]], within_us: int, key: str = "host", chunk: int = CHUNK) -> DataFrame:
    """Hosts that show the given activities one after the other.

    Each step is a frame of episodes ``(key, first_us, last_us)``. An episode follows the previous
    step when it starts after that step ended and no later than ``within_us`` after. Only the
    latest earlier end needs a look, so each step is one sorted pass over episodes. Hosts are counted once, over the episodes
    of all steps, which bound the rows of any step; the steps themselves start no job.
    """
    every = steps[0][1].select(key)
    for _, episodes in steps[1:]:
        every = every.unionByName(episodes.select(key))
    hot = ordered.hot_keys(every, [key])
    name, episodes = steps[0]
    chain = episodes.select(key, F.col("last_us").alias("end_us"), F.struct(F.col("first_us").alias(name)).alias("path"))
    for name, episodes in steps[1:]:
        ended = chain.select(key, F.col("end_us").alias("at"), F.lit(1).alias("tie"), F.struct("end_us", "path").alias("done"))
        started = episodes.select(
            key, F.col("first_us").alias("at"), F.lit(0).alias("tie"), F.struct("first_us", "last_us").alias("next")
        )
        both = ended.unionByName(started, allowMissingColumns=True)
        seen = ordered.carry_last(both, [key], "at", {"before": F.col("done")}, ["tie", "done"], chunk, hot=hot)
        hit = seen.where(
            F.col("next").isNotNull() & (F.col("next.first_us") - F.col("before.end_us") <= within_us)
        )
        chain = hit.select(
            key,
            F.col("next.last_us").alias("end_us"),
            F.col("before.path").withField(name, F.col("next.first_us")).alias("path"),
        )
    return chain.select(key, "path.*", "end_us")


def fail_then_success(auth: DataFrame, n: int, within_us: int, chunk: int = CHUNK) -> DataFrame:
    """Successful logons after at least ``n`` failures of the account in the time before."""
    failed = (~F.col("success")).cast("bigint")
    counted = ordered.trailing_totals(
        auth, ["account"], "ts_us", {"failures": failed}, within_us, chunk, exclude_current=True
    )
    return counted.where(F.col("success") & (F.col("failures") >= n))


# What a rule of each class may claim. Scores never move a finding up.
def claim_level(df: DataFrame, observed: Column, inferred: Column) -> DataFrame:
    """Split findings into observation, inference and unverified."""
    return df.withColumn(
        "claim_level",
        F.when(observed, "observation").when(inferred, "inference").otherwise("unverified"),
    )
