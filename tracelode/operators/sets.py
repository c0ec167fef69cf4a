"""Set operations, order and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_num
from .filters import normalize
from .ordered import locator


def union_events(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources as one table of normalised events."""
    parts = [normalize(df, name) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_endpoints(df: DataFrame, columns: Sequence[str] = ("orig_h", "resp_h")) -> DataFrame:
    """Distinct values of several columns taken together, in one pass."""
    return df.select(F.explode(F.array(*columns)).alias("ip")).where("ip is not null").distinct()


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key ``b`` does not have."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def in_every(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys present in every source: one aggregation instead of a chain of intersections."""
    tagged = reduce(
        DataFrame.unionByName, [df.select(*keys, F.lit(i).alias("__s")) for i, df in enumerate(sources)]
    )
    held = tagged.groupBy(*keys).agg(F.bit_or(F.expr("shiftleft(1L, __s)")).alias("__mask"))
    return held.where(F.col("__mask") == (1 << len(sources)) - 1).select(*keys)


def run_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two runs do not share, with surplus copies; empty when the runs are equal."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("__d")).unionByName(b.select(*columns, F.lit(-1).alias("__d")))
    return (
        both.groupBy(*columns)
        .agg(F.sum("__d").alias("surplus_in_a"))
        .where("surplus_in_a <> 0")
    )


def by_line(df: DataFrame) -> DataFrame:
    """Raw record order; for the last step before a sink."""
    return df.orderBy(*locator(df))


def by_ip(df: DataFrame, ip: str) -> DataFrame:
    """Numeric address order."""
    return df.orderBy(ip_num(F.col(ip)), ip)


def by_time(df: DataFrame, ts: str = "ts_us", tie: str = "line") -> DataFrame:
    """Time order with a stable tie-break."""
    return df.orderBy(ts, tie)


def page_after(df: DataFrame, after: int | tuple[str, int], size: int, line: str = "line") -> DataFrame:
    """The next ``size`` rows after a line: key-set paging, which skips and repeats nothing.

    Over several files ``after`` is the pair (file, line) of the last row shown.
    """
    if isinstance(after, tuple):
        file, at = after
        later = (F.col("file") > file) | ((F.col("file") == file) & (F.col(line) > at))
        return df.where(later).orderBy("file", line).limit(size)
    return df.where(F.col(line) > after).orderBy(line).limit(size)


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)
