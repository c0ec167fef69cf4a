"""Intervals, ranges, timelines and sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import ip_num
from . import ordered
from .ordered import CHUNK

# Width of a chunk of line or packet numbers.
LINES = 1_000_000


def beacons(
    df: DataFrame,
    keys: Sequence[str],
    min_intervals: int,
    max_cv: float,
    max_bytes: int | None = None,
    ts: str = "ts_us",
    size: str = "orig_bytes",
    chunk: int = CHUNK,
) -> DataFrame:
    """Keys contacted many times at even spacing (low deviation over mean) with small payloads."""
    stats = ordered.interval_stats(df, keys, ts, chunk).where(F.col("intervals") >= min_intervals)
    stats = stats.withColumn("cv", F.col("sd_us") / F.nullif(F.col("mean_us"), F.lit(0.0))).where(
        F.col("cv") <= max_cv
    )
    sizes = df.groupBy(*keys).agg(F.max(size).alias("max_bytes"))
    if max_bytes is not None:
        sizes = sizes.where(F.col("max_bytes") <= max_bytes)
    return ordered.join_null_safe(stats, sizes, list(keys), "inner")


def locators(
    df: DataFrame, keys: Sequence[str], line: str = "line", ts: str = "ts_us", uid: str = "uid"
) -> DataFrame:
    """First and last record of each group; with a ``file``, in the order of files and with their names."""
    names = ordered.locator(df, line)
    at = F.struct(*[F.col(n) for n in names])
    found = df.groupBy(*keys).agg(
        F.min(at).alias("__first"), F.max(at).alias("__last"), F.min(ts).alias("first_us"), F.max(ts).alias("last_us"),
        F.min_by(uid, at).alias("first_uid"), F.max_by(uid, at).alias("last_uid"),
    )
    files = [F.col(f"__{end}.file").alias(f"{end}_file") for end in ("first", "last")] if len(names) > 1 else []
    return found.select(
        *keys, *files, F.col(f"__first.{line}").alias("first_line"), F.col(f"__last.{line}").alias("last_line"),
        "first_us", "last_us", "first_uid", "last_uid",
    )


def spans(df: DataFrame, keys: Sequence[str], start: str = "first_us", last: str = "last_us") -> DataFrame:
    """First start to last start, and first start to last packet: two different spans."""
    return df.groupBy(*keys).agg(
        (F.max(start) - F.min(start)).alias("start_span_us"),
        (F.max(last) - F.min(start)).alias("packet_span_us"),
    )


def phase_gaps(phases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Time from the last packet of a phase to the first of the next. One row per phase."""
    w = Window.partitionBy(*keys).orderBy("first_us", "phase")
    return phases.select(
        *keys,
        "phase",
        F.lag("phase").over(w).alias("previous_phase"),
        (F.col("first_us") - F.lag("last_us").over(w)).alias("gap_us"),
    )


def ranges(df: DataFrame, keys: Sequence[str], line: str = "line", chunk: int = LINES) -> DataFrame:
    """Consecutive line (or packet) numbers as first-last ranges, within each file where there is a ``file``."""
    keys = [*keys, *[c for c in ordered.locator(df, line)[:-1] if c not in keys]]
    return ordered.islands(df, keys, line, 2, chunk=chunk).select(
        *keys,
        F.col("start").alias("first_line"),
        F.col("end").alias("last_line"),
        F.col("n").alias("lines"),
    )


def sequential_scan(
    df: DataFrame, min_hosts: int, ts: str = "ts_us", tie: str = "line", chunk: int = CHUNK
) -> DataFrame:
    """Runs in which a host contacts address after address, each one higher than the last."""
    num, hot = df.withColumn("__num", ip_num(F.col("resp_h"))), ordered.hot_keys(df, ["orig_h"])
    seen = ordered.carry_last(
        num,
        ["orig_h"],
        ts,
        {"__prev": F.struct(F.col("__num").alias("num"), F.col("resp_p").alias("port"))},
        [tie],
        chunk,
        hot=hot,
    )
    step = F.coalesce(F.col("__num") == F.col("__prev.num") + 1, F.lit(False))
    numbered = ordered.runs(seen.withColumn("__step", step), ["orig_h"], ts, ~F.col("__step"), [tie], chunk, hot=hot)
    change = F.col("__step") & (F.col("resp_p") != F.col("__prev.port"))
    # Distinct ports per run come from a second grouping, so no set is collected.
    per_port = numbered.groupBy("orig_h", "run", "resp_p").agg(
        F.min(ts).alias("first_us"),
        F.max(ts).alias("last_us"),
        F.count(F.lit(1)).alias("hosts"),
        F.count_if(change).alias("port_changes"),
    )
    return (
        per_port.groupBy("orig_h", "run")
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("hosts").alias("hosts"),
            F.count(F.lit(1)).alias("ports"),
            F.sum("port_changes").alias("port_changes"),
        )
        .where(F.col("hosts") >= min_hosts)
        .drop("run")
    )


def log_gaps(
    df: DataFrame, keys: Sequence[str], limit_us: int, ts: str = "ts_us", chunk: int = CHUNK
) -> DataFrame:
    """Silences longer than ``limit_us`` between neighbouring records of a key."""
    keys = list(keys)
    rows = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("__t"), ordered.floor_us(F.col(ts), chunk).alias("__c"))
    ends = rows.groupBy(*keys, "__c").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"))
    across = ends.select(
        *keys,
        F.col("__last").alias("silent_from_us"),
        F.lead("__first").over(Window.partitionBy(*keys).orderBy("__c")).alias("silent_to_us"),
    )
    found = across
    if limit_us < chunk:
        # Only then can a silence fit inside one chunk.
        inside = rows.select(
            *keys,
            F.col("__t").alias("silent_from_us"),
            F.lead("__t").over(Window.partitionBy(*keys, "__c").orderBy("__t")).alias("silent_to_us"),
        )
        found = across.unionByName(inside)
    gap = F.col("silent_to_us") - F.col("silent_from_us")
    return found.withColumn("gap_us", gap).where(F.col("gap_us") > limit_us)


def cumulative_bytes(
    df: DataFrame, keys: Sequence[str], size: str = "orig_bytes", ts: str = "ts_us", tie: str = "line", chunk: int = CHUNK
) -> DataFrame:
    return ordered.running_totals(df, keys, ts, {"total_bytes": F.col(size)}, [tie], chunk)


def timeline(
    df: DataFrame, phase: str = "phase", ts: str = "ts_us", tie: str = "line", chunk: int = CHUNK
) -> DataFrame:
    """Global order with a rank and a mark where the phase changes; no single sorted task."""
    ranked = ordered.running_totals(df, [], ts, {"rank": F.lit(1).cast("bigint")}, [tie], chunk)
    marked = ordered.carry_last(ranked, [], ts, {"previous_phase": F.col(phase)}, [tie], chunk)
    return marked.withColumn(
        "phase_change", F.coalesce(F.col("previous_phase") != F.col(phase), F.lit(True))
    )


def activity_sessions(
    df: DataFrame,
    keys: Sequence[str],
    gap_us: int,
    sums: Mapping[str, Column] | None = None,
    ts: str = "ts_us",
    chunk: int = CHUNK,
) -> DataFrame:
    """Sessions closed by ``gap_us`` of inactivity."""
    found = ordered.islands(df, keys, ts, gap_us, sums, chunk)
    return found.withColumnRenamed("start", "start_us").withColumnRenamed("end", "end_us")


def rate(
    df: DataFrame, keys: Sequence[str], width_us: int, size: str = "orig_bytes", ts: str = "ts_us", chunk: int = CHUNK
) -> DataFrame:
    """Records and bytes of the trailing ``width_us`` at each record."""
    return ordered.trailing_totals(
        df, keys, ts, {"events": F.lit(1).cast("bigint"), "bytes": F.col(size)}, width_us, chunk
    )


def duplicates(df: DataFrame, keys: Sequence[str], line: str = "line", chunk: int = LINES) -> DataFrame:
    """Rows whose key occurs more than once, with the number of copies and their ordinal."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    repeated = ordered.join_null_safe(df, counts, keys, "inner")
    return ordered.running_totals(repeated, keys, line, {"ordinal": F.lit(1).cast("bigint")}, (), chunk)
