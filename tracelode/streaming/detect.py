"""Detections on streams. Input columns are those of the batch operators plus ``event_time``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import to_ts
from ..functions.net import PRIVATE, zone
from ..operators.aggregates import REMOTE_PORTS


def with_event_time(df: DataFrame, delay: str, ts: str = "ts_us", name: str = "event_time") -> DataFrame:
    """Event time as TIMESTAMP with a watermark; rows later than ``delay`` may be dropped by state."""
    return df.withColumn(name, to_ts(F.col(ts))).withWatermark(name, delay)


def outbound_alerts(df: DataFrame, width: str, limit: int, size: str = "orig_bytes") -> DataFrame:
    """Hosts over a byte limit in a tumbling window."""
    return (
        df.groupBy("orig_h", F.window("event_time", width).alias("w"))
        .agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("conversations"))
        .where(F.col("bytes") > limit)
        .select("orig_h", F.unix_micros("w.start").alias("window_us"), "bytes", "conversations")
    )


def fan_out_alerts(
    df: DataFrame,
    width: str,
    slide: str,
    min_peers: int,
    ports: Sequence[int] = REMOTE_PORTS,
    internal: Sequence[str] = PRIVATE,
    rsd: float = 0.01,
) -> DataFrame:
    """Distinct internal peers on remote services in a sliding window: approximate, with little state, so hosts near the limit
    may be missed or added. ``fan_out_exact`` is exact."""
    remote = df.where(F.col("resp_p").isin(*ports) & (zone(F.col("resp_h"), internal) == "internal"))
    return (
        remote.groupBy("orig_h", F.window("event_time", width, slide).alias("w"))
        .agg(F.approx_count_distinct("resp_h", rsd).alias("peers"))
        .where(F.col("peers") >= min_peers)
        .select("orig_h", F.unix_micros("w.start").alias("window_us"), "peers")
    )


def fan_out_exact(
    df: DataFrame, width: str, slide: str, min_peers: int, ports: Sequence[int] = REMOTE_PORTS, internal: Sequence[str] = PRIVATE
) -> DataFrame:
    """Distinct internal peers on remote services in a sliding window, each window once, when the watermark has passed it.

    Two stateful steps in append mode: the distinct pairs of host and peer in each window, then their number per host. State has
    a row for each pair and open window. Rows without both addresses only carry time on.
    """
    remote = F.col("resp_p").isin(*ports) & (zone(F.col("resp_h"), internal) == "internal")
    pairs = (
        df.where(remote | (F.col("orig_h").isNull() & F.col("resp_h").isNull()))
        .groupBy("orig_h", "resp_h", F.window("event_time", width, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    peers = pairs.groupBy("orig_h", "w").agg(F.count("resp_h").alias("peers"))
    return peers.where(F.col("peers") >= min_peers).select("orig_h", F.unix_micros("w.start").alias("window_us"), "peers")


def fan_out_sliding(
    df: DataFrame, width: str, slide: str, min_peers: int, ports: Sequence[int] = REMOTE_PORTS, internal: Sequence[str] = PRIVATE
) -> DataFrame:
    """The exact batch form of ``fan_out_alerts``."""
    remote = df.where(F.col("resp_p").isin(*ports) & (zone(F.col("resp_h"), internal) == "internal"))
    pairs = remote.select(
        "orig_h", "resp_h", F.window(to_ts(F.col("ts_us")), width, slide).alias("w")
    ).select("orig_h", "resp_h", F.unix_micros("w.start").alias("window_us")).distinct()
    return pairs.groupBy("orig_h", "window_us").agg(F.count(F.lit(1)).alias("peers")).where(F.col("peers") >= min_peers)


def sessions(df: DataFrame, gap: str, size: str = "orig_bytes") -> DataFrame:
    """Activity sessions per host. ``end_us`` is the last record, not the end of the silence."""
    return (
        df.groupBy("orig_h", F.session_window("event_time", gap).alias("w"))
        .agg(F.max("ts_us").alias("end_us"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
        .select("orig_h", F.unix_micros("w.start").alias("start_us"), "end_us", "n", "bytes")
    )


def once(df: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Each record once, as long as its copies come within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def dns_then_conn(dns: DataFrame, conn: DataFrame, within: str, outer: bool = False) -> DataFrame:
    """Connections to an answered address within a time after the answer, as a stream-stream join.

    Both sides carry watermarks, so state is dropped once nothing can match any more. ``outer``
    also reports answers that no connection followed.
    """
    d = dns.select(
        F.col("line").alias("dns_line"), F.col("orig_h").alias("d_host"), F.col("answer").alias("d_addr"),
        F.col("event_time").alias("d_time"),
    )
    c = conn.select(F.col("line").alias("conn_line"), "orig_h", "resp_h", F.col("event_time").alias("c_time"))
    cond = (
        (F.col("d_host") == F.col("orig_h"))
        & (F.col("d_addr") == F.col("resp_h"))
        & (F.col("c_time") >= F.col("d_time"))
        & (F.col("c_time") <= F.col("d_time") + F.expr(f"interval {within}"))
    )
    joined = d.join(c, cond, "left_outer" if outer else "inner")
    return joined.select(
        "dns_line", "conn_line", (F.unix_micros("c_time") - F.unix_micros("d_time")).alias("gap_us")
    )


def enrich(stream: DataFrame, assets: DataFrame, ip: str = "orig_h") -> DataFrame:
    """Stream-static left join with an asset table ``(ip, device)``; the table may grow between batches."""
    return stream.join(assets.select(F.col("ip").alias(ip), "device"), ip, "left")


def split_late(on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], delay_us: int):
    """A ``foreachBatch`` function that hands late records to their own table before any watermark.

    A record is late when it was received more than ``delay_us`` after its event time.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        is_late = F.coalesce(F.col("receive_us") - F.col("ts_us") > delay_us, F.lit(False))
        on_time(batch.where(~is_late), batch_id)
        late(batch.where(is_late), batch_id)

    return run


def alert_sink(path: str):
    """A ``foreachBatch`` function that writes each batch to a folder of its own.

    A batch that is run again after a failure replaces its own folder and nothing else.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run
