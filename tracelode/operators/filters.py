"""Filters, labels and projections of single records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, net
from ..schemas import TUPLE, TUPLE_FIELDS


def for_host(df: DataFrame, ip: str, src: str = "orig_h", dst: str = "resp_h") -> DataFrame:
    """Records in which the address is either endpoint."""
    return df.where((F.col(src) == ip) | (F.col(dst) == ip))


def with_direction(df: DataFrame, ip: str, src: str = "orig_h", dst: str = "resp_h") -> DataFrame:
    """``direction`` relative to a host. It says nothing about who opened the conversation."""
    return df.withColumn(
        "direction", F.when(F.col(src) == ip, F.lit("out")).when(F.col(dst) == ip, F.lit("in"))
    )


def five_tuple(df: DataFrame, source: str) -> DataFrame:
    """Rename a source's endpoint fields to the canonical key; firewall codes become names."""
    fields = TUPLE_FIELDS[source]
    picked = {name: F.col(f"`{field}`") for name, field in fields.items()}
    for port in ("orig_p", "resp_p"):
        picked[port] = picked[port].cast("bigint")
    if source == "firewall":
        picked["proto"] = net.proto_name(picked["proto"])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in fields.values()]
    return df.select(*[expr.alias(name) for name, expr in picked.items()], *rest)


def orient(packets: DataFrame, host: str | None = None) -> DataFrame:
    """Add the conversation key to packets.

    With ``host`` the host is the originator. Without, the sender of the first SYN-without-ACK is,
    and where there is none the sender of the first packet. First is by packet number; where packets name
    their ``file``, by time, then file and number, since numbers of several captures overlap. Packets with an ``instance``
    (``instances.number``) are oriented for each instance.
    """
    if host is not None:
        out = F.col("src") == host
        return packets.select(
            "*",
            F.when(out, F.col("src")).otherwise(F.col("dst")).alias("orig_h"),
            F.when(out, F.col("sport")).otherwise(F.col("dport")).alias("orig_p"),
            F.when(out, F.col("dst")).otherwise(F.col("src")).alias("resp_h"),
            F.when(out, F.col("dport")).otherwise(F.col("sport")).alias("resp_p"),
            out.alias("from_orig"),
        )
    here = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port"))
    there = F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    ends = packets.withColumn("__a", F.least(here, there)).withColumn("__b", F.greatest(here, there))
    pair = ["__a", "__b", "proto", *(["instance"] if "instance" in packets.columns else [])]
    place = F.struct("ts_us", "file", "packet") if "file" in packets.columns else F.col("packet")
    syn = F.when(net.is_syn(F.col("flags")), place)
    first = ends.groupBy(*pair).agg(F.coalesce(F.min_by(here, syn), F.min_by(here, place)).alias("__opener"))
    from .ordered import join_null_safe

    joined = join_null_safe(ends, first, pair)
    opener = F.col("__opener")
    other = F.when(F.col("__a") == opener, F.col("__b")).otherwise(F.col("__a"))
    return joined.select(
        *packets.columns,
        opener["ip"].alias("orig_h"),
        opener["port"].alias("orig_p"),
        other["ip"].alias("resp_h"),
        other["port"].alias("resp_p"),
        (here == opener).alias("from_orig"),
    )


def handshake_state(packets: DataFrame) -> DataFrame:
    """Per conversation, which steps of opening and closing were seen. Needs ``orient``."""
    syn, ack, fin = (net.has_flag(F.col("flags"), bit) for bit in (net.SYN, net.ACK, net.FIN))
    out = F.col("from_orig")
    seen = packets.where(F.col("proto") == "tcp").groupBy(*TUPLE).agg(
        F.coalesce(F.bool_or(out & syn & ~ack), F.lit(False)).alias("syn"),
        F.coalesce(F.bool_or(~out & syn & ack), F.lit(False)).alias("syn_ack"),
        F.coalesce(F.bool_or(out & ~syn & ack), F.lit(False)).alias("ack"),
        F.coalesce(F.bool_or(out & fin), F.lit(False)).alias("orig_fin"),
        F.coalesce(F.bool_or(~out & fin), F.lit(False)).alias("resp_fin"),
    )
    opened = F.col("syn") & F.col("syn_ack") & F.col("ack")
    return seen.withColumn(
        "state",
        F.when(opened & F.col("orig_fin") & F.col("resp_fin"), "closed")
        .when(opened, "established")
        .when(F.col("syn") & F.col("syn_ack"), "half_open")
        .when(F.col("syn"), "attempt")
        .otherwise("partial"),
    )


def phase(df: DataFrame) -> DataFrame:
    """Activity label of conversations that carry ``starts_post``."""
    return df.withColumn(
        "phase",
        F.when((F.col("proto") == "udp") & (F.col("resp_p") == 53), "dns")
        .when(F.col("starts_post"), "http_upload")
        .otherwise("other_tcp"),
    )


def with_zone(df: DataFrame, ip: str, internal: Sequence[str] = net.PRIVATE, name: str = "zone") -> DataFrame:
    return df.withColumn(name, net.zone(F.col(ip), internal))


def zone_from_table(df: DataFrame, ip: str, cidrs: DataFrame) -> DataFrame:
    """Longest-prefix zone lookup in a table ``(net BIGINT, prefix INT, zone STRING)``.

    Only the prefix lengths that occur (33 at most) are tried, as an equi join on
    (prefix, network). Addresses are looked up once each.
    """
    lengths = sorted(row["prefix"] for row in cidrs.select("prefix").distinct().collect())
    ips = df.select(F.col(ip).alias("__ip")).where(F.col(ip).isNotNull()).distinct()
    tries = [
        F.struct(F.lit(n).alias("prefix"), net.ip_num(F.col("__ip")).bitwiseAND(F.lit(2**32 - 2 ** (32 - n))).alias("net"))
        for n in lengths
    ]
    if not tries:
        return df.withColumn("zone", F.lit(None).cast("string"))
    keys = ips.select("__ip", F.explode(F.array(*tries)).alias("t")).select("__ip", "t.*")
    hits = keys.join(cidrs, ["prefix", "net"]).groupBy("__ip").agg(F.max_by("zone", "prefix").alias("zone"))
    return df.join(hits, df[ip] == hits["__ip"], "left").drop("__ip")


def time_bounds(df: DataFrame, ts: str = "ts_us") -> DataFrame:
    return df.agg(
        F.min(ts).alias("first_us"),
        F.max(ts).alias("last_us"),
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col(ts).isNull()).alias("unknown_time"),
    )


def in_range(df: DataFrame, first_us: int, last_us: int, ts: str = "ts_us") -> DataFrame:
    return df.where(F.col(ts).between(first_us, last_us))


def align_clock(df: DataFrame, offsets: DataFrame, collector: str = "collector", ts: str = "ts_us") -> DataFrame:
    """Apply each collector's clock offset; the printed time stays in ``original_us``.

    A collector without a known offset keeps its time and is marked.
    """
    known = offsets.select(F.col(collector).alias("__c"), F.col("offset_us").alias("__o"))
    joined = df.join(known, df[collector] == known["__c"], "left")
    return (
        joined.withColumn("original_us", F.col(ts))
        .withColumn(ts, F.col(ts) + F.coalesce("__o", F.lit(0)))
        .withColumn("offset_known", F.col("__o").isNotNull())
        .drop("__c", "__o")
    )


def off_hours(df: DataFrame, tz: str, start_hour: int, end_hour: int, ts: str = "ts_us") -> DataFrame:
    return df.withColumn("off_hours", clock.off_hours(F.col(ts), tz, start_hour, end_hour))


# Canonical columns of a normalised event and what each source puts there.
EVENT_COLUMNS = (
    "source event_us source_ip source_port destination_ip destination_port protocol event_type action "
    "bytes_sent bytes_received source_record_id"
).split()


def _text(value: str) -> Column:
    return F.lit(value).cast("string")


def _spec(source: str) -> dict[str, Column]:
    null_long, null_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    base = {"event_type": _text(source), "action": null_text, "bytes_sent": null_long, "bytes_received": null_long}
    extra: Mapping[str, dict[str, Column]] = {
        "dns": {"action": F.col("query")},
        "conn": {"action": F.col("conn_state"), "bytes_sent": F.col("orig_bytes"), "bytes_received": F.col("resp_bytes")},
        "flow": {"bytes_sent": F.col("bytes")},
        "ids": {"action": F.col("signature_id").cast("string")},
        "firewall": {"action": F.col("app"), "bytes_sent": F.col("sentbyte"), "bytes_received": F.col("rcvdbyte")},
    }
    return {**base, **extra[source]}


def normalize(df: DataFrame, source: str) -> DataFrame:
    """Project a parsed source onto the canonical event columns, keeping a record locator."""
    spec = _spec(source)
    return df.select(
        _text(source).alias("source"),
        F.col("ts_us").alias("event_us"),
        F.col("orig_h").alias("source_ip"),
        F.col("orig_p").alias("source_port"),
        F.col("resp_h").alias("destination_ip"),
        F.col("resp_p").alias("destination_port"),
        F.col("proto").alias("protocol"),
        *[expr.alias(name) for name, expr in spec.items()],
        F.concat(F.lit(f"{source}:"), F.col("line").cast("string")).alias("source_record_id"),
    ).select(*EVENT_COLUMNS)
