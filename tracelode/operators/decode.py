"""Frames to packets, packets to DNS and HTTP messages.

Everything up to transport level is JVM-side arithmetic on the bytes. Only DNS messages, whose
names may point backwards into the message, need Python, and only UDP port 53 rows go there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions.binary import hex_prefix, ipv4_at, latin1, u8, u16, u32
from ..functions.clock import iso_utc
from ..functions.text import header, http_parts
from .ordered import locator

IPV4 = 0x0800
ETHERNET_BYTES = 14


def packet_class(frames: DataFrame) -> DataFrame:
    """Capture quality of each frame. Cheap header tests only; nothing is decoded yet."""
    frame = F.col("frame")
    proto = u8(frame, 23)
    fragment = u16(frame, 20).bitwiseAND(F.lit(0x3FFF)) != 0
    kind = (
        F.when(F.length(frame) < ETHERNET_BYTES, "short")
        .when(u16(frame, 12) != IPV4, "non_ipv4")
        .when(F.length(frame) < ETHERNET_BYTES + 20, "short")
        .when(F.shiftright(u8(frame, 14), 4) != 4, "bad_ip")
        .when(F.length(frame) - ETHERNET_BYTES < u16(frame, 16), "bad_ip")
        .when(fragment, "fragment")
        .when(proto == 6, "tcp")
        .when(proto == 17, "udp")
        .otherwise("other_protocol")
    )
    return frames.select(
        "*", kind.alias("packet_class"), (F.col("caplen") != F.col("wirelen")).alias("truncated")
    )


def decode_ip(frames: DataFrame) -> DataFrame:
    """IPv4 header fields of decodable frames; the rest is counted by ``packet_class``."""
    frame = F.col("frame")
    usable = packet_class(frames).where(F.col("packet_class").isin("tcp", "udp", "other_protocol"))
    return usable.select(
        *[c for c in usable.columns if c != "frame"],
        ipv4_at(frame, 26).alias("src"),
        ipv4_at(frame, 30).alias("dst"),
        u8(frame, 23).alias("ip_proto"),
        u16(frame, 16).alias("ip_bytes"),
        (u8(frame, 14).bitwiseAND(F.lit(15)) * 4).alias("ihl"),
        # The IP length bounds the segment, which drops Ethernet padding.
        F.substring(
            frame,
            F.lit(ETHERNET_BYTES + 1) + u8(frame, 14).bitwiseAND(F.lit(15)).cast("int") * 4,
            u16(frame, 16).cast("int") - u8(frame, 14).bitwiseAND(F.lit(15)).cast("int") * 4,
        ).alias("segment"),
    )


_PACKET = ["packet", "ts_us", "src", "dst", "sport", "dport", "proto", "flags", "seq", "ack", "payload",
           "ip_bytes", "payload_bytes", "error"]


def _columns(ip: DataFrame) -> list[str]:
    """Packets keep the file they come from: numbers of several captures overlap."""
    return [*(["file"] if "file" in ip.columns else []), *_PACKET]


def decode_tcp(ip: DataFrame) -> DataFrame:
    """TCP header and payload of ``decode_ip`` rows."""
    seg = F.col("segment")
    header = F.shiftright(u8(seg, 12), 4).cast("int") * 4
    short = (F.length(seg) < 20) | (F.length(seg) < header)
    payload = F.substring(seg, header + 1, F.length(seg))
    return ip.where(F.col("ip_proto") == 6).select(
        "*",
        u16(seg, 0).alias("sport"),
        u16(seg, 2).alias("dport"),
        F.lit("tcp").alias("proto"),
        u8(seg, 13).alias("flags"),
        u32(seg, 4).alias("seq"),
        u32(seg, 8).alias("ack"),
        payload.alias("payload"),
        F.length(payload).cast("bigint").alias("payload_bytes"),
        F.when(short, F.lit("short TCP header")).alias("error"),
    ).select(*_columns(ip))


def decode_udp(ip: DataFrame) -> DataFrame:
    """UDP header and payload of ``decode_ip`` rows; a wrong length field is an error row."""
    seg = F.col("segment")
    wrong = (F.length(seg) < 8) | (u16(seg, 4) != F.length(seg))
    payload = F.substring(seg, F.lit(9), F.length(seg))
    none = F.lit(None).cast("bigint")
    return ip.where(F.col("ip_proto") == 17).select(
        "*",
        u16(seg, 0).alias("sport"),
        u16(seg, 2).alias("dport"),
        F.lit("udp").alias("proto"),
        F.lit(0).cast("bigint").alias("flags"),
        none.alias("seq"),
        none.alias("ack"),
        payload.alias("payload"),
        F.length(payload).cast("bigint").alias("payload_bytes"),
        F.when(wrong, F.lit("UDP length differs")).alias("error"),
    ).select(*_columns(ip))


def decode(frames: DataFrame, strict: bool = False) -> DataFrame:
    """Frames to packets in one pass over the data (no union of two scans).

    Rows that fail a check keep their ``error``. ``strict`` fails the job on the first of them and
    on frames whose IP header is inconsistent.
    """
    classed = packet_class(frames)
    if strict:
        bad = F.col("packet_class").isin("short", "bad_ip")
        classed = classed.where(F.when(bad, F.raise_error(F.concat(F.lit("bad frame "), F.col("packet").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    frame = F.col("frame")
    ihl = u8(frame, 14).bitwiseAND(F.lit(15)).cast("int") * 4
    ip = classed.where(F.col("packet_class").isin("tcp", "udp")).select(
        *(["file"] if "file" in frames.columns else []),
        "packet",
        "ts_us",
        F.col("packet_class").alias("proto"),
        ipv4_at(frame, 26).alias("src"),
        ipv4_at(frame, 30).alias("dst"),
        u16(frame, 16).alias("ip_bytes"),
        F.substring(frame, F.lit(ETHERNET_BYTES + 1) + ihl, u16(frame, 16).cast("int") - ihl).alias("segment"),
    )
    seg, tcp = F.col("segment"), F.col("proto") == "tcp"
    skip = F.when(tcp, F.shiftright(u8(seg, 12), 4).cast("int") * 4).otherwise(F.lit(8))
    payload = F.substring(seg, skip + 1, F.length(seg))
    error = F.when(tcp & ((F.length(seg) < 20) | (F.length(seg) < skip)), "short TCP header").when(
        ~tcp & ((F.length(seg) < 8) | (u16(seg, 4) != F.length(seg))), "UDP length differs"
    )
    out = ip.select(
        "*",
        u16(seg, 0).alias("sport"),
        u16(seg, 2).alias("dport"),
        F.when(tcp, u8(seg, 13)).otherwise(F.lit(0).cast("bigint")).alias("flags"),
        F.when(tcp, u32(seg, 4)).alias("seq"),
        F.when(tcp, u32(seg, 8)).alias("ack"),
        payload.alias("payload"),
        F.length(payload).cast("bigint").alias("payload_bytes"),
        error.alias("error"),
    ).select(*_columns(ip))
    if strict:
        fail = F.raise_error(F.concat(F.col("error"), F.lit(" in packet "), F.col("packet").cast("string")))
        out = out.where(F.when(F.col("error").isNotNull(), fail.cast("boolean")).otherwise(F.lit(True)))
    return out


def packet_index(packets: DataFrame, prefix: int = 120) -> DataFrame:
    """Packet table for review: no payload, only its first bytes in hex. Packets are named by file and number."""
    return packets.select(
        *locator(packets, "packet"),
        iso_utc(F.col("ts_us")).alias("utc"),
        "src",
        "dst",
        "sport",
        "dport",
        "proto",
        "flags",
        "payload_bytes",
        "ip_bytes",
        hex_prefix(F.col("payload"), prefix).alias("payload_prefix_hex"),
    )


def query_packets(packets: DataFrame, cond: Column | str, limit: int, payload_bytes: int) -> DataFrame:
    """The first ``limit`` matching packets by file and number, each with the count of all matches."""
    matched = packets.where(cond)
    total = matched.agg(F.count(F.lit(1)))
    named = locator(packets, "packet")
    shown = matched.orderBy(*named).limit(limit)
    return shown.select(
        *named, "ts_us", "src", "dst", "sport", "dport", "proto", "payload_bytes",
        hex_prefix(F.col("payload"), payload_bytes).alias("payload_hex"),
        (F.col("payload_bytes") > payload_bytes).alias("payload_truncated"),
        total.scalar().alias("matching_packets"),
    ).withColumn("samples_truncated", F.col("matching_packets") > limit)


# --- DNS -----------------------------------------------------------------------------------------

_QUESTION = pa.struct([("name", pa.string()), ("qtype", pa.int64()), ("qclass", pa.int64())])
_ANSWER = pa.struct([("name", pa.string()), ("type", pa.int64()), ("ttl", pa.int64()), ("address", pa.string())])
_DNS_FIELDS = {
    "tid": pa.int64(), "response": pa.bool_(), "rcode": pa.int64(),
    "questions": pa.list_(_QUESTION), "answers": pa.list_(_ANSWER), "authority": pa.int64(), "additional": pa.int64(),
    "error": pa.string(),
}
DNS_COLUMNS = (
    "tid BIGINT, response BOOLEAN, rcode BIGINT, "
    "questions ARRAY<STRUCT<name: STRING, qtype: BIGINT, qclass: BIGINT>>, "
    "answers ARRAY<STRUCT<name: STRING, type: BIGINT, ttl: BIGINT, address: STRING>>, authority BIGINT, additional BIGINT, error STRING"
)


class _Reader:
    """Cursor over one DNS message."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, width: int) -> int:
        chunk = self.take(width)
        return int.from_bytes(chunk, "big")

    def take(self, width: int) -> bytes:
        if self.at + width > len(self.data):
            raise ValueError("message ends early")
        chunk = self.data[self.at : self.at + width]
        self.at += width
        return chunk

    def name(self) -> str:
        labels, visited, resume = [], {self.at}, None
        while (size := self.number(1)) != 0:
            if size >= 0xC0:
                target = (size - 0xC0) * 256 + self.number(1)
                resume = self.at if resume is None else resume
                if target in visited:
                    raise ValueError("name pointer loop")
                visited.add(target)
                self.at = target
            elif size > 63:
                raise ValueError("bad label length")
            else:
                labels.append(self.take(size).decode("ascii"))
        if resume is not None:
            self.at = resume
        return ".".join(labels)


def _parse_dns(data: bytes) -> dict:
    r = _Reader(bytes(data))
    tid, bits, asked, given, authority, extra = (r.number(2) for _ in range(6))
    questions = [{"name": r.name(), "qtype": r.number(2), "qclass": r.number(2)} for _ in range(asked)]

    def record() -> dict:
        name, kind, _cls, ttl, size = r.name(), r.number(2), r.number(2), r.number(4), r.number(2)
        value = r.take(size)
        text = ".".join(map(str, value)) if kind == 1 and size == 4 else value.hex()
        return {"name": name, "type": kind, "ttl": ttl, "address": text}

    answers = [record() for _ in range(given)]
    # other sections are read and counted; modern queries carry one additional record
    for _ in range(authority + extra):
        record()
    if r.at != len(r.data):
        raise ValueError("bytes left over")
    return {
        "tid": tid, "response": bits >= 0x8000, "rcode": bits % 16,
        "questions": questions, "answers": answers, "authority": authority, "additional": extra, "error": None,
    }


def _parse_or_error(data: bytes) -> dict:
    try:
        return _parse_dns(data)
    except (ValueError, UnicodeDecodeError) as error:
        return {"error": str(error)}


def _dns_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parsed = [_parse_or_error(data) for data in batch.column("payload").to_pylist()]
        kept = [name for name in batch.schema.names if name != "payload"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(name) for name in kept]
            + [pa.array([row.get(name) for row in parsed], kind) for name, kind in _DNS_FIELDS.items()],
            names=[*kept, *_DNS_FIELDS],
        )


_ENDS = "packet BIGINT, ts_us BIGINT, src STRING, dst STRING, sport BIGINT, dport BIGINT, proto STRING"


def decode_dns(packets: DataFrame) -> DataFrame:
    """DNS messages of UDP port 53 packets, one row per packet, errors in ``error``."""
    chosen = packets.where(
        (F.col("proto") == "udp")
        & ((F.col("sport") == 53) | (F.col("dport") == 53))
        & F.col("payload").isNotNull()
    )
    ends = [part.split()[0] for part in _ENDS.split(", ")]
    return chosen.select(*ends, "payload").mapInArrow(_dns_batches, f"{_ENDS}, {DNS_COLUMNS}")


def dns_answers(messages: DataFrame) -> DataFrame:
    """One row per answer with its position."""
    return messages.select("packet", F.posexplode("answers").alias("position", "a")).select(
        "packet", "position", "a.*"
    )


# --- HTTP ----------------------------------------------------------------------------------------


def http_messages(packets: DataFrame) -> DataFrame:
    """Requests that lie in one payload: request line, headers and byte counts.

    ``complete`` is false when the body is shorter than Content-Length says (the rest came in
    another packet); it is null when there is no such header.
    """
    requests = packets.where(
        (F.col("proto") == "tcp") & net.starts_with_any(F.col("payload"), net.HTTP_METHODS)
    )
    parts = http_parts(F.col("payload"))
    named = requests.select(*locator(packets, "packet"), "ts_us", "src", "dst", "sport", "dport", *[v.alias(k) for k, v in parts.items()])
    declared = header(F.col("header_list"), "Content-Length").try_cast("bigint")
    return named.select(
        "*",
        declared.alias("content_length"),
        (declared == F.col("body_bytes")).alias("length_agrees"),
        (F.col("body_bytes") >= declared).alias("complete"),
    )


def http_replies(packets: DataFrame) -> DataFrame:
    """Replies whose status line begins a payload: status code and byte counts. ``status`` is null when it is no number."""
    replies = packets.where((F.col("proto") == "tcp") & net.starts_with(F.col("payload"), "HTTP/"))
    parts = http_parts(F.col("payload"))
    line = F.coalesce(parts["request_line"], F.substring_index(latin1(F.col("payload")), "\r\n", 1))
    return replies.select(
        *locator(packets, "packet"), "ts_us", "src", "dst", "sport", "dport", line.alias("status_line"),
        F.get(F.split(line, " "), F.lit(1)).try_cast("bigint").alias("status"),
        *[parts[name].alias(name) for name in ("payload_bytes", "header_bytes", "body_bytes")],
    )


def payload_list(packets: DataFrame) -> DataFrame:
    """Every TCP payload that is no HTTP request, with its text: ``kind`` is ``response`` when it comes from an address and port that
    some request went to, else ``probe``."""
    tcp = packets.where((F.col("proto") == "tcp") & (F.col("payload_bytes") > 0))
    asks = net.starts_with_any(F.col("payload"), net.HTTP_METHODS)
    servers = tcp.where(asks).select(F.col("dst").alias("src"), F.col("dport").alias("sport")).distinct()
    rest = tcp.where(~asks).join(servers.withColumn("__server", F.lit(True)), ["src", "sport"], "left")
    return rest.select(
        *locator(packets, "packet"), "ts_us", "src", "sport", "dst", "dport", "payload_bytes",
        F.when(F.col("__server"), "response").otherwise("probe").alias("kind"), latin1(F.col("payload")).alias("text"),
    )


def body_bytes(requests: DataFrame) -> DataFrame:
    """Distinct byte values of each body, in order."""
    chars = F.array_distinct(F.split(F.col("body"), ""))
    codes = F.array_sort(F.transform(chars, lambda c: F.ascii(c)))
    return requests.select("packet", codes.alias("byte_values"), F.size(codes).cast("bigint").alias("distinct_bytes"))


def payload_text(packets: DataFrame) -> DataFrame:
    return packets.withColumn("text", latin1(F.col("payload")))
