"""Addresses, protocols, flags and payload observation."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import u8, u16

FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16

# RFC 1918 private ranges.
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")

# Request methods that open an HTTP/1.x message.
HTTP_METHODS = ("GET ", "POST ", "PUT ", "HEAD ", "DELETE ", "OPTIONS ", "PATCH ")


def ip_num(ip: Column) -> Column:
    """Dotted IPv4 text as an unsigned number, for numeric order and masks."""
    part = F.split(ip, r"\.")
    return (
        part[0].cast("bigint") * 16777216
        + part[1].cast("bigint") * 65536
        + part[2].cast("bigint") * 256
        + part[3].cast("bigint")
    )


def ip_text(num: Column) -> Column:
    return F.concat_ws(
        ".", *[F.shiftright(num, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    )


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def is_syn(flags: Column) -> Column:
    """Initial SYN: SYN set and ACK clear."""
    return has_flag(flags, SYN) & ~has_flag(flags, ACK)


def proto_name(code: Column) -> Column:
    """IP protocol number (as text or integer) to a name; other numbers give null."""
    text = code.cast("string")
    return F.when(text == "6", F.lit("tcp")).when(text == "17", F.lit("udp"))


def in_cidr(ip: Column, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr)
    mask = int(net.netmask)
    return ip_num(ip).bitwiseAND(F.lit(mask)) == F.lit(int(net.network_address))


def zone(ip: Column, internal: Sequence[str] = PRIVATE) -> Column:
    """'internal' when the address lies in one of the given ranges, else 'external'."""
    inside = F.lit(False)
    for cidr in internal:
        inside = inside | in_cidr(ip, cidr)
    return F.when(inside, F.lit("internal")).otherwise(F.lit("external"))


def is_dns_query(proto: Column, dport: Column, payload: Column) -> Column:
    """UDP to port 53 with a full header whose response bit is clear."""
    return F.coalesce(
        (proto == "udp")
        & (dport == 53)
        & (F.length(payload) >= 12)
        & (u16(payload, 2).bitwiseAND(F.lit(0x8000)) == 0),
        F.lit(False),
    )


def starts_with(payload: Column, text: str) -> Column:
    return F.startswith(payload, F.lit(bytearray(text.encode("latin-1"))))


def starts_with_any(payload: Column, texts: Sequence[str]) -> Column:
    """``starts_with`` for several texts. The payload is named once: its expression is not worked out again for each text."""
    head = F.decode(F.substring(payload, 1, max(map(len, texts))), "ISO-8859-1")
    return F.regexp_like(head, F.lit("^(?:" + "|".join(map(re.escape, texts)) + ")"))


def observe_protocol(payload: Column, proto: Column, sport: Column, dport: Column) -> Column:
    """What the payload bytes show, independent of any label."""
    http = starts_with_any(payload, ("HTTP/", *HTTP_METHODS))
    first = u8(payload, 0)
    tls = (proto == "tcp") & (F.length(payload) >= 3) & first.between(20, 23) & (u8(payload, 1) == 3)
    dns = (proto == "udp") & ((sport == 53) | (dport == 53)) & (F.length(payload) >= 12)
    return (
        F.when(http, F.lit("http"))
        .when(tls, F.lit("tls"))
        .when(dns, F.lit("dns"))
        .otherwise(F.lit("not_established"))
    )
