"""Test-only builder of the example case: one host's traffic, background hosts and five logs.

The host's figures are fixed values of the published case; the background is invented.
"""

from __future__ import annotations

import json
import socket
import struct
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

HOST, RESOLVER, OUTSIDE = "10.70.0.66", "10.70.0.53", "203.0.113.66"
DAY = 1787529600  # 2026-08-24 00:00:00 UTC
BACKGROUND = 500
PROBE = b"LAB13 coherent remote service probe"
FLAGS = [2, 18, 16, 24, 24, 17, 17]
OUTWARD = [True, False, True, True, False, True, False]


@dataclass
class Conversation:
    proto: str
    src: str
    sport: int
    dst: str
    dport: int
    start_us: int
    packets: list  # (offset_us, outward, flags, payload)
    uid: str = ""


def _name(text: str) -> bytes:
    return b"".join(bytes([len(x)]) + x.encode() for x in text.split(".")) + b"\0"


def dns_payloads(tid: int) -> tuple[bytes, bytes]:
    question = _name("c2-course.evidence.example.test") + struct.pack("!HH", 1, 1)
    query = struct.pack("!HHHHHH", tid, 0x0100, 1, 0, 0, 0) + question
    answer = b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 60, 4) + socket.inet_aton(OUTSIDE)
    return query, struct.pack("!HHHHHH", tid, 0x8180, 1, 1, 0, 0) + question + answer


def _tcp(request: bytes, reply: bytes) -> list:
    payloads = [b"", b"", b"", request, reply, b"", b""]
    return [(1000 * i, OUTWARD[i], FLAGS[i], payloads[i]) for i in range(7)]


def conversations() -> list[Conversation]:
    out = []
    for i in range(120):
        query, response = dns_payloads(1000 + i)
        out.append(
            Conversation("udp", HOST, 40000 + i, RESOLVER, 53, (DAY + 60 * i) * 10**6, [(0, True, 0, query), (1000, False, 0, response)])
        )
    for i in range(120):
        body = bytes([65 + i % 20]) * 50000
        head = f"POST /upload/{i} HTTP/1.0\r\nHost: exfil.evidence.example.test\r\nContent-Length: 50000\r\n\r\n".encode()
        start = DAY + 2 * 3600 + 600 + 10 * i
        out.append(Conversation("tcp", HOST, 40120 + i, OUTSIDE, 443, start * 10**6, _tcp(head + body, b"OK")))
    for n in range(1, 26):
        start = DAY + 2 * 3600 + 2400 + 10 * (n - 1)
        port = (22, 445, 3389)[(n - 1) % 3]
        out.append(Conversation("tcp", HOST, 40239 + n, f"10.70.1.{n}", port, start * 10**6, _tcp(PROBE, b"OK")))
    for j in range(BACKGROUND):
        out.append(
            Conversation(
                "tcp", f"10.80.{j // 200}.{j % 200 + 1}", 20000 + j, f"10.90.0.{j % 50 + 1}", 8080,
                (DAY + 3 * 3600 + j) * 10**6, _tcp(b"hello %d" % j, b"world"),
            )
        )
    for number, conv in enumerate(out):
        conv.uid = f"C{number:05d}"
    return out


def frame(conv: Conversation, outward: bool, flags: int, payload: bytes) -> bytes:
    src, sport, dst, dport = conv.src, conv.sport, conv.dst, conv.dport
    if not outward:
        src, sport, dst, dport = dst, dport, src, sport
    if conv.proto == "udp":
        segment = struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) + payload
    else:
        segment = struct.pack("!HHIIBBHHH", sport, dport, 4_000_000_000, 1, 0x50, flags, 65535, 0, 0) + payload
    return ethernet(ipv4(src, dst, 17 if conv.proto == "udp" else 6, segment))


def ipv4(src: str, dst: str, proto: int, segment: bytes, frag: int = 0x4000) -> bytes:
    head = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(segment), 0, frag, 64, proto, 0)
    return head + socket.inet_aton(src) + socket.inet_aton(dst) + segment


def ethernet(packet: bytes, kind: int = 0x0800) -> bytes:
    return b"\2\0\0\0\0\1\2\0\0\0\0\2" + struct.pack("!H", kind) + packet


def pcap_header(magic: bytes = b"\xd4\xc3\xb2\xa1", link: int = 1) -> bytes:
    return magic + struct.pack("<HHiIII", 2, 4, 0, 0, 262144, link)


def record(ts_us: int, data: bytes, wirelen: int | None = None) -> bytes:
    return struct.pack("<IIII", ts_us // 10**6, ts_us % 10**6, len(data), wirelen or len(data)) + data


def build(folder: Path) -> None:
    pcap, dns, conn, flow, ids, fw = [pcap_header()], [], [], [], [], []
    number = 0
    for conv in conversations():
        numbers = []
        for offset, outward, flags, payload in conv.packets:
            number += 1
            numbers.append(number)
            pcap.append(record(conv.start_us + offset, frame(conv, outward, flags, payload)))
        overhead = 28 if conv.proto == "udp" else 40
        sides = {True: [p for *_, o, _f, p in conv.packets if o], False: [p for *_, o, _f, p in conv.packets if not o]}
        sizes = {side: sum(map(len, payloads)) for side, payloads in sides.items()}
        ts = conv.start_us / 1e6
        ends = {
            "id.orig_h": conv.src, "id.orig_p": conv.sport, "id.resp_h": conv.dst, "id.resp_p": conv.dport, "proto": conv.proto,
        }
        tuple_ = {
            "source_ip": conv.src, "source_port": conv.sport, "destination_ip": conv.dst, "destination_port": conv.dport,
            "network_protocol": conv.proto,
        }
        last = conv.start_us + conv.packets[-1][0]
        conn.append(
            {
                "ts": ts, "uid": conv.uid, **ends, "duration": (last - conv.start_us) / 1e6, "orig_bytes": sizes[True],
                "resp_bytes": sizes[False], "conn_state": "SF", "history": "Dd" if conv.proto == "udp" else "ShADdFf",
                "orig_pkts": len(sides[True]), "orig_ip_bytes": sizes[True] + overhead * len(sides[True]),
                "resp_pkts": len(sides[False]), "resp_ip_bytes": sizes[False] + overhead * len(sides[False]),
            }
        )
        flow.append({"ts": last / 1e6, **tuple_, "bytes": sizes[True], "packets": len(sides[True])})
        stamp = datetime.fromtimestamp(conv.start_us // 10**6, timezone.utc)
        app = {443: "HTTPS", 53: "DNS"}.get(conv.dport, "")
        fw.append(
            f'date={stamp:%Y-%m-%d} time={stamp:%H:%M:%S} devname="edge \\"1\\"" srcip={conv.src} srcport={conv.sport} dstip={conv.dst} '
            f'dstport={conv.dport} proto={17 if conv.proto == "udp" else 6} sentbyte={sizes[True]} rcvdbyte={sizes[False]} '
            f'parentuid="{conv.uid}" app="{app}" dstintf="{"wan" if conv.dst == OUTSIDE else "lan"}" zeekstate=SF '
            'simulation="true" evidence_origin="pcap-derived"'
        )
        if conv.src != HOST:
            continue
        alerts = {"udp": [0]}.get(conv.proto) or ([5] if conv.dport == 443 else [0, 2, 3, 5])
        signature = 1300101 if conv.proto == "udp" else 1300102 if conv.dport == 443 else 1300103
        for at in alerts:
            offset, outward, _flags, _payload = conv.packets[at]
            assert outward
            ids.append(
                {
                    "ts": (conv.start_us + offset) / 1e6, **tuple_, "pcap_count": numbers[at], "signature_id": signature,
                    "application_protocol": "http" if conv.dport == 443 else "failed",
                }
            )
        if conv.proto == "udp":
            dns.append(
                {
                    "ts": ts, "uid": conv.uid, **ends, "trans_id": 1000 + len(dns), "rtt": 0.001,
                    "query": "c2-course.evidence.example.test", "qclass": 1, "qclass_name": "C_INTERNET", "qtype": 1,
                    "qtype_name": "A", "rcode": 0, "rcode_name": "NOERROR", "AA": False, "TC": False, "RD": True, "RA": True,
                    "Z": 0, "answers": [OUTSIDE], "TTLs": [60.0], "rejected": False,
                }
            )
    (folder / "capture.pcap").write_bytes(b"".join(pcap))
    for name, rows in (("dns", dns), ("conn", conn), ("flow", flow), ("ids", ids)):
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (folder / "firewall.log").write_text("".join(line + "\n" for line in fw))
