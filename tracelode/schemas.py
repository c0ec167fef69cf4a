"""Declared schemas of the evidence sources and their canonical column names."""

from __future__ import annotations

# The directed connection key.
TUPLE = ["orig_h", "orig_p", "resp_h", "resp_p", "proto"]

_IDS = "`id.orig_h` STRING, `id.orig_p` BIGINT, `id.resp_h` STRING, `id.resp_p` BIGINT, proto STRING"

DNS = (
    f"ts DOUBLE, uid STRING, {_IDS}, trans_id BIGINT, rtt DOUBLE, query STRING, qclass INT, qclass_name STRING, "
    "qtype INT, qtype_name STRING, rcode INT, rcode_name STRING, AA BOOLEAN, TC BOOLEAN, RD BOOLEAN, RA BOOLEAN, "
    "Z INT, answers ARRAY<STRING>, TTLs ARRAY<DOUBLE>, rejected BOOLEAN"
)
CONN = (
    f"ts DOUBLE, uid STRING, {_IDS}, duration DOUBLE, orig_bytes BIGINT, resp_bytes BIGINT, conn_state STRING, "
    "history STRING, orig_pkts BIGINT, orig_ip_bytes BIGINT, resp_pkts BIGINT, resp_ip_bytes BIGINT"
)
_FLOW = (
    "ts DOUBLE, source_ip STRING, source_port BIGINT, destination_ip STRING, destination_port BIGINT, "
    "network_protocol STRING"
)
FLOW = f"{_FLOW}, bytes BIGINT, packets BIGINT"
IDS = f"{_FLOW}, pcap_count BIGINT, signature_id BIGINT, application_protocol STRING"

FIREWALL_FIELDS = (
    "date time srcip srcport dstip dstport proto sentbyte rcvdbyte parentuid app dstintf zeekstate "
    "simulation evidence_origin"
).split()

MANIFEST = (
    "schema STRING, case_id STRING, source_relationship STRING, sources ARRAY<STRUCT<id: STRING, "
    "archive: STRING, member: STRING, path: STRING, bytes: BIGINT, sha256: STRING, analysis: STRING, "
    "records: BIGINT, archive_sha256: STRING>>"
)

PACKET_RECORD = "packet BIGINT, ts_us BIGINT, caplen INT, wirelen INT, frame BINARY, file STRING"

# How each source spells the connection key.
_ZEEK = dict(zip(TUPLE, ("id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto")))
_NETFLOW = dict(
    zip(TUPLE, ("source_ip", "source_port", "destination_ip", "destination_port", "network_protocol"))
)
_FORTI = dict(zip(TUPLE, ("srcip", "srcport", "dstip", "dstport", "proto")))
TUPLE_FIELDS = {"dns": _ZEEK, "conn": _ZEEK, "flow": _NETFLOW, "ids": _NETFLOW, "firewall": _FORTI}

SCHEMAS = {"dns": DNS, "conn": CONN, "flow": FLOW, "ids": IDS}
