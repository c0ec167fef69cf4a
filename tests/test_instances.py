"""Instances of connections on reused tuples, against a plain walk over the packets."""

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import aggregates, filters, instances, joins, ordered

PACKET = (
    "file string, packet long, ts_us long, src string, dst string, sport long, dport long, proto string, flags long, seq long, "
    "payload binary, ip_bytes long, payload_bytes long, error string"
)
SYN, ACK = 2, 16
IDLE = 1_000_000


def packet(no, ts, src, dst, flags=ACK, seq=0, proto="tcp", error=None, file="a"):
    (sh, sp), (dh, dp) = src, dst
    return (file, no, ts, sh, dh, sp, dp, proto, flags, seq, b"", 60, 20, error)


A, B, C = ("10.0.0.1", 5000), ("10.0.0.2", 80), ("10.0.0.3", 5000)


def walk(rows):
    """Instance of every packet, one packet after the other."""
    last, out = {}, {}
    for f, no, ts, sh, dh, sp, dp, proto, flags, seq, *_, error in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if error or sh is None or dh is None:
            continue
        me = (sh, sp)
        key = (*sorted([me, (dh, dp)]), proto)
        at = last.setdefault(key, {"n": -1, "ts": None, "syn": {}, "open": None})
        opens = flags & SYN and not flags & ACK
        fresh = opens and at["syn"].get(me) != seq and at["open"] not in ({(dh, dp)} - {me})
        if at["ts"] is None or ts - at["ts"] > IDLE or fresh:
            at["n"] += 1
        at["ts"], at["open"] = ts, me if opens else None
        if opens:
            at["syn"][me] = seq
        out[(f, no)] = at["n"]
    return out


def noise(n=600, seed=4):
    rng, rows, ts = random.Random(seed), [], 0
    for i in range(n):
        ts += rng.choice([0, 1, 1000, 200_000, IDLE, IDLE + 1])
        pair = rng.choice([(A, B), (B, A), (A, B), (C, B), (A, C)])
        kind = rng.choice([SYN, SYN, SYN | ACK, ACK, ACK])
        proto = rng.choice(["tcp", "tcp", "tcp", "udp"])
        rows.append(packet(i % 50, ts, *pair, flags=kind if proto == "tcp" else 0, seq=rng.randrange(3), proto=proto, error="bad" if i % 37 == 0 else None, file=f"f{i // 50:02d}"))
    return rows


@pytest.mark.parametrize("hot", [10**9, 50, 0])
def test_numbering_against_a_walk(spark, monkeypatch, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    rows = noise()
    df = spark.createDataFrame(rows, PACKET)
    got = {(r.file, r.packet): r.instance for r in instances.number(df, IDLE, chunk=500_000).collect()}
    assert got == walk(rows) and len(set(got.values())) > 20


def test_what_begins_an_instance(spark):
    rows = [
        packet(1, 0, A, B, SYN, 7), packet(2, 10, A, B, SYN, 7), packet(3, 20, B, A, SYN | ACK, 1), packet(4, 30, A, B, SYN, 7),  # repeated SYN
        packet(5, 40, A, B, SYN, 8), packet(6, 50, B, A, SYN | ACK, 2),  # a new one on the same ports
        packet(7, 60, B, A, SYN, 9), packet(8, 61, A, B, SYN, 10), packet(9, 70, A, B),  # both open at once
        packet(10, 80, A, B, SYN, 11, error="short TCP header"), packet(11, 90, (None, 1), B),
        packet(12, 70 + IDLE, A, B), packet(13, 91 + 2 * IDLE, B, A),  # silence
    ]
    got = {r.packet: r.instance for r in instances.number(spark.createDataFrame(rows, PACKET), IDLE).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 2, 8: 2, 9: 2, 12: 2, 13: 3}
    assert instances.number(spark.createDataFrame([], PACKET)).count() == 0


def numbered(spark):
    day = 86_400_000_000
    rows = []
    for d in range(3):
        rows += [packet(3 * d + 1, d * day, A, B, SYN, d), packet(3 * d + 2, d * day + 5, B, A, SYN | ACK, d), packet(3 * d + 3, d * day + 50, A, B)]
    return instances.number(spark.createDataFrame(rows, PACKET)), day


def test_records_meet_the_instance_of_their_time(spark):
    packets, day = numbered(spark)
    conv = aggregates.conversations(packets)
    assert [(r.instance, r.first_us, r.out_packets, r.in_packets) for r in conv.orderBy("instance").collect()] == [(d, d * day, 2, 1) for d in range(3)]
    times = [(1, 0), (2, day + 3), (3, day + 50 + instances.TOLERANCE), (4, day + 51 + instances.TOLERANCE), (5, 2 * day - instances.TOLERANCE), (6, -instances.TOLERANCE - 1), (7, None)]
    records = spark.createDataFrame([(n, ts, *A, *B, "tcp") for n, ts in times], "line long, ts_us long, orig_h string, orig_p long, resp_h string, resp_p long, proto string")
    got = {r.line: r.instance for r in instances.assign(records, conv).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: None, 5: 2, 6: None, 7: None}
    table = aggregates.conversation_table(conv, records)
    assert sorted((r.instance, r.conn_line) for r in table.collect()) == [(0, 1), (1, 2), (1, 3), (2, 5)]
    plain = aggregates.conversations(packets.drop("instance"))
    assert plain.count() == 1 and "instance" not in plain.columns


def test_reconcile_by_instance(spark):
    packets, day = numbered(spark)
    conv = aggregates.conversations(packets)
    names = {"out_payload_bytes": "orig_bytes", "in_payload_bytes": "resp_bytes", "out_packets": "orig_pkts", "in_packets": "resp_pkts", "out_ip_bytes": "orig_ip_bytes", "in_ip_bytes": "resp_ip_bytes"}
    log = conv.where("instance < 2").select("orig_h", "orig_p", "resp_h", "resp_p", "proto", F.col("instance").alias("line"), F.col("first_us").alias("ts_us"), *[F.col(k).alias(v) for k, v in names.items()])
    log = log.withColumn("orig_bytes", F.col("orig_bytes") + F.when(F.col("line") == 1, 9).otherwise(0))
    got = joins.reconcile(conv.withColumnsRenamed(names), log).select("instance", "field", "pcap", "log").collect()
    assert sorted(tuple(r) for r in got if r.field == "orig_bytes") == [(1, "orig_bytes", 40, 49)]
    assert [(r.instance, r.field) for r in got if r.field != "orig_bytes"] == [(2, "no conn record")]


def test_opener_over_several_captures(spark):
    rows = [packet(9, 100, A, B, SYN, 1, file="first"), packet(1, 200, B, A, SYN | ACK, 1, file="second"), packet(2, 300, A, B, file="second")]
    df = spark.createDataFrame(rows, PACKET)
    assert {(r.orig_h, r.from_orig) for r in filters.orient(df).collect()} == {(A[0], True), (A[0], False)}
    late = spark.createDataFrame([packet(9, 100, A, B, file="first"), packet(1, 200, B, A, file="second")], PACKET)
    assert {r.orig_h for r in aggregates.conversations(late).collect()} == {A[0]}


def test_alerts_over_several_captures(spark):
    rows = [packet(1, 100, A, B, file="x"), packet(1, 100, C, B, file="y"), packet(1, 5000, A, B, file="z")]
    packets = spark.createDataFrame(rows, PACKET)
    shape = "line long, ts_us long, orig_h string, orig_p long, resp_h string, resp_p long, proto string, pcap_count long"
    ids = spark.createDataFrame([(1, 100, *A, *B, "tcp", 1), (2, 900, *A, *B, "tcp", 1), (3, 100, *A, *C, "tcp", 1), (4, 100, *A, *B, "tcp", 8)], shape)
    got = {r.line: (r.packet_file, r.verdict) for r in joins.join_ids_packet(ids, packets, 1).collect()}
    assert got == {1: ("x", "matched"), 2: ("x", "time_differs"), 3: ("x", "tuple_differs"), 4: (None, "no_packet")}
    said = ids.withColumn("pcap_file", F.lit("y"))
    assert {r.line: r.verdict for r in joins.join_ids_packet(said, packets, 1).collect()} == {1: "tuple_differs", 2: "tuple_differs", 3: "tuple_differs", 4: "no_packet"}
    assert joins.join_ids_packet(ids, packets.where("file = 'x'").drop("file"), 1).columns == ["line", "pcap_count", "verdict"]
