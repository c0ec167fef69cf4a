"""The example case against its published numbers (fixed values)."""

import pytest
from pyspark.sql import functions as F

from evidence import BACKGROUND, HOST, OUTSIDE, PROBE
from tracelode.plans.case_report import case_report, open_case, write_report
from tracelode.operators import aggregates, decode, detections, filters, joins, ordered

MICRO = 1_000_000


@pytest.fixture(scope="module")
def sources(spark, case):
    paths = {n: str(case / f"{n}.jsonl") for n in ("dns", "conn", "flow", "ids")}
    # Ranges far smaller than one upload frame, so that files are entered in the middle of payloads.
    return open_case(spark, {**paths, "capture": str(case / "capture.pcap"), "firewall": str(case / "firewall.log")}, 1 << 17)


@pytest.fixture(scope="module")
def report(sources):
    return case_report(sources, HOST)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def only(df):
    (row,) = df.collect()
    return row


def test_log_counts(report):
    got = rows(report["log_counts"], "source")
    total = 265 + BACKGROUND
    want = {"dns": (120, 120), "conn": (total, 265), "flow": (total, 265), "ids": (340, 340), "firewall": (total, 265)}
    for name, (records, origin) in want.items():
        row = got[(name,)]
        assert (row.records, row.host_origin, row.host_destination) == (records, origin, 0)
    assert only(report["simulation_counts"]) == ("true", total)


def test_capture_counters(report):
    row = only(report["capture"])
    assert row.packets == 120 * 2 + (145 + BACKGROUND) * 7
    assert (row.host_packets, row.host_out_packets, row.host_in_packets) == (1255, 700, 555)
    assert (row.syn_without_ack, row.dns_queries) == (145 + BACKGROUND, 120)
    assert (row.truncated, row.non_ipv4, row.fragments, row.bad_frames) == (0, 0, 0, 0)


def test_peers_and_patterns(report):
    peers = report["peers"].collect()
    assert len(peers) == 27 and sum(r.conversations for r in peers) == 265
    row = only(report["flag_patterns"])
    assert (row.pattern, row.conversations) == ("[2, 18, 16, 24, 24, 17, 17]", 145)
    states = report["handshakes"].groupBy("state").count().collect()
    assert [tuple(r) for r in states] == [("closed", 145)]


def test_sources_agree(report):
    assert report["disagreements"].count() == 0
    assert report["join_errors"].count() == 0


def test_join_cardinalities(report):
    want = {
        "dns": (120, 120, 120, 145, 0, 0),
        "flow": (265, 265, 265, 0, 1000, 6000),
        "firewall": (265, 265, 265, 0, None, None),
        "ids": (340, 340, 265, 0, 0, 5000),
    }
    for name, (source, matched, conn, without, low, high) in want.items():
        r = only(report[f"cardinality_{name}"])
        got = (r.source_records, r.matched_source_records, r.matched_conn_records, r.conn_records_without_this_source, r.min_delta_us, r.max_delta_us)
        assert got == (source, matched, conn, without, low, high), name
        assert r.unmatched_source_records == 0
    assert report["join_firewall"].where("not printed_time_matches").count() == 0
    assert report["alerts_to_packets"].where("verdict = 'matched'").count() == 340


def test_phases(report):
    got = rows(report["phases"], "phase")
    fields = ("conversations", "out_payload_bytes", "in_payload_bytes", "out_ip_bytes", "in_ip_bytes", "out_packets", "in_packets")
    want = {
        "dns": (120, 5880, 7800, 9240, 11160, 120, 120),
        "http_upload": (120, 6010330, 240, 6029530, 14640, 480, 360),
        "other_tcp": (25, 875, 50, 4875, 3050, 100, 75),
    }
    for name, values in want.items():
        assert tuple(got[(name,)][f] for f in fields) == values
    spacing = {"dns": (119, 60), "http_upload": (119, 10), "other_tcp": (24, 10)}
    for name, (n, seconds) in spacing.items():
        row = got[(name,)]
        assert (row.intervals, row.mean_us, row.sd_us) == (n, seconds * MICRO, 0.0)
    spans = {"dns": 7140_001_000, "http_upload": 1190_006_000, "other_tcp": 240_006_000}
    assert {n: got[(n,)].packet_span_us for n in spans} == spans
    assert (got[("dns",)].first_packet, got[("dns",)].last_packet) == (1, 240)
    assert (got[("http_upload",)].first_packet, got[("http_upload",)].last_packet) == (241, 1080)
    assert (got[("other_tcp",)].first_packet, got[("other_tcp",)].last_packet) == (1081, 1255)
    assert [got[(n,)].peers for n in want] == [1, 1, 25]


def test_phase_gaps_and_lines(report):
    gaps = rows(report["phase_gaps"], "phase")
    assert gaps[("http_upload",)].gap_us == 659_999_000
    assert gaps[("other_tcp",)].gap_us == 609_994_000
    lines = {r.phase: (r.first_line, r.last_line) for r in report["phase_lines"].collect()}
    assert lines == {"dns": (1, 120), "http_upload": (121, 240), "other_tcp": (241, 265)}


def test_ports(report):
    got = rows(report["port_groups"], "resp_p")
    assert {k[0]: (r.connections, r.peers) for k, r in got.items()} == {
        22: (9, 9), 53: (120, 1), 443: (120, 1), 445: (8, 8), 3389: (8, 8)
    }
    for port in (22, 445, 3389):
        assert (got[(port,)].mean_us, got[(port,)].sd_us) == (30 * MICRO, 0.0)
    assert {(r.resp_p, r.conn_state, r.connections) for r in report["states"].collect()} == {
        (22, "SF", 9), (53, "SF", 120), (443, "SF", 120), (445, "SF", 8), (3389, "SF", 8)
    }
    ordered_22 = [r.resp_h for r in report["port_peers"].where("resp_p = 22").orderBy("ip_num").collect()]
    assert ordered_22 == [f"10.70.1.{n}" for n in range(1, 26, 3)]


def test_http(report):
    row = only(report["http"])
    assert (row.requests, row.payload_bytes, row.header_bytes, row.body_bytes) == (120, 6010330, 10330, 6000000)
    assert row.adds_up and row.lengths_agree
    bodies = report["http_bodies"].orderBy("packet").collect()
    assert [r.byte_values for r in bodies] == [[65 + i % 20] for i in range(120)]
    first = report["http_requests"].orderBy("packet").first()
    assert first.request_line == "POST /upload/0 HTTP/1.0" and first.headers["Host"] == "exfil.evidence.example.test"
    texts = {r.text: r.n for r in report["payloads"].collect()}
    assert texts.pop("OK") == 145 and texts == {PROBE.decode(): 25}


def test_dns(report):
    messages = report["dns_messages"]
    assert messages.where("error is not null").count() == 0
    replies = messages.where("response").collect()
    assert len(replies) == 120 and {r.answers[0]["address"] for r in replies} == {OUTSIDE}
    assert {r.tid for r in replies} == set(range(1000, 1120))
    values = {(r.field, r.value) for r in report["dns_values"].collect()}
    assert values == {
        ("query", "c2-course.evidence.example.test"), ("answers", OUTSIDE), ("rcode_name", "NOERROR"), ("ttls", "60.0")
    }


def test_alerts_and_totals(report):
    assert {(r.signature_id, r.alerts) for r in report["signatures"].collect()} == {(1300101, 120), (1300102, 120), (1300103, 100)}
    assert {(r.k, r.n) for r in report["alerts_per_conn"].collect()} == {(1, 240), (4, 25)}
    totals = only(report["totals"])
    assert (totals.out_payload_bytes, totals.in_payload_bytes, totals.out_packets, totals.in_packets) == (6017085, 8090, 700, 555)
    assert totals.flow_bytes == 6017085
    zones = {(r.zone, r.resp_h): r.bytes for r in report["bytes_by_destination"].collect()}
    assert zones[("external", None)] == 6010330 and zones[(None, None)] == 6017085


def test_conflicts_matrix_and_scan(report):
    conflicts = report["label_conflicts"].select("label", "observed_protocol").distinct().collect()
    assert [tuple(r) for r in conflicts] == [("HTTPS", "http")] and report["label_conflicts"].count() == 120
    matrix = report["evidence_matrix"].groupBy("sources_seen", "bytes_agree").count().collect()
    assert {tuple(r) for r in matrix} == {(6, True, 120), (5, True, 145)}
    scan = only(report["sequential_scan"].orderBy(F.desc("hosts")).limit(1))
    assert (scan.hosts, scan.ports) == (25, 3)


def test_general_orientation_agrees_with_host(sources):
    packets = filters.for_host(decode.decode(sources.frames), HOST, "src", "dst")
    assert filters.orient(packets).exceptAll(filters.orient(packets, HOST)).count() == 0
    a, b = aggregates.conversations(packets), aggregates.conversations(packets, HOST)
    assert a.exceptAll(b).count() == 0 and a.count() == 265


def test_swapping_sides_swaps_bytes(sources):
    packets = decode.decode(sources.frames)
    host = aggregates.conversations(packets, HOST).where(f"resp_h = '{OUTSIDE}'").agg(F.sum("out_payload_bytes"), F.sum("in_payload_bytes")).first()
    peer = aggregates.conversations(packets, OUTSIDE).agg(F.sum("in_payload_bytes"), F.sum("out_payload_bytes")).first()
    assert tuple(host) == tuple(peer)


def test_detections_find_the_host(sources):
    beacons = [r for r in ordered.interval_stats(sources.conn, ["orig_h", "resp_h"]).where("intervals >= 50 and sd_us = 0").collect()]
    assert {(r.orig_h, r.resp_h) for r in beacons} == {(HOST, "10.70.0.53"), (HOST, OUTSIDE)}
    over = aggregates.outbound_over(sources.conn, 900 * MICRO, 1_000_000).collect()
    assert {r.orig_h for r in over} == {HOST}
    fan = aggregates.fan_out(sources.conn, 900 * MICRO, 20).collect()
    assert [(r.orig_h, r.peers) for r in fan] == [(HOST, 25)]
    rare = aggregates.name_prevalence(sources.dns, 1).collect()
    assert [(r.hosts, r.queries) for r in rare] == [(1, 120)]
    conn = sources.conn.withColumnRenamed("orig_h", "host")

    def episode(cond):
        return conn.where(cond).groupBy("host").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))

    steps = [("lookups", episode("resp_p = 53")), ("upload", episode("resp_p = 443")), ("spread", episode("resp_p in (22, 445, 3389)"))]
    assert [r.host for r in detections.sequence(steps, 3600 * MICRO).collect()] == [HOST]
    assert detections.sequence(steps, 600 * MICRO).count() == 0
    next_conn = joins.dns_to_conn(sources.dns.withColumn("answer", F.col("answers")[0]), sources.conn, 3 * 3600 * MICRO)
    found = next_conn.where("conn_line is not null").collect()
    assert len(found) == 120 and {r.conn_line for r in found} == {121}
    hosts = decode.http_messages(decode.decode(sources.frames)).select(F.col("headers")["Host"].alias("name")).distinct()
    assert [r.name for r in joins.unresolved_names(hosts, sources.dns).collect()] == ["exfil.evidence.example.test"]


def test_report_is_written_once(spark, report, tmp_path):
    small = {k: report[k] for k in ("phases", "conversations")}
    write_report(small, f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in (tmp_path / "out" / "conversations").glob("part-*"))
    assert text.startswith('"orig_h"\t"orig_p"')
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_report(small, f"file://{tmp_path}/out")
