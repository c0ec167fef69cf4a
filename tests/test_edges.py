"""Inputs at the edge of what the formats allow."""

import json
import struct

import pytest
from pyspark.sql import functions as F

import evidence as ev
from tracelode.functions import net
from tracelode.functions.text import http_parts
from tracelode.operators import aggregates, decode, detections, filters, governance, integrity, joins, ordered, sets, temporal
from tracelode.sources import archive, logs, pcap

SCHEMA = "packet BIGINT, ts_us BIGINT, caplen INT, wirelen INT, frame BINARY, file STRING"


def frames(spark, *data):
    return spark.createDataFrame(
        [(i + 1, 1000 * i, len(d), wire or len(d), bytearray(d), "f") for i, (d, wire) in enumerate(data)], SCHEMA
    )


def udp(payload, sport=5000, dport=53, length=None):
    return struct.pack("!HHHH", sport, dport, length or 8 + len(payload), 0) + payload


def test_packet_classes(spark):
    good = ev.ethernet(ev.ipv4("10.0.0.1", "10.0.0.2", 17, udp(b"x")))
    df = frames(
        spark, (good, None), (good, len(good) + 9), (ev.ethernet(b"\0" * 40, 0x86DD), None),
        (ev.ethernet(ev.ipv4("10.0.0.1", "10.0.0.2", 17, udp(b"x"), frag=0x2000)), None),
        (ev.ethernet(ev.ipv4("10.0.0.1", "10.0.0.2", 1, b"\0" * 8)), None), (b"\1\2\3", None),
        (good[:-3], None),
    )
    got = [(r.packet_class, r.truncated) for r in decode.packet_class(df).orderBy("packet").collect()]
    assert got == [
        ("udp", False), ("udp", True), ("non_ipv4", False), ("fragment", False), ("other_protocol", False), ("short", False), ("bad_ip", False)
    ]
    assert decode.decode(df).count() == 2
    with pytest.raises(Exception, match="bad frame"):
        decode.decode(df, strict=True).collect()
    row = aggregates.capture_summary(df, "10.0.0.1").first()
    assert (row.packets, row.host_packets, row.non_ipv4, row.fragments, row.other_protocol, row.bad_frames) == (7, 2, 1, 1, 1, 2)


def test_udp_length_must_agree(spark):
    df = frames(spark, (ev.ethernet(ev.ipv4("10.0.0.1", "10.0.0.2", 17, udp(b"abc", length=99))), None))
    assert decode.decode(df).first().error == "UDP length differs"
    assert decode.decode_udp(decode.decode_ip(df)).first().error == "UDP length differs"
    with pytest.raises(Exception, match="UDP length differs"):
        decode.decode(df, strict=True).collect()


def test_high_bytes_survive(spark):
    payload = bytes(range(256))
    df = frames(spark, (ev.ethernet(ev.ipv4("10.0.0.1", "10.0.0.2", 17, udp(payload, 1, 2))), None))
    row = decode.payload_text(decode.decode(df)).first()
    assert bytes(row.payload) == payload and row.text == payload.decode("latin-1")


def test_decode_forms_agree(spark):
    convs = ev.conversations()[:3] + ev.conversations()[120:123]
    data = [(ev.frame(c, o, f, p), None) for c in convs for _, o, f, p in c.packets]
    df = frames(spark, *data)
    ip = decode.decode_ip(df)
    apart = decode.decode_tcp(ip).unionByName(decode.decode_udp(ip))
    assert apart.exceptAll(decode.decode(df)).count() == 0 and apart.count() == len(data)


def dns_rows(spark, *payloads):
    df = spark.createDataFrame(
        [(i, 0, "a", "b", 1, 53, "udp", bytearray(p)) for i, p in enumerate(payloads)],
        "packet BIGINT, ts_us BIGINT, src STRING, dst STRING, sport BIGINT, dport BIGINT, proto STRING, payload BINARY",
    )
    return decode.decode_dns(df).orderBy("packet").collect()


def test_dns_errors_are_rows(spark):
    query, reply = ev.dns_payloads(7)
    head = struct.pack("!HHHHHH", 1, 0, 1, 0, 0, 0)
    loop = head + b"\xc0\x0c" + b"\0\1\0\1"
    aaaa = reply[:-16] + b"\xc0\x0c" + struct.pack("!HHIH", 28, 1, 5, 3) + b"\1\2\xff"
    extra = struct.pack("!HHHHHH", 1, 0, 0, 0, 0, 1)
    edns = query[:11] + b"\1" + query[12:] + b"\0" + struct.pack("!HHIH", 41, 1232, 0, 0)
    got = dns_rows(spark, query, reply, loop, query + b"!", query[:20], aaaa, extra, edns, b"\0\1")
    assert [r.error for r in got] == [
        None, None, "name pointer loop", "bytes left over", "message ends early", None, "message ends early", None, "message ends early"
    ]
    assert got[7].questions == got[0].questions and (got[7].authority, got[7].additional) == (0, 1)
    assert got[1].answers[0]["address"] == ev.OUTSIDE and got[5].answers[0]["address"] == "0102ff"


def test_key_value_lines(spark):
    lines = spark.createDataFrame(
        [
            (1, 'a=1 b="x y" c=""'), (2, r'a="say \"hi\" \\ ok" b=2'), (3, "a=1 junk b=2"), (4, "a=1 a=2"), (5, 'a="msg b=9" b=3'),
            (6, 'a="\\u00e9" b=x"y'),
        ],
        "line BIGINT, raw STRING",
    )
    got = {r.line: (r.a, r.b, r.c, r.error) for r in logs.parse_kv(lines, ["a", "b", "c"]).collect()}
    assert got[1] == ("1", "x y", "", None)
    assert got[2] == ('say "hi" \\ ok', "2", None, None)
    assert got[3][3] == "unparsed text"
    assert got[4][0] == "2"
    assert got[5][:2] == ("msg b=9", "3")
    assert got[6][:2] == ("é", 'x"y')
    with pytest.raises(Exception, match="unparsed text in line 3"):
        logs.fail_on_error(logs.parse_kv(lines, ["a"])).collect()


def test_malformed_json_goes_to_errors(spark, tmp_path):
    good = {"ts": 1787529600.0009999, "uid": "u", "id.orig_h": "1.2.3.4", "id.orig_p": 1, "id.resp_h": "5.6.7.8", "id.resp_p": 2, "proto": "tcp"}
    path = tmp_path / "conn.jsonl"
    path.write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"uid": "x"}) + "\n")
    parsed = logs.parse_json(logs.text_lines(spark, str(path)), logs.SCHEMAS["conn"])
    usable, errors = logs.split_errors(parsed)
    assert [(r.line, r.error) for r in errors.orderBy("line").collect()] == [(2, "malformed JSON"), (3, "required field missing")]
    row = logs.canonical(usable, "conn").first()
    assert (row.ts_us, row.orig_h, row.line) == (1787529600_001_000, "1.2.3.4", 1)
    assert logs.read_jsonl(spark, str(path), "conn", strict=False).count() == 1
    with pytest.raises(Exception, match="malformed JSON in line 2"):
        logs.read_jsonl(spark, str(path), "conn").collect()


@pytest.mark.parametrize("split", [100, 1000, 7777])
def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    for name, n in (("a.log", 700), ("b.log", 333)):
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 37)}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = logs.text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    assert len(got) == 1033 and all(r.raw.split()[1] == str(r.line) for r in got)


def test_pages_of_lines(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "line")
    page = logs.read_lines(df, 1, 4).collect()
    assert len(page) == 4 and {(r.next_line, r.reached_eof) for r in page} == {(5, False)}
    page = logs.read_lines(df, 7, 4).collect()
    assert {(r.next_line, r.reached_eof) for r in page} == {(None, True)}


# --- captures ------------------------------------------------------------------------------------


def write_pcap(path, records, head=None):
    path.write_bytes((head or ev.pcap_header()) + b"".join(records))
    return str(path)


def test_capture_with_records_inside_payloads(spark, tmp_path):
    """Payloads that themselves look like chains of records must not shift packet numbers."""
    inner = b"".join(ev.record(10**6 * i, b"\0" * 20) for i in range(40))
    records = [ev.record(10**6 * i, ev.ethernet(ev.ipv4("10.0.0.1", "10.0.0.2", 17, udp(inner, 1, 2)))) for i in range(60)]
    path = write_pcap(tmp_path / "tricky.pcap", records)
    for split in (500, 4096, 1 << 20):
        got = pcap.read_pcap(spark, path, split_bytes=split).select("packet", "ts_us").orderBy("packet").collect()
        assert [tuple(r) for r in got] == [(i + 1, 10**6 * i) for i in range(60)]


def test_capture_errors(spark, tmp_path):
    ok = ev.record(0, b"\0" * 60)
    cases = {
        "magic": (write_pcap(tmp_path / "magic.pcap", [ok], ev.pcap_header(b"\xa1\xb2\xc3\xd4")), "not a little-endian"),
        "link": (write_pcap(tmp_path / "link.pcap", [ok], ev.pcap_header(link=101)), "link type 101"),
        "short": (write_pcap(tmp_path / "short.pcap", [ok, ok[:-5]]), "cut short"),
        "header": (write_pcap(tmp_path / "header.pcap", [ok, b"\0" * 7]), "cut short"),
    }
    pcap.register(spark)
    for path, message in cases.values():
        with pytest.raises(Exception, match=message):
            pcap.read_pcap(spark, path).collect()
        with pytest.raises(Exception, match=message):
            spark.read.format("pcap").load(path).collect()


def test_empty_capture_and_folder(spark, tmp_path):
    write_pcap(tmp_path / "a.pcap", [])
    write_pcap(tmp_path / "b.pcap", [ev.record(i, b"\0" * 60) for i in range(5)])
    pcap.register(spark)
    for df in (pcap.read_pcap(spark, str(tmp_path)), spark.read.format("pcap").load(str(tmp_path))):
        assert sorted(r.packet for r in df.collect()) == [1, 2, 3, 4, 5]
    index = pcap.capture_index(spark, str(tmp_path), 100)
    again = pcap.read_pcap(spark, str(tmp_path), index=index)
    assert again.count() == 5
    some = pcap.read_pcap(spark, str(tmp_path), index=index, packets=(2, 4))
    assert sorted(r.packet for r in some.collect()) == [2, 3, 4]


# --- joins ---------------------------------------------------------------------------------------


def test_null_identifiers_do_not_match(spark):
    left = spark.createDataFrame([(1, None), (2, "u"), (3, None)], "line BIGINT, uid STRING")
    right = spark.createDataFrame([(7, "u"), (8, None)], "other BIGINT, uid STRING")
    assert {(r.line, r.other) for r in joins.lookup(left, right, ["uid"]).collect()} == {(1, None), (2, 7), (3, None)}


CONV = "orig_h STRING, orig_p BIGINT, resp_h STRING, resp_p BIGINT, proto STRING"


def test_reconcile_lists_each_field(spark):
    counters = ", ".join(f"{c} BIGINT" for c in joins.COUNTERS)
    t = ("a", 1, "b", 2, "tcp")
    conv = spark.createDataFrame([(*t, 100, 1, 2, 3, 4, 5, 6), ("x", *t[1:], 0, 1, 2, 3, 4, 5, 6)], f"{CONV}, first_us BIGINT, {counters}")
    conn = spark.createDataFrame([(*t, 9, 102, 1, 2, 3, 4, 5, 7)], f"{CONV}, line BIGINT, ts_us BIGINT, {counters}")
    got = {(r.orig_h, r.field, r.pcap, r.log) for r in joins.reconcile(conv, conn).collect()}
    assert got == {("a", "resp_ip_bytes", 6, 7), ("a", "ts", 100, 102), ("x", "no conn record", None, None)}
    near = conn.withColumn("ts_us", F.lit(101).cast("bigint")).withColumn("resp_ip_bytes", F.lit(6).cast("bigint"))
    assert joins.reconcile(conv.where("orig_h = 'a'"), near).count() == 0


def test_compare_copies_counts_duplicates(spark):
    schema = "k BIGINT, v STRING"
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "q"), (4, "q")], schema)
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "q"), (5, "z")], schema)
    got = {r.k: r.status for r in joins.compare_copies(a, b, ["k"], ["v"]).collect()}
    assert got == {2: "differs", 4: "differs", 5: "missing_in_a"}
    diff = {tuple(r) for r in sets.run_differences(a, b).collect()}
    assert diff == {(2, "x", 1), (2, "y", -1), (4, "q", 1), (5, "z", -1)}


def test_overlapping_leases_are_reported(spark):
    df = spark.createDataFrame(
        [("a", "d1", 0, 10), ("a", "d2", 5, 20), ("b", "d3", 0, None), ("b", "d4", 50, 60)],
        "ip STRING, device STRING, valid_from_us BIGINT, valid_to_us BIGINT",
    )
    assert {r.device for r in joins.lease_overlaps(df).collect()} == {"d2", "d4"}


def test_http_over_two_packets_is_incomplete(spark):
    whole = b"POST /x HTTP/1.0\r\nContent-Length: 10\r\n\r\n12345"
    df = spark.createDataFrame(
        [(1, bytearray(whole)), (2, bytearray(b"POST no end")), (3, bytearray(b"67890"))], "packet BIGINT, payload BINARY"
    ).selectExpr("packet", "0L ts_us", "'a' src", "'b' dst", "1L sport", "80L dport", "'tcp' proto", "payload")
    got = {r.packet: r for r in decode.http_messages(df).collect()}
    assert set(got) == {1, 2}
    assert (got[1].body_bytes, got[1].content_length, got[1].complete, got[1].length_agrees) == (5, 10, False, False)
    assert got[2].header_bytes is None and got[2].complete is None
    parts = df.select(*[v.alias(k) for k, v in http_parts(F.col("payload")).items()])
    assert parts.where("header_bytes is not null").count() == 1


def test_long_conversations_keep_their_whole_pattern(spark):
    rows = []
    for conv, tail in enumerate([24, 24, 17]):
        flags = [2, 18] + [16] * 1200 + [tail]
        rows += [(f"h{conv}", 1, "s", 2, "tcp", 10_000 * conv + i, f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "src STRING, sport BIGINT, dst STRING, dport BIGINT, proto STRING, packet BIGINT, flags BIGINT")
    for chunk in (5, 10**6):
        got = {r.pattern: (r.conversations, r.packets) for r in aggregates.flag_patterns(df, chunk=chunk).collect()}
        assert got == {"[2, 18, 16x1200, 24]": (2, 1203), "[2, 18, 16x1200, 17]": (1, 1203)}


def test_alternating_flags_of_a_long_conversation(spark):
    """300,000 changes of flags: the long table has a row per run, whatever way the conversation is cut."""
    df = spark.range(300_000).selectExpr("'a' src", "1L sport", "'b' dst", "2L dport", "'tcp' proto", "id packet", "16 + id % 2 * 8 AS flags")
    for chunk in (1000, 10**6):
        runs = aggregates.flag_pattern_runs(df, chunk=chunk)
        got = runs.agg(F.count("*"), F.count_distinct("pattern"), F.max("packets"), F.max("conversations"), F.sum("n"), F.max("position")).first()
        assert tuple(got) == (300_000, 1, 300_000, 1, 300_000, 300_000)


def test_http_replies_first_in_first_out(spark, monkeypatch):
    """Against a queue: pipelined requests, replies nobody waits for, interim replies, ties of time, unknown ends, two captures."""
    import random
    from collections import deque

    rng = random.Random(4)
    rows, want = [], []
    for conn in range(6):
        client, waiting, t = (None if conn == 5 else f"c{conn}"), deque(), 0
        for i in range(60):
            t += rng.choice([0, 1, 5, 40])
            name = (f"cap{conn % 2}", 1000 * conn + i)
            kind = rng.choice(["ask", "ask", "reply", "reply", "interim", "other"])
            if kind == "ask":
                rows.append((client, 4000, "s", 80, t, *name, b"GET / HTTP/1.1\r\n\r\n"))
                waiting.append(len(want))
                want.append([*name, None, None])
            else:
                text = {"reply": b"HTTP/1.1 200 OK\r\n\r\nx", "interim": b"HTTP/1.1 100 Continue\r\n\r\n", "other": b"more bytes"}[kind]
                rows.append(("s", 80, client, 4000, t, *name, text))
                if kind == "reply" and waiting and client:
                    want[waiting.popleft()][2:] = name
    schema = "src STRING, sport BIGINT, dst STRING, dport BIGINT, ts_us BIGINT, file STRING, packet BIGINT, payload BINARY"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'tcp' proto")
    assert any(w[2] for w in want) and not all(w[2] for w in want)
    for hot in (10**9, 20, 0):
        monkeypatch.setattr(ordered, "HOT_ROWS", hot)
        got = joins.pair_http(df, chunk=30).collect()
        assert sorted((r.file, r.packet, r.reply_file, r.reply_packet) for r in got) == sorted(map(tuple, want), key=lambda w: w[:2])


def test_key_value_of_any_length(spark):
    long = "x" * 1_000_000
    lines = spark.createDataFrame([(1, f'a="{long}" b=2'), (2, 'a="' + r'\"' * 20_000 + '" b=3')], "line BIGINT, raw STRING")
    got = logs.parse_kv(lines, ["a", "b"]).orderBy("line").collect()
    assert got[0].a == long and got[0].b == "2" and got[1].a == '"' * 20_000 and got[1].b == "3" and not got[0].error and not got[1].error


def test_records_of_several_files_stay_apart(spark):
    ends = "orig_h STRING, orig_p BIGINT, resp_h STRING, resp_p BIGINT, proto STRING"
    conn = spark.createDataFrame(
        [(f, n, 1000 * i, u, "a", i, "b", 53, "udp") for i, (f, n, u) in enumerate([("x", 1, "A"), ("x", 2, "B"), ("y", 1, "C"), ("y", 2, "D"), ("y", 3, "D")])],
        f"file STRING, line BIGINT, ts_us BIGINT, uid STRING, {ends}",
    )
    dns = conn.where("uid in ('A', 'D') and line < 3")
    joined = joins.join_dns_conn(dns, conn)
    assert {(r.file, r.line, r.conn_file, r.conn_line, r.verdict) for r in joined.collect()} == {
        ("x", 1, "x", 1, "matched"), ("y", 2, "y", 2, "ambiguous")
    }
    assert [r.uid for r in joins.with_source(conn, joined).collect()] == ["A"]
    near = joins.join_ids_conn(conn.drop("uid"), conn, 10)
    total = joins.join_cardinality(near, conn).first()
    assert (total.source_records, total.matched_source_records, total.matched_conn_records) == (5, 5, 5)
    assert total.conn_records_without_this_source == 0
    assert {(r.file, r.first_line, r.last_line, r.lines) for r in temporal.ranges(conn, []).collect()} == {("x", 1, 2, 2), ("y", 1, 3, 3)}
    page = sets.page_after(conn, ("x", 1), 2)
    assert [(r.file, r.line) for r in page.collect()] == [("x", 2), ("y", 1)]
    first = temporal.locators(conn, ["resp_h"]).first()
    assert (first.first_file, first.first_line, first.last_file, first.last_line) == ("x", 1, "y", 3)


def test_no_local_scratch_folder_on_a_cluster():
    from types import SimpleNamespace

    from tracelode.session import shared_folder

    def session(master, named=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
        assert shared_folder(session(master, "hdfs:///shared")) == "hdfs:///shared"


def test_fingerprint_sees_a_moved_null(spark):
    a = spark.createDataFrame([(1, None, "x")], "k INT, p STRING, q STRING")
    b = spark.createDataFrame([(1, "x", None)], "k INT, p STRING, q STRING")
    assert integrity.fingerprint(a).first().content_sum != integrity.fingerprint(b).first().content_sum
    assert joins.compare_copies(a, b, ["k"], ["p", "q"]).first().status == "differs"
    assert joins.compare_copies(a, a, ["k"], ["p", "q"]).count() == 0


def test_repeated_and_odd_headers(spark):
    raw = b"POST /a HTTP/1.0\r\nCookie: a=1\r\nCookie: b=2\r\ncontent-length:2\r\nnot a header\r\n\r\nok"
    df = spark.createDataFrame([(1, 1, "s", "d", 1, 2, "tcp", raw)], "packet INT, ts_us INT, src STRING, dst STRING, sport INT, dport INT, proto STRING, payload BINARY")
    r = decode.http_messages(df).first()
    assert r.headers == {"Cookie": "b=2", "content-length": "2"} and [h.value for h in r.header_list] == ["a=1", "b=2", "2"]
    assert r.content_length == 2 and r.length_agrees


def test_zone_table_prefers_the_longest_prefix(spark):
    ips = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("8.8.8.8",), (None,)], "ip STRING")
    nets = spark.createDataFrame([(10 << 24, 8, "ten"), ((10 << 24) + (1 << 16) + (2 << 8), 24, "lab")], "net BIGINT, prefix INT, zone STRING")
    got = {r.ip: r.zone for r in filters.zone_from_table(ips, "ip", nets).collect()}
    assert got == {"10.1.2.3": "lab", "10.1.9.9": "ten", "8.8.8.8": None, None: None}
    zones = ips.select(net.zone(F.col("ip")).alias("z"), "ip").where("ip is not null").collect()
    assert {r.ip: r.z for r in zones}["8.8.8.8"] == "external"


def test_observed_protocols(spark):
    rows = [
        (b"GET / HTTP/1.1\r\n", "tcp", 80), (b"\x16\x03\x01\0\0", "tcp", 443), (b"\x16\x09\x01", "tcp", 443), (b"", "tcp", 443),
        (b"\0" * 12, "udp", 53), (b"\0" * 11, "udp", 53),
    ]
    df = spark.createDataFrame([(i, bytearray(p), proto, port) for i, (p, proto, port) in enumerate(rows)], "i INT, payload BINARY, proto STRING, dport BIGINT")
    got = df.select("i", net.observe_protocol(F.col("payload"), F.col("proto"), F.lit(1), F.col("dport")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == ["http", "tls", "not_established", "not_established", "dns", "not_established"]


# --- integrity and governance --------------------------------------------------------------------


def zip_case(tmp_path):
    import hashlib
    import zipfile

    entries = []
    for name, content in (("one.txt", b"first"), ("two.txt", b"second" * 1000)):
        path = tmp_path / f"{name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(name, content)
        entries.append(
            {
                "id": name[:3], "archive": path.name, "member": name, "path": f"/in/{name}", "bytes": len(content),
                "sha256": hashlib.sha256(content).hexdigest(), "analysis": None, "records": None,
                "archive_sha256": hashlib.sha256(path.read_bytes()).hexdigest(),
            }
        )
    return entries


def manifest_of(spark, tmp_path, entries):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"schema": "m", "case_id": "c", "source_relationship": "one parent", "sources": entries}, indent=1))
    return archive.read_manifest(spark, str(path))


def test_gate(spark, tmp_path):
    import zipfile

    entries = zip_case(tmp_path)
    inventory = archive.archive_inventory(spark, str(tmp_path / "*.zip"))
    report = integrity.inventory_report(inventory, manifest_of(spark, tmp_path, entries))
    assert integrity.require_verified(report) == 2

    entries[1]["sha256"] = "0" * 64
    changed = integrity.inventory_report(inventory, manifest_of(spark, tmp_path, entries))
    with pytest.raises(integrity.IntegrityError, match="differs: 1"):
        integrity.require_verified(changed)

    entries[1]["member"] = "three.txt"
    missing = integrity.inventory_report(inventory, manifest_of(spark, tmp_path, entries))
    with pytest.raises(integrity.IntegrityError, match="missing: 1"):
        integrity.require_verified(missing)

    bad = tmp_path / "bad"
    bad.mkdir()
    with pytest.warns(UserWarning), zipfile.ZipFile(bad / "dup.zip", "w") as z:
        z.writestr("x", b"1")
        z.writestr("x", b"2")
        z.writestr("../up", b"3")
    (bad / "not.zip").write_bytes(b"plain")
    problems = {(r.archive, r.member): r.problem for r in archive.archive_inventory(spark, str(bad)).collect()}
    assert problems[("dup.zip", "x")] == "duplicate member"
    assert problems[("dup.zip", "../up")] == "member name has a path"
    assert problems[("not.zip", None)].startswith("not a readable archive")


def test_claims_need_locators(spark):
    claims = spark.createDataFrame([("a", "confirmed", "conn", "x"), ("b", "confirmed", "conn", "x")], "claim STRING, status STRING, source STRING, fields STRING")
    where = spark.createDataFrame([("a", "conn", 1, 5)], "claim STRING, source STRING, first_line BIGINT, last_line BIGINT")
    assert {r.claim: r.status for r in governance.claim_ledger(claims, where, strict=False).collect()} == {"a": "confirmed", "b": "rejected"}
    with pytest.raises(Exception, match="claim without locator or status: b"):
        governance.claim_ledger(claims, where).collect()


def test_handshake_states(spark):
    def conv(host, *steps):
        return [(host, 1, "s", 2, "tcp", i, out, f) for i, (out, f) in enumerate(steps)]

    rows = conv("try", (True, 2)) + conv("half", (True, 2), (False, 18)) + conv("up", (True, 2), (False, 18), (True, 16))
    rows += conv("done", (True, 2), (False, 18), (True, 16), (False, 17), (True, 17)) + conv("mid", (True, 24))
    df = spark.createDataFrame(rows, f"{CONV}, packet BIGINT, from_orig BOOLEAN, flags BIGINT")
    got = {r.orig_h: r.state for r in filters.handshake_state(df).collect()}
    assert got == {"try": "attempt", "half": "half_open", "up": "established", "done": "closed", "mid": "partial"}


def test_sequence_takes_the_latest_earlier_end(spark):
    def step(*rows):
        return spark.createDataFrame([("h", *r) for r in rows], "host STRING, first_us BIGINT, last_us BIGINT")

    first, second = step((0, 10), (5, 40), (20, 30)), step((31, 35), (41, 45), (500, 501))
    got = {(r.a, r.b) for r in detections.sequence([("a", first), ("b", second)], 50).collect()}
    assert got == {(20, 31), (5, 41)}


def test_host_as_responder_and_single_records(spark):
    df = spark.createDataFrame([(1, 5, "a", 1, "host", 2, "tcp", 3)], "line BIGINT, ts_us BIGINT, orig_h STRING, orig_p BIGINT, resp_h STRING, resp_p BIGINT, proto STRING, orig_bytes BIGINT")
    counts = aggregates.log_counts({"conn": df}, "host").first()
    assert (counts.host_origin, counts.host_destination) == (0, 1)
    assert filters.with_direction(df, "host").first().direction == "in"
    assert temporal.beacons(df, ["orig_h"], 1, 1.0).count() == 0
