"""Questions about single records: scans, filters, labels, functions, order and sets."""

from pyspark.sql import functions as F

from ..functions import binary, clock, net, text
from ..functions import sql as sqlfn
from ..operators import decode, filters, integrity, sets
from ..sources import logs
from . import roles
from .registry import question
from .roles import TUPLE

C = roles.CONN
CD, CW, CP = C + roles.DNS, C + roles.FIREWALL, C + roles.PACKETS
CQ = C + roles.on_wire(roles.PACKETS)
T5 = ", ".join(TUPLE)


def packets(spark, sf):
    return decode.decode(roles.frames(spark, sf))


def host_packets(spark, sf):
    """Packets of frames that keep all hosts apart."""
    return roles.named(decode.decode(roles.frames(spark, sf, own=True)))


def firewall(spark, sf):
    return logs.parse_firewall(roles.firewall_text(spark, sf))


# --- scans ---------------------------------------------------------------------------------------


@question("a1_capture_frames", CP + "SELECT packet, ts_us, ip_bytes + 16 AS caplen, CASE WHEN event_id % 53 = 0 THEN ip_bytes + 26 ELSE ip_bytes + 16 END AS wirelen FROM pkt")
def capture_frames(spark, sf):
    return roles.frames(spark, sf).select(
        "packet", "ts_us", F.col("caplen").cast("bigint").alias("caplen"), F.col("wirelen").cast("bigint").alias("wirelen")
    )


@question(
    "a2_json_records",
    C + """SELECT event_id AS line, uid, orig_h, orig_bytes, k AS orig_pkts, ts_us FROM conn""",
)
def json_records(spark, sf):
    """Connections written as JSON lines and read back by the log parser."""
    c = roles.conn(spark, sf)
    lines = c.select(
        F.col("event_id").alias("line"),
        F.to_json(
            F.struct(
                (F.col("ts_us") / 1e6).alias("ts"), "uid", F.col("orig_h").alias("id.orig_h"),
                F.col("orig_p").alias("id.orig_p"), F.col("resp_h").alias("id.resp_h"),
                F.col("resp_p").alias("id.resp_p"), "proto", "orig_bytes", F.col("k").alias("orig_pkts"), "conn_state",
            )
        ).alias("raw"),
    )
    parsed = logs.parse_json(lines, logs.SCHEMAS["conn"])
    return logs.canonical(logs.fail_on_error(parsed), "conn").select("line", "uid", "orig_h", "orig_bytes", "orig_pkts", "ts_us")


@question(
    "a3_key_value_records",
    CW + f"SELECT line, date, time, {T5}, sentbyte, rcvdbyte, parentuid, app, dstintf, zeekstate, simulation, evidence_origin FROM fw",
)
def key_value_records(spark, sf):
    return firewall(spark, sf).select(
        "line", "date", "time", *TUPLE, "sentbyte", "rcvdbyte", "parentuid", "app", "dstintf", "zeekstate",
        "simulation", "evidence_origin",
    )


@question("a5_read_lines", C + """SELECT line, uid, CASE WHEN (SELECT max(line) FROM conn) >= 300 THEN CAST(300 AS BIGINT) END AS next_line,
  (SELECT max(line) FROM conn) < 300 AS reached_eof FROM conn WHERE line >= 200 AND line < 300""")
def read_lines(spark, sf):
    return logs.read_lines(roles.conn(spark, sf), 200, 100).select("line", "uid", "next_line", "reached_eof")


@question(
    "a6_query_packets",
    CQ + """SELECT 'derived' AS file, packet, ts_us, src, dst, CAST(sport AS BIGINT) AS sport, CAST(dport AS BIGINT) AS dport, proto, CAST(payload_bytes AS BIGINT) AS payload_bytes,
      lower(hex(encode(text[1:20]))) AS payload_hex, payload_bytes > 20 AS payload_truncated,
      (SELECT count(*) FROM pkt WHERE dport = 443) AS matching_packets, (SELECT count(*) FROM pkt WHERE dport = 443) > 25 AS samples_truncated
    FROM pkt WHERE dport = 443 ORDER BY packet LIMIT 25""",
)
def query_packets(spark, sf):
    return decode.query_packets(packets(spark, sf), "dport = 443", 25, 20)


@question("a7_query_records", C + "SELECT line, uid, orig_h, resp_h FROM conn WHERE conn_state = 'SF' AND resp_p = 22 AND orig_bytes > 10000")
def query_records(spark, sf):
    return logs.query_records(
        roles.conn(spark, sf), "conn_state = 'SF' and resp_p = 22 and orig_bytes > 10000", ["line", "uid", "orig_h", "resp_h"]
    )


@question(
    "a14_packet_index",
    CQ + """SELECT 'derived' AS file, packet, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS utc,
      src, dst, CAST(sport AS BIGINT) AS sport, CAST(dport AS BIGINT) AS dport, proto, CAST(flags AS BIGINT) AS flags,
      CAST(payload_bytes AS BIGINT) AS payload_bytes, CAST(ip_bytes AS BIGINT) AS ip_bytes, coalesce(lower(hex(encode(text[1:120]))), printf('%04x', event_id % 65536)
        || CASE i WHEN 0 THEN '01000001000000000000' ELSE '81800001000100000000' END
        || printf('%02x', length('h' || k)) || lower(hex(encode('h' || k))) || '076578616d706c650000010001'
        || CASE i WHEN 0 THEN '' ELSE 'c00c00010001' || printf('%08x', 60 * (1 + k % 3)) || '0004cb0071' || printf('%02x', 60 + k % 40) END) AS payload_prefix_hex
    FROM pkt""",
)
def packet_index(spark, sf):
    return decode.packet_index(packets(spark, sf))


@question("a17_fingerprint", "SELECT 'lineitem' AS output, count(*) AS rows, TRUE AS same_after_reorder, FALSE AS same_after_duplicate FROM lineitem")
def fingerprint(spark, sf):
    """A table's fingerprint ignores order and notices one repeated row."""
    t = roles.table(spark, sf, "lineitem")
    prints = [
        integrity.fingerprint(df, "lineitem")
        for df in (t, t.orderBy("l_partkey"), t.unionByName(t.orderBy("l_orderkey", "l_linenumber").limit(1)))
    ]
    base, again, doubled = (p.select("content_sum").scalar() for p in prints)
    return prints[0].select(
        "output", "rows", (base == again).alias("same_after_reorder"), (base == doubled).alias("same_after_duplicate")
    )


@question(
    "a18_event_store",
    CD + """, e AS (SELECT 'conn' AS source, ts_us, orig_bytes AS b FROM conn UNION ALL SELECT 'dns', ts_us, NULL FROM dns)
    SELECT source, strftime(make_timestamp(ts_us), '%Y-%m-%d') AS event_date, count(*) AS events, CAST(sum(b) AS BIGINT) AS bytes_sent FROM e GROUP BY ALL""",
)
def event_store(spark, sf):
    """Write the event store, then ask it by partition columns."""
    from ..sources.sinks import write_events
    from ..streaming.runtime import scratch

    path = scratch(spark, "events")
    write_events(sets.union_events({"conn": roles.conn(spark, sf), "dns": roles.dns(spark, sf)}), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("source", F.col("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("bytes_sent").alias("bytes_sent")
    )


@question("a19_selected_records", CD + "SELECT 'conn' AS source, line FROM conn WHERE orig_h = '10.20.0.9' OR resp_h = '10.20.0.9' UNION ALL SELECT 'dns', line FROM dns WHERE orig_h = '10.20.0.9' OR resp_h = '10.20.0.9'")
def selected_records(spark, sf):
    chosen = logs.selected_records({"conn": roles.conn(spark, sf), "dns": roles.dns(spark, sf)}, "10.20.0.9")
    parts = [df.select(F.lit(name).alias("source"), "line") for name, df in chosen.items()]
    return parts[0].unionByName(parts[1])


# --- filters and labels --------------------------------------------------------------------------


@question("b1_for_host", C + "SELECT line, orig_h, resp_h FROM conn WHERE orig_h = '203.0.113.77' OR resp_h = '203.0.113.77'")
def for_host(spark, sf):
    return filters.for_host(roles.conn(spark, sf), "203.0.113.77").select("line", "orig_h", "resp_h")


@question("b2_direction", CP + "SELECT packet, CASE WHEN src = '10.70.1.5' THEN 'out' WHEN dst = '10.70.1.5' THEN 'in' END AS direction FROM pkt")
def direction(spark, sf):
    return filters.with_direction(packets(spark, sf), "10.70.1.5", "src", "dst").select("packet", "direction")


@question("b3_five_tuple", CW + f"SELECT line, {T5} FROM fw")
def five_tuple(spark, sf):
    return firewall(spark, sf).select("line", *TUPLE)


@question("b4_orient", CQ + f"SELECT packet, {T5}, i = 0 AS from_orig FROM pkt")
def orient(spark, sf):
    return filters.orient(packets(spark, sf)).select("packet", *TUPLE, "from_orig")


@question("b5_decode_ip", CQ + """SELECT packet, src, dst, CAST(CASE proto WHEN 'tcp' THEN 6 ELSE 17 END AS BIGINT) AS ip_proto, CAST(ip_bytes AS BIGINT) AS ip_bytes,
  CAST(ip_bytes - 20 AS BIGINT) AS segment_bytes FROM pkt""")
def decode_ip(spark, sf):
    return decode.decode_ip(roles.frames(spark, sf)).select(
        "packet", "src", "dst", "ip_proto", "ip_bytes", F.length("segment").cast("bigint").alias("segment_bytes")
    )


@question("b6_decode_tcp", CP + """SELECT packet, CAST(sport AS BIGINT) AS sport, CAST(dport AS BIGINT) AS dport, CAST(flags AS BIGINT) AS flags, event_id AS seq,
  CAST(i AS BIGINT) AS ack, text FROM pkt WHERE proto = 'tcp'""")
def decode_tcp(spark, sf):
    return decode.decode_tcp(decode.decode_ip(roles.frames(spark, sf))).select(
        "packet", "sport", "dport", "flags", "seq", "ack", binary.latin1(F.col("payload")).alias("text")
    )


@question("b7_decode_udp", CP + """SELECT packet, CAST(sport AS BIGINT) AS sport, CAST(dport AS BIGINT) AS dport, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  CAST(NULL AS VARCHAR) AS error FROM pkt WHERE proto = 'udp'""")
def decode_udp(spark, sf):
    return decode.decode_udp(decode.decode_ip(roles.frames(spark, sf))).select("packet", "sport", "dport", "payload_bytes", "error")


@question("b8_packet_class", CP + "SELECT proto AS packet_class, event_id % 53 = 0 AS truncated, count(*) AS n FROM pkt GROUP BY ALL")
def packet_class(spark, sf):
    return decode.packet_class(roles.frames(spark, sf)).groupBy("packet_class", "truncated").agg(F.count(F.lit(1)).alias("n"))


@question("b9_initial_syn", CP + "SELECT packet FROM pkt WHERE proto = 'tcp' AND i = 0")
def initial_syn(spark, sf):
    return packets(spark, sf).where(net.is_syn(F.col("flags"))).select("packet")


@question("b10_dns_queries", CQ + "SELECT packet, src FROM pkt WHERE proto = 'udp' AND i = 0")
def dns_queries(spark, sf):
    return packets(spark, sf).where(net.is_dns_query(F.col("proto"), F.col("dport"), F.col("payload"))).select("packet", "src")


@question("b11_handshake_state", CQ + f"SELECT DISTINCT {T5}, TRUE AS syn, TRUE AS syn_ack, FALSE AS ack, FALSE AS orig_fin, FALSE AS resp_fin, 'half_open' AS state FROM pkt WHERE proto = 'tcp' AND i = 0")
def handshake_state(spark, sf):
    return filters.handshake_state(filters.orient(packets(spark, sf)))


@question("b12_phase", CQ + f"SELECT DISTINCT {T5}, CASE WHEN proto = 'udp' THEN 'dns' WHEN resp_p = 443 THEN 'http_upload' ELSE 'other_tcp' END AS phase FROM pkt WHERE i = 0")
def phase(spark, sf):
    from ..operators.aggregates import conversations

    return filters.phase(conversations(packets(spark, sf))).select(*TUPLE, "phase")


@question("b14_observed_protocol", CP + """SELECT CASE WHEN proto = 'udp' THEN 'dns' WHEN text LIKE 'POST %' THEN 'http' ELSE 'not_established' END AS protocol, count(*) AS packets FROM pkt GROUP BY ALL""")
def observed_protocol(spark, sf):
    seen = net.observe_protocol(F.col("payload"), F.col("proto"), F.col("sport"), F.col("dport"))
    return packets(spark, sf).groupBy(seen.alias("protocol")).agg(F.count(F.lit(1)).alias("packets"))


@question("b15_zone", C + "SELECT line, CASE WHEN k < 60 THEN 'internal' ELSE 'external' END AS zone FROM conn")
def zone(spark, sf):
    return filters.with_zone(roles.conn(spark, sf), "resp_h").select("line", "zone")


@question(
    "b15_zone_table",
    C + """SELECT line, CASE WHEN resp_h LIKE '10.70.1.%' THEN CASE WHEN k < 16 THEN 'lab-low' ELSE 'lab' END END AS zone FROM conn""",
)
def zone_table(spark, sf):
    """Longest-prefix match against a table of networks."""
    nets = spark.range(1).select(
        F.inline(
            F.array(
                F.struct(F.lit(10 * 2**24 + 70 * 2**16 + 256).alias("net"), F.lit(24).alias("prefix"), F.lit("lab").alias("zone")),
                F.struct(F.lit(10 * 2**24 + 70 * 2**16 + 256).alias("net"), F.lit(28).alias("prefix"), F.lit("lab-low").alias("zone")),
            )
        )
    )
    return filters.zone_from_table(roles.conn(spark, sf), "resp_h", nets).select("line", "zone")


@question("b16_time_bounds", C + "SELECT min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS records, CAST(0 AS BIGINT) AS unknown_time FROM conn")
def time_bounds(spark, sf):
    return filters.time_bounds(roles.conn(spark, sf))


@question("b16_in_range", C + "SELECT line FROM conn WHERE ts_us BETWEEN 1704412800000000 AND 1704844800000000")
def in_range(spark, sf):
    return filters.in_range(roles.conn(spark, sf), 1_704_412_800_000_000, 1_704_844_800_000_000).select("line")


@question(
    "b17_normalize",
    C + """SELECT 'conn' AS source, ts_us AS event_us, orig_h AS source_ip, orig_p AS source_port, resp_h AS destination_ip,
      resp_p AS destination_port, proto AS protocol, 'conn' AS event_type, conn_state AS action, orig_bytes AS bytes_sent,
      resp_bytes AS bytes_received, 'conn:' || line AS source_record_id FROM conn""",
)
def normalize(spark, sf):
    return filters.normalize(roles.conn(spark, sf), "conn")


@question(
    "b18_align_clock",
    C + """SELECT line, ts_us + CASE event_type WHEN 'view' THEN -2500000 WHEN 'error' THEN 1000 ELSE 0 END AS ts_us, ts_us AS original_us,
      event_type IN ('view', 'error') AS offset_known FROM conn""",
)
def align_clock(spark, sf):
    """Collectors stand for event types; only two of them have a known offset."""
    c = roles.conn(spark, sf).withColumnRenamed("event_type", "collector")
    offsets = (
        c.select("collector").distinct().where("collector in ('view', 'error')")
        .withColumn("offset_us", F.when(F.col("collector") == "view", -2_500_000).otherwise(1000).cast("bigint"))
    )
    return filters.align_clock(c, offsets).select("line", "ts_us", "original_us", "offset_known")


@question("b19_off_hours", C + "SELECT line, extract(hour FROM make_timestamp(ts_us) + INTERVAL 7 HOUR) < 8 OR extract(hour FROM make_timestamp(ts_us) + INTERVAL 7 HOUR) >= 18 AS off_hours FROM conn")
def off_hours(spark, sf):
    return filters.off_hours(roles.conn(spark, sf), "Asia/Bangkok", 8, 18).select("line", "off_hours")


# --- order, paging and sets ----------------------------------------------------------------------


@question("f1_by_line", C + "SELECT line, uid FROM conn")
def by_line(spark, sf):
    return sets.by_line(roles.conn(spark, sf)).select("line", "uid")


@question("f2_numeric_ip_order", C + """SELECT DISTINCT resp_h, CAST(split_part(resp_h, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(resp_h, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(resp_h, '.', 3) AS BIGINT) * 256 + CAST(split_part(resp_h, '.', 4) AS BIGINT) AS ip_num FROM conn""")
def numeric_ip_order(spark, sf):
    hosts = roles.conn(spark, sf).select("resp_h").distinct()
    return sets.by_ip(hosts, "resp_h").select("resp_h", net.ip_num(F.col("resp_h")).alias("ip_num"))


@question("f3_page_after", C + "SELECT line, uid FROM conn WHERE line > 500 ORDER BY line LIMIT 250")
def page_after(spark, sf):
    return sets.page_after(roles.conn(spark, sf), 500, 250).select("line", "uid")


@question("f4_top_k", C + "SELECT line, orig_bytes FROM conn ORDER BY orig_bytes DESC, line LIMIT 20")
def top_k(spark, sf):
    return sets.top_k(roles.conn(spark, sf), "orig_bytes", 20, "line").select("line", "orig_bytes")


@question("f5_time_order", C + "SELECT ts_us, line FROM conn")
def time_order(spark, sf):
    return sets.by_time(roles.conn(spark, sf)).select("ts_us", "line")


@question(
    "g1_union_events",
    CD + roles.IDS + """SELECT source, count(*) AS events, min(event_us) AS first_us, max(event_us) AS last_us, CAST(sum(b) AS BIGINT) AS bytes_sent FROM (
      SELECT 'conn' AS source, ts_us AS event_us, orig_bytes AS b FROM conn UNION ALL SELECT 'dns', ts_us, NULL FROM dns
      UNION ALL SELECT 'ids', ts_us, NULL FROM ids) GROUP BY source""",
)
def union_events(spark, sf):
    merged = sets.union_events({"conn": roles.conn(spark, sf), "dns": roles.dns(spark, sf), "ids": roles.ids(spark, sf)})
    return merged.groupBy("source").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_us").alias("first_us"), F.max("event_us").alias("last_us"),
        F.sum("bytes_sent").alias("bytes_sent"),
    )


@question("g2_distinct_endpoints", C + "SELECT orig_h AS ip FROM conn UNION SELECT resp_h FROM conn")
def distinct_endpoints(spark, sf):
    return sets.distinct_endpoints(roles.conn(spark, sf))


@question("g3_difference", CD + "SELECT line, uid FROM conn WHERE uid NOT IN (SELECT uid FROM dns)")
def difference(spark, sf):
    return sets.difference(roles.conn(spark, sf), roles.dns(spark, sf), ["uid"]).select("line", "uid")


@question("g4_in_every_source", CD + f"SELECT {T5} FROM conn INTERSECT SELECT {T5} FROM dns")
def in_every_source(spark, sf):
    return sets.in_every([roles.conn(spark, sf), roles.dns(spark, sf)], TUPLE)


@question(
    "g5_run_differences",
    C + roles.FLOW + """, a AS (SELECT line, orig_bytes AS bytes, orig_pkts AS packets FROM conn), b AS (SELECT line, bytes, packets FROM flow)
    SELECT *, CAST(1 AS BIGINT) AS surplus_in_a FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL SELECT *, CAST(-1 AS BIGINT) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def run_differences(spark, sf):
    a = roles.conn(spark, sf).select("line", F.col("orig_bytes").alias("bytes"), F.col("orig_pkts").alias("packets"))
    return sets.run_differences(a, roles.flow(spark, sf).select("line", "bytes", "packets"))


# --- functions -----------------------------------------------------------------------------------


@question("h1_utc_iso", C + """SELECT line, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS utc FROM conn""")
def utc_iso(spark, sf):
    return roles.conn(spark, sf).select("line", clock.iso_utc(F.col("ts_us")).alias("utc"))


@question("h2_big_endian", CP + "SELECT packet, CAST(ip_bytes AS BIGINT) AS u16_value, CAST(CASE proto WHEN 'tcp' THEN event_id END AS BIGINT) AS u32_value FROM pkt")
def big_endian(spark, sf):
    frame = F.col("frame")
    return roles.frames(spark, sf).select(
        "packet", binary.u16(frame, 16).alias("u16_value"),
        F.when(binary.u8(frame, 23) == 6, binary.u32(frame, 38)).alias("u32_value"),
    )


@question("h3_ipv4_round_trip", C + "SELECT DISTINCT resp_h AS ip, resp_h AS again FROM conn")
def ipv4_round_trip(spark, sf):
    hosts = roles.conn(spark, sf).select(F.col("resp_h").alias("ip")).distinct()
    return hosts.select("ip", net.ip_text(net.ip_num(F.col("ip"))).alias("again"))


@question("h4_hex_prefix", "SELECT page_id, lower(hex(encode(html))[1:64]) AS prefix FROM pages")
def hex_prefix(spark, sf):
    return roles.table(spark, sf, "pages").select("page_id", binary.hex_prefix(F.encode("html", "UTF-8"), 32).alias("prefix"))


@question("h5_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256(spark, sf):
    return roles.table(spark, sf, "documents").select("doc_id", binary.sha256_hex(F.encode("text", "UTF-8")).alias("sha256"))


@question("h6_printed_time", CW + "SELECT line, TRUE AS printed_time_matches FROM fw")
def printed_time(spark, sf):
    fw = firewall(spark, sf).select("line", "date", "time")
    c = roles.conn(spark, sf).select("line", "ts_us")
    return fw.join(c, "line").select(
        "line", clock.printed_equals(F.col("date"), F.col("time"), F.col("ts_us")).alias("printed_time_matches")
    )


@question("h7_http_parts", CP + """SELECT packet, 'POST /upload/' || event_id || ' HTTP/1.0' AS request_line, 'h' || k || '.example.test' AS host, k + 1 AS content_length,
  CAST(length(text) - (k + 1) AS BIGINT) AS header_bytes, k + 1 AS body_bytes, TRUE AS length_agrees FROM pkt WHERE resp_p = 443 AND i = 0""")
def http_parts(spark, sf):
    return decode.http_messages(packets(spark, sf)).select(
        "packet", "request_line", F.col("headers")["Host"].alias("host"), "content_length", "header_bytes", "body_bytes", "length_agrees"
    )


@question("h8_key_value_tokens", CW + "SELECT line, devname, app, evidence_origin FROM fw")
def key_value_tokens(spark, sf):
    lines = roles.firewall_text(spark, sf).withColumnRenamed("value", "raw")
    return logs.parse_kv(lines, ["devname", "app", "evidence_origin"]).select("line", "devname", "app", "evidence_origin")


@question("h9_protocol_name", C + "SELECT proto, count(*) AS n FROM conn GROUP BY proto")
def protocol_name(spark, sf):
    code = F.when(F.col("proto") == "udp", 17).otherwise(6)
    return roles.conn(spark, sf).groupBy(net.proto_name(code).alias("proto")).agg(F.count(F.lit(1)).alias("n"))


@question("h10_bit_tests", C + "SELECT line, (line & 18) = 2 AS is_syn, (line & 1) <> 0 AS fin FROM conn")
def bit_tests(spark, sf):
    return roles.conn(spark, sf).select(
        "line", net.is_syn(F.col("line")).alias("is_syn"), net.has_flag(F.col("line"), net.FIN).alias("fin")
    )


@question("h11_answers", CP + """SELECT packet, 'h' || k || '.example' AS name, CAST(60 * (1 + k % 3) AS BIGINT) AS ttl, '203.0.113.' || (60 + k % 40) AS address
  FROM pkt WHERE proto = 'udp' AND i = 1""")
def answers(spark, sf):
    return decode.dns_answers(decode.decode_dns(packets(spark, sf))).select("packet", "name", "ttl", "address")


@question("h12_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf):
    return roles.table(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@question("h13_mean_and_deviation", C + "SELECT resp_p, round(avg(orig_bytes), 6) AS mean, round(stddev_pop(orig_bytes), 6) AS sd FROM conn GROUP BY resp_p")
def mean_and_deviation(spark, sf):
    return roles.conn(spark, sf).groupBy("resp_p").agg(
        F.round(F.avg("orig_bytes"), 6).alias("mean"), F.round(F.stddev_pop("orig_bytes"), 6).alias("sd")
    )


@question("h14_payload_text", CP + "SELECT packet, text FROM pkt WHERE proto = 'tcp'")
def payload_text(spark, sf):
    return decode.payload_text(packets(spark, sf).where("proto = 'tcp'")).select("packet", "text")


@question("j1_dns_messages", CP + """SELECT packet, event_id % 65536 AS tid, i = 1 AS response, CAST(0 AS BIGINT) AS rcode, 'h' || k || '.example' AS name,
  CAST(1 AS BIGINT) AS qtype, CAST(i AS BIGINT) AS answers, CAST(NULL AS VARCHAR) AS error FROM pkt WHERE proto = 'udp'""")
def dns_messages(spark, sf):
    m = decode.decode_dns(packets(spark, sf))
    return m.select(
        "packet", "tid", "response", "rcode", F.col("questions")[0]["name"].alias("name"),
        F.col("questions")[0]["qtype"].alias("qtype"), F.size("answers").cast("bigint").alias("answers"), "error",
    )


@question(
    "j5_ask_in_sql",
    C + """SELECT CASE WHEN k < 60 THEN 'internal' ELSE 'external' END AS zone, count(*) AS n, CAST(sum(orig_bytes) AS BIGINT) AS bytes,
      max(CAST(split_part(resp_h, '.', 4) AS BIGINT)) AS top FROM conn GROUP BY ALL""",
)
def ask_in_sql(spark, sf):
    sqlfn.register_functions(spark)
    sqlfn.register_views({"evidence_conn": roles.conn(spark, sf)})
    return spark.sql(
        "SELECT zone(resp_h) AS zone, count(*) AS n, sum(orig_bytes) AS bytes, max(ip_num(resp_h) & 255) AS top "
        "FROM evidence_conn GROUP BY zone(resp_h)"
    )
