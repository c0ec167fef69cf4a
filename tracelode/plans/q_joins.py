"""Questions that put sources next to each other."""

from pyspark.sql import functions as F

from ..operators import decode, filters, joins as J
from . import roles
from .registry import question
from .roles import TUPLE

C = roles.CONN
CF = C + roles.FLOW
CD = C + roles.DNS
CI = C + roles.IDS
CW = C + roles.FIREWALL
CP = C + roles.PACKETS
CQ = C + roles.on_wire(roles.PACKETS)

SAME = " AND ".join(f"l.{c} = r.{c}" for c in TUPLE)

DNS_JOIN = f""", j AS (SELECT l.line, l.uid, r.line AS conn_line, l.ts_us - r.ts_us AS delta_us,
   CASE WHEN r.line IS NULL THEN 'no_conn' WHEN NOT ({SAME}) THEN 'tuple_differs'
     WHEN l.ts_us <> r.ts_us THEN 'time_differs' ELSE 'matched' END AS verdict
   FROM dns l LEFT JOIN conn r ON l.uid = r.uid)
"""
FLOW_JOIN = f""", j AS (
  SELECT l.line, arg_min(r.line, abs(l.ts_us - r.ts_us) * 1000000 + r.line) AS conn_line,
    arg_min(l.ts_us - r.ts_us, abs(l.ts_us - r.ts_us) * 1000000 + r.line) AS delta_us, count(r.line) > 1 AS ambiguous,
    CASE WHEN count(r.line) = 0 THEN 'unmatched' ELSE 'matched' END AS verdict
  FROM flow l LEFT JOIN conn r ON {SAME} AND abs(l.ts_us - r.ts_us) <= 10000
    AND l.bytes = r.orig_bytes AND l.packets = r.orig_pkts GROUP BY l.line)
"""
IDS_JOIN = f""", j AS (
  SELECT l.line, arg_min(r.line, abs(l.ts_us - r.ts_us) * 1000000 + r.line) AS conn_line,
    arg_min(l.ts_us - r.ts_us, abs(l.ts_us - r.ts_us) * 1000000 + r.line) AS delta_us, count(r.line) > 1 AS ambiguous,
    CASE WHEN count(r.line) = 0 THEN 'unmatched' ELSE 'matched' END AS verdict
  FROM ids l LEFT JOIN conn r ON {SAME} AND abs(l.ts_us - r.ts_us) <= 10000 GROUP BY l.line)
"""
FW_JOIN = f""", j AS (SELECT l.line, r.line AS conn_line,
   CASE WHEN r.line IS NULL THEN 'no_conn' WHEN NOT ({SAME}) THEN 'tuple_differs'
     WHEN l.sentbyte <> r.orig_bytes OR l.rcvdbyte <> r.resp_bytes THEN 'bytes_differ' ELSE 'matched' END AS verdict,
   l.date || 'T' || l.time = strftime(make_timestamp(r.ts_us), '%Y-%m-%dT%H:%M:%S') AS printed_time_matches
   FROM fw l LEFT JOIN conn r ON l.parentuid = r.uid)
"""
CARD = """SELECT count(DISTINCT line) AS source_records, count(DISTINCT line) FILTER (WHERE verdict = 'matched') AS matched_source_records,
  count(DISTINCT line) - count(DISTINCT line) FILTER (WHERE verdict = 'matched') AS unmatched_source_records,
  count(DISTINCT conn_line) FILTER (WHERE verdict = 'matched') AS matched_conn_records,
  (SELECT count(*) FROM conn) - count(DISTINCT conn_line) FILTER (WHERE verdict = 'matched') AS conn_records_without_this_source,
  min(delta_us) FILTER (WHERE verdict = 'matched') AS min_delta_us, max(delta_us) FILTER (WHERE verdict = 'matched') AS max_delta_us FROM j"""


def _fw(spark, sf):
    from ..sources.logs import parse_firewall

    return parse_firewall(roles.firewall_text(spark, sf))


def _dns_join(spark, sf):
    return J.join_dns_conn(roles.dns(spark, sf), roles.conn(spark, sf))


def _flow_join(spark, sf):
    return J.join_flow_conn(roles.flow(spark, sf), roles.conn(spark, sf))


def _ids_join(spark, sf):
    return J.join_ids_conn(roles.ids(spark, sf), roles.conn(spark, sf))


def _fw_join(spark, sf):
    return J.join_fw_conn(_fw(spark, sf), roles.conn(spark, sf))


question("c1_dns_conn", CD + DNS_JOIN + "SELECT * FROM j")(_dns_join)
question("c2_flow_conn", CF + FLOW_JOIN + "SELECT * FROM j")(_flow_join)
question("c3_firewall_conn", CW + FW_JOIN + "SELECT * FROM j")(_fw_join)
question("c4_alert_conn", CI + IDS_JOIN + "SELECT * FROM j")(_ids_join)


@question(
    "c5_alert_packet",
    CQ + roles.IDS + """SELECT l.line, l.pcap_count, CASE WHEN r.packet IS NOT NULL THEN 'derived' END AS packet_file, CASE WHEN r.packet IS NULL THEN 'no_packet'
      WHEN NOT (l.orig_h = r.src AND l.orig_p = r.sport AND l.resp_h = r.dst AND l.resp_p = r.dport AND l.proto = r.proto) THEN 'tuple_differs'
      WHEN abs(l.ts_us - r.ts_us) > 1 THEN 'time_differs' ELSE 'matched' END AS verdict
    FROM ids l LEFT JOIN pkt r ON l.pcap_count = r.packet""",
)
def alert_packet(spark, sf):
    return J.join_ids_packet(roles.ids(spark, sf), decode.decode(roles.frames(spark, sf)))


@question(
    "c6_join_errors",
    CF + roles.DNS + FLOW_JOIN.replace("j AS", "f AS") + DNS_JOIN + """SELECT 'flow' AS source, line, verdict FROM f WHERE verdict <> 'matched'
    UNION ALL SELECT 'dns', line, verdict FROM j WHERE verdict <> 'matched'""",
)
def join_errors(spark, sf):
    parts = {"flow": _flow_join(spark, sf), "dns": _dns_join(spark, sf)}
    out = [J.unmatched(df).select(F.lit(name).alias("source"), "line", "verdict") for name, df in parts.items()]
    return out[0].unionByName(out[1])


@question("c7_conn_with_alert", CI + IDS_JOIN + "SELECT line, uid FROM conn WHERE line IN (SELECT conn_line FROM j WHERE verdict = 'matched')")
def conn_with_alert(spark, sf):
    return J.with_source(roles.conn(spark, sf), _ids_join(spark, sf)).select("line", "uid")


@question(
    "c8_reconcile",
    CP + """, v AS (SELECT orig_h, orig_p, resp_h, resp_p, proto, min(ts_us) AS first_us,
      sum(payload_bytes) FILTER (WHERE i = 0) AS orig_bytes, sum(payload_bytes) FILTER (WHERE i = 1) AS resp_bytes,
      count(*) FILTER (WHERE i = 0) AS orig_pkts, count(*) FILTER (WHERE i = 1) AS resp_pkts,
      sum(ip_bytes) FILTER (WHERE i = 0) AS orig_ip_bytes, sum(ip_bytes) FILTER (WHERE i = 1) AS resp_ip_bytes
      FROM pkt GROUP BY ALL),
    x AS (SELECT v.orig_h, v.orig_p, v.resp_h, v.resp_p, v.proto, c.line, unnest([
      {'field': 'orig_bytes', 'pcap': CAST(v.orig_bytes AS BIGINT), 'log': c.orig_bytes},
      {'field': 'resp_bytes', 'pcap': CAST(v.resp_bytes AS BIGINT), 'log': c.resp_bytes},
      {'field': 'orig_pkts', 'pcap': v.orig_pkts, 'log': c.orig_pkts},
      {'field': 'resp_pkts', 'pcap': v.resp_pkts, 'log': c.resp_pkts},
      {'field': 'orig_ip_bytes', 'pcap': CAST(v.orig_ip_bytes AS BIGINT), 'log': c.orig_ip_bytes},
      {'field': 'resp_ip_bytes', 'pcap': CAST(v.resp_ip_bytes AS BIGINT), 'log': c.resp_ip_bytes}]) AS d
      FROM v JOIN conn c USING (orig_h, orig_p, resp_h, resp_p, proto))
    SELECT orig_h, orig_p, resp_h, resp_p, proto, line, d.field AS field, d.pcap AS pcap, d.log AS log FROM x
    WHERE d.pcap IS DISTINCT FROM d.log""",
)
def reconcile(spark, sf):
    from ..operators import aggregates as A

    conv = A.conversations(roles.named(decode.decode(roles.frames(spark, sf, own=True))))
    named = conv.select(
        *TUPLE, "first_us", F.col("out_payload_bytes").alias("orig_bytes"), F.col("in_payload_bytes").alias("resp_bytes"),
        F.col("out_packets").alias("orig_pkts"), F.col("in_packets").alias("resp_pkts"),
        F.col("out_ip_bytes").alias("orig_ip_bytes"), F.col("in_ip_bytes").alias("resp_ip_bytes"),
    )
    return J.reconcile(named, roles.conn(spark, sf))


for _name, _sql, _fn in (
    ("dns", CD + DNS_JOIN, _dns_join), ("flow", CF + FLOW_JOIN, _flow_join), ("alert", CI + IDS_JOIN, _ids_join),
):
    question(f"c9_cardinality_{_name}", _sql + CARD)(
        lambda spark, sf, fn=_fn: J.join_cardinality(fn(spark, sf), roles.conn(spark, sf))
    )
question(
    "c9_cardinality_firewall", CW + FW_JOIN.replace("j AS", "j0 AS") + ", j AS (SELECT *, CAST(NULL AS BIGINT) AS delta_us FROM j0) " + CARD
)(lambda spark, sf: J.join_cardinality(_fw_join(spark, sf), roles.conn(spark, sf)))

# Every sign-up stands for a lease that ends with the next one of the same address, or after two days.
LEASES = """, lease AS (SELECT orig_h AS ip, 'dev-' || line AS device, ts_us AS valid_from_us,
    least(coalesce(lead(ts_us) OVER (PARTITION BY orig_h ORDER BY ts_us, line), 9000000000000000), ts_us + 172800000000) AS valid_to_us
  FROM conn WHERE event_type = 'signup')
"""


def leases(spark, sf):
    from ..operators import ordered

    s = roles.conn(spark, sf).where(F.col("event_type") == "signup")
    nxt = ordered.carry_next(s, ["orig_h"], "ts_us", {"next_us": F.col("ts_us")}, ["line"])
    return nxt.select(
        F.col("orig_h").alias("ip"), F.concat(F.lit("dev-"), F.col("line").cast("string")).alias("device"),
        F.col("ts_us").alias("valid_from_us"),
        F.least(F.coalesce("next_us", F.lit(9_000_000_000_000_000)), F.col("ts_us") + 172_800_000_000).alias("valid_to_us"),
    )


@question(
    "c10_asset_at_time",
    C + LEASES + """SELECT c.line, c.orig_h AS ip, l.device FROM conn c LEFT JOIN lease l
      ON c.orig_h = l.ip AND c.ts_us >= l.valid_from_us AND c.ts_us < l.valid_to_us""",
)
def asset_at_time(spark, sf):
    events = roles.conn(spark, sf).select("line", "ts_us", F.col("orig_h").alias("ip"))
    return J.asof_asset(events, leases(spark, sf)).select("line", "ip", "device")


NEXT_CONNECTION = CD + """, m AS (SELECT d.line, d.orig_h, d.answer AS address, d.ts_us, c.line AS conn_line, c.ts_us - d.ts_us AS gap_us,
  row_number() OVER (PARTITION BY d.line ORDER BY c.ts_us, c.line) AS rn
  FROM dns d LEFT JOIN conn c ON d.orig_h = c.orig_h AND d.answer = c.resp_h
    AND c.ts_us >= d.ts_us AND c.ts_us - d.ts_us <= 604800000000)
SELECT line, orig_h, address, conn_line, gap_us FROM m WHERE rn = 1"""


@question("c11_dns_then_conn", NEXT_CONNECTION)
def dns_then_conn(spark, sf):
    return J.dns_to_conn(roles.dns(spark, sf), roles.conn(spark, sf), 604_800_000_000)


@question(
    "c12_unresolved_names",
    CD + """SELECT DISTINCT regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS name FROM pages
    WHERE regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) NOT IN (SELECT lower(query) FROM dns)
    UNION SELECT DISTINCT 's' || (k % 17) || '.d' || (user_id % 31) || '.example.test' FROM conn
    WHERE 's' || (k % 17) || '.d' || (user_id % 31) || '.example.test' NOT IN (SELECT lower(query) FROM dns)""",
)
def unresolved_names(spark, sf):
    from ..functions.text import url_host

    pages = roles.table(spark, sf, "pages").select(url_host(F.col("url")).alias("name"))
    used = roles.conn(spark, sf).select(
        F.expr("concat('s', k % 17, '.d', user_id % 31, '.example.test')").alias("name")
    )
    return J.unresolved_names(pages.unionByName(used).distinct(), roles.dns(spark, sf))


@question(
    "c13_alerts_without_conn",
    CI + f"""SELECT l.line, l.signature_id FROM ids l WHERE NOT EXISTS (SELECT 1 FROM conn r
      WHERE {SAME} AND abs(l.ts_us - r.ts_us) <= 10000 AND r.resp_pkts > 0)""",
)
def alerts_without_conn(spark, sf):
    return J.alerts_without_conn(roles.ids(spark, sf), roles.conn(spark, sf)).select("line", "signature_id")


@question(
    "c14_compare_copies",
    CW + """, b AS (SELECT line, sentbyte AS orig_bytes, rcvdbyte AS resp_bytes FROM fw WHERE zeekstate <> 'RSTO')
    SELECT coalesce(c.line, b.line) AS line, CAST(c.line IS NOT NULL AS BIGINT) AS in_a, CAST(b.line IS NOT NULL AS BIGINT) AS in_b,
      CASE WHEN b.line IS NULL THEN 'missing_in_b' WHEN c.line IS NULL THEN 'missing_in_a' ELSE 'differs' END AS status
    FROM (SELECT * FROM conn WHERE conn_state <> 'S0') c FULL JOIN b ON c.line = b.line
    WHERE c.line IS NULL OR b.line IS NULL OR c.orig_bytes <> b.orig_bytes OR c.resp_bytes <> b.resp_bytes""",
)
def compare_copies(spark, sf):
    a = roles.conn(spark, sf).where("conn_state <> 'S0'")
    b = _fw(spark, sf).where("zeekstate <> 'RSTO'").select(
        "line", F.col("sentbyte").alias("orig_bytes"), F.col("rcvdbyte").alias("resp_bytes")
    )
    return J.compare_copies(a, b, ["line"], ["orig_bytes", "resp_bytes"])


@question(
    "c15_not_authorised",
    C + """, allow AS (SELECT resp_h, resp_p FROM conn GROUP BY ALL HAVING sum(orig_bytes) < 100000)
    SELECT line, resp_h, resp_p FROM conn ANTI JOIN allow USING (resp_h, resp_p)""",
)
def not_authorised(spark, sf):
    c = roles.conn(spark, sf)
    allow = c.groupBy("resp_h", "resp_p").agg(F.sum("orig_bytes").alias("b")).where("b < 100000")
    return J.not_authorised(c, allow, ["resp_h", "resp_p"]).select("line", "resp_h", "resp_p")


@question(
    "c16_nearest_match",
    C + """, m AS (SELECT a.line, b.line AS match_id, a.ts_us - b.ts_us AS delta_us,
      row_number() OVER (PARTITION BY a.line ORDER BY abs(a.ts_us - b.ts_us), b.line) AS rn, count(b.line) OVER (PARTITION BY a.line) AS n
      FROM conn a LEFT JOIN conn b ON a.orig_h = b.orig_h AND b.event_type = 'error' AND abs(a.ts_us - b.ts_us) <= 86400000000
      WHERE a.event_type = 'click')
    SELECT line, match_id, delta_us, n > 1 AS ambiguous FROM m WHERE rn = 1""",
)
def nearest_match(spark, sf):
    c = roles.conn(spark, sf).select("line", "ts_us", "orig_h", "event_type")
    return J.nearest_match(
        c.where("event_type = 'click'"), c.where("event_type = 'error'"), ["orig_h"], 86_400_000_000
    ).select("line", "match_id", "delta_us", "ambiguous")


def _matrix(spark, sf):
    c = roles.conn(spark, sf)
    return J.evidence_matrix(
        {
            "conn": c.withColumn("bytes", F.col("orig_bytes")),
            "dns": roles.dns(spark, sf),
            "flow": roles.flow(spark, sf),
            "ids": roles.ids(spark, sf),
            "firewall": _fw(spark, sf).withColumn("bytes", F.col("sentbyte")),
        }
    )


MATRIX = """, u AS (
    SELECT orig_h, orig_p, resp_h, resp_p, proto, 'conn' AS s, orig_bytes AS b FROM conn UNION ALL
    SELECT orig_h, orig_p, resp_h, resp_p, proto, 'dns', NULL FROM dns UNION ALL
    SELECT orig_h, orig_p, resp_h, resp_p, proto, 'flow', bytes FROM flow UNION ALL
    SELECT orig_h, orig_p, resp_h, resp_p, proto, 'ids', NULL FROM ids UNION ALL
    SELECT orig_h, orig_p, resp_h, resp_p, proto, 'fw', sentbyte FROM fw),
  g AS (SELECT orig_h, orig_p, resp_h, resp_p, proto, count(*) FILTER (WHERE s = 'conn') AS conn_records,
    count(*) FILTER (WHERE s = 'dns') AS dns_records, count(*) FILTER (WHERE s = 'flow') AS flow_records,
    count(*) FILTER (WHERE s = 'ids') AS ids_records, count(*) FILTER (WHERE s = 'fw') AS firewall_records,
    sum(b) FILTER (WHERE s = 'conn') AS bc, sum(b) FILTER (WHERE s = 'flow') AS bf, sum(b) FILTER (WHERE s = 'fw') AS bw
    FROM u GROUP BY ALL),
  matrix AS (SELECT orig_h, orig_p, resp_h, resp_p, proto, conn_records, dns_records, flow_records, ids_records, firewall_records,
    CAST(CAST(conn_records > 0 AS INT) + CAST(dns_records > 0 AS INT) + CAST(flow_records > 0 AS INT)
      + CAST(ids_records > 0 AS INT) + CAST(firewall_records > 0 AS INT) AS BIGINT) AS sources_seen,
    bc = bf AND bf = bw AS bytes_agree FROM g)
"""
ALL5 = C + roles.FLOW + roles.DNS + roles.IDS + roles.FIREWALL

question("c17_evidence_matrix", ALL5 + MATRIX + "SELECT * FROM matrix")(_matrix)


@question(
    "k5_independent_witnesses",
    ALL5 + MATRIX + """SELECT orig_h, orig_p, resp_h, resp_p, proto, sources_seen,
    CAST(CASE WHEN conn_records > 0 OR dns_records > 0 OR flow_records > 0 THEN 1 ELSE 0 END + CASE WHEN ids_records > 0 THEN 1 ELSE 0 END
      + CASE WHEN firewall_records > 0 THEN 1 ELSE 0 END AS BIGINT) AS independent_witnesses FROM matrix""",
)
def independent_witnesses(spark, sf):
    parents = {"conn": "capture", "dns": "capture", "flow": "capture", "ids": "sensor", "firewall": "edge"}
    return J.witnesses(_matrix(spark, sf), parents).select(*TUPLE, "sources_seen", "independent_witnesses")


@question(
    "c20_pair_messages",
    CQ + """, m AS (SELECT orig_h AS client, resp_h AS server, event_id % 65536 AS tid, packet, ts_us, i,
      first_value(CASE WHEN i = 1 THEN {'packet': packet, 'ts': ts_us} END IGNORE NULLS) OVER (
        PARTITION BY orig_h, resp_h, event_id % 65536 ORDER BY ts_us, packet ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply
      FROM pkt WHERE proto = 'udp')
    SELECT client, server, tid, packet, reply.packet AS reply_packet, reply.ts - ts_us AS reply_us FROM m WHERE i = 0""",
)
def pair_messages(spark, sf):
    m = decode.decode_dns(decode.decode(roles.frames(spark, sf)))
    asked = m.where("not response").select(F.col("src").alias("client"), F.col("dst").alias("server"), "tid", "ts_us", "packet")
    given = m.where("response").select(F.col("dst").alias("client"), F.col("src").alias("server"), "tid", "ts_us", "packet")
    return J.pair_by_id(asked, given, ["client", "server", "tid"])


@question(
    "c20_turn_replies",
    """SELECT a.conv_id, a.turn AS packet, min(b.turn) AS reply_packet, min(b.turn) - a.turn AS reply_us FROM conversations a
    LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'assistant' AND b.turn > a.turn
    WHERE a.role = 'user' GROUP BY a.conv_id, a.turn""",
)
def turn_replies(spark, sf):
    t = roles.table(spark, sf, "conversations").withColumn("ts_us", F.col("turn")).withColumn("packet", F.col("turn"))
    return J.pair_by_id(t.where("role = 'user'"), t.where("role = 'assistant'"), ["conv_id"], chunk=1000)


@question(
    "c20_http_pairs",
    C + """, m AS (SELECT orig_h AS client, line AS packet, ts_us, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS s FROM conn WHERE event_id % 14 <> 1),
    o AS (SELECT *, sum(s) OVER w AS bal, count(*) FILTER (s > 0) OVER w AS asked, count(*) FILTER (s < 0) OVER w AS given
      FROM m WINDOW w AS (PARTITION BY client ORDER BY ts_us, packet ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT *, least(0, min(bal) OVER (PARTITION BY client ORDER BY ts_us, packet ROWS UNBOUNDED PRECEDING)) AS low FROM o),
    r AS (SELECT *, low < coalesce(lag(low) OVER (PARTITION BY client ORDER BY ts_us, packet), 0) AS orphan FROM l)
    SELECT a.client, a.packet, b.packet AS reply_packet, b.ts_us - a.ts_us AS reply_us
    FROM r a LEFT JOIN r b ON a.client = b.client AND b.s < 0 AND NOT b.orphan AND b.given + b.low = a.asked WHERE a.s > 0""",
)
def http_pairs(spark, sf):
    """One kept-alive connection per client: even events ask, odd ones reply, some with an interim status first."""
    c, ask = roles.conn(spark, sf), F.col("event_id") % 2 == 0
    line = F.when(ask, F.concat(F.lit("GET /"), F.col("event_id").cast("string"), F.lit(" HTTP/1.1"))).when(
        F.col("event_id") % 14 == 1, "HTTP/1.1 100 Continue"
    ).otherwise("HTTP/1.1 200 OK")
    server, client = (F.lit("198.51.100.1"), F.lit(80)), (F.col("orig_h"), F.lit(40000))
    ends = [(F.when(ask, x).otherwise(y)).alias(n) for n, x, y in zip(("src", "sport", "dst", "dport"), (*client, *server), (*server, *client), strict=True)]
    packets = c.select(
        *ends, F.lit("tcp").alias("proto"), F.col("line").alias("packet"), "ts_us",
        F.concat(line, F.lit("\r\nHost: x\r\n\r\n")).cast("binary").alias("payload"),
    )
    return J.pair_http(packets, chunk=86_400_000_000).select("client", "packet", "reply_packet", "reply_us")


@question(
    "c20_payload_list",
    CQ + """SELECT packet, src, dst, CASE WHEN (src, sport) IN (SELECT (dst, dport) FROM pkt WHERE text LIKE 'POST %') THEN 'response' ELSE 'probe' END AS kind, text
    FROM pkt WHERE proto = 'tcp' AND text NOT LIKE 'POST %'""",
)
def payload_list(spark, sf):
    return decode.payload_list(decode.decode(roles.frames(spark, sf))).select("packet", "src", "dst", "kind", "text")


def _correlate(spark, sf):
    c = roles.conn(spark, sf)
    return J.correlate(c.where("event_type = 'purchase'"), c.where("event_type = 'error'"), ["orig_h", "resp_h"], 86_400_000_000)


CORR = """, j AS (SELECT l.line, arg_min(r.line, abs(l.ts_us - r.ts_us) * 1000000 + r.line) AS conn_line,
    arg_min(l.ts_us - r.ts_us, abs(l.ts_us - r.ts_us) * 1000000 + r.line) AS delta_us, count(r.line) > 1 AS ambiguous,
    CASE WHEN count(r.line) = 0 THEN 'unmatched' ELSE 'matched' END AS verdict
  FROM conn l LEFT JOIN conn r ON l.orig_h = r.orig_h AND l.resp_h = r.resp_h AND r.event_type = 'error'
    AND abs(l.ts_us - r.ts_us) <= 86400000000 WHERE l.event_type = 'purchase' GROUP BY l.line)
"""
question("c21_correlate_rows", C + CORR + "SELECT * FROM j")(lambda spark, sf: _correlate(spark, sf)[0])
question(
    "c21_correlate_summary", C + CORR + CARD.replace("FROM conn)", "FROM conn WHERE event_type = 'error')")
)(lambda spark, sf: _correlate(spark, sf)[1])


@question(
    "b13_label_conflicts",
    CW + """, seen AS (SELECT line, CASE resp_p WHEN 443 THEN 'http' WHEN 53 THEN 'dns' ELSE 'not_established' END AS observed FROM conn)
    SELECT fw.line, fw.app AS label, observed AS observed_protocol FROM fw JOIN seen USING (line)
    WHERE app <> '' AND observed <> 'not_established' AND lower(app) <> observed""",
)
def label_conflicts(spark, sf):
    from ..operators import aggregates as A

    conv = A.conversations(roles.named(decode.decode(roles.frames(spark, sf, own=True))))
    return A.label_conflicts(_fw(spark, sf), conv).select("line", "label", "observed_protocol")
