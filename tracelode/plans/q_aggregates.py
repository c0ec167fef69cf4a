"""Questions answered by counts and sums."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import decode, filters, instances
from ..session import cut_lineage
from . import roles
from .q_joins import IDS_JOIN, _ids_join
from .q_records import firewall, host_packets, packets
from .registry import question
from .roles import TUPLE

C = roles.CONN
CD, CI, CW, CP = C + roles.DNS, C + roles.IDS, C + roles.FIREWALL, C + roles.PACKETS
CF = C + roles.FLOW
T5 = ", ".join(TUPLE)

CONV = """, conv AS (SELECT orig_h, orig_p, resp_h, resp_p, proto, min(ts_us) AS first_us, max(ts_us) AS last_us, min(packet) AS first_packet,
    max(packet) AS last_packet, CAST(sum(payload_bytes) FILTER (WHERE i = 0) AS BIGINT) AS out_payload_bytes,
    CAST(sum(payload_bytes) FILTER (WHERE i = 1) AS BIGINT) AS in_payload_bytes, CAST(sum(ip_bytes) FILTER (WHERE i = 0) AS BIGINT) AS out_ip_bytes,
    CAST(sum(ip_bytes) FILTER (WHERE i = 1) AS BIGINT) AS in_ip_bytes, count(*) FILTER (WHERE i = 0) AS out_packets, count(*) FILTER (WHERE i = 1) AS in_packets,
    CASE WHEN proto = 'udp' THEN 'dns' WHEN resp_p = 443 THEN 'http_upload' ELSE 'other_tcp' END AS phase
  FROM pkt GROUP BY ALL)
"""


def conversations(spark, sf):
    return A.conversations(host_packets(spark, sf))


HOST = "10.20.0.9"


@question(
    "d1_log_counts",
    CD + "".join(
        f"{'UNION ALL ' if s != 'dns' else ''}SELECT '{s}' AS source, count(*) AS records, count(*) FILTER (WHERE orig_h = '{HOST}') AS host_origin, "
        f"count(*) FILTER (WHERE resp_h = '{HOST}') AS host_destination FROM {s} "
        for s in ("dns", "conn")
    ),
)
def log_counts(spark, sf):
    return A.log_counts({"dns": roles.dns(spark, sf), "conn": roles.conn(spark, sf)}, HOST)


@question("d2_value_counts", CW + "SELECT dstintf AS value, count(*) AS n FROM fw GROUP BY ALL")
def value_counts(spark, sf):
    return A.value_counts(firewall(spark, sf), "dstintf")


@question(
    "d3_capture_summary",
    CP + f"""SELECT count(*) AS packets, count(*) FILTER (WHERE src = '{HOST}' OR dst = '{HOST}') AS host_packets,
      count(*) FILTER (WHERE src = '{HOST}') AS host_out_packets, count(*) FILTER (WHERE dst = '{HOST}') AS host_in_packets,
      count(*) FILTER (WHERE proto = 'tcp' AND i = 0) AS syn_without_ack, count(*) FILTER (WHERE proto = 'udp' AND i = 0) AS dns_queries,
      count(*) FILTER (WHERE event_id % 53 = 0) AS truncated, CAST(0 AS BIGINT) AS non_ipv4, CAST(0 AS BIGINT) AS fragments,
      CAST(0 AS BIGINT) AS other_protocol, CAST(0 AS BIGINT) AS bad_frames,
      min(ts_us) FILTER (WHERE src = '{HOST}' OR dst = '{HOST}') AS host_first_us, max(ts_us) FILTER (WHERE src = '{HOST}' OR dst = '{HOST}') AS host_last_us
    FROM pkt""",
)
def capture_summary(spark, sf):
    return A.capture_summary(roles.frames(spark, sf, own=True), HOST)


@question(
    "d4_conversations",
    CP + CONV + f"""SELECT {T5}, first_us, last_us, first_packet, last_packet, out_payload_bytes, in_payload_bytes, out_ip_bytes, in_ip_bytes,
    out_packets, in_packets, phase = 'http_upload' AS starts_post, CASE phase WHEN 'http_upload' THEN 'http' WHEN 'dns' THEN 'dns' ELSE 'not_established' END AS observed_protocol FROM conv""",
)
def conversations_from_packets(spark, sf):
    return conversations(spark, sf)


@question(
    "d4_connection_sums",
    C + """SELECT orig_h, resp_h, resp_p, proto, count(*) AS conversations, CAST(sum(orig_bytes) AS BIGINT) AS orig_bytes, CAST(sum(resp_bytes) AS BIGINT) AS resp_bytes,
      min(ts_us) AS first_us, max(ts_us) AS last_us FROM conn GROUP BY ALL""",
)
def connection_sums(spark, sf):
    return roles.conn(spark, sf).groupBy("orig_h", "resp_h", "resp_p", "proto").agg(
        F.count(F.lit(1)).alias("conversations"), F.sum("orig_bytes").alias("orig_bytes"), F.sum("resp_bytes").alias("resp_bytes"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
    )


@question("d5_peers", C + "SELECT host, peer, count(*) AS conversations FROM (SELECT orig_h AS host, resp_h AS peer FROM conn UNION ALL SELECT resp_h, orig_h FROM conn) GROUP BY ALL")
def peers(spark, sf):
    return A.peers(roles.conn(spark, sf))


@question("d6_contact_matrix", C + """SELECT orig_h, resp_h, resp_p, proto, count(*) AS conversations, count(*) FILTER (WHERE resp_pkts > 0) AS replied,
  bool_or(resp_bytes > 0) AS reply_data_seen FROM conn GROUP BY ALL""")
def contact_matrix(spark, sf):
    c = roles.conn(spark, sf)
    return A.contact_matrix(c.withColumn("in_packets", F.col("resp_pkts")).withColumn("in_payload_bytes", F.col("resp_bytes")))


@question(
    "d7_port_groups",
    C + """, d AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY resp_p ORDER BY ts_us, line) AS gap FROM conn)
    SELECT resp_p, count(*) AS connections, count(DISTINCT resp_h) AS peers, CAST(sum(orig_bytes) AS BIGINT) AS orig_bytes,
      CAST(sum(resp_bytes) AS BIGINT) AS resp_bytes, min(ts_us) AS first_us, max(ts_us) AS last_us, count(gap) AS intervals,
      CAST(round(avg(gap)) AS BIGINT) AS mean_us, CAST(round(stddev_pop(gap) / 1000) AS BIGINT) AS sd_ms FROM d GROUP BY resp_p""",
)
def port_groups(spark, sf):
    return A.port_groups(roles.conn(spark, sf)).select(
        "resp_p", "connections", "peers", "orig_bytes", "resp_bytes", "first_us", "last_us", "intervals",
        F.round("mean_us").cast("bigint").alias("mean_us"), F.round(F.col("sd_us") / 1000).cast("bigint").alias("sd_ms"),
    )


@question("d7_port_peers", C + """SELECT resp_p, resp_h, count(*) AS connections, any_value(CAST(split_part(resp_h, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(resp_h, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(resp_h, '.', 3) AS BIGINT) * 256 + CAST(split_part(resp_h, '.', 4) AS BIGINT)) AS ip_num FROM conn GROUP BY resp_p, resp_h""")
def port_peers(spark, sf):
    return A.port_peers(roles.conn(spark, sf))


@question(
    "d8_phase_metrics",
    CP + CONV + """, d AS (SELECT *, first_us - lag(first_us) OVER (PARTITION BY phase ORDER BY first_us) AS gap FROM conv)
    SELECT phase, count(*) AS conversations, count(DISTINCT resp_h) AS peers, max(last_us) AS last_packet_us, min(first_packet) AS first_packet,
      max(last_packet) AS last_packet, CAST(sum(out_payload_bytes) AS BIGINT) AS out_payload_bytes, CAST(sum(in_payload_bytes) AS BIGINT) AS in_payload_bytes,
      CAST(sum(out_ip_bytes) AS BIGINT) AS out_ip_bytes, CAST(sum(in_ip_bytes) AS BIGINT) AS in_ip_bytes,
      CAST(sum(out_packets) AS BIGINT) AS out_packets, CAST(sum(in_packets) AS BIGINT) AS in_packets, min(first_us) AS first_start_us, max(first_us) AS last_start_us,
      count(gap) AS intervals, CAST(round(avg(gap)) AS BIGINT) AS mean_us, CAST(round(stddev_pop(gap) / 1000) AS BIGINT) AS sd_ms,
      max(first_us) - min(first_us) AS start_span_us, max(last_us) - min(first_us) AS packet_span_us FROM d GROUP BY phase""",
)
def phase_metrics(spark, sf):
    # Read three times below; written once instead of decoding the capture three times.
    m = A.phase_metrics(cut_lineage(filters.phase(conversations(spark, sf))))
    return m.withColumn("sd_ms", F.round(F.col("sd_us") / 1000).cast("bigint")).withColumn(
        "mean_us", F.round("mean_us").cast("bigint")
    ).drop("sd_us")


@question(
    "d9_host_totals",
    CP + roles.FLOW + CONV + """SELECT CAST(sum(out_payload_bytes) AS BIGINT) AS out_payload_bytes, CAST(sum(in_payload_bytes) AS BIGINT) AS in_payload_bytes,
      CAST(sum(out_ip_bytes) AS BIGINT) AS out_ip_bytes, CAST(sum(in_ip_bytes) AS BIGINT) AS in_ip_bytes, CAST(sum(out_packets) AS BIGINT) AS out_packets,
      CAST(sum(in_packets) AS BIGINT) AS in_packets, (SELECT CAST(sum(bytes) AS BIGINT) FROM flow) AS flow_bytes FROM conv""",
)
def host_totals(spark, sf):
    return A.host_totals(conversations(spark, sf), roles.flow(spark, sf))


@question(
    "d10_bytes_by_destination",
    C + """SELECT zone, resp_h, CAST(sum(orig_bytes) AS BIGINT) AS bytes, count(*) AS conversations, CAST(grouping(zone) * 2 + grouping(resp_h) AS BIGINT) AS level
    FROM (SELECT *, CASE WHEN k < 60 THEN 'internal' ELSE 'external' END AS zone FROM conn) GROUP BY ROLLUP (zone, resp_h)""",
)
def bytes_by_destination(spark, sf):
    return A.bytes_by_destination(roles.conn(spark, sf), size="orig_bytes")


@question(
    "d11_byte_units",
    CP + CONV + """SELECT 'out_payload' AS unit, CAST(sum(out_payload_bytes) AS BIGINT) AS bytes FROM conv UNION ALL SELECT 'in_payload', sum(in_payload_bytes) FROM conv
    UNION ALL SELECT 'out_ip', sum(out_ip_bytes) FROM conv UNION ALL SELECT 'in_ip', sum(in_ip_bytes) FROM conv""".replace("sum(in_", "CAST(sum(in_").replace("sum(out_ip_bytes)", "CAST(sum(out_ip_bytes) AS BIGINT)").replace("in_payload_bytes) FROM", "in_payload_bytes) AS BIGINT) FROM").replace("in_ip_bytes) FROM", "in_ip_bytes) AS BIGINT) FROM"),
)
def byte_units(spark, sf):
    return A.byte_units(
        conversations(spark, sf),
        {"out_payload": F.col("out_payload_bytes"), "in_payload": F.col("in_payload_bytes"), "out_ip": F.col("out_ip_bytes"), "in_ip": F.col("in_ip_bytes")},
    )


@question(
    "d12_distinct_values",
    CD + """SELECT DISTINCT 'query' AS field, query AS value FROM dns UNION SELECT DISTINCT 'rcode_name', rcode_name FROM dns
    UNION SELECT DISTINCT 'ttl', CAST(ttl AS VARCHAR) FROM dns UNION SELECT DISTINCT 'answers', answer FROM dns""",
)
def distinct_values(spark, sf):
    d = roles.dns(spark, sf).withColumn("answers", F.array("answer"))
    return A.distinct_values(d, ["query", "rcode_name", "ttl", "answers"])


@question("d13_states", C + "SELECT resp_p, conn_state, count(*) AS connections FROM conn GROUP BY ALL")
def states(spark, sf):
    return A.states(roles.conn(spark, sf))


@question("d13_states_wide", C + "SELECT resp_p, count(*) FILTER (WHERE conn_state = 'SF') AS sf, count(*) FILTER (WHERE conn_state = 'S0') AS s0, count(*) FILTER (WHERE conn_state = 'RSTO') AS rsto FROM conn GROUP BY resp_p")
def states_wide(spark, sf):
    return A.states_wide(roles.conn(spark, sf), ["SF", "S0", "RSTO"])


@question("d14_signature_counts", CI + "SELECT signature_id, count(*) AS alerts FROM ids GROUP BY ALL")
def signature_counts(spark, sf):
    return A.signature_counts(roles.ids(spark, sf))


@question("d15_alerts_per_conn", CI + IDS_JOIN + "SELECT k, count(*) AS n FROM (SELECT count(*) AS k FROM j WHERE verdict = 'matched' GROUP BY conn_line) GROUP BY k")
def alerts_per_conn(spark, sf):
    return A.count_histogram(_ids_join(spark, sf).where("verdict = 'matched'"), "conn_line")


@question("d15_lines_per_order", "SELECT k, count(*) AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey) GROUP BY k")
def lines_per_order(spark, sf):
    return A.count_histogram(roles.table(spark, sf, "lineitem"), "l_orderkey")


@question("d16_flag_patterns", CP + "SELECT '[2, 18]' AS pattern, CAST(2 AS BIGINT) AS packets, count(*) AS conversations FROM pkt WHERE proto = 'tcp' AND i = 0")
def flag_patterns(spark, sf):
    """A tuple that comes back is another connection, with flags of its own."""
    # Numbering counts its keys and orders its rows, so the packets are decoded once before it.
    tcp = host_packets(spark, sf).where("proto = 'tcp'").drop("payload", "ack", "ip_bytes", "payload_bytes")
    return A.flag_patterns(instances.number(cut_lineage(tcp)))


_KINDS = ("signup", "click", "view", "purchase", "error")


@question(
    "d16_flag_histories",
    C + """, p AS (SELECT orig_h, line, CAST(list_position(['signup', 'click', 'view', 'purchase', 'error'], event_type) AS BIGINT) % 3 AS f,
      row_number() OVER (PARTITION BY orig_h ORDER BY line) AS i FROM conn),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY orig_h, f ORDER BY line) AS run FROM p),
    r AS (SELECT orig_h, f, min(i) AS start, count(*) AS n FROM g GROUP BY orig_h, f, run),
    t AS (SELECT orig_h, CAST(sum(n) AS BIGINT) AS packets,
      '[' || string_agg(CASE WHEN n > 3 THEN f || 'x' || n ELSE repeat(f || ', ', CAST(n AS INTEGER) - 1) || f END, ', ' ORDER BY start) || ']' AS pattern
      FROM r GROUP BY orig_h)
    SELECT packets, pattern, count(*) AS conversations FROM t GROUP BY packets, pattern""",
)
def flag_histories(spark, sf):
    """One conversation per host, whose flags follow the kinds of its events."""
    flags = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("event_type")) % 3
    return A.flag_patterns(roles.conn(spark, sf).select(
        F.col("orig_h").alias("src"), F.lit(1).alias("sport"), F.lit("198.51.100.1").alias("dst"), F.lit(2).alias("dport"),
        F.lit("tcp").alias("proto"), F.col("line").alias("packet"), flags.alias("flags"),
    ))


@question("d17_payload_counts", CP + "SELECT text, count(*) AS n FROM pkt WHERE proto = 'tcp' GROUP BY text")
def payload_counts(spark, sf):
    return A.payload_counts(packets(spark, sf).where("proto = 'tcp'"))


@question(
    "d17_document_texts",
    "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY text",
)
def document_texts(spark, sf):
    docs = roles.table(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("payload"))
    counted = A.payload_counts(docs.withColumn("payload_bytes", F.length("payload")))
    return counted.select(F.sha2(F.encode("text", "ISO-8859-1"), 256).alias("sha256"), "n")


@question(
    "d18_http_accounting",
    CP + """SELECT count(*) AS requests, CAST(sum(length(text)) AS BIGINT) AS payload_bytes, CAST(sum(length(text) - k - 1) AS BIGINT) AS header_bytes,
      CAST(sum(k + 1) AS BIGINT) AS body_bytes, TRUE AS adds_up, TRUE AS lengths_agree FROM pkt WHERE resp_p = 443 AND i = 0""",
)
def http_accounting(spark, sf):
    return A.http_accounting(decode.http_messages(packets(spark, sf)))


@question("d19_all_of", C + "SELECT bool_and(orig_ip_bytes = orig_bytes + 40 * orig_pkts) AS header_sums, bool_and(resp_bytes > 0) AS all_answered FROM conn")
def all_of(spark, sf):
    return A.all_of(
        roles.conn(spark, sf),
        {"header_sums": F.col("orig_ip_bytes") == F.col("orig_bytes") + 40 * F.col("orig_pkts"), "all_answered": F.col("resp_bytes") > 0},
    )


@question("d20_body_bytes", CP + "SELECT packet, CAST(1 AS BIGINT) AS distinct_bytes, CAST(65 + k % 20 AS BIGINT) AS first_byte FROM pkt WHERE resp_p = 443 AND i = 0")
def body_bytes(spark, sf):
    b = decode.body_bytes(decode.http_messages(packets(spark, sf)))
    return b.select("packet", "distinct_bytes", F.col("byte_values")[0].cast("bigint").alias("first_byte"))


@question(
    "d21_unit_counts",
    CP + roles.IDS + """SELECT 'packets' AS unit, count(*) AS n FROM pkt UNION ALL SELECT 'connections', count(*) FROM conn
    UNION ALL SELECT 'alerts', count(*) FROM ids UNION ALL SELECT 'conversations', count(*) FROM (SELECT DISTINCT orig_h, orig_p, resp_h, resp_p, proto FROM conn)""",
)
def unit_counts(spark, sf):
    c = roles.conn(spark, sf)
    return A.unit_counts({"packets": roles.frames(spark, sf), "connections": c, "alerts": roles.ids(spark, sf), "conversations": c.select(*TUPLE).distinct()})


@question("d22_name_prevalence", CD + "SELECT lower(query) AS name, count(DISTINCT orig_h) AS hosts, count(*) AS queries FROM dns GROUP BY ALL")
def name_prevalence(spark, sf):
    return A.name_prevalence(roles.dns(spark, sf))


@question("d22_rare_names", CD + "SELECT lower(query) AS name, count(DISTINCT orig_h) AS hosts, count(*) AS queries FROM dns GROUP BY ALL HAVING count(DISTINCT orig_h) <= 3")
def rare_names(spark, sf):
    return A.name_prevalence(roles.dns(spark, sf), max_hosts=3)


@question("d23_outbound_over", C + """SELECT orig_h, ts_us - ts_us % 900000000 AS window_us, CAST(sum(orig_bytes) AS BIGINT) AS bytes, count(*) AS conversations
  FROM conn GROUP BY ALL HAVING sum(orig_bytes) > 10000""")
def outbound_over(spark, sf):
    return A.outbound_over(roles.conn(spark, sf), 900_000_000, 10_000)


@question(
    "d24_outbound_vs_baseline",
    C + """, d AS (SELECT orig_h, ts_us - ts_us % 86400000000 AS day_us, CAST(sum(orig_bytes) AS BIGINT) AS bytes FROM conn GROUP BY ALL)
    SELECT orig_h, day_us, bytes, count(*) OVER w AS baseline_days, round(avg(bytes) OVER w, 4) AS baseline_mean,
      round((bytes - avg(bytes) OVER w) / nullif(stddev_pop(bytes) OVER w, 0), 4) AS z
    FROM d WINDOW w AS (PARTITION BY orig_h ORDER BY day_us RANGE BETWEEN 604800000000 PRECEDING AND 86400000000 PRECEDING)""",
)
def outbound_vs_baseline(spark, sf):
    return A.outbound_vs_baseline(roles.conn(spark, sf), 7).select(
        "orig_h", "day_us", "bytes", "baseline_days", F.round("baseline_mean", 4).alias("baseline_mean"), F.round("z", 4).alias("z")
    )


@question("d25_byte_ratio", C + """SELECT orig_h, CAST(sum(orig_bytes) AS BIGINT) AS out_bytes, CAST(sum(resp_bytes) AS BIGINT) AS in_bytes,
  round(sum(orig_bytes) / nullif(sum(resp_bytes), 0), 6) AS ratio FROM conn GROUP BY orig_h""")
def byte_ratio(spark, sf):
    return A.byte_ratio(roles.conn(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@question(
    "d26_fan_out",
    C + """, p AS (SELECT orig_h, ts_us - ts_us % 86400000000 AS window_us, count(DISTINCT resp_h) AS peers FROM conn
      WHERE resp_p IN (22, 445, 3389) AND k < 60 GROUP BY ALL),
    g AS (SELECT *, peers - lag(peers) OVER (PARTITION BY orig_h ORDER BY window_us) AS growth FROM p) SELECT * FROM g WHERE peers >= 2""",
)
def fan_out(spark, sf):
    return A.fan_out(roles.conn(spark, sf), 86_400_000_000, 2)


@question("d27_account_spread", C + "SELECT 'acct' || user_id AS account, count(DISTINCT resp_h) AS hosts, count(*) AS logons FROM conn GROUP BY user_id HAVING count(DISTINCT resp_h) >= 40")
def account_spread(spark, sf):
    auth = roles.conn(spark, sf).select(F.concat(F.lit("acct"), F.col("user_id").cast("string")).alias("account"), F.col("resp_h").alias("host"))
    return A.account_spread(auth, 40)


@question("d28_first_seen", C + "SELECT orig_h, resp_h, min(ts_us) AS first_us, count(*) AS connections FROM conn GROUP BY ALL HAVING min(ts_us) >= 1705276800000000")
def first_seen(spark, sf):
    return A.first_seen(roles.conn(spark, sf), 1_705_276_800_000_000)


@question("d29_top_talkers", C + "SELECT orig_h, CAST(sum(orig_bytes) AS BIGINT) AS bytes FROM conn GROUP BY orig_h ORDER BY bytes DESC, orig_h LIMIT 10")
def top_talkers(spark, sf):
    return A.top_talkers(roles.conn(spark, sf), 10)


@question(
    "d30_name_shape",
    """WITH n AS (SELECT DISTINCT regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS name FROM pages),
    c AS (SELECT name, unnest(string_split(name, '')) AS ch FROM n), f AS (SELECT name, ch, count(*) AS x FROM c GROUP BY ALL),
    e AS (SELECT name, -sum(x / length(name) * log2(x / length(name))) AS h FROM f GROUP BY name),
    s AS (SELECT name, len(string_split(name, '.')) AS labels, list_max([length(x) FOR x IN string_split(name, '.')]) AS longest_label,
      array_to_string(string_split(name, '.')[-2:], '.') AS parent FROM n)
    SELECT parent, name, labels, longest_label, round(h, 6) AS entropy, count(*) OVER (PARTITION BY parent) AS names_under_parent FROM s JOIN e USING (name)""",
)
def name_shape(spark, sf):
    from ..functions.text import url_host

    names = roles.table(spark, sf, "pages").select(url_host(F.col("url")).alias("query"))
    return A.name_shape(names).withColumn("entropy", F.round("entropy", 6))


@question(
    "d31_one_sided",
    CF + """SELECT line FROM conn c WHERE resp_pkts > 0 AND NOT EXISTS (SELECT 1 FROM flow f WHERE f.orig_h = c.resp_h AND f.orig_p = c.resp_p
      AND f.resp_h = c.orig_h AND f.resp_p = c.orig_p AND f.proto = c.proto)""",
)
def one_sided(spark, sf):
    return A.one_sided(roles.flow(spark, sf), roles.conn(spark, sf)).select("line")


@question("d32_reply_rate", C + "SELECT resp_p, count(*) AS conversations, count(*) FILTER (WHERE resp_bytes > 0) AS replied, round(avg(CAST(resp_bytes > 0 AS INT)), 6) AS rate FROM conn GROUP BY resp_p")
def reply_rate(spark, sf):
    return A.reply_rate(roles.conn(spark, sf)).withColumn("rate", F.round("rate", 6))
