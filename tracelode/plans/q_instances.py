"""Questions on tuples that come back over days, and on several captures at once."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import decode, filters, instances
from ..operators import joins as J
from ..session import cut_lineage
from ..sources.logs import parse_firewall
from . import roles
from .registry import question
from .roles import TUPLE

T5 = ", ".join(TUPLE)
IDLE = 86_400_000_000
BYTES = ["orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes"]

# Packets of one pair in order of time: what stood before each, then where a new instance begins.
NUMBERED = """,
ends AS (
  SELECT *, (src, sport) <= (dst, dport) AS from_a, proto = 'tcp' AND flags = 2 AS opens, event_id AS seq,
    CASE WHEN (src, sport) <= (dst, dport) THEN src || ':' || sport || ' ' || dst || ':' || dport ELSE dst || ':' || dport || ' ' || src || ':' || sport END AS pair
  FROM pkt),
seen AS (
  SELECT *, lag(ts_us) OVER w AS before, lag(CASE WHEN NOT opens THEN 0 WHEN from_a THEN 1 ELSE 2 END) OVER w AS opened,
    CASE WHEN from_a THEN last_value(CASE WHEN opens AND from_a THEN seq END IGNORE NULLS) OVER p
      ELSE last_value(CASE WHEN opens AND NOT from_a THEN seq END IGNORE NULLS) OVER p END AS last_syn
  FROM ends WINDOW w AS (PARTITION BY pair, proto ORDER BY ts_us, {order}),
    p AS (PARTITION BY pair, proto ORDER BY ts_us, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN before IS NULL OR ts_us - before > {idle}
      OR (opens AND last_syn IS DISTINCT FROM seq AND opened IS DISTINCT FROM CASE WHEN from_a THEN 2 ELSE 1 END) THEN 1 ELSE 0 END)
    OVER (PARTITION BY pair, proto ORDER BY ts_us, {order}) AS BIGINT) - 1 AS instance
  FROM seen),
opener AS (
  SELECT pair, proto, instance, coalesce(
    arg_min({{'h': src, 'p': sport}}, (ts_us, {order})) FILTER (WHERE opens), arg_min({{'h': src, 'p': sport}}, (ts_us, {order}))) AS o
  FROM numbered GROUP BY pair, proto, instance),
turned AS (
  SELECT n.*, o.h = src AND o.p = sport AS from_orig FROM numbered n JOIN opener USING (pair, proto, instance)),
inst AS (
  SELECT CASE WHEN from_orig THEN src ELSE dst END AS orig_h, CASE WHEN from_orig THEN sport ELSE dport END AS orig_p,
    CASE WHEN from_orig THEN dst ELSE src END AS resp_h, CASE WHEN from_orig THEN dport ELSE sport END AS resp_p, proto, instance,
    min(ts_us) AS first_us, max(ts_us) AS last_us, min(packet) AS first_packet, max(packet) AS last_packet,
    CAST(coalesce(sum(payload_bytes) FILTER (WHERE from_orig), 0) AS BIGINT) AS out_payload_bytes,
    CAST(coalesce(sum(payload_bytes) FILTER (WHERE NOT from_orig), 0) AS BIGINT) AS in_payload_bytes,
    CAST(coalesce(sum(ip_bytes) FILTER (WHERE from_orig), 0) AS BIGINT) AS out_ip_bytes, CAST(coalesce(sum(ip_bytes) FILTER (WHERE NOT from_orig), 0) AS BIGINT) AS in_ip_bytes,
    count(*) FILTER (WHERE from_orig) AS out_packets, count(*) FILTER (WHERE NOT from_orig) AS in_packets,
    bool_or(from_orig AND coalesce(text LIKE 'POST %', FALSE)) AS post
  FROM turned GROUP BY ALL)
"""
ONE = roles.REUSED + roles.PACKETS + NUMBERED.format(order="packet", idle=IDLE)
MANY = roles.REUSED + roles.CAPTURES + NUMBERED.format(order="file, packet", idle=IDLE)

# Each record with the last instance of its tuple that began by then, if it had not ended.
HELD = """,
held AS (
  SELECT r.line, arg_max(i.instance, i.first_us) AS instance, arg_max(i.last_us, i.first_us) AS until_us, any_value(r.ts_us) AS rec_us
  FROM {records} r JOIN inst i ON r.orig_h = i.orig_h AND r.orig_p = i.orig_p AND r.resp_h = i.resp_h AND r.resp_p = i.resp_p AND r.proto = i.proto
    AND i.first_us <= r.ts_us + 10000 GROUP BY r.line),
mine AS (SELECT r.*, instance FROM {records} r JOIN held USING (line) WHERE rec_us <= until_us + 10000)
"""


# The same where instances may begin at the same time: the last by number.
HELD_LAST = HELD.replace("i.instance, i.first_us)", "i.instance, (i.first_us, i.instance))").replace("i.last_us, i.first_us)", "i.last_us, (i.first_us, i.instance))")


def numbered(spark, sf, captures=1, own=True):
    """Numbering counts its keys and orders its rows, so the packets are decoded once before it."""
    packets = decode.decode(roles.frames(spark, sf, roles.reused(spark, sf), captures, own))
    return instances.number(cut_lineage(roles.named(packets) if own else packets), IDLE)


def conversations(spark, sf, own=True):
    return A.conversations(numbered(spark, sf, own=own))


@question("d4_instances", ONE + f"""SELECT {T5}, instance, first_us, last_us, first_packet, last_packet, out_payload_bytes, in_payload_bytes, out_ip_bytes, in_ip_bytes,
  out_packets, in_packets FROM inst""")
def reused_tuples(spark, sf):
    return conversations(spark, sf).drop("starts_post", "observed_protocol")


@question("d4_instances_captures", MANY + f"SELECT {T5}, instance, first_us, last_us, out_payload_bytes, in_packets FROM inst")
def several_captures(spark, sf):
    """Connections whose packets lie in three captures that number them alike."""
    conv = A.conversations(numbered(spark, sf, 3))
    return conv.select(*TUPLE, "instance", "first_us", "last_us", "out_payload_bytes", "in_packets")


@question("b4_orient_captures", MANY + f"""SELECT t.file, t.packet, i.orig_h, i.orig_p, i.resp_h, i.resp_p, t.proto, t.instance, t.from_orig
  FROM turned t JOIN inst i ON t.instance = i.instance AND t.proto = i.proto
    AND ((t.from_orig AND i.orig_h = t.src AND i.orig_p = t.sport AND i.resp_h = t.dst AND i.resp_p = t.dport)
      OR (NOT t.from_orig AND i.orig_h = t.dst AND i.orig_p = t.dport AND i.resp_h = t.src AND i.resp_p = t.sport))""")
def orient_captures(spark, sf):
    return filters.orient(numbered(spark, sf, 3)).select("file", "packet", *TUPLE, "instance", "from_orig")


@question("a13_instance_table", roles.REUSED + roles.on_wire(roles.PACKETS) + NUMBERED.format(order="packet", idle=IDLE) + HELD_LAST.format(records="conn") + f"""SELECT {T5}, inst.instance, mine.line AS conn_line,
  CASE WHEN proto = 'udp' AND resp_p = 53 THEN 'dns' WHEN post THEN 'http_upload' ELSE 'other_tcp' END AS phase, out_payload_bytes
  FROM inst LEFT JOIN mine USING ({T5}, instance)""")
def instance_table(spark, sf):
    table = A.conversation_table(conversations(spark, sf, own=False), roles.reused(spark, sf))
    return table.select(*TUPLE, "instance", "conn_line", "phase", "out_payload_bytes")


@question("b13_instance_labels", roles.REUSED + roles.FIREWALL + roles.PACKETS + NUMBERED.format(order="packet", idle=IDLE) + """,
  fwt AS (SELECT fw.*, ts_us FROM fw JOIN conn USING (line))""" + HELD.format(records="fwt") + f"""
  SELECT mine.line, mine.app AS label, CASE WHEN proto = 'udp' THEN 'dns' WHEN post THEN 'http' ELSE 'not_established' END AS observed_protocol
  FROM mine JOIN inst USING ({T5}, instance) WHERE app <> '' AND (proto = 'udp' OR post) AND lower(app) <> CASE WHEN proto = 'udp' THEN 'dns' ELSE 'http' END""")
def instance_labels(spark, sf):
    c = roles.reused(spark, sf)
    fw = parse_firewall(roles.firewall_text(spark, sf, c)).drop("ts_us").join(c.select("line", "ts_us"), "line")
    return A.label_conflicts(fw, conversations(spark, sf)).select("line", "label", "observed_protocol")


@question("c8_reused_tuples", ONE + HELD.format(records="conn") + """,
  x AS (SELECT inst.orig_h, inst.orig_p, inst.resp_h, inst.resp_p, inst.proto, inst.instance, mine.line, unnest(CASE WHEN mine.line IS NULL
      THEN [{'field': 'no conn record', 'pcap': CAST(NULL AS BIGINT), 'log': CAST(NULL AS BIGINT)}] ELSE [
        {'field': 'orig_bytes', 'pcap': out_payload_bytes, 'log': mine.orig_bytes}, {'field': 'resp_bytes', 'pcap': in_payload_bytes, 'log': mine.resp_bytes},
        {'field': 'orig_pkts', 'pcap': out_packets, 'log': mine.orig_pkts}, {'field': 'resp_pkts', 'pcap': in_packets, 'log': mine.resp_pkts},
        {'field': 'orig_ip_bytes', 'pcap': out_ip_bytes, 'log': mine.orig_ip_bytes}, {'field': 'resp_ip_bytes', 'pcap': in_ip_bytes, 'log': mine.resp_ip_bytes},
        {'field': CASE WHEN abs(first_us - mine.ts_us) > 1 THEN 'ts' END, 'pcap': first_us, 'log': mine.ts_us}] END) AS d
    FROM inst LEFT JOIN mine USING (orig_h, orig_p, resp_h, resp_p, proto, instance))
  SELECT orig_h, orig_p, resp_h, resp_p, proto, instance, line, d.field AS field, d.pcap AS pcap, d.log AS log FROM x
  WHERE d.field IS NOT NULL AND (d.pcap IS DISTINCT FROM d.log OR d.field = 'no conn record')""")
def reconcile(spark, sf):
    """Instances next to the records of their own time, so yesterday's connection is not held against today's record."""
    names = dict(zip(["out_payload_bytes", "in_payload_bytes", "out_packets", "in_packets", "out_ip_bytes", "in_ip_bytes"], BYTES))
    return J.reconcile(conversations(spark, sf).withColumnsRenamed(names), roles.reused(spark, sf))


@question("c5_alert_captures", roles.CONN + roles.on_wire(roles.CAPTURES) + roles.IDS.replace("(line - 1) * 2 + 1 + nth AS pcap_count", "(line - 1) // 3 * 2 + 1 + nth AS pcap_count") + """,
  m AS (SELECT l.line, l.pcap_count, r.file, CASE WHEN r.packet IS NULL THEN 4
      WHEN NOT (l.orig_h = r.src AND l.orig_p = r.sport AND l.resp_h = r.dst AND l.resp_p = r.dport AND l.proto = r.proto) THEN 3
      WHEN abs(l.ts_us - r.ts_us) > 1 THEN 2 ELSE 1 END AS rank
    FROM ids l LEFT JOIN pkt r ON l.pcap_count = r.packet)
  SELECT line, pcap_count, arg_min(file, (rank, file)) AS packet_file, (['matched', 'time_differs', 'tuple_differs', 'no_packet'])[min(rank)] AS verdict
  FROM m GROUP BY line, pcap_count""")
def alert_captures(spark, sf):
    """Alerts that cite a packet number which every capture has: each still has one verdict."""
    ids = roles.ids(spark, sf).withColumn("pcap_count", F.expr("(line div 3 - 1) div 3 * 2 + 1 + line % 3"))
    return J.join_ids_packet(ids, decode.decode(roles.frames(spark, sf, captures=3)))
