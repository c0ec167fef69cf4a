"""Questions that combine findings, streaming forms, and governance."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import detections as D
from ..operators import governance as K
from ..operators import temporal as T
from ..functions.clock import DAY, floor_us
from ..sources import logs
from ..streaming import buffers as B
from ..streaming import detect as S
from ..streaming.runtime import drain, replay, scratch
from . import roles
from .q_joins import NEXT_CONNECTION
from .q_temporal import GAPS
from .registry import question

C = roles.CONN
CD, CI = C + roles.DNS, C + roles.IDS
TWO_DAYS = 172_800_000_000
STEPS = ["lookup_us", "transfer_us", "spread_us", "alert_us"]


def episodes(spark, sf):
    """Per-step activity episodes of each host."""
    c = roles.conn(spark, sf).withColumnRenamed("orig_h", "host")

    def daily(df):
        return df.groupBy("host", floor_us(F.col("ts_us"), DAY).alias("slot")).agg(
            F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("n"), F.sum("orig_bytes").alias("b")
        )

    lookups = daily(c.where("resp_p = 53")).where("n >= 2")
    transfers = daily(c.where("resp_p = 443")).where("b > 10000")
    spread = daily(c.where("resp_p in (22, 445, 3389) and k < 60")).where("n >= 2")
    alerts = roles.ids(spark, sf).select(F.col("orig_h").alias("host"), F.col("ts_us").alias("first_us"), F.col("ts_us").alias("last_us")).distinct()
    return [df.select("host", "first_us", "last_us") for df in (lookups, transfers, spread, alerts)]


def _step(i, prev, cur):
    fields = ", ".join(f"c.{s}" for s in STEPS[:i])
    order = ", ".join(f"c.{s} DESC" for s in STEPS[:i])
    return f""", {cur} AS (SELECT host, {', '.join(STEPS[: i + 1])}, end_us FROM (
      SELECT s.host, {fields}, s.first_us AS {STEPS[i]}, s.last_us AS end_us, s.first_us - c.end_us AS gap,
        row_number() OVER (PARTITION BY s.host, s.first_us, s.last_us ORDER BY c.end_us DESC, {order}) AS rn
      FROM s{i} s JOIN {prev} c ON s.host = c.host AND c.end_us < s.first_us) WHERE rn = 1 AND gap <= {TWO_DAYS})
"""


SEQ = (
    CI
    + """, day AS (SELECT *, orig_h AS host, ts_us - ts_us % 86400000000 AS slot FROM conn),
  s0 AS (SELECT host, min(ts_us) AS first_us, max(ts_us) AS last_us FROM day WHERE resp_p = 53 GROUP BY host, slot HAVING count(*) >= 2),
  s1 AS (SELECT host, min(ts_us) AS first_us, max(ts_us) AS last_us FROM day WHERE resp_p = 443 GROUP BY host, slot HAVING sum(orig_bytes) > 10000),
  s2 AS (SELECT host, min(ts_us) AS first_us, max(ts_us) AS last_us FROM day WHERE resp_p IN (22, 445, 3389) AND k < 60 GROUP BY host, slot HAVING count(*) >= 2),
  s3 AS (SELECT DISTINCT orig_h AS host, ts_us AS first_us, ts_us AS last_us FROM ids),
  c0 AS (SELECT host, first_us AS lookup_us, last_us AS end_us FROM s0)
"""
    + _step(1, "c0", "c1")
    + _step(2, "c1", "c2")
    + _step(3, "c2", "c3")
    + "SELECT * FROM c3"
)


@question("c18_phase_sequence", SEQ)
def phase_sequence(spark, sf):
    return D.sequence(list(zip(STEPS, episodes(spark, sf))), TWO_DAYS)


@question("i10_sequence_state", SEQ)
def sequence_state(spark, sf):
    """The same chains found by a stream of episodes that come newest first."""
    every = [df.withColumn("step", F.lit(i)) for i, df in enumerate(episodes(spark, sf))]
    table = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    return drain(B.sequence_state(replay(table, "first_us"), STEPS, TWO_DAYS, delay="60 days"), "sequence")


@question(
    "c19_fail_then_success",
    C + """, a AS (SELECT line, orig_h AS account, ts_us, conn_state = 'SF' AS success,
      count(*) FILTER (WHERE conn_state <> 'SF') OVER (PARTITION BY orig_h ORDER BY ts_us RANGE BETWEEN 43200000000 PRECEDING AND 1 PRECEDING) AS failures FROM conn)
    SELECT line, account, failures FROM a WHERE success AND failures >= 2""",
)
def fail_then_success(spark, sf):
    auth = roles.conn(spark, sf).select("line", F.col("orig_h").alias("account"), "ts_us", (F.col("conn_state") == "SF").alias("success"))
    return D.fail_then_success(auth, 2, 43_200_000_000).select("line", "account", "failures")


# --- streams -------------------------------------------------------------------------------------


def backwards(spark, sf, read=roles.conn, delay="60 days"):
    """A source that arrives newest first, over several batches, with a mark of time at its end."""
    return replay(read(spark, sf)).withWatermark("event_time", delay)


def live(spark, sf, delay="1 day"):
    return S.with_event_time(roles.conn(spark, sf, roles.stream), delay)


@question("i1_follow_json", C + "SELECT uid, ts_us, orig_h, orig_bytes FROM conn")
def follow_json(spark, sf):
    """Connections land as JSON lines; a stream picks the files up and parses them."""
    path = scratch(spark, "landing")
    c = roles.conn(spark, sf)
    c.select(
        F.to_json(
            F.struct(
                (F.col("ts_us") / 1e6).alias("ts"), "uid", F.col("orig_h").alias("id.orig_h"), F.col("orig_p").alias("id.orig_p"),
                F.col("resp_h").alias("id.resp_h"), F.col("resp_p").alias("id.resp_p"), "proto", "orig_bytes",
            )
        )
    ).write.text(path)
    return drain(logs.follow_jsonl(spark, path, "conn")[0], "followed").select("uid", "ts_us", "orig_h", "orig_bytes")


@question("i1_follow_firewall", C + roles.FIREWALL + "SELECT parentuid, orig_h, resp_h, sentbyte, app FROM fw")
def follow_firewall(spark, sf):
    path = scratch(spark, "landing")
    roles.firewall_text(spark, sf).select("value").write.text(path)
    return drain(logs.follow_firewall(spark, path)[0], "followed").select("parentuid", "orig_h", "resp_h", "sentbyte", "app")


@question("i1_errors", """SELECT CASE WHEN doc_id % 2 = 0 THEN translate(text, chr(10) || chr(13), '  ') || '#' || doc_id
    ELSE '{"uid":"' || doc_id || '","note":"' || regexp_replace(text, '[^a-zA-Z ]', '', 'g') || '"}' END AS raw,
  CASE WHEN doc_id % 2 = 0 THEN 'malformed JSON' ELSE 'required field missing' END AS error FROM documents WHERE text IS NOT NULL""")
def follow_errors(spark, sf):
    """Lines that are no record go to a stream of their own: whole prose, and objects without a time, next to good records."""
    path = scratch(spark, "landing")
    docs = roles.table(spark, sf, "documents").where("text IS NOT NULL")
    uid = F.col("doc_id").cast("string")
    prose = F.concat(F.translate("text", "\n\r", "  "), F.lit("#"), uid)
    bare = F.to_json(F.struct(uid.alias("uid"), F.regexp_replace("text", "[^a-zA-Z ]", "").alias("note")))
    odd = docs.select(F.when(F.col("doc_id") % 2 == 0, prose).otherwise(bare).alias("value"))
    good = roles.conn(spark, sf).select(F.to_json(F.struct((F.col("ts_us") / 1e6).alias("ts"), "uid")).alias("value"))
    odd.unionByName(good).write.text(path)
    return drain(logs.follow_jsonl(spark, path, "conn")[1], "unparsed").select("raw", "error")


@question("i2_watermark", C + "SELECT line, ts_us FROM conn")
def watermark(spark, sf):
    return drain(live(spark, sf).select("line", F.unix_micros("event_time").alias("ts_us")), "marked")


@question("i3_late_records", C + """SELECT line, ts_us + (event_id * 7919000) % 900000000 AS receive_us, (event_id * 7919000) % 900000000 AS delay_us FROM conn WHERE (event_id * 7919000) % 900000000 > 600000000""")
def late_records(spark, sf):
    c = roles.conn(spark, sf).withColumn("receive_us", F.expr("ts_us + (event_id * 7919000) % 900000000"))
    return K.late_records(c, 600_000_000).select("line", "receive_us", "delay_us")


@question("i4_outbound_alerts", C + """SELECT orig_h, ts_us - ts_us % 900000000 AS window_us, CAST(sum(orig_bytes) AS BIGINT) AS bytes, count(*) AS conversations
  FROM conn GROUP BY ALL HAVING sum(orig_bytes) > 10000""")
def outbound_alerts(spark, sf):
    return drain(S.outbound_alerts(live(spark, sf), "15 minutes", 10_000), "outbound", "complete")


@question("i4_outbound_closed", C + """SELECT orig_h, ts_us - ts_us % 900000000 AS window_us, CAST(sum(orig_bytes) AS BIGINT) AS bytes, count(*) AS conversations
  FROM conn GROUP BY ALL HAVING sum(orig_bytes) > 10000""")
def outbound_closed(spark, sf):
    """Each window once, when the watermark has passed it; its state is gone then."""
    return drain(S.outbound_alerts(backwards(spark, sf), "15 minutes", 10_000), "outbound")


SESSIONS = C + """, g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w >= 1800000000 THEN 1 ELSE 0 END AS b
      FROM conn WINDOW w AS (PARTITION BY orig_h ORDER BY ts_us, line)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY orig_h ORDER BY ts_us, line) AS sid FROM g)
    SELECT orig_h, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n, CAST(sum(orig_bytes) AS BIGINT) AS bytes FROM s GROUP BY orig_h, sid"""

SLIDING = C + """, w AS (SELECT orig_h, resp_h, ts_us - ts_us % 43200000000 - s * 43200000000 AS window_us FROM conn, (SELECT unnest([0, 1]) AS s)
      WHERE resp_p IN (22, 445, 3389) AND k < 60)
    SELECT orig_h, window_us, count(DISTINCT resp_h) AS peers FROM w GROUP BY ALL HAVING count(DISTINCT resp_h) >= 2"""


@question("i5_fan_out_stream", SLIDING)
def fan_out_stream(spark, sf):
    return drain(S.fan_out_exact(backwards(spark, sf), "1 day", "12 hours", 2), "fan-out")


@question("i6_sessions_closed", SESSIONS)
def sessions_closed(spark, sf):
    return drain(S.sessions(backwards(spark, sf), "30 minutes"), "sessions-closed")


@question("i8_next_connection", NEXT_CONNECTION)
def next_connection(spark, sf):
    """Every answer with its next connection, both streams newest first."""
    return drain(B.next_connection(backwards(spark, sf, roles.dns), backwards(spark, sf), 604_800_000_000), "next")


@question("i5_sliding_fan_out", SLIDING)
def sliding_fan_out(spark, sf):
    return S.fan_out_sliding(roles.conn(spark, sf), "1 day", "12 hours", 2)


@question("i6_sessions", SESSIONS)
def sessions(spark, sf):
    return drain(S.sessions(live(spark, sf), "30 minutes"), "sessions", "complete")


@question("i7_records_once", C + "SELECT uid, line FROM conn")
def records_once(spark, sf):
    """The table arrives twice; each uid comes out once."""
    twice = roles.conn(spark, sf, roles.stream).unionByName(roles.conn(spark, sf, roles.stream))
    return drain(S.once(S.with_event_time(twice, "1 day")).select("uid", "line"), "once")


@question("i8_dns_then_conn", CD + """SELECT d.line AS dns_line, c.line AS conn_line, c.ts_us - d.ts_us AS gap_us FROM dns d JOIN conn c
  ON d.orig_h = c.orig_h AND d.answer = c.resp_h AND c.ts_us >= d.ts_us AND c.ts_us - d.ts_us <= 86400000000""")
def dns_then_conn(spark, sf):
    dns = S.with_event_time(roles.dns(spark, sf, roles.stream), "1 day")
    return drain(S.dns_then_conn(dns, live(spark, sf), "1 day"), "followed")


@question("i9_interval_state", C + GAPS + """SELECT orig_h, resp_p, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, count(gap) AS intervals,
  CAST(round(avg(gap)) AS BIGINT) AS mean_us, CAST(round(stddev_pop(gap) / 1000) AS BIGINT) AS sd_ms FROM d GROUP BY orig_h, resp_p""")
def interval_state(spark, sf):
    """The last word on each key, of records that come newest first."""
    updates = drain(B.interval_state(backwards(spark, sf), ["orig_h", "resp_p"]), "spacing", "update")
    return updates.where("closed").select(
        "orig_h", "resp_p", "n", "first_us", "last_us", "intervals",
        F.round("mean_us").cast("bigint").alias("mean_us"), F.round(F.col("sd_us") / 1000).cast("bigint").alias("sd_ms"),
    )


@question("i11_alert_sink", C + "SELECT line, resp_h FROM conn WHERE conn_state = 'S0'")
def alert_sink(spark, sf):
    return drain(roles.conn(spark, sf, roles.stream).where("conn_state = 'S0'").select("line", "resp_h"), "alerts")


@question("i12_enrich", C + "SELECT c.line, c.orig_h, a.device FROM conn c LEFT JOIN (SELECT orig_h, 'dev-' || max(line) AS device FROM conn WHERE event_type = 'signup' GROUP BY orig_h) a USING (orig_h)")
def enrich(spark, sf):
    assets = roles.conn(spark, sf).where("event_type = 'signup'").groupBy(F.col("orig_h").alias("ip")).agg(
        F.concat(F.lit("dev-"), F.max("line").cast("string")).alias("device")
    )
    return drain(S.enrich(live(spark, sf), assets).select("line", "orig_h", "device"), "enriched")


# --- governance ----------------------------------------------------------------------------------

NOW = 1_712_534_400_000_000


@question(
    "k1_retention",
    C + f"""SELECT line, event_type AS source, CASE WHEN {NOW} - ts_us < 7776000000000 THEN 'keep' WHEN event_type = 'error' THEN 'hold' ELSE 'due' END AS retention FROM conn""",
)
def retention(spark, sf):
    c = roles.conn(spark, sf).select("line", F.col("event_type").alias("source"), F.col("ts_us").alias("ingested_us"))
    holds = c.where("source = 'error'").groupBy("source").agg(F.max("ingested_us").alias("hold_from_us"))
    return K.retention(c, holds, NOW).select("line", "source", "retention")


@question("k2_custody", C + "SELECT line, 'F3' AS custody_source, CAST(1704067200000000 AS BIGINT) AS custody_collected_us, 'job-1' AS custody_job FROM conn")
def custody(spark, sf):
    return K.with_custody(roles.conn(spark, sf), "F3", 1_704_067_200_000_000, "00", "job-1").select(
        "line", "custody_source", "custody_collected_us", "custody_job"
    )


@question(
    "k3_coverage",
    C + """, n AS (SELECT event_type, ts_us - ts_us % 3600000000 AS slot_us, count(*) AS records FROM conn GROUP BY ALL),
    b AS (SELECT event_type, unnest(range(min(slot_us), max(slot_us) + 1, 3600000000)) AS slot_us FROM n GROUP BY event_type)
    SELECT event_type, slot_us, coalesce(records, 0) AS records, records IS NULL AS silent FROM b LEFT JOIN n USING (event_type, slot_us)""",
)
def coverage(spark, sf):
    return K.coverage(roles.conn(spark, sf), ["event_type"])


@question(
    "k4_claim_ledger",
    C + """, g AS (SELECT event_type, line, line - row_number() OVER (PARTITION BY event_type ORDER BY line) AS grp FROM conn),
    r AS (SELECT event_type, min(line) AS first_line, max(line) AS last_line FROM g GROUP BY event_type, grp)
    SELECT 'hosts show ' || event_type AS claim, CASE WHEN event_type = 'error' THEN 'hypothesis' ELSE 'confirmed' END AS status, 'conn' AS source, first_line, last_line
    FROM r UNION ALL SELECT 'hosts show transfer of ownership', 'rejected', 'conn', NULL, NULL""",
)
def claim_ledger(spark, sf):
    c = roles.conn(spark, sf)
    about = F.concat(F.lit("hosts show "), F.col("event_type"))
    claims = c.select("event_type").distinct().unionByName(c.select(F.lit("transfer of ownership").alias("event_type")).distinct()).select(
        about.alias("claim"), F.when(F.col("event_type") == "error", "hypothesis").otherwise("confirmed").alias("status"),
        F.lit("conn").alias("source"), F.lit("event_type").alias("fields"),
    )
    found = T.ranges(c.select("event_type", "line"), ["event_type"]).select(
        about.alias("claim"), F.lit("conn").alias("source"), "first_line", "last_line"
    )
    return K.claim_ledger(claims, found, strict=False).select("claim", "status", "source", "first_line", "last_line")


@question(
    "k6_claim_level",
    C + """SELECT orig_h, CAST(sum(orig_bytes) AS BIGINT) AS out_bytes, CASE WHEN count(*) FILTER (WHERE resp_pkts > 0) > 60 THEN 'observation'
      WHEN sum(orig_bytes) > 200000 THEN 'inference' ELSE 'unverified' END AS claim_level FROM conn GROUP BY orig_h""",
)
def claim_level(spark, sf):
    per_host = roles.conn(spark, sf).groupBy("orig_h").agg(F.sum("orig_bytes").alias("out_bytes"), F.count_if(F.col("resp_pkts") > 0).alias("answered"))
    return D.claim_level(per_host, F.col("answered") > 60, F.col("out_bytes") > 200_000).select("orig_h", "out_bytes", "claim_level")
