"""Questions about order and time."""

from pyspark.sql import functions as F

from ..operators import temporal as T
from ..operators.ordered import interval_stats
from . import roles
from .registry import question

C = roles.CONN
HALF_HOUR = 1_800_000_000


def spacing(spark, sf):
    c = roles.conn(spark, sf)
    keys = ["orig_h", "resp_p"]
    sums = c.groupBy(*keys).agg(F.sum("orig_bytes").alias("bytes"))
    stats = interval_stats(c, keys)
    return stats.join(sums, keys).select(
        *keys,
        "n",
        "bytes",
        "first_us",
        "last_us",
        "intervals",
        F.round("mean_us").cast("bigint").alias("mean_us"),
        F.round(F.col("sd_us") / 1000).cast("bigint").alias("sd_ms"),
    )


GAPS = """, d AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY orig_h, resp_p ORDER BY ts_us, line) AS gap FROM conn)
"""

question(
    "e1_interval_stats",
    C + GAPS + """SELECT orig_h, resp_p, count(*) AS n, CAST(sum(orig_bytes) AS BIGINT) AS bytes, min(ts_us) AS first_us,
      max(ts_us) AS last_us, count(gap) AS intervals, CAST(round(avg(gap)) AS BIGINT) AS mean_us,
      CAST(round(stddev_pop(gap) / 1000) AS BIGINT) AS sd_ms
    FROM d GROUP BY orig_h, resp_p""",
)(spacing)


@question(
    "e2_beacons",
    C + GAPS + """SELECT orig_h, resp_p, count(gap) AS intervals, CAST(round(avg(gap)) AS BIGINT) AS mean_us,
      round(stddev_pop(gap) / avg(gap), 6) AS cv, CAST(max(orig_bytes) AS BIGINT) AS max_bytes
    FROM d GROUP BY orig_h, resp_p
    HAVING count(gap) >= 5 AND stddev_pop(gap) / avg(gap) <= 0.9 AND max(orig_bytes) <= 20000""",
)
def beacons(spark, sf):
    return T.beacons(
        roles.conn(spark, sf), ["orig_h", "resp_p"], min_intervals=5, max_cv=0.9, max_bytes=20000
    ).select(
        "orig_h", "resp_p", "intervals", F.round("mean_us").cast("bigint").alias("mean_us"),
        F.round("cv", 6).alias("cv"), "max_bytes",
    )


@question(
    "e3_locators",
    C + """SELECT orig_h, resp_p, min(line) AS first_line, max(line) AS last_line, min(ts_us) AS first_us,
      max(ts_us) AS last_us, arg_min(uid, line) AS first_uid, arg_max(uid, line) AS last_uid
    FROM conn GROUP BY orig_h, resp_p""",
)
def locators(spark, sf):
    return T.locators(roles.conn(spark, sf), ["orig_h", "resp_p"])


@question(
    "e4_spans",
    C + """SELECT orig_h, max(ts_us) - min(ts_us) AS start_span_us, max(ts_us + duration_us) - min(ts_us) AS packet_span_us
    FROM conn GROUP BY orig_h""",
)
def spans(spark, sf):
    return T.spans(
        roles.conn(spark, sf).withColumn("last_us", F.expr("ts_us + duration_us")), ["orig_h"], "ts_us", "last_us"
    )


@question(
    "e5_phase_gaps",
    C + """, p AS (SELECT orig_h, event_type AS phase, min(ts_us) AS first_us, max(ts_us + duration_us) AS last_us
      FROM conn GROUP BY ALL)
    SELECT orig_h, phase, lag(phase) OVER w AS previous_phase, first_us - lag(last_us) OVER w AS gap_us
    FROM p WINDOW w AS (PARTITION BY orig_h ORDER BY first_us, phase)""",
)
def phase_gaps(spark, sf):
    c = roles.conn(spark, sf)
    phases = c.groupBy("orig_h", F.col("event_type").alias("phase")).agg(
        F.min("ts_us").alias("first_us"), F.max(F.expr("ts_us + duration_us")).alias("last_us")
    )
    return T.phase_gaps(phases, ["orig_h"])


@question(
    "e6_line_ranges",
    C + """, g AS (SELECT resp_p, line, line - row_number() OVER (PARTITION BY resp_p ORDER BY line) AS grp FROM conn)
    SELECT resp_p, min(line) AS first_line, max(line) AS last_line, count(*) AS lines FROM g GROUP BY resp_p, grp""",
)
def line_ranges(spark, sf):
    return T.ranges(roles.conn(spark, sf), ["resp_p"])


@question(
    "e7_sequential_scan",
    C + """, a AS (SELECT orig_h, ts_us, line, k, resp_p, lag(k) OVER w AS pk, lag(resp_p) OVER w AS pp
      FROM (SELECT *, CASE WHEN k < 60 THEN k ELSE k + 1000000 END AS n FROM conn) WINDOW w AS (PARTITION BY orig_h ORDER BY ts_us, line)),
    b AS (SELECT *, sum(CASE WHEN pk IS NOT NULL AND k = pk + 1 AND (k < 60) = (pk < 60) THEN 0 ELSE 1 END)
      OVER (PARTITION BY orig_h ORDER BY ts_us, line) AS run FROM a)
    SELECT orig_h, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS hosts, count(DISTINCT resp_p) AS ports,
      CAST(count(*) FILTER (WHERE resp_p <> pp AND pk IS NOT NULL AND k = pk + 1 AND (k < 60) = (pk < 60)) AS BIGINT) AS port_changes
    FROM b GROUP BY orig_h, run HAVING count(*) >= 2""",
)
def sequential_scan(spark, sf):
    return T.sequential_scan(roles.conn(spark, sf), min_hosts=2)


@question(
    "e8_log_gaps",
    C + """, g AS (SELECT orig_h, ts_us, lead(ts_us) OVER (PARTITION BY orig_h ORDER BY ts_us) AS nxt FROM conn)
    SELECT orig_h, ts_us AS silent_from_us, nxt AS silent_to_us, nxt - ts_us AS gap_us FROM g WHERE nxt - ts_us > 43200000000""",
)
def log_gaps(spark, sf):
    return T.log_gaps(roles.conn(spark, sf), ["orig_h"], limit_us=43_200_000_000)


@question(
    "e9_cumulative_bytes",
    C + """SELECT line, orig_h, CAST(sum(orig_bytes) OVER (PARTITION BY orig_h ORDER BY ts_us, line
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_bytes FROM conn""",
)
def cumulative_bytes(spark, sf):
    return T.cumulative_bytes(roles.conn(spark, sf), ["orig_h"], "orig_bytes").select("line", "orig_h", "total_bytes")


@question(
    "e10_timeline",
    C + """SELECT row_number() OVER (ORDER BY ts_us, line) AS rank, line, ts_us, event_type AS phase,
      coalesce(lag(event_type) OVER (ORDER BY ts_us, line) <> event_type, TRUE) AS phase_change FROM conn""",
)
def timeline(spark, sf):
    c = roles.conn(spark, sf).withColumnRenamed("event_type", "phase")
    return T.timeline(c).select("rank", "line", "ts_us", "phase", "phase_change")


@question(
    "e11_activity_sessions",
    C + """, g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w >= 1800000000 THEN 1 ELSE 0 END AS b
      FROM conn WINDOW w AS (PARTITION BY orig_h ORDER BY ts_us, line)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY orig_h ORDER BY ts_us, line) AS sid FROM g)
    SELECT orig_h, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n, CAST(sum(orig_bytes) AS BIGINT) AS bytes
    FROM s GROUP BY orig_h, sid""",
)
def activity_sessions(spark, sf):
    return T.activity_sessions(roles.conn(spark, sf), ["orig_h"], HALF_HOUR, {"bytes": F.col("orig_bytes")})


@question(
    "e12_trailing_rate",
    C + """SELECT line, orig_h, count(*) OVER w AS events, CAST(sum(orig_bytes) OVER w AS BIGINT) AS bytes FROM conn
    WINDOW w AS (PARTITION BY orig_h ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""",
)
def trailing_rate(spark, sf):
    return T.rate(roles.conn(spark, sf), ["orig_h"], 3_600_000_000, "orig_bytes").select("line", "orig_h", "events", "bytes")


@question(
    "e13_duplicate_keys",
    C + """SELECT line, orig_h, resp_h, resp_p, count(*) OVER (PARTITION BY orig_h, resp_h, resp_p) AS copies,
      row_number() OVER (PARTITION BY orig_h, resp_h, resp_p ORDER BY line) AS ordinal
    FROM conn QUALIFY copies > 1""",
)
def duplicate_keys(spark, sf):
    return T.duplicates(roles.conn(spark, sf), ["orig_h", "resp_h", "resp_p"]).select(
        "line", "orig_h", "resp_h", "resp_p", "copies", "ordinal"
    )
