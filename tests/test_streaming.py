"""Streams over several micro-batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from tracelode.operators import aggregates, detections, joins, ordered, temporal
from tracelode.plans import roles
from tracelode.streaming import buffers, detect
from tracelode.streaming.runtime import drain, replay, scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def conn(spark):
    return roles.conn(spark, SF).cache()


def arriving(spark, df, files=4, order="ts_us"):
    """The rows as a stream of ``files`` files in time order, one per micro-batch."""
    path = scratch(spark, "arriving")
    bounds = df.approxQuantile(order, [i / files for i in range(1, files)], 0.0)
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        part = df
        if low is not None:
            part = part.where(F.col(order) > low)
        if high is not None:
            part = part.where(F.col(order) <= high)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    columns = a.columns
    return a.exceptAll(b.select(*columns)).count() == 0 and b.select(*columns).exceptAll(a).count() == 0


def latest(updates, keys, by):
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*keys, "r.*")


def finished(stream, name, mode):
    """What a stream wrote, and what its last micro-batch says of its state."""
    out, state = scratch(stream.sparkSession, name), scratch(stream.sparkSession, f"{name}-state")
    query = (
        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
        .foreachBatch(detect.alert_sink(out)).start()
    )
    query.awaitTermination()
    done = stream.sparkSession.read.schema(stream.schema).parquet(out).select(*stream.columns)
    return done, [p["stateOperators"] for p in query.recentProgress]


def marked(spark, df, delay, ts="ts_us", **how):
    return replay(df, ts, **how).withWatermark("event_time", delay)


def check_spacing(rows, conn, keys):
    want = {tuple(r[k] for k in keys): r for r in ordered.interval_stats(conn, keys).collect()}
    assert len(rows) == len(want)
    for r in rows:
        w = want[tuple(r[k] for k in keys)]
        assert (r.n, r.first_us, r.last_us, r.intervals) == (w.n, w.first_us, w.last_us, w.intervals)
        if w.mean_us is not None:
            assert r.mean_us == pytest.approx(w.mean_us) and r.sd_us == pytest.approx(w.sd_us, abs=1.0)


def test_interval_state_newest_first(spark, conn):
    """Files in reverse order of time give what the batch operator gives, before and after the keys close."""
    keys = ["orig_h", "resp_p"]
    rows, progress = finished(buffers.interval_state(marked(spark, conn, "60 days"), keys), "spacing", "update")
    check_spacing(rows.where("closed").collect(), conn, keys)
    check_spacing(latest(rows.where("not closed"), keys, "n").collect(), conn, keys)
    assert max(o[0]["numRowsTotal"] for o in progress) > 0 and progress[-1][0]["numRowsTotal"] == 0


def test_interval_state_settles_and_expires(spark, conn):
    """In order of time, with a short delay: rows settle while the stream runs, and silent keys are forgotten and begin anew."""
    keys = ["orig_h"]
    live = detect.with_event_time(arriving(spark, conn, 6), "1 hour")
    updates, _ = finished(buffers.interval_state(live, keys, 10**15), "spacing", "update")
    check_spacing(latest(updates, keys, "n").collect(), conn, keys)
    live = detect.with_event_time(arriving(spark, conn, 6), "1 hour")
    short, _ = finished(buffers.interval_state(live, ["resp_h"], 86_400_000_000), "spacing", "update")
    whole = {r.resp_h: r.n for r in ordered.interval_stats(conn, ["resp_h"]).collect()}
    shut = short.where("closed").collect()
    assert sum(r.n for r in shut) <= conn.count() and any(r.n < whole[r.resp_h] for r in shut)


def test_rows_behind_the_watermark_never_mix_in(spark, conn):
    rows, progress = finished(buffers.interval_state(marked(spark, conn, "1 day"), ["orig_h"]), "late", "update")
    dropped = sum(o[0]["numRowsDroppedByWatermark"] for o in progress)
    assert dropped > 0 and rows.where("closed").agg(F.sum("n")).first()[0] == conn.count() - dropped


@pytest.mark.parametrize("backwards", [True, False])
def test_sequence_state(spark, conn, backwards):
    host = conn.withColumnRenamed("orig_h", "host")
    steps = ["a_us", "b_us", "c_us"]
    parts = [
        host.where(F.col("resp_p") == port).select("host", F.col("ts_us").alias("first_us"), (F.col("ts_us") + 1000).alias("last_us"))
        for port in (53, 443, 22)
    ]
    both = parts[0].withColumn("step", F.lit(0))
    for i in (1, 2):
        both = both.unionByName(parts[i].withColumn("step", F.lit(i)))
    within = 86_400_000_000
    if backwards:
        stream, delay = replay(both, "first_us"), "60 days"
    else:
        end = spark.range(1).select(F.lit(None).cast("string").alias("host"), F.lit(4 * 10**15).alias("first_us"), F.lit(4 * 10**15).alias("last_us"), F.lit(0).alias("step"))
        stream, delay = arriving(spark, both.unionByName(end), 4, "first_us"), "1 hour"
    got, progress = finished(buffers.sequence_state(stream, steps, within, delay=delay), "chain", "append")
    want = detections.sequence(list(zip(steps, parts)), within)
    assert want.count() > 0 and same(want, got)
    assert progress[-1][0]["numRowsTotal"] <= (0 if backwards else 8)


def test_next_connection(spark, conn):
    """Each answer once, with its next connection or without; ties and repeated answers included."""
    dns = roles.dns(spark, SF)
    twice = dns.unionByName(dns.select(*[(F.col(c) + 1_000_000).alias(c) if c in ("line", "ts_us") else F.col(c) for c in dns.columns]))
    at_once = conn.limit(40).select((F.col("line") + 5_000_000).alias("line"), "ts_us", "orig_h", F.col("resp_h").alias("answer"))
    asked = twice.select("line", "ts_us", "orig_h", "answer").unionByName(at_once)
    unknown = spark.createDataFrame([(9_000_001, 1_705_000_000_000_000, None, "1.2.3.4"), (9_000_002, 1_705_000_000_000_000, "10.20.0.1", None)], asked.schema)
    asked, within = asked.unionByName(unknown), 604_800_000_000
    got, progress = finished(
        buffers.next_connection(marked(spark, asked, "60 days"), marked(spark, conn, "60 days"), within), "next", "append"
    )
    want = joins.dns_to_conn(asked, conn, within).select(*got.columns)
    assert want.where("conn_line is not null").count() > 0 and same(want, got)
    assert progress[-1][0]["numRowsTotal"] == 0


def test_exact_fan_out_in_append_mode(spark, conn):
    got, progress = finished(detect.fan_out_exact(marked(spark, conn, "60 days"), "1 day", "12 hours", 2), "fan", "append")
    assert got.count() > 0 and same(detect.fan_out_sliding(conn, "1 day", "12 hours", 2), got)
    assert max(o["numRowsTotal"] for o in progress[-2]) > 0


def test_outbound_alerts(spark, conn):
    live = detect.with_event_time(arriving(spark, conn), "1 day")
    got = drain(detect.outbound_alerts(live, "15 minutes", 5_000), "outbound", "complete")
    assert same(aggregates.outbound_over(conn, 900_000_000, 5_000), got)


def test_append_mode_emits_closed_windows(spark, conn):
    live = detect.with_event_time(arriving(spark, conn), "1 hour")
    got = drain(detect.outbound_alerts(live, "15 minutes", 5_000), "closed")
    want = aggregates.outbound_over(conn, 900_000_000, 5_000)
    last = conn.agg(F.max("ts_us")).first()[0]
    assert got.count() > 0 and got.exceptAll(want.select(*got.columns)).count() == 0
    missed = want.select(*got.columns).exceptAll(got)
    assert missed.where(F.col("window_us") + 900_000_000 <= last - 3_600_000_000).count() == 0


def test_sliding_fan_out(spark, conn):
    live = detect.with_event_time(arriving(spark, conn), "1 day")
    got = drain(detect.fan_out_alerts(live, "1 day", "12 hours", 2), "fan", "complete")
    assert same(detect.fan_out_sliding(conn, "1 day", "12 hours", 2), got)


def test_sessions(spark, conn):
    live = detect.with_event_time(arriving(spark, conn), "1 day")
    got = drain(detect.sessions(live, "30 minutes"), "sessions", "complete")
    want = temporal.activity_sessions(conn, ["orig_h"], 1_800_000_000, {"bytes": F.col("orig_bytes")})
    assert same(want, got)


def test_records_once(spark, conn):
    twice = arriving(spark, conn.unionByName(conn))
    got = drain(detect.once(detect.with_event_time(twice, "1 day")).select("uid"), "once")
    assert got.count() == conn.count() == got.distinct().count()


def test_stream_join_and_outer(spark, conn):
    dns = roles.dns(spark, SF)
    d = detect.with_event_time(arriving(spark, dns), "1 hour")
    c = detect.with_event_time(arriving(spark, conn), "1 hour")
    got = drain(detect.dns_then_conn(d, c, "10 days"), "pairs")
    want = dns.alias("d").join(
        conn.alias("c"),
        F.expr("d.orig_h = c.orig_h and d.answer = c.resp_h and c.ts_us >= d.ts_us and c.ts_us - d.ts_us <= 864000000000"),
    ).select(F.col("d.line").alias("dns_line"), F.col("c.line").alias("conn_line"), F.expr("c.ts_us - d.ts_us").alias("gap_us"))
    assert want.count() > 0 and same(want, got)


def test_late_split_keeps_every_row(spark, conn):
    received = conn.withColumn("receive_us", F.expr("ts_us + (event_id * 7919000) % 900000000"))
    good, late, state = (scratch(spark, n) for n in ("good", "late", "split-state"))
    run = detect.split_late(detect.alert_sink(good), detect.alert_sink(late), 600_000_000)
    stream = arriving(spark, received)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    n_good, n_late = spark.read.parquet(good).count(), spark.read.parquet(late).count()
    assert n_late == received.where("receive_us - ts_us > 600000000").count() > 0
    assert n_good + n_late == conn.count()


def test_alert_sink_repeats_safely(spark, conn):
    path = scratch(spark, "again")
    write = detect.alert_sink(path)
    for _ in range(2):
        write(conn, 0)
    write(conn.limit(3), 1)
    assert spark.read.parquet(path).count() == conn.count() + 3


def test_enrich(spark, conn):
    assets = conn.groupBy(F.col("orig_h").alias("ip")).agg(F.max("uid").alias("device"))
    got = drain(detect.enrich(arriving(spark, conn), assets).select("line", "device"), "enriched")
    assert got.count() == conn.count() and got.where("device is null").count() == 0
