"""The state of a stream is kept by bucket, so calls and state rows do not grow with the number of keys."""

from pyspark.sql import functions as F

from test_streaming import SF, check_spacing, finished, marked, same
from tracelode.operators import joins
from tracelode.plans import roles
from tracelode.streaming import buffers


def test_interval_state_by_bucket(spark):
    conn, keys = roles.conn(spark, SF).cache(), ["orig_h", "resp_p"]
    rows, progress = finished(buffers.interval_state(marked(spark, conn, "60 days"), keys, buckets=3), "spacing", "update")
    check_spacing(rows.where("closed").collect(), conn, keys)
    # a run per batch, one table of summaries and one timer (kept in two indices) for each bucket
    assert 0 < max(o[0]["numRowsTotal"] for o in progress) <= 3 * 8 and progress[-1][0]["numRowsTotal"] == 0


def test_next_connection_by_bucket(spark):
    conn, within = roles.conn(spark, SF).cache(), 604_800_000_000
    asked = roles.dns(spark, SF).select("line", "ts_us", "orig_h", F.when(F.col("k") % 7 > 0, F.col("answer")).alias("answer"))
    got, progress = finished(
        buffers.next_connection(marked(spark, asked, "60 days"), marked(spark, conn, "60 days"), within, buckets=2), "next", "append"
    )
    assert same(joins.dns_to_conn(asked, conn, within).select(*got.columns), got)
    assert max(o[0]["numRowsTotal"] for o in progress) <= 2 * 8 and progress[-1][0]["numRowsTotal"] == 0
