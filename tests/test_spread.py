"""Rows are dealt to tasks by their number, and a payload's start is tested in one expression."""

from pyspark.sql import functions as F

from tracelode.functions import net
from tracelode.plans import roles

SF = "/root/testdata/sf0.001"


def test_more_rows_make_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(roles, "ROWS_PER_TASK", 10)
    c = roles.conn(spark, SF)
    sizes = [r["count"] for r in c.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 100 and max(sizes) < 40


def test_starts_with_any(spark):
    texts = [b"GET /", b"GET", b"", None, b"POST x", b"xPOST ", b"\xffGET ", b"HTTP/1.1", b"get /", b"PATCH \x80", b"\nGET "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, payload BINARY")
    wanted = ("HTTP/", *net.HTTP_METHODS)
    one = F.lit(False)
    for text in wanted:
        one = one | net.starts_with(F.col("payload"), text)
    got = rows.select("i", net.starts_with_any(F.col("payload"), wanted).alias("a"), one.alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(bool(r.a) for r in got) == 4
