"""Frames are built and decoded once before connections are numbered."""

from tracelode.plans import q_instances

SF = "/root/testdata/sf0.001"


def test_numbering_reads_decoded_packets(spark):
    df = q_instances.numbered(spark, SF, 3)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and df.count() == 2000
