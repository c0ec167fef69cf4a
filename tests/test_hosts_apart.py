"""Questions over packets next to their SQL where hosts have numbers that no octet holds and tuples come back: every host stays itself."""

import duckdb
import pytest

import __spark_entry__ as contract
from tracelode.operators import decode
from tracelode.plans import roles

SF = "/root/testdata/sf0.001"
NAMES = [
    "d3_capture_summary", "d4_conversations", "d8_phase_metrics", "d4_instances", "b4_orient_captures",
    "b13_instance_labels", "d4_instances_captures", "c8_reused_tuples", "d16_flag_patterns",
    "b13_label_conflicts",
]


@pytest.fixture(scope="module")
def colliding(tmp_path_factory):
    """The events, the same at the same time from hosts 256 networks on and 256 * 256 + 512 networks on, and again an hour later from the same hosts and ports."""
    folder, db = tmp_path_factory.mktemp("apart"), duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    db.execute(f"""COPY (SELECT event_id + i * 300000 AS event_id, (ts + to_hours(CASE i WHEN 3 THEN 1 ELSE 0 END))::TIMESTAMP AS ts,
      user_id + CASE i WHEN 1 THEN 64000 WHEN 2 THEN 250 * (65536 + 512) ELSE 0 END AS user_id, event_type, value, props
      FROM range(4) r(i), '{SF}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)""")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), db


@pytest.mark.parametrize("name", NAMES)
def test_next_to_sql(spark, colliding, name):
    folder, db = colliding
    df = contract.queries()[name](spark, folder)
    columns = ", ".join(df.columns)
    want = db.execute(f"SELECT {columns} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_hosts_keep_their_names(spark, colliding):
    packets = decode.decode(roles.frames(spark, colliding[0], own=True))
    hosts = roles.conn(spark, colliding[0]).select("orig_h").distinct()
    assert packets.where("dport < 1024").select("src").distinct().count() == hosts.count()
    assert roles.named(packets).where("dport < 1024").select("src").distinct().exceptAll(hosts).count() == 0


def test_reconcile_counters_and_start(spark, colliding):
    """The SQL of c8_reconcile states the six counters; the start of a conversation is a row of its own where a record of its tuple begins at another time."""
    folder, db = colliding
    rows = [tuple(r) for r in contract.queries()["c8_reconcile"](spark, folder).select("orig_h", "orig_p", "resp_h", "line", "field", "pcap", "log").collect()]
    counters = db.execute(f"SELECT orig_h, orig_p, resp_h, line, field, pcap, log FROM ({contract.oracle_sql()['c8_reconcile']})").fetchall()
    assert sorted(map(repr, (r for r in rows if r[4] != "ts"))) == sorted(map(repr, counters))
    starts = db.execute(f"""{roles.CONN} SELECT orig_h, orig_p, resp_h, line, 'ts' AS field, first_us, ts_us
      FROM (SELECT *, min(ts_us) OVER (PARTITION BY orig_h, orig_p, resp_h, resp_p, proto) AS first_us FROM conn) WHERE ts_us > first_us + 1""").fetchall()
    assert starts and sorted(map(repr, (r for r in rows if r[4] == "ts"))) == sorted(map(repr, starts))
