"""Questions over packets next to their SQL where tuples come back and hosts have numbers that no octet holds."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
NAMES = [
    "a13_conversation_table", "a13_instance_table", "a14_packet_index", "a1_capture_round_trip", "a6_query_packets", "b10_dns_queries", "b11_handshake_state",
    "b12_phase", "b4_orient", "b5_decode_ip", "c20_pair_messages", "c20_payload_list", "c5_alert_captures", "c5_alert_packet",
]


@pytest.fixture(scope="module")
def colliding(tmp_path_factory):
    """The events, the same from hosts 256 networks on at the same time, and again an hour later from the same hosts and ports."""
    folder, db = tmp_path_factory.mktemp("colliding"), duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    db.execute(f"""COPY (SELECT event_id + i * 300000 AS event_id, (ts + to_hours(CASE i WHEN 2 THEN 1 ELSE 0 END))::TIMESTAMP AS ts,
      user_id + CASE i WHEN 1 THEN 64000 ELSE 0 END AS user_id, event_type, value, props
      FROM range(3) r(i), '{SF}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)""")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), db


@pytest.mark.parametrize("name", NAMES)
def test_next_to_sql(spark, colliding, name):
    folder, db = colliding
    df = contract.queries()[name](spark, folder)
    columns = ", ".join(df.columns)
    want = db.execute(f"SELECT {columns} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
