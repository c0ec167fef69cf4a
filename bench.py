"""Time headline questions on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

tables beforehand (not timed): at sf0.1 the connection log has the same 100,000 lines.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import functions as F  # noqa: E402

from tracelode.operators import decode  # noqa: E402
from tracelode.plans import catalog, q_sources, roles  # noqa: E402
from tracelode.session import cut_lineage, local_session  # noqa: E402
from tracelode.sources import archive, logs, pcap  # noqa: E402
from tracelode.streaming.runtime import scratch  # noqa: E402

HEADLINE = (
    "e1_interval_stats", "e2_beacons", "e6_line_ranges", "e7_sequential_scan", "e9_cumulative_bytes", "e10_timeline",
    "e11_activity_sessions", "e12_trailing_rate", "c1_dns_conn", "c2_flow_conn", "c3_firewall_conn", "c4_alert_conn",
    "c5_alert_packet", "c8_reconcile", "c10_asset_at_time", "c11_dns_then_conn", "c14_compare_copies", "c16_nearest_match",
    "c17_evidence_matrix", "c18_phase_sequence", "d4_conversations", "d7_port_groups", "d8_phase_metrics",
    "d10_bytes_by_destination", "d16_flag_patterns", "d23_outbound_over", "d26_fan_out", "d30_name_shape", "j1_dns_messages",
    "a1_capture_round_trip", "i9_interval_state",
)


def conn_json(spark, sf: str) -> str:
    """The connection log as JSON lines."""
    path = scratch(spark, "bench-conn")
    c = roles.conn(spark, sf)
    ends = {"id.orig_h": "orig_h", "id.orig_p": "orig_p", "id.resp_h": "resp_h", "id.resp_p": "resp_p"}
    fields = [
        (F.col("ts_us") / 1e6).alias("ts"), "uid", *[F.col(col).alias(name) for name, col in ends.items()], "proto",
        (F.col("duration_us") / 1e6).alias("duration"), "orig_bytes", "resp_bytes", "conn_state", F.lit("ShADdFf").alias("history"),
        "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
    ]
    c.select(F.to_json(F.struct(*fields)).alias("value")).write.text(path)
    return path


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    log, captures = conn_json(spark, sf), q_sources._captures(spark, sf)
    index = cut_lineage(pcap.capture_index(spark, captures))
    packets = lambda: decode.decode(pcap.read_pcap(spark, captures))
    jobs = {
        "base_log_row_count": lambda: spark.read.text(log).agg(F.count(F.lit(1))),
        "base_log_parse_all": lambda: logs.read_jsonl(spark, log, "conn"),
        "base_read_one_line": lambda: logs.text_lines(spark, log).where("line = 1"),
        "base_capture_filter": lambda: decode.query_packets(packets(), "packet = 1", 10, 0),
        "base_capture_packet_by_number": lambda: decode.query_packets(
            decode.decode(pcap.read_pcap(spark, captures, index=index, packets=(1, 1))), "packet = 1", 10, 0
        ),
        "base_sha256_capture": lambda: archive.file_inventory(spark, captures),
    }
    questions = catalog.questions()
    jobs.update({name: (lambda fn=questions[name]: fn(spark, sf)) for name in HEADLINE})
    run(questions["d13_states"](spark, sf))  # start the JVM's compilers and the Python workers' parent
    times = {}
    for name, make in jobs.items():
        began = time.perf_counter()
        run(make())
        times[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([\d.]+)", sf)
    print(
        json.dumps(
            {
                "metric": "headline_questions_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": float(scale.group(1)) if scale else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
