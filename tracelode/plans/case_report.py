"""The whole investigation of one host, or of all hosts, as a set of lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import decode, filters, joins, sets, temporal
from ..session import cut_lineage
from ..sources import logs, pcap, sinks


@dataclass
class Sources:
    """The six evidence sources in canonical form."""

    frames: DataFrame
    dns: DataFrame
    conn: DataFrame
    flow: DataFrame
    ids: DataFrame
    firewall: DataFrame

    def logs(self) -> dict[str, DataFrame]:
        return {"dns": self.dns, "conn": self.conn, "flow": self.flow, "ids": self.ids, "firewall": self.firewall}

    def of_host(self, host: str) -> "Sources":
        """Log records of one host. Frames stay whole; packets are cut after decoding."""
        return Sources(self.frames, **{n: filters.for_host(df, host) for n, df in self.logs().items()})


def open_case(spark: SparkSession, paths: dict[str, str], split_bytes: int = 64 << 20) -> Sources:
    """Read the six files or folders; keys are ``capture dns conn flow ids firewall``."""
    return Sources(
        frames=pcap.read_pcap(spark, paths["capture"], split_bytes),
        dns=logs.read_jsonl(spark, paths["dns"], "dns"),
        conn=logs.read_jsonl(spark, paths["conn"], "conn"),
        flow=logs.read_jsonl(spark, paths["flow"], "flow"),
        ids=logs.read_jsonl(spark, paths["ids"], "ids"),
        firewall=logs.read_firewall(spark, paths["firewall"]),
    )


def case_report(sources: Sources, host: str, work: bool = True) -> dict[str, DataFrame]:
    """Every table of the investigation of ``host``.

    With ``work`` the host's log records, packets and conversations are written once to the checkpoint
    folder and all tables read them from there: one pass over each log and the capture, and a
    lost executor costs no new one.
    """
    keep = cut_lineage if work else (lambda df: df)
    cut = sources.of_host(host)
    own = Sources(cut.frames, **{name: keep(df) for name, df in cut.logs().items()})
    packets = keep(filters.for_host(decode.decode(sources.frames), host, "src", "dst"))
    conv = keep(A.conversation_table(A.conversations(packets, host), own.conn))
    oriented = filters.orient(packets, host)
    messages = decode.decode_dns(packets)
    requests = decode.http_messages(packets)
    joined = {
        "dns": joins.join_dns_conn(own.dns, own.conn),
        "flow": joins.join_flow_conn(own.flow, own.conn),
        "firewall": joins.join_fw_conn(own.firewall, own.conn),
        "ids": joins.join_ids_conn(own.ids, own.conn),
    }
    cited = joins.join_ids_packet(own.ids, packets)
    named = conv.select(
        *joins.TUPLE, "first_us",
        F.col("out_payload_bytes").alias("orig_bytes"), F.col("in_payload_bytes").alias("resp_bytes"),
        F.col("out_packets").alias("orig_pkts"), F.col("in_packets").alias("resp_pkts"),
        F.col("out_ip_bytes").alias("orig_ip_bytes"), F.col("in_ip_bytes").alias("resp_ip_bytes"),
    )
    phases = A.phase_metrics(conv)
    errors = None
    for name, df in {**joined, "ids_packet": cited}.items():
        part = joins.unmatched(df).select(F.lit(name).alias("source"), "line", "verdict")
        errors = part if errors is None else errors.unionByName(part)
    tables = {
        "log_counts": A.log_counts(sources.logs(), host),
        "simulation_counts": A.value_counts(sources.firewall, "simulation"),
        "capture": A.capture_summary(sources.frames, host),
        "peers": A.peers(conv, host),
        "contacts": A.contact_matrix(conv),
        "flag_patterns": A.flag_patterns(packets),
        "handshakes": filters.handshake_state(oriented),
        "disagreements": joins.reconcile(named, own.conn),
        "dns_messages": messages,
        "http_requests": requests.drop("body"),
        "http": A.http_accounting(requests),
        "http_replies": joins.pair_http(packets),
        "payload_list": decode.payload_list(packets),
        "http_bodies": decode.body_bytes(requests),
        "payloads": A.payload_counts(packets.where((F.col("proto") == "tcp") & ~F.startswith("payload", F.lit(b"POST ")))),
        "join_errors": errors,
        "alerts_to_packets": cited,
        "port_groups": A.port_groups(own.conn),
        "port_peers": A.port_peers(own.conn),
        "port_lines": temporal.ranges(own.conn, ["resp_p"]),
        "states": A.states(own.conn),
        "signatures": A.signature_counts(own.ids),
        "alerts_per_conn": A.count_histogram(joined["ids"].where("verdict = 'matched'"), "conn_line"),
        "conversations": conv,
        "packet_index": decode.packet_index(packets),
        "phases": phases,
        "phase_gaps": temporal.phase_gaps(
            phases.select("phase", F.col("first_start_us").alias("first_us"), F.col("last_packet_us").alias("last_us")), []
        ),
        "phase_lines": temporal.ranges(conv.where("conn_line is not null"), ["phase"], "conn_line"),
        "totals": A.host_totals(conv, own.flow),
        "dns_values": A.distinct_values(own.dns, ["query", "answers", "rcode_name", "ttls"]),
        "label_conflicts": A.label_conflicts(own.firewall, conv),
        "bytes_by_destination": A.bytes_by_destination(conv),
        "evidence_matrix": joins.evidence_matrix(
            {
                "packets": conv.withColumn("bytes", F.col("out_payload_bytes")),
                "dns": own.dns,
                "conn": own.conn.withColumn("bytes", F.col("orig_bytes")),
                "flow": own.flow,
                "ids": own.ids,
                "firewall": own.firewall.withColumn("bytes", F.col("sentbyte")),
            }
        ),
        "events": sets.union_events(own.logs()),
        "sequential_scan": temporal.sequential_scan(own.conn, min_hosts=3),
    }
    for name, df in joined.items():
        tables[f"join_{name}"] = df
        tables[f"cardinality_{name}"] = joins.join_cardinality(df, own.conn)
    return tables


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as JSON documents, conversations and packets as quoted TSV. Nothing is overwritten."""
    for name, df in tables.items():
        if name in ("conversations", "packet_index"):
            sinks.write_tsv(df, f"{path}/{name}")
        else:
            sinks.write_metrics(df, f"{path}/{name}")
