"""Counts and sums. Results are long tables: no operator collects a set per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from ..functions.binary import latin1, u8, u16
from ..functions.binary import ipv4_at
from ..functions.clock import DAY, floor_us
from ..functions.text import entropy_bits
from ..schemas import TUPLE
from . import decode, instances, ordered
from .filters import phase
from .ordered import join_null_safe
from .temporal import LINES

SUMS = (
    "out_payload_bytes", "in_payload_bytes", "out_ip_bytes", "in_ip_bytes", "out_packets", "in_packets",
)


# --- records and captures ------------------------------------------------------------------------


def log_counts(sources: Mapping[str, DataFrame], host: str) -> DataFrame:
    """Per source: all records, and those with the host as origin or as destination."""
    out = None
    for name, df in sources.items():
        row = df.agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if(F.col("orig_h") == host).alias("host_origin"),
            F.count_if(F.col("resp_h") == host).alias("host_destination"),
        ).select(F.lit(name).alias("source"), "records", "host_origin", "host_destination")
        out = row if out is None else out.unionByName(row)
    return out


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def capture_summary(frames: DataFrame, host: str) -> DataFrame:
    """All capture counters of a host in one pass over the frames."""
    frame, kind = F.col("frame"), F.col("packet_class")
    classed = decode.packet_class(frames)
    transport = kind.isin("tcp", "udp")
    ip = F.when(kind.isin("tcp", "udp", "other_protocol"), frame)
    ihl = u8(ip, 14).bitwiseAND(F.lit(15)).cast("int") * 4
    dport = u16(ip, F.lit(16) + ihl)
    tcp_flags = F.when(kind == "tcp", u8(ip, F.lit(27) + ihl))
    dns_query = (
        (kind == "udp")
        & (dport == 53)
        & (u16(ip, F.lit(18) + ihl) >= 20)
        & (u16(ip, F.lit(24) + ihl).bitwiseAND(F.lit(0x8000)) == 0)
    )
    rows = classed.select(
        "packet", "ts_us", "packet_class", "truncated",
        (transport & ((ipv4_at(ip, 26) == host) | (ipv4_at(ip, 30) == host))).alias("of_host"),
        (transport & (ipv4_at(ip, 26) == host)).alias("from_host"),
        net.is_syn(tcp_flags).alias("syn"),
        dns_query.alias("query"),
    )
    return rows.agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if("of_host").alias("host_packets"),
        F.count_if("from_host").alias("host_out_packets"),
        F.count_if(F.col("of_host") & ~F.col("from_host")).alias("host_in_packets"),
        F.count_if("syn").alias("syn_without_ack"),
        F.count_if("query").alias("dns_queries"),
        F.count_if("truncated").alias("truncated"),
        F.count_if(kind == "non_ipv4").alias("non_ipv4"),
        F.count_if(kind == "fragment").alias("fragments"),
        F.count_if(kind == "other_protocol").alias("other_protocol"),
        F.count_if(kind.isin("short", "bad_ip")).alias("bad_frames"),
        F.min(F.when(F.col("of_host"), F.col("ts_us"))).alias("host_first_us"),
        F.max(F.when(F.col("of_host"), F.col("ts_us"))).alias("host_last_us"),
    )


def _pair(packets: DataFrame) -> tuple[Column, Column, Column]:
    """Unordered endpoint pair of a packet, and whether the smaller end sent it."""
    here = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port"))
    there = F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    return F.least(here, there), F.greatest(here, there), here <= there


OBSERVABLE = ("http", "tls", "dns")


def conversations(packets: DataFrame, host: str | None = None) -> DataFrame:
    """Conversations with directional byte and packet counts, in one hash aggregation.

    Packets are grouped by the unordered endpoint pair and summed per sender; who opened the
    conversation is decided on the aggregated row. With ``host`` the host is the opener;
    otherwise the sender of the first SYN-without-ACK, or of the first packet. All aggregation
    buffers are fixed-width, so Spark hashes instead of sorting and combines before the shuffle.

    Packets with an ``error`` are left out. Packets that ``instances.number`` has numbered give one row, with its
    ``instance``, for each connection of a pair instead of one for the pair.
    """
    if "error" in packets.columns:
        packets = packets.where(F.col("error").isNull())
    instance = ["instance"] if "instance" in packets.columns else []
    if host is not None:
        packets = packets.where((F.col("src") == host) | (F.col("dst") == host))
    end_a, end_b, from_a = _pair(packets)
    rows = packets.select(
        end_a.alias("__a"),
        end_b.alias("__b"),
        "proto", *instance,
        from_a.alias("__from_a"),
        "packet", "ts_us", "payload_bytes", "ip_bytes",
        # Only flags derived from the payload travel, not the payload.
        net.starts_with(F.col("payload"), "POST ").alias("__post"),
        net.observe_protocol(F.col("payload"), F.col("proto"), F.col("sport"), F.col("dport")).alias("__seen"),
        net.is_syn(F.col("flags")).alias("__syn"),
    )
    packet = F.col("packet")
    # numbers of several captures overlap, so there time comes first
    places = ["ts_us", "packet"] if "file" in packets.columns else ["packet"]
    aggs = [
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.min("packet").alias("first_packet"),
        F.max("packet").alias("last_packet"),
        *[F.min(F.when(F.col("__seen") == p, packet)).alias(f"__first_{p}") for p in OBSERVABLE],
    ]
    for side, cond in (("a", F.col("__from_a")), ("b", ~F.col("__from_a"))):
        aggs += [
            F.sum(F.when(cond, F.col("payload_bytes")).otherwise(0)).alias(f"__payload_{side}"),
            F.sum(F.when(cond, F.col("ip_bytes")).otherwise(0)).alias(f"__ip_{side}"),
            F.count_if(cond).alias(f"__packets_{side}"),
            F.coalesce(F.bool_or(cond & F.col("__post")), F.lit(False)).alias(f"__post_{side}"),
            *[
                F.min(F.when(when, F.col(place))).alias(f"__{kind}_{place}_{side}")
                for kind, when in (("first", cond), ("syn", cond & F.col("__syn"))) for place in places
            ],
        ]
    grouped = rows.groupBy("__a", "__b", "proto", *instance).agg(*aggs)

    def earlier(kind: str) -> Column:
        """True when side a comes first, false when side b does, null when neither occurs."""
        a, b = (F.struct(*[F.col(f"__{kind}_{place}_{side}") for place in places]) for side in "ab")
        has_a, has_b = (F.col(f"__{kind}_packet_{side}").isNotNull() for side in "ab")
        return F.when(has_a & has_b, a < b).when(has_a, True).when(has_b, False)

    opened_by_a = F.coalesce(earlier("syn"), earlier("first")) if host is None else F.col("__a.ip") == host
    named = grouped.withColumn("__open_a", opened_by_a)

    def pick(first: str, second: str) -> Column:
        return F.when(F.col("__open_a"), F.col(first)).otherwise(F.col(second))

    first_seen_packet = F.least(*[F.col(f"__first_{p}") for p in OBSERVABLE])
    observed = F.lit(None).cast("string")
    for p in OBSERVABLE:
        observed = F.when(F.col(f"__first_{p}") == first_seen_packet, p).otherwise(observed)
    return named.select(
        pick("__a.ip", "__b.ip").alias("orig_h"),
        pick("__a.port", "__b.port").alias("orig_p"),
        pick("__b.ip", "__a.ip").alias("resp_h"),
        pick("__b.port", "__a.port").alias("resp_p"),
        "proto", *instance, "first_us", "last_us", "first_packet", "last_packet",
        pick("__payload_a", "__payload_b").alias("out_payload_bytes"),
        pick("__payload_b", "__payload_a").alias("in_payload_bytes"),
        pick("__ip_a", "__ip_b").alias("out_ip_bytes"),
        pick("__ip_b", "__ip_a").alias("in_ip_bytes"),
        pick("__packets_a", "__packets_b").alias("out_packets"),
        pick("__packets_b", "__packets_a").alias("in_packets"),
        pick("__post_a", "__post_b").alias("starts_post"),
        F.coalesce(observed, F.lit("not_established")).alias("observed_protocol"),
    )


def conversation_table(conv: DataFrame, conn: DataFrame) -> DataFrame:
    """Conversations with phase and the line of their connection record; numbered instances with the record in whose time they fall."""
    logged, keys = instances.lines(conn, ["line"], conv)
    return phase(conv).join(logged.withColumnRenamed("line", "conn_line"), keys, "left")


def label_conflicts(fw: DataFrame, conv: DataFrame) -> DataFrame:
    """Firewall records whose application label differs from what the payload shows."""
    labelled, keys = instances.lines(fw.where(F.col("app") != ""), [c for c in fw.columns if c not in TUPLE], conv)
    seen = conv.where("observed_protocol <> 'not_established'").select(*keys, "observed_protocol")
    return (
        labelled.join(seen, keys)
        .where(F.lower("app") != F.col("observed_protocol"))
        .withColumnRenamed("app", "label")
    )


# --- contacts ------------------------------------------------------------------------------------


def peers(conv: DataFrame, host: str | None = None) -> DataFrame:
    """Each host's peers from either side, with the number of conversations."""
    ends = F.array(
        F.struct(F.col("orig_h").alias("host"), F.col("resp_h").alias("peer")),
        F.struct(F.col("resp_h").alias("host"), F.col("orig_h").alias("peer")),
    )
    rows = conv.select(F.explode(ends).alias("e")).select("e.*")
    if host is not None:
        rows = rows.where(F.col("host") == host)
    return rows.groupBy("host", "peer").agg(F.count(F.lit(1)).alias("conversations"))


def contact_matrix(conv: DataFrame) -> DataFrame:
    """Who contacted whom, on which service, and whether replies came back."""
    return conv.groupBy("orig_h", "resp_h", "resp_p", "proto").agg(
        F.count(F.lit(1)).alias("conversations"),
        F.count_if(F.col("in_packets") > 0).alias("replied"),
        F.bool_or(F.col("in_payload_bytes") > 0).alias("reply_data_seen"),
    )


def port_groups(conn: DataFrame, keys: Sequence[str] = ("resp_p",)) -> DataFrame:
    """Per service port: connections, distinct peers, byte sums and start-time statistics."""
    keys = list(keys)
    per_peer = conn.groupBy(*keys, "resp_h").agg(
        F.count(F.lit(1)).alias("c"), F.sum("orig_bytes").alias("o"), F.sum("resp_bytes").alias("r")
    )
    sums = per_peer.groupBy(*keys).agg(
        F.sum("c").alias("connections"),
        F.count("resp_h").alias("peers"),
        F.sum("o").alias("orig_bytes"),
        F.sum("r").alias("resp_bytes"),
    )
    return join_null_safe(sums, ordered.interval_stats(conn, keys).drop("n"), keys)


def port_peers(conn: DataFrame) -> DataFrame:
    """Peers of each port with their numeric address for ordering."""
    return conn.groupBy("resp_p", "resp_h").agg(F.count(F.lit(1)).alias("connections")).withColumn(
        "ip_num", net.ip_num(F.col("resp_h"))
    )


def phase_metrics(conv: DataFrame, keys: Sequence[str] = ("phase",)) -> DataFrame:
    """Per phase: conversations, peers, bounds, spans, spacing of starts, locators and sums."""
    keys = list(keys)
    per_peer = conv.groupBy(*keys, "resp_h").agg(
        F.count(F.lit(1)).alias("c"),
        F.max("last_us").alias("last_packet_us"),
        F.min("first_packet").alias("first_packet"),
        F.max("last_packet").alias("last_packet"),
        *[F.sum(s).alias(s) for s in SUMS],
    )
    sums = per_peer.groupBy(*keys).agg(
        F.sum("c").alias("conversations"),
        F.count("resp_h").alias("peers"),
        F.max("last_packet_us").alias("last_packet_us"),
        F.min("first_packet").alias("first_packet"),
        F.max("last_packet").alias("last_packet"),
        *[F.sum(s).alias(s) for s in SUMS],
    )
    spacing = ordered.interval_stats(conv, keys, "first_us").select(
        *keys,
        F.col("first_us").alias("first_start_us"),
        F.col("last_us").alias("last_start_us"),
        "intervals", "mean_us", "sd_us",
    )
    return join_null_safe(sums, spacing, keys).select(
        "*",
        (F.col("last_start_us") - F.col("first_start_us")).alias("start_span_us"),
        (F.col("last_packet_us") - F.col("first_start_us")).alias("packet_span_us"),
    )


def host_totals(conv: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """Totals over all conversations, with the flow log's own byte total beside them."""
    totals = conv.agg(*[F.sum(s).alias(s) for s in SUMS])
    if flow is None:
        return totals
    return totals.select("*", flow.agg(F.sum("bytes")).scalar().alias("flow_bytes"))


def bytes_by_destination(conv: DataFrame, internal: Sequence[str] = net.PRIVATE, size: str = "out_payload_bytes") -> DataFrame:
    """Bytes per zone and destination with subtotals; total outbound is not external outbound."""
    zoned = conv.withColumn("zone", net.zone(F.col("resp_h"), internal))
    return zoned.rollup("zone", "resp_h").agg(
        F.sum(size).alias("bytes"),
        F.count(F.lit(1)).alias("conversations"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def byte_units(df: DataFrame, units: Mapping[str, Column]) -> DataFrame:
    """Totals in long form, one row per unit, so that different units are never added up."""
    sums = df.agg(*[F.sum(expr).alias(name) for name, expr in units.items()])
    return sums.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("unit"), F.col(n).cast("bigint").alias("bytes")) for n in units])).alias("u")
    ).select("u.*")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns as (field, value) from one scan; array columns are exploded."""
    kinds = dict(df.dtypes)

    def named(name: str) -> Column:
        values = F.col(name) if kinds[name].startswith("array") else F.array(name)
        given = F.coalesce(values.cast("array<string>"), F.array())
        return F.transform(given, lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))

    return df.select(F.explode(F.concat(*map(named, columns))).alias("x")).select("x.*").where("value is not null").distinct()


def states(conn: DataFrame, keys: Sequence[str] = ("resp_p",)) -> DataFrame:
    return conn.groupBy(*keys, "conn_state").agg(F.count(F.lit(1)).alias("connections"))


def states_wide(conn: DataFrame, values: Sequence[str], keys: Sequence[str] = ("resp_p",)) -> DataFrame:
    return conn.groupBy(*keys).agg(*[F.count_if(F.col("conn_state") == v).alias(v.lower()) for v in values])


def signature_counts(ids: DataFrame) -> DataFrame:
    return ids.groupBy("signature_id").agg(F.count(F.lit(1)).alias("alerts"))


def count_histogram(matched: DataFrame, key: str) -> DataFrame:
    """How many keys have k rows."""
    per_key = matched.groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    return per_key.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def flag_pattern_runs(packets: DataFrame, chunk: int = LINES) -> DataFrame:
    """The ordered TCP flags of conversations as a long table: one row per run of equal flags of each distinct pattern.

    Columns ``pattern`` (128 bits that name it), ``packets``, ``conversations`` that show it, and of the run ``position`` (from 1),
    ``flags`` and ``n``. Patterns are compared by sums of hashes of (position, flags, length) over a conversation's runs, which
    combine before the shuffle; only one conversation of each pattern hands on its runs, and no row grows with a conversation.
    Each connection of packets that ``instances.number`` has numbered is a conversation of its own.
    """
    end_a, end_b, _ = _pair(packets)
    instance = ["instance"] if "instance" in packets.columns else []
    pair = ["__a", "__b", *instance]
    rows = packets.where(F.col("proto") == "tcp").select(end_a.alias("__a"), end_b.alias("__b"), *instance, "packet", "flags")
    hot = ordered.hot_keys(rows, pair)
    placed = ordered.running_totals(rows, pair, "packet", {"position": F.lit(1).cast("bigint")}, (), chunk, hot=hot)
    # without hot conversations there are no hot (conversation, flags) either
    same = ordered.islands(placed, [*pair, "flags"], "position", 2, chunk=chunk, hot=ordered.ASK if hot else hot)
    word = lambda salt: F.xxhash64(F.lit(salt), "start", "flags", "n").cast("decimal(38,0)")
    per_conv = same.groupBy(*pair).agg(F.sum("n").alias("packets"), F.sum(word(1)).alias("__x"), F.sum(word(2)).alias("__y"))
    name = F.md5(F.concat_ws("/", F.col("__x").cast("string"), F.col("__y").cast("string")))
    patterns = per_conv.groupBy("packets", name.alias("pattern")).agg(
        F.count(F.lit(1)).alias("conversations"), F.min(F.struct(*pair)).alias("__one")
    )
    shown = patterns.select("pattern", "packets", "conversations", "__one.*")
    runs = join_null_safe(shown, same.select(*pair, F.col("start").alias("position"), "flags", "n"), pair, "inner")
    return runs.select("pattern", "packets", "conversations", "position", "flags", "n")


def flag_patterns(packets: DataFrame, chunk: int = LINES) -> DataFrame:
    """Histogram of the ordered TCP flags of conversations, in full.

    From four equal flags in a row on a run is written once, as ``24x296``. The text of a distinct pattern is one row; where
    conversations change flags millions of times ``flag_pattern_runs`` has the same without it.
    """
    flags = F.col("flags").cast("string")
    text = F.when(F.col("n") > 3, F.concat(flags, F.lit("x"), F.col("n").cast("string"))).otherwise(
        F.array_join(F.array_repeat(flags, F.least("n", F.lit(3)).cast("int")), ", ")
    )
    runs = F.array_sort(F.collect_list(F.struct("position", text.alias("text"))))
    whole = flag_pattern_runs(packets, chunk).groupBy("pattern", "packets", "conversations").agg(runs.alias("__runs"))
    pattern = F.concat(F.lit("["), F.array_join(F.col("__runs.text"), ", "), F.lit("]"))
    return whole.select("packets", pattern.alias("pattern"), "conversations")


def payload_counts(packets: DataFrame) -> DataFrame:
    """Histogram of payload texts. Long texts are grouped by hash first, so the shuffle stays small."""
    texts = packets.where(F.col("payload_bytes") > 0)
    digest = F.sha2(F.col("payload"), 256)
    return (
        texts.groupBy(digest.alias("__h"))
        .agg(F.count(F.lit(1)).alias("n"), F.first(latin1(F.col("payload"))).alias("text"))
        .drop("__h")
    )


def http_accounting(requests: DataFrame) -> DataFrame:
    """Header and body bytes of requests, and whether they add up."""
    return requests.agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("payload_bytes").alias("payload_bytes"),
        F.sum("header_bytes").alias("header_bytes"),
        F.sum("body_bytes").alias("body_bytes"),
        F.bool_and(F.col("payload_bytes") == F.col("header_bytes") + F.col("body_bytes")).alias("adds_up"),
        F.bool_and("length_agrees").alias("lengths_agree"),
    )


def all_of(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row of all-true checks; a null counts as false."""
    return df.agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])


def unit_counts(units: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of different units side by side; they are not the same thing."""
    out = None
    for name, df in units.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("unit"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# --- detections on volume, names and spread ------------------------------------------------------


def name_prevalence(dns: DataFrame, max_hosts: int | None = None) -> DataFrame:
    """Distinct hosts that asked for each name. ``max_hosts=1`` keeps names of a single host."""
    per_host = dns.groupBy(F.lower("query").alias("name"), "orig_h").agg(F.count(F.lit(1)).alias("c"))
    out = per_host.groupBy("name").agg(F.count(F.lit(1)).alias("hosts"), F.sum("c").alias("queries"))
    return out if max_hosts is None else out.where(F.col("hosts") <= max_hosts)


def outbound_over(conv: DataFrame, width_us: int, limit: int, size: str = "orig_bytes", ts: str = "ts_us") -> DataFrame:
    """Hosts whose outbound bytes in a fixed window exceed a limit."""
    return (
        conv.groupBy("orig_h", floor_us(F.col(ts), width_us).alias("window_us"))
        .agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("conversations"))
        .where(F.col("bytes") > limit)
    )


def outbound_vs_baseline(conv: DataFrame, days: int, size: str = "orig_bytes", ts: str = "ts_us") -> DataFrame:
    """Each host's daily outbound bytes against the ``days`` days before, as a z-score.

    Days without traffic are not rows; the frame is by calendar day. One row per host and day
    enters the window.
    """
    daily = conv.groupBy("orig_h", floor_us(F.col(ts), DAY).alias("day_us")).agg(F.sum(size).alias("bytes"))
    past = Window.partitionBy("orig_h").orderBy("day_us").rangeBetween(-days * DAY, -DAY)
    scored = daily.select(
        "*",
        F.count("bytes").over(past).alias("baseline_days"),
        F.avg("bytes").over(past).alias("baseline_mean"),
        F.stddev_pop("bytes").over(past).alias("baseline_sd"),
    )
    z = (F.col("bytes") - F.col("baseline_mean")) / F.nullif(F.col("baseline_sd"), F.lit(0.0))
    return scored.withColumn("z", z)


def byte_ratio(conv: DataFrame, out: str = "orig_bytes", back: str = "resp_bytes") -> DataFrame:
    """Outbound over inbound bytes per host; null when nothing came back."""
    sums = conv.groupBy("orig_h").agg(F.sum(out).alias("out_bytes"), F.sum(back).alias("in_bytes"))
    return sums.withColumn("ratio", F.col("out_bytes") / F.nullif(F.col("in_bytes"), F.lit(0)))


# SSH, SMB and RDP.
REMOTE_PORTS = (22, 445, 3389)


def fan_out(
    conn: DataFrame, width_us: int, min_peers: int, ports: Sequence[int] = REMOTE_PORTS, internal: Sequence[str] = net.PRIVATE
) -> DataFrame:
    """Distinct internal peers a host reaches on remote services per window, and the growth."""
    remote = conn.where(F.col("resp_p").isin(*ports) & (net.zone(F.col("resp_h"), internal) == "internal"))
    pairs = remote.select("orig_h", floor_us(F.col("ts_us"), width_us).alias("window_us"), "resp_h").distinct()
    counts = pairs.groupBy("orig_h", "window_us").agg(F.count(F.lit(1)).alias("peers"))
    w = Window.partitionBy("orig_h").orderBy("window_us")
    grown = counts.withColumn("growth", F.col("peers") - F.lag("peers").over(w))
    return grown.where(F.col("peers") >= min_peers)


def account_spread(auth: DataFrame, min_hosts: int) -> DataFrame:
    """Accounts used on many hosts."""
    pairs = auth.groupBy("account", "host").agg(F.count(F.lit(1)).alias("c"))
    out = pairs.groupBy("account").agg(F.count(F.lit(1)).alias("hosts"), F.sum("c").alias("logons"))
    return out.where(F.col("hosts") >= min_hosts)


def first_seen(conn: DataFrame, since_us: int) -> DataFrame:
    """Destinations a host contacted for the first time at or after ``since_us``."""
    return (
        conn.groupBy("orig_h", "resp_h")
        .agg(F.min("ts_us").alias("first_us"), F.count(F.lit(1)).alias("connections"))
        .where(F.col("first_us") >= since_us)
    )


def top_talkers(conv: DataFrame, n: int, key: str = "orig_h", size: str = "orig_bytes") -> DataFrame:
    """The ``n`` keys with most bytes; ties by key."""
    return conv.groupBy(key).agg(F.sum(size).alias("bytes")).orderBy(F.desc("bytes"), key).limit(n)


def name_shape(dns: DataFrame, query: str = "query", parent_labels: int = 2) -> DataFrame:
    """Shape of each distinct name, and how many distinct names share its parent."""
    names = dns.select(F.lower(query).alias("name")).distinct()
    labels = F.split("name", r"\.")
    shaped = names.select(
        "name",
        F.size(labels).cast("bigint").alias("labels"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("bigint").alias("longest_label"),
        entropy_bits(F.col("name")).alias("entropy"),
        F.substring_index("name", ".", -parent_labels).alias("parent"),
    )
    per_parent = shaped.groupBy("parent").agg(F.count(F.lit(1)).alias("names_under_parent"))
    return shaped.join(per_parent, "parent")


def one_sided(flow: DataFrame, conv: DataFrame, replied: str = "resp_pkts") -> DataFrame:
    """Connections that were answered although no flow record runs in reverse."""
    answered = conv.where(F.col(replied) > 0)
    reverse = flow.select(
        F.col("resp_h").alias("orig_h"), F.col("resp_p").alias("orig_p"),
        F.col("orig_h").alias("resp_h"), F.col("orig_p").alias("resp_p"), "proto",
    ).distinct()
    return answered.join(reverse, TUPLE, "left_anti")


def reply_rate(conv: DataFrame, keys: Sequence[str] = ("resp_p",), reply: str = "resp_bytes") -> DataFrame:
    """Share of conversations in which reply data came back."""
    return conv.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("conversations"),
        F.count_if(F.col(reply) > 0).alias("replied"),
        F.avg((F.col(reply) > 0).cast("int")).alias("rate"),
    )
