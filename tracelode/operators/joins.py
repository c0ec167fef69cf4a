"""Correlation of sources.

Joins report a verdict per source row instead of failing. Time tolerances are inclusive. Nearest
matches are found by sorting both sides together, never by forming pairs (see ``ordered.nearest``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..schemas import TUPLE
from . import decode, instances, ordered
from .integrity import row_print
from .ordered import CHUNK

# Inclusive tolerances in microseconds.
RECORD_TOLERANCE = 10_000
PACKET_TOLERANCE = 1


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi join that spreads rows with a null key.

    Missing identifiers are common in logs and would otherwise all hash to one task. They get a
    salt of their own; every row that can match has salt zero.
    """
    keys = list(keys)
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    salted = left.withColumn("__salt", F.when(missing, F.xxhash64(*left.columns)).otherwise(F.lit(0)))
    # Always zero, but not a literal, which the optimizer would fold out of the join keys.
    plain = right.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(1)))
    return salted.join(plain, [*keys, "__salt"], "left").select(
        *left.columns, *[c for c in right.columns if c not in keys]
    )


def _same_tuple(prefix: str) -> Column:
    same = F.lit(True)
    for col in TUPLE:
        same = same & (F.col(col) == F.col(f"{prefix}{col}"))
    return same


def _conn_locator(conn: DataFrame) -> list[str]:
    """What names the connection in a joined row: conn_line, and conn_file where connections have a file."""
    return [f"conn_{c}" for c in ordered.locator(conn)]


def _conn_by_uid(conn: DataFrame, extra: Sequence[str]) -> DataFrame:
    """One row per uid: the first connection with it, and how many there are."""
    held = F.struct(*ordered.locator(conn), "ts_us", *TUPLE, *extra)
    one = conn.where("uid is not null").groupBy("uid").agg(F.min(held).alias("c"), F.count(F.lit(1)).alias("conn_copies"))
    return one.select("uid", "conn_copies", *[F.col(f"c.{n}").alias(f"conn_{n}") for n in [*ordered.locator(conn), "ts_us", *TUPLE, *extra]])


def _record(df: DataFrame) -> Column:
    """The locator as one value that ``nearest`` can carry."""
    names = ordered.locator(df)
    return (F.struct(*names) if len(names) > 1 else F.col("line")).alias("line")


def join_dns_conn(dns: DataFrame, conn: DataFrame) -> DataFrame:
    """DNS record to its connection: same uid, same tuple, same time.

    A uid that several connections have is ``ambiguous`` and names the first of them.
    """
    joined = lookup(dns, _conn_by_uid(conn, []), ["uid"])
    verdict = (
        F.when(F.col("conn_line").isNull(), "no_conn")
        .when(F.col("conn_copies") > 1, "ambiguous")
        .when(~_same_tuple("conn_"), "tuple_differs")
        .when(F.col("ts_us") != F.col("conn_ts_us"), "time_differs")
        .otherwise("matched")
    )
    return joined.select(
        *ordered.locator(dns),
        "uid",
        *_conn_locator(conn),
        (F.col("ts_us") - F.col("conn_ts_us")).alias("delta_us"),
        verdict.alias("verdict"),
    )


def join_flow_conn(
    flow: DataFrame, conn: DataFrame, tol_us: int = RECORD_TOLERANCE, chunk: int = CHUNK
) -> DataFrame:
    """Flow record to its connection: same tuple, time within tolerance, same bytes and packets."""
    left = flow.select(*ordered.locator(flow), "ts_us", *TUPLE, "bytes", "packets")
    right = conn.select(
        _record(conn), "ts_us", *TUPLE, F.col("orig_bytes").alias("bytes"), F.col("orig_pkts").alias("packets")
    )
    found = ordered.nearest(left, right, [*TUPLE, "bytes", "packets"], tol_us, chunk=chunk)
    return _nearest_verdict(found, conn)


def join_ids_conn(
    ids: DataFrame, conn: DataFrame, tol_us: int = RECORD_TOLERANCE, chunk: int = CHUNK
) -> DataFrame:
    """Alert to its connection: same tuple, time within tolerance. Many alerts may share one."""
    found = ordered.nearest(
        ids.select(*ordered.locator(ids), "ts_us", *TUPLE), conn.select(_record(conn), "ts_us", *TUPLE), TUPLE, tol_us, chunk=chunk
    )
    return _nearest_verdict(found, conn)


def _nearest_verdict(found: DataFrame, conn: DataFrame) -> DataFrame:
    names = ordered.locator(conn)
    hit = [F.col(f"match_id.{n}").alias(f"conn_{n}") for n in names] if len(names) > 1 else [F.col("match_id").alias("conn_line")]
    return found.select(
        *ordered.locator(found),
        *hit,
        "delta_us",
        "ambiguous",
        F.when(F.col("match_id").isNull(), "unmatched").otherwise("matched").alias("verdict"),
    )


def join_fw_conn(fw: DataFrame, conn: DataFrame) -> DataFrame:
    """Firewall record to its connection by parent uid; tuple and both byte counters must agree.

    ``printed_time_matches`` is a separate check of the printed date and time against UTC.
    """
    joined = lookup(
        fw.withColumn("uid", F.col("parentuid")), _conn_by_uid(conn, ["orig_bytes", "resp_bytes"]), ["uid"]
    )
    verdict = (
        F.when(F.col("conn_line").isNull(), "no_conn")
        .when(F.col("conn_copies") > 1, "ambiguous")
        .when(~_same_tuple("conn_"), "tuple_differs")
        .when(
            (F.col("sentbyte") != F.col("conn_orig_bytes")) | (F.col("rcvdbyte") != F.col("conn_resp_bytes")),
            "bytes_differ",
        )
        .otherwise("matched")
    )
    return joined.select(
        *ordered.locator(fw),
        *_conn_locator(conn),
        verdict.alias("verdict"),
        clock.printed_equals(F.col("date"), F.col("time"), F.col("conn_ts_us")).alias("printed_time_matches"),
    )


def join_ids_packet(ids: DataFrame, packets: DataFrame, tol_us: int = PACKET_TOLERANCE) -> DataFrame:
    """Alert to the packet it cites: packet number, tuple in packet direction, time.

    Where packets name their ``file`` so does the result (``packet_file``). An alert that says which capture it means
    (``pcap_file``) meets that one's packet only; the number alone may stand in every capture, so then the capture that agrees
    best counts (the first by name among equals), and each alert still gives one row.
    """
    filed = "file" in packets.columns
    keys = ["pcap_file", "pcap_count"] if filed and "pcap_file" in ids.columns else ["pcap_count"]
    cited = packets.select(
        *([F.col("file").alias("pcap_file" if len(keys) == 2 else "packet_file")] if filed else []),
        F.col("packet").alias("pcap_count"),
        F.col("ts_us").alias("packet_ts_us"),
        F.col("src").alias("p_orig_h"),
        F.col("sport").alias("p_orig_p"),
        F.col("dst").alias("p_resp_h"),
        F.col("dport").alias("p_resp_p"),
        F.col("proto").alias("p_proto"),
    )
    joined = lookup(ids, cited, keys)
    verdict = (
        F.when(F.col("packet_ts_us").isNull(), "no_packet")
        .when(~_same_tuple("p_"), "tuple_differs")
        .when(F.abs(F.col("ts_us") - F.col("packet_ts_us")) > tol_us, "time_differs")
        .otherwise("matched")
    )
    if len(keys) == 2:
        joined = joined.withColumn("packet_file", F.when(F.col("packet_ts_us").isNotNull(), F.col("pcap_file")))
    named = [*ordered.locator(ids), "pcap_count"]
    out = joined.select(*named, *(["packet_file"] if filed else []), verdict.alias("verdict"))
    if not filed or len(keys) == 2:
        return out
    rank = F.array_position(F.lit(["matched", "time_differs", "tuple_differs", "no_packet"]), F.col("verdict"))
    best = F.min(F.struct(rank.alias("rank"), F.col("packet_file"), F.col("verdict"))).alias("best")
    return out.groupBy(*named).agg(best).select(*named, "best.packet_file", "best.verdict")


def unmatched(joined: DataFrame) -> DataFrame:
    """Join errors: source rows without a valid partner."""
    return joined.where(F.col("verdict") != "matched")


def _hits(conn: DataFrame, joined: DataFrame) -> tuple[DataFrame, list[str]]:
    names = [n for n in ordered.locator(conn) if f"conn_{n}" in joined.columns]
    hit = joined.where(F.col("verdict") == "matched").select(*[F.col(f"conn_{n}").alias(n) for n in names])
    return hit, names


def with_source(conn: DataFrame, joined: DataFrame) -> DataFrame:
    """Connections that have evidence in the joined source."""
    hit, names = _hits(conn, joined)
    return conn.join(hit, names, "left_semi")


def without_source(conn: DataFrame, joined: DataFrame) -> DataFrame:
    hit, names = _hits(conn, joined)
    return conn.join(hit, names, "left_anti")


COUNTERS = ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes")


def reconcile(conv: DataFrame, conn: DataFrame, tol_us: int = PACKET_TOLERANCE) -> DataFrame:
    """Fields on which the capture and the connection log disagree, one row per field.

    ``conv`` carries the counters under the log's names and ``first_us``. A conversation without a
    record gives one row with field ``no conn record``. Where ``conv`` has instances of reused tuples (and ``last_us``), each meets the
    records of its own time.
    """
    logged, keys = instances.lines(conn, ["line", "ts_us", *COUNTERS], conv)
    logged = logged.withColumnsRenamed({"ts_us": "log_ts", **{c: f"log_{c}" for c in COUNTERS}})
    joined = conv.join(logged, keys, "left")
    pairs = [
        F.struct(F.lit(c).alias("field"), F.col(c).alias("pcap"), F.col(f"log_{c}").alias("log")) for c in COUNTERS
    ]
    missing = F.col("line").isNull()
    none = F.lit(None).cast("bigint")
    differing = F.filter(F.array(*pairs), lambda p: ~p["pcap"].eqNullSafe(p["log"]))
    start = F.struct(F.lit("ts").alias("field"), F.col("first_us").alias("pcap"), F.col("log_ts").alias("log"))
    shifted = F.when(F.abs(F.col("first_us") - F.col("log_ts")) > tol_us, F.array(start)).otherwise(
        F.filter(F.array(start), lambda p: F.lit(False))
    )
    absent = F.array(F.struct(F.lit("no conn record").alias("field"), none.alias("pcap"), none.alias("log")))
    rows = F.when(missing, absent).otherwise(F.concat(differing, shifted))
    return joined.select(*keys, "line", F.explode(rows).alias("d")).select(*keys, "line", "d.*")


def join_cardinality(joined: DataFrame, conn: DataFrame) -> DataFrame:
    """How many rows of each side took part in a join, and the range of time differences.

    The join is read once: every row stands for its source line and, if matched, for its
    connection line, and both are folded in the same aggregation.
    """
    ok = F.col("verdict") == "matched"
    delta = F.col("delta_us") if "delta_us" in joined.columns else F.lit(None).cast("bigint")
    named = lambda file, line: F.struct((F.col(file) if file in joined.columns else F.lit(None).cast("string")).alias("file"), F.col(line).alias("line"))
    own, theirs = named("file", "line"), named("conn_file", "conn_line")
    sides = F.array(
        F.struct(F.lit("source").alias("side"), own.alias("id")),
        F.struct(F.lit("conn").alias("side"), F.when(ok, theirs).alias("id")),
    )
    rows = joined.select(ok.alias("ok"), F.when(ok, delta).alias("delta"), F.explode(sides).alias("s"))
    folded = rows.where("s.id is not null").groupBy("s.side", "s.id").agg(
        F.bool_or("ok").alias("ok"), F.min("delta").alias("low"), F.max("delta").alias("high")
    )
    source = F.col("side") == "source"
    totals = folded.agg(
        F.count_if(source).alias("source_records"),
        F.count_if(source & F.col("ok")).alias("matched_source_records"),
        F.count_if(source & ~F.col("ok")).alias("unmatched_source_records"),
        F.count_if(~source).alias("matched_conn_records"),
        F.min("low").alias("min_delta_us"),
        F.max("high").alias("max_delta_us"),
    )
    without = conn.agg(F.count(F.lit(1))).scalar() - F.col("matched_conn_records")
    return totals.withColumn("conn_records_without_this_source", without)


def asof_asset(events: DataFrame, leases: DataFrame, ip: str = "ip", chunk: int = CHUNK) -> DataFrame:
    """Which device held an address at event time. Leases of one address must not overlap.

    ``leases``: ``ip, device, valid_from_us, valid_to_us`` (null = still open). No day bins and no
    range join: long leases cost one row.
    """
    held = ordered.asof(
        events,
        leases.withColumn("__end", F.col("valid_to_us")),
        [ip],
        ["device", "__end"],
        right_ts="valid_from_us",
        chunk=chunk,
    )
    inside = F.col("__end").isNull() | (F.col("ts_us") < F.col("__end"))
    return held.withColumn("device", F.when(inside, F.col("device"))).drop("__end")


def lease_overlaps(leases: DataFrame, ip: str = "ip") -> DataFrame:
    """Leases that begin before the previous one of the same address ended."""
    before = ordered.carry_last(
        leases, [ip], "valid_from_us", {"previous_to_us": F.coalesce("valid_to_us", F.lit(2**62))}, ["device"]
    )
    return before.where(F.col("valid_from_us") < F.col("previous_to_us"))


def dns_to_conn(dns: DataFrame, conn: DataFrame, within_us: int, chunk: int = CHUNK) -> DataFrame:
    """The next connection a host opens to an address it was just given, and the gap to it.

    ``dns`` has one row per answered address (column ``answer``).
    """
    keys = ["orig_h", "address"]
    asked = dns.select(
        "orig_h", F.col("answer").alias("address"), F.col("ts_us").alias("at"), F.lit(1).alias("side"),
        F.col("line").alias("dns_line"), F.lit(None).cast("bigint").alias("conn_line"),
    )
    opened = conn.select(
        "orig_h", F.col("resp_h").alias("address"), F.col("ts_us").alias("at"), F.lit(0).alias("side"),
        F.lit(None).cast("bigint").alias("dns_line"), F.col("line").alias("conn_line"),
    )
    both = asked.unionByName(opened).withColumn("tie", F.coalesce("conn_line", F.lit(-1)))
    found = (F.col("side") == 0) & ordered.known(keys)
    hit = F.when(found, F.struct(F.col("at").alias("at"), F.col("conn_line").alias("line")))
    seen = ordered.carry_next(both, keys, "at", {"next": hit}, ["tie"], chunk)
    gap = F.col("next.at") - F.col("at")
    inside = F.coalesce(gap <= within_us, F.lit(False))
    return seen.where("side = 1").select(
        F.col("dns_line").alias("line"),
        *keys,
        F.when(inside, F.col("next.line")).alias("conn_line"),
        F.when(inside, gap).alias("gap_us"),
    )


def unresolved_names(names: DataFrame, dns: DataFrame, name: str = "name", query: str = "query") -> DataFrame:
    """Names used (for instance in a Host header) that no DNS record asks for."""
    asked = dns.select(F.lower(query).alias("__q")).distinct()
    return names.join(asked, F.lower(names[name]) == asked["__q"], "left_anti")


def alerts_without_conn(ids: DataFrame, conn: DataFrame, tol_us: int = RECORD_TOLERANCE, chunk: int = CHUNK) -> DataFrame:
    """Alerts near no connection that was answered: attempts only."""
    answered = conn.where(F.col("resp_pkts") > 0)
    joined = ordered.nearest(
        ids, answered.select("line", "ts_us", *TUPLE), TUPLE, tol_us, chunk=chunk
    )
    return joined.where(F.col("match_id").isNull()).select(*ids.columns)


def compare_copies(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two copies of a log: rows missing on either side and rows whose values differ.

    Aggregation instead of a full outer join, so a hot key is combined before the shuffle.
    Differing values include different numbers of copies.
    """
    keys = list(keys)
    print_ = row_print(list(values))
    sides = a.select(*keys, print_.alias("__f"), F.lit("a").alias("__s")).unionByName(
        b.select(*keys, print_.alias("__f"), F.lit("b").alias("__s"))
    )
    in_a, in_b = F.col("__s") == "a", F.col("__s") == "b"
    counted = sides.groupBy(*keys).agg(
        F.count_if(in_a).alias("in_a"),
        F.count_if(in_b).alias("in_b"),
        F.struct(*[F.sum(F.when(in_a, F.col(f"__f.{w}"))) for w in "xy"]).alias("__fa"),
        F.struct(*[F.sum(F.when(in_b, F.col(f"__f.{w}"))) for w in "xy"]).alias("__fb"),
    )
    verdict = (
        F.when(F.col("in_b") == 0, "missing_in_b")
        .when(F.col("in_a") == 0, "missing_in_a")
        .when((F.col("in_a") != F.col("in_b")) | (F.col("__fa") != F.col("__fb")), "differs")
    )
    return counted.withColumn("status", verdict).where("status is not null").drop("__fa", "__fb")


def not_authorised(df: DataFrame, allow: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows on the allow list. The list's size decides the join strategy at run time."""
    return df.join(allow.select(*keys).distinct(), list(keys), "left_anti")


def evidence_matrix(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Per connection key, how many records each source holds and whether byte counts agree.

    Each frame has the tuple columns and, where it knows them, ``bytes``. All sources are
    stacked and counted in one aggregation rather than joined one after the other.
    """
    stacked = None
    for name, df in sources.items():
        part = df.select(
            *TUPLE,
            F.lit(name).alias("__source"),
            (F.col("bytes") if "bytes" in df.columns else F.lit(None)).cast("bigint").alias("__bytes"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    is_source = {name: F.col("__source") == name for name in sources}
    counted = stacked.groupBy(*TUPLE).agg(
        *[F.count_if(cond).alias(f"{name}_records") for name, cond in is_source.items()],
        *[F.sum(F.when(cond, F.col("__bytes"))).alias(f"__b_{name}") for name, cond in is_source.items()],
    )
    known = F.filter(F.array(*[F.col(f"__b_{name}") for name in sources]), lambda v: v.isNotNull())
    seen = sum((F.col(f"{name}_records") > 0).cast("bigint") for name in sources)
    return counted.select(
        *TUPLE,
        *[f"{name}_records" for name in sources],
        seen.alias("sources_seen"),
        (F.size(F.array_distinct(known)) <= 1).alias("bytes_agree"),
    )


def witnesses(matrix: DataFrame, parents: Mapping[str, str]) -> DataFrame:
    """Count sources that share a parent as one witness."""
    by_parent: dict[str, list[str]] = {}
    for source, parent in parents.items():
        by_parent.setdefault(parent, []).append(source)
    voices = sum(
        F.greatest(*[(F.col(f"{s}_records") > 0).cast("bigint") for s in group], F.lit(0).cast("bigint"))
        for group in by_parent.values()
    )
    return matrix.withColumn("independent_witnesses", voices)


def pair_by_id(requests: DataFrame, replies: DataFrame, keys: Sequence[str], within_us: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Each request with its first later reply that carries the same keys (such as transaction id).

    Both need ``packet`` and ``ts_us``; ``keys`` is in request direction.
    """
    keys = list(keys)
    none = F.lit(None).cast("bigint")
    both = requests.select(*keys, "ts_us", "packet", F.col("packet").alias("request")).unionByName(
        replies.select(*keys, "ts_us", "packet", none.alias("request"))
    )
    reply = F.col("request").isNull() & ordered.known(keys)
    hit = F.when(reply, F.struct(F.col("packet").alias("packet"), F.col("ts_us").alias("ts")))
    seen = ordered.carry_next(both, keys, "ts_us", {"reply": hit}, ["packet"], chunk)
    gap = F.col("reply.ts") - F.col("ts_us")
    ok = F.lit(True) if within_us is None else gap <= within_us
    return seen.where("request is not null").select(
        *keys,
        "packet",
        F.when(ok, F.col("reply.packet")).alias("reply_packet"),
        F.when(ok, gap).alias("reply_us"),
    )


def pair_in_order(requests: DataFrame, replies: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """The k-th request of a key with the k-th reply, first in, first out: a reply answers the oldest request still open.

    Both need ``packet`` and ``ts_us`` (``file`` if they have one); ``keys`` is in request direction. Replies for which no request is open
    count for none, and requests without a reply stay, with nulls. Rows with an unknown key are not paired. Nothing is
    gathered per key: numbers come from running sums and minima, and request and reply meet under (key, number).
    """
    keys, name = list(keys), ordered.locator(requests, "packet")
    side = lambda df, sign: df.select(*keys, "ts_us", *name, F.lit(sign).cast("bigint").alias("__sign"))
    both = side(requests, 1).unionByName(side(replies, -1))
    hot, tie = ordered.hot_keys(both, keys), name
    sums = {"__open": F.col("__sign"), "__asked": (F.col("__sign") > 0).cast("bigint"), "__given": (F.col("__sign") < 0).cast("bigint")}
    counted = ordered.running_totals(both, keys, "ts_us", sums, tie, chunk, hot=hot)
    # the balance falls to a new low below zero exactly at replies that nothing waits for
    low = ordered.running_least(counted, keys, "ts_us", {"__low": F.least("__open", F.lit(0))}, tie, chunk, hot=hot)
    seen = ordered.carry_last(low, keys, "ts_us", {"__before": F.col("__low")}, tie, chunk, hot=hot)
    orphan = F.col("__low") < F.coalesce("__before", F.lit(0))
    number = F.when(F.col("__sign") > 0, F.col("__asked")).when(~orphan & ordered.known(keys), F.col("__given") + F.col("__low"))
    record = F.struct("ts_us", *name)
    ranked = seen.select(*keys, number.alias("__k"), F.when(F.col("__sign") > 0, record).alias("ask"), F.when(F.col("__sign") < 0, record).alias("reply"))
    # requests of unknown keys stay single
    alone = F.when(~ordered.known(keys), F.col("ask"))
    met = ranked.where("__k is not null").groupBy(*keys, "__k", alone.alias("__alone")).agg(F.max("ask").alias("ask"), F.max("reply").alias("reply"))
    return met.where("ask is not null").select(
        *keys, "ask.*", *[F.col(f"reply.{c}").alias(f"reply_{c}") for c in name], (F.col("reply.ts_us") - F.col("ask.ts_us")).alias("reply_us")
    )


def pair_http(packets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each HTTP request with its reply on the same connection, pipelined requests included.

    Interim replies (status 100 to 199 but 101) answer nothing.
    """
    asked, given = decode.http_messages(packets), decode.http_replies(packets)
    final = F.coalesce(~F.col("status").between(100, 199) | (F.col("status") == 101), F.lit(True))
    ends = ["client", "client_port", "server", "server_port"]
    name = ["ts_us", *ordered.locator(packets, "packet")]
    requests = asked.select(*[F.col(c).alias(e) for c, e in zip(("src", "sport", "dst", "dport"), ends, strict=True)], *name)
    replies = given.where(final).select(*[F.col(c).alias(e) for c, e in zip(("dst", "dport", "src", "sport"), ends, strict=True)], *name)
    return pair_in_order(requests, replies, ends, chunk)


def nearest_match(left: DataFrame, right: DataFrame, keys: Sequence[str], tol_us: int, chunk: int = CHUNK) -> DataFrame:
    return ordered.nearest(left, right, keys, tol_us, chunk=chunk)


def correlate(a: DataFrame, b: DataFrame, keys: Sequence[str], tol_us: int, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """General correlation of two record sets: rows with a verdict, and a summary."""
    rows = _nearest_verdict(
        ordered.nearest(a.select(*ordered.locator(a), "ts_us", *keys), b.select(_record(b), "ts_us", *keys), keys, tol_us, chunk=chunk), b
    )
    return rows, join_cardinality(rows, b)
