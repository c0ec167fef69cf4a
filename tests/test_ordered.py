"""Ordered operators against brute force, with chunks small enough that edges are crossed often."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracelode.operators import joins, ordered, temporal

CHUNKS = [11]


@pytest.fixture(autouse=True, params=["all", "some", "none"])
def splitting(request, monkeypatch):
    """Every key split, only the busiest, or none: the results must not depend on it."""
    rows = {"all": 0, "some": 60, "none": 10**9}[request.param]
    monkeypatch.setattr(ordered, "HOT_ROWS", rows)
    monkeypatch.setattr(ordered, "MAX_HOT_KEYS", 10_000)
    return request.param


def data(spark, seed, n=240):
    """Half of all rows belong to one key; times repeat; one key is null."""
    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["b", "c", None]
    rows = [(i, rng.choice(keys), rng.randrange(400), rng.randrange(50), rng.choice(["x", "y", None])) for i in range(n)]
    schema = "line BIGINT, k STRING, ts_us BIGINT, v BIGINT, label STRING"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(row[1], []).append(row)
    return out


@pytest.mark.parametrize("chunk", CHUNKS)
def test_carry_last_and_next(spark, chunk):
    rows, df = data(spark, 1)
    want_last, want_next = {}, {}
    for group in by_key(rows).values():
        for i, row in enumerate(group):
            want_last[row[0]] = next((r[4] for r in reversed(group[:i]) if r[4] is not None), None)
            want_next[row[0]] = next((r[4] for r in group[i + 1 :] if r[4] is not None), None)
    last = ordered.carry_last(df, ["k"], "ts_us", {"p": F.col("label")}, ["line"], chunk)
    nxt = ordered.carry_next(df, ["k"], "ts_us", {"p": F.col("label")}, ["line"], chunk)
    assert {r.line: r.p for r in last.collect()} == want_last
    assert {r.line: r.p for r in nxt.collect()} == want_next


@pytest.mark.parametrize("chunk", CHUNKS)
def test_running_and_trailing(spark, chunk):
    rows, df = data(spark, 2)
    running, trailing, before = {}, {}, {}
    for group in by_key(rows).values():
        total = 0
        for row in group:
            total += row[3]
            running[row[0]] = total
            trailing[row[0]] = sum(r[3] for r in group if row[2] - 30 <= r[2] <= row[2])
            before[row[0]] = sum(r[3] for r in group if row[2] - 30 <= r[2] < row[2])
    got = ordered.running_totals(df, ["k"], "ts_us", {"t": F.col("v")}, ["line"], chunk)
    assert {r.line: r.t for r in got.collect()} == running
    for exclude, want in ((False, trailing), (True, before)):
        got = ordered.trailing_totals(df, ["k"], "ts_us", {"t": F.col("v")}, 30, chunk, exclude_current=exclude)
        assert {r.line: r.t for r in got.collect()} == want


@pytest.mark.parametrize("chunk", CHUNKS)
def test_islands(spark, chunk):
    rows, df = data(spark, 3, 90)
    want = []
    for key, group in by_key(rows).items():
        run = []
        for row in group:
            if run and row[2] - run[-1][2] >= 9:
                want.append((key, run[0][2], run[-1][2], len(run), sum(r[3] for r in run)))
                run = []
            run.append(row)
        want.append((key, run[0][2], run[-1][2], len(run), sum(r[3] for r in run)))
    got = ordered.islands(df, ["k"], "ts_us", 9, {"v": F.col("v")}, chunk).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_interval_stats(spark, chunk):
    rows, df = data(spark, 4)
    rows.append((999, "single", 5, 1, None))
    df = df.unionByName(spark.createDataFrame([rows[-1]], df.schema))
    got = {r.k: r for r in ordered.interval_stats(df, ["k"], chunk=chunk).collect()}
    for key, group in by_key(rows).items():
        gaps = [b[2] - a[2] for a, b in zip(group, group[1:])]
        row = got[key]
        assert (row.n, row.intervals, row.first_us, row.last_us) == (len(group), len(gaps), group[0][2], group[-1][2])
        if gaps:
            assert row.mean_us == pytest.approx(statistics.mean(gaps))
            assert row.sd_us == pytest.approx(statistics.pstdev(gaps))
        else:
            assert row.mean_us is None and row.sd_us is None


def test_constant_gaps_have_no_deviation(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") * 60_000_000 + 1787529600_000_001).alias("ts_us"))
    row = ordered.interval_stats(df, ["k"]).first()
    assert (row.mean_us, row.sd_us) == (60_000_000.0, 0.0)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_nearest(spark, chunk):
    left, ldf = data(spark, 5, 120)
    right, rdf = data(spark, 6, 80)
    got = {r.line: r for r in ordered.nearest(ldf, rdf, ["k"], 6, chunk=chunk).collect()}
    assert len(got) == len(left)
    for line, key, ts, *_ in left:
        near = sorted((abs(ts - r[2]), r[0], ts - r[2]) for r in right if key is not None and r[1] == key and abs(ts - r[2]) <= 6)
        row = got[line]
        assert (row.match_id, row.delta_us) == ((near[0][1], near[0][2]) if near else (None, None))
        assert row.ambiguous == (len(near) > 1)


def test_tolerance_is_inclusive(spark):
    schema = "line BIGINT, k STRING, ts_us BIGINT"
    left = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 20_000)], schema)
    right = spark.createDataFrame([(1, "a", 10_000), (2, "b", 10_001), (3, "c", 10_000)], schema)
    got = {r.line: r.match_id for r in ordered.nearest(left, right, ["k"], 10_000).collect()}
    assert got == {1: 1, 2: None, 3: 3}


@pytest.mark.parametrize("chunk", CHUNKS)
def test_asof_and_leases(spark, chunk):
    leases = [("a", "d1", 10, 60), ("a", "d2", 100, None), ("b", "d3", 0, 5)]
    rng = random.Random(7)
    events = [(i, rng.choice("abc"), rng.randrange(200)) for i in range(150)]
    edf = spark.createDataFrame(events, "line BIGINT, ip STRING, ts_us BIGINT")
    ldf = spark.createDataFrame(leases, "ip STRING, device STRING, valid_from_us BIGINT, valid_to_us BIGINT")
    got = {r.line: r.device for r in joins.asof_asset(edf, ldf, chunk=chunk).collect()}
    for line, ip, ts in events:
        want = [d for i, d, lo, hi in leases if i == ip and lo <= ts and (hi is None or ts < hi)]
        assert got[line] == (want[0] if want else None)


def test_log_gaps(spark):
    rows, df = data(spark, 8, 60)
    want = sorted(
        (str(key), a[2], b[2]) for key, group in by_key(rows).items() for a, b in zip(group, group[1:]) if b[2] - a[2] > 8
    )
    for chunk in CHUNKS:
        got = temporal.log_gaps(df, ["k"], 8, chunk=chunk).collect()
        assert sorted((str(r.k), r.silent_from_us, r.silent_to_us) for r in got) == want


def test_timeline_ranks_without_one_sorted_task(spark):
    rows, df = data(spark, 9)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    got = temporal.timeline(df.withColumnRenamed("label", "phase"), chunk=13)
    assert {r.line: r["rank"] for r in got.collect()} == {r[0]: i + 1 for i, r in enumerate(order)}


def test_too_many_hot_keys_split_all(spark, monkeypatch):
    rows, df = data(spark, 2)
    want = ordered.running_totals(df, ["k"], "ts_us", {"t": F.col("v")}, ["line"], 50).collect()
    monkeypatch.setattr(ordered, "HOT_ROWS", 0)
    monkeypatch.setattr(ordered, "MAX_HOT_KEYS", 1)
    got = ordered.running_totals(df, ["k"], "ts_us", {"t": F.col("v")}, ["line"], 50).collect()
    assert {(r.line, r.t) for r in got} == {(r.line, r.t) for r in want}


def test_ordered_plans_split_a_key(spark, splitting):
    """With hot keys the row-level windows are partitioned by key and chunk, never by key alone."""
    if splitting == "none":
        return
    _, df = data(spark, 10)
    for out in (
        ordered.running_totals(df, ["k"], "ts_us", {"t": F.col("v")}, ["line"]),
        ordered.carry_last(df, ["k"], "ts_us", {"p": F.col("v")}, ["line"]),
        ordered.islands(df, ["k"], "ts_us", 9),
        ordered.interval_stats(df, ["k"]),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "__chunk" in plan and "CartesianProduct" not in plan


def test_one_count_per_operator(spark, monkeypatch):
    """Steps hand on what was counted, however many there are; a timeline counts nothing and sorts no whole table in one task."""
    from tracelode.operators import detections

    asked, count = [], ordered.hot_keys
    monkeypatch.setattr(ordered, "hot_keys", lambda df, keys: asked.append(keys) or count(df, keys))
    _, df = data(spark, 3)
    steps = [(f"s{i}_us", df.where(F.col("v") % 4 == i).select(F.col("k").alias("host"), F.col("ts_us").alias("first_us"), F.col("ts_us").alias("last_us"))) for i in range(4)]
    detections.sequence(steps, 200)
    temporal.rate(df, ["k"], 20, "v")
    assert asked == [["host"], ["k"]]
    plan = temporal.timeline(df, "label")._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 2
    single = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition(" in line and "windowspecdefinition(__chunk" not in line]
    assert all("__p_" in line or "__t_" in line or "__s_" in line for line in single)


def test_unknown_keys_spread(spark):
    """Left rows without a key match nothing, whatever their number, and do not share a window."""
    left = spark.range(500).select(F.col("id").alias("line"), F.lit(None).cast("string").alias("k"), (F.col("id") % 3).alias("ts_us"))
    right = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "line long, k string, ts_us long")
    got = ordered.nearest(left, right, ["k"], 5, chunk=11)
    assert got.where("match_id is null and not ambiguous").count() == 500
    assert "__salt" in got._jdf.queryExecution().optimizedPlan().toString()
