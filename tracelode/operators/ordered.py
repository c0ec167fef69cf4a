"""Ordered work within a key that stays spread out when one key holds most rows.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task. Here a hot key
(more than ``HOT_ROWS`` rows, found by one count that combines before its shuffle) is cut into
fixed-width chunks of the ordering number (time in µs, line number, packet number). Ordered
work runs inside ``(key, chunk)``; only one summary row per chunk takes part in the second step
over the key, so that step grows with the covered range, not with the rows. Other keys are
one chunk each and need no second step; without hot keys the plan is the plain one.

An operator of several steps counts once, over its input, and hands the ``hot`` keys on to its steps: a step then
adds no job of its own while the plan is built. Work without keys is always cut.

``chunk`` is the width. Choose it so that the busiest key has a few million rows per chunk. Which keys
are split changes the plan only, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import MINUTE, floor_us

CHUNK = 5 * MINUTE
# A key with more rows than this is split.
HOT_ROWS = 5_000_000
# The hot keys themselves are broadcast. Were there more than this, all keys are split instead.
MAX_HOT_KEYS = 10_000
_C = "__chunk"
#: Parts of the rows of a chunk whose key is unknown.
SALTS = 1024
#: Count the keys where the work is asked for.
ASK = object()


def locator(df: DataFrame, line: str = "line") -> list[str]:
    """What names a record: its line (or packet) together with its file where there is one."""
    return ["file", line] if "file" in df.columns and line != "file" else [line]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which null keys match each other; the right keys are dropped."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(renamed[f"__r_{key}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{key}" for key in keys])


def known(keys: Sequence[str]) -> Column:
    """True where no key is null: an unknown value is not equal to another unknown value."""
    out = F.lit(True)
    for key in keys:
        out = out & F.col(key).isNotNull()
    return out


def hot_keys(df: DataFrame, keys: Sequence[str]) -> list | None:
    """Keys above ``HOT_ROWS``; None when they are too many to list."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS)
    found = counts.select(*keys).limit(MAX_HOT_KEYS + 1).collect()
    return None if len(found) > MAX_HOT_KEYS else found


def _chunked(df: DataFrame, keys: Sequence[str], pos: str, chunk: int, hot=ASK) -> tuple[DataFrame, list[str]]:
    """Add the chunk column (null for a key that stays whole) and say what to partition by."""
    slot = floor_us(F.col(pos), chunk)
    if not keys:
        return df.withColumn(_C, slot), [_C]
    hot = hot_keys(df, keys) if hot is ASK else hot
    if hot is not None and not hot:
        return df.withColumn(_C, F.lit(None).cast("bigint")), list(keys)
    if hot is None:
        return df.withColumn(_C, slot), [*keys, _C]
    schema = df.select(*keys).schema
    listed = df.sparkSession.createDataFrame(hot, schema).withColumn("__hot", F.lit(True))
    marked = join_null_safe(df, F.broadcast(listed), keys)
    return marked.withColumn(_C, F.when(F.col("__hot"), slot)).drop("__hot"), [*keys, _C]


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Mapping[str, Column],
    tie: Sequence[str] = (),
    chunk: int = CHUNK,
    include_current: bool = False,
    hot=ASK,
) -> DataFrame:
    """Add, per row, the last non-null value seen before it (or up to it) within the key.

    ``values`` maps new column names to expressions over ``df``. Order is ``pos`` then ``tie``.
    """
    keys, tie, names = list(keys), list(tie), list(values)
    src, parts = _chunked(df, keys, pos, chunk, hot)
    for name in names:
        src = src.withColumn(f"__v_{name}", values[name])
    inside = (
        Window.partitionBy(*parts)
        .orderBy(pos, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if include_current else -1)
    )
    rows = src.select("*", *[F.last(f"__v_{n}", ignorenulls=True).over(inside).alias(f"__l_{n}") for n in names])
    out, carried_names = rows, []
    if parts != keys:
        order = F.struct(pos, *tie)
        tails = src.where(F.col(_C).isNotNull()).groupBy(*keys, _C).agg(
            *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), order)).alias(f"__t_{n}") for n in names]
        )
        before = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, -1)
        carried = tails.select(
            *keys, _C, *[F.last(f"__t_{n}", ignorenulls=True).over(before).alias(f"__p_{n}") for n in names]
        )
        out, carried_names = join_null_safe(rows, carried, [*keys, _C]), [f"__p_{n}" for n in names]
    for name in names:
        sources = [f"__l_{name}"] + ([f"__p_{name}"] if carried_names else [])
        out = out.withColumn(name, F.coalesce(*sources))
    return out.drop(_C, *carried_names, *[f"__{kind}_{n}" for n in names for kind in "vl"])


def carry_next(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Mapping[str, Column],
    tie: Sequence[str] = (),
    chunk: int = CHUNK,
    include_current: bool = False,
) -> DataFrame:
    """The first non-null value after each row. Numeric ``tie`` columns only."""
    flipped = df.withColumn("__pos", -F.col(pos))
    ties = []
    for col in tie:
        flipped = flipped.withColumn(f"__tie_{col}", -F.col(col))
        ties.append(f"__tie_{col}")
    out = carry_last(flipped, keys, "__pos", values, ties, chunk, include_current)
    return out.drop("__pos", *ties)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Mapping[str, Column],
    tie: Sequence[str] = (),
    chunk: int = CHUNK,
    with_peers: bool = False,
    hot=ASK,
) -> DataFrame:
    """Running sums up to each row. ``with_peers`` counts all rows that share the position."""
    keys, tie, names = list(keys), list(tie), list(values)
    src, parts = _chunked(df, keys, pos, chunk, hot)
    for name in names:
        src = src.withColumn(f"__v_{name}", values[name])
    if with_peers:
        inside = Window.partitionBy(*parts).orderBy(pos).rangeBetween(Window.unboundedPreceding, 0)
    else:
        inside = Window.partitionBy(*parts).orderBy(pos, *tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = src.select("*", *[F.sum(f"__v_{n}").over(inside).alias(f"__l_{n}") for n in names])
    out, offset_names = rows, []
    if parts != keys:
        sums = src.where(F.col(_C).isNotNull()).groupBy(*keys, _C).agg(
            *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names]
        )
        before = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(*keys, _C, *[F.sum(f"__s_{n}").over(before).alias(f"__p_{n}") for n in names])
        out, offset_names = join_null_safe(rows, offsets, [*keys, _C]), [f"__p_{n}" for n in names]
    zero = F.lit(0)
    for name in names:
        total = F.coalesce(f"__l_{name}", zero)
        out = out.withColumn(name, total + F.coalesce(f"__p_{name}", zero) if offset_names else total)
    return out.drop(_C, *offset_names, *[f"__{kind}_{n}" for n in names for kind in "vl"])


def running_least(
    df: DataFrame, keys: Sequence[str], pos: str, values: Mapping[str, Column], tie: Sequence[str] = (), chunk: int = CHUNK, hot=ASK
) -> DataFrame:
    """Running minimum up to and including each row; nulls do not count."""
    keys, tie, names = list(keys), list(tie), list(values)
    src, parts = _chunked(df, keys, pos, chunk, hot)
    for name in names:
        src = src.withColumn(f"__v_{name}", values[name])
    inside = Window.partitionBy(*parts).orderBy(pos, *tie).rowsBetween(Window.unboundedPreceding, 0)
    out = src.select("*", *[F.min(f"__v_{n}").over(inside).alias(f"__l_{n}") for n in names])
    if parts == keys:
        return out.select(*df.columns, *[F.col(f"__l_{n}").alias(n) for n in names])
    lows = src.where(F.col(_C).isNotNull()).groupBy(*keys, _C).agg(*[F.min(f"__v_{n}").alias(f"__s_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lows.select(*keys, _C, *[F.min(f"__s_{n}").over(before).alias(f"__p_{n}") for n in names])
    out = join_null_safe(out, earlier, [*keys, _C])
    return out.select(*df.columns, *[F.least(f"__l_{n}", f"__p_{n}").alias(n) for n in names])


def trailing_totals(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Mapping[str, Column],
    width: int,
    chunk: int = CHUNK,
    exclude_current: bool = False,
) -> DataFrame:
    """Sums over ``[pos - width, pos]`` (or ``[pos - width, pos)``), linear in the rows.

    Each row adds its value at its position and takes it back once it has left the window, so a
    running sum gives the window's content without re-reading overlapping frames. Keys are counted over the rows, not the marks.
    """
    names, hot = list(values), hot_keys(df, keys) if keys else []
    vals = df
    for name in names:
        vals = vals.withColumn(f"__w_{name}", F.coalesce(values[name], F.lit(0)))
    enter = F.col(pos) + (1 if exclude_current else 0)
    marks = F.array(
        F.struct(F.col(pos).alias("at"), F.lit(0).alias("sign")),
        F.struct(enter.alias("at"), F.lit(1).alias("sign")),
        F.struct((F.col(pos) + width + 1).alias("at"), F.lit(-1).alias("sign")),
    )
    steps = vals.withColumn("__m", F.explode(marks)).select(
        "*", F.col("__m.at").alias("__at"), F.col("__m.sign").alias("__sign")
    ).drop("__m")
    summed = running_totals(
        steps,
        keys,
        "__at",
        {name: F.col(f"__w_{name}") * F.col("__sign") for name in names},
        chunk=chunk,
        with_peers=True,
        hot=hot,
    )
    return summed.where("__sign = 0").drop("__at", "__sign", *[f"__w_{name}" for name in names])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    limit: int,
    sums: Mapping[str, Column] | None = None,
    chunk: int = CHUNK,
    hot=ASK,
) -> DataFrame:
    """Runs of rows whose neighbours are closer than ``limit``.

    Output: keys, ``start``, ``end``, ``n`` and the requested sums. An island that touches
    neither edge of its chunk is final; only the first and the last of each chunk can join
    a neighbour, so at most two rows per chunk reach the second step.
    """
    keys = list(keys)
    sums = dict(sums or {})
    rows, cut = _chunked(
        df.select(*keys, F.col(pos).alias("__p"), *[expr.alias(name) for name, expr in sums.items()]), keys, "__p", chunk, hot
    )
    w = Window.partitionBy(*cut).orderBy("__p")
    flagged = rows.withColumn(
        "__gap", F.coalesce((F.col("__p") - F.lag("__p").over(w) >= limit).cast("int"), F.lit(0))
    )
    numbered = flagged.withColumn(
        "__i", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    parts = numbered.groupBy(*keys, _C, "__i").agg(
        F.min("__p").alias("start"),
        F.max("__p").alias("end"),
        F.count(F.lit(1)).alias("n"),
        *[F.sum(name).alias(name) for name in sums],
    )
    columns = [*keys, "start", "end", "n", *sums]
    if cut == keys:
        return parts.select(*columns)
    whole = Window.partitionBy(*keys, _C)
    on_edge = (F.col("__i") == 0) | (F.col("__i") == F.max("__i").over(whole))
    edges = parts.withColumn("__edge", F.col(_C).isNotNull() & on_edge)
    by_key = Window.partitionBy(*keys).orderBy(_C, "__i")
    joined = (
        edges.where("__edge")
        .withColumn(
            "__new",
            F.coalesce((F.col("start") - F.lag("end").over(by_key) >= limit).cast("int"), F.lit(1)),
        )
        .withColumn("__run", F.sum("__new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("n").alias("n"),
            *[F.sum(name).alias(name) for name in sums],
        )
    )
    return edges.where("not __edge").select(*columns).unionByName(joined.select(*columns))


def runs(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    breaks: Column,
    tie: Sequence[str] = (),
    chunk: int = CHUNK,
    name: str = "run",
    hot=ASK,
) -> DataFrame:
    """Number consecutive rows: the number grows by one at each row where ``breaks`` is true."""
    return running_totals(
        df, keys, pos, {name: F.coalesce(breaks, F.lit(True)).cast("bigint")}, tie, chunk, hot=hot
    )


def interval_stats(
    df: DataFrame, keys: Sequence[str], ts: str = "ts_us", chunk: int = CHUNK
) -> DataFrame:
    """Inter-arrival statistics per key: count, bounds, mean and population deviation.

    Mean and deviation are null for a key with a single row. Chunk moments are combined
    with the parallel variance formula, so nothing is subtracted that could cancel.
    """
    keys = list(keys)
    rows, cut = _chunked(df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("__t")), keys, "__t", chunk)
    w = Window.partitionBy(*cut).orderBy("__t")
    parts = (
        rows.withColumn("__d", F.col("__t") - F.lag("__t").over(w))
        .groupBy(*cut)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.min("__t").alias("__first"),
            F.max("__t").alias("__last"),
            F.count("__d").alias("__k"),
            F.avg("__d").alias("__m"),
            F.var_pop("__d").alias("__v"),
        )
    )
    if cut == keys:
        parts = parts.withColumn(_C, F.lit(None).cast("bigint"))
    by_key = Window.partitionBy(*keys)
    linked = parts.withColumn(
        "__x", F.col("__first") - F.lag("__last").over(by_key.orderBy(_C))
    ).withColumn(
        "__mean",
        (F.max("__last").over(by_key) - F.min("__first").over(by_key))
        / F.nullif(F.sum("__n").over(by_key) - 1, F.lit(0)),
    )
    within = F.col("__k") * (F.col("__v") + F.pow(F.col("__m") - F.col("__mean"), 2))
    across = F.pow(F.col("__x") - F.col("__mean"), 2)
    merged = linked.groupBy(*keys).agg(
        F.sum("__n").alias("n"),
        F.min("__first").alias("first_us"),
        F.max("__last").alias("last_us"),
        F.max("__mean").alias("mean_us"),
        F.sum(F.coalesce(within, F.lit(0.0)) + F.coalesce(across, F.lit(0.0))).alias("__ss"),
    )
    intervals = F.col("n") - 1
    return merged.select(
        *keys,
        "n",
        "first_us",
        "last_us",
        intervals.alias("intervals"),
        "mean_us",
        F.when(intervals > 0, F.sqrt(F.col("__ss") / intervals)).alias("sd_us"),
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    tol_us: int,
    left_id: str = "line",
    right_id: str = "line",
    left_ts: str = "ts_us",
    right_ts: str = "ts_us",
    chunk: int = CHUNK,
) -> DataFrame:
    """For each left row the right row with the same keys closest in time, within ``tol_us``.

    Adds ``match_id``, ``delta_us`` (left minus right) and ``ambiguous`` (more than one right row
    was within tolerance). Equal distances go to the smaller right id. No pairs are made: both
    sides are sorted together once per direction. Right rows near a chunk edge are also given
    to the neighbouring chunk, so chunks never need each other. Left rows with an unknown key match nothing and are
    spread, so that many of them do not meet in one task.
    """
    keys = list(keys)
    chunk = max(chunk, 2 * tol_us + 1)
    slots = F.sequence(
        floor_us(F.col(right_ts) - tol_us, chunk), floor_us(F.col(right_ts) + tol_us, chunk), F.lit(chunk)
    )
    r = right.where(known(keys)).select(
        *keys, F.col(right_ts).alias("__t"), F.col(right_id).alias("__rid"), F.explode(slots).alias(_C)
    )
    among = Window.partitionBy(*keys, _C).orderBy("__t", F.desc("__rid"))
    r = r.withColumn("__before", F.lag("__t").over(among)).withColumn("__after", F.lead("__t").over(among))
    r = r.select(
        *keys,
        _C,
        F.lit(0).cast("bigint").alias("__salt"),
        "__t",
        F.lit(0).alias("__side"),
        "__rid",
        F.struct(
            F.col("__t").alias("t"),
            F.col("__rid").alias("id"),
            F.col("__before").alias("before"),
            F.col("__after").alias("after"),
        ).alias("__r"),
    )
    lefts = left.withColumn("__t", F.col(left_ts)).withColumn(_C, floor_us(F.col(left_ts), chunk))
    salt = F.when(known(keys), F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64(left_id, left_ts), F.lit(SALTS)))
    l = lefts.withColumn("__side", F.lit(1)).withColumn("__salt", salt).withColumn("__left", F.struct(*left.columns))
    both = l.select(*keys, _C, "__salt", "__t", "__side", "__left").unionByName(r, allowMissingColumns=True)
    grow = (Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys, _C, "__salt").orderBy("__t", "__side", F.desc("__rid")).rowsBetween(*grow)
    down = Window.partitionBy(*keys, _C, "__salt").orderBy(F.desc("__t"), "__side", F.desc("__rid")).rowsBetween(*grow)
    seen = both.withColumn("__prev", F.last("__r", ignorenulls=True).over(up)).withColumn(
        "__next", F.last("__r", ignorenulls=True).over(down)
    )
    t = F.col("__t")
    back, ahead = t - F.col("__prev.t"), F.col("__next.t") - t
    prev_ok, next_ok = F.coalesce(back <= tol_us, F.lit(False)), F.coalesce(ahead <= tol_us, F.lit(False))
    use_prev = prev_ok & (
        ~next_ok | (back < ahead) | ((back == ahead) & (F.col("__prev.id") <= F.col("__next.id")))
    )
    ambiguous = (
        (prev_ok & next_ok & (F.col("__prev.id") != F.col("__next.id")))
        | (prev_ok & F.coalesce(t - F.col("__prev.before") <= tol_us, F.lit(False)))
        | (next_ok & F.coalesce(F.col("__next.after") - t <= tol_us, F.lit(False)))
        | (next_ok & F.coalesce(F.col("__next.before") >= t, F.lit(False)))
    )
    picked = F.when(use_prev, F.col("__prev")).when(next_ok, F.col("__next"))
    return seen.where("__side = 1").select(
        "__left.*",
        picked["id"].alias("match_id"),
        (t - picked["t"]).alias("delta_us"),
        ambiguous.alias("ambiguous"),
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    left_ts: str = "ts_us",
    right_ts: str = "ts_us",
    chunk: int = CHUNK,
    tie: str | None = None,
) -> DataFrame:
    """For each left row, ``values`` of the last right row at or before it with the same keys.

    Of right rows at the same time it is the one with the largest ``tie``, a column of ``right``; without it any of them.
    """
    keys, values = list(keys), list(values)
    r = right.where(known(keys)).select(
        *keys,
        F.col(right_ts).alias("__at"),
        F.lit(0).alias("__side"),
        *([F.col(tie).alias("__tie")] if tie else []),
        F.struct(*values).alias("__r"),
    )
    l = left.withColumn("__left", F.struct(*left.columns)).select(
        *keys, F.col(left_ts).alias("__at"), F.lit(1).alias("__side"), "__left"
    )
    both = l.unionByName(r, allowMissingColumns=True)
    seen = carry_last(both, keys, "__at", {"__hit": F.col("__r")}, ["__side", *(["__tie"] if tie else [])], chunk)
    return seen.where("__side = 1").select("__left.*", *[F.col(f"__hit.{v}").alias(v) for v in values])
