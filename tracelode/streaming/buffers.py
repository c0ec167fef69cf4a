"""State that holds on under disorder: rows wait in event-time buffers until the watermark passes them.

Keys are dealt to buckets by hash, and the state of a bucket is a few Arrow tables, so that a call of Python and a read of state serve
many keys at once instead of one. Rows of a bucket are kept as runs, one for each batch that brought some. A timer fires once the
watermark has passed the rows that were waiting when it was set, or a key's expiry: due rows are put in order and folded into the
summaries of their keys, and keys from which nothing more can follow lose their state. So disorder within the watermark's delay
changes no result, and state is bounded by the delay, not by the life of the stream. Rows older than the watermark are dropped by
Spark before they get here (``numRowsDroppedByWatermark``); ``detect.split_late`` keeps them for the late table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.clock import to_ts
from .runtime import use_rocksdb

#: Buckets that keys are dealt to. A bucket's waiting rows and summaries are in memory at once: take more for more state. A running
#: stream keeps its number.
BUCKETS = 256
_KEY = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _pack(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpack(run: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(run).read_pandas()


class Runs:
    """Rows of a key and whole numbers, the first number a time in microseconds, that wait for the watermark."""

    def __init__(self, handle: StatefulProcessorHandle, columns: Sequence[str]):
        self.state = handle.getListState("waiting", "run BINARY")
        self.columns = ["key", *columns]

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.state.appendValue((_pack(rows),))

    def rows(self) -> pd.DataFrame:
        """All of them by key, then in order."""
        runs = [_unpack(r[0]) for r in self.state.get()] if self.state.exists() else []
        if not runs:
            return pd.DataFrame({c: pd.Series(dtype=object if c == "key" else np.int64) for c in self.columns})
        return pd.concat(runs, ignore_index=True).sort_values(self.columns, ignore_index=True)

    def take(self, upto_us: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """``(due, rest)`` in order; the rest goes on waiting, as one run."""
        every = self.rows()
        late = (every[self.columns[1]] > upto_us).to_numpy()
        due, rest = every[~late].reset_index(drop=True), every[late].reset_index(drop=True)
        if not len(rest):
            self.state.clear()
        elif len(due):
            self.state.put([(_pack(rest),)])
        return due, rest


class Buffered(StatefulProcessor):
    """A processor whose rows wait in ``Runs`` and whose keys have one table of summaries; one timer per bucket."""

    columns: Sequence[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Runs(handle, self.columns)
        self.table = handle.getValueState("summaries", "rows BINARY")

    def summaries(self) -> pd.DataFrame | None:
        return _unpack(self.table.get()[0]) if self.table.exists() else None

    def keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.table.update((_pack(rows),))
        else:
            self.table.clear()

    def arrived(self, keys: np.ndarray) -> Iterator[pd.DataFrame]:
        """What to say after a batch brought rows of ``keys``."""
        return iter(())

    def settle(self, due: pd.DataFrame, rest: pd.DataFrame, now_us: int) -> tuple[list[pd.DataFrame], int | None]:
        """Fold ordered rows that nothing can precede any more; what to say, and when to look at the summaries again (None: never)."""
        raise NotImplementedError

    def _wake(self, at_us: int, fired_ms: int | None = None) -> None:
        """Let the one timer fire at this time, or earlier where it is set so. The timer that fires now is still listed."""
        timers, at = [t for t in self.handle.listTimers() if t != fired_ms], at_us // 1000 + 1
        if not timers or min(timers) > at:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, found = not self.waiting.state.exists(), []
        for chunk in rows:
            chunk = chunk.loc[chunk[self.columns[0]].notna(), self.waiting.columns]  # a mark of time has no content
            found.append(chunk.astype({c: np.int64 for c in self.columns}))
        found = pd.concat(found, ignore_index=True)
        if not len(found):
            return
        self.waiting.add(found)
        if fresh:
            self._wake(int(found[self.columns[0]].max()))
        yield from self.arrived(found["key"].unique())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = self.waiting.take(now_us)
        said, again = self.settle(due, rest, now_us)
        next_us = [int(rest[self.columns[0]].max())] if len(rest) else []
        next_us += [max(again, now_us)] if again is not None else []
        if next_us:
            self._wake(min(next_us), expiredTimerInfo.getExpiryTimeInMs())
        yield from said

    def close(self) -> None:
        pass


def _bucketed(rows: DataFrame, keys: Sequence[str], values: Sequence[Column | str], buckets: int):
    """Rows with one text for all their keys, grouped by bucket; ``_keyed`` gives the keys back."""
    key = F.to_json(F.struct(*keys), _KEY)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    return rows.select(bucket, key.alias("key"), *values, "event_time").groupBy("bucket")


def _keyed(said: DataFrame, schema: StructType, keys: Sequence[str]) -> DataFrame:
    one = StructType([schema[k] for k in keys])
    rest = [c for c in said.columns if c != "key"]
    return said.select(F.from_json("key", one, {"timestampFormat": _KEY["timestampFormat"]}).alias("__key"), *rest).select("__key.*", *rest)


_SUMS = {"n": np.int64, "last": np.int64, "first": np.int64, "mean": np.float64, "m2": np.float64}


def _merged(sums: pd.DataFrame | None, rows: pd.DataFrame) -> pd.DataFrame:
    """``key, n, last, first, mean, m2`` of the gaps after rows ordered by key and time follow; moments of both parts are combined."""
    if sums is None:
        sums = pd.DataFrame({"key": pd.Series(dtype=object), **{c: pd.Series(dtype=t) for c, t in _SUMS.items()}})
    if not len(rows):
        return sums
    code, keys = pd.factorize(rows["key"])
    old = sums.set_index("key").reindex(keys)
    known = old["n"].notna().to_numpy()
    n = old["n"].fillna(0).to_numpy(np.int64)
    times, starts = rows["ts_us"].to_numpy(), np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    before = np.r_[times[:1], times[:-1]]
    before[starts] = np.where(known, old["last"].fillna(0).to_numpy(np.int64), times[starts])
    counts = np.ones(len(times), np.int64)
    counts[starts] = known
    gaps = (times - before).astype(np.float64)
    k = np.bincount(code, counts, len(keys))
    each = np.maximum(k, 1)
    mean = np.bincount(code, gaps, len(keys)) / each
    m2 = np.bincount(code, counts * (gaps - mean[code]) ** 2, len(keys))
    done = np.maximum(n - 1, 0)
    total, old_mean = np.maximum(done + k, 1), old["mean"].fillna(0.0).to_numpy()
    shift = np.where(k > 0, mean - old_mean, 0.0)
    ends = np.r_[starts[1:], len(times)] - 1
    new = pd.DataFrame({
        "key": keys, "n": n + np.bincount(code, minlength=len(keys)), "last": times[ends],
        "first": np.where(known, old["first"].fillna(0).to_numpy(np.int64), times[starts]),
        "mean": old_mean + shift * k / total, "m2": old["m2"].fillna(0.0).to_numpy() + m2 + shift * shift * done * k / total,
    })
    same = sums[~sums["key"].isin(keys)]
    return pd.concat([same, new], ignore_index=True) if len(same) else new


class _Spacing(Buffered):
    """Count, mean and squared deviation of the gaps between the records of each key."""

    columns = ("ts_us",)

    def __init__(self, expire_us: int):
        self.expire_us = expire_us

    def _rows(self, sums: pd.DataFrame, closed: bool) -> pd.DataFrame:
        several = sums["n"] > 1
        return pd.DataFrame({
            "key": sums["key"], "n": sums["n"], "first_us": sums["first"], "last_us": sums["last"], "intervals": sums["n"] - 1,
            "mean_us": sums["mean"].where(several), "sd_us": np.sqrt(sums["m2"] / (sums["n"] - 1).where(several)), "closed": closed,
        }).astype({"mean_us": object, "sd_us": object}).where(lambda out: out.notna(), None)

    def arrived(self, keys):
        sums, waiting = self.summaries(), self.waiting.rows()
        mine = None if sums is None else sums[sums["key"].isin(keys)]
        yield self._rows(_merged(mine, waiting[waiting["key"].isin(keys)]), False)

    def settle(self, due, rest, now_us):
        sums = _merged(self.summaries(), due)
        idle = ~sums["key"].isin(rest["key"].unique())
        over = idle & (sums["last"] + self.expire_us <= now_us)
        self.keep(sums[~over])
        left = sums.loc[idle & ~over, "last"]
        return ([self._rows(sums[over], True)] if over.any() else []), (int(left.min()) + self.expire_us if len(left) else None)


def interval_state(df: DataFrame, keys: Sequence[str], expire_us: int = 604_800_000_000, buckets: int = BUCKETS) -> DataFrame:
    """Online interval statistics per key over ``ts_us``, in update mode: n, first_us, last_us, intervals, mean_us, sd_us, closed.

    ``df`` has ``event_time`` with a watermark (``detect.with_event_time``). A key's row covers all its records so far, those that
    still wait included, in order of time whatever order they came in. A key is ``closed``, and forgotten, once the watermark is
    ``expire_us`` past its last record; later records start it anew. Rows with a null ``ts_us`` only carry their event time on.
    """
    use_rocksdb(df.sparkSession)
    said = _bucketed(df, keys, ["ts_us"], buckets).transformWithStateInPandas(
        statefulProcessor=_Spacing(expire_us),
        outputStructType="key STRING, n BIGINT, first_us BIGINT, last_us BIGINT, intervals BIGINT, mean_us DOUBLE, sd_us DOUBLE, closed BOOLEAN",
        outputMode="Update", timeMode="EventTime",
    )
    return _keyed(said, df.schema, keys)


class _Chain(Buffered):
    """How far each host has come in an ordered list of steps."""

    columns = ("first_us", "last_us", "step")

    def __init__(self, steps: Sequence[str], within_us: int):
        self.steps, self.within = list(steps), within_us

    def _follow(self, chains: list[list], rows: list[list]) -> list[tuple]:
        """Chains that the rows of one host complete; ``chains`` are the ends and starts of those at each step."""
        out = []
        for first, last, step in rows:
            if step == 0:
                chains[0].append((last, (first,)))
                continue
            ended = max((c for c in chains[step - 1] if c[0] < first), default=None)
            # Episodes come by start, so an earlier end than the best one is of no more use.
            chains[step - 1] = [c for c in chains[step - 1] if c[0] >= first] + ([ended] if ended else [])
            if ended and first - ended[0] <= self.within:
                path = (*ended[1], first)
                if step == len(self.steps) - 1:
                    out.append((*path, last))
                else:
                    chains[step].append((last, path))
        return out

    def settle(self, due, rest, now_us):
        # Summaries: chains that may still go on, as their step, end and the starts of their steps.
        old, open_chains = self.summaries(), {}
        for key, step, end, starts in old.itertuples(index=False, name=None) if old is not None else ():
            open_chains.setdefault(key, [[] for _ in self.steps])[step].append((end, tuple(starts)))
        said, numbers = [], due[list(self.columns)].to_numpy()
        code, keys = pd.factorize(due["key"])
        edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(due) else np.zeros(1, np.int64)
        for key, begin, end in zip(keys, edges, edges[1:]):
            chains = open_chains.setdefault(key, [[] for _ in self.steps])
            said += [(key, *row) for row in self._follow(chains, numbers[begin:end].tolist())]
        # episodes still to come, of those that wait and those not yet seen, start after now_us
        left = [
            (key, step, end, list(starts))
            for key, chains in open_chains.items() for step, found in enumerate(chains) for end, starts in found if end + self.within >= now_us
        ]
        self.keep(pd.DataFrame(left, columns=["key", "step", "end", "starts"]))
        again = max(end for _, _, end, _ in left) + self.within if left else None
        return ([pd.DataFrame(said, columns=["key", *self.steps, "end_us"])] if said else []), again


class _Next(Buffered):
    """Answers of each host and address that wait for their next connection."""

    columns = ("ts_us", "opened", "line")

    def __init__(self, within_us: int):
        self.within = within_us

    def settle(self, due, rest, now_us):
        # Summaries: answers still open, which stand before all due rows of their key.
        old = self.summaries()
        rows = due if old is None else pd.concat([old, due], ignore_index=True).sort_values(self.waiting.columns, ignore_index=True)
        code = pd.factorize(rows["key"])[0]
        times, lines, opened = rows["ts_us"].to_numpy(), rows["line"].to_numpy(), rows["opened"].to_numpy() == 1
        # the first connection from each row on, if it is of the same key
        places = np.where(opened, np.arange(len(rows)), len(rows))
        at = np.minimum.accumulate(places[::-1])[::-1]
        safe = np.minimum(at, max(len(rows) - 1, 0))
        met = (at < len(rows)) & (code[safe] == code)
        gap = times[safe] - times
        inside = met & (gap <= self.within)
        over = ~opened & (met | (times + self.within < now_us))
        said = pd.DataFrame({
            "line": lines[over], "key": rows["key"].to_numpy()[over],
            "conn_line": pd.array(lines[safe][over], dtype="Int64"), "gap_us": pd.array(gap[over], dtype="Int64"),
        })
        said.loc[~inside[over], ["conn_line", "gap_us"]] = pd.NA
        left = rows[~opened & ~over]
        self.keep(left)
        return ([said] if len(said) else []), (int(left["ts_us"].min()) + self.within if len(left) else None)


def next_connection(dns: DataFrame, conn: DataFrame, within_us: int, buckets: int = BUCKETS) -> DataFrame:
    """Online form of ``joins.dns_to_conn``: line, orig_h, address, conn_line, gap_us of every answer, once.

    An answer meets the first connection of its host to its address within ``within_us``, at the same time or after; its row comes when the
    watermark has passed that connection, or the limit (then the last two columns are null). Both streams have ``event_time``
    with watermarks. State holds the answers still open, so output and state grow with the answers, not with pairs.
    Unknown hosts and addresses meet nothing.
    """
    use_rocksdb(dns.sparkSession)
    asked = dns.select("orig_h", F.col("answer").alias("address"), "ts_us", F.lit(0).cast("bigint").alias("opened"), "line", "event_time")
    opened = conn.select("orig_h", F.col("resp_h").alias("address"), "ts_us", F.lit(1).cast("bigint").alias("opened"), "line", "event_time")
    # a connection of unknown ends only carries its event time on
    opened = opened.withColumn("ts_us", F.when(F.col("orig_h").isNotNull() & F.col("address").isNotNull(), F.col("ts_us")))
    keys, rows = ["orig_h", "address"], asked.unionByName(opened)
    said = _bucketed(rows, keys, ["ts_us", "opened", "line"], buckets).transformWithStateInPandas(
        statefulProcessor=_Next(within_us), outputStructType="line BIGINT, key STRING, conn_line BIGINT, gap_us BIGINT",
        outputMode="Append", timeMode="EventTime",
    )
    return _keyed(said, rows.schema, keys).select("line", *keys, "conn_line", "gap_us")


def sequence_state(
    episodes: DataFrame, steps: Sequence[str], within_us: int, key: str = "host", delay: str = "1 day", buckets: int = BUCKETS
) -> DataFrame:
    """Online form of ``detections.sequence``: episodes ``(key, step, first_us, last_us)`` in any order within ``delay``.

    A chain is reported once, when the watermark has passed the start of its last step. Chains that nothing can follow any more
    are forgotten. Rows with a null ``first_us`` and an ``event_time`` of their own only carry time on.
    """
    use_rocksdb(episodes.sparkSession)
    own = F.col("event_time") if "event_time" in episodes.columns else F.lit(None).cast("timestamp")
    timed = episodes.select(key, "step", "first_us", "last_us", F.coalesce(to_ts(F.col("first_us")), own).alias("event_time"))
    said = _bucketed(timed.withWatermark("event_time", delay), [key], ["first_us", "last_us", "step"], buckets).transformWithStateInPandas(
        statefulProcessor=_Chain(steps, within_us), outputStructType="key STRING, " + ", ".join(f"`{s}` BIGINT" for s in steps) + ", end_us BIGINT",
        outputMode="Append", timeMode="EventTime",
    )
    return _keyed(said, episodes.schema, [key])
