"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Packing is sequential, so it runs in two levels: every partition packs its own groups into pallets of a
small fixed capacity, then the pallets, whose number depends on the shards and the partitions
and not on the rows, are packed into shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, text_id

PALLETS_PER_SHARD = 256
GROUPS_PER_TASK = 200_000


class Room:
    """Open bins by remaining capacity: a two-level balanced tree with at most 2 * LEAF entries in a leaf."""

    LEAF = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.highest: list[tuple[int, int]] = []

    def put(self, left: int, bin_no: int) -> None:
        item = (left, bin_no)
        if not self.leaves:
            self.leaves, self.highest = [[item]], [item]
            return
        i = min(bisect_left(self.highest, item), len(self.leaves) - 1)
        leaf = self.leaves[i]
        insort(leaf, item)
        if len(leaf) > 2 * self.LEAF:
            self.leaves[i : i + 1] = [leaf[: self.LEAF], leaf[self.LEAF :]]
            self.highest[i : i + 1] = [leaf[self.LEAF - 1], leaf[-1]]
        else:
            self.highest[i] = leaf[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that is enough for ``size``."""
        i = bisect_left(self.highest, (size, -1))
        if i == len(self.leaves):
            return None
        leaf = self.leaves[i]
        item = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.highest[i] = leaf[-1]
        else:
            del self.leaves[i], self.highest[i]
        return item


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size; sizes come in falling order. One above the capacity gets a bin of its own."""
    room, out, bins = Room(), [], 0
    for size in sizes:
        found = room.take(size) if size <= capacity else None
        left, no = found or (capacity, bins)
        bins += found is None
        out.append(no)
        if size <= capacity:
            room.put(left - size, no)
    return out


def level(sizes: list[int], bins: int) -> list[int]:
    """Bins 0 to ``bins - 1`` of near equal sums for sizes in falling order.

    A size above the mean of what is left gets a bin of its own; for the rest, the least capacity is searched with
    which best fit needs no more bins than are left.
    """
    total, own = sum(sizes), 0
    while own < min(bins - 1, len(sizes)) and sizes[own] * (bins - own) > total:
        total -= sizes[own]
        own += 1
    rest, left = sizes[own:], bins - own
    if not rest:
        return list(range(own))
    low, high = max(rest[0], -(-total // left)), max(rest[0], -(-2 * total // left) + rest[0])
    best = best_fit(rest, high)
    while low < high:
        middle = (low + high) // 2
        found = best_fit(rest, middle)
        if max(found) < left:
            high, best = middle, found
        else:
            low = middle + 1
    return [*range(own), *(own + b for b in best)]


def _pallets(capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, sizes = [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (-sizes[i], keys[i]))
        base = TaskContext.get().partitionId() << 32
        bins = best_fit([sizes[i] for i in order], capacity)
        for lo in range(0, len(order), 20_000):
            part = slice(lo, lo + 20_000)
            yield pa.record_batch(
                [
                    pa.array([keys[i] for i in order[part]], pa.binary()), pa.array([sizes[i] for i in order[part]], pa.int64()),
                    pa.array([base + b for b in bins[part]], pa.int64()),
                ],
                ["key", "weight", "pallet"],
            )

    return pack


def _shards(bins: int):
    def assign(pdf):
        pdf = pdf.sort_values(["weight", "pallet"], ascending=[False, True])
        return pdf.assign(shard=level([int(w) for w in pdf["weight"]], bins))[["pallet", "shard"]]

    return assign


def pack(groups: DataFrame, capacity: int) -> DataFrame:
    """Groups ``key binary, weight long`` into bins of a fixed capacity, as few as best fit needs: adds ``pallet``.

    Each partition of about GROUPS_PER_TASK groups packs for itself, so at most one bin per partition is
    filled badly. A group larger than the capacity has a bin of its own.
    """
    tasks = max(1, -(-groups.count() // GROUPS_PER_TASK))
    dealt = groups.select("key", "weight").repartition(tasks, "key")
    return dealt.mapInArrow(_pallets(capacity), "key binary, weight long, pallet long")


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """Shard of each group ``key binary, weight long``, the shards near equal in weight."""
    total = groups.agg(F.sum("weight").alias("w")).collect()[0]["w"] or 0
    loaded = kept(pack(groups, max(1, total // (shards * PALLETS_PER_SHARD))), "shard-pallets")
    pallets = loaded.groupBy("pallet").agg(F.sum("weight").alias("weight"))
    placed = pallets.groupBy(F.lit(0).alias("all")).applyInPandas(_shards(shards), "pallet long, shard int")
    return loaded.join(kept(placed, "shard-bins"), "pallet").select("key", "shard")


def shard(docs: DataFrame, shards: int = 24, slot_blocks: int = 1024) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text (null: none) plus 8. Law ``bytes``: equal texts form one indivisible
    group (null texts one too) and shards come near the same size; a group above that has a shard to itself and the
    others share the rest evenly. ``slot`` numbers a shard's rows from 0, by a hash range of doc_id, doc_id, checksum and size;
    it is counted per range, so no task sees a whole shard. Null ids and repeated rows are rows like others;
    no rows give no rows. Only doc_id and text are read; texts are not shuffled.
    """
    rows = kept(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
            F.coalesce(text_id(F.col("text")), F.lit(b"")).alias("key"),
        ),
        "shard-rows",
    )
    groups = kept(rows.groupBy("key").agg(F.sum("size").alias("weight")), "shard-groups")
    out = rows.join(shard_groups(groups, shards), "key").drop("key")
    out = kept(out.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slot_blocks)).cast("int")), "shard-assigned")
    counts = out.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        out.withColumn("within", within).join(counts, ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
