"""Conversation prefix trie: ROLLUP over columns of turn ids aggregates all prefixes together.

A conversation is laid out as blocks of WIDTH turn ids. One ``GROUP BY block, prior, ROLLUP (t1, ..., t8)`` groups every
prefix of every block at once; ``prior`` is the key of the node where the block before ended, so long conversations go on
in further blocks without another pass. A node's key is a sum of hashes of (position, turn id): a running sum, so
that neither numbering nor keys need a conversation in one task.

What is summed over a subtree is rolled up the same way. Each node is charged to its smallest member, which stays a
member of all nodes above; a conversation that carries at each depth the sum of its charges from there on adds up to the
subtree's total in whatever node it is grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, kept

WIDTH = 8
SLOTS = [f"t{i}" for i in range(1, WIDTH + 1)]
PRIOR = ["p1", "p2", "p3", "p4"]
KEY = ["k1", "k2", "k3", "k4"]
UP = ["q1", "q2", "q3", "q4"]
#: Blocks of one conversation that one window orders.
STRETCH = 4096
#: Parents with more children than this, and than a ten-thousandth of all nodes, are looked up by broadcast.
MANY = 10_000


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, token``: the id of each turn's role and text, followed by its number of words.

    Null role or text is empty. Turns without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    same = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(WORD)).cast("string").cast("binary")
    return conversations.where("conv_id is not null").select("conv_id", "turn", F.concat(F.unhex(same), words).alias("token"))


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(turns, convs)``: ``conv_id, pos, token`` with positions from 1, and ``conv_id, n``.

    Turns are ordered by ``turn`` (null first), turns with the same number by the hash of role and text. Ranges of the whole
    order are numbered each for itself, so a long conversation spreads; the few that reach over several
    ranges (two a border at most) get an offset by broadcast.
    """
    salted = kept(rows, "turn-rows").withColumn("salt", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "token", "salt"]
    placed = kept(salted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turn-ranges")
    per = kept(placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")), "turn-counts")
    convs = kept(per.groupBy("conv_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")), "turn-convs")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    wide = per.join(convs.where("parts > 1").select("conv_id"), "conv_id", "left_semi").select("conv_id", "part", before.alias("before"))
    at = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order[1:]))
    turns = placed.withColumn("at", at).join(F.broadcast(wide), ["conv_id", "part"], "left")
    return turns.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "token"), convs.select("conv_id", "n")


def forked(turns: DataFrame, convs: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation c begins with the first h turns of conversation ``c - c % every`` (all if it has fewer, none if it is
    absent), followed by its own turns after its first h; h is crc32(decimal c) modulo ``heads``."""
    info = convs.select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("root"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")
    )
    info = info.join(convs.select(F.col("conv_id").alias("root"), F.col("n").alias("n_root")), "root", "left")
    info = kept(info.withColumn("take", F.least("h", F.coalesce("n_root", F.lit(0)))), "turn-forks")
    own = turns.join(info.select("conv_id", "h", "take"), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("take")).alias("pos"), "token")
    lent = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "root").join(info.select("conv_id", "root", "h"), "root")
    made = own.unionByName(lent.where("pos <= h").select("conv_id", "pos", "token"))
    return made, info.select("conv_id", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _limbs(pos: Column, token: Column) -> list[Column]:
    """128 bits of hash of a turn at a position, as four numbers that can be summed without overflow."""
    halves = [F.xxhash64(pos.cast("long"), token), F.xxhash64(F.lit(1), pos.cast("long"), token)]
    return [part for h in halves for part in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]


def _running(df: DataFrame, values: Sequence[str], down: bool = False) -> DataFrame:
    """``df`` with ``<value>_past``: the sum over the blocks before (``down``: after) within the conversation."""
    df = df.withColumn("stretch", F.expr(f"block div {STRETCH}"))
    past = (Window.unboundedPreceding, -1)
    way = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    near = Window.partitionBy("conv_id", "stretch").orderBy(way("block")).rowsBetween(*past)
    far = Window.partitionBy("conv_id").orderBy(way("stretch")).rowsBetween(*past)
    whole = df.groupBy("conv_id", "stretch").agg(*[F.sum(v).alias(v) for v in values])
    whole = whole.select("conv_id", "stretch", *[F.sum(v).over(far).alias(f"{v}_far") for v in values]).where(F.col(f"{values[0]}_far").isNotNull())
    df = df.select("*", *[F.sum(v).over(near).alias(f"{v}_near") for v in values]).join(whole, ["conv_id", "stretch"], "left")
    sums = {f"{v}_past": F.coalesce(f"{v}_near", F.lit(0)) + F.coalesce(f"{v}_far", F.lit(0)) for v in values}
    return df.withColumns(sums).drop("stretch", *[f"{v}_{s}" for v in values for s in ("near", "far")])


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, block, t1..t8, p1..p4, x1..x4``: the turn ids of each block, the key of the prefix before it and what it adds."""
    slot = (F.col("pos") - 1) % WIDTH + 1
    rows = turns.select("conv_id", "pos", "token", F.expr(f"(pos - 1) div {WIDTH}").alias("block"), slot.alias("slot"), *[c.alias(f"x{i}") for i, c in enumerate(_limbs(F.col("pos"), F.col("token")), 1)])
    cut = rows.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("token"))).alias(t) for i, t in enumerate(SLOTS, 1)], *[F.sum(f"x{i}").alias(f"x{i}") for i in range(1, 5)]
    )
    bare = convs.where("n = 0").select(
        "conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("binary").alias(t) for t in SLOTS], *[F.lit(0).cast("long").alias(f"x{i}") for i in range(1, 5)]
    )
    made = _running(cut.unionByName(bare), [f"x{i}" for i in range(1, 5)])
    return kept(made.withColumnsRenamed({f"x{i}_past": f"p{i}" for i in range(1, 5)}), "trie-blocks")


def _rollup(df: DataFrame, sums: str) -> DataFrame:
    """All prefixes of all blocks with ``sums``, their ``level`` in the block and ``depth``."""
    slots, prior = ", ".join(SLOTS), ", ".join(PRIOR)
    made = df.sparkSession.sql(
        f"SELECT block, {prior}, {slots}, {WIDTH} - bit_count(grouping_id()) AS level, min(conv_id) AS conv_id, {sums} "
        f"FROM {{blocks}} GROUP BY block, {prior}, ROLLUP ({slots})",
        blocks=df,
    )
    # a conversation that has ended gives no deeper prefix; the empty prefix counts once, before the first block
    made = made.withColumn("token", F.coalesce(*[F.when(F.col("level") == i, F.col(t)) for i, t in enumerate(SLOTS, 1)]))
    made = made.where("token is not null or (level = 0 and block = 0)")
    return made.withColumn("depth", F.col("block") * WIDTH + F.col("level"))


def nodes(laid: DataFrame) -> DataFrame:
    """``conv_id, depth, n_convs, words, token, k1..k4, q1..q4``: every node, named by its smallest member and depth, with its
    key and its parent's."""
    made = _rollup(laid, "count(*) AS n_convs")
    each = [_limbs(F.col("block") * WIDTH + i, F.col(t)) for i, t in enumerate(SLOTS, 1)]

    def key(limb: int, least: int) -> Column:
        out = F.col(PRIOR[limb])
        for i, limbs in enumerate(each, 1):
            out = out + F.when(F.col("level") >= i + least, limbs[limb]).otherwise(F.lit(0))
        return out

    words = F.coalesce(F.expr("cast(cast(substring(token, 17) as string) as bigint)"), F.lit(0))
    return made.select(
        "conv_id", "depth", "n_convs", words.alias("words"), "token", *[key(i, 0).alias(k) for i, k in enumerate(KEY)], *[key(i, 1).alias(q) for i, q in enumerate(UP)]
    )


def subtrees(laid: DataFrame, counted: DataFrame) -> DataFrame:
    """``conv_id, depth, n_leaves, saved_tokens`` of every node, from ``counted`` nodes with ``n_children``."""
    spot = (F.col("depth") - 1) % WIDTH + 1
    own = (F.col("n_convs") - 1) * F.col("words")
    charged = counted.groupBy("conv_id", F.expr(f"greatest(depth - 1, 0) div {WIDTH}").alias("block")).agg(
        *[F.sum(F.when(spot == i, own).otherwise(F.lit(0))).alias(f"o{i}") for i in range(1, WIDTH + 1)],
        F.sum(own).alias("own"), F.count_if(F.col("n_children") == 0).alias("leaf"), F.count(F.lit(1)).alias("led"),
    )
    owns = [f"o{i}" for i in range(1, WIDTH + 1)]
    full = laid.drop("x1", "x2", "x3", "x4").join(charged, ["conv_id", "block"], "left").fillna(0, [*owns, "own", "leaf", "led"])
    full = _running(full, ["own", "leaf", "led"], down=True).where("led + led_past > 0")
    onward, later = {}, F.col("own_past")
    for i in range(WIDTH, 0, -1):
        later = later + F.col(f"o{i}")
        onward[f"s{i}"] = later
    full = full.withColumns({**onward, "leaves": F.col("leaf") + F.col("leaf_past")})
    made = _rollup(full, "sum(leaves) AS n_leaves, " + ", ".join(f"sum(s{i}) AS s{i}" for i in range(1, WIDTH + 1)))
    saved = F.coalesce(*[F.when(F.greatest("level", F.lit(1)) == i, F.col(f"s{i}")) for i in range(1, WIDTH + 1)])
    return made.select("conv_id", "depth", "n_leaves", saved.alias("saved_tokens"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come one after another, joined by commas."""
    names = ["depth", *KEY]
    last, running = None, None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        out = []
        for *key, piece in zip(*columns, batch.column("piece").to_pylist(), strict=True):
            if key == last:
                running.update(b"," + piece.encode())
                continue
            if last is not None:
                out.append((*last, running.hexdigest()))
            last, running = key, hashlib.sha256(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*names, "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, running.hexdigest())], [*names, "ends_sha256"])


def ends(laid: DataFrame, run_bits: int = 12) -> DataFrame:
    """``depth, k1..k4, ends_sha256`` of the nodes where conversations end.

    Ids are joined in runs of ``2 ** run_bits`` numbers first; only a node's runs, in order, pass through one hash, which
    keeps a few bytes whatever their number.
    """
    filled = sum((F.when(F.col(t).isNotNull(), 1).otherwise(0) for t in SLOTS), F.lit(0))
    here = F.struct("block", filled.alias("filled"), *[(F.col(f"p{i}") + F.col(f"x{i}")).alias(f"k{i}") for i in range(1, 5)])
    last = laid.groupBy("conv_id").agg(F.max(here).alias("e")).select("conv_id", (F.col("e.block") * WIDTH + F.col("e.filled")).alias("depth"), *[f"e.{k}" for k in KEY])
    name = ["depth", *KEY]
    runs = last.groupBy(*name, F.shiftright("conv_id", run_bits).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece")
    )
    ordered = runs.repartition(*name).sortWithinPartitions(*name, "run")
    return ordered.drop("run").mapInArrow(_digests, "depth long, k1 long, k2 long, k3 long, k4 long, ends_sha256 string")


def _parents(counted: DataFrame, many: int) -> DataFrame:
    """``conv_id, depth, parent_conv_id``. Parents of very many children are few, and broadcast; the rest is a join."""
    most = max(many, counted.count() // 10_000)
    up = F.col("depth") - 1
    child = counted.where("depth > 0").select("conv_id", "depth", up.alias("up"), *UP)
    parent = counted.select(F.col("depth").alias("up"), *[F.col(k).alias(q) for k, q in zip(KEY, UP, strict=True)], F.col("conv_id").alias("parent_conv_id"), "n_children")
    on = ["up", *UP]
    large = F.broadcast(parent.where(F.col("n_children") > most).drop("n_children"))
    few = child.join(large, on, "left_anti").join(parent.drop("n_children"), on)
    return child.join(large, on).unionByName(few).select("conv_id", "depth", "parent_conv_id")


def trie(turns: DataFrame, convs: DataFrame, many: int = MANY) -> DataFrame:
    """One row per node of the prefix trie of ``turns`` (``conv_id, pos, token``) and ``convs`` (``conv_id, n``): conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and turn_id, the hash
    of the node's last role and text (``turn_texts`` has them). Conversations without turns are members of the root;
    no conversations give no rows."""
    laid = blocks(turns, convs)
    every = kept(nodes(laid), "trie-nodes")
    below = every.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(q).alias(k) for k, q in zip(KEY, UP, strict=True)]).agg(F.count(F.lit(1)).alias("n_children"))
    counted = kept(every.join(below, ["depth", *KEY], "left").fillna(0, ["n_children"]), "trie-counted")
    out = counted.join(subtrees(laid, counted), ["conv_id", "depth"]).join(ends(laid), ["depth", *KEY], "left")
    out = out.join(_parents(counted, many), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), F.lower(F.hex(F.substring("token", 1, 16))).alias("turn_id"),
    )


def turn_texts(conversations: DataFrame) -> DataFrame:
    """``turn_id, role, text`` of every distinct turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    same = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where("conv_id is not null").groupBy(same.alias("turn_id")).agg(F.min(role).alias("role"), F.min(text).alias("text"))


def conversation_trie(conversations: DataFrame, many: int = MANY) -> DataFrame:
    """The trie of the conversations as they are. Repeated rows are turns like others; only conv_id, turn, role and text are
    read, so other columns may have any names; texts of any length count as their hash and number of words."""
    return trie(*numbered(turn_rows(conversations)), many)


def forked_trie(conversations: DataFrame, many: int = MANY) -> DataFrame:
    """The trie of the conversations that ``forked`` makes."""
    turns, convs = forked(*numbered(turn_rows(conversations)))
    return trie(turns, convs, many)
