"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points run through the cumulative target shares and name a source for every slot; a slot's
rank among its source's slots is the number of the equal-token block that it takes from the source's
shuffled stream. A stream repeats its source up to ``max_epochs`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, kept, key_text

GOLDEN = 0.6180339887498949
CELLS = 4096
CHUNK = 1 << 16
#: Rows that a range of a source's shuffled order holds at most, about, if the source had all rows.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Target words of each source from ``skey, source, source_size``.

    Sources in code point order (null last) weigh 1, 2, 3, 1, ...; together they get as many words as
    there are. A source stops at ``max_epochs`` times its size and the excess goes to the others by weight,
    until none is above: in the order of size by weight, the first source whose share of what is left
    fits its limit fixes the words per weight for itself and all after it. One row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    up = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", (F.col("rank") % 3 + 1).cast("double")).withColumn("limit", F.lit(max_epochs).cast("double") * F.col("source_size"))
    t = t.withColumn("ratio", F.col("limit") / F.col("weight"))
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("limit").over(up), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    t = t.withColumn("per_weight", left / weights)
    free = F.min(F.when(F.col("per_weight") <= F.col("ratio"), F.struct("ratio", "rank", "per_weight"))).over(every)["per_weight"]
    t = t.withColumn("target", F.least(F.col("limit"), free * F.col("weight")))
    return t.select("skey", "source", "rank", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("take"))


def range_digits(rows: int) -> int:
    """Hexadecimal digits of the hash that cut ``rows`` rows into ranges of RANGE_ROWS; two at least, eight at most."""
    return next((d for d in range(2, 8) if 16**d * RANGE_ROWS >= rows), 8)


def streams(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document's place in its source's shuffled stream of words, and the sources.

    The order is that of md5(doc_id), or of the text's hash where the id is null (then doc_id, size and checksum). Places are sums within
    ranges of the hash per source plus a running sum over the ranges; the ranges grow in number with the rows, so a
    source with all rows has some RANGE_ROWS of them in a group.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    sized = kept(
        docs.select(
            "doc_id", "source", key_text(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size"),
            F.md5(name).alias("h"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("crc"),
        ),
        "mix-sizes",
    )
    sized = sized.withColumn("bucket", F.substring("h", 1, range_digits(sized.count())))
    ranges = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    running = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("skey", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("offset"))
    sources = targets(ranges.groupBy("skey").agg(F.sum("words").alias("source_size"), F.first("source").alias("source")))
    sources = kept(sources, "mix-sources")
    order = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "crc")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("within", before).withColumn("no", F.row_number().over(order)).join(offsets, ["skey", "bucket"])
    placed = placed.join(sources.select("skey", "source_size", "target", "take"), "skey")
    return placed.withColumn("place", F.col("offset") + F.col("within")).drop("offset", "within"), sources


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """Slots ``slot, skey, rank, words``: which source gives its next block, and how many words of it."""
    spark = sources.sparkSession
    all_ = sources.agg(F.sum("source_size").alias("words"), F.count(F.lit(1)).alias("sources")).collect()[0]
    slots = -(-int(all_["words"] or 0) // block_words)
    upto = Window.orderBy("rank")
    whole = F.sum("target").over(Window.partitionBy())
    shares = sources.where("take > 0").select(
        "skey", "rank", "take",
        (F.coalesce(F.sum("target").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / whole).alias("low"),
        (F.sum("target").over(upto) / whole).alias("high"),
    )
    last = F.lit(CELLS - 1).cast("long")
    cells = shares.select(
        "skey", "low", "high",
        F.explode(F.sequence(F.least(F.floor(F.col("low") * CELLS), last), F.least(F.floor(F.col("high") * CELLS), last))).alias("cell"),
    )
    point = spark.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("u"))
    point = point.withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = point.join(cells, "cell").where("u >= low and u < high").select("slot", "skey", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = drawn.withColumn("i", F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(counts.withColumn("before", before), ["skey", "chunk"]).select("slot", "skey", (F.col("before") + F.col("i")).alias("rank"))
    # what the points leave short of a target follows at the end
    need = F.ceil(F.col("take") / block_words)
    given = counts.groupBy("skey").agg(F.sum("n").alias("given"))
    short = shares.join(given, "skey", "left").withColumn("given", F.coalesce("given", F.lit(0))).where(F.col("given") < need)
    tail = short.select(
        "skey", F.col("rank").alias("source_rank"), F.col("given"), F.explode(F.sequence(F.col("given"), need - 1)).alias("rank")
    ).select((F.lit(slots) + (F.col("rank") - F.col("given")) * all_["sources"] + F.col("source_rank")).alias("slot"), "skey", "rank")
    both = ranked.unionByName(tail).join(shares.select("skey", "take"), "skey")
    words = F.least(F.lit(block_words), F.col("take") - F.col("rank") * block_words)
    return both.withColumn("words", words).where("words > 0").select("slot", "skey", "rank", "words")


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """The documents cut at the blocks of their source's stream, once for each repeat the target reaches."""
    live = placed.where((F.col("size") > 0) & (F.col("place") < F.col("take")))
    epochs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("take") - F.col("place") - 1) / F.col("source_size")))
    out = live.withColumn("epoch", F.explode(epochs)).withColumn("begin", F.col("place") + F.col("epoch") * F.col("source_size"))
    block = F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words))
    out = out.withColumn("rank", F.explode(block))
    return out.withColumn("from", F.greatest("begin", F.col("rank") * block_words)).withColumn(
        "upto", F.least(F.col("begin") + F.col("size"), (F.col("rank") + 1) * block_words)
    )


def mix(docs: DataFrame, block_words: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The mix: ``(documents, spans)``.

    ``documents`` has one row per input row: doc_id, size (words; null text: 0), source_size, target, taken
    (words in the mix, repeats counted), copies (repeats that start in the mix). ``spans`` has what each slot holds:
    slot, doc_id, first_word and words. Null sources are one source; null ids and repeated rows are rows like
    others (rows alike in id, size and text may trade places); texts without words take none, with
    ``copies`` 1 where their place lies in the mix; no rows give no rows. Only doc_id, source and text are read.
    Sizes and targets are whole-corpus sums; shuffles carry narrow rows, never texts.
    """
    placed, sources = streams(docs)
    placed = kept(placed, "mix-placed")
    slots = schedule(sources, block_words)
    cut = pieces(placed, block_words).join(slots, ["skey", "rank"])
    cut = cut.withColumn("n", F.least("upto", F.col("rank") * block_words + F.col("words")) - F.col("from")).where("n > 0")
    spans = cut.select("slot", "doc_id", (F.col("from") - F.col("begin")).alias("first_word"), F.col("n").alias("words"))
    row = ["skey", "bucket", "no"]
    taken = cut.groupBy(*row).agg(F.sum("n").alias("taken"), F.count_distinct("epoch").alias("copies"))
    out = placed.join(taken, row, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("copies", F.when((F.col("size") == 0) & (F.col("place") <= F.col("take")), 1).otherwise(0)).cast("long").alias("copies"),
        "skey", "crc",
    )
    return out, spans


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole, each as often as a repeat of it starts in the mix; all columns."""
    marks, _ = mix(docs)
    id_, key, crc, copies, rows, copy = free(docs, "id", "key", "crc", "copies", "rows", "copy")
    many = marks.where("copies > 0").groupBy(F.col("doc_id").alias(id_), F.col("skey").alias(key), F.col("crc").alias(crc))
    many = many.agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    here = [
        docs["doc_id"].eqNullSafe(F.col(id_)), key_text(docs["source"]) == F.col(key),
        F.crc32(F.coalesce(docs["text"], F.lit(""))) == F.col(crc),
    ]
    # rows alike in id, source and text share their copies evenly, rounded up
    out = docs.join(many, here).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(copies) / F.col(rows)))))
    return out.select(*[docs[c] for c in docs.columns])
