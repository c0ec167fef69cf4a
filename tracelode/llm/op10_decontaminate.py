"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by the power of two of their number of shingles. An item's signature is the
bottom-k MinHash sketch of its shingles with k set by its partition's largest size, so that a document holding the
asked share of the item must hold one of the k shingles: with m of n shingles allowed to miss, any m + 1 of them meet
it. Documents that share a signature shingle and are long enough are compared on all shingles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, free, kept, small, text_id

SHINGLE = 5


def norm_words(text: Column) -> Column:
    """Lower-case (A-Z) words between white space; an empty array without any."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def _cut(split: DataFrame, keep: Sequence[str], width: int) -> DataFrame:
    split = split.where(F.size("w") >= width).withColumn("n_all", F.size("w") - (width - 1))
    shifted = [F.slice("w", i + 1, F.col("n_all")).alias(f"w{i}") for i in range(width)]
    rows = split.select(*keep, "n_all", F.explode(F.arrays_zip(*shifted)).alias("s"))
    return rows.select(*keep, "n_all", F.xxhash64(*[F.col(f"s.w{i}") for i in range(width)]).alias("shingle"))


def shingle_rows(df: DataFrame, *keep: str, widths: Sequence[int] = (SHINGLE,)) -> DataFrame:
    """``keep`` columns with ``shingle``, the 64-bit hash of each run of so many words of ``text``, repeats included,
    and ``n_all``, how many runs of that width there are."""
    split = df.select(*keep, norm_words(F.col("text")).alias("w"))
    return reduce(DataFrame.unionByName, [_cut(split, keep, k) for k in widths])


def short_widths(items: DataFrame) -> list[int]:
    """Numbers of words, below five, that items have: at most four numbers."""
    n = items.select(F.size(norm_words(F.col("text"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < SHINGLE))
    return sorted(r["n"] for r in n.distinct().collect())


def signatures(items: DataFrame, threshold: float, short: Sequence[int] = ()) -> tuple[DataFrame, DataFrame]:
    """``(shingles, signatures)`` of the items: item_no, item_id, shingle, n; the second with sketches only.

    An item of fewer than five words is one shingle of its own width, one of ``short``.
    """
    keep = ["item_id", "item_no"]
    split = items.where("text is not null").select(*keep, norm_words(F.col("text")).alias("w"))
    parts = [_cut(split, keep, SHINGLE), *[_cut(split.where(F.size("w") == k), keep, k) for k in short]]
    own = reduce(DataFrame.unionByName, parts).drop("n_all").distinct()
    sizes = own.groupBy("item_no").agg(F.count(F.lit(1)).alias("n"))
    own = kept(own.join(sizes, "item_no"), "bench-shingles")
    partition = F.ceil(F.log2(F.col("n")))
    largest = own.withColumn("partition", partition).groupBy("partition").agg(F.max("n").alias("u"))
    # the sketch of a partition is the one that its largest member needs
    k = F.col("u") - F.ceil(F.lit(threshold) * F.col("u") - 1e-9) + 1
    order = F.row_number().over(Window.partitionBy("item_no").orderBy(F.xxhash64("shingle"), "shingle"))
    sketch = own.withColumn("partition", partition).join(largest, "partition").withColumn("at", order).where(F.col("at") <= k)
    return own, kept(sketch.select("item_no", "shingle", "n"), "bench-signatures")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs ``text_key, item_no, item_id, n_shingles, n_found``: distinct texts that hold at least ``threshold`` of an item.

    ``text_key`` is the hash of the whole text. An item of fewer than five words is one shingle: a text holds it where its words
    follow each other (for such items texts are cut at their widths too). Null texts and texts without words hold nothing and are held by
    none; repeated items are reported each. Item sketches are broadcast
    while their counted rows stay within a bound; beyond that the join shuffles hashes.
    """
    # equal items are searched once
    items = benchmark.select("item_id", "text", text_id(F.col("text")).alias("item_no"))
    distinct = items.groupBy("item_no").agg(F.first("text").alias("text"), F.first("item_id").alias("item_id"))
    short = short_widths(distinct)
    widths = (SHINGLE, *short)
    shingles, sketches = signatures(distinct, threshold, short)
    named = docs.select("text", text_id(F.col("text")).alias("text_key"))
    met = shingle_rows(named, "text_key", widths=widths).join(small(sketches), "shingle")
    met = met.where(F.col("n_all") >= F.lit(threshold) * F.col("n") - 1e-9)
    candidates = kept(met.select("text_key", "item_no").distinct(), "bench-candidates")
    # exact: the shingles of candidate texts only, distinct per text
    texts = named.join(small(candidates.select("text_key").distinct()), "text_key", "left_semi")
    found = shingle_rows(texts, "text_key", widths=widths).join(small(shingles), "shingle").select("text_key", "item_no", "n", "shingle").distinct()
    found = found.groupBy("text_key", "item_no").agg(F.count(F.lit(1)).alias("n_found"), F.first("n").alias("n_shingles"))
    found = found.join(candidates, ["text_key", "item_no"], "left_semi").where(F.col("n_found") >= F.lit(threshold) * F.col("n_shingles") - 1e-9)
    return found.join(items.select("item_no", "item_id"), "item_no")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_shingles, n_found (distinct shingles).

    Repeated documents and items give repeated rows; null ids stay null.
    """
    pairs = kept(contaminated(docs, benchmark, threshold), "bench-pairs")
    keyed = docs.select("doc_id", text_id(F.col("text")).alias("text_key"))
    return keyed.join(pairs, "text_key").select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that hold no item, with all their columns, in rows as they come: repeated rows, null and empty texts stay."""
    (key,) = free(docs, "text_key")
    bad = kept(contaminated(docs, benchmark, threshold).select(F.col("text_key").alias(key)).distinct(), "bench-texts")
    return docs.join(bad, text_id(docs["text"]) == F.col(key), "left_anti")
