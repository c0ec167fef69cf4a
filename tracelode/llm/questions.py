"""The corpus queries registered for the driver, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.runtime import scratch
from . import op1_lines, op2_licenses, op3_sharding, op4_embeddings, op5_toxicity, op6_quality, op7_token_counts, op8_mixing, op9_jaccard, op10_decontaminate, op11_conversations, op12_backoff, op13_lexical
from .common import kept, table, text_id
from .oracles import oracles  # noqa: F401

Question = Callable[[SparkSession, str], DataFrame]


def op1_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return op1_lines.line_counts(table(spark, sf, "documents"))


def op2_license_units(spark: SparkSession, sf: str) -> DataFrame:
    return op2_licenses.scan(table(spark, sf, "documents"))


def op3_sharding_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return op3_sharding.shard(table(spark, sf, "documents"))


def op4_embedding_links(spark: SparkSession, sf: str) -> DataFrame:
    return op4_embeddings.near_duplicates(table(spark, sf, "embeddings"))


def op5_toxicity_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return op5_toxicity.score(docs, op5_toxicity.train(docs, table(spark, sf, "labels")))


def op6_quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return op6_quality.score(docs, op6_quality.train(docs, table(spark, sf, "labels")))


def op7_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Totals after three batches: every document; exact copies (all but the smallest doc_id) deleted; documents in other
    languages than English recounted with the multilingual vocabulary. Each batch is committed twice."""
    docs = table(spark, sf, "documents")
    rollup = op7_token_counts.Rollup(spark, scratch(spark, "token-rollup"))
    counted = op7_token_counts.count_tokens(docs, op7_token_counts.VOCABULARY, "byte_bpe_50k")
    keyed = docs.select("doc_id", text_id(F.col("text")).alias("key"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first"))
    copies = kept(keyed.join(first, "key").where("doc_id > first").select("doc_id"), "copies")
    other = docs.join(copies, "doc_id", "left_anti").where("lang <> 'en'")
    recounted = op7_token_counts.count_tokens(other, op7_token_counts.MULTILINGUAL, "byte_bpe_multi_50k")
    for _ in range(2):
        rollup.commit("1-all", inserts=counted)
        rollup.commit("2-copies", deletes=copies)
        rollup.commit("3-multilingual", inserts=recounted, deletes=other.select("doc_id"))
    return rollup.totals()


def op8_mixing_words(spark: SparkSession, sf: str) -> DataFrame:
    return op8_mixing.mix(table(spark, sf, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard_classes(spark: SparkSession, sf: str) -> DataFrame:
    return op9_jaccard.jaccard_classes(table(spark, sf, "documents"))


def op10_benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return op10_decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return op11_conversations.forked_trie(table(spark, sf, "conversations")).drop("turn_id")


def op12_backoff_scores(spark: SparkSession, sf: str) -> DataFrame:
    return op12_backoff.score(table(spark, sf, "documents"))


def op13_lexical_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return op13_lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def questions() -> dict[str, Question]:
    found = [
        op1_line_counts, op2_license_units, op3_sharding_bytes, op4_embedding_links, op5_toxicity_scores, op6_quality_scores, op7_token_rollup, op8_mixing_words,
        op9_jaccard_classes, op10_benchmark_leaks, op11_conversation_trie, op12_backoff_scores, op13_lexical_ranks,
    ]
    return {fn.__name__: fn for fn in found}
