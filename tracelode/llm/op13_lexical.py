"""Ranked lexical search: term at a time with a limited set of accumulators.

Terms of an item are taken rarest first. While a document not yet seen could still reach the k-th best partial
score with all the terms that remain, each term opens accumulators for new documents; from then on only the open ones
are continued, exactly. Documents are searched slice by slice; each task carries its best k of every item on, so
later slices start with a higher bar, and the tasks' lists are ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept
from .textgrams import byte_table, slices, words

#: Letters and digits of ASCII and all bytes beyond it; the rest separates terms.
TERMS = byte_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Terms of items that go to every task at once (8 bytes each, with their places some 40).
BATCH_TERMS = 200_000
SCALE = 1_000_000_000


@dataclass
class Slice:
    """Postings of some documents for the searched terms, by term, then document."""

    size: np.ndarray  # terms of each document
    term: np.ndarray
    doc: np.ndarray
    tf: np.ndarray


def item_terms(items: DataFrame) -> DataFrame:
    """``no, item_id, terms``: the distinct term hashes of each item. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in slices(batch.column(2)):
                w = words(part, TERMS)
                terms = [np.unique(w.hash[a:b]).view(np.int64) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                ids = batch.slice(row, len(part))
                yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), pa.array(terms, pa.list_(pa.int64()))], ["no", "item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    plain = items.select(F.monotonically_increasing_id().alias("no"), "item_id", "text")
    return kept(plain.mapInArrow(run, f"no long, item_id {kind}, terms array<long>"), "lex-items")


def _postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """A row for each slice of documents: their ids, sizes and postings of ``terms`` (sorted), kept as a table."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for row, part in slices(batch.column(1)):
                w = words(part, TERMS)
                at = np.minimum(np.searchsorted(known, w.hash), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[at] == w.hash) if len(known) else np.zeros(0, np.int64)
                doc = np.searchsorted(w.first, hit, side="right") - 1
                pair, tf = np.unique(at[hit] * len(part) + doc, return_counts=True)
                made = Slice(np.diff(w.first), pair // len(part), pair % len(part), tf)
                ids = batch.column(0).slice(row, len(part))
                packed = [a.astype(t).tobytes() for a, t in ((made.size, np.int64), (made.term, np.int32), (made.doc, np.int32), (made.tf, np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([p], pa.binary()) for p in packed)],
                    ["ids", "size", "term", "doc", "tf"],
                )

    made = docs.select("doc_id", "text").mapInArrow(run, f"ids array<{kind}>, size binary, term binary, doc binary, tf binary")
    out = kept(made, "lex-postings")
    shared.destroy()
    return out


def _unpacked(batch: pa.RecordBatch, row: int) -> Slice:
    size, term, doc, tf = (batch.column(n)[row].as_py() for n in ("size", "term", "doc", "tf"))
    return Slice(np.frombuffer(size, np.int64), *(np.frombuffer(b, np.int32).astype(np.int64) for b in (term, doc, tf)))


def _statistics(postings: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of each term, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                s = _unpacked(batch, row)
                df[:n_terms] += np.bincount(s.term, minlength=n_terms)
                df[n_terms:] += (s.size > 0).sum(), s.size.sum()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "n"])

    found = postings.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(n_terms + 2, np.int64)
    for r in found:
        total[r.term] = r.n
    return int(total[n_terms]), int(total[n_terms + 1]), total[:n_terms]


def term_at_a_time(order: np.ndarray, impacts: list[np.ndarray], docs: list[np.ndarray], n_docs: int, k: int, bar: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(documents, scores)`` of one slice that can be among the best ``k`` with a score of at least ``bar``.

    ``order`` lists the item's terms rarest first, with ``impacts`` and ``docs`` of each term's postings. Once what remains
    is under the k-th partial score (or the bar) no accumulator is opened any more; all that are open become exact.
    """
    score, is_open = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    bounds = np.array([int(impacts[t].max()) if len(impacts[t]) else 0 for t in order], np.int64)
    remaining = np.cumsum(bounds[::-1])[::-1]
    opening = True
    for i, t in enumerate(order):
        if opening:
            least = bar
            held = score[is_open]
            if len(held) >= k:
                least = max(least, int(np.partition(held, len(held) - k)[len(held) - k]))
            opening = remaining[i] >= least
        here, value = docs[t], impacts[t]
        if opening:
            is_open[here] = True
        else:
            known = is_open[here]
            here, value = here[known], value[known]
        score[here] += value  # a term lists each document once
    best = np.flatnonzero(is_open & (score > 0) & (score >= bar))
    return best, score[best]


def _best(postings: DataFrame, items: list[tuple[int, np.ndarray]], weight: np.ndarray, rarest: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """Each task's best documents of every item: ``no, doc_id, score``."""
    context = postings.sparkSession.sparkContext
    shared = context.broadcast((items, weight, rarest))
    kind = postings.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, w, place = shared.value
        top: dict[int, tuple[list, np.ndarray]] = {}
        kinds = pa.int64()
        for batch in batches:
            kinds = batch.schema.field("ids").type.value_type
            for row in range(batch.num_rows):
                s = _unpacked(batch, row)
                ids = batch.column("ids")[row].values
                m = 100 - 50 + (50 * s.size * n) // max(length, 1)
                impact = w[s.term] * ((SCALE * s.tf) // (1000 * s.tf + 20 * m[s.doc]))
                cut = np.searchsorted(s.term, np.arange(len(w) + 1))
                doc_of, impact_of = np.split(s.doc, cut[1:-1]), np.split(impact, cut[1:-1])
                for no, terms in wanted:
                    old_ids, old = top.get(no, ([], np.zeros(0, np.int64)))
                    bar = int(old.min()) if len(old) >= k else 0
                    order = terms[np.lexsort((terms, place[terms]))]
                    docs, scores = term_at_a_time(order, impact_of, doc_of, len(s.size), k, bar)
                    if len(docs) == 0:
                        continue
                    if len(docs) > k:
                        least = np.partition(scores, len(scores) - k)[len(scores) - k]
                        docs, scores = docs[scores >= least], scores[scores >= least]
                    names = old_ids + ids.take(pa.array(docs)).to_pylist()
                    every = np.concatenate([old, scores])
                    by = sorted(range(len(every)), key=lambda i: (-every[i], names[i] is None, names[i] if names[i] is not None else 0))[:k]
                    top[no] = [names[i] for i in by], every[by]
        for no, (names, scores) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), no, np.int64)), pa.array(names, kinds), pa.array(scores)], ["no", "doc_id", "score"])

    return postings.mapInArrow(run, f"no long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0, equal scores by doc_id
    (null last).

    Items are searched in batches of about ``batch_terms`` terms, each over all documents; a batch's terms and weights
    go to every task, which holds one slice of postings and k rows an item. Null and empty texts have no terms: such documents
    are never found and such items find none. Repeated documents and items are rows of their own. Very long texts are
    slices of their own. Of ``docs`` doc_id and text are read, of ``items`` item_id and text; other columns may have any names.
    """
    queries = item_terms(items)
    sizes = queries.where(F.size("terms") > 0).select("no", F.size("terms").alias("n"))
    batches = -(-int(sizes.agg(F.sum("n")).collect()[0][0] or 0) // batch_terms)
    found = []
    for i in range(batches):
        part = queries.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("no"), F.lit(batches)) == i)).select("no", "terms").collect()
        if not part:
            continue
        hashes = np.unique(np.concatenate([np.array(r.terms, np.int64).view(np.uint64) for r in part]))
        postings = _postings(docs, hashes)
        n, length, df = _statistics(postings, len(hashes))
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        wanted = [(r.no, np.searchsorted(hashes, np.array(r.terms, np.int64).view(np.uint64))) for r in part]
        found.append(kept(_best(postings, wanted, weight, df, n, length, k), "lex-best"))
    if not found:
        kinds = [items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()]
        return docs.sparkSession.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(queries.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")
