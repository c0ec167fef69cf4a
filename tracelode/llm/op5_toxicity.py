"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words; the document's is the
noisy-or of its sentences, and only document labels train the word weights. The same weights then say which
sentences offend.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learned, textgrams

BITS = 20
PER_CLASS = 2500
STEPS, RATE, DECAY, SLOW, PRIOR = 200, 0.5, 0.3, 25.0, -6.0
#: A feature is used if its share among toxic documents is so many standard errors above that among clean ones.
SIGNIFICANCE = 4.0
PREFIXES, GRAM = (3, 4, 6), 5
_ENDS = np.zeros(256, np.int64)
_ENDS[[ord(c) for c in ".!?|\n\r"]] = 1


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, textgrams.Words]:
    """``(feature, sentence, first_word, first_sentence, words)`` of the texts.

    A sentence ends with one of ``. ! ? |`` or a line break; only those with a word count. Features of a sentence are
    its words, their first bytes (PREFIXES of them) and all runs of GRAM bytes within words, hashed.
    """
    w = textgrams.words(texts, textgrams.LETTERS)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    ends = np.cumsum(_ENDS[w.raw])[w.start] if len(w.start) else np.zeros(0, np.int64)
    new = np.ones(len(w.start), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (row[1:] != row[:-1])
    first_word = np.flatnonzero(new)
    first_sentence = np.searchsorted(row[first_word], np.arange(len(w.first)))
    of_word = np.cumsum(new) - 1
    length = w.end - w.start
    feature, sentence = [w.hash], [of_word]
    for k in PREFIXES:
        longer = np.flatnonzero(length > k)
        feature.append(w.span(w.start[longer], w.start[longer] + k) ^ np.uint64(k))
        sentence.append(of_word[longer])
    many = np.maximum(length - GRAM + 1, 0)
    at = np.arange(many.sum()) + np.repeat(w.start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) if len(many) else w.start
    feature.append(w.span(at, at + GRAM) ^ np.uint64(99))
    sentence.append(np.repeat(of_word, many))
    hashed = (np.concatenate(feature) >> np.uint64(64 - BITS)).astype(np.int64)
    return hashed, np.concatenate(sentence), np.append(first_word, len(w.start)), first_sentence, w


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[first])


def probability(logit: np.ndarray, first_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each sentence, and by noisy-or of each text (0 without sentences)."""
    p = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
    return p, -np.expm1(_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), first_sentence))


def fit(texts: list[str], labels: np.ndarray) -> bytes:
    """Feature weights (the last is the sentence bias) that maximise the likelihood of the document labels.

    Features that do not stand out among the toxic documents have weight 0. Without both classes every weight is 0 and the
    bias says which class there was (toxic only without any clean document).
    """
    size = 1 << BITS
    weight = np.zeros(size + 1)
    weight[size] = -30.0
    if len(labels) and (labels == 1).all():
        weight[size] = 30.0
    if len(set(labels.tolist())) == 2:
        toxic, parts, counts = labels == 1, [], np.zeros((2, size))
        for at, part in textgrams.slices(pa.array(texts, pa.large_string())):
            f, sentence, _, first, _ = sentences(part)
            row = np.searchsorted(first, sentence, side="right") - 1
            pairs = np.unique(row << BITS | f)
            for c in (0, 1):
                counts[c] += np.bincount(pairs[toxic[at + (pairs >> BITS)] == c] & (size - 1), minlength=size)
            parts.append((f, sentence, first))
        n0, n1 = (~toxic).sum(), toxic.sum()
        share = counts.sum(0) / (n0 + n1)
        z = (counts[1] / n1 - counts[0] / n0) / np.sqrt(np.maximum(share * (1 - share) * (1 / n0 + 1 / n1), 1e-12))
        chosen = z > SIGNIFICANCE
        words, sentence, first_sentence = [], [], [0]
        for f, s, first in parts:
            known = chosen[f]
            words.append(f[known])
            sentence.append(s[known] + first_sentence[-1])
            first_sentence += (first[1:] + first_sentence[-1]).tolist()
        used, words = np.unique(np.concatenate(words), return_inverse=True)
        sentence, first_sentence = np.concatenate(sentence), np.array(first_sentence)
        owner = np.repeat(np.arange(len(labels)), np.diff(first_sentence))
        n, w, b = int(first_sentence[-1]), np.zeros(len(used)), PRIOR
        square_w, square_b = np.full(len(used), SLOW), 1e-8
        for _ in range(STEPS):
            p, doc = probability(np.bincount(sentence, w[words], n) + b, first_sentence)
            # d(-log likelihood) / d(logit): p for a clean document, -p (1 - P) / P for a toxic one
            pull = np.where(toxic, -(1 - doc) / np.maximum(doc, 1e-9), 1.0)
            g = p * pull[owner]
            gw, gb = np.bincount(words, g[sentence], len(used)) + DECAY * w, g.sum()
            square_w += gw**2
            square_b += gb**2
            w -= RATE * gw / np.sqrt(square_w)
            b -= RATE * gb / np.sqrt(square_b)
        weight[used], weight[size] = w, b
    out = io.BytesIO()
    np.savez(out, weight=weight.astype(np.float32))
    return out.getvalue()


def _weights(model: bytes) -> tuple[np.ndarray, float]:
    weight = np.load(io.BytesIO(model))["weight"].astype(np.float64)
    return weight[:-1], weight[-1]


def rated(weight: np.ndarray, bias: float, texts: pa.Array):
    """Probabilities of the sentences and texts, each sentence's first word, each text's first sentence, and the words."""
    f, sentence, first_word, first_sentence, w = sentences(texts)
    value = weight[f]
    hit = np.flatnonzero(value)
    p, doc = probability(np.bincount(sentence[hit], value[hit], len(first_word) - 1) + bias, first_sentence)
    return p, doc, first_word, first_sentence, w


def scorer(model: bytes):
    """A function from texts to ``score, n_sentences, worst_sentence, worst_score``, for use in a task."""

    def make():
        weight, bias = _weights(model)

        def score(texts: pa.Array) -> dict[str, np.ndarray]:
            p, doc, _, first_sentence, _ = rated(weight, bias, texts)
            many = np.diff(first_sentence)
            worst = np.full(len(many), -1, np.int64)
            row = np.repeat(np.arange(len(many)), many)
            order = np.lexsort((-np.arange(len(p)), p, row))  # the last of each row is its first highest
            worst[many > 0] = order[first_sentence[1:][many > 0] - 1]
            top = np.where(many > 0, np.append(p, 0.0)[worst], 0.0)
            return {"score": doc, "n_sentences": many, "worst_sentence": np.where(many > 0, worst - first_sentence[:-1], -1), "worst_score": top}

        return score

    return make


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, fold: int = 0, per_class: int = PER_CLASS) -> bytes:
    """A model from at most ``per_class`` labelled documents of each class whose crc32(doc_id) mod ``mod`` is not ``fold``."""
    return learned.fitted(learned.sample(docs, labels, "toxic", mod, fold, per_class), fit)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score, n_sentences, worst_sentence (from 0), worst_score and predicted for every row.

    Only the text decides. Null, empty and wordless texts have no sentence: score 0, worst_sentence -1. Null ids
    are not held out; repeated rows are rows like others; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select("doc_id", F.coalesce(learned.remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")
    out = learned.scored(
        named, lambda: scorer(shared.value)(), ["doc_id", "held_out"], "score double, n_sentences long, worst_sentence long, worst_score double"
    )
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def offending(docs: DataFrame, model: bytes, least: float = 0.5) -> DataFrame:
    """Sentences with a probability of at least ``least``: doc_id, first_byte, end_byte, score, sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = _weights(shared.value)
        for batch in batches:
            for at, part in textgrams.slices(batch.column(1)):
                p, _, first_word, first_sentence, w = rated(weight, bias, part)
                hit = np.flatnonzero(p >= least)
                row = np.searchsorted(first_sentence, hit, side="right") - 1
                begin, end = w.start[first_word[hit]], w.end[first_word[hit + 1] - 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at + row)), pa.array(begin - w.bounds[row]), pa.array(end - w.bounds[row]),
                        pa.array(p[hit]), pa.array([w.raw[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)], pa.string()),
                    ],
                    ["doc_id", "first_byte", "end_byte", "score", "sentence"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, first_byte long, end_byte long, score double, sentence string")
