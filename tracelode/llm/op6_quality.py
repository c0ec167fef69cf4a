"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log-count ratios of the classes; a linear hinge-loss model on the
scaled, unit-length rows is fitted by dual coordinate descent and interpolated with its mean magnitude.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learned, textgrams

BITS = 18
PER_CLASS = 2000
SMOOTHING, COST, EPOCHS, INTERPOLATION = 1.0, 1.0, 20, 0.25


def grams(w: textgrams.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, and the index of each text's first one, with the end.

    N-grams of one and two words, and of one to three word shapes: length, capitals, last
    character, and whether the word repeats the one or two before it.
    """
    n, rows = len(w.hash), len(w.first) - 1
    row = np.repeat(np.arange(rows), np.diff(w.first))
    same = lambda k: np.concatenate([np.zeros(min(k, n), bool), (w.hash[k:] == w.hash[:-k]) & (row[k:] == row[:-k])])
    capital = lambda at: (w.raw[np.minimum(at, w.end - 1)] - 65 < 26) if n else np.zeros(0, bool)
    last = w.raw[w.end - 1].astype(np.uint64)
    letter = (last >= 128) | ((last | 32) - 97 < 26)
    shape = np.minimum(w.end - w.start, 15).astype(np.uint64) | np.where(letter, 0, last).astype(np.uint64) << np.uint64(8)
    for bit, flag in enumerate((capital(w.start), capital(w.start + 1), same(1), same(2))):
        shape |= flag.astype(np.uint64) << np.uint64(16 + bit)
    shape = textgrams.mix(shape + np.uint64(1))
    found = [(row, w.hash), (row, shape ^ np.uint64(0xA5A5))]
    with np.errstate(over="ignore"):
        for base, sizes in ((w.hash, (2,)), (shape, (2, 3))):
            for k in sizes:
                if n >= k:
                    h = base[: n - k + 1].copy()
                    for i in range(1, k):
                        h = textgrams.mix(h * np.uint64(31) + base[i : n - k + 1 + i])
                    whole = row[: n - k + 1] == row[k - 1 :]
                    found.append((row[: n - k + 1][whole], h[whole]))
    key = np.unique(np.concatenate([r << BITS | (textgrams.mix(h) >> np.uint64(64 - BITS)).astype(np.int64) for r, h in found]))
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(rows + 1))


def descend(index: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, size: int) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent over unit-length sparse rows."""
    w, alpha, shuffle = np.zeros(size), np.zeros(len(y)), np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in shuffle.permutation(len(y)):
            at, x = index[i], value[i]
            gradient = y[i] * (w[at] @ x) - 1.0
            new = min(max(alpha[i] - gradient, 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * y[i] * x
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def fit(texts: list[str], labels: np.ndarray) -> bytes:
    """Tables of a model: per n-gram its ratio, and its ratio times its weight; then slope and shift of the score.

    Without both classes the score is constant: the share of label 1, or a half without any row.
    """
    size = 1 << BITS
    ratio, theta, bias = np.zeros(size), np.zeros(size), 0.0
    y = np.where(labels == 1, 1.0, -1.0)
    index: list[np.ndarray] = []
    for _, part in textgrams.slices(pa.array(texts, pa.large_string())) if texts else ():
        at, first = grams(textgrams.words(part))
        index += [at[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    slope = 0.0
    if len(set(y)) == 2:
        count = {c: np.bincount(np.concatenate([x for x, t in zip(index, y, strict=True) if t == c]), minlength=size) + SMOOTHING for c in (1.0, -1.0)}
        ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
        seen = count[1.0] + count[-1.0] > 2 * SMOOTHING
        ratio[~seen] = 0.0
        value = [ratio[x] / max(np.linalg.norm(ratio[x]), 1e-12) for x in index]
        w = descend(index, value, y, COST, EPOCHS, size)
        w = (1 - INTERPOLATION) * np.abs(w).sum() / max(seen.sum(), 1) + INTERPOLATION * w
        theta = ratio * w
        margin = np.array([theta[x] @ np.ones(len(x)) / max(np.linalg.norm(ratio[x]), 1e-12) for x in index])
        # threshold in the middle of the classes, slope from their distance
        centre = {c: np.median(margin[y == c]) for c in (1.0, -1.0)}
        cuts = np.unique(margin)
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        cuts = cuts[:: max(1, len(cuts) // 2000)]
        wrong = np.array([(margin[y == 1] < c).mean() + (margin[y == -1] >= c).mean() for c in cuts])
        best = cuts[wrong <= wrong.min() + 1e-12]
        bias, slope = -float(np.median(best)), 6.0 / max(abs(centre[1.0] - centre[-1.0]), 1e-9)
    elif len(y):
        bias = float((y[0] == 1) * 2 - 1) * 20
        slope = 1.0
    out = io.BytesIO()
    np.savez(out, ratio=ratio.astype(np.float32), theta=theta.astype(np.float32), line=np.array([bias, slope]))
    return out.getvalue()


def scorer(model: bytes):
    """A function from texts to ``score``, for use in a task."""

    def make():
        m = np.load(io.BytesIO(model))
        ratio2, theta, (bias, slope) = m["ratio"].astype(np.float64) ** 2, m["theta"].astype(np.float64), m["line"]

        def score(texts: pa.Array) -> dict[str, np.ndarray]:
            at, first = grams(textgrams.words(texts))
            sums = [np.concatenate([[0.0], np.cumsum(t[at])])[first] for t in (theta, ratio2)]
            margin = np.diff(sums[0]) / np.sqrt(np.maximum(np.diff(sums[1]), 1e-12))
            return {"score": 1.0 / (1.0 + np.exp(-np.clip(slope * (margin + bias), -30, 30)))}

        return score

    return make


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, fold: int = 1, per_class: int = PER_CLASS) -> bytes:
    """A model from at most ``per_class`` labelled documents of each class whose crc32(doc_id) mod ``mod`` is not ``fold``."""
    return learned.fitted(learned.sample(docs, labels, "quality", mod, fold, per_class), fit)


def _shared(docs: DataFrame, model: bytes):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2 ** BITS floats
    return lambda: scorer(shared.value)()


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Only the text decides the score. Null and empty texts have no n-gram and get the score at margin 0;
    null ids are not held out; repeated rows and labels for unknown ids do no harm; other columns are not read.
    """
    named = docs.select("doc_id", F.coalesce(learned.remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    out = learned.scored(named, _shared(docs, model), ["doc_id", "held_out"], "score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: bytes) -> DataFrame:
    """The documents that the model does not reject (score at least a half), with all columns."""
    return learned.passing(docs, _shared(docs, model), "score", 0.5)
