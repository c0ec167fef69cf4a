"""Backoff automaton and ranked search against plain Python, with odd rows."""

import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus  # noqa: E402

from tracelode.llm import op12_backoff, op13_lexical  # noqa: E402

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.crowded(corpus.frame(spark)).persist()


# 12. language model


def plain_model(rows, order, mu, mod=7, fold=2):
    counts, n, seen = Counter(), 0, set()
    for doc, text in rows:
        if doc is not None and zlib.crc32(str(doc).encode()) % mod != fold:
            tokens = ["<s>", *corpus.words(text), "</s>"]
            counts[("<s>",)] += 1
            n, seen = n + len(tokens) - 1, seen | set(tokens[1:])
            for i in range(1, len(tokens)):
                for k in range(1, min(order, i + 1) + 1):
                    counts[tuple(tokens[i - k + 1 : i + 1])] += 1
    everything = n + len(seen) + 1

    def p(context, token):
        if not context:
            return (counts[(token,)] + 1) / everything
        pseudo, low = mu[min(len(context) + 1, len(mu) + 1) - 2], p(context[1:], token)
        return (counts[(*context, token)] + pseudo * low) / (counts[context] + pseudo) if counts[context] else low

    return counts, n, everything, seen, p


@pytest.mark.parametrize(("order", "block", "strand"), [(1, 1 << 20, 2048), (2, 500, 7), (3, 700, 16), (4, 20, 2048)])
def test_backoff_brute_force(spark, docs, order, block, strand, monkeypatch):
    monkeypatch.setattr(op12_backoff, "STRAND", strand)
    monkeypatch.setattr(op12_backoff, "RANGE_GRAMS", 1 << 12)
    mu = (3.0, 1.5)
    some = docs.where("length(text) < 3000 or text is null or doc_id is null") if block == 20 else docs
    rows = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()]
    counts, n, everything, _, p = plain_model(rows, order, mu)
    got = op12_backoff.score(some, order=order, mu=mu, block_tokens=block).collect()
    want = []
    for doc, text in rows:
        tokens = ["<s>", *corpus.words(text), "</s>"]
        held = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2
        base = sum(math.log10((counts[(t,)] + 1) / everything) for t in tokens[1:])
        score = sum(math.log10(p(tuple(tokens[max(0, i - order + 1) : i]), tokens[i])) for i in range(1, len(tokens)))
        want.append((doc, held, len(tokens) - 1, sum(counts[(t,)] > 0 for t in tokens[1:]), n, round(base, 4), round(score, 4)))
    assert corpus.bag([(*r[:5], round(r.base_score, 4), round(r.score, 4)) for r in got]) == corpus.bag(want)


def test_backoff_adds_up_to_one():
    rows = [(1, "a b a c"), (3, "a b b c d"), (4, "b c")]
    _, _, _, seen, p = plain_model(rows, 3, (2.0, 1.0))
    for context in [("a",), ("a", "b"), ("zz",), ()]:
        assert abs(sum(p(context, t) for t in [*seen, "unknown"]) - 1) < 1e-9


def test_backoff_empty_and_pieces(spark):
    assert op12_backoff.score(corpus.frame(spark, [])).count() == 0
    long = "x" * (3 << 20) + " " + "word, " * 400_000
    cut = list(op12_backoff._word_hashes(pa.array([long])))
    whole = op12_backoff.words(pa.array([long])).hash
    assert len(cut) > 1 and [c[2] for c in cut] == [False] * (len(cut) - 1) + [True]
    assert (np.concatenate([c[1] for c in cut]) == whole).all()
    values = np.array([0, 5, 5, 2**40], np.int64)
    assert (op12_backoff.unpack(op12_backoff.pack(values), np.int64) == values).all() and op12_backoff.unpack(b"", np.int32).size == 0
    assert (op12_backoff.unpack_sorted(op12_backoff.pack_sorted(values), np.int64) == values).all()


def test_backoff_held_out_better_than_base(spark):
    got = op12_backoff.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


# 13. ranked search


def terms(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return regex.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranks(docs, items, k):
    of = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in of]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for item, text in items:
        want = sorted(set(terms(text)))
        df = {t: sum(t in c for _, c in of) for t in want}
        found = []
        for (doc, c), size in zip(of, sizes, strict=True):
            score = 0
            for t in want:
                if c[t]:
                    m = 100 - 50 + (50 * size * n) // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc if doc is not None else 0, doc))
        found.sort(key=lambda x: x[:3])
        out += [(item, i, f[3], -f[0]) for i, f in enumerate(found[:k], 1)]
    return out


@pytest.mark.parametrize(("k", "batch"), [(50, 10**6), (3, 60), (1, 1)])
def test_ranks_brute_force(spark, docs, k, batch, monkeypatch):
    monkeypatch.setattr("tracelode.llm.textgrams.SLICE_BYTES", 2000)  # several slices a task, so the bar is carried on
    items = [(1, "w1 w2, w3. w399"), (2, "W17 w17 x1"), (3, None), (4, ""), (4, "one"), (5, "unheard-of"), (None, "w5 w6"), (7, "w8 " * 5000)]
    frame = corpus.crowded(spark.createDataFrame(items, ITEMS).repartition(3))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = op13_lexical.search(docs, frame, k=k, batch_terms=batch)
    assert corpus.bag(got.collect()) == corpus.bag(plain_ranks(rows, items, k))


def test_ranks_empty(spark, docs):
    none, items = corpus.frame(spark, []), spark.createDataFrame([(1, "w1")], ITEMS)
    assert op13_lexical.search(none, items).count() == 0
    assert op13_lexical.search(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert op13_lexical.search(docs, spark.createDataFrame([(1, None)], ITEMS)).columns == ["item_id", "rank", "doc_id", "score"]


def test_accumulators_stop_and_stay_exact():
    rng = np.random.default_rng(0)
    n, order = 400, np.arange(12)
    docs = [np.sort(rng.choice(n, size=8 * (t + 1), replace=False)) for t in order]
    impacts = [rng.integers(1, 1000 // (t + 1) + 2, len(d)) for t, d in zip(order, docs, strict=True)]
    exact = np.zeros(n, np.int64)
    for d, i in zip(docs, impacts, strict=True):
        exact[d] += i
    found, scores = op13_lexical.term_at_a_time(order, impacts, docs, n, 5)
    assert (scores == exact[found]).all() and len(found) < (exact > 0).sum()
    assert sorted(scores)[-5:] == sorted(exact)[-5:]
