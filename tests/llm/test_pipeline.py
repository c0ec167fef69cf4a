"""The corpus pipeline: each stage against a plain form of its rule, on the smallest tables."""

from collections import Counter

import pytest

import corpus_pipeline
from tracelode.llm import op6_quality
from tracelode.llm.common import kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = kept(stage(spark, docs, SF), "test-stage")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(spark, steps):
    assert [s for s, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding",
    ]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for _, after in steps[:-1])


def test_quality_stage(spark, steps):
    before, after = steps[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = op6_quality.score(before, op6_quality.train(before, labels)).collect()
    assert ids(after) == Counter(r.doc_id for r in scores if r.score >= 0.5)


def shingles(text, k):
    w = text.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def test_near_duplicate_stage(steps):
    before, after = steps[1]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    sets, parent = [shingles(r.text, 5) for r in rows], list(range(len(rows)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert ids(after) == Counter(r.doc_id for i, r in enumerate(rows) if find(i) == i)


def test_leak_stage(spark, steps):
    before, after = steps[2]
    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = Counter()
    for r in before.collect():
        own = shingles(r.text, 5)
        clean[r.doc_id] += not any(10 * len(s & own) >= 8 * len(s) for s in items)
    assert ids(after) == +clean


def test_mixing_and_sharding_stages(spark, steps):
    before, after = steps[3]
    words = {r.doc_id: len(r.text.split()) for r in before.collect()}
    many = ids(after)
    assert set(many) <= set(words) and max(many.values()) <= 3
    total = sum(words[d] * n for d, n in many.items())
    assert abs(total - sum(words.values())) <= 20 * max(words.values())
    assert ids(steps[4][1]) == many
    assert ids(corpus_pipeline.run(spark, SF)) == many
