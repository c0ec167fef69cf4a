"""The pipeline's near-duplicate stage at its rule, and the Jaccard join at other arguments, by brute force."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus  # noqa: E402
import corpus_pipeline  # noqa: E402
from tracelode.llm import op9_jaccard  # noqa: E402

SF = "/root/testdata/sf0.001"


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_near_duplicate_stage_rule(spark):
    """Five words and similarity 0.8, where three words and 0.9 keep some of the copies."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(df.collect(), key=lambda r: r.doc_id)

    def linked(k, percent):
        sets = [corpus.shingles(r.text, k) for r in rows]
        return [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]

    near = linked(5, 80)
    assert set(near) - set(linked(3, 90)), "the table holds pairs that only the stage's rule links"
    group = corpus.classes(len(rows), near)
    assert ids(corpus_pipeline.near_duplicates(spark, df, SF)) == Counter(r.doc_id for i, r in enumerate(rows) if group[i] == i)


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (3, 90), (2, 60)])
def test_jaccard_arguments(spark, shingle, percent):
    rng = random.Random(8)
    texts = [corpus.prose(rng, 120) for _ in range(6)]
    texts += [corpus.changed(rng, t, share) for t in texts for share in (0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(2)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    sets = [corpus.shingles(t, shingle) for t in texts]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = [(i, len(sets[i]), g) for i, g in enumerate(corpus.classes(len(rows), pairs))]
    df = corpus.frame(spark, rows)
    assert corpus.bag(op9_jaccard.jaccard_classes(df, shingle, percent).collect()) == corpus.bag(want)


def test_all_links(spark):
    """The join form has the links inside a component too, and a number of links per row."""
    df = corpus.frame(spark)
    rows = df.collect()
    sets = [corpus.shingles(r.text, 3) for r in rows]
    near = lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])
    want = [(r.doc_id, sum(bool(near(i, j)) for j in range(len(rows)) if i != j)) for i, r in enumerate(rows)]
    assert corpus.bag(op9_jaccard.link_counts(df).collect()) == corpus.bag(want)
    of_text = {r.text: bytes(r.id) for r in df.selectExpr("text", "unhex(md5(text)) AS id").distinct().collect() if r.id is not None}
    pairs = {(min(a, b), max(a, b)) for i, x in enumerate(rows) for j, y in enumerate(rows[:i]) if near(i, j) and x.text != y.text for a, b in [(of_text[x.text], of_text[y.text])]}
    signatures, found = op9_jaccard.linked_pairs(df)
    got = [(bytes(r.a), bytes(r.b)) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 20
    assert signatures.count() == len(rows)
    assert op9_jaccard.link_counts(corpus.frame(spark, [])).count() == 0
