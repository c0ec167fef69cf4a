"""Sets that are alike without being linked are not opened pair by pair, and lose no link."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus  # noqa: E402
from tracelode.llm import op9_jaccard  # noqa: E402


def family(rng, n, words, least, most):
    base = corpus.prose(rng, words).split()
    texts = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(words), rng.randint(least, most)):
            text[at] = f"y{rng.randrange(40)}" if rng.random() < 0.3 else f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
        if i % 9 == 0:  # far from the centre, but near to each other
            texts.append(" ".join(text[1:]))
    return texts


@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80)])
def test_family_pairs_stay_few(spark, monkeypatch, shingle, percent):
    rng = random.Random(5)
    texts = family(rng, 300, 140, 2, 3) + family(rng, 100, 90, 1, 12) + [corpus.prose(rng, 100) for _ in range(40)]
    sets = [corpus.shingles(t, shingle) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = [(i, len(sets[i]), g) for i, g in enumerate(corpus.classes(len(texts), links))]
    pairs = {}

    def kept(df, name, write=op9_jaccard.kept):
        out = write(df, name)
        if name.endswith("pairs"):
            pairs[name] = out.count()
        return out

    monkeypatch.setattr(op9_jaccard, "kept", kept)
    df = corpus.frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    assert corpus.bag(op9_jaccard.jaccard_classes(df, shingle, percent).collect()) == corpus.bag(want)
    # the index alone opened 12,008 and 29,182 pairs here
    assert sum(pairs.values()) < 12 * len(texts), pairs


def test_families_change_no_result(spark, monkeypatch):
    """All alike sets held as differences, in families of any size."""
    rng = random.Random(9)
    texts = family(rng, 60, 60, 0, 9) + family(rng, 30, 12, 0, 2) + [corpus.prose(rng, 3) for _ in range(5)] + ["", None, "one"]
    sets = [corpus.shingles(t, 3) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    want = [(i, len(sets[i]), g) for i, g in enumerate(corpus.classes(len(texts), links))]
    monkeypatch.setattr(op9_jaccard, "FAMILY", 1)
    df = corpus.frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    assert corpus.bag(op9_jaccard.jaccard_classes(df).collect()) == corpus.bag(want)
