"""Cover trees of one block: the same links as brute force, at about its cost."""

import time

import numpy as np
import pandas as pd

from tracelode.llm import op4_embeddings


def linked(vectors, split, weight, cosine=0.93):
    """Weights linked to each row, and the smallest row connected with each, of blocks of ``split`` and the other rows."""
    ids = [f"{i:06d}".encode() for i in range(len(vectors))]
    rows = pd.DataFrame({"side": [int(i >= split) for i in range(len(ids))], "cid": ids, "m": weight, "embedding": list(vectors)})
    found = op4_embeddings._pair(cosine)(rows)
    count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for a, n in found.loc[found.b.isna(), ["a", "n"]].itertuples(index=False):
        count[int(a)] = n
    for a, b in found.loc[~found.b.isna(), ["a", "b"]].itertuples(index=False):
        x, y = root[int(a)], root[int(b)]
        root[root == max(x, y)] = min(x, y)
    return count, root


def brute(vectors, split, weight, cosine=0.93):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hit = unit @ unit.T >= cosine
    np.fill_diagonal(hit, False)
    if split < len(vectors):
        hit[:split, :split] = hit[split:, split:] = False
    root = np.arange(len(vectors))
    for i, j in zip(*np.nonzero(np.triu(hit)), strict=True):
        x, y = root[i], root[j]
        if x != y:
            root[root == max(x, y)] = min(x, y)
    return hit @ weight, root


def groups(seed, dim, noise):
    """Near copies around a few vectors, one group far larger than the others, and vectors alone."""
    r = np.random.default_rng(seed)
    middle = np.concatenate([np.repeat(r.normal(size=(1, dim)), 900, 0), np.repeat(r.normal(size=(20, dim)), 30, 0)])
    x = np.concatenate([middle + noise * r.normal(size=middle.shape), r.normal(size=(500, dim))]) * r.uniform(0.5, 3, (2000, 1))
    return x[r.permutation(2000)], r.integers(1, 4, 2000)


def test_links_as_brute_force():
    for seed, dim, noise in ((1, 64, 0.15), (2, 64, 0.35), (3, 5, 0.1), (4, 2, 0.01)):
        x, weight = groups(seed, dim, noise)
        for split in (2000, 700):
            for got, want in zip(linked(x, split, weight), brute(x, split, weight), strict=True):
                assert (got == want).all()


def test_large_groups_cost_no_step_per_link():
    x, weight = groups(1, 64, 0.15)
    began = time.process_time()
    linked(x, 2000, weight)
    assert time.process_time() - began < 4
