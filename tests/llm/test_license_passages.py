"""Licence passages: notices over several paragraphs and inside a line, against all windows by brute force."""

import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus  # noqa: E402

from tracelode.llm import op2_licenses as op2  # noqa: E402

MIT = re.sub(r" (?=The above copyright|THE SOFTWARE IS)", "\n\n", op2.TEMPLATES["MIT"][1])
BSD = {name: re.sub(r" (?=[123]\. |THIS SOFTWARE IS)", "\n\n", op2.WHOLE[name][1]) for name in ("BSD-2-Clause", "BSD-3-Clause")}


def words(text):
    return re.sub("[^a-z0-9\n]+", " ", text.lower()).split()


def grams(w):
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def test_notices_in_long_documents(spark):
    rng = random.Random(12)
    around = lambda body: corpus.prose(rng, 600) + "\n\n" + body + "\n\n" + corpus.prose(rng, 600)
    cut = lambda body: "\n".join("# " + " ".join(body.split()[i : i + 9]) for i in range(0, len(body.split()), 9))
    near = BSD["BSD-3-Clause"].replace("the copyright holder nor", "Acme Incorporated nor")
    rows = [
        (1, around(MIT)), (2, around(BSD["BSD-3-Clause"])), (3, around(BSD["BSD-2-Clause"])), (4, BSD["BSD-3-Clause"]), (5, around(cut(MIT))), (6, around(near)),
        (7, f"{corpus.prose(rng, 30)} this file is released under the MIT License. {corpus.prose(rng, 30)}"), (8, corpus.prose(rng, 900)),
        (9, None), (10, ""), (11, "license"), (12, around(MIT) + "\n" + BSD["BSD-2-Clause"]), (None, around(MIT)), (13, "license " * 50_000),
    ]
    df = corpus.crowded(corpus.frame(spark, [(i, t, None, None, None) for i, t in rows + [rows[0]]]))
    got = op2.scan_passages(df).collect()
    want = [(1, "MIT"), (1, "MIT"), (2, "BSD-3-Clause"), (3, "BSD-2-Clause"), (4, "BSD-3-Clause"), (5, "MIT"), (6, "BSD-3-Clause"), (7, "MIT"), (12, "BSD-2-Clause"), (12, "MIT"), (None, "MIT")]
    assert corpus.bag((r.doc_id, r.license) for r in got) == corpus.bag(want)
    texts = dict(rows)
    for r in got:
        here = words(texts[r.doc_id])[r.first_word : r.last_word + 1]
        assert " ".join(here) in " ".join(words(MIT + "\n" + " ".join(BSD.values()) + near + "released under the mit license"))
        assert here[0] in words("\n".join(texts[r.doc_id].split("\n")[r.first_line : r.first_line + 1]))
    # the units of the query miss the notices that stand in paragraphs
    assert {(r.doc_id, r.license) for r in op2.scan(df).collect()} < {(r.doc_id, r.license) for r in got}


def test_passages_by_all_windows():
    rng = random.Random(4)
    known = [("A", frozenset(grams(list("abcdefgh")))), ("B", frozenset(grams(list("hgfedc")))), ("C", frozenset(grams(list("xy"))))]
    for _ in range(300):
        w = [rng.choice("abcdefghxyz") for _ in range(10)] + list("abcdefgh")[: rng.randrange(5, 9)] + [rng.choice("hgfz") for _ in range(3)] + list("gfedc")
        good = []
        for name, g in known:
            for i in range(len(w)):
                for j in range(i + 2, len(w) + 1):
                    own = grams(w[i:j])
                    if 2 * len(own & g) >= 0.8 * (len(own) + len(g)) - 1e-9:
                        good.append((len(own) + len(g) - 4 * len(own & g), j - i, name, i, j - 1))
        left, best = sorted(good), []
        while left:
            best.append(left[0])
            left = [x for x in left if x[4] < best[-1][3] or x[3] > best[-1][4]]
        got = op2.passages(" ".join(w), known, 0.8)
        assert bool(got) == bool(best)
        if best:
            score = lambda p: next(len(grams(w[p[0] : p[1] + 1])) + len(g) - 4 * len(grams(w[p[0] : p[1] + 1]) & g) for n, g in known if n == p[4])
            assert min(map(score, got)) == best[0][0]
            assert all(any(p[0] <= x[4] and x[3] <= p[1] for p in got) for x in good)
