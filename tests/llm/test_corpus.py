"""Corpus operators against brute force on small tables with odd rows."""

import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus  # noqa: E402

from tracelode.llm import (  # noqa: E402
    components, learned, op1_lines, op2_licenses, op3_sharding, op4_embeddings, op5_toxicity, op6_quality, op7_token_counts, op8_mixing, op9_jaccard,
    op10_decontaminate, textgrams,
)

VEC = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.crowded(corpus.frame(spark)).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.frame(spark, [])


def test_words_and_shingles_match_plain_python():
    texts = ["A b\tc", None, "", "  é É x y ", "a\x0bb\x0cc\rd", "z"]
    w = textgrams.words(pa.array(texts))
    assert np.diff(w.first).tolist() == [len(corpus.words(t)) for t in texts]
    h, first = w.shingles(3)
    assert [len(set(h[a:b].tolist())) for a, b in zip(first[:-1], first[1:], strict=True)] == [len(corpus.shingles(t, 3)) for t in texts]
    same = textgrams.words(pa.array(["q a b c", "a b c"])).shingles(3)[0]
    assert same[1] == same[2] and same[0] != same[1]
    parts = list(textgrams.slices(pa.array(["x" * 10] * 5)))
    assert [at for at, _ in parts] == [0] and len(parts[0][1]) == 5


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_components(spark, few):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(400 + i, 401 + i) for i in range(60)] + [(500, i) for i in range(501, 560)]
    got = defaultdict(set)
    for r in components.components(spark.createDataFrame(pairs, "a long, b long"), few).collect():
        got[r.root].add(r.node)
    want = defaultdict(set)
    for i, c in enumerate(corpus.classes(600, pairs)):
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long"), few).count() == 0
    keys = spark.createDataFrame([(b"x", b"y"), (b"z", b"y"), (b"p", b"q")], "a binary, b binary")
    assert len({bytes(r.root) for r in components.components(keys, few).collect()}) == 2


# 1. lines


def normal_line(line):
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip()


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def one_word_apart(a, b):
    """One word differs: by at most a fifth of each line, or by one letter that is another, more or less."""
    x, y = a.split(" "), b.split(" ")
    differ = [(v, w) for v, w in zip(x, y) if v != w]  # noqa: B905
    if len(x) != len(y) or len(differ) != 1 or max(len(a), len(b)) < 5:
        return False
    (v, w), (m, n) = differ[0], (len(a) // 5, len(b) // 5)
    return (len(v) <= m and len(w) <= n) or (edit(v, w) <= 1 and max(len(v), len(w)) <= op1_lines.LETTERS and (m >= 1 and n >= 1 or len(v) != len(w)))


def test_lines_one_letter_apart_are_all_found(spark):
    import random

    rng, rows = random.Random(11), []
    for n in (1, 2, 4, 8, 12, 20, 40):
        for i in range(60):
            line = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9) + 3 * (n == 1))) for _ in range(n))
            at = rng.choice([k for k, c in enumerate(line) if c != " "])
            other = [line[:at] + "Q" + line[at + 1 :], line[:at] + "q" + line[at:], line[:at] + line[at + 1 :]][i % 3]
            rows += [(len(rows), line, None, None, None), (len(rows) + 1, other, None, None, None)]
    got = op1_lines.line_counts(corpus.frame(spark, rows)).collect()
    assert {r.doc_id for r in got if r.n_kept} == set(range(0, len(rows), 2))


def test_lines_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [" ".join(f"word{rng.randrange(50)}" for _ in range(rng.choice([3, 6, 25, 40]))) for _ in range(25)]
    pool = base + [corpus.changed(rng, b, 0.04) for b in base for _ in range(3)] + ["", "--", "A b.", "a B"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))), None, None, None) for i in range(40)]
    rows += [rows[3], (None, rows[4][1], None, None, None), (50, None, None, None, None), (51, "", None, None, None)]
    df = corpus.frame(spark, rows)
    # the SimHashes come from Spark, all else from plain Python
    lines = op1_lines.occurrences(df)
    distinct = op1_lines.distinct_lines(lines)
    sims = {r.norm: (r.sim, r.words) for r in op1_lines.line_classes(distinct).join(distinct, ["l1", "l2"]).collect()}
    classes = sorted(sims)
    linked = [
        (i, j) for i, a in enumerate(classes) for j, b in enumerate(classes[:i])
        if (
            min(sims[a][1], sims[b][1]) >= op1_lines.MIN_WORDS and ((sims[a][0] ^ sims[b][0]) & (2**64 - 1)).bit_count() <= op1_lines.DISTANCE
            and edit(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
        ) or one_word_apart(a, b)
    ]
    assert linked, "the fixture holds near lines"
    group = dict(zip(classes, corpus.classes(len(classes), linked), strict=True))
    hashed = {r.text: r.t for r in df.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS t").distinct().collect()}
    first = {}
    for doc, text, *_ in rows:
        for no, line in enumerate((text or "").split("\n")):
            if normal_line(line):
                place = (doc is None, doc if doc is not None else -1, hashed[text], no)
                c = group[normal_line(line)]
                first[c] = min(first.get(c, place), place)
    want = []
    for doc, text, *_ in rows:
        parts = (text or "").split("\n")
        drop = [no for no, x in enumerate(parts) if normal_line(x) and first[group[normal_line(x)]] != (doc is None, doc if doc is not None else -1, hashed[text], no)]
        want.append((doc, len(parts), len(parts) - len(drop), ",".join(map(str, drop))))
    assert corpus.bag(op1_lines.line_counts(df).collect()) == corpus.bag(want)
    clean = op1_lines.dedup_lines(corpus.crowded(df)).select("doc_id", "text").collect()
    expected = [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if str(i) not in w[3].split(","))) for (d, t, *_), w in zip(rows, want, strict=True)]
    assert corpus.bag(clean) == corpus.bag(expected)


def test_lines_odd_rows(docs, empty):
    assert op1_lines.line_counts(docs).count() == docs.count()
    assert op1_lines.line_counts(empty).count() == 0


# 2. licences


def test_licences(spark, empty):
    rows = [
        (1, "Some prose here.\nReleased under the MIT License.\nMore prose.", None, None, None), (2, "RELEASED UNDER THE  MIT license", None, None, None),
        (3, "x\n \nLicensed under CC BY-NC 4.0.\n\ny", None, None, None), (4, None, None, None, None), (5, "", None, None, None),
        (None, "Licensed under the Apache License, Version 2.0.", None, None, None), (6, "license", None, None, None),
        (7, op2_licenses.TEMPLATES["MIT"][1].replace("fitness", "suitability"), None, None, None), (8, "license " * 50_000, None, None, None),
    ]
    df = corpus.crowded(corpus.frame(spark, rows + [rows[1]]))
    got = corpus.bag(op2_licenses.scan(df).select("doc_id", "unit", "unit_no", "license").collect())
    assert got == corpus.bag([
        (1, "line", 1, "MIT"), (2, "text", 0, "MIT"), (2, "text", 0, "MIT"), (3, "text", 0, "CC-BY-NC-4.0"), (3, "paragraph", 1, "CC-BY-NC-4.0"), (3, "line", 2, "CC-BY-NC-4.0"),
        (None, "text", 0, "Apache-2.0"), (7, "text", 0, "MIT"),
    ])
    assert op2_licenses.scan(empty).count() == 0


# 3. sharding


def test_best_fit_is_the_tightest_and_level_is_even():
    rng = np.random.default_rng(2)
    sizes = sorted((int(x) for x in rng.integers(1, 60, 3000)), reverse=True)
    got, left, want = op3_sharding.best_fit(sizes, 100), [], []
    for s in sizes:  # the plain rule: least room that is enough, the lowest bin among equals
        fits = [(room, i) for i, room in enumerate(left) if room >= s]
        i = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(100)
        left[i] -= s
        want.append(i)
    assert got == want
    load = Counter()
    for s, b in zip(sizes, op3_sharding.level(sizes, 24), strict=True):
        load[b] += s
    assert max(load.values()) - min(load.values()) < 0.02 * sum(sizes) / 24
    assert op3_sharding.level([100, 1, 1], 3) == [0, 1, 2] and op3_sharding.level([], 4) == []


def test_shards(docs, empty):
    rows = op3_sharding.shard(docs, 5).collect()
    source = [(r.doc_id, len((r.text or "").encode()) + 8, None if r.text is None else zlib.crc32(r.text.encode())) for r in docs.collect()]
    assert corpus.bag((r.doc_id, r["size"], r.text_crc32) for r in rows) == corpus.bag(source)
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert op3_sharding.shard(empty).count() == 0


# 4. embeddings


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, 8)) * s for s in (0.05, 0.2, 0.5)] + [rng.normal(size=(60, 8))])
    x = np.concatenate([x, x[:20], x[:5] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, rng.integers(0, 3, len(x)), strict=True))]
    rows += [rows[0], (None, x[1].tolist(), rows[1][2]), (900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, x[0].tolist(), None)]
    rows += [(904, [None] + [1.0] * 7, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [float("inf")] * 8, 1)]
    df = corpus.crowded(spark.createDataFrame(rows, VEC))
    ok = [r[1] is not None and r[2] is not None and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]
    pairs = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                    pairs.append((i, j))
    degree = Counter(i for p in pairs for i in p)
    group = corpus.classes(len(rows), pairs)
    least = {c: min((r[0] for r, g in zip(rows, group, strict=True) if g == c and r[0] is not None), default=None) for c in set(group)}
    want = [(r[0], degree[i], least[group[i]], r[0] is not None and r[0] == least[group[i]]) for i, r in enumerate(rows)]
    for block in (16, 4096):
        assert corpus.bag(op4_embeddings.near_duplicates(df, block_rows=block).collect()) == corpus.bag(want)
    assert op4_embeddings.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


# 5, 6. classifiers


@pytest.mark.parametrize(("op", "label", "fold", "least"), [(op5_toxicity, "toxic", (5, 0), 0.95), (op6_quality, "quality", (3, 1), 0.97)])
def test_held_out_accuracy(spark, op, label, fold, least):
    sf = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = op.score(df, op.train(df, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[label] for r in held]) >= least


@pytest.mark.parametrize(("op", "label"), [(op5_toxicity, "toxic"), (op6_quality, "quality")])
def test_classifier_odd_rows(spark, docs, empty, op, label):
    for values in ([], [(1, 1, 1)], [(1, 0, 0), (2, 0, 0)], [(i, i % 2, i % 2) for i in range(80)] + [(None, 1, 1), (3, 0, 0), (5, None, None), (10**6, 1, 1)]):
        labels = spark.createDataFrame(values, "doc_id long, quality int, toxic int")
        model = op.train(docs, labels)
        got = op.score(docs, model).collect()
        assert corpus.bag([r.doc_id] for r in got) == corpus.bag([r.doc_id] for r in docs.collect())
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert op.score(empty, model).count() == 0
    assert op.score(empty, op.train(empty, labels)).count() == 0
    bound = learned.sample(docs, labels, label, 1, 1, 7).groupBy("label").count().collect()
    assert all(r["count"] <= 7 for r in bound)


def test_quality_keeps_rows_whole(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model = op6_quality.train(docs, labels)
    good = Counter(repr((r.doc_id, r.predicted)) for r in op6_quality.score(docs, model).collect() if r.predicted)
    kept = op6_quality.keep_good(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(good.values())


def test_offending_sentences(spark):
    rows = [(i, f"Calm words number {i}. " * 3 + ("You vile wretch é! " if i % 2 else "") + "The end.", None, None, None) for i in range(60)]
    df = corpus.frame(spark, rows)
    model = op5_toxicity.fit([r[1] for r in rows], np.array([r[0] % 2 for r in rows]))
    found = op5_toxicity.offending(df, model).collect()
    assert {r.doc_id for r in found} == {r[0] for r in rows if r[0] % 2}
    texts = {r[0]: r[1].encode() for r in rows}
    assert all(texts[r.doc_id][r.first_byte : r.end_byte].decode() == r.sentence and "vile" in r.sentence for r in found)


# 7. token counts


def test_rollup(spark, docs, empty, tmp_path):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(op7_token_counts.VOCABULARY, "rb"))}
    encoder = tiktoken.Encoding("t", pat_str=op7_token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counted = op7_token_counts.count_tokens(docs, op7_token_counts.VOCABULARY, "v1")
    want = Counter()
    for r in docs.collect():
        for name, n in (("documents", 1), ("tokens", len(encoder.encode_ordinary(r.text or ""))), ("bytes", len((r.text or "").encode()))):
            want[r.source, r.lang, "v1", name] += n
    rollup = op7_token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    totals = lambda: {(r.source, r.lang, r.version, n): r[n] for r in rollup.totals().collect() for n in op7_token_counts.SUMS}
    assert rollup.commit("1", inserts=counted) and not rollup.commit("1", inserts=counted)
    assert {k: v for k, v in totals().items() if v} == {k: v for k, v in want.items() if v}
    before = totals()
    ids = docs.select("doc_id").where("doc_id < 10")
    revised = op7_token_counts.count_tokens(docs.where("doc_id < 10"), op7_token_counts.VOCABULARY, "v2")
    assert rollup.commit("2", inserts=revised, deletes=ids)
    # a run that was cut short after its ledger is done again with the same result
    import shutil

    after = totals()
    shutil.rmtree(tmp_path / "r/delta/batch=2")
    assert rollup.commit("2", inserts=revised, deletes=ids) and totals() == after
    # a cut-short batch is no part of what a later batch takes back; done again, it counts
    late = op7_token_counts.count_tokens(docs.where("doc_id = 20").selectExpr("1000 AS doc_id", "source", "lang", "text"), op7_token_counts.VOCABULARY, "v3")
    assert rollup.commit("2b", inserts=late) and totals() != after
    shutil.rmtree(tmp_path / "r/delta/batch=2b")
    assert totals() == after
    assert rollup.commit("2c", deletes=late.select("doc_id")) and totals() == after
    assert rollup.commit("2b", inserts=late) and sum(v for k, v in totals().items() if k[2:] == ("v3", "documents")) == 1
    assert rollup.commit("2d", deletes=late.select("doc_id")) and totals() == after
    assert sum(v for k, v in after.items() if k[3] == "tokens") == sum(v for k, v in before.items() if k[3] == "tokens")
    assert rollup.commit("3", deletes=docs.select("doc_id")) and rollup.commit("4", inserts=op7_token_counts.count_tokens(empty, op7_token_counts.VOCABULARY, "v1"))
    nameless = [r for r in docs.collect() if r.doc_id is None]
    assert sum(v for k, v in totals().items() if k[3] == "documents") == len(nameless)


def test_pieces_keep_counts():
    text = "ab cd  ef " * 60_000
    parts = list(op7_token_counts.pieces(text))
    assert "".join(parts) == text and len(parts) > 3 and all(p.startswith(" ") for p in parts[1:])


# 8. mixing


def water(sizes, weights, epochs=3):
    """Targets by the plain rule: share by weight, stop at the limit, share the excess again."""
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        above = {s for s in free if left * weights[s] / total > epochs * sizes[s]}
        if not above:
            return target | {s: left * weights[s] / total for s in free}
        for s in above:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        free -= above
    return target


@pytest.mark.parametrize("block", [7, 4096])
def test_mixing(docs, block):
    marks, spans = op8_mixing.mix(docs, block_words=block)
    rows = marks.collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(corpus.words(r.text))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = water(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    source = defaultdict(set)
    for r in docs.collect():
        source[r.doc_id, len(corpus.words(r.text))].add(r.source)
    taken = defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r["size"]
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s in names:
        assert abs(taken[sizes[s], round(targets[s], 6)] - targets[s]) <= 1
    assert corpus.bag([r.doc_id] for r in rows) == corpus.bag([r.doc_id] for r in docs.collect())
    assert sum(r.words for r in spans.collect()) == sum(r.taken for r in rows)
    slots = Counter()
    for r in spans.collect():
        slots[r.slot] += r.words
    assert max(slots.values()) <= block
    again = op8_mixing.mix(docs.repartition(3), block_words=block)[0]
    assert corpus.bag(again.collect()) == corpus.bag(rows)


def test_many_sources_and_nameless_rows(spark):
    """1,500 sources whose blocks do not share a slot, and rows without an id spread over the ranges of their source."""
    rows = [(None if i % 3 else i, f"w{i} " * (1 + i % 40), None, f"s{i % 1500:04}", 0) for i in range(6000)]
    df = corpus.frame(spark, rows)
    marks, spans = op8_mixing.mix(df, block_words=5)
    slots = defaultdict(set)
    for r in spans.join(df.select("doc_id", "source").distinct(), "doc_id").collect():
        slots[r.slot].add(r.source)
    assert max(map(len, slots.values())) == 1 and marks.count() == 6000
    placed, _ = op8_mixing.streams(df.withColumn("source", op8_mixing.F.lit("one")))
    assert placed.where("doc_id IS NULL").select("bucket").distinct().count() > 200
    assert [op8_mixing.range_digits(n) for n in (0, 5_120_000, 5_120_001, 10**12)] == [2, 2, 3, 7]


def test_mixed_documents(docs, empty):
    mixed = op8_mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema and mixed.count() > 0
    assert op8_mixing.mix(empty)[0].count() == 0 and op8_mixing.mixed_documents(empty).count() == 0


# 9. Jaccard join


def test_jaccard_brute_force(docs, empty):
    rows = docs.collect()
    sets = [corpus.shingles(r.text, 3) for r in rows]
    pairs = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])
    ]
    group = corpus.classes(len(rows), pairs)
    least = {c: min((r.doc_id for r, g in zip(rows, group, strict=True) if g == c and r.doc_id is not None), default=None) for c in set(group)}
    want = [(r.doc_id, len(s), least[g]) for r, s, g in zip(rows, sets, group, strict=True)]
    assert corpus.bag(op9_jaccard.jaccard_classes(docs).collect()) == corpus.bag(want)
    one = op9_jaccard.one_per_class(docs)
    assert one.schema == docs.schema
    expected = len({g for g, s in zip(group, sets, strict=True) if s}) + sum(not s for s in sets)
    assert one.count() == expected
    assert op9_jaccard.jaccard_classes(empty).count() == 0 and op9_jaccard.one_per_class(empty).count() == 0


# 10. decontamination


def test_leaks_brute_force(spark, docs, empty):
    import random

    rng = random.Random(9)
    base = [r.text for r in docs.collect() if len(corpus.words(r.text)) > 100]
    items = [(i, " ".join(rng.choice(base).split()[k : k + n])) for i, (k, n) in enumerate([(3, 20), (10, 14), (0, 59), (5, 9), (30, 40), (2, 4), (2, 5), (7, 1)])]
    items += [(20, corpus.changed(rng, items[2][1], 0.05)), (21, corpus.changed(rng, items[2][1], 0.3)), (22, None), (23, ""), (None, items[0][1]), (0, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in docs.collect():
        for item, text in items:
            k = min(5, len(corpus.words(text)))
            s = corpus.shingles(text, k) if k else set()
            own = corpus.shingles(r.text, k) if k and len(corpus.words(r.text)) >= k else set()
            if s and 10 * len(s & own) >= 8 * len(s):
                want.append((r.doc_id, item, len(s), len(s & own)))
    got = op10_decontaminate.leaks(docs, bench)
    assert {len(corpus.words(t)) for i, t in items if i in {w[1] for w in want}} >= {1, 4, 5, 20} and corpus.bag(got.collect()) == corpus.bag(want)
    clean = op10_decontaminate.decontaminate(docs, bench)
    assert clean.schema == docs.schema and all(corpus.bag([[r.doc_id]])[0] or True for r in clean.collect())
    dirty = {(r.doc_id) for r in got.collect()}
    assert {r.doc_id for r in clean.collect()} & dirty - {None, 7} == set()
    assert op10_decontaminate.leaks(empty, bench).count() == 0 and op10_decontaminate.leaks(docs, bench.limit(0)).count() == 0
