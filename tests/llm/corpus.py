"""Small tables for the corpus operators: odd rows, and plain Python forms of the rules."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "score double, key string, root string, shard int, size long, rank long, n long, unit string, keep boolean, " \
    "id string, text_hash string, crc int, copies long, rows long, copy int, dropped string, text_key string, t long, line int, bucket string, first long, " \
    "__id string, __key string, __t long, __text string, __sum long, __rows long, __copy int, __drop string, __crc int, __keep boolean"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def changed(rng, text, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split(" "))


def documents(seed=3):
    """Prose with exact and near copies, nulls in every column, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 3, 8, 30, 120, 400])) for _ in range(60)]
    base = prose(rng, 200)
    texts += [base] * 4 + [changed(rng, base, 0.01) for _ in range(12)] + [changed(rng, base, 0.3) for _ in range(3)]
    texts += ["", "", None, None, " \t\n", "one", "ONE", "one two", prose(rng, 30_000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], None, None, None), (None, texts[7], None, None, None), (None, None, None, None, None), (7, texts[8], "en", "a", 0)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def crowded(df):
    """With more columns, named like those that the operators use inside."""
    from pyspark.sql import functions as F

    fields = [part.split(" ") for part in EXTRA.split(", ")]
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in fields])


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(n, pairs):
    """Smallest member reachable from each of 0..n-1."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
