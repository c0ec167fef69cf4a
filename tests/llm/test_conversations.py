"""Conversation prefix trie against plain Python, with odd rows."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tracelode.llm import op11_conversations  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def odd_rows():
    """Shared beginnings, null turns, roles and texts, ties, repeated rows, negative ids, one long conversation and its copies."""
    talk = [("user", "Hello there"), ("assistant", "Hi"), ("user", None), (None, "a b\tc"), ("user", "")]
    rows = []
    for c in [*range(0, 70, 3), -7, -40, 20, 40]:
        for t in range(1 + abs(c) % 5):
            rows.append((c, t, *talk[(t + abs(c) // 9) % 5 if t > 1 else t]))
    rows += [(c, t, "user", f"turn {t}") for c in (200, 201, 240) for t in range(45)]
    rows += [(201, 45, "user", "one more"), (300, None, "user", "first"), (300, -5, "user", "second"), (301, 2, "b", "x"), (301, 2, "a", "x")]
    rows += [(301, 2, "a", "x"), (None, 0, "user", "nobody's"), (302, 0, None, None), (303, 0, "user", "long " * 50_000), (45, 0, "u", "x")]
    return rows


def plain(rows, every=20, heads=4):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    if every:
        root = {c: c - (c % every if c >= 0 else -(-c % every)) for c in own}
        h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
        own = {c: own.get(root[c], [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c, s in own.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", k[-1][1].encode())) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * words
    out = set()
    for k, m in members.items():
        here = ",".join(str(c) for c in sorted(m) if len(own[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.add((min(m), len(k), parent, len(m), children[k], leaves[k], saved[k], hashlib.sha256(here.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("forked", [True, False])
def test_trie_brute_force(spark, forked, monkeypatch):
    monkeypatch.setattr(op11_conversations, "STRETCH", 2)  # the long conversations cross several stretches
    rows = odd_rows()
    names = "score double, key string, level int, block long, pos long, n long, part int, salt long, token string, h long, root long"
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (p.split(" ") for p in names.split(", "))])
    make = op11_conversations.forked_trie if forked else op11_conversations.conversation_trie
    got = make(df, many=3)
    assert {tuple(r) for r in got.select(*COLUMNS).collect()} == plain(rows, 20 if forked else 0)
    texts = op11_conversations.turn_texts(df)
    assert got.where("depth > 0").join(texts, "turn_id", "left_anti").count() == 0


def test_trie_without_conversations(spark):
    assert op11_conversations.forked_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ends_in_several_runs(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 4000, 7)]
    turns, convs = op11_conversations.numbered(op11_conversations.turn_rows(spark.createDataFrame(rows, SCHEMA)))
    laid = op11_conversations.blocks(turns, convs)
    got = op11_conversations.ends(laid, run_bits=4).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()]
