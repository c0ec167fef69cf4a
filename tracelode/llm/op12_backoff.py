"""Language-model scores: smoothed n-grams as a weighted automaton with failure arcs.

Counts cover all training documents and stay distributed. Texts become blocks of about BLOCK_TOKENS token ids. Each block
sends its distinct n-grams, with its own counts, to ranges of the hash space; there they are added up, and a block gets
back only the totals that differ from what it counted itself. From these it builds the part of the model that its texts can
reach: every n-gram that can go on is a state, an arc carries the smoothed log-probability of a token after it, and a
failure arc leads to the next shorter n-gram with the weight of backing off. One pass from left to right carries each
text's state through its tokens.

Smoothing: ``p(w | h) = (c(hw) + mu * p(w | shorter h)) / (c(h) + mu)``, down to ``(c(w) + 1) / (N + V + 1)``, so the tokens after
every state, with one unknown token, add up to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept
from .learned import remainder
from .textgrams import SPACED, mix, slices, words

ORDER = 2
#: Pseudo-counts of the shorter context, for n-grams of two and more tokens.
MU = (500.0, 30.0)
BLOCK_TOKENS = 1 << 20
#: Distinct n-grams that one range of the hash space is meant to hold.
RANGE_GRAMS = 1 << 22
#: Tokens of a text that are scored as one strand; the next strand starts from the same state.
STRAND = 2048
PIECE_BYTES = 1 << 20
#: N-grams of two and more tokens are told apart by 56 bits of hash, tokens by 64.
NAMED = np.uint64(0xFFFFFFFFFFFFFF00)
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SEPARATOR = SPACED == 0


def _word_hashes(part: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
    """``(row, word hashes, last)`` of each text; a long text comes in pieces cut between words."""
    if len(part) > 1 or len(part.buffers()[2] or b"") == 0:
        w = words(part)
        for row in range(len(part)):
            yield row, w.hash[w.first[row] : w.first[row + 1]], True
        return
    text = part.cast(pa.large_string()).cast(pa.large_binary())[0].as_buffer() if part[0].is_valid else b""
    raw, at = np.frombuffer(text, np.uint8), 0
    while len(raw) - at > PIECE_BYTES:
        gaps = np.flatnonzero(_SEPARATOR[raw[at : at + PIECE_BYTES]])
        ahead = at + PIECE_BYTES
        while not len(gaps) and ahead < len(raw):  # a word longer than a piece stays whole
            gaps = np.flatnonzero(_SEPARATOR[raw[ahead : ahead + PIECE_BYTES]]) + (ahead - at)
            ahead += PIECE_BYTES
        upto = at + int(gaps[-1]) + 1 if len(gaps) else len(raw)
        yield 0, _hashes(raw[at:upto]), False
        at = upto
    yield 0, _hashes(raw[at:]), True


def _hashes(raw: np.ndarray) -> np.ndarray:
    offsets = pa.py_buffer(np.array([0, len(raw)], np.int64).tobytes())
    return words(pa.Array.from_buffers(pa.large_string(), 1, [None, offsets, pa.py_buffer(raw.tobytes())])).hash


def encode(docs: DataFrame, mod: int, fold: int, order: int, block_tokens: int) -> DataFrame:
    """A row per block: ``block``, the ids of its pieces of documents (``doc, row, held, train``), their ``size`` and ``lead``
    (tokens that only give context), the tokens' numbers and the dictionary of their hashes; kept as a table."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, blocks, rows, held = TaskContext.get().partitionId() << 32, 0, 0, []
        open_tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal blocks, open_tokens, held
            names, numbers, folds, trains, parts, leads = map(list, zip(*held, strict=True))
            known, ids, often = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            by = np.argsort(-often, kind="stable")  # small numbers for frequent tokens
            known, ids = known[by], np.argsort(by)[ids]
            lists = [pa.array([v], pa.list_(t)) for v, t in ((names, names_type), (numbers, pa.int64()), (folds, pa.bool_()), (trains, pa.bool_()))]
            packed = [pack(a) for a in (np.array([len(p) for p in parts], np.int32), np.array(leads, np.int32), ids.astype(np.int32), known)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([base + blocks]), pa.array([int(len(ids) - sum(leads))]), *lists, *(pa.array([p], pa.binary()) for p in packed)],
                ["block", "tokens", "doc", "row", "held", "train", "size", "lead", "ids", "known"],
            )
            blocks, open_tokens, held = blocks + 1, 0, []
            return out

        names_type = pa.int64()
        for batch in batches:
            names_type = batch.schema.field(0).type
            ids, fold_of, learned = (batch.column(i) for i in range(3))
            for at, part in slices(batch.column(3)):
                context = np.array([START])
                for row, found, last in _word_hashes(part):
                    tokens = np.concatenate([found, [END]]) if last else found
                    while len(tokens):
                        room = max(block_tokens - open_tokens, 1)
                        here, tokens = tokens[:room], tokens[room:]
                        i = at + row
                        held.append((ids[i].as_py(), base + rows, fold_of[i].as_py(), learned[i].as_py(), np.concatenate([context, here]), len(context)))
                        open_tokens += len(here)
                        context = held[-1][4][1 - order :] if order > 1 else here[:0]
                        if open_tokens >= block_tokens:
                            yield flush()
                    if last:
                        rows, context = rows + 1, np.array([START])
        if held:
            yield flush()

    part_of = remainder(F.col("doc_id"), mod)
    plain = docs.select("doc_id", F.coalesce(part_of == fold, F.lit(False)).alias("held"), F.coalesce(part_of != fold, F.lit(False)).alias("train"), "text")
    schema = f"block long, tokens long, doc array<{kind}>, row array<long>, held array<boolean>, train array<boolean>, size binary, lead binary, ids binary, known binary"
    return kept(plain.mapInArrow(run, schema), "lm-blocks")


def pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; ``unpack`` with the same type gives them back."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True) if len(raw) else b""


def unpack(packed: bytes, kind: type) -> np.ndarray:
    if not packed:
        return np.zeros(0, kind)
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(packed[8:], n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(packed: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(packed, kind), dtype=kind)


@dataclass
class Block:
    size: np.ndarray  # tokens of each piece, context included
    lead: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, size: bytes, lead: bytes, ids: bytes, known: bytes, train) -> Block:
        return cls(*(unpack(b, np.int32).astype(np.int64) for b in (size, lead, ids)), unpack(known, np.uint64), np.asarray(train, bool))

    def __post_init__(self):
        self.first = np.cumsum(self.size) - self.size
        self.piece = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.arange(len(self.ids)) - self.first[self.piece]
        self.scored = self.at >= self.lead[self.piece]
        # the start of a training text counts as a context, once, though not as a token
        begins = (self.known[self.ids] == START) & (self.lead[self.piece] == 1)
        self.counted = (self.scored | begins) & self.train[self.piece]

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For 1, 2, ... ``order`` tokens: the distinct n-grams (sorted hashes), where each first ends, its count in this block's training
        texts, and for every token the number of the n-gram that ends there (-1: none)."""
        with np.errstate(over="ignore"):
            h = token = self.known[self.ids]
            for n in range(1, order + 1):
                if n > 1:
                    h = mix(np.concatenate([h[:1], h[:-1]]) * np.uint64(0x5851F42D4C957F2D) + token + np.uint64(n))
                ends = np.flatnonzero(self.at >= n - 1)
                u, where, inverse = np.unique(h[ends] & NAMED if n > 1 else h[ends], return_index=True, return_inverse=True)
                count = np.bincount(inverse, weights=self.counted[ends], minlength=len(u)).astype(np.int64)
                index = np.full(len(h), -1)
                index[ends] = inverse
                yield u, ends[where], count, index


def _ranges(u: np.ndarray, bits: int) -> np.ndarray:
    """Where each of ``2 ** bits`` equal ranges of the hash space starts in sorted hashes, with the end."""
    if not bits:
        return np.array([0, len(u)])
    borders = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(u, borders), [len(u)]])


def counts(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """``block, n, range, place, total``: for each block and range the n-grams, by their place in the block's sorted range, whose
    total over all training texts differs from the block's own count. Rows with block -1 have tokens and
    distinct tokens as ``total``. Kept as a table."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, train, *packed in zip(*(batch.column(c).to_pylist() for c in ("block", "train", "size", "lead", "ids", "known")), strict=True):
                for n, (u, _, count, _) in enumerate(Block.of(*packed, train).grams(order), 1):
                    cut = _ranges(u, bits)
                    some = np.flatnonzero(np.diff(cut))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), block)), pa.array(np.full(len(some), n)), pa.array(some),
                            pa.array([pack_sorted(u[cut[i] : cut[i + 1]]) for i in some], pa.binary()),
                            pa.array([pack(count[cut[i] : cut[i + 1]].astype(np.int32)) for i in some], pa.binary()),
                        ],
                        ["block", "n", "range", "grams", "count"],
                    )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n, part = int(rows["n"].iloc[0]), int(rows["range"].iloc[0])
        grams = [unpack_sorted(g, np.uint64) for g in rows["grams"]]
        own = np.concatenate([unpack(c, np.int32) for c in rows["count"]]).astype(np.int64)
        u, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(inverse, weights=own, minlength=len(u)).astype(np.int64)
        out, at = [], 0
        for block, g in zip(rows["block"], grams, strict=True):
            upto = at + len(g)
            whole = total[inverse[at:upto]]
            place = np.flatnonzero(whole != own[at:upto])
            if len(place):
                out.append((block, n, part, pack_sorted(place.astype(np.int32)), pack(whole[place])))
            at = upto
        if n == 1:
            token = total[u != START]
            out.append((-1, n, part, b"", pack(np.array([token.sum(), (token > 0).sum()]))))
        return pd.DataFrame(out, columns=["block", "n", "range", "place", "total"])

    sent = blocks.select("block", "train", "size", "lead", "ids", "known").mapInArrow(send, "block long, n long, range long, grams binary, count binary")
    return kept(sent.groupBy("n", "range").applyInPandas(merge, "block long, n long, range long, place binary, total binary"), "lm-totals")


@dataclass
class Automaton:
    key: np.ndarray  # state * tokens + token of each arc, sorted
    weight: np.ndarray
    target: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    tokens: int


def automaton(block: Block, grams: list, n_train: int, n_distinct: int, mu: tuple[float, ...]) -> Automaton:
    """The part of the model that the block's texts reach. State 0 is the empty context; arcs from it take every token of the
    block, known or not."""
    order, w = len(grams), len(block.known)
    start, end = (int(np.argmax(block.known == t)) if (block.known == t).any() else -1 for t in (START, END))
    key, weight, target, fail, fail_weight = [], [], [], [np.zeros(1, np.int64)], [np.zeros(1)]
    below, p_below, made = np.zeros(1, np.int64), None, 1
    for n, (u, ends, count, index) in enumerate(grams, 1):
        token = block.ids[ends]
        pseudo = mu[min(n, len(mu) + 1) - 2] if n > 1 else 0.0
        if n == 1:
            from_state, p = np.zeros(len(u), np.int64), (count + 1.0) / (n_train + n_distinct + 1.0)
            shorter = np.zeros(len(u), np.int64)
        else:
            before = grams[n - 2][3]
            context, suffix = before[ends - 1], before[ends]
            from_state, shorter = below[context], below[suffix]
            p = (count + pseudo * p_below[suffix]) / (grams[n - 2][2][context] + pseudo)
        seen = (count > 0) & (token != end) & (n < order)
        state = np.where(seen, made + np.cumsum(seen) - 1, shorter)
        own = mu[min(n + 1, len(mu) + 1) - 2]
        fail.append(shorter[seen])
        fail_weight.append(np.log10(own / (count[seen] + own)))
        arc = (count > 0) if n > 1 else np.ones(len(u), bool)
        key.append(from_state[arc] * w + token[arc])
        weight.append(np.where(token[arc] == start, 0.0, np.log10(p[arc])))
        target.append(state[arc])
        below, p_below, made = state, p, made + int(seen.sum())
    by = np.argsort(every := np.concatenate(key), kind="stable")
    return Automaton(every[by], np.concatenate(weight)[by], np.concatenate(target)[by], np.concatenate(fail), np.concatenate(fail_weight), w)


def traverse(block: Block, model: Automaton, order: int) -> np.ndarray:
    """log10 probability of each piece. Strands of all pieces take their next token together, each from its own state."""
    todo = block.size - block.lead
    n = -(-todo // STRAND)
    piece = np.repeat(np.arange(len(todo)), n)
    i = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    lead = np.where(i == 0, block.lead[piece], order - 1)
    lead = np.minimum(lead, block.lead[piece] + i * STRAND)
    begin = block.first[piece] + block.lead[piece] + i * STRAND - lead
    length = lead + np.minimum(STRAND, todo[piece] - i * STRAND)
    by = np.argsort(-length, kind="stable")
    piece, lead, begin, length = piece[by], lead[by], begin[by], length[by]
    state, total = np.zeros(len(piece), np.int64), np.zeros(len(piece))
    for t in range(int(length.max(initial=0))):
        live = int(np.searchsorted(-length, -t, side="left"))
        token, counts_now = block.ids[begin[:live] + t], t >= lead[:live]
        left = np.arange(live)
        while len(left):
            s = state[left]
            wanted = s * model.tokens + token[left]
            arc = np.minimum(np.searchsorted(model.key, wanted), len(model.key) - 1)
            hit = model.key[arc] == wanted
            gain = np.where(hit, model.weight[arc], model.fail_weight[s])
            total[left] += np.where(counts_now[left], gain, 0.0)
            state[left] = np.where(hit, model.target[arc], model.fail[s])
            left = left[~hit]
    return np.bincount(piece, weights=total, minlength=len(todo))


def score(docs: DataFrame, mod: int = 7, fold: int = 2, order: int = ORDER, mu: tuple[float, ...] = MU, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text with A-Z lower-cased, and an end. Documents whose ``crc32(doc_id) % mod`` is ``fold`` are held out; the model
    counts all others. ``base_score`` adds up unigrams with one added, ``score`` is the automaton's log10 probability. Null and empty texts are
    an end alone. A null doc_id is neither held out nor learned from. Repeated rows are documents of their own; texts longer than a
    block are scored and counted in pieces that hand their state on. No documents give no rows. Only doc_id and text are read.
    """
    blocks = encode(docs, mod, fold, order, block_tokens)
    tokens = blocks.agg(F.sum("tokens")).collect()[0][0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, tokens * order / RANGE_GRAMS)))))
    totals = counts(blocks, order, bits)
    sums = [unpack(r.total, np.int64) for r in totals.where("block = -1").select("total").collect()]
    n_train, n_distinct = (int(x) for x in (np.sum(sums, axis=0) if sums else (0, 0)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(_key, texts: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        columns = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not len(texts):
            return pd.DataFrame([], columns=columns)
        r = texts.iloc[0]
        block = Block.of(r["size"], r["lead"], r["ids"], r["known"], r["train"])
        grams = list(block.grams(order))
        cuts = [_ranges(u, bits) for u, *_ in grams]
        for n, part, place, total in zip(changes["n"], changes["range"], changes["place"], changes["total"], strict=True):
            grams[n - 1][2][cuts[n - 1][part] + unpack_sorted(place, np.int32)] = unpack(total, np.int64)
        unigrams = grams[0][2][grams[0][3]]
        pieces = [np.bincount(block.piece[block.scored], weights=w[block.scored], minlength=len(block.size)) for w in (
            np.ones(len(unigrams)), unigrams > 0, np.log10((unigrams + 1) / (n_train + n_distinct + 1)),
        )]
        made = traverse(block, automaton(block, grams, n_train, n_distinct, mu), order)
        return pd.DataFrame({
            "row": r["row"], "doc_id": pd.Series(list(r["doc"]), dtype=object), "held_out": r["held"], "n_tokens": pieces[0].astype(np.int64),
            "n_known": pieces[1].astype(np.int64), "base_score": pieces[2], "score": made,
        })[columns]

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(totals.where("block >= 0").groupBy("block")).applyInPandas(run, schema)
    whole = scored.groupBy("row", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
