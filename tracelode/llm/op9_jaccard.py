"""N-gram Jaccard join with skipping by set relations.

Sets are the distinct word shingles of whole texts, equal texts being one class. Highly similar sets are first attached to
a leader (they share MinHash pairs, and the Jaccard of each with its leader is computed). What the leaders' overlaps
say then answers for their sets: an overlap of x and y lies within the differences of x and y from their leaders
of the overlap of the leaders, so most other pairs are accepted or left out unread. Candidate pairs
come from an index of the sets' rarest shingles, whose lists are cut into blocks by size; a block pair is skipped
when positions and sizes cannot reach the threshold or when all its sets are connected already. How many of their rarest
shingles two sets share bounds their overlap, so most pairs end there.

Families of sets that are alike without being linked share nearly all shingles, so the index would open them pair by pair. There each set
is held as its difference from a common centre: sets whose differences have nothing in common link only where both link with
the set nearest to the centre, and all others must share rare elements of their differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textgrams
from .common import free, kept, small, text_id
from .components import FEW, components

#: Words of a shingle and least Jaccard in percent of the registered query; the functions take others.
SHINGLE, PERCENT = 3, 90
HASHES = 6
#: Rounds of leaders; each asks only for sets that are not connected to their leader yet.
ROUNDS = 3
#: A shingle is reported as frequent if so many distinct texts of one task's run of texts hold it.
LOCAL, RUN = 2, 1 << 21
#: How many frequent shingles the rarity order knows (8 bytes and a count each); it is no filter, only an order.
FREQUENT = 1_000_000
#: Alike sets are compared by their differences from a centre if they are in so many components; a choice of plan, not of results.
FAMILY = 16
_SALTS = [np.uint64(x) for x in np.random.default_rng(11).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)]


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any set that links, for a set of size n."""
    return -(-n * percent // 100)


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each text."""
    for at, part in textgrams.slices(column):
        h, first = textgrams.words(part).shingles(shingle)
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            yield at + i, _distinct(h[a:b])


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_id", "n", "k1", "k2", "k3", "frequent"]
    run: list[np.ndarray] = []
    known: set[bytes] = set()
    total = 0
    no_id = None

    def frequent() -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(run), return_counts=True)
        value, count = value[count >= LOCAL].view(np.int64), count[count >= LOCAL]
        pairs = pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.StructArray.from_arrays([pa.array(value), pa.array(count)], ["s", "c"]))
        empty = [pa.array([None], kind) for kind in (no_id, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*empty, pairs], names)

    with np.errstate(over="ignore"):
        for batch in batches:
            no_id = batch.column(0).type
            n, keys = np.zeros(batch.num_rows, np.int64), np.zeros((3, batch.num_rows), np.int64)
            ids = batch.column(1).to_pylist()
            for at, part in textgrams.slices(batch.column(2)):
                h, first = textgrams.words(part).shingles(shingle)
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                low = [np.minimum.reduceat(textgrams.mix(h * salt), first[full]) for salt in _SALTS]
                for k in range(3):
                    keys[k, at + full] = textgrams.mix(low[2 * k] * np.uint64(3) + low[2 * k + 1]).view(np.int64)
                for row in full:
                    s = _distinct(h[first[row] : first[row + 1]])
                    n[at + row] = len(s)
                    if ids[at + row] not in known:
                        known.add(ids[at + row])
                        run.append(s)
                        total += len(s)
                        if total > RUN:
                            yield frequent()
                            run, known, total = [], set(), 0
            columns = [batch.column(0), batch.column(1), pa.array(n), *(pa.array(k) for k in keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(batch.num_rows, pa.list_(pa.struct([("s", pa.int64()), ("c", pa.int64())])))], names)
        if run:
            yield frequent()


def _postings(frequent: tuple[np.ndarray, np.ndarray], shingle: int, percent: int):
    """Prefix of each set in the order of rarity: text_id, many, n, shingle, at (position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, count = frequent
        for batch in batches:
            ids, several = batch.column(0), batch.column(1)
            seen: set[bytes] = set()
            out: list[tuple[int, int, np.ndarray]] = []
            plain = ids.to_pylist()
            for row, s in _sets(batch.column(2), shingle):
                if not len(s) or plain[row] in seen:
                    continue
                seen.add(plain[row])
                m = len(s) - int(needed(np.int64(len(s)), percent)) + 1
                rank = np.zeros(len(s), np.int64)
                if len(value):
                    near = np.minimum(np.searchsorted(value, s), len(value) - 1)
                    rank = np.where(value[near] == s, count[near], 0)
                order = np.argsort(rank, kind="stable")[:m]  # s is sorted, so equal counts go by value
                out.append((row, len(s), s[order]))
            for lo in range(0, len(out), 2000):
                part = out[lo : lo + 2000]
                many = np.array([len(s) for _, _, s in part])
                rows = np.repeat(np.array([r for r, _, _ in part]), many)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)), several.take(pa.array(rows)), pa.array(np.repeat(np.array([n for _, n, _ in part]), many)),
                        pa.array(np.concatenate([s for _, _, s in part]).view(np.int64)),
                        pa.array(np.concatenate([np.arange(k) for k in many])),
                    ],
                    ["text_id", "many", "n", "shingle", "at"],
                )

    return run


def _overlaps(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.zeros(batch.num_rows, np.int64)
        # neighbouring rows often have the same left text
        for (row, a), (_, b) in zip(_sets(batch.column(2), shingle), _sets(batch.column(3), shingle), strict=True):
            same[row] = len(np.intersect1d(a, b, assume_unique=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], ["a", "b", "same"])


def overlaps(texts: DataFrame, pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``a, b, same``: exact sizes of the intersections of the texts' sets, for distinct pairs of text ids.

    Only texts that stand in a pair are moved.
    """
    wanted = kept(pairs.select(F.col("a").alias("text_id")).union(pairs.select("b")).distinct(), "jaccard-wanted")
    few = kept(texts.join(small(wanted), "text_id", "left_semi").dropDuplicates(["text_id"]), "jaccard-texts")
    left, right = few.select(F.col("text_id").alias("a"), F.col("text").alias("ta")), few.select(F.col("text_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return kept(both.mapInArrow(lambda b: _overlaps(b, shingle), "a binary, b binary, same long"), "jaccard-overlaps")


def _deltas(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Shingles that only the text or only its centre has, for texts with a third of both in common at least."""
    for batch in batches:
        rows, deltas, sizes = [], [], []
        for (row, s), (_, c) in zip(_sets(batch.column(3), shingle), _sets(batch.column(4), shingle), strict=True):
            delta = np.setxor1d(s, c, assume_unique=True)
            if 2 * len(delta) <= len(s) + len(c):
                rows.append(row)
                deltas.append(delta.view(np.int64))
                sizes.append(len(s))
        first = np.cumsum([0, *map(len, deltas)])
        values = np.concatenate([np.zeros(0, np.int64), *deltas])
        kept_rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i).take(kept_rows) for i in range(3)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))],
            ["text_id", "family", "root", "n", "delta"],
        )


def _families(near: DataFrame, roots: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame] | None:
    """``(text_id, family)`` of the sets in families of FAMILY components or more, and links ``a, b`` that connect all linked sets inside each family.

    With D the difference of a set and the centre C, two sets differ in |D| + |E| - 2 |D & E| shingles, whatever C is. So they link if and only if
    2 (100 + percent) |D & E| reaches the sum of their s = (100 + percent) |D| - (100 - percent) n. Where that sum is not above 0, both
    link with the set of least s; all other linked sets share elements, and have one among the rarest of each.
    """
    group = kept(components(near.select("a", "b"), FEW), "jaccard-near")
    rooted = group.select("node", F.col("root").alias("group")).join(roots, "node", "left").select("node", "group", F.coalesce("root", "node").alias("root"))
    crowded = rooted.select("group", "root").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") >= FAMILY).select("group")
    rooted = kept(rooted.join(crowded, "group"), "jaccard-crowded")
    if rooted.isEmpty():
        return None
    # the centre: the leader with most sets around it, later without what most of its family lacks and with what most have
    led = near.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("c")).join(rooted, "node")
    hub = led.groupBy("group").agg(F.max(F.struct("c", "node")).alias("h")).select("group", F.col("h.node").alias("family"))
    member = kept(rooted.join(hub, "group").select(F.col("node").alias("text_id"), "family", "root"), "jaccard-family")
    few = kept(bodies.join(small(member.select("text_id")), "text_id", "left_semi").dropDuplicates(["text_id"]), "jaccard-family-texts")
    both = member.join(few, "text_id").join(few.select(F.col("text_id").alias("family"), F.col("text").alias("centre")), "family")
    both = both.select("text_id", "family", "root", "text", "centre")
    deltas = kept(both.mapInArrow(lambda b: _deltas(b, shingle), "text_id binary, family binary, root binary, n long, delta array<long>"), "jaccard-deltas")
    held = deltas.select("family", F.explode("delta").alias("e")).groupBy("family", "e").agg(F.count(F.lit(1)).alias("c"))
    flips = held.join(deltas.groupBy("family").agg(F.count(F.lit(1)).alias("m")), "family").where("2 * c > m").groupBy("family").agg(F.collect_list("e").alias("flips"))
    flip = F.coalesce("flips", F.array().cast("array<long>"))
    tuned = deltas.join(flips, "family", "left").withColumn("delta", F.array_except(F.array_union("delta", flip), F.array_intersect(F.col("delta"), flip))).drop("flips")
    tuned = kept(tuned.withColumn("s", (100 + percent) * F.size("delta").cast("long") - (100 - percent) * F.col("n")), "jaccard-tuned")
    least = tuned.groupBy("family").agg(F.min(F.struct("s", "text_id", "root")).alias("m"))
    core = F.col("s") + F.col("m.s") <= 0
    tuned = kept(tuned.join(least, "family").withColumn("core", core).withColumn("root", F.when(core, F.col("m.root")).otherwise(F.col("root"))), "jaccard-centred")
    found = tuned.where("core AND text_id <> m.text_id").select(F.col("m.text_id").alias("a"), F.col("text_id").alias("b"))

    # an index of the differences, rarest first; those of one set only come before all others and meet nothing
    worth = 2 * (100 + percent)
    held = tuned.select("family", "text_id", F.explode("delta").alias("e"))
    shared = held.groupBy("family", "e").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ordered = held.join(shared, ["family", "e"]).groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("shared"))
    at = tuned.join(ordered, "text_id").select(
        "family", "text_id", "root", "s", F.col("m.s").alias("s0"), F.size("shared").alias("some"), F.posexplode("shared").alias("at", "x")
    )
    lists = at.select("family", F.col("x.e").alias("e"), "text_id", "root", "s", "s0", (F.col("some") - F.col("at")).cast("long").alias("left"))
    lists = kept(lists.where(F.col("left") * worth >= F.col("s") + F.col("s0")).drop("s0"), "jaccard-family-lists")
    side = lambda s: lists.select("family", "e", *[F.col(c).alias(f"{c}_{s}") for c in ("text_id", "root", "s", "left")])
    met = side("x").join(side("y"), ["family", "e"]).where("text_id_x < text_id_y AND root_x <> root_y")
    met = met.where(F.least("left_x", "left_y") * worth >= F.col("s_x") + F.col("s_y"))
    pairs = kept(met.select(F.col("text_id_x").alias("a"), F.col("text_id_y").alias("b")).distinct(), "jaccard-family-pairs")
    of = lambda s: tuned.select(F.col("text_id").alias(s), F.col("delta").alias(f"d{s}"), F.col("s").alias(f"s{s}"))
    read = pairs.join(of("a"), "a").join(of("b"), "b").where(F.size(F.array_intersect("da", "db")).cast("long") * worth >= F.col("sa") + F.col("sb"))
    return tuned.select("text_id", "family"), kept(found.unionByName(read.select("a", "b")), "jaccard-family-links")


def links(same: Column, n: Column, m: Column, percent: int = PERCENT) -> Column:
    return F.lit(100) * same >= F.lit(percent) * (n + m - same)


def linked_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(signatures, roots)``: text_id and set size of every document, and ``node, root`` of linked text ids."""
    signatures, found, roots = _linked(docs, shingle, percent, False)
    # sets connected so far are one node for what is left
    return signatures, components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), FEW)


def linked_pairs(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(signatures, pairs)``: doc_id, text_id and set size n of every document, and every linked pair ``a < b`` of different texts.

    The whole join: pairs inside a component are computed too, so the pairs grow with the square of a group of near copies. Equal texts
    are one text_id and no pair.
    """
    signatures, found, _ = _linked(docs, shingle, percent, True)
    return signatures.select("doc_id", "text_id", "n"), found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_counts(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id and n_links, the number of other rows it links with; rows with equal words link too."""
    signatures, pairs = linked_pairs(docs, shingle, percent)
    rows = kept(signatures, "jaccard-members")
    copies = rows.where("n > 0").groupBy("text_id").agg(F.count(F.lit(1)).alias("copies"))
    both = kept(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "jaccard-both")
    others = both.join(copies, F.col("b") == F.col("text_id")).groupBy("a").agg(F.sum("copies").alias("others"))
    own = copies.join(others, F.col("a") == F.col("text_id"), "left").select("text_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(own, "text_id", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent shingles, at most FREQUENT: those above a count that a histogram gives, so
    that the driver sorts and merges nothing."""
    grade = F.floor(F.log2(F.col("c")) * 16)
    sizes = counts.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("grade")).collect()
    total = np.cumsum([r.n for r in sizes])
    fit = int(np.searchsorted(total, FREQUENT, side="right")) if sizes else 0
    if not fit:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.where(grade >= sizes[fit - 1].grade).toArrow()
    value, count = top["s"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(value)
    return value[order], count[order]


def _linked(docs: DataFrame, shingle: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(signatures, found, roots)``: links of the index and components of the leaders' links; ``every``: found has all links, also those inside a component."""
    texts = docs.select("doc_id", text_id(F.col("text")).alias("text_id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = texts.mapInArrow(lambda b: _signatures(b, shingle), f"doc_id {kind}, text_id binary, n long, k1 long, k2 long, k3 long, frequent array<struct<s:long,c:long>>")
    made = kept(made, "jaccard-signatures")
    signatures = made.where("n IS NOT NULL").drop("frequent")
    sets = kept(
        signatures.where("n > 0").groupBy("text_id").agg(F.first("n").alias("n"), *[F.first(k).alias(k) for k in ("k1", "k2", "k3")]), "jaccard-sets"
    )
    sized = sets.select("text_id", "n")
    bodies = texts.select("text_id", "text")

    # 1. every set against the leader of each of its three MinHash pairs, with other leaders each round
    alike, roots = None, None
    for turn in range(ROUNDS):
        stars = []
        for k in ("k1", "k2", "k3"):
            chosen = F.min(F.struct(F.xxhash64(F.lit(turn), "text_id").alias("h"), "text_id", "n")).alias("lead")
            leader = sets.groupBy(k).agg(chosen, F.count(F.lit(1)).alias("size")).where("size > 1")
            near = sets.join(leader, k).select(F.col("lead.text_id").alias("a"), F.col("lead.n").alias("na"), F.col("text_id").alias("b"), F.col("n").alias("nb"))
            stars.append(near.where(f"a <> b AND 100 * least(na, nb) >= {percent} * greatest(na, nb)"))
        star = stars[0].unionByName(stars[1]).unionByName(stars[2]).distinct()
        if roots is not None:
            at = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
            star = star.join(at("a"), "a", "left").join(at("b"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").drop("ra", "rb")
        star = kept(star, "jaccard-stars")
        known = overlaps(bodies, star.select("a", "b"), shingle).join(star, ["a", "b"])
        found = known.where(links(F.col("same"), F.col("na"), F.col("nb"), min(percent, 50))).select("a", "na", "b", "nb", "same")
        alike = kept(found if alike is None else alike.unionByName(found), "jaccard-star-links")
        good = alike.where(links(F.col("same"), F.col("na"), F.col("nb"), percent))
        roots = kept(components(good.select("a", "b"), FEW), "jaccard-roots")
    # the leader of a set: the linked one with the largest overlap; a set without any leads itself
    lead = good.groupBy(F.col("b").alias("text_id")).agg(F.max(F.struct("same", F.col("a").alias("leader"), F.col("na").alias("n_leader"))).alias("l"))
    state = sized.join(lead, "text_id", "left").join(roots.select(F.col("node").alias("text_id"), "root"), "text_id", "left").select(
        "text_id", "n", F.coalesce("l.leader", "text_id").alias("leader"), F.coalesce("l.n_leader", "n").alias("n_leader"),
        F.coalesce("l.same", "n").alias("same_leader"), F.coalesce("root", "text_id").alias("root"),
    )
    state = kept(state, "jaccard-state")
    inside = None if every else _families(alike, roots, bodies, shingle, percent)
    if inside:
        state = kept(state.join(inside[0], "text_id", "left"), "jaccard-parted")
    else:
        state = state.withColumn("family", F.lit(None).cast("binary"))

    # 2. index lists of the rarest shingles, without those of a single component
    counts = made.where("frequent IS NOT NULL").select(F.explode("frequent").alias("f")).groupBy("f.s").agg(F.sum("f.c").alias("c"))
    frequent = docs.sparkSession.sparkContext.broadcast(_most_frequent(kept(counts, "jaccard-counts")))
    # a text that stands in several rows gives its postings once
    several = kept(signatures.groupBy("text_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 AND text_id IS NOT NULL").select("text_id", F.lit(True).alias("many")), "jaccard-several")
    marked = bodies.join(small(several), "text_id", "left").select("text_id", F.coalesce("many", F.lit(False)).alias("many"), "text")
    postings = kept(
        marked.mapInArrow(lambda b: _postings(frequent.value, shingle, percent)(b), "text_id binary, many boolean, n long, shingle long, at long"), "jaccard-postings"
    )
    frequent.destroy()
    postings = postings.where("NOT many").unionByName(postings.where("many").distinct()).drop("many")
    shared = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("shingle")
    # for all links every set is a component of its own; the sets without a family are one part
    named = state.select("text_id", F.col("text_id" if every else "root").alias("root"), F.coalesce("family", F.lit(b"")).alias("part"))
    lists = postings.join(shared, "shingle").join(named, "text_id")
    lists = kept(lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))), "jaccard-lists")
    block = lists.groupBy("shingle", "band", "part").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("at").alias("at"), F.max("at").alias("upto"), F.min("n").alias("n0"), F.max("n").alias("n1")
    )
    as_ = lambda df, side, *cols: df.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in cols])
    x, y = (as_(block, side, "band", "part", "r0", "r1", "at", "upto", "n0", "n1") for side in "xy")
    # common shingles before this one, and what follows it
    reach = F.least("upto_x", "upto_y") + F.least(F.col("n1_x") - F.col("at_x"), F.col("n1_y") - F.col("at_y"))
    skip = (reach * (100 + percent) < percent * (F.col("n0_x") + F.col("n0_y"))) | (
        (F.col("r0_x") == F.col("r1_x")) & (F.col("r0_y") == F.col("r1_y")) & (F.col("r0_x") == F.col("r0_y"))
    )
    skip = skip | ((F.col("part_x") == F.col("part_y")) & (F.length("part_x") > 0))  # a family's own links are known
    opened = x.join(y, "shingle").where("band_y BETWEEN band_x AND band_x + 1").where(~skip).select("shingle", "band_x", "part_x", "band_y", "part_y")
    left, right = (as_(lists, side, "text_id", "n", "at", "root", "band", "part") for side in "xy")
    met = opened.join(left, ["shingle", "band_x", "part_x"]).join(right, ["shingle", "band_y", "part_y"])
    met = met.where("root_x <> root_y AND (band_x < band_y OR text_id_x < text_id_y)")
    met = met.where(f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)")
    most = F.least("at_x", "at_y") + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    met = met.where(most * (100 + percent) >= percent * (F.col("n_x") + F.col("n_y")))
    # of the set whose prefix ends first, every common shingle is counted or lies behind the prefix
    behind = F.ceil(F.lit(percent) * F.greatest("n_x", "n_y") / 100) - 1
    pairs = met.groupBy(F.least("text_id_x", "text_id_y").alias("a"), F.greatest("text_id_x", "text_id_y").alias("b")).agg(
        F.count(F.lit(1)).alias("met"), F.first(behind).alias("behind"), F.first(F.col("n_x") + F.col("n_y")).alias("both")
    )
    pairs = pairs.where((F.col("met") + F.col("behind")) * (100 + percent) >= percent * F.col("both")).select("a", "b")
    side = lambda s: state.select(*[F.col(c).alias(f"{c}_{s}") for c in ("text_id", "n", "leader", "n_leader", "same_leader")]).withColumnRenamed(f"text_id_{s}", s)
    pairs = kept(pairs.join(side("a"), "a").join(side("b"), "b"), "jaccard-pairs")

    # 3. leaders answer for their sets
    u, v = F.least("leader_a", "leader_b").alias("u"), F.greatest("leader_a", "leader_b").alias("v")
    asked = pairs.where("leader_a <> leader_b").select(u, v).distinct()
    answers = overlaps(bodies, asked.select(F.col("u").alias("a"), F.col("v").alias("b")), shingle).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("same").alias("core"))
    told = pairs.withColumns({"u": u, "v": v}).join(answers, ["u", "v"], "left")
    told = told.withColumn("core", F.when(F.col("u") == F.col("v"), F.col("n_leader_a")).otherwise(F.col("core")))
    more = F.col("n_a") - F.col("same_leader_a") + F.col("n_b") - F.col("same_leader_b")
    less = F.col("n_leader_a") - F.col("same_leader_a") + F.col("n_leader_b") - F.col("same_leader_b")
    told = kept(told.withColumn("most", F.least(F.col("core") + more, "n_a", "n_b")).withColumn("least", F.col("core") - less), "jaccard-told")
    sure = links(F.col("least"), F.col("n_a"), F.col("n_b"), percent)
    open_ = told.where(~sure & links(F.col("most"), F.col("n_a"), F.col("n_b"), percent))
    read = overlaps(bodies, open_.select("a", "b").distinct(), shingle).join(open_.select("a", "b", "n_a", "n_b"), ["a", "b"])
    found = told.where(sure).select("a", "b").unionByName(read.where(links(F.col("same"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b"))
    return signatures, found.unionByName(inside[1]) if inside else found, roots


def jaccard_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Texts without words (null too) have no shingles and link with nothing; equal texts with words always link. A null
    doc_id takes part but names no component (null where a class has no id); repeated rows are rows like others; only doc_id and
    text are read; no rows give no rows.
    """
    signatures, roots = linked_sets(docs, shingle, percent)
    rows = signatures.join(roots.select(F.col("node").alias("text_id"), "root"), "text_id", "left")
    rows = kept(rows.select("doc_id", "n", F.coalesce("root", "text_id").alias("root")), "jaccard-rows")
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_class(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each class: the smallest doc_id and text hash (nulls last); all columns.

    Documents without words are no copies of each other and stay.
    """
    signatures, roots = linked_sets(docs, shingle, percent)
    rows = signatures.where("n > 0").join(roots.select(F.col("node").alias("text_id"), "root"), "text_id", "left")
    rows = rows.select("doc_id", "text_id", F.coalesce("root", "text_id").alias("root"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")).alias("f"))
    keep = first.select(F.col("f.doc_id").alias("first_id"), F.col("f.text_id").alias("first_text"))
    own = rows.groupBy("doc_id", "text_id").agg(F.count(F.lit(1)).alias("rows"))
    own = own.join(keep, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_id") == F.col("first_text")), "left")
    id_, text = free(docs, "id", "text_hash")
    marks = kept(own.select(F.col("doc_id").alias(id_), F.col("text_id").alias(text), F.col("rows") > 1, F.col("first_text").isNotNull()).toDF(id_, text, "many", "keep"), "jaccard-marks")
    here = docs["doc_id"].eqNullSafe(F.col(id_)) & (text_id(docs["text"]) == F.col(text))
    out = docs.join(small(marks.where("NOT keep OR many").select(id_, text)), here, "left_anti")
    # rows that stand in the input several times, once
    again = docs.join(small(marks.where("keep AND many").select(id_, text)), here, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.unionByName(again)
