"""Embedding near-dedup by dual traversal of cover trees.

Unit vectors lie in nested levels of balls with halving radii. Two subtrees are left out when their
centres are further apart than the link distance and both covering radii allow, and link as a whole when even
their far ends are close enough; what is left is compared by its exact cosine. Vectors of a label are dealt to
cells around pivots and cells to blocks of bounded size; a task traverses the trees of one pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept
from .components import components

PIVOTS = 64
BLOCK_ROWS = 4096
LEAF = 24
SLACK = 1e-7
#: Centres chosen at once; rows up to which two runs are compared as they lie; what a pair of vectors by itself and a
#: call for a pair of nodes cost, in pairs of vectors compared as runs (an order of work only, no link is lost).
STEP, FEW, SCATTERED, CALL = 256, 256, 32, 2048


class CoverTree:
    """Balls over unit vectors: each node has a centre, its covering radius and a run of ``order``; children halve the radius.

    The first net is of radius ``top``: wider balls of vectors with many components lie within reach of all others. Once built,
    ``x`` is in the tree's order, so the members of a node are a slice of it.
    """

    def __init__(self, x: np.ndarray, top: float = 1.0) -> None:
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.begin, self.end, self.children = [], [], [], [], []
        if len(x):
            self._grow(top)
        place = np.empty(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        self.x, self.c, self.r = x[self.order], place[np.array(self.centre, np.int64)], np.array(self.radius)
        self.lo, self.hi = np.array(self.begin, np.int64), np.array(self.end, np.int64)
        self.size = self.hi - self.lo

    def _node(self, begin: int, end: int, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.begin.append(begin)
        self.end.append(end)
        self.children.append(None)
        return len(self.centre) - 1

    def _net(self, members: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each member's centre at ``level`` by number, its distance from it, and the centres: each in turn takes what is left within ``level``."""
        number, far, centres = np.zeros(len(members), np.int64), np.zeros(len(members)), []
        left = np.arange(len(members))
        while len(left):
            head = self.x[members[left[:STEP]]]
            near, free, chosen = distance(head, head) <= level, np.ones(len(head), bool), []
            for i in range(len(head)):
                if free[i]:
                    chosen.append(i)
                    free &= ~near[i]
            apart = distance(self.x[members[left]], head[chosen])
            apart[chosen, range(len(chosen))] = -1.0  # a centre is its own
            first = (apart <= level).argmax(1)
            first[chosen] = range(len(chosen))
            apart = apart[np.arange(len(left)), first]
            inside = apart <= level
            number[left[inside]], far[left[inside]] = first[inside] + len(centres), np.maximum(apart[inside], 0.0)
            centres.extend(members[left[chosen]])
            left = left[~inside]
        return number, far, np.array(centres, np.int64)

    def _grow(self, top: float) -> None:
        """Open nodes from the root on until they are small or narrow."""
        whole = self.order
        stack = [(self._node(0, len(whole), 0, float(distance(self.x[:1], self.x).max())), 2.0 * top)]
        while stack:
            node, level = stack.pop()
            begin, end = self.begin[node], self.end[node]
            if end - begin <= LEAF or self.radius[node] <= 1e-6:
                continue
            level = min(level, top)
            while level >= self.radius[node]:
                level /= 2
            members = self.order[begin:end].copy()
            number, far, centres = self._net(members, level)
            by = np.argsort(number, kind="stable")
            self.order[begin:end] = members[by]
            ends = np.cumsum(np.bincount(number, minlength=len(centres)))
            widest = np.maximum.reduceat(far[by], np.concatenate([[0], ends[:-1]]))
            kids = [self._node(begin + lo, begin + hi, c, r) for lo, hi, c, r in zip([0, *ends[:-1].tolist()], ends.tolist(), centres.tolist(), widest.tolist(), strict=True)]
            self.children[node] = np.array(kids, np.int64)
            stack += [(k, level) for k in kids]

    def opened(self, node: int) -> np.ndarray:
        """The children of a node, which follow each other in its run; a leaf itself."""
        kids = self.children[node]
        return np.array([node]) if kids is None else kids


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2.0
    d += 2.0
    return np.sqrt(np.maximum(d, 0.0, out=d), out=d)


class Links:
    """Links between rows: weights linked to each row, and the smallest row that each is connected with."""

    def __init__(self, weight: np.ndarray) -> None:
        self.count, self.weight, self.root = np.zeros(len(weight), np.int64), weight, np.arange(len(weight))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """The rows ``i`` and ``j``, one by one, are connected."""
        while len(i):
            x, y = self.root[i], self.root[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def own(self, a: np.ndarray) -> None:
        """All rows of ``a`` link with one another."""
        self.count[a] += self.weight[a].sum() - self.weight[a]
        self.join(a, np.full(len(a), a[0]))

    def every(self, a: np.ndarray, b: np.ndarray) -> None:
        """All rows of ``a`` link with all of ``b`` (disjoint)."""
        self.count[a] += self.weight[b].sum()
        self.count[b] += self.weight[a].sum()
        both = np.concatenate([a, b])
        self.join(both, np.full(len(both), a[0]))

    def some(self, a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> None:
        """Rows of ``a`` (no row twice) link with those of ``b`` (no row twice) where ``hit`` says."""
        if hit.any():
            drawn = hit.astype(np.float64)
            self.count[a] += np.rint(drawn @ self.weight[b]).astype(np.int64)
            self.count[b] += np.rint(drawn.T @ self.weight[a]).astype(np.int64)
            i, j = np.nonzero(hit & (self.root[a][:, None] != self.root[b][None, :]))
            self.join(a[i], b[j])

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """The rows ``i`` and ``j`` link one by one (no pair twice)."""
        rows = len(self.count)
        for x, y in ((i, j), (j, i)):
            self.count += np.rint(np.bincount(x, self.weight[y], rows)).astype(np.int64)
        self.join(i, j)


def traverse(s: CoverTree, t: CoverTree, at: int, links: Links, raw: np.ndarray, norm: np.ndarray, cosine: float) -> None:
    """Add all links between the trees ``s`` and ``t``, or within one when they are the same; ``at`` is t's first row.

    Rows are in the order of the trees. Pairs of nodes that the bounds leave open are opened further, down to FEW pairs of vectors; where
    that would be more than a share of all pairs of two runs, the runs are compared as they lie.
    """
    reach, same = float(np.sqrt(2.0 - 2.0 * cosine)), s is t

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (raw[a] @ raw[b].T) / np.outer(norm[a], norm[b]) >= cosine

    def dense(x: np.ndarray, y: np.ndarray, later: bool) -> None:
        """The members of the nodes ``x`` with those of ``y``, each nodes that follow each other; or only with those of ``later`` nodes."""
        a, b = np.arange(s.lo[x[0]], s.hi[x[-1]]), np.arange(t.lo[y[0]], t.hi[y[-1]])
        of_a, of_b = np.repeat(x, s.size[x]), np.repeat(y, t.size[y])
        for lo in range(0, len(a), 1024):
            part = slice(lo, lo + 1024)
            hit = exact(a[part], b + at)
            if later:
                hit &= of_a[part][:, None] < of_b[None, :]
            links.some(a[part], b + at, hit)

    def singly(x: np.ndarray, y: np.ndarray) -> None:
        """The members of each node of ``x`` with those of the node of ``y`` beside it."""
        n = s.size[x] * t.size[y]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(s.lo[x], n) + nth // np.repeat(t.size[y], n)
        j = np.repeat(t.lo[y], n) + nth % np.repeat(t.size[y], n) + at
        for lo in range(0, len(i), 1 << 16):
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            hit = np.einsum("ij,ij->i", raw[a], raw[b]) / (norm[a] * norm[b]) >= cosine
            links.pairs(a[hit], b[hit])

    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        a, b = np.arange(s.lo[p], s.hi[p]), np.arange(t.lo[q], t.hi[q]) + at
        if same and p == q:
            if 2 * s.r[p] < reach - SLACK:
                links.own(a)
                continue
            if s.children[p] is None or len(a) <= FEW:
                links.some(a, a, np.triu(exact(a, a), 1))
                continue
            own = s.children[p]
            stack += [(k, k) for k in own[s.size[own] > 1].tolist()]
        elif (s.children[p] is None and t.children[q] is None) or len(a) * len(b) <= FEW * FEW:
            links.some(a, b, exact(a, b))
            continue
        xs, ys, later = s.opened(p), t.opened(q), same and p == q
        for lo in range(0, len(xs), 1024):
            x = xs[lo : lo + 1024]
            y = ys[lo:] if later else ys
            apart = distance(s.x[s.c[x]], t.x[t.c[y]])
            both = s.r[x][:, None] + t.r[y][None, :]
            open_ = apart <= both + (reach + SLACK)
            if later:
                open_ &= x[:, None] < y[None, :]
            i, j = np.nonzero(open_)
            whole = apart[i, j] + both[i, j] < reach - SLACK
            work = s.size[x[i]] * t.size[y[j]]
            little = work <= SCATTERED
            if np.where(little, work * SCATTERED, CALL + work * ~whole).sum() > s.size[x].sum() * t.size[y].sum():
                dense(x, y, later)
                continue
            u, v = x[i], y[j]
            singly(u[little], v[little])
            for u, v, all_ in zip(u[~little].tolist(), v[~little].tolist(), whole[~little].tolist(), strict=True):
                if all_:
                    links.every(np.arange(s.lo[u], s.hi[u]), np.arange(t.lo[v], t.hi[v]) + at)
                else:
                    stack.append((u, v))


def _unit(column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.stack(column.to_list()).astype(np.float64)
    norm = np.sqrt((raw * raw).sum(1))
    return raw, norm, raw / norm[:, None]


def _pair(cosine: float):
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    top = 2.0 ** np.floor(np.log2(max(reach, 1e-6)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "cid"])
        raw, norm, unit = _unit(pdf["embedding"])
        first = int((pdf["side"] == 0).sum())
        s = CoverTree(unit[:first], top)
        t = s if first == len(pdf) else CoverTree(unit[first:], top)
        order = s.order if t is s else np.concatenate([s.order, t.order + first])
        cid, links = pdf["cid"].to_numpy()[order], Links(pdf["m"].to_numpy(np.int64)[order])
        traverse(s, t, 0 if t is s else first, links, raw[order], norm[order], cosine)
        hit, low = np.flatnonzero(links.count), np.flatnonzero(links.root != np.arange(len(cid)))
        a, b = np.concatenate([cid[hit], cid[low]]), np.concatenate([np.full(len(hit), None), cid[links.root[low]]])
        n = np.concatenate([links.count[hit], np.zeros(len(low), np.int64)])
        return pd.DataFrame({"a": a, "b": b, "n": n})

    return run


def _cells(pivots: pd.DataFrame):
    """Nearest pivot of the own label for each vector, with the distance."""
    by_label = {key: np.stack(part["embedding"].to_list()).astype(np.float64) for key, part in pivots.groupby(["label", "dim"])}
    by_label = {key: p / np.linalg.norm(p, axis=1, keepdims=True) for key, p in by_label.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, far = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            for key, at in pdf.groupby(["label", "dim"]).indices.items():
                _, _, unit = _unit(pdf["embedding"].iloc[at])
                d = distance(unit, by_label[key])
                cell[at] = d.argmin(1)
                far[at] = d.min(1)
            yield pdf.assign(cell=cell, far=far)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine in double precision is at least ``cosine``. Null,
    zero and empty vectors, those with null or non-finite components, and those without label link with nothing and keep
    themselves. Equal vectors of a label form one class, compared once; links count rows, so all copies count. Vectors of
    different length do not link. A null vec_id counts as a link but names no component (null where no id is left); repeated rows
    are rows like others; extra columns are not read; no rows give no rows.
    At most PIVOTS pivots a label, those with the smallest hash, are collected; labels are taken to be few.
    """
    good = "embedding IS NOT NULL AND label IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(embedding, x -> x <> 0)"
    vectors = vectors.select("vec_id", "embedding", "label").withColumn(
        "cid", F.when(F.expr(good), F.unhex(F.md5(F.concat_ws("/", F.col("label").cast("string"), F.array_join("embedding", ",")))))
    )
    rows = kept(vectors.withColumn("dim", F.size("embedding")), "vectors")
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("label").alias("label"), F.first("dim").alias("dim"),
        F.first("embedding").alias("embedding"),
    )
    classes = kept(classes, "vector-classes")
    linked, edges = _linked(classes, cosine, block_rows)
    roots = components(edges)
    own = classes.select("cid", "least", "m").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
    own = own.withColumn("root", F.coalesce("root", "cid"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    own = own.join(least, "root").join(linked, "cid", "left").select("cid", "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = rows.select("vec_id", "cid").join(own, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _linked(classes: DataFrame, cosine: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Weights linked to each class (cid, n), and edges (a, b) that connect the linked classes."""
    spark = classes.sparkSession
    # candidates for pivots: the smallest ids of a bounded number of hash ranges, so no label is sorted as a whole
    thin = classes.withColumn("range", F.pmod(F.xxhash64("cid"), F.lit(PIVOTS))).groupBy("label", "dim", "range").agg(F.min(F.struct("cid", "embedding")).alias("p"))
    pivots = thin.select("label", "dim", "p.cid", "p.embedding").toPandas()
    if not len(pivots):
        nothing = classes.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0)
        return classes.select("cid", F.col("m").alias("n")).limit(0), nothing
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    cells = kept(classes.mapInPandas(_cells(pivots), f"{named}, cell long, far double"), "vector-cells")
    # a cell's vectors by distance from the pivot, cut into blocks: rings of one cell stay near each other
    size = cells.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / block_rows)
    blocked = cells.join(size, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("cid"), parts))
    blocked = kept(blocked.withColumn("block", F.concat_ws(":", "cell", "part")).drop("size"), "vector-blocks")
    balls = blocked.groupBy("label", "dim", "cell", "block").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n"))
    # cells smaller than a block travel together: bins of about block_rows vectors
    running = F.sum("n").over(Window.partitionBy("label", "dim").orderBy("cell", "block"))
    balls = kept(balls.withColumn("bin", F.floor((running - F.col("n")) / block_rows)), "vector-balls")
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    unit = {k: np.stack(p["embedding"].to_list()).astype(np.float64) for k, p in pivots.groupby(["label", "dim"])}
    gaps = []
    for (label, dim), p in unit.items():
        p = p / np.linalg.norm(p, axis=1, keepdims=True)
        d = distance(p, p)
        gaps += [(int(label), int(dim), i, j, float(d[i, j])) for i in range(len(p)) for j in range(len(p))]
    gaps = spark.createDataFrame(gaps, "label int, dim int, cell long, cell2 long, gap double")
    other = balls.select("label", "dim", F.col("cell").alias("cell2"), F.col("r").alias("r2"), F.col("bin").alias("bin2"))
    near = balls.join(gaps, ["label", "dim", "cell"]).join(other, ["label", "dim", "cell2"]).where(F.col("gap") <= F.col("r") + F.col("r2") + F.lit(reach + SLACK))
    pairs = kept(near.where("bin <= bin2").select("label", "dim", "bin", "bin2").distinct(), "vector-pairs")
    member = blocked.join(balls.select("label", "dim", "block", "bin"), ["label", "dim", "block"])
    task = F.concat_ws("/", "label", "dim", "bin", "bin2").alias("task")
    first = member.join(pairs, ["label", "dim", "bin"]).select(task, F.lit(0).alias("side"), "cid", "m", "embedding")
    second = member.withColumnRenamed("bin", "bin2").join(pairs.where("bin < bin2"), ["label", "dim", "bin2"]).select(task, F.lit(1).alias("side"), "cid", "m", "embedding")
    found = first.unionByName(second).groupBy("task").applyInPandas(_pair(cosine), "a binary, b binary, n long")
    found = kept(found, "vector-links")
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    return linked, found.where("b IS NOT NULL").select("a", "b")
