"""Random forests from histograms, of any depth and with a least size of nodes to split.

Features are binned once (``BINS`` quantiles) and the binned rows are written once.
Every tree weighs its rows by a bootstrap, Poisson with mean 1 from a hash of row,
tree and seed.  A node looks at the square root of all features, drawn by its tree and
its path, and at more of them only while none of those can split it; the split has the
least weighted Gini impurity.

1. Nodes of more than ``small`` rows are split level by level for all trees at once:
   tasks count (feature, bin, class) of such nodes over their rows, Spark adds the counts,
   and the best split of each node comes from its sums.  ``small`` is at least
   rows / ``TOP``, so these tops have some 2 x ``TOP`` nodes a tree, and are broadcast.
2. The rows of every smaller node are gathered and its subtree is grown in one task, level
   by level: nodes of few rows are split together, by sorted rows instead of histograms.

Every node keeps its class weights, rows and depth, and neither its features nor its split
depend on limits.  So a forest without limits holds all forests with fewer trees, with a
depth limit, or with a larger least size of nodes to split: they are its first trees, cut
where the limit is met.  ``predict`` reads any number of settings from one
forest; a grid of 3 x 4 x 3 takes one fit.

A test row visits each tree: it walks the top, then goes to the task that has its subtree.
Class shares of a row's trees are added up by Spark.

Defined cases: labels are whole numbers from 0; null or NaN features count as the lowest bin; ids must be unique
within a table (a bootstrap goes by id); constant features never split; equal shares of
classes give the smaller class, equal splits the feature looked at first, then the lower
bin; an empty training table gives an error, an empty test table no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.sources import scratch

#: Bins of a feature, and quantiles' accuracy.
BINS, ACCURACY = 128, 10_000
#: Rows of a node that is finished in one task, at least, and nodes of a tree's top, about half of them at most.
SMALL, TOP = 8192, 512
#: In a task, nodes of fewer rows are split together, so many rows times features at once.
FEW, TOGETHER = 128, 1 << 19
ROOT = 1
_NODE = "feature array<int>, bin array<int>, left array<int>, depth array<int>, rows array<long>, shares array<double>"


def _mixed(*parts) -> np.ndarray:
    """64-bit hashes of the parts, by row."""
    with np.errstate(over="ignore"):
        h = np.uint64(0x9E3779B97F4A7C15)
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(29))
            h = h * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
        return h


def bootstrap(ids: np.ndarray, tree, seed: int) -> np.ndarray:
    """How often each row counts in a tree: Poisson with mean 1, 7 at most (more has a chance of 1e-5)."""
    u = (_mixed(ids, tree, seed) >> np.uint64(11)).astype(np.float64) / 2.0**53
    steps = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720], dtype=float))
    return np.searchsorted(steps, u, side="right").astype(np.int64)


def children(nodes: np.ndarray, right: bool) -> np.ndarray:
    """The names of nodes' children: 64 bits that stand for the path."""
    return _mixed(nodes, int(right) + 1).astype(np.int64)


def child(node: int, right: bool) -> int:
    """The name of a node's child."""
    return int(children(np.int64(node), right))


def draws(tree: int, nodes: np.ndarray, seed: int, features: int) -> np.ndarray:
    """All features in the order in which each node looks at them, a row a node."""
    return np.argsort(_mixed(seed, tree, nodes[:, None], np.arange(features)), axis=1, kind="stable")


def drawn(tree: int, node: int, seed: int, features: int) -> np.ndarray:
    """All features in the order in which a node looks at them."""
    return draws(tree, np.array([node], dtype=np.int64), seed, features)[0]


def best_split(counts: np.ndarray, rows: np.ndarray, leaf: int) -> tuple[float, int, int] | None:
    """(impurity, feature, bin): the best split of counts (features x bins x classes, weighted) and rows (features x bins), left being bins up to it; None if there is none."""
    left, n = np.cumsum(counts, axis=1)[:, :-1], np.cumsum(rows, axis=1)
    total, n, every = counts.sum(axis=1)[:, None], n[:, :-1], n[:, -1:]
    right = total - left
    wl, wr = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        impurity = wl - (left * left).sum(axis=2) / wl + wr - (right * right).sum(axis=2) / wr
    impurity[~((n >= leaf) & (every - n >= leaf) & (wl > 0) & (wr > 0))] = np.inf
    if not impurity.size:  # one bin: these features are constant here
        return None
    at = int(np.argmin(impurity))
    f, b = divmod(at, impurity.shape[1])
    return (float(impurity[f, b]), f, b) if np.isfinite(impurity[f, b]) else None


def _counts(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted counts (features x bins x classes) and rows (features x bins) of binned rows."""
    width = x.shape[1]
    bins = int(x.max()) + 1
    cell = x.astype(np.int64) + np.arange(width) * bins
    counts = np.bincount((cell * classes + y[:, None]).ravel(), weights=np.repeat(w, width), minlength=width * bins * classes)
    rows = np.bincount(cell.ravel(), minlength=width * bins)
    return counts.reshape(width, bins, classes), rows.reshape(width, bins)


class Grower:
    """Grows subtrees in a task."""

    def __init__(self, seed: int, features: int, classes: int, leaf: int, depth: int | None, split: int):
        self.seed, self.features, self.classes, self.leaf, self.depth, self.split = seed, features, classes, leaf, depth, split
        self.look = max(1, int(features**0.5))

    def choose(self, tree: int, node: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[int, int] | None:
        order = drawn(tree, node, self.seed, self.features)
        for a in range(0, self.features, self.look):
            some = order[a : a + self.look]
            found = best_split(*_counts(x[:, some], y, w, self.classes), self.leaf)
            if found:
                return int(some[found[1]]), found[2]
        return None

    def together(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the feature, bin) of the best split of each node, place -1 if there is none, as ``best_split`` finds it.

        Rows of a node are ``sizes`` neighbours in x (rows x features that their node looks at), y and w.
        """
        width, nodes = x.shape[1], len(sizes)
        # a segment is a feature of a node; its rows by bin
        segment = (np.repeat(np.arange(nodes), sizes)[:, None] * width + np.arange(width)).ravel()
        key = segment * 256 + x.ravel()
        order = np.argsort(key, kind="stable")
        key = key[order]
        own = np.zeros((len(order), self.classes))
        own[np.arange(len(order)), np.repeat(y, width)[order]] = np.repeat(w, width)[order]
        sums = np.cumsum(own, axis=0)
        size = np.repeat(sizes, width)
        end = np.cumsum(size) - 1
        before = np.concatenate((np.zeros((1, self.classes)), sums[end[:-1]]))
        total = sums[end] - before
        at = np.flatnonzero(key[1:] != key[:-1])  # the last rows of bins
        seg = key[at] // 256
        at, seg = (v[at != end[seg]] for v in (at, seg))
        n = at - (end - size)[seg]
        at, seg = (v[(n >= self.leaf) & (size[seg] - n >= self.leaf)] for v in (at, seg))
        place, bins = np.full(nodes, -1), np.zeros(nodes, dtype=np.int64)
        if len(at):
            left = sums[at] - before[seg]
            right = total[seg] - left
            wl, wr = left.sum(axis=1), right.sum(axis=1)
            impurity = wl - (left * left).sum(axis=1) / wl + wr - (right * right).sum(axis=1) / wr
            node = seg // width
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            best = np.repeat(np.minimum.reduceat(impurity, first), np.diff(np.append(first, len(node))))
            hit = np.flatnonzero(impurity == best)
            some, one = np.unique(node[hit], return_index=True)  # the first of each node
            place[some], bins[some] = seg[hit[one]] % width, key[at[hit[one]]] % 256
        return place, bins

    def chosen(self, tree: int, names: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, bin) of the split of each node, feature -1 if there is none; a node's rows are ``sizes`` of ``rows`` from ``starts`` on."""
        feature, bins = np.full(len(names), -1), np.zeros(len(names), dtype=np.int64)
        for i in np.flatnonzero(sizes >= FEW):
            mine = rows[starts[i] : starts[i] + sizes[i]]
            found = self.choose(tree, int(names[i]), x[mine], y[mine], w[mine])
            if found:
                feature[i], bins[i] = found
        few = np.flatnonzero(sizes < FEW)
        lots = np.cumsum(sizes[few] * self.look) // TOGETHER
        for some in np.split(few, np.flatnonzero(np.diff(lots)) + 1) if len(few) else ():
            order = draws(tree, names[some], self.seed, self.features)
            left = np.arange(len(some))  # nodes without a split so far
            for a in range(0, self.features, self.look):
                size = sizes[some[left]]
                mine = rows[np.repeat(starts[some[left]] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                looked = order[left, a : a + self.look]
                place, at = self.together(x[mine[:, None], np.repeat(looked, size, axis=0)], y[mine], w[mine], size)
                hit = place >= 0
                feature[some[left[hit]]], bins[some[left[hit]]] = looked[hit, place[hit]], at[hit]
                left = left[~hit]
                if not len(left):
                    break
        return feature, bins

    def tree(self, tree: int, node: int, depth: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, list]:
        """Nodes from ``node`` on as columns; ``left`` is a node's left child, the right one stands after it, -1 marks a leaf."""
        out: dict[str, list] = {k: [] for k in ("feature", "bin", "left", "depth", "rows", "shares")}
        names, rows, sizes, done = np.array([node], dtype=np.int64), np.arange(len(y)), np.array([len(y)]), 0
        while len(names):
            own = np.repeat(np.arange(len(names)), sizes)
            weights = np.bincount(own * self.classes + y[rows], weights=w[rows], minlength=len(names) * self.classes).reshape(-1, self.classes)
            feature, bins = np.full(len(names), -1), np.zeros(len(names), dtype=np.int64)
            if self.depth is None or depth < self.depth:
                some = np.flatnonzero((sizes >= max(self.split, 2)) & ((weights > 0).sum(axis=1) > 1))
                if len(some):
                    feature[some], bins[some] = self.chosen(tree, names[some], rows, (np.cumsum(sizes) - sizes)[some], sizes[some], x, y, w)
            split = feature >= 0
            rank, done = np.cumsum(split) - 1, done + len(names)
            for k, v in (("feature", feature), ("bin", bins), ("left", np.where(split, done + 2 * rank, -1)), ("depth", np.full(len(names), depth)), ("rows", sizes)):
                out[k] += v.tolist()
            out["shares"] += (weights / weights.sum(axis=1, keepdims=True)).ravel().tolist()
            on = split[own]
            rows, own = rows[on], own[on]
            side = 2 * rank[own] + (x[rows, feature[own]] > bins[own])
            rows, sizes = rows[np.argsort(side, kind="stable")], np.bincount(side, minlength=2 * int(split.sum()))
            names = np.stack([children(names[split], right) for right in (False, True)], axis=1).ravel()
            depth += 1
        return out


@dataclass
class Forest:
    """A fitted forest: bounds of bins, tops by tree, and the table of subtrees (tree, node, columns of nodes)."""

    bounds: Broadcast
    tops: Broadcast
    subtrees: DataFrame
    trees: int
    classes: int
    small: int


def bounds_of(rows: DataFrame, width: int) -> np.ndarray:
    """Upper bounds of all bins but the last (width x at most BINS - 1, padded with infinity), by quantiles of each feature."""
    long = rows.select(F.posexplode("v").alias("d", "x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    points = F.array(*[F.lit((i + 1) / BINS) for i in range(BINS - 1)])
    out = np.full((width, BINS - 1), np.inf)
    for r in long.groupBy("d").agg(F.percentile_approx("x", points, F.lit(ACCURACY)).alias("q"), F.max("x").alias("top")).collect():  # a row a feature
        q = np.unique(np.array(r["q"], dtype=float))
        q = q[q < r["top"]]
        out[r["d"], : len(q)] = q
    return out


def _binned(bounds: Broadcast, extra: Sequence[str]):
    """Rows (id, v, ...) to (id, ..., x): a byte a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = bounds.value
        for batch in batches:
            n = batch.num_rows
            if n:
                v = np.array(batch.column("v").fill_null([]).to_pylist(), dtype=float).reshape(n, -1)
                x = np.empty(v.shape, dtype=np.uint8)
                for d in range(v.shape[1]):
                    x[:, d] = np.searchsorted(cuts[d], v[:, d], side="left")
                x[np.isnan(v)] = 0
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[batch.column(c) for c in extra], pa.array([r.tobytes() for r in x], pa.binary())], names=["id", *extra, "x"])

    return run


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)


def _walked(top: dict[int, tuple[int, int, tuple]], x: np.ndarray, mine: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(node, depth, rows) of the nodes of a tree that its top does not split."""
    todo = [(ROOT, 0, mine)]
    for node, depth, rows in todo:
        if node in top and len(rows):
            f, b, _ = top[node]
            goes = x[rows, f] <= b
            todo += [(child(node, False), depth + 1, rows[goes]), (child(node, True), depth + 1, rows[~goes])]
        elif len(rows):
            yield node, depth, rows


def _level(tops: Broadcast, open_: Broadcast, grower: Grower, seed: int):
    """Counts of the open nodes' features over a task: (tree, node, feature, bin, class, n, w)."""

    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, y, x = np.asarray(batch.column("id")), np.asarray(batch.column("label"), dtype=np.int64), _matrix(batch.column("x").to_pylist())
            for tree, nodes in open_.value.items():
                weight = bootstrap(ids, tree, seed)
                for node, _, rows in _walked(tops.value[tree], x, np.flatnonzero(weight)):
                    if node in nodes:
                        some = drawn(tree, node, seed, grower.features)[nodes[node] * grower.look : (nodes[node] + 1) * grower.look]
                        padded = np.zeros((grower.look, BINS, grower.classes)), np.zeros((grower.look, BINS), dtype=np.int64)
                        for to, got in zip(padded, _counts(x[rows][:, some], y[rows], weight[rows].astype(float), grower.classes)):
                            to[: got.shape[0], : got.shape[1]] = got
                        if (tree, node) in held:
                            for to, got in zip(held[tree, node], padded):
                                to += got
                        else:
                            held[tree, node] = padded
        for (tree, node), (counts, rows) in held.items():
            f, b = np.nonzero(rows)
            n = len(f)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, tree)), pa.array(np.full(n, node)), pa.array(f), pa.array(b), pa.array(rows[f, b]), pa.array(list(counts[f, b]), pa.list_(pa.float64()))],
                names=["tree", "node", "f", "b", "n", "w"],
            )

    return run


def _decided(grower: Grower):
    """The best split of one open node from its summed counts: feature -1 if there is none, and the rows and classes on either side."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        f, b = (np.asarray(table.column(c)) for c in ("f", "b"))
        counts, rows = np.zeros((grower.look, BINS, grower.classes)), np.zeros((grower.look, BINS), dtype=np.int64)
        counts[f, b], rows[f, b] = np.array(table.column("w").to_pylist()), np.asarray(table.column("n"))
        found = best_split(counts, rows, grower.leaf)
        total = rows[f[0]].sum()
        out = (-1, 0, 0, 0, 0, 0) if found is None else (found[1], found[2], (n := int(rows[found[1], : found[2] + 1].sum())), int(total - n), int((counts[found[1], : found[2] + 1].sum(axis=0) > 0).sum()), int((counts[found[1], found[2] + 1 :].sum(axis=0) > 0).sum()))
        weights = counts[f[0]].sum(axis=0)  # of all rows, by any feature
        return pa.table({"tree": [key[0].as_py()], "node": [key[1].as_py()], **{k: [v] for k, v in zip(("f", "b", "nl", "nr", "cl", "cr"), out)}, "shares": [(weights / weights.sum()).tolist()]})

    return run


def fit(train: DataFrame, trees: int, seed: int = 42, depth: int | None = None, split: int = 2, leaf: int = 1, small: int | None = None) -> Forest:
    """A forest of train(id, label, v); ``depth`` None has no limit, nodes of fewer than ``split`` rows are not split, children have ``leaf`` rows at least."""
    spark = train.sparkSession
    rows = train.select(F.xxhash64("id").alias("id"), F.col("label").cast("int").alias("label"), F.col("v").cast("array<double>").alias("v"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), (F.max("label") + 1).alias("k")).first()
    if not facts["n"]:
        raise ValueError("a forest needs training rows")
    width, classes = facts["d"], facts["k"]
    small = max(SMALL, facts["n"] // TOP) if small is None else small
    bounds = spark.sparkContext.broadcast(bounds_of(rows, width))
    binned = scratch.written(rows.mapInArrow(_binned(bounds, ["label"]), "id long, label int, x binary"), "forest")
    grower = Grower(seed, width, classes, leaf, depth, split)
    tops: list[dict[int, tuple[int, int, tuple]]] = [{} for _ in range(trees)]
    # names of open nodes, and how many lots of features they have looked at
    open_ = {t: {ROOT: 0} for t in range(trees)} if facts["n"] > small and (depth is None or depth > 0) else {}
    level = {(t, ROOT): 0 for t in range(trees)}
    lots = -(-width // grower.look)
    while open_:
        shared = spark.sparkContext.broadcast(tops), spark.sparkContext.broadcast(open_)
        counted = binned.mapInArrow(_level(*shared, grower, seed), "tree long, node long, f long, b long, n long, w array<double>")
        sums = counted.groupBy("tree", "node", "f", "b").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("w")[c]) for c in range(classes)]).alias("w"))
        found = sums.groupBy("tree", "node").applyInArrow(_decided(grower), "tree long, node long, f long, b long, nl long, nr long, cl long, cr long, shares array<double>").collect()  # a row an open node
        ahead: dict[int, dict[int, int]] = {}
        for r in found:
            t, node = r["tree"], r["node"]
            lot, at = open_[t][node], level[t, node]
            if r["f"] < 0:
                if lot + 1 < lots:
                    ahead.setdefault(t, {})[node] = lot + 1
                continue
            order = drawn(t, node, seed, width)[lot * grower.look :]
            tops[t][node] = (int(order[r["f"]]), r["b"], tuple(r["shares"]))
            for side, n, kinds in ((False, r["nl"], r["cl"]), (True, r["nr"], r["cr"])):
                name = child(node, side)
                level[t, name] = at + 1
                if n > small and n >= split and kinds > 1 and (depth is None or at + 1 < depth):
                    ahead.setdefault(t, {})[name] = 0
        open_ = ahead
        for b in shared:
            b.destroy()
    top = spark.sparkContext.broadcast(tops)
    dealt = binned.mapInArrow(_dealt(top, seed, True), "tree long, node long, depth int, label int, w int, x binary")

    def grown(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, y = _matrix(table.column("x").to_pylist()), np.asarray(table.column("label"), dtype=np.int64)
        got = grower.tree(key[0].as_py(), key[1].as_py(), table.column("depth")[0].as_py(), x, y, np.asarray(table.column("w"), dtype=float))
        kinds = {"rows": pa.int64(), "shares": pa.float64()}
        return pa.table({"tree": [key[0].as_py()], "node": [key[1].as_py()], **{k: pa.array([v], pa.list_(kinds.get(k, pa.int32()))) for k, v in got.items()}})

    subtrees = scratch.written(dealt.groupBy("tree", "node").applyInArrow(grown, f"tree long, node long, {_NODE}"), "forest")
    return Forest(bounds, top, subtrees, trees, classes, small)


def _dealt(tops: Broadcast, seed: int, train: bool):
    """Rows of every tree by the subtree that they reach: training rows with their bootstrap weight, test rows with their id."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, blobs = batch.column("id"), batch.column("x")
            x = _matrix(blobs.to_pylist())
            for tree, top in enumerate(tops.value):
                weight = bootstrap(np.asarray(ids), tree, seed) if train else None
                for node, depth, rows in _walked(top, x, np.flatnonzero(weight) if train else np.arange(len(x))):
                    at, n = pa.array(rows), len(rows)
                    named = [pa.array(np.full(n, tree)), pa.array(np.full(n, node))]
                    own = [pa.array(np.full(n, depth, np.int32)), batch.column("label").take(at), pa.array(weight[rows].astype(np.int32))] if train else [ids.take(at)]
                    yield pa.RecordBatch.from_arrays([*named, *own, blobs.take(at)], names=["tree", "node", *(["depth", "label", "w"] if train else ["id"]), "x"])

    return run


def _shares(settings: list[tuple[int | None, int]], classes: int):
    """Class shares of test rows in one subtree, for every limit of depth and least size of a node to split."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, subtree: pa.Table) -> pa.Table:
        if not rows.num_rows or not subtree.num_rows:
            return pa.table({"id": rows.column("id").slice(0, 0), "tree": pa.array([], pa.int64()), "shares": pa.array([], pa.list_(pa.float64()))})
        feature, bins, left, depth, size = (np.asarray(subtree.column(c).combine_chunks().flatten()) for c in ("feature", "bin", "left", "depth", "rows"))
        shares = np.asarray(subtree.column("shares").combine_chunks().flatten()).reshape(-1, classes)
        x = _matrix(rows.column("x").to_pylist())
        out = np.empty((len(x), len(settings), classes))
        for s, (most, least) in enumerate(settings):
            if most is not None and most < depth[0]:  # cut within the top (``_cut``)
                out[:, s] = 0
                continue
            at, walking = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
            while len(walking):
                node = at[walking]
                on = (left[node] >= 0) & (size[node] >= least) & (depth[node] < (np.inf if most is None else most))
                walking, node = walking[on], node[on]
                at[walking] = left[node] + (x[walking, feature[node]] > bins[node])
            out[:, s] = shares[at]
        return pa.table({"id": rows.column("id"), "tree": pa.array(np.full(len(x), key[0].as_py())), "shares": pa.array(list(out.reshape(len(x), -1)), pa.list_(pa.float64()))})

    return run


def _cut(tops: Broadcast, limits: list[tuple[int | None, int]], classes: int):
    """Class shares of test rows whose limit of depth is met within a tree's top; zeros for the other limits."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x").to_pylist())
            for tree, top in enumerate(tops.value):
                out, met = np.zeros((len(x), len(limits), classes)), np.zeros(len(x), dtype=bool)
                todo = [(ROOT, 0, np.arange(len(x)))]
                for node, depth, rows in todo:
                    if node in top and len(rows):
                        f, b, shares = top[node]
                        for s, (most, _) in enumerate(limits):
                            if most == depth:
                                out[rows, s], met[rows] = shares, True
                        goes = x[rows, f] <= b
                        todo += [(child(node, False), depth + 1, rows[goes]), (child(node, True), depth + 1, rows[~goes])]
                at = np.flatnonzero(met)
                if not len(at):  # as in a top that ends above the limits
                    continue
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(np.full(len(at), tree)), pa.array(list(out[at].reshape(len(at), -1)), pa.list_(pa.float64()))], names=["id", "tree", "shares"])

    return run


def predict(forest: Forest, test: DataFrame, settings: Sequence[tuple[int, int | None, int]]) -> DataFrame:
    """(id, y_true, trees, depth, split, y_pred) of test(id, label, v) for every setting (trees, depth, split), read from the first trees of one forest.

    Limits wider than those of the fit have no effect.
    """
    kind = dict(test.dtypes)["id"]
    limits = list(dict.fromkeys((d, s) for _, d, s in settings))
    steps = sorted({t for t, _, _ in settings})
    if steps[-1] > forest.trees:
        raise ValueError(f"the forest has {forest.trees} trees, {steps[-1]} are asked for")
    if max(s for _, s in limits) > forest.small and any(forest.tops.value):
        raise ValueError(f"nodes of more than {forest.small} rows have been split: fit with a larger small")
    rows = test.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(_binned(forest.bounds, []), f"id {kind}, x binary")
    dealt = rows.mapInArrow(_dealt(forest.tops, 0, False), f"tree long, node long, id {kind}, x binary")
    wanted = forest.subtrees.filter(F.col("tree") < steps[-1])
    met = dealt.filter(F.col("tree") < steps[-1]).groupBy("tree", "node").cogroup(wanted.groupBy("tree", "node"))
    schema = f"id {kind}, tree long, shares array<double>"
    shares = met.applyInArrow(_shares(limits, forest.classes), schema)
    if any(forest.tops.value) and any(d is not None for d, _ in limits):
        shares = shares.unionByName(rows.mapInArrow(_cut(forest.tops, limits, forest.classes), schema).filter(F.col("tree") < steps[-1]))
    # trees from one asked number to the next are added up apart
    step = F.lit(0)
    for a in steps[:-1]:
        step = step + (F.col("tree") >= a).cast("int")
    numbers = len(limits) * forest.classes
    sums = shares.groupBy("id", step.alias("step")).agg(F.array(*[F.sum(F.col("shares")[i]) for i in range(numbers)]).alias("shares"))
    whole = sums.groupBy("id").agg(F.collect_list(F.struct("step", "shares")).alias("sums"))  # a row a step

    def argmax(frames):
        for f in frames:
            out = []
            for id_, mine in zip(f["id"], f["sums"]):
                total = np.zeros((len(steps), len(limits), forest_classes))
                for r in mine:
                    total[r["step"]] = np.array(r["shares"], dtype=float).reshape(len(limits), -1)
                label = np.cumsum(total, axis=0).round(9).argmax(axis=2)
                out += [(id_, t, d, s, int(label[steps.index(t), limits.index((d, s))])) for t, d, s in settings]
            yield pd.DataFrame(out, columns=["id", "trees", "depth", "split", "y_pred"]).astype({"depth": "Int32"})

    forest_classes = forest.classes
    said = whole.mapInPandas(argmax, f"id {kind}, trees int, depth int, split int, y_pred int")
    return said.join(test.select("id", F.col("label").cast("int").alias("y_true")), "id").select("id", "y_true", "trees", "depth", "split", "y_pred")
