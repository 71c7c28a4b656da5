"""Out-of-distribution scores from one isolation forest per class.

A forest is built from at most ``POOL`` rows of its class, chosen by a hash of
the id, in blocks of trees that are separate groups, so neither rows nor work of
a class meet in one task; the forests (classes x trees x 511 nodes at most) are
bounded by these parameters and broadcast for scoring.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SUBSAMPLE, POOL, BLOCK = 200, 256, 4096, 25


def _average_path(n: np.ndarray | int):
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Nodes (feature, threshold, left, right, path) in one array; feature -1 is a leaf whose path length is in the last column."""
    nodes, limit = [], int(np.ceil(np.log2(max(len(x), 2))))

    def build(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + float(_average_path(len(rows)))])
        if depth < limit and len(rows) > 1:
            low, high = rows.min(0), rows.max(0)
            usable = np.flatnonzero(high > low)
            if len(usable):
                f = int(rng.choice(usable))
                cut = rng.uniform(low[f], high[f])
                left = rows[:, f] <= cut
                nodes[me][:2] = [f, cut]
                nodes[me][2], nodes[me][3] = build(rows[left], depth + 1), build(rows[~left], depth + 1)
        return me

    build(x, 0)
    return np.array(nodes)


def path_lengths(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    while True:
        f = tree[at, 0].astype(int)
        go = f >= 0
        if not go.any():
            return tree[at, 4]
        left = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
        at = np.where(go, np.where(left, tree[at, 2], tree[at, 3]).astype(int), at)


def forests(train: DataFrame, seed: int = 42, trees: int = TREES) -> DataFrame:
    """(label, tree, nodes, rows) from train (id, label, v)."""
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    pool = train.join(sizes, "label").filter(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 20)) < F.lit(POOL) / F.col("_n") * (1 << 20))
    blocks = pool.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-trees // BLOCK) - 1))))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        label, block = key
        rows = rows.sort_values("id")
        x = np.array(rows["v"].tolist(), dtype=float)
        rng = np.random.default_rng([seed, zlib.crc32(str(label).encode()), int(block)])
        out = []
        for t in range(block * BLOCK, min((block + 1) * BLOCK, trees)):
            some = x[rng.permutation(len(x))[:SUBSAMPLE]]
            out.append((label, t, grow(some, rng).ravel().tolist(), len(some)))
        return pd.DataFrame(out, columns=["label", "tree", "nodes", "rows"])

    kind = dict(train.dtypes)["label"]
    return blocks.select("id", "label", "v", "block").groupBy("label", "block").applyInPandas(build, f"label {kind}, tree int, nodes array<double>, rows int")


def scores(forest: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, label, score) of every row under every class's forest: 0.5 - 2^(-path / expected); low is unusual."""
    trees: dict[int, list] = {}
    for r in forest.collect():  # bounded by classes x trees
        trees.setdefault(r.label, []).append((np.array(r.nodes).reshape(-1, 5), r.rows))
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for part in batches:
            if not len(part):
                continue
            x = np.array(part["v"].tolist(), dtype=float)
            for label, mine in sorted(shared.value.items()):
                depth = np.mean([path_lengths(t, x) for t, _ in mine], axis=0)
                expected = float(_average_path(max(n for _, n in mine)))
                yield pd.DataFrame({"id": part["id"], "label": label, "score": 0.5 - 2.0 ** (-depth / max(expected, 1e-9))})

    kinds = {**dict(rows.dtypes), "label": dict(forest.dtypes)["label"]}
    return rows.select("id", "v").mapInPandas(run, f"id {kinds['id']}, label {kinds['label']}, score double")


def by_class(long: DataFrame, labels: list) -> DataFrame:
    """One column ``class_<label>`` for each class model."""
    return long.groupBy("id").agg(*[F.max(F.when(F.col("label") == c, F.col("score"))).alias(f"class_{c}") for c in labels])
