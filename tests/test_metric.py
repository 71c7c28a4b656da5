"""Searches and maps that prune or approximate, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import knn, tsne


def framed(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), int(i) % 3, [float(a) for a in r]) for i, r in zip(ids, x)], "id long, label int, v array<double>").repartition(3)


def blobs(seed, clusters, each, width=8, spread=0.3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(rng.normal(0, 6, width), spread, (each, width)) for _ in range(clusters)])


def sides(df):
    return df.select(F.col("id").alias("test_id"), "v"), df.select(F.col("id").alias("train_id"), "label", "v")


def brute(x, y, k):
    out = []
    for i, a in enumerate(x):
        d = ((y - a) ** 2).sum(axis=1).round(9)
        out += [(i, j, place + 1) for place, j in enumerate(np.lexsort((np.arange(len(y)), d))[:k].tolist())]
    return out


@pytest.mark.parametrize("k", [1, 5, 40])
def test_index_finds_the_same_neighbours(spark, k):
    y = np.concatenate([blobs(1, 12, 30), np.tile(blobs(2, 1, 1), (50, 1)), np.zeros((3, 8))])  # a hot vector
    x = np.concatenate([blobs(1, 12, 4), np.random.default_rng(3).normal(0, 9, (20, 8)), y[-4:]])
    test, train = sides(framed(spark, x))[0], sides(framed(spark, y))[1]
    want = brute(x, y, k)
    for numbers in (10**6, 200):
        got = sorted((r.test_id, r.place, r.train_id) for r in knn.neighbours(test, train, k, numbers).collect())
        assert got == sorted((i, p, j) for i, j, p in want)


def test_index_drops_pairs_of_clustered_rows(spark):
    test, train = sides(framed(spark, blobs(5, 30, 20)))
    met, every = knn.pairs_met(test, train, 5, 800)  # 24 pivots for 30 blobs
    assert every == 600 * 600 and met < every / 3


def test_rows_travel_once_a_block_not_once_a_cell(spark):
    """Vectors without clusters meet nearly all cells; what is shuffled is bounded by the blocks."""
    test, train = sides(framed(spark, np.random.default_rng(4).normal(0, 1, (400, 8))))
    cells = knn.Cells(train, 8, 400, 64)
    met = cells._met(test.withColumn("most", F.lit(None).cast("double")), False, 5)
    assert 400 <= met.count() <= 8 * 400
    meetings = knn.pairs_met(test, train, 5, 64)
    assert meetings[0] > 0.8 * meetings[1]


def test_index_of_few_rows(spark):
    test, train = sides(framed(spark, blobs(1, 2, 3)))
    assert knn.neighbours(test, train, 9, 1).count() == 36  # fewer rows than neighbours
    assert knn.neighbours(test.filter("false"), train, 2, 1).count() == 0
    assert knn.neighbours(test, train.filter("false"), 2).count() == 0


def test_perplexity_of_affinities():
    d2 = np.random.default_rng(0).gamma(2, 5, (40, 30))
    p = tsne._bisected(d2, 8.0)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(np.exp(-(p * np.log(p + 1e-300)).sum(axis=1)), 8, rtol=1e-4)
    assert np.allclose(tsne._bisected(np.ones((2, 5)), 3.0), 0.2)


@pytest.mark.parametrize("scale", [1e-4, 3.0, 12.0])
def test_repulsion_on_the_grid_matches_direct_sums(scale):
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, scale, (2, 500))
    width = min(tsne.WIDEST, max(np.ptp(x), np.ptp(y)) / tsne.FINE)
    field = tsne.Field(tsne.charges(x, y, width), width, 500)
    dx, dy = x[:, None] - x, y[:, None] - y
    k = 1 / (1 + dx * dx + dy * dy)
    z = k.sum() - 500
    want = np.stack([(k * k * dx).sum(axis=1), (k * k * dy).sum(axis=1)]) / z
    got = np.stack(field.repulsion(x, y))
    assert abs(field.z / z - 1) < 0.02 and np.abs(got - want).max() < 0.02 * np.abs(want).max()


def test_attraction_is_a_sum_over_pairs(spark):
    rng = np.random.default_rng(2)
    at = rng.normal(0, 1, (12, 2))
    state = spark.createDataFrame([(i, float(a), float(b), 0.0) for i, (a, b) in enumerate(at)], "id long, x double, y double, ux double")
    pairs = [(i, j, float(rng.random())) for i in range(12) for j in range(12) if i != j and (i + j) % 3]
    got = {r.id: (r.fx, r.fy, r.x, r.ux) for r in tsne.attraction(state, spark.createDataFrame(pairs, "i long, j long, p double")).collect()}
    for i in range(12):
        want = sum(p * (at[a] - at[b]) / (1 + ((at[a] - at[b]) ** 2).sum()) for a, b, p in pairs if a == i)
        assert np.allclose(got[i][:2], want) and got[i][2:] == (at[i][0], 0.0)


def test_map_keeps_neighbourhoods_better_than_principal_components(spark):
    from skyloom.operators import cluster

    rng = np.random.default_rng(7)
    df = framed(spark, np.repeat(rng.normal(0, 1, (30, 64)), 10, axis=0) + rng.normal(0, 1, (300, 64)))
    mapped = tsne.embedded(df, perplexity=8, iterations=40, early=20)
    pca = cluster.projected(df).select("id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
    share = lambda m: tsne.preserved(df, m, 8).agg(F.avg("share")).first()[0]
    assert share(mapped) > share(pca) + 0.05
    assert tsne.embedded(df.limit(1)).first()[1:] == (0.0, 0.0) and tsne.embedded(df.filter("false")).count() == 0


def test_a_step_carries_the_charges_of_its_new_places():
    """The job that moves the rows spreads their charges too, so no other one reads the rows for them."""
    import types

    import pandas as pd

    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 2, (2, 400))
    field = tsne.Field(tsne.charges(x, y, 0.2), 0.2, 400)
    f = pd.DataFrame({"id": np.arange(400), "x": x, "y": y, "fx": 0.0, "fy": 0.0, "ux": 0.0, "uy": 0.0, "gx": 1.0, "gy": 1.0})
    moved = pd.concat(tsne._moved(types.SimpleNamespace(value=field), 50.0, 0.5, 1.0, 0.25)([f[:150], f[150:]]))
    assert len(moved) == 400 and moved["na"].notna().sum() == 1
    got = pd.DataFrame({c: moved[f"n{c}"].dropna().iloc[0] for c in tsne.NODE})
    pd.testing.assert_frame_equal(got, tsne.charges(moved["x"].to_numpy(), moved["y"].to_numpy(), 0.25), check_dtype=False)
    assert all(2 * n <= tsne._size(n) <= 2.5 * n for n in range(16, tsne.CELLS * tsne.NODES + 1))  # not the next power of two


def test_blocks_of_packed_rows_move_as_single_rows_do(spark, monkeypatch):
    """A step over cells of two blocks gives what a join of single pairs gives; a map is the same by both."""
    rng = np.random.default_rng(3)
    n, block = 70, 16
    x, y = rng.normal(0, 1, (2, n))
    pairs = spark.createDataFrame([(int(i), int(j), float(rng.random())) for i, j in {tuple(map(int, r)) for r in rng.integers(0, n, (600, 2))}], "i long, j long, p double")
    start = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i long, x double, y double")
    state = tsne.packed_state(start, block)
    cells = tsne.packed_pairs(pairs, block)
    assert cells.count() == 25 and [(r.i, r.x, r.y) for r in tsne.unpacked(state, block).orderBy("i").collect()] == list(zip(range(n), x, y))
    want = {r.id: (r.fx, r.fy) for r in tsne.attraction(start.withColumnRenamed("i", "id"), pairs).collect()}
    got = np.zeros((2, n))
    for r in tsne.pulled(state, cells).collect():
        for c, f in enumerate((r.fx, r.fy)):
            part = np.frombuffer(bytes(f))
            got[c, r.b * block : r.b * block + len(part)] += part
    assert all(np.allclose(got[:, i], want.get(i, (0, 0))) for i in range(n))
    monkeypatch.setattr(tsne, "BLOCK", 16)
    df = spark.createDataFrame([(7 * i + 3, rng.normal(5 * (i % 3), 1, 4).tolist()) for i in range(n)], "id long, v array<double>").repartition(3)
    packed = {r.id: (r.x, r.y) for r in tsne.embedded(df, perplexity=6, iterations=4).collect()}
    monkeypatch.setattr(tsne, "SHARED", 0)
    single = {r.id: (r.x, r.y) for r in tsne.embedded(df, perplexity=6, iterations=4).collect()}
    assert sorted(packed) == [7 * i + 3 for i in range(n)] and all(np.allclose(packed[i], single[i], rtol=1e-6) for i in packed)
