"""The histogram forest against direct trees, and the settings read from one fit."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import classify, evaluate, forest


def framed(spark, x, y):
    return spark.createDataFrame([(i, int(c), [float(a) for a in r]) for i, (r, c) in enumerate(zip(x, y))], "id long, label int, v array<double>").repartition(3)


def noisy(seed, n, width=6, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).round(1)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] + rng.normal(0, 0.5, n) > 0.4)) % classes
    return x, y


def test_bootstrap_weights():
    w = np.concatenate([forest.bootstrap(np.arange(20_000), t, 42) for t in (0, 1)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[:20_000], w[20_000:])[0, 1]) < 0.03


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for leaf in (1, 4):
        for _ in range(60):
            n = int(rng.integers(2, 30))
            x, y, w = rng.integers(0, 6, (n, 3)).astype(np.uint8), rng.integers(0, 3, n), rng.integers(1, 4, n).astype(float)
            best = None
            for f, b in itertools.product(range(3), range(5)):
                left = x[:, f] <= b
                if min(left.sum(), (~left).sum()) >= leaf:
                    gini = sum(w[s].sum() - (np.bincount(y[s], w[s]) ** 2).sum() / w[s].sum() for s in (left, ~left))
                    best = gini if best is None else min(best, gini)
            got = forest.best_split(*forest._counts(x, y, w, 3), leaf)
            assert (got is None) == (best is None) and (best is None or got[0] == pytest.approx(best))


def nodes(fitted):
    """Names, depth, rows and shares of every node of every tree, tops left out."""
    out = []
    for r in fitted.subtrees.collect():
        names = [r.node]
        for i, left in enumerate(r.left):
            if left >= 0:
                while len(names) < left + 2:
                    names.append(None)
                names[left], names[left + 1] = forest.child(names[i], False), forest.child(names[i], True)
        out += [(r.tree, n, *x) for n, x in zip(names, zip(r.feature, r.bin, r.depth, r.rows))]
    return out


def test_levels_on_spark_grow_the_same_trees(spark):
    """Splitting large nodes by summed counts and small ones in a task gives what one task gives alone."""
    x, y = noisy(2, 400)
    df = framed(spark, x, y)
    alone, levels = forest.fit(df, 4, seed=7), forest.fit(df, 4, seed=7, small=40)
    assert any(levels.tops.value) and not any(alone.tops.value)
    want = {(t, n): (f, b, d) for t, n, f, b, d, _ in nodes(alone) if f >= 0}
    got = {(t, n): (f, b, d) for t, n, f, b, d, _ in nodes(levels) if f >= 0}
    assert all(want[k] == v for k, v in got.items())
    assert {(t, n): v[:2] for t, top in enumerate(levels.tops.value) for n, v in top.items()} == {k: v[:2] for k, v in want.items() if k not in got}
    settings = list(itertools.product((1, 4), (0, 1, 2, 5, None), (2, 9)))
    a, b = (sorted(map(tuple, forest.predict(m, df, settings).collect()), key=repr) for m in (alone, levels))
    assert a == b and len(a) == 400 * 20


def test_limits_of_a_fit_are_cuts_of_the_whole_forest(spark):
    """36 settings are told apart, and each equals a forest that was fitted with it."""
    x, y = noisy(3, 300)
    df, test = framed(spark, x, y), framed(spark, *noisy(4, 80))
    whole = forest.fit(df, 6, seed=1)
    settings = [(6, 2, 2), (4, None, 30), (2, 4, 10)]
    said = forest.predict(whole, test, settings)
    for t, d, s in settings:
        mine = said.filter((F.col("trees") == t) & F.col("depth").eqNullSafe(F.lit(d)) & (F.col("split") == s)).select("id", "y_true", "y_pred")
        own = forest.predict(forest.fit(df, t, 1, d, s), test, [(t, d, s)]).select("id", "y_true", "y_pred")
        assert sorted(mine.collect()) == sorted(own.collect())
        deepest = max(d or 0 for *_, d, _ in nodes(forest.fit(df, t, 1, d, s)))
        assert d is None or deepest <= d


def test_least_size_and_depth(spark):
    x, y = noisy(5, 300)
    got = nodes(forest.fit(framed(spark, x, y), 5, split=11, leaf=3))
    assert min(n for _, _, f, _, _, n in got if f >= 0) >= 11 and min(n for *_, n in got) >= 3
    n = 120
    deep = forest.Grower(1, 1, 2, 1, None, 2).tree(0, 1, 0, np.arange(n, dtype=np.uint8)[:, None], np.arange(n) % 2, np.ones(n))
    assert max(deep["depth"]) > 30 and min(deep["rows"]) == 1


def test_grid_has_all_settings(spark):
    x, y = noisy(6, 120)
    df = framed(spark, x, y)
    scored = classify.grid_search(df.filter("id < 90"), df.filter("id >= 90"), {"trees": (2, 3, 5), "depth": (1, 2, 30, None), "split": (2, 5, 10)}).collect()
    assert {(r.trees, r.depth, r.split) for r in scored} == set(itertools.product((2, 3, 5), (1, 2, 30, None), (2, 5, 10))) and len(scored) == 36
    assert all(0 <= r.f1 <= 1 for r in scored) and len({r.f1 for r in scored}) > 3


def test_odd_rows(spark):
    x, y = noisy(8, 60)
    df = framed(spark, np.hstack([x, np.ones((60, 1)), np.full((60, 1), np.nan)]), y)  # a constant feature and one without values
    fitted = forest.fit(df, 3)
    assert not {f for _, _, f, *_ in nodes(fitted)} & {6, 7}
    assert forest.predict(fitted, df.filter("false"), [(3, None, 2)]).count() == 0
    one = forest.fit(df.filter("label = 1"), 2)
    assert {r.y_pred for r in forest.predict(one, df, [(2, None, 2)]).collect()} == {1}
    with pytest.raises(ValueError):
        forest.fit(df.filter("false"), 2)
    with pytest.raises(ValueError):
        forest.predict(fitted, df, [(4, None, 2)])


def test_limit_of_depth_that_no_top_reaches(spark):
    """Tops of a level or two under a limit of 20: no row's share comes from a top."""
    x, y = noisy(9, 200)
    df = framed(spark, x, y)
    fitted = forest.fit(df, 2, seed=3, depth=20, small=80)
    assert any(fitted.tops.value)
    want = forest.predict(forest.fit(df, 2, seed=3, depth=20), df, [(2, 20, 2)])
    got = forest.predict(fitted, df, [(2, 20, 2)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 200


def test_nodes_whose_drawn_features_have_one_bin():
    """A node looks on where all features of its first look lie in the lowest bin; without any other it is a leaf."""
    grower = forest.Grower(1, 4, 2, 1, None, 2)
    first = forest.drawn(0, forest.ROOT, 1, 4)[:2]
    x, y = np.zeros((6, 4), dtype=np.uint8), np.arange(6) % 2
    assert grower.choose(0, forest.ROOT, x, y, np.ones(6)) is None
    assert grower.tree(0, forest.ROOT, 0, x, y, np.ones(6))["left"] == [-1]
    other = next(f for f in range(4) if f not in first)
    x[:, other] = y
    assert grower.choose(0, forest.ROOT, x, y, np.ones(6)) == (other, 0)


def test_nodes_split_together_as_one_by_one(monkeypatch):
    """Sorted rows of many nodes give the splits that a node's histogram gives, in a fraction of the time."""
    rng = np.random.default_rng(12)
    for n, leaf, split, depth, width, bins in ((700, 1, 2, None, 9, 128), (700, 3, 11, 5, 9, 5), (200, 1, 2, None, 4, 2)):
        x, y, w = rng.integers(0, bins, (n, width)).astype(np.uint8), rng.integers(0, 4, n), rng.integers(1, 4, n).astype(float)
        x[:, 0] = 0
        grower = forest.Grower(3, width, 4, leaf, depth, split)
        got = grower.tree(1, 5, 0, x, y, w)
        rows, names = {0: np.arange(n)}, {0: 5}
        for i, (f, b, left, level) in enumerate(zip(got["feature"], got["bin"], got["left"], got["depth"])):
            mine = rows[i]
            stop = len(mine) < max(split, 2) or len(set(y[mine])) < 2 or level == depth
            assert (None if stop else grower.choose(1, names[i], x[mine], y[mine], w[mine])) == ((f, b) if f >= 0 else None)
            if f >= 0:
                goes = x[mine, f] <= b
                rows[left], rows[left + 1] = mine[goes], mine[~goes]
                names[left], names[left + 1] = forest.child(names[i], False), forest.child(names[i], True)
        assert len(rows) == len(got["left"])
    n, took = 3000, []
    x, y = rng.integers(0, 128, (n, 64)).astype(np.uint8), rng.integers(0, 10, n)
    for few in (0, 128):  # one by one, together
        monkeypatch.setattr(forest, "FEW", few)
        began = time.perf_counter()
        took.append((forest.Grower(3, 64, 10, 1, None, 2).tree(1, 5, 0, x, y, np.ones(n)), time.perf_counter() - began))
    assert took[0][0] == took[1][0] and took[1][1] < took[0][1] / 2
