"""Vectors, splits, neighbours, evaluation, clustering and models."""

import inspect
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import vectors
from skyloom.operators import classify, cluster, embed, evaluate, joins, knn, ood, splits
from skyloom.plans import model_queries


def test_time_average_ranks(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([],), (None,)], "e array<array<float>>")
    got = [r[0] for r in df.select(vectors.time_average(F.col("e"))).collect()]
    assert got[0] == [2, 3] and got[1] is None and got[2] is None
    flat = spark.createDataFrame([([1.0, 2.0],)], "e array<float>").select(vectors.time_average(vectors.as_steps(F.col("e"), 1))).first()[0]
    assert flat == [1, 2]


def test_combine_bands(spark):
    df = spark.createDataFrame([([1.0], [3.0]), (None, [3.0])], "g array<double>, r array<double>")
    bands = {"r": F.col("r"), "g": F.col("g")}
    got = df.select(*[vectors.combine_bands(bands, m).alias(m) for m in ("concat", "avg", "g")], vectors.combine_bands(bands, "concat", 1).alias("zeros")).collect()
    assert (got[0].concat, got[0].avg, got[0].g) == ([1, 3], [2], [1])
    assert (got[1].concat, got[1].avg, got[1].g, got[1].zeros) == (None, [3], [3], [0, 3])


def test_finite_filter(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([float("nan")],), ([float("inf")],), (None,), ([None],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.all_finite(F.col("v"))).collect()] == [True, False, False, False, False]


def test_stratified_split_is_exact(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("a" * 10 + "b" * 20 + "c" * 30)], "id long, label string")
    got = splits.stratified(df, "id", "label")
    counts = {(r.label, r.split): r["count"] for r in got.groupBy("label", "split").count().collect()}
    for label, n in (("a", 10), ("b", 20), ("c", 30)):
        assert counts[(label, "test")] == n // 5 and counts[(label, "validation")] == n // 10 and counts[(label, "train")] == n * 7 // 10
    assert {(r.id, r.split) for r in got.collect()} == {(r.id, r.split) for r in splits.stratified(df.repartition(5), "id", "label").collect()}


def test_random_split_and_selection(spark):
    got = splits.random(spark.range(1000).withColumnRenamed("id", "x"), "x")
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"test": 200, "validation": 100, "train": 700}
    assert splits.select_splits(got, ["test"]).count() == 200 and splits.select_splits(got, "all").count() == 1000
    with pytest.raises(ValueError):
        splits.select_splits(got, ["nope"])
    assert splits.with_split(spark.range(1)).first().split == "train"


def test_scaler_is_population_and_keeps_constants(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([4.0, 5.0],)], "v array<double>")
    s = knn.fit_scaler(df).first()
    assert s.scale == pytest.approx([np.std([1, 2, 4]), 1.0]) and s.mean[1] == 5
    assert [r.v[1] for r in knn.apply_scaler(df, knn.fit_scaler(df)).collect()] == [0, 0, 0]


def test_neighbours_in_blocks_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 4)).round(1), rng.normal(size=(20, 4)).round(1)
    train = spark.createDataFrame([(i, int(i % 3), v.tolist()) for i, v in enumerate(x)], "train_id long, label int, v array<double>")
    test = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "test_id long, v array<double>")
    want = {i: [j for _, j in sorted((round(((x[j] - y[i]) ** 2).sum(), 9), j) for j in range(60))[:5]] for i in range(20)}
    for limit in (10**6, 60):
        monkeypatch.setattr(knn, "BLOCK_NUMBERS", limit)
        got = {}
        for r in knn.neighbours(test, train).orderBy("place").collect():
            got.setdefault(r.test_id, []).append(r.train_id)
        assert got == want
    votes = {r.test_id: r.y_pred for r in knn.vote(knn.neighbours(test, train)).collect()}
    for i, near in want.items():
        labels = [j % 3 for j in near]
        assert votes[i] == min(set(labels), key=lambda c: (-labels.count(c), c))


def pred_of(spark, pairs):
    return spark.createDataFrame(pairs, "y_true int, y_pred int")


def test_report_and_confusion(spark):
    pred = pred_of(spark, [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (0, 3)])
    rows = {r.row: r for r in evaluate.report(pred).collect()}
    assert rows["0"].precision == 0.5 and rows["0"].recall == pytest.approx(1 / 3) and rows["2"].f1 == 0 and rows["3"].support == 0
    assert rows["accuracy"].f1 == 0.5 and rows["accuracy"].support == 6
    cells = {(r.y_true, r.y_pred): r for r in evaluate.confusion(pred).collect()}
    assert len(cells) == 16 and sum(r.n for r in cells.values()) == 6
    assert cells[(3, 3)].share is None and cells[(0, 3)].share == pytest.approx(1 / 3)


def test_ari_and_nmi(spark):
    same = pred_of(spark, [(i % 3, (i + 1) % 3 + 10) for i in range(30)])
    assert evaluate.cluster_scores(same).first().asDict() == {"ari": pytest.approx(1), "nmi": pytest.approx(1)}
    a, b = [0, 0, 1, 1, 2, 2], [0, 0, 1, 2, 2, 2]
    r = evaluate.cluster_scores(pred_of(spark, list(zip(a, b)))).first()
    pairs = list(itertools.combinations(range(6), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    sa, sb = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    e = sa * sb / len(pairs)
    assert r.ari == pytest.approx((both - e) / ((sa + sb) / 2 - e))


def test_assignment_against_permutations():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (6, 6)):
        for _ in range(10):
            g = rng.integers(0, 20, (n, m))
            got = cluster.assignment(g)
            best = max(sum(g[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(g[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
            assert sum(g[i, j] for i, j in got) == best and len(got) == min(n, m)


def test_summary_conventions(spark):
    df = spark.createDataFrame([("a", 42, 1.0), ("a", 100, 3.0), ("b", 42, 5.0), ("c", 42, float("nan")), ("c", 100, 2.0)], "g string, seed int, value double")
    one = {r.g: r for r in evaluate.summary(df, ["g"]).collect()}
    pop = {r.g: r for r in evaluate.summary(df, ["g"], ddof=0).collect()}
    assert one["a"].std == pytest.approx(math.sqrt(2)) and pop["a"].std == 1 and one["b"].std == 0 and one["a"].seeds == "42,100" and one["c"].n == 1 and one["c"].mean == 2


def test_rank_ties_are_deterministic(spark):
    df = spark.createDataFrame([("k", "m2", 0.5), ("k", "m1", 0.5), ("k", "m3", 0.9)], "c string, m string, f1 double")
    assert {r.m: r["rank"] for r in evaluate.rank_within(df, "c", "f1", "m").collect()} == {"m3": 1, "m1": 2, "m2": 3}


def test_ward_against_definition():
    points = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    merges = cluster.ward_merges(points, np.ones(5))
    labels = cluster.cut_tree(merges, 5, 3)
    assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3 and min(labels) == 1
    assert merges[0, 2] == pytest.approx(0.1) and len(cluster.last_merges(merges, 2)) == 2


def blobs(spark, n=30):
    rng = np.random.default_rng(0)
    rows = [(i, i % 3, (rng.normal(size=3) + 6 * np.eye(3)[i % 3]).tolist()) for i in range(3 * n)]
    return spark.createDataFrame(rows, "id long, label int, v array<double>")


def test_clusterings_find_blobs(spark):
    df = blobs(spark)
    for got in (cluster.kmeans(df, 3), cluster.ward(df, 3, points=20)):
        r = cluster.clustering_metrics(got.select(F.col("label").alias("y_true"), "y_pred")).first()
        assert r.ari > 0.9 and r.f1 > 0.9


def test_ward_in_rounds_is_exact(spark):
    """Points without structure and some copies give the clusters of one merge after another, however few the driver links."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(260, 3))
    x = np.vstack([x, x[:40], np.repeat(x[:1], 20, axis=0), [[50.0, 0, 0], [58.0, 0, 0]]])
    truth = cluster.cut_tree(cluster.ward_merges(x, np.ones(len(x))), len(x), 9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = [r.y_pred for r in cluster.ward(df, 9, points=20).orderBy("id").collect()]
    assert len(got) == len(x) and len(set(zip(got, truth.tolist()))) == len(set(got)) == 9


def test_classifiers_and_search(spark):
    df = splits.stratified(blobs(spark), "id", "label")
    train, val, test = (df.filter(F.col("split") == s) for s in ("train", "validation", "test"))
    for pred in (classify.logistic(train, test), classify.forest(train, test, 10, 5), classify.perceptron(train, val, test, (16, 8), dropout=0.2, rate=0.02, batch=16, epochs=15)):
        assert {r.row: r for r in evaluate.report(pred).collect()}["accuracy"].f1 > 0.9
    best = classify.best_parameters(classify.grid_search(train, val, {"trees": (5, 3), "depth": (3, None), "split": (2, 9)})).first()
    assert best.trees in (3, 5) and best.split in (2, 9) and best.f1 > 0.8
    assert classify.seeds(42) == [42, 100, 200]


def test_given_parameters():
    assert classify.given_parameters(None) == classify.DEFAULT_FOREST
    assert classify.given_parameters('{"n_estimators": 500, "max_depth": None}') == {"trees": 500, "depth": None, "split": 2}
    with pytest.raises(ValueError, match="unknown parameters"):
        classify.given_parameters('{"criterion": "gini"}')
    with pytest.raises(ValueError):
        classify.given_parameters("{n_estimators: 5")


def test_perceptron_gradients_and_weights(spark):
    """Backpropagation of the weighted loss agrees with finite differences; averages of equal states change nothing; rare classes count."""
    import pickle

    rng = np.random.default_rng(0)
    net, weight = classify.Layers([5, 7, 4, 3], 1), np.array([0.5, 1.0, 2.5])
    x, y = rng.normal(size=(12, 5)), rng.integers(0, 3, 12)
    grads = net.gradients(x, y, weight, 0.0, rng)
    mean = lambda: np.divide(*net.loss(x, y, weight))
    for p, g in zip(net.all(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        values = []
        for d in (1e-5, -1e-5):
            p[at] += d
            values.append(mean())
            p[at] -= d
        assert (values[0] - values[1]) / 2e-5 == pytest.approx(g[at], rel=1e-4)
    state = (net, [(np.ones_like(p), np.ones_like(p)) for p in net.all()], 4)
    same = classify._average([(3, pickle.dumps(state)), (9, pickle.dumps(state))])
    assert all(np.allclose(a, b) for a, b in zip(same[0].all(), net.all())) and same[2] == 4
    rows = [(i, int(i % 20 == 0), [float(rng.normal() + 1.2 * (i % 20 == 0))]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    recall = {}
    for weighted in (True, False):
        pred = classify.perceptron(df, df, df, (8,), rate=0.02, batch=64, epochs=12, weighted=weighted).collect()
        recall[weighted] = np.mean([r.y_pred for r in pred if r.y_true == 1])
    assert recall[True] > recall[False] + 0.2


def test_scaler_of_parts_is_that_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 3, size=(90, 3))
    x[:, 2] = 4.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    parts = [knn.scaler_state(df.filter(f"id % 3 = {i}")) for i in range(3)]
    got, want = knn.scaler_of(knn.merged(knn.merged(*parts[:2]), parts[2])).first(), knn.fit_scaler(df).first()
    assert got.mean == pytest.approx(x.mean(0)) and got.scale == pytest.approx([*x.std(0)[:2], 1.0]) and want.mean == pytest.approx(got.mean) and want.scale == pytest.approx(got.scale)


def test_stratified_split_counts_classes_without_one_task_each(spark):
    """Exact quotas in a class of two thirds of the rows, in a class of one row, and among rows without a class."""
    rows = [(i, "big" if i % 3 else ("small" if i else "one") if i % 6 else None) for i in range(1, 3000)] + [(0, "one")]
    df = spark.createDataFrame(rows, "id long, label string")
    got = splits.stratified(df, "id", "label")
    assert got.columns == ["id", "label", "split"] and got.count() == len(rows)
    for label, n in ((r.label, r.n) for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()):
        counts = {r.split: r.n for r in got.filter(F.col("label").eqNullSafe(label)).groupBy("split").agg(F.count("*").alias("n")).collect()}
        test = math.ceil(n * 0.2)
        assert counts.get("test", 0) == test and counts.get("validation", 0) == math.ceil((n - test) * 0.125) and sum(counts.values()) == n
    assert "partitionBy(label)" not in got._jdf.queryExecution().toString()


def test_cut_height_gives_the_clusters(spark):
    rng = np.random.default_rng(3)
    merges = cluster.ward_merges(rng.normal(size=(30, 2)), np.ones(30))
    for k in (1, 2, 7, 30):
        assert 30 - (merges[:, 2] < cluster.cut_height(merges, k)).sum() == k


def test_isolation_forests_of_named_classes(spark):
    rng = np.random.default_rng(1)
    train = spark.createDataFrame([(f"s{i}", "RRab" if i % 2 else "EW", (rng.normal(size=2) + 20 * (i % 2)).tolist()) for i in range(200)], "id string, label string, v array<double>")
    test = spark.createDataFrame([("near EW", [0.0, 0.0]), ("near RRab", [20.0, 20.0])], "id string, v array<double>")
    got = {(r.id, r.label): r.score for r in ood.scores(ood.forests(train, trees=20), test).collect()}
    assert got["near EW", "EW"] > got["near EW", "RRab"] and got["near RRab", "RRab"] > got["near RRab", "EW"]


def test_isolation_forest_ranks_outliers_low(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, rng.normal(size=2).tolist()) for i in range(300)]
    train = spark.createDataFrame(rows, "id long, label int, v array<double>")
    test = spark.createDataFrame([(1, [0.0, 0.0]), (2, [9.0, 9.0])], "id long, v array<double>")
    got = {r.id: r.class_0 for r in ood.by_class(ood.scores(ood.forests(train, trees=30), test), [0]).collect()}
    assert got[1] > 0 > got[2]


def test_embedding_map_keeps_keys_and_nulls(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, None), (3, [[3.0, 4.0]])], "k long, w array<array<double>>")
    got = {r.k: r.embedding for r in embed.embed(df, "k", "w", lambda: (lambda x: x[:, :, :1] * 2), 1).collect()}
    assert got == {1: [[2.0]], 2: None, 3: [[6.0]]}
    with pytest.raises(Exception, match="the model returned shape"):
        embed.embed(df, "k", "w", lambda: (lambda x: x), 1).collect()


def test_cone_match_against_brute_force(spark):
    rng = np.random.default_rng(4)
    stars, objects = [], []
    for i in range(150):
        ra, dec = rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))
        if i < 20:
            ra, dec = (rng.choice([0.0001, 359.9999]), dec) if i < 10 else (ra, rng.choice([-89.9995, 89.9996, 89.9999]))
        stars.append((i, float(ra), float(dec)))
        for j in range(3):
            objects.append((i * 3 + j, float((ra + rng.normal() * 1.5 / 3600 / max(math.cos(math.radians(dec)), 1e-5)) % 360), float(np.clip(dec + rng.normal() * 1.5 / 3600, -90, 90))))

    def sep(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
        return math.degrees(2 * math.asin(min(1, math.sqrt(h)))) * 3600

    want = {(s[0], o[0]) for s in stars for o in objects if sep(*s[1:], *o[1:]) <= 2}
    got = joins.cone_match(spark.createDataFrame(stars, "star_id long, ra double, dec double"), spark.createDataFrame(objects, "object_id long, ora double, odec double")).collect()
    assert len(got) == len(want) > 100 and {(r.star_id, r.object_id) for r in got} == want


def test_registered_models_use_the_operators_settings(spark, monkeypatch):
    """Only the parameters are looked at: fits are left out."""
    seen = {}

    def spy(module, name, answer):
        shape = inspect.signature(getattr(module, name))

        def call(*args, **kwargs):
            bound = shape.bind(*args, **kwargs)
            bound.apply_defaults()
            seen.setdefault(name, []).append(bound.arguments)
            return answer(bound.arguments)

        monkeypatch.setattr(module, name, call)

    known = lambda a: a["test"].select("id", F.col("label").alias("y_true"), F.col("label").alias("y_pred"))
    spy(classify, "forest", known)
    spy(classify, "perceptron", known)
    monkeypatch.setattr(classify, "standardised", lambda *frames: list(frames))
    spy(ood, "forests", lambda a: a["train"])
    monkeypatch.setattr(ood, "scores", lambda forest, rows: rows)
    rows = spark.createDataFrame([(i, i % 2, [float(i)], s) for i, s in enumerate(["train", "validation", "test"] * 4)], "id long, label int, v array<double>, split string")
    lc = spark.createDataFrame([(s, "gr"[b], 10 * s + k, float(k), float(k * s + b), 0.1) for s in range(5) for b in range(2) for k in range(1, 6)], "sourceid long, band string, obs_id long, mjd double, mag double, err double")
    monkeypatch.setattr(model_queries, "embeddings", lambda *_: rows)
    monkeypatch.setattr(model_queries, "observations", lambda *_: lc)
    default = classify.DEFAULT_FOREST
    for name in ("forest_report", "forest_seeds", "feature_forest_report", "perceptron_report", "isolation_scores", "feature_isolation_scores"):
        getattr(model_queries, name)(spark, "")
    assert len(seen["forest"]) == 5 and all({k: a[k] for k in default} == default for a in seen["forest"])
    assert [(a["hidden"], a["rate"], a["batch"], a["patience"], a["weighted"]) for a in seen["perceptron"]] == [((1024, 512, 256), 1e-3, 1024, 3, True)]
    assert [a["trees"] for a in seen["forests"]] == [ood.TREES] * 2
    searched = {}
    monkeypatch.setattr(classify, "best_parameters", lambda scored: scored)
    monkeypatch.setattr(classify, "grid_search", lambda *a, **k: searched.update(args=a, **k) or rows)
    model_queries.forest_grid(spark, "")
    assert len(searched["args"]) == 2 and set(searched) == {"args"} and len(list(itertools.product(*classify.GRID.values()))) == 36
