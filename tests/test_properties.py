"""Invariants over generated inputs."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.operators import cluster, evaluate, periodogram, splits

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PAIRS = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=2, max_size=40)


@FEW
@given(pairs=PAIRS, shift=st.integers(1, 50))
def test_cluster_scores_ignore_names(spark, pairs, shift):
    a = spark.createDataFrame(pairs, "y_true int, y_pred int")
    b = a.withColumn("y_pred", (F.col("y_pred") * 7 + shift) % 100)
    x, y = evaluate.cluster_scores(a).first(), evaluate.cluster_scores(b).first()
    assert abs(x.ari - y.ari) < 1e-9 and abs(x.nmi - y.nmi) < 1e-9 and x.ari <= 1 + 1e-9 and -1e-9 <= x.nmi <= 1 + 1e-9


@FEW
@given(pairs=PAIRS)
def test_confusion_and_report_add_up(spark, pairs):
    pred = spark.createDataFrame(pairs, "y_true int, y_pred int")
    cells = evaluate.confusion(pred).collect()
    labels = {x for p in pairs for x in p}
    assert len(cells) == len(labels) ** 2 and sum(c.n for c in cells) == len(pairs)
    rows = {r.row: r for r in evaluate.report(pred).collect()}
    assert sum(rows[str(x)].support for x in labels) == len(pairs)
    assert abs(rows["accuracy"].f1 - sum(a == b for a, b in pairs) / len(pairs)) < 1e-12
    assert abs(rows["weighted avg"].recall - rows["accuracy"].recall) < 1e-12


@FEW
@given(sizes=st.lists(st.integers(1, 30), min_size=1, max_size=5), seed=st.integers(0, 99))
def test_splits_are_disjoint_complete_and_exact(spark, sizes, seed):
    rows = [(i * 1000 + j, i) for i, n in enumerate(sizes) for j in range(n)]
    got = splits.stratified(spark.createDataFrame(rows, "id long, label int"), "id", "label", seed).collect()
    assert len(got) == len(rows)
    for i, n in enumerate(sizes):
        tests = sum(r.split == "test" for r in got if r.label == i)
        assert tests == -(-n // 5)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=25))
def test_ward_heights_rise(values):
    merges = cluster.ward_merges(np.array(values)[:, None], np.ones(len(values)))
    assert (np.diff(merges[:, 2]) >= -1e-9).all() and merges[-1, 3] == len(values)
    for k in (1, 2, len(values)):
        labels = cluster.cut_tree(merges, len(values), k)
        assert len(set(labels)) == k and set(labels) == set(range(1, k + 1))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_periodogram_is_bounded(seed):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 50, 30))
    power = periodogram.lomb_scargle(t, rng.normal(size=30), periodogram.grid(t)[:300])
    assert (power >= -1e-9).all() and (power <= 1 + 1e-9).all()
