"""A training that is broken off and taken up again."""

import numpy as np
import pytest

from skyloom.operators import classify
from skyloom.sources import training


def vectors(spark, n=600):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(x) for x in rng.normal(0, 1, 4) + 1.5 * np.eye(4)[i % 3]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, v array<double>")


def test_arrays_come_back(spark, tmp_path):
    arrays = {"a": np.arange(6.0).reshape(2, 3), "b": np.zeros((0, 4)), "c": np.random.default_rng(0).normal(size=training.PIECE + 5)}
    for epoch in range(4):
        training.store(spark, str(tmp_path), epoch, arrays, {"step": epoch})
    assert training.epochs(spark, str(tmp_path)) == [2, 3]
    (tmp_path / "epoch-000009").mkdir()  # broken off while it was written
    epoch, found, note = training.latest(spark, str(tmp_path))
    assert (epoch, note) == (3, {"step": 3}) and found.keys() == arrays.keys()
    assert all(np.array_equal(found[k], arrays[k]) and found[k].shape == arrays[k].shape for k in arrays)
    assert training.latest(spark, str(tmp_path / "none")) is None


def test_taken_up_training_equals_an_unbroken_one(spark, tmp_path, monkeypatch):
    df = vectors(spark)
    fit = lambda folder, epochs, **more: {r.id: r.y_pred for r in classify.perceptron(df, df, df, (8,), dropout=0.1, rate=0.01, batch=32, epochs=epochs, state=str(folder), **more).collect()}
    whole = fit(tmp_path / "whole", 5)

    store, stored = training.store, []

    def dies(spark, folder, epoch, arrays, note):
        if epoch == 2 and not stored:
            stored.append(epoch)
            raise RuntimeError("driver lost")
        store(spark, folder, epoch, arrays, note)

    monkeypatch.setattr(training, "store", dies)
    with pytest.raises(RuntimeError, match="driver lost"):
        fit(tmp_path / "broken", 5)
    assert training.epochs(spark, str(tmp_path / "broken")) == [0, 1]
    assert fit(tmp_path / "broken", 5) == whole
    a, b = (training.latest(spark, str(tmp_path / name)) for name in ("whole", "broken"))
    assert a[0] == b[0] == 4 and all(np.allclose(a[1][k], b[1][k], rtol=1e-9, atol=1e-12) for k in a[1])
    # nothing is left to train
    assert fit(tmp_path / "whole", 5) == whole
    with pytest.raises(ValueError, match="other settings"):
        fit(tmp_path / "whole", 5, seed=7)


def test_a_pass_follows_parts_not_files_and_frames():
    """A task that reads the files of several parts, in any order and frames, gives the states of tasks with one each."""
    import pickle
    import types

    import pandas as pd

    rng = np.random.default_rng(1)
    rows = [pd.DataFrame({"label": rng.integers(0, 2, 40), "v": list(rng.normal(size=(40, 3))), "part": p}) for p in range(3)]
    state = classify._begun({"widths": [3, 4, 2], "seed": 1})
    run = classify._pass(types.SimpleNamespace(value=state), np.ones(2), 8, 0.01, 0.1, 5)
    states = lambda frames: {pickle.loads(r.state)[0].w[0].tobytes(): r.n for f in run(iter(frames)) for r in f.itertuples()}
    want = {k: n for one in rows for k, n in states([one]).items()}
    assert len(want) == 3 and set(want.values()) == {40}
    for order in ([0, 1, 2], [2, 0, 1]):
        several = pd.concat([rows[i] for i in order], ignore_index=True)
        assert states([several]) == states([several[:25], several[25:90], several[90:]]) == want


def test_one_row_of_averaged_weights_reaches_the_driver(spark):
    """However many partitions trained, the driver gets one state: their mean by rows."""
    import pickle

    states = []
    for i in range(16):
        net = classify.Layers([3, 2], i)
        states += [(i % classify.GROUPS, i + 1, bytearray(pickle.dumps((net, [(p * 0, p * 0) for p in net.all()], i))))]
    got = classify._averaged(spark.createDataFrame(states, "g int, n long, state binary"), 16).collect()
    assert len(got) == 1 and got[0]["n"] == 136
    net, _, step = pickle.loads(got[0]["state"])
    want = sum(classify.Layers([3, 2], i).w[0] * (i + 1) for i in range(16)) / 136
    assert step == 15 and abs(net.w[0] - want).max() < 1e-12
