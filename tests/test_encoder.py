"""The encoder against plain loops over places, heads and layers."""

import math

import numpy as np
import pytest

from skyloom.operators import encoder
from skyloom.sources import training


def normalised(v, scale, shift):
    mean = sum(v) / len(v)
    spread = math.sqrt(sum((a - mean) ** 2 for a in v) / len(v) + 1e-5)
    return np.array([(a - mean) / spread * s + b for a, s, b in zip(v, scale, shift)])


def plain(t, y, w):
    """One window, one place at a time, without padding."""
    width, heads = w["input"].shape[1], int(w["heads"][0])
    each, mean = width // heads, sum(y) / len(y)
    rates = [2 * math.pi / encoder.SLOWEST ** (i / (width // 2 - 1)) for i in range(width // 2)]
    x = [(b - mean) * w["input"][0] + w["input_bias"] + np.array([f((a - t[0]) * r) for f in (math.sin, math.cos) for r in rates]) for a, b in zip(t, y)]
    layer = 0
    while f"{layer}.query" in w:
        g = lambda name: w[f"{layer}.{name}"]  # noqa: B023, E731
        h = [normalised(v, g("scale1"), g("shift1")) for v in x]
        q, k, v = ([a @ g(name) for a in h] for name in ("query", "key", "value"))
        new = []
        for i in range(len(x)):
            seen = []
            for j in range(heads):
                part = slice(j * each, (j + 1) * each)
                score = [math.exp(q[i][part] @ b[part] / math.sqrt(each)) for b in k]
                seen.append(sum(s * b[part] for s, b in zip(score, v)) / sum(score))
            new.append(x[i] + np.concatenate(seen) @ g("output"))
        x = [a + np.maximum(normalised(a, g("scale2"), g("shift2")) @ g("up") + g("up_bias"), 0) @ g("down") + g("down_bias") for a in new]
        layer += 1
    return np.array(x)


def windows(lengths, seed=0):
    rng = np.random.default_rng(seed)
    return [np.sort(rng.uniform(0, 900, n)) + 50_000 for n in lengths], [rng.normal(15, 2, n) for n in lengths]


@pytest.mark.parametrize("scores", [encoder.SCORES, 300])
def test_encoder_equals_plain_loops(monkeypatch, scores):
    monkeypatch.setattr(encoder, "SCORES", scores)  # few scores at once: queries in blocks, one window at a time
    w = encoder.initial(width=12, heads=3, layers=2, inner=10, seed=1)
    w = {k: a if k == "heads" else a + 0.05 * np.random.default_rng(7).normal(size=a.shape) for k, a in w.items()}
    times, values = windows([1, 2, 7, 8, 9, 33, 8, 64])
    for got, t, y in zip(encoder.encode_windows(times, values, w), times, values):
        assert got.shape == (len(t), 12)
        assert np.allclose(got, plain(t, y, w), rtol=1e-9, atol=1e-9)


def test_length_classes():
    assert encoder.classes(np.array([0, 1, 8, 9, 16, 17, 200])).tolist() == [8, 8, 8, 16, 16, 32, 256]
    with pytest.raises(ValueError):
        encoder.initial(width=10, heads=4)


def test_encoder_over_a_frame_with_stored_weights(spark, tmp_path):
    training.store(spark, str(tmp_path), 0, encoder.initial(width=8, heads=2, layers=1, inner=6), {})
    w = training.latest(spark, str(tmp_path))[1]
    times, values = windows([3, 20, 5])
    rows = [(f"s{i}", "g", [float(a) for a in t], [float(a) for a in y]) for i, (t, y) in enumerate(zip(times, values))]
    rows += [("none", "g", None, None), ("empty", "g", [], []), ("null", "g", [1.0, None], [1.0, 2.0]), ("nan", "g", [1.0, 2.0], [float("nan"), 2.0]), (None, "g", [1.0], [2.0])]
    df = spark.createDataFrame(rows, "sourceid string, band string, mjd array<double>, mag array<double>")
    got = {r.sourceid: r.embedding for r in encoder.embedded(df, w).collect()}
    assert len(got) == len(rows) and all(got[k] is None for k in ("none", "empty", "null", "nan")) and got[None] is not None
    steps = {r.sourceid: r.embedding for r in encoder.embedded(df, w, pooled=False).collect()}
    for i, (t, y) in enumerate(zip(times, values)):
        want = plain(t, y, w)
        assert np.allclose(got[f"s{i}"], want.mean(axis=0), atol=1e-5) and np.allclose(steps[f"s{i}"], want, atol=1e-5)
    assert encoder.embedded(df.limit(0), w).count() == 0


def test_windows_of_a_batch_are_encoded_some_at_a_time(spark, monkeypatch):
    """Memory follows ``STEPS`` and the longest window, not the rows of a batch."""
    assert encoder.runs(np.array([], dtype=int)) == []
    lengths = np.array([3, 9, 200, 0, 40, 7, 8] * 50)
    for steps in (8, 300, encoder.STEPS):
        monkeypatch.setattr(encoder, "STEPS", steps)
        cuts = encoder.runs(lengths)
        assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == len(lengths)
        assert all(b - a == 1 or encoder.classes(lengths[a:b]).sum() <= steps for a, b in cuts)

    peak = []
    encode = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda t, *more: peak.append(t.size) or encode(t, *more))
    times, values = windows([12] * 2000)
    w = encoder.initial(width=8, heads=2, layers=1, inner=6)
    assert len(encoder.encode_windows(times, values, w)) == 2000 and max(peak) <= encoder.STEPS == 1 << 13
