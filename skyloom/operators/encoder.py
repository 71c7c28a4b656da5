"""Encoder of light-curve windows: masked self-attention with weights that are read from a table.

A window is a list of times and one of values, of any length.  Values are centred on
their mean and projected; times, counted from the window's first one, are added as sines and
cosines of rates from a day to ``SLOWEST`` days.  Every layer is multi-head
attention and a rectified network of two layers, each after a normalisation and added
to its input.

Windows of an Arrow batch are dealt into length classes (powers of two) and padded
only up to their class; padding has no weight in the attention and is cut off again.
Scores are made for so many windows and queries at once that they stay under ``SCORES`` numbers,
so memory does not grow with the square of a window's length.  A task encodes so many windows of a
batch at once that they have at most ``STEPS`` padded steps, or one window, and pools them before the next ones.

A null or empty window, and one with a null or a number that is not finite, has null results.
Weights are not trained here: ``initial`` gives seeded ones, ``sources.training`` stores and reads any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHORTEST, SLOWEST = 8, 10_000.0
#: Attention scores in memory at once: 4 MB.
SCORES = 1 << 19
#: Padded steps of the windows that are encoded at once.
STEPS = 1 << 13


def initial(width: int = 32, heads: int = 4, layers: int = 2, inner: int = 64, seed: int = 42) -> dict[str, np.ndarray]:
    """Seeded weights by name; ``heads`` is kept as a number beside them."""
    if width % heads or width % 2:
        raise ValueError("the width is even and a multiple of the heads")
    rng = np.random.default_rng(seed)
    dense = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    out = {"heads": np.array([heads]), "input": dense(1, width), "input_bias": np.zeros(width)}
    for i in range(layers):
        out |= {f"{i}.{name}": dense(width, width) for name in ("query", "key", "value", "output")}
        out |= {f"{i}.scale1": np.ones(width), f"{i}.shift1": np.zeros(width), f"{i}.scale2": np.ones(width), f"{i}.shift2": np.zeros(width)}
        out |= {f"{i}.up": dense(width, inner), f"{i}.up_bias": np.zeros(inner), f"{i}.down": dense(inner, width), f"{i}.down_bias": np.zeros(width)}
    return out


def _normalised(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + 1e-5) * scale + shift


def attention(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], layer: int) -> np.ndarray:
    """Self-attention of windows x time x width, in which places outside ``mask`` are not seen."""
    n, time, width = x.shape
    heads = int(w["heads"][0])
    split = lambda name: (x @ w[f"{layer}.{name}"]).reshape(n, time, heads, -1).transpose(0, 2, 1, 3)
    q, k, v = split("query"), split("key").swapaxes(2, 3), split("value")
    hidden = np.where(mask, 0.0, -np.inf)[:, None, None, :]
    out = np.empty_like(q)
    some = max(1, SCORES // (n * heads * time))
    for a in range(0, time, some):
        s = q[:, :, a : a + some] @ k / np.sqrt(width // heads) + hidden
        s = np.exp(s - s.max(axis=-1, keepdims=True))
        out[:, :, a : a + some] = s / s.sum(axis=-1, keepdims=True) @ v
    return out.transpose(0, 2, 1, 3).reshape(n, time, width) @ w[f"{layer}.output"]


def encode(t: np.ndarray, y: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Windows x time x width of padded times and values; what stands at padded places is of no use."""
    width = w["input"].shape[1]
    mean = (y * mask).sum(axis=1, keepdims=True) / mask.sum(axis=1, keepdims=True)
    rates = 2 * np.pi / SLOWEST ** np.linspace(0, 1, width // 2)
    angle = np.where(mask, t - t[:, :1], 0.0)[:, :, None] * rates
    x = np.where(mask, y - mean, 0.0)[:, :, None] @ w["input"] + w["input_bias"] + np.concatenate([np.sin(angle), np.cos(angle)], axis=2)
    for i in range(sum(name.endswith(".query") for name in w)):
        x = x + attention(_normalised(x, w[f"{i}.scale1"], w[f"{i}.shift1"]), mask, w, i)
        h = np.maximum(_normalised(x, w[f"{i}.scale2"], w[f"{i}.shift2"]) @ w[f"{i}.up"] + w[f"{i}.up_bias"], 0)
        x = x + h @ w[f"{i}.down"] + w[f"{i}.down_bias"]
    return x


def classes(lengths: np.ndarray) -> np.ndarray:
    """The length up to which each window is padded: a power of two, ``SHORTEST`` at least."""
    return np.maximum(SHORTEST, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))


def encode_windows(times: list[np.ndarray], values: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Time x width of each window."""
    lengths = np.array([len(x) for x in values], dtype=np.int64)
    padded = classes(lengths)
    out: list = [None] * len(values)
    for size in np.unique(padded):
        members = np.flatnonzero(padded == size)
        at_once = max(1, min(SCORES // (int(w["heads"][0]) * int(size) * int(size)), STEPS // int(size)))
        for a in range(0, len(members), at_once):
            some = members[a : a + at_once]
            t, y = np.zeros((2, len(some), size))
            mask = np.arange(size) < lengths[some, None]
            t[mask], y[mask] = (np.concatenate([x[i] for i in some]) for x in (times, values))
            for i, e in zip(some, encode(t, y, mask, w)):
                out[i] = e[: lengths[i]]
    return out


def runs(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of neighbouring windows with at most ``STEPS`` padded steps together, or one window."""
    out, start, steps = [], 0, 0
    for i, size in enumerate(classes(lengths).tolist()):
        if i > start and steps + size > STEPS:
            out.append((start, i))
            start, steps = i, 0
        steps += size
    return [*out, (start, len(lengths))] if len(lengths) else out


def _finite(t: pa.Scalar, y: pa.Scalar) -> bool:
    if not (t.is_valid and y.is_valid) or len(t.values) != len(y.values) or not len(y.values) or t.values.null_count or y.values.null_count:
        return False
    return bool(np.isfinite(np.asarray(t.values, dtype=float)).all() and np.isfinite(np.asarray(y.values, dtype=float)).all())


def embedded(windows: DataFrame, w: dict[str, np.ndarray], keys: tuple[str, ...] = ("sourceid", "band"), pooled: bool = True) -> DataFrame:
    """``windows`` (keys, mjd, mag as arrays) with ``embedding``: the mean over time, or time x width unless ``pooled``."""
    shared = windows.sparkSession.sparkContext.broadcast(w)  # a model's weights

    def run(batches):
        for batch in batches:
            lengths = np.asarray(batch.column("mag").value_lengths().fill_null(0))
            for a, b in runs(lengths):
                yield encoded(batch.slice(a, b - a))

    def encoded(some: pa.RecordBatch) -> pa.RecordBatch:
        mjd, mag = some.column("mjd"), some.column("mag")
        good = [i for i, (t, y) in enumerate(zip(mjd, mag)) if _finite(t, y)]
        lists = [[np.asarray(c[i].values, dtype=float) for i in good] for c in (mjd, mag)]
        out: list = [None] * some.num_rows
        for i, e in zip(good, encode_windows(*lists, shared.value)):
            out[i] = (e.mean(axis=0) if pooled else e).astype(np.float32).tolist()
        kind = pa.list_(pa.float32()) if pooled else pa.list_(pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([*(some.column(k) for k in keys), pa.array(out, kind)], names=[*keys, "embedding"])

    kinds = dict(windows.dtypes)
    return windows.select(*keys, "mjd", "mag").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + (", embedding array<float>" if pooled else ", embedding array<array<float>>"))
