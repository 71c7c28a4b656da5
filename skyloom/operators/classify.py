"""Classifiers on (v, label), a fixed validation fold, and several seeds.

Regressions are Spark ML's; forests are those of ``operators.forest``, of any depth and
with an exact least size of nodes to split.  A grid search fits one forest, of the
most trees and without limits, and reads every setting from it.

The perceptron is trained in numpy: its loss is weighted by class, its hidden layers
have dropout, its steps are Adam's, and it stops early by the validation loss.  Rows
are dealt to at most ``WORKERS`` partitions; in every epoch each takes one pass over
its rows in batches from the common weights, and the weights are averaged by rows.
With a folder for its ``state``, every epoch is stored there, and a run that finds one goes on after it.
"""

from __future__ import annotations

import json
import pickle
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import groupby, product
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.operators import evaluate, knn
from skyloom.operators import forest as forests
from skyloom.sources import scratch, training

#: Parameters that are used where no search is asked for.
DEFAULT_FOREST = {"trees": 200, "depth": 20, "split": 2}
GRID = {"trees": (100, 200, 500), "depth": (10, 20, 30, None), "split": (2, 5, 10)}
# The names that parameter files give to those of a forest.
PARAMETER_NAMES = {"n_estimators": "trees", "max_depth": "depth", "min_samples_split": "split", "min_samples_leaf": "leaf"}
#: Fits at once of several seeds.
FITS = 4
#: Rows of a part that the perceptron holds and shuffles at once.
CHUNK = 10_000
#: Stands for a depth without limit.
_NO_LIMIT = 1 << 30
#: Partitions of the perceptron's training rows at most, and groups that average their weights first.
WORKERS, GROUPS = 256, 16
#: Groups whose weights are averaged at once, until one is left for the driver.
FEW = 4


def seeds(base: int = 42) -> list[int]:
    return [base, base + 58, base + 158]


def featured(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col("v").cast("array<double>"))).withColumn("label", F.col("label").cast("double"))


def balanced(df: DataFrame) -> DataFrame:
    """``weight``: n / (classes x count of the class)."""
    w = evaluate.class_weights(df, "label").select("label", F.col("balanced_weight").alias("weight"))
    return df.join(w, "label")


def predictions(model, test: DataFrame) -> DataFrame:
    return model.transform(featured(test)).select("id", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


def logistic(train: DataFrame, test: DataFrame, c: float = 1.0) -> DataFrame:
    """Multinomial logistic regression with balanced weights; ``c`` is the inverse strength of the L2 penalty."""
    rows = balanced(featured(train))
    total = rows.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(family="multinomial", weightCol="weight", standardization=False, regParam=1 / (c * total), maxIter=200, tol=1e-6).fit(rows)
    return predictions(model, test)


def forest(train: DataFrame, test: DataFrame, trees: int = 200, depth: int | None = 20, split: int = 2, leaf: int = 1, seed: int = 42) -> DataFrame:
    """(id, y_true, y_pred) of a forest; ``depth`` None has no limit."""
    fitted = forests.fit(train, trees, seed, depth, split, leaf)
    return forests.predict(fitted, test, [(trees, depth, split)]).select("id", "y_true", "y_pred")


def given_parameters(text: str | None) -> dict:
    """Parameters of ``forest`` from JSON in which None may stand for null; the default without text.  Names that are not known fail."""
    if not text:
        return dict(DEFAULT_FOREST)
    given = json.loads(re.sub(r"\bNone\b", "null", text))
    unknown = set(given) - set(PARAMETER_NAMES)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}; known: {sorted(PARAMETER_NAMES)}")
    return {**DEFAULT_FOREST, **{PARAMETER_NAMES[k]: v for k, v in given.items()}}


def together(fit, settings) -> list:
    """``fit`` of every setting, ``FITS`` at once: each is many small jobs, which leave executors idle between them."""
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.getActiveSession())(fit), settings))


def grid_search(train: DataFrame, validation: DataFrame, grid: dict = GRID, seed: int = 42) -> DataFrame:
    """(trees, depth, split, f1): macro F1 on the validation rows of every combination; a null depth has no limit.

    Smaller forests, less deep ones and those with larger nodes to split are parts of the largest one, so there is one fit.
    """
    settings = list(product(*(grid[k] for k in ("trees", "depth", "split"))))
    deepest = None if None in grid["depth"] else max(grid["depth"])
    fitted = forests.fit(train, max(grid["trees"]), seed, deepest, min(grid["split"]))
    by = ["trees", "depth", "split"]
    # a null depth would not meet itself in the report's joins
    said = forests.predict(fitted, validation, settings).withColumn("depth", F.coalesce("depth", F.lit(_NO_LIMIT)))
    found = evaluate.report(said, by).filter("row = 'macro avg'")
    return found.select("trees", F.expr(f"nullif(depth, {_NO_LIMIT})").alias("depth"), "split", "f1")


def best_parameters(scored: DataFrame) -> DataFrame:
    """The combination with the largest F1; on ties the smaller forest, then the less deep one, then the larger nodes."""
    return scored.agg(F.max_by(F.struct("trees", "depth", "split", "f1"), F.struct("f1", -F.col("trees"), -F.coalesce("depth", F.lit(_NO_LIMIT)), "split")).alias("b")).select("b.*")


def several_seeds(fit, base: int = 42) -> DataFrame:
    """Predictions of ``fit(seed)`` for every seed, with a ``seed`` column."""
    return reduce(DataFrame.unionByName, together(lambda s: fit(s).withColumn("seed", F.lit(s)), seeds(base)))


def standardised(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """The frames with ``v`` scaled by the training rows."""
    scaler = knn.fit_scaler(train)
    return [knn.apply_scaler(df, scaler) for df in (train, *others)]


class Layers:
    """Weights of a perceptron with rectified hidden layers."""

    def __init__(self, widths: list[int], seed: int):
        rng = np.random.default_rng(seed)
        self.w = [rng.uniform(-1, 1, (a, b)) / np.sqrt(a) for a, b in zip(widths[:-1], widths[1:])]
        self.b = [rng.uniform(-1, 1, b) / np.sqrt(a) for a, b in zip(widths[:-1], widths[1:])]

    def all(self) -> list[np.ndarray]:
        return self.w + self.b

    def forward(self, x: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None):
        """Scores of the classes, and what each layer was given."""
        seen = [x]
        for w, b in zip(self.w[:-1], self.b[:-1]):
            x = np.maximum(x @ w + b, 0)
            if dropout:
                x = x * (rng.random(x.shape) >= dropout) / (1 - dropout)
            seen.append(x)
        return x @ self.w[-1] + self.b[-1], seen

    def loss(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
        """Sum of the weighted cross entropies, and of the weights."""
        z, _ = self.forward(x)
        z = z - z.max(axis=1, keepdims=True)
        return float((weight[y] * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y])).sum()), float(weight[y].sum())

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, dropout: float, rng: np.random.Generator) -> list[np.ndarray]:
        """Of the weighted mean cross entropy, in the order of ``all``."""
        z, seen = self.forward(x, dropout, rng)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d *= (weight[y] / weight[y].sum())[:, None]
        gw, gb = [], []
        for w, x in zip(self.w[::-1], seen[::-1]):
            gw.append(x.T @ d), gb.append(d.sum(axis=0))
            d = (d @ w.T) * (x > 0) / (1 - dropout)
        return gw[::-1] + gb[::-1]


def _chunks(frames, rows: int):
    """(part, frame) of the frames' rows: so many of a part each time, wherever frames end and whichever files a task reads."""
    part, held = None, None
    for f in frames:
        for p, some in f.groupby("part", sort=False):
            if held is not None and len(held) and p != part:
                yield part, held
                held = None
            part, held = p, some if held is None else pd.concat([held, some])
            while len(held) >= rows:
                yield part, held[:rows]
                held = held[rows:]
    if held is not None and len(held):
        yield part, held


def _pass(shared, weight: np.ndarray, batch: int, rate: float, dropout: float, seed: int):
    """One pass of Adam over each part of a task, chunk by chunk: its group, rows, weights and Adam's moments."""

    def run(frames):
        for part, chunks in groupby(_chunks(frames, max(CHUNK, batch)), itemgetter(0)):
            net, moments, step = pickle.loads(pickle.dumps(shared.value))
            rows = 0
            rng = np.random.default_rng([seed, step, part])
            for _, f in chunks:
                x, y = np.array(f["v"].tolist(), dtype=float), f["label"].to_numpy(int)
                rows += len(y)
                order = rng.permutation(len(y))
                for a in range(0, len(y), batch):
                    some = order[a : a + batch]
                    step += 1
                    for p, g, (m, v) in zip(net.all(), net.gradients(x[some], y[some], weight, dropout, rng), moments):
                        m += 0.1 * (g - m)
                        v += 0.001 * (g * g - v)
                        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            yield pd.DataFrame({"g": [part % GROUPS], "n": [rows], "state": [pickle.dumps((net, moments, step))]})

    return run


def _average_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"g": [key[0]], "n": [rows["n"].sum()], "state": [pickle.dumps(_average(sorted(zip(rows["n"], rows["state"]))))]})  # in one order, whichever came first


def _averaged(states: DataFrame, groups: int) -> DataFrame:
    """One row of all partitions' states (g, n, state): averaged by group, then ``FEW`` groups at a time."""
    schema = "g int, n long, state binary"
    states = states.groupBy("g").applyInPandas(_average_group, schema)
    while groups > 1:
        states = states.withColumn("g", F.floor(F.col("g") / FEW).cast("int")).groupBy("g").applyInPandas(_average_group, schema)
        groups = -(-groups // FEW)
    return states


def _average(states: list[tuple[int, bytes]]):
    """The state of all partitions: means by rows."""
    total = sum(n for n, _ in states)
    net, moments, step = None, None, 0
    for n, blob in states:
        other, more, steps = pickle.loads(blob)
        step = max(step, steps)
        if net is None:
            net, moments = other, more
            for x in [*net.all(), *(a for pair in moments for a in pair)]:
                x *= n / total
        else:
            for x, y in zip([*net.all(), *(a for pair in moments for a in pair)], [*other.all(), *(a for pair in more for a in pair)]):
                x += y * (n / total)
    return net, moments, step


def _begun(settings: dict):
    net = Layers(settings["widths"], settings["seed"])
    return net, [(np.zeros_like(p), np.zeros_like(p)) for p in net.all()], 0


def _arrays(now, best: Layers) -> dict[str, np.ndarray]:
    """Weights, both moments and the best weights by name."""
    net, moments, _ = now
    kinds = {"weights": net.all(), "first": [m for m, _ in moments], "second": [v for _, v in moments], "best": best.all()}
    return {f"{kind}-{i:03d}": a for kind, arrays in kinds.items() for i, a in enumerate(arrays)}


def _taken_up(settings: dict, epoch: int, arrays: dict[str, np.ndarray], note: dict):
    """The next epoch, the state, the best loss with its weights, and the epochs since it, of a stored epoch."""
    if note["settings"] != settings:
        raise ValueError(f"the folder has a training with other settings: {note['settings']}, asked for {settings}")
    (net, moments, _), best = _begun(settings), Layers(settings["widths"], settings["seed"])
    for i, (p, (m, v), b) in enumerate(zip(net.all(), moments, best.all())):
        p[:], m[:], v[:], b[:] = (arrays[f"{kind}-{i:03d}"] for kind in ("weights", "first", "second", "best"))
    return epoch + 1, (net, moments, note["step"]), (np.inf if note["best"] is None else note["best"], best), note["waited"]


def perceptron(
    train: DataFrame, validation: DataFrame, test: DataFrame, hidden=(1024, 512, 256), dropout: float = 0.0, rate: float = 1e-3, batch: int = 1024, epochs: int = 100, patience: int = 3, weighted: bool = True, seed: int = 42, state: str | None = None
) -> DataFrame:
    """Predictions of the perceptron that has the least validation loss; training ends ``patience`` epochs after it.

    ``state`` names a folder that all executors share.  The rows as they were dealt are kept there too, so a run that
    is taken up has the weights of one that was never broken off.  Other settings than the stored ones, or other
    widths and classes, are an error.
    """
    spark = train.sparkSession
    width, classes = train.agg(F.max(F.size("v")), F.max("label").cast("int")).first()
    counts = {r["label"]: r["balanced_weight"] for r in evaluate.class_weights(train, "label").collect()}
    weight = np.array([counts.get(c, 0.0) if weighted else 1.0 for c in range(classes + 1)])
    # by id and in its order, so that the same rows are dealt the same way in every run
    by = ["id"] if "id" in train.columns else ["label", "v"]
    # rows keep the number of their part: which files a task reads follows their sizes and the order of a folder's listing
    parts = min(WORKERS, max(1, -(-train.count() // (4 * batch))))
    dealt = train.repartition(parts, *by).sortWithinPartitions(*by).select("label", "v", F.spark_partition_id().alias("part"))
    kept = validation.select("label", "v")
    rows = training.once(dealt, f"{state}/parts") if state else scratch.written(dealt, "perceptron")
    held = training.once(kept, f"{state}/held") if state else scratch.written(kept, "perceptron")
    settings = {"widths": [width, *hidden, classes + 1], "dropout": dropout, "rate": rate, "batch": batch, "weighted": weighted, "seed": seed}
    now, waited, start = _begun(settings), 0, 0
    best = (np.inf, now[0])
    if state and (found := training.latest(spark, state)):
        start, now, best, waited = _taken_up(settings, *found)
    for epoch in range(start, epochs):
        if waited >= patience:
            break
        shared = spark.sparkContext.broadcast(now)
        got = rows.mapInPandas(_pass(shared, weight, batch, rate, dropout, seed + epoch), "g int, n long, state binary")
        got = _averaged(got, min(parts, GROUPS)).collect()  # one row: the model's size, whatever the number of rows
        shared.destroy()
        now = _average([(r["n"], r["state"]) for r in got])
        model = spark.sparkContext.broadcast(now[0])

        def losses(frames, model=model):
            for f in frames:
                if len(f):
                    total, n = model.value.loss(np.array(f["v"].tolist(), dtype=float), f["label"].to_numpy(int), weight)
                    yield pd.DataFrame({"loss": [total], "weight": [n]})

        loss = held.mapInPandas(losses, "loss double, weight double").agg(F.sum("loss") / F.sum("weight")).first()[0]
        if loss is None or loss < best[0]:
            best, waited = (np.inf if loss is None else loss, now[0]), 0
        else:
            waited += 1
        if state:
            training.store(spark, state, epoch, _arrays(now, best[1]), {"settings": settings, "step": now[2], "best": None if best[0] == np.inf else best[0], "waited": waited})
    model = spark.sparkContext.broadcast(best[1])

    def predict(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "y_true": f["label"].astype("int32"), "y_pred": model.value.forward(np.array(f["v"].tolist(), dtype=float))[0].argmax(axis=1).astype("int32")})

    return test.select("id", "label", "v").mapInPandas(predict, f"id {dict(test.dtypes)['id']}, y_true int, y_pred int")


def capped(train: DataFrame, most: int, id_column: str = "id") -> DataFrame:
    """At most ``most`` rows in the order of the id's hash, for fitting a scaler on part of a table."""
    return train.orderBy(F.xxhash64(id_column), id_column).limit(most)


def argmax(scores: DataFrame, by: str) -> DataFrame:
    """The class with the largest score of each row of a long table (by, label, score)."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "label"))
    return scores.withColumn("_r", place).filter("_r = 1").drop("_r")
