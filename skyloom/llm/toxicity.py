"""Toxicity scores from a counterfactually regularised linear classifier.

Features of a document are its distinct words and their beginnings of 4 to 8
bytes (words are runs of letters, A-Z lower-cased), counted over distinct words.
A logistic model is trained in numpy on a bounded sample of labelled rows.  For
every labelled sentence the identity terms it names are swapped for the other
terms of their group and for a neutral word without weight (each pair is swapped
once besides, so that terms absent from the sample are tied too), and the squared
change of the score's logit is penalised: neither which group a sentence names nor
that it names one may move the score.

Training is bounded: about ``SAMPLE`` labelled rows (whole texts, chosen by a
hash of doc_id), of whose features the ``FEATURES`` with the largest signed
chi-square statistics are kept.  Feature counting runs on the executors.  The
label sample (ids and labels, at most 2 x SAMPLE rows) is the only broadcast
side of the join with documents.

Defined cases: null and empty texts and texts without known features get the
model's base rate; rows of labels with null doc_id or toxic are left out; a
doc_id that labels repeats counts with its largest label; documents that repeat
a doc_id are scored each; without training rows all scores are 0; extra columns
are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnp as tx
from skyloom.llm.shared import cut

SAMPLE, FEATURES = 12_000, 4096
#: Least chi-square statistic of a feature (one in twenty by chance).
EVIDENCE = 3.84
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
L1, L2, COUNTERFACTUAL, STEPS = 1e-5, 3e-6, 1.0, 600

# Groups of identity terms that may stand for each other.
IDENTITY = (
    ("women", "men"),
    ("black", "white", "asian", "latino"),
    ("christian", "muslim", "jewish", "hindu", "atheist"),
    ("gay", "straight", "lesbian", "transgender"),
    ("immigrants", "foreigners", "refugees", "locals"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = True
_LETTERS[0x80:] = True
_PREFIXES = (4, 5, 6, 7, 8)


def _features(words: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes (0: none) of the distinct words, a row each, and the number of each word."""
    hashes = words.hashes(lower=True)
    code, distinct = pd.factorize(hashes)
    if not len(distinct):
        return np.zeros((0, 1 + len(_PREFIXES)), np.uint64), code
    first = np.empty(len(distinct), dtype=np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    start, size = words.start[first], (words.end - words.start)[first]
    out = np.zeros((len(distinct), 1 + len(_PREFIXES)), dtype=np.uint64)
    out[:, 0] = distinct
    total = np.zeros(len(distinct), dtype=np.uint64)
    for i in range(max(_PREFIXES)):
        byte = tx.LOWER[words.buf[np.minimum(start + i, len(words.buf) - 1)]].astype(np.uint64) + np.uint64(1)
        total = total + byte * tx._POWERS[i]
        if i + 1 in _PREFIXES:
            # a beginning is another feature than the word of the same bytes
            out[:, 1 + _PREFIXES.index(i + 1)] = np.where(size > i, tx.mix(total + np.uint64((i + 1) * 0x51ED27)), 0)
    return out, code


def _split(column: pa.Array) -> tx.Words:
    return tx.Words(*tx.text_bytes(column), letter=_LETTERS)


def _pairs(words: tx.Words, code: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, distinct word) pairs of the chosen distinct words."""
    hit = chosen[code] if len(code) else np.zeros(0, bool)
    key = np.unique(words.doc[hit].astype(np.int64) << 32 | code[hit])
    return key >> 32, key & 0xFFFFFFFF


def _counted(batches):
    """(feature, documents, toxic documents) of a batch."""
    for batch in batches:
        for part in tx.slices(batch, "text"):
            toxic = np.asarray(part.column("toxic"), dtype=np.int64)
            words = _split(part.column("text"))
            features, code = _features(words)
            row, word = _pairs(words, code, np.ones(len(features), dtype=bool))
            f = features[word]
            rows = np.repeat(row, f.shape[1])
            f = f.ravel()
            ok = f > 0
            order = np.lexsort((rows[ok], f[ok]))
            f, rows = f[ok][order], rows[ok][order]
            if not len(f):
                continue
            new = np.ones(len(f), dtype=bool)
            new[1:] = (f[1:] != f[:-1]) | (rows[1:] != rows[:-1])
            f, rows = f[new], rows[new]
            keys, back = np.unique(f, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [tx.as_long(keys), pa.array(np.bincount(back)), pa.array(np.bincount(back, weights=toxic[rows]).astype(np.int64))], names=["feature", "n", "t"]
            )


def _vectors(known: np.ndarray):
    """Per labelled row: toxic, numbers of known features, and their counts."""

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                words = _split(part.column("text"))
                row, slot, value = _known_counts(words, known)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                offs = pa.array(cuts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic").cast(pa.int32()), pa.ListArray.from_arrays(offs, pa.array(slot.astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(value.astype(np.float32)))],
                    names=["toxic", "slots", "counts"],
                )

    return run


def _lookup(features: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Number of each feature among the sorted known ones, or -1."""
    at = np.minimum(np.searchsorted(known, features), len(known) - 1)
    return np.where(known[at] == features, at, -1)


def _known_counts(words: tx.Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    features, code = _features(words)
    slots = _lookup(features, known)
    row, word = _pairs(words, code, (slots >= 0).any(axis=1))
    s = slots[word]
    rows = np.repeat(row, s.shape[1])
    s = s.ravel()
    ok = s >= 0
    key, value = np.unique(rows[ok] * len(known) + s[ok], return_counts=True)
    return key // len(known), key % len(known), value


class Model:
    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float):
        used = np.flatnonzero(weights)
        self.known, self.weights, self.bias = known[used], weights[used], bias

    def logits(self, column: pa.Array) -> np.ndarray:
        words = _split(column)
        out = np.full(words.rows, self.bias)
        if len(self.known) and len(words):
            features, code = _features(words)
            slots = _lookup(features, self.known)
            per_word = np.where(slots >= 0, self.weights[slots], 0.0).sum(axis=1)
            row, word = _pairs(words, code, per_word != 0)
            out += np.bincount(row, weights=per_word[word], minlength=words.rows)
        return out


def _identity(known: np.ndarray) -> list[list[np.ndarray]]:
    """Numbers of the known features of every identity term, by group."""
    out = []
    for group in IDENTITY:
        features, code = _features(_split(pa.array(list(group))))
        slots = _lookup(features, known)
        out.append([slots[c][slots[c] >= 0] for c in code])
    return out


def train(known: np.ndarray, toxic: np.ndarray, offs: np.ndarray, slots: np.ndarray, counts: np.ndarray, steps: int = STEPS, penalty: float = COUNTERFACTUAL) -> Model:
    """Proximal gradient descent with momentum; rows in CSR form."""
    n, d = len(toxic), len(known)
    row = np.repeat(np.arange(n), np.diff(offs))
    rate = np.clip(toxic.mean(), 1e-3, 1 - 1e-3)
    w, bias = np.zeros(d), float(np.log(rate / (1 - rate)))
    # counterfactual sentences: term a swapped for b changes exactly these features
    swaps = []
    for group in _identity(known):
        group = [*group, np.zeros(0, dtype=np.int64)]  # the neutral word
        named = [len(np.unique(row[np.isin(slots, s[:1])])) if len(s) else 0 for s in group]
        for i, a in enumerate(group):
            for j, b in enumerate(group):
                if i != j and (len(a) or len(b)):
                    diff = np.zeros(d)
                    np.add.at(diff, a, -1)
                    np.add.at(diff, b, 1)
                    swaps.append((np.sqrt(1 + named[i]), diff))
    change = np.array([weight * diff for weight, diff in swaps]).reshape(-1, d)
    # a bound of the curvature, feature by feature
    scale = np.bincount(slots, weights=counts * np.bincount(row, weights=counts, minlength=n)[row], minlength=d) / (4 * n) + L2
    scale += penalty / n * (np.abs(change) * np.abs(change).sum(axis=1, keepdims=True)).sum(axis=0) if len(change) else 0
    scale = np.maximum(scale, 1e-6)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        z = bias + np.bincount(row, weights=v[slots] * counts, minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        err = (p - toxic) / n
        grad = np.bincount(slots, weights=err[row] * counts, minlength=d) + L2 * v
        if len(change):
            grad += penalty / n * (change.T @ (change @ v))
        step = v - grad / scale
        new = np.sign(step) * np.maximum(np.abs(step) - L1 / scale, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        bias -= err.sum() / max(rate * (1 - rate), 0.02) * 0.5
    return Model(known, w, bias)


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE, penalty: float = COUNTERFACTUAL) -> Model | None:
    """A model from about ``sample`` doc_ids of labels (doc_id, toxic) for which ``usable`` holds, and their documents (of a repeated doc_id the least text); ``penalty`` 0 leaves the swaps out."""
    rows = labels.filter("doc_id is not null and toxic is not null")
    if usable is not None:
        rows = rows.filter(usable)
    rows = rows.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    share = min(1.0, sample / max(rows.count(), 1))
    picked = rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, but costly ones
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of a repeated doc_id one text
    texts = cut(own.select("toxic", "text").repartition(partitions))
    n, t = texts.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not t or t == n:
        return None
    counted = texts.mapInArrow(_counted, "feature long, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter("n >= 5")
    expected = F.col("n") * (t / n)
    chi = (F.col("t") - expected) * (F.col("t") - expected) / expected
    best = counted.filter(chi >= EVIDENCE).withColumn("chi", F.when(F.col("t") > expected, chi).otherwise(chi / 4)).orderBy(F.desc("chi"), "feature").limit(FEATURES).select("feature").toPandas()
    own = _features(_split(pa.array([x for g in IDENTITY for x in g])))[0].ravel()
    known = np.unique(np.concatenate([best["feature"].to_numpy(np.int64).view(np.uint64), own[own > 0]]))
    got = texts.mapInArrow(_vectors(known), "toxic int, slots array<int>, counts array<float>").toPandas()
    size = got["slots"].map(len).to_numpy()
    return train(
        known,
        got["toxic"].to_numpy(float),
        np.concatenate(([0], np.cumsum(size))),
        np.concatenate(got["slots"].to_numpy()).astype(np.int64),
        np.concatenate(got["counts"].to_numpy()).astype(np.float64),
        penalty=penalty,
    )


def _scores(model: Model | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    return 1 / (1 + np.exp(-np.clip(model.logits(column), -40, 40)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(shared.value, part.column("text")))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                yield part.filter(pa.array(_scores(shared.value, part.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
