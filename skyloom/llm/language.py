"""Language identification with prediction by partial matching.

Each language has a variable-order context tree over bytes: the counts of every
byte after every context of up to ``ORDER`` bytes.  Words are joined by one space
and A-Z lower-cased; a text starts after spaces and ends with one, and contexts
reach across the space into the word before.  Code lengths follow escape method C: a
context that knows the byte charges ``n / (total + distinct)``, one that does not
charges its escape ``distinct / (total + distinct)`` and passes on to the next
shorter context; below order 0 all bytes are alike.  Statistics are frozen after
training, so the code length of a word after the same two bytes is the same
everywhere and a text's length is the sum of its words'; the language with the
shortest code wins.

Trees are learnt from a bounded sample of whole labelled documents of every
language, chosen by a hash of doc_id: in expectation at most ``SAMPLE`` documents
and ``SAMPLE_BYTES`` of text of each, and all of a rare language.  Counting runs on
the executors, and only the counts (at most the sample's distinct n-grams) reach
the driver.  All code lengths of known n-grams are resolved into one table, in
which each distinct word of a slice, with the end of the word before, is looked up once.

Defined cases: a null text and one without a letter are ``und`` with score 0; ties
take the alphabetically first language; labelled rows without text or lang are
left out; a repeated doc_id is learnt from with all its rows or none; without any
training row all are ``und``; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnp as tx

ORDER = 3
#: Labelled documents of a language to learn from, and bytes of their text, in expectation.
SAMPLE, SAMPLE_BYTES = 1500, 4 << 20
#: Weight of code lengths in the posterior of the score.
_LN2 = np.log(2.0)


def _unique_words(words: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the distinct words, each as the ``ORDER`` bytes before it, word, space; their sizes; and each word's number."""
    size = words.end - words.start
    last = tx.LOWER[words.buf[words.end - 1]] if len(words) else np.zeros(0, np.uint8)
    second = np.where(size > 1, tx.LOWER[words.buf[np.maximum(words.end - 2, 0)]], np.uint8(0x20)) if len(words) else last
    before = np.full((ORDER, len(words)), 0x20, dtype=np.uint8)  # the last one is the space
    inner = words.pos > 0
    for row, byte in ((ORDER - 2, last), (ORDER - 3, second)):
        before[row, 1:] = np.where(inner[1:], byte[:-1], np.uint8(0x20))
    end = before[ORDER - 3].astype(np.uint64) << np.uint64(8) | before[ORDER - 2]
    code, distinct = pd.factorize(tx.mix(words.hashes(lower=True) ^ (end * np.uint64(0xD6E8FEB86659FD93))))
    first = np.empty(len(distinct), dtype=np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    size = size[first]
    full = size + ORDER + 1
    body = np.full(int(full.sum()), 0x20, dtype=np.uint8)
    base = np.cumsum(full) - full
    for i in range(ORDER):
        body[base + i] = before[i, first]
    body[tx.ragged(base + ORDER, size)] = tx.LOWER[words.buf[tx.ragged(words.start[first], size)]]
    return body, full, code


def _grams(body: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every coded byte (the word and the space after it) its keys by order, and its word."""
    base = np.repeat(np.cumsum(full) - full, full)
    at = np.flatnonzero(np.arange(len(body)) >= base + ORDER)
    big = body.astype(np.int64)
    key = big[at]
    out = [key]
    for k in range(1, ORDER + 1):
        key = key | big[at - k] << (8 * k)
        out.append(key | (k << 40))
    return np.stack(out), np.repeat(np.arange(len(full)), full)[at]


def _counts(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            mine = batch.filter(pa.array([x == lang for x in langs]))
            for part in tx.slices(mine, "text"):
                words = tx.Words(*tx.text_bytes(part.column("text")))
                body, full, code = _unique_words(words)
                grams, word = _grams(body, full)
                times = np.bincount(code, minlength=len(full))[word]
                for k in range(ORDER + 1):
                    keys, back = np.unique(grams[k], return_inverse=True)
                    n = np.bincount(back, weights=times, minlength=len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])


class Trees:
    """Code lengths in bits of all known n-grams, by language."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        n = len(self.langs)
        of = counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy()
        gram, times = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        order = gram >> 40
        self.keys: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        for k in range(ORDER + 1):
            here = order == k
            context = gram[here] & ~np.int64(0xFF)
            ctx, cback = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(ctx), n)), np.zeros((len(ctx), n))
            np.add.at(total, (cback, of[here]), times[here])
            np.add.at(kinds, (cback, of[here]), 1)
            log = lambda x, y: np.log2(np.divide(x, y, out=np.ones_like(x), where=x > 0))  # noqa: E731; 0 where x is
            escape = -log(kinds, total + kinds)
            keys, back = np.unique(gram[here], return_inverse=True)
            seen = np.zeros((len(keys), n))
            np.add.at(seen, (back, of[here]), times[here])
            place = np.searchsorted(ctx, keys & ~np.int64(0xFF))
            lower = self._lower(keys, k) if len(keys) else np.zeros((0, n))
            bits = np.where(seen > 0, -log(seen, (total + kinds)[place]), escape[place] + lower)
            self.keys.append(keys), self.bits.append(bits.astype(np.float32))
            self.contexts.append(ctx), self.escape.append(escape.astype(np.float32))

    def _lower(self, keys: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full((len(keys), len(self.langs)), np.log2(257.0))
        return self.lengths(self.shorter(keys, k), k - 1)

    @staticmethod
    def shorter(keys: np.ndarray, k: int) -> np.ndarray:
        return (keys & ((1 << (8 * k)) - 1)) | ((k - 1) << 40)

    def lengths(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits of n-grams of order k, whether known or not."""
        out = np.full((len(keys), len(self.langs)), np.float32(np.log2(257.0)))
        if k < 0 or not len(keys):
            return out
        known = self.keys[k]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), dtype=bool)
        out[hit] = self.bits[k][at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            low = self.lengths(self.shorter(keys[miss], k), k - 1) if k else out[miss]
            ctx = keys[miss] & ~np.int64(0xFF)
            known = self.contexts[k]
            at = np.minimum(np.searchsorted(known, ctx), max(len(known) - 1, 0))
            if len(known):
                low = low + np.where((known[at] == ctx)[:, None], self.escape[k][at], 0)
            out[miss] = low
        return out

    def rows(self, column: pa.Array) -> np.ndarray:
        """Bits of every row's text in every language."""
        words = tx.Words(*tx.text_bytes(column))
        out = np.zeros((words.rows, len(self.langs)))
        if not len(words):
            return out
        body, full, code = _unique_words(words)
        grams, word = _grams(body, full)
        bits = self.lengths(grams[ORDER], ORDER)
        for i in range(len(self.langs)):
            per_word = np.bincount(word, weights=bits[:, i], minlength=len(full))
            out[:, i] = np.bincount(words.doc, weights=per_word[code], minlength=words.rows)
        return out


def learn(rows: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Trees | None:
    """Trees from about ``sample`` rows (doc_id, text, lang) with text of every lang, and ``sample_bytes`` of text; of every lang at least one row, however long."""
    rows = rows.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 20))
    stock = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(place).alias("first")).collect()  # a row a language
    if not stock:
        return None
    least = lambda r: max(r["first"] + 1, int(min(1.0, sample / r["n"], sample_bytes / max(r["bytes"], 1)) * (1 << 20)))  # noqa: E731  the first row of a language at least
    share = F.create_map(*[F.lit(x) for r in stock for x in (r["lang"], least(r))])
    picked = rows.filter(place < F.element_at(share, F.col("lang")))
    counts = picked.select("text", "lang").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Trees(counts) if len(counts) else None


def _letters(column: pa.Array) -> np.ndarray:
    """Rows that have a letter."""
    buf, offs = tx.text_bytes(column)
    seen = np.concatenate(([0], np.cumsum(((tx.LOWER[buf] >= 0x61) & (tx.LOWER[buf] <= 0x7A)).astype(np.int64))))
    out = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py() or "")
    return out


def _predict(trees):
    def run(batches):
        model = trees.value
        for batch in batches:
            for part in tx.slices(batch, "text"):
                text = part.column("text")
                letters = _letters(text)
                if model is None:
                    lang, score = ["und"] * len(text), np.zeros(len(text))
                else:
                    bits = model.rows(text)
                    best = bits.argmin(axis=1)
                    weight = np.exp(-(bits - bits.min(axis=1, keepdims=True)) * _LN2)
                    score = np.where(letters, 1 / weight.sum(axis=1), 0.0)
                    lang = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
