"""Ranked lexical search against brute force, and its edge cases."""

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import lexical

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, score double, rank int, terms string"
ITEMS = "item_id long, text string, doc_id long, score int"


def indexed(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, 9, 0.5, 1, "x") for i, t in zip(ids, texts)], DOCS).repartition(3)


def asked(spark, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS).repartition(2)


def brute(texts, ids, items, k=10):
    bags = [Counter(TERM.findall((t or "").translate(LOW))) for t in texts]
    n, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in df}
    out = []
    for item, text in set(items):
        terms = set(TERM.findall((text or "").translate(LOW)))
        scores = []
        for i, b in zip(ids, bags):
            m = 10 + 90 * sum(b.values()) * n // total if b else 0
            s = sum(weight[t] * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def bodies(seed, n=300):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcXYé1") for _ in range(rng.randrange(1, 5))) for _ in range(150)]
    text = lambda most: rng.choice([" ", "-", "_", ".\n"]).join(rng.choice(vocab[: rng.randrange(1, 150)]) for _ in range(rng.randrange(1, most)))
    texts = [None, "", " ...", "a", "A", "ÀÉ àé", "ab\x7fab\x80ab"] + [text(60) for _ in range(n)]
    texts += [texts[20]] * 40 + [text(30_000)]
    items = [(i, text(25)) for i in range(30)] + [(90, None), (91, "!?"), (92, "nowhere zzzz"), (93, "a a A"), (1, "b c"), (93, "a a A"), (94, texts[20])]
    return texts, items


@pytest.mark.parametrize("seed,pairs,segment", [(1, 1 << 20, 1 << 20), (2, 50, 3000), (3, 1 << 20, 500)])
def test_search(spark, monkeypatch, seed, pairs, segment):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 1500 if seed == 2 else 1 << 22)
    texts, items = bodies(seed)
    got = found(lexical.search(lexical.build(indexed(spark, texts)), asked(spark, items)))
    assert got == brute(texts, range(len(texts)), items)


def test_search_of_repeated_and_null_ids(spark):
    texts = ["red fox", "red fox", "red fox", "red", "blue fox", None]
    ids = [None, 4, 4, 2, 2, 9]
    items = [(1, "red FOX"), (None, "blue")]
    got = found(lexical.search(lexical.build(indexed(spark, texts, ids)), asked(spark, items), k=3))
    assert got == brute(texts, ids, items, 3)


def test_empty_tables(spark):
    index = lexical.build(indexed(spark, ["a b"]))
    assert found(lexical.search(index, asked(spark, [(1, "a")]).limit(0))) == []
    assert found(lexical.search(lexical.build(indexed(spark, ["a"]).limit(0)), asked(spark, [(1, "a")]))) == []
    assert found(lexical.search(lexical.build(indexed(spark, [None, "?"])), asked(spark, [(1, "a")]))) == []


def test_bytes_bound_exact_values():
    """A byte is the least whose step reaches the value, and one byte less does not."""
    x = lexical._exact(np.arange(1, 4000), np.resize(np.array([10, 11, 100, 5000, 10**7]), 3999))
    byte = -(-x // lexical.STEP)
    assert byte.max() <= 255 and (byte * lexical.STEP >= x).all() and ((byte - 1) * lexical.STEP < x)[x > 0].all()


def test_rescoring_is_bounded_by_thresholds(spark, monkeypatch):
    """Documents that cannot be among the best are not scored in exact integers."""
    import pyarrow as pa

    texts = [f"common filler {i % 50} {'gold ' * (i % 7 == 0)}{'silver ' * (i % 11 == 0)}" for i in range(2000)]
    index = lexical.build(indexed(spark, texts))
    block = lexical.Block(["gold silver common"])
    block.weigh(np.array([sum(t in x.split() for x in texts) for t in block.terms.to_pylist()]), index.documents)
    rows = index.segments.toArrow().to_batches()
    shared = type("B", (), {"value": block})
    lower = sorted((r["lower"] for b in rows for out in lexical._bounds(shared, 10)([b]) for r in out.to_pylist()), reverse=True)
    reach = sum(int((lexical.STEP * u >= lower[9]).sum()) for b in rows for i in range(b.num_rows) for *_, u in lexical._sums(block, b, i, np.array([lower[9]])))
    assert 10 <= reach <= 60  # 26 documents hold both words
    exact = lexical._best(shared, index.documents, index.terms, type("L", (), {"value": np.array([float(lower[9])])}), 10, pa.int64())
    best = [r for b in rows for out in exact([b]) for r in out.to_pylist()]
    assert sorted((-r["score"], r["doc_id"]) for r in best)[:10] == [(-s, i) for _, _, i, s in sorted(brute(texts, range(2000), [(0, "gold silver common")]), key=lambda x: x[1])]
