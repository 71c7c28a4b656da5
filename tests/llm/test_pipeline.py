"""The pipeline on a small corpus: every stage's decisions take effect and clean documents stay."""

import random
import re

import pytest


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = {i: text(rng.randrange(40, 120)) for i in range(200)}
    labels = []
    for i in range(0, 200, 4):
        docs[i] += " idiot moron scum"
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    docs[300] = docs[1].replace(" ", "\n ")  # exact copy
    words = docs[3].split()
    words[2] = "changed"
    docs[301] = " ".join(words)  # near copy
    item = text(30)
    docs[302] = text(40) + " " + item + " " + text(40)
    docs[303], docs[304] = None, ""
    out = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    want = {i for i in range(200) if i % 4} | {303}
    assert set(got) == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.decoded == (texts[i] or "") and len(r.ids) == r.n_tokens for i, r in got.items())
    assert not re.search("idiot", " ".join(r.decoded for r in got.values()))


def test_stages_keep_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, node string, row long, key string, bucket int, part int, label int, score double, toxic int, kept boolean"


def clashing(spark, texts):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(1000 + i, t, "en", "s", None, "n", 1, "k", 1, 2, 3, 0.5, 1, True) for i, t in enumerate(texts)], CLASHING)


def test_stages_on_empty_tables_and_clashing_columns(spark, sf_dir):
    import corpus_pipeline

    docs = clashing(spark, [None, "", "one two three four five six seven", "one two three four five six  seven", "ONE two three four five six seven eight"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.columns == docs.columns and empty.count() == 0, name
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.count() >= 2, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.limit(0), sf_dir).count() == 0 and last(spark, docs, sf_dir).count() == 5
