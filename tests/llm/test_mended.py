"""Cases that hashes alone get wrong, hot groups, and bounds."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.llm import bpe, decontaminate, exact_dedup, language, minhash, pii, substring_dedup, textnp, token_files, toxicity

DOCS = "doc_id long, text string, lang string"


def docs_of(spark, texts, ids=None, lang="en", parts=2):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, lang) for i, t in zip(ids, texts)], DOCS).repartition(parts)


def thue_morse(n):
    """A word of ``n`` letters and its complement, which a polynomial modulo 2^64 cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [thue_morse(n) for n in (8, 64, 65, 512, 1024, 4096, 8192)]


@pytest.mark.parametrize("seed", [0, 1])
def test_hashes_tell_words_apart(seed):
    texts = [w for p in PAIRS for w in p] + ["an", "bo", "An", "é", "a" * 63, "a" * 64, "a" * 65, "a" * 8, "a" * 9, "x" * 7 + "a", "x" * 7 + "b"]
    words = textnp.Words(*textnp.text_bytes(pa.array(texts)))
    assert len(set(words.hashes(seed=seed).tolist())) == len(texts)
    assert not set(words.hashes(seed=0).tolist()) & set(words.hashes(seed=1).tolist())
    low = words.hashes(lower=True, seed=seed)
    assert low[texts.index("An")] == low[texts.index("an")] and len(set(low.tolist())) == len(texts) - 1
    again = textnp.Words(*textnp.text_bytes(pa.array(["zz " + " ".join(reversed(texts))])))
    assert again.hashes(seed=seed)[1:][::-1].tolist() == words.hashes(seed=seed).tolist()


def test_same_runs_compares_bytes():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 8, 9, 64, 70, 200]))) for _ in range(400)] + [w for p in PAIRS for w in p] * 2
    words = textnp.Words(*textnp.text_bytes(pa.array(texts)))
    for hashes in (words.hashes(), np.zeros(len(words), np.uint64), words.hashes() & np.uint64(7)):
        code = textnp.same_runs(words.buf, words.start, words.end, hashes)
        seen = {}
        assert all(seen.setdefault(t, c) == c for t, c in zip(texts, code.tolist())) and len(set(code.tolist())) == len(set(texts))


def test_row_digests():
    texts = ["a  b", "A b", "ab", "", None, " \n", *PAIRS[4]]
    got = [bytes(r) for r in textnp.row_digests(textnp.Words(*textnp.text_bytes(pa.array(texts))))]
    assert got[0] == got[1] == hashlib.blake2b(b"a b", digest_size=16).digest()
    assert got[3] == got[4] == got[5] == bytes(16) and len(set(got)) == 5


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_token_files_beside_special_tokens(spark, parts):
    """Whatever a worker has met before, ids are the library's: words that differ by one in every byte, special tokens, long words."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    special = token_files._special(path)[0].decode()
    texts = [f"an by c {special}", "bo cz d", "an by c", f"bo cz d {special}", "AN By", *(w for p in PAIRS for w in p)] * 3
    whole = token_files._tokenizer(path)
    want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for order in (1, -1):
        got = [token_files.encode_column(path, pa.array([t]), 2)[0].tolist() for t in texts[::order]]
        assert got == want[::order]
    rows = {r.doc_id: r for r in token_files.through_files(docs_of(spark, texts, parts=parts), path).collect()}
    import zlib

    assert [rows[i].ids_crc32 for i in range(len(texts))] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]


def test_token_files_split_equal_ids(spark):
    """A doc_id that repeats is not one range, and no draft stays behind."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"text {i}" for i in range(400)]
    df = docs_of(spark, texts, [7] * 300 + [None] * 100)
    folder = f"{token_files.shared_folder(spark)}/split"
    token_files.write_files(df, path, folder)
    parts = spark.read.parquet(f"{folder}/files").select("part").distinct().count()
    assert parts > 2
    index = token_files.read_index(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in index] == [None] * 100 + [7] * 300
    assert all(a.start + a.n_tokens == b.start for a, b in zip(index, index[1:]))
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(f"{folder}/drafts")


def test_bpe_tells_long_words_apart():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [w for p in PAIRS for w in p] + [" ".join(PAIRS[3])]
    ids, count = bpe.encode_column(bpe.automaton(path), pa.array(texts))
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_word_operators_tell_long_words_apart(spark):
    a, b = PAIRS[5]
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, [a, b, a])).collect()}
    assert near == {0: 0, 1: 1, 2: 0}
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join([*words, a]), " ".join([*words, b]), " ".join([*words, a])]
    gone = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert gone == {0: 0, 1: 0, 2: 13}
    bench = spark.createDataFrame([(1, f"{a} one two"), (2, b)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.hits(docs_of(spark, [f"x {a} one two", f"x {b} one two"]), bench).collect()}
    assert found == {(0, 1, 0), (1, 2, 0)}


@pytest.mark.parametrize("hashed", ["xxhash64", "constant"])
def test_exact_dedup_of_a_hot_text_with_any_hash(spark, monkeypatch, hashed):
    if hashed == "constant":
        monkeypatch.setattr(exact_dedup, "_hash", lambda text: F.length(text).cast("long") * 0)
    texts = ["hot  text"] * 200 + [f"other {i % 90}" for i in range(300)] + [None, "", " "]
    ids = [None] * 50 + list(range(50, len(texts)))
    df = docs_of(spark, texts, ids, parts=3)
    norm = [" ".join(t.split(" ")) if t and t.strip() else (" " if t else "") for t in ["hot text" if t == "hot  text" else t for t in texts]]
    groups = defaultdict(list)
    for i, t in zip(ids, norm):
        groups[t].append(i)
    least = {t: min((x for x in g if x is not None), default=None) for t, g in groups.items()}
    got = sorted(map(tuple, exact_dedup.exact_groups(df).collect()), key=repr)
    want = sorted(((i, least[t], len(groups[t]), least[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(ids, norm)), key=repr)
    assert got == want
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(least.values())


def test_exact_dedup_of_repeated_hot_rows(spark):
    """Of a hot text whose rows all have one doc_id, or none, one row stays."""
    for one in (None, 4):
        df = docs_of(spark, ["same"] * 300 + ["b", "c"], [one] * 300 + [1, 2])
        assert exact_dedup.deduplicate(df).filter("text = 'same'").count() == 1
        got = exact_dedup.exact_groups(df).filter("group_size = 300")
        assert got.count() == 300 and {r.keep_id for r in got.collect()} == {one}


def test_language_of_few_long_texts_is_learnt(spark):
    rows = [(i, "the of and to in that " * 40, "en") for i in range(50)] + [(100 + i, "zyx wvu qqq jjj xxx " * 4000, "zz") for i in range(3)]
    df = spark.createDataFrame(rows, DOCS)
    trees = language.learn(df, sample=10, sample_bytes=1000)
    assert sorted(trees.langs) == ["en", "zz"]
    assert language.predict(df, trees).filter("doc_id >= 100 and lang_pred = 'zz'").count() == 3


def test_search_that_cannot_reach_its_recall_is_an_error():
    with pytest.raises(ValueError, match="walks find"):
        decontaminate.repeats(18, 20, 15)


def test_overlaps_by_search():
    rng = random.Random(5)
    for _ in range(300):
        spans = [("ip", a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(0, 9)))]
        reach = pii._Reach(spans)
        for _ in range(20):
            a = rng.randrange(60)
            b = a + rng.randrange(1, 9)
            assert reach.meets(a, b) == any(a < y and x < b for _, x, y in spans)


def test_toxicity_learns_from_one_text_of_a_doc_id(spark):
    rows = [(i, f"awful vile hate {i}" if i % 2 else f"kind calm words {i}", "en") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    once, many = (spark.createDataFrame(r, DOCS) for r in (rows, rows + rows[:7] * 5))
    a, b = (toxicity.score(docs_of(spark, ["awful vile hate"]), toxicity.learn(d, labels)).first().score for d in (once, many))
    assert a == pytest.approx(b)
