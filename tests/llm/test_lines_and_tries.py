"""Line deduplication and the conversation trie against brute force, and their edge cases."""

import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import pytest

from skyloom.llm import line_dedup, prefix_trie

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- 13 lines

DOCS = "doc_id long, text string, pos int, line string, key string, heavy boolean, n_docs long"


def lined(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, 1, "x", "k", True, 2) for i, t in zip(ids, texts)], DOCS).repartition(3)


def brute_lines(texts, min_docs, min_chars):
    key = lambda line: line.strip(WHITE).translate(LOW)
    count = defaultdict(int)
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] += 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and count[key(x)] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_corpus(seed):
    rng = random.Random(seed)
    common = ["Share this", " share THIS\t", "ÉCOLE", "école", "\r", "", "   ", "a", "日本", "x\x85", "Cookie policy \x0b"]
    texts = [None, "", "\n", "\n\n a \n", "Share this", "a\r\nb\r\n"]
    for _ in range(60):
        texts.append("\n".join(rng.choice(common) if rng.random() < 0.5 else f"own line {rng.random()}" for _ in range(rng.randrange(1, 9))))
    texts.append("\n".join(f"line {i}" if i % 3 else "Share this" for i in range(30_000)))
    return texts + texts[10:16]


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 0), (3, 5), (1000, 1)])
def test_lines(spark, min_docs, min_chars):
    texts = line_corpus(min_docs)
    got = {r.doc_id: r for r in line_dedup.drop_lines(lined(spark, texts), min_docs=min_docs, min_chars=min_chars).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute_lines(texts, min_docs, min_chars)):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == want


def test_lines_of_a_third_of_all_documents(spark, monkeypatch):
    """Most lines of frequent keys come through the join of the keys that are not broadcast, and the other way round."""
    texts = [f"hot\nwarm {i % 40}\nown {i}" for i in range(600)] + [f"cold {i}" for i in range(600)]
    want = brute_lines(texts, 10, 1)
    for share in (1, 10**6):
        monkeypatch.setattr(line_dedup, "HEAVY", share)
        got = {r.doc_id: r for r in line_dedup.drop_lines(lined(spark, texts)).collect()}
        assert [(got[i].n_lines, got[i].n_dropped, got[i].kept_text) for i in range(len(texts))] == want


def test_lines_of_repeated_and_null_ids(spark):
    texts = ["same\nline 1", "same\nline 2", "same\nline 2", None, "same"] + ["same"] * 8
    ids = [None, None, 7, 7, 7] + list(range(100, 108))
    df = lined(spark, texts, ids)
    left = line_dedup.without_repeats(df, min_docs=9)
    assert left.columns == df.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect()))[-2:] == [(True, 0, "line 1"), (True, 0, "line 2")]
    assert sorted(r.text for r in left.filter("doc_id = 7").collect()) == ["", "", "line 2"]
    assert line_dedup.drop_lines(df.filter("false")).count() == 0


def test_line_plan_is_native(spark):
    plan = line_dedup.drop_lines(lined(spark, ["a\nb"] * 3))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("Scan")[0])


# ---------------------------------------------------------------- 11 trie

TURNS = "conv_id long, turn long, role string, text string, base long, k1 long, depth long, n_convs long"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], TURNS).repartition(3)


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rem = lambda c: abs(c) % 5 * (1 if c >= 0 else -1)
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - rem(c), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    below = defaultdict(list)
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    kids = {k: sum(len(x) == len(k) + 1 for x in below[k]) for k in members}
    out = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[k] if x)
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], sum(kids[x] == 0 for x in below[k]), saved, sha(ends)))
    return sorted(out, key=repr)


def talk_corpus(seed, n=120):
    rng = random.Random(seed)
    lines = ["hello", "HELLO", "", "é", "yes", None, "a,b"]
    rows = []
    for c in [*range(n), *range(-7, 0), 10**15 + 3]:
        if c == 15:
            continue  # a base that is absent
        for turn in range(rng.choice([0, 1, 3, 8, 9, 12])):
            rows.append((c, turn if rng.random() < 0.97 else None, rng.choice(["user", "assistant", None]), rng.choice(lines)))
    rows += [(None, 0, "user", "lost"), (40, 3, "user", "again"), (40, 3, "user", "again")]
    rows += [(1000 + c, t, "user", "hot") for c in range(200) for t in range(3)]  # many conversations of one text
    rows += [(5000, t, "user", f"turn {t % 7}") for t in range(1500)]  # a long one
    return rows


@pytest.mark.parametrize("held,piece", [(100_000, 1 << 16), (3, 8)])
def test_trie(spark, monkeypatch, held, piece):
    rows = talk_corpus(held)
    monkeypatch.setattr(prefix_trie, "HELD", held)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "HEAVY", 1 if held == 3 else 8)
    got = prefix_trie.prefix_trie(talks(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_trie_parts_and_pieces():
    """Families handed on in parts have the same members; ids travel in pieces that end at ``PIECE`` bytes."""
    import pyarrow as pa

    turns = pa.RecordBatch.from_pydict({"base": [0] * 6, "conv": [0, 0, 0, 3, 3, 3], "role": ["u"] * 6, "text": list("abcabc")})
    whole = [r for b in prefix_trie._walk([turns]) for r in b.to_pylist()]
    split = [r for b in prefix_trie._walk([turns.slice(0, 4), turns.slice(4)]) for r in b.to_pylist()]
    assert whole == split and sum(len(r["convs"]) for r in whole) == 8 and sum(len(r["ends"]) for r in whole) == 2
    ids = pa.RecordBatch.from_pydict({"k1": [1] * 30_000, "k2": [2] * 30_000, "conv": list(range(30_000))})
    pieces = [r for b in prefix_trie._pieces([ids]) for r in b.to_pylist()]
    assert max(len(p["ids"]) for p in pieces) <= prefix_trie.PIECE + 20 and len(pieces) == 3
    joined = pa.RecordBatch.from_pydict({k: [p[k] for p in pieces] for k in ("k1", "k2", "ids")})
    assert [r["ends_sha256"] for b in prefix_trie._hashed([joined]) for r in b.to_pylist()] == [sha(",".join(map(str, range(30_000))))]


def test_trie_of_empty_tables(spark):
    assert prefix_trie.prefix_trie(talks(spark, []).limit(0)).count() == 0
    assert prefix_trie.prefix_trie(talks(spark, [(None, 1, "user", "x")])).count() == 0
    only = prefix_trie.prefix_trie(talks(spark, [(7, 0, None, None)])).collect()  # h of 7 is above 1 and its base is absent
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in only] == [(7, 0, None, 1, 0, 1, 0)]
    assert only[0].ends_sha256 == sha("7")
