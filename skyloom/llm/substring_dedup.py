"""Removal of repeated passages with fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a
window that covers it also starts in a document with a smaller doc_id.

1. *Index and probe.*  The blocks of ``BLOCK`` words at positions 0, BLOCK,
   2 x BLOCK ... of every document are the anchors, and every rolling window of
   BLOCK words probes them.  As WINDOW = 2 x BLOCK - 1, a window always holds a
   whole anchor of the document that it stands in, so a repeat cannot miss.  This
   step is a filter: 32-bit keys may give hits too many, never too few.
2. *Extend.*  A hit grows to the left and right word by word: of the windows that
   hold a hit, those with the same words are one class, and runs of windows whose
   class has a smaller doc_id are the maximal repeats.

Documents are dealt into buckets by a hash of doc_id and text, so a bucket has
``BUCKET_BYTES`` of text in expectation however doc_ids, sources or copies are
distributed, and only one very long text can make it larger.  Within a bucket,
windows are classed by comparing their words.  A bucket then sends each class
once, however often it occurs there, with the smallest doc_id that has it, to the
part that its key belongs to: a passage in a third of all documents costs an entry
a bucket.  The answer is one bit a class, in the order of the question: whether
another bucket has it in a document with a smaller doc_id.

Across buckets classes are the same if two independent 64-bit hashes of all their
words are: among 10^13 windows, any two are mistaken with a chance of 10^-13.  The
words themselves stay at home; with them, all contexts of a frequent line would
meet in one group.

Bucket and part counts follow the text's bytes, not the number of executors, and
nothing but that sum reaches the driver.

Defined cases: null or empty text has no words, removes nothing and keeps the
empty text; rows that repeat a doc_id are one document for "smaller" and each
judged alone; a null doc_id is smaller than all others; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnp as tx

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: Bytes of text in a bucket and in a part of the keys, in expectation.
BUCKET_BYTES, PART_BYTES = 4 << 20, 16 << 20
_NULL, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _read(table: pa.Table):
    """The bucket, its words, their hashes and doc_ids; its rows in an order that does not depend on how they came."""
    tx.release()  # the arrays of the bucket before
    table = table.combine_chunks()
    doc = np.asarray(table.column("doc_id").fill_null(int(_NULL)), dtype=np.int64)
    order = np.argsort(doc, kind="stable")
    if (doc[order][1:] == doc[order][:-1]).any():  # rows of one doc_id by their text
        words = tx.Words(*tx.text_bytes(table.column("text")))
        order = np.lexsort((tx.row_hashes(words, words.hashes(), 1), doc))
    table, doc = table.take(pa.array(order)).combine_chunks(), doc[order]
    words = tx.Words(*tx.text_bytes(table.column("text")))
    return table, words, words.hashes(), doc


def _keys(words: tx.Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of documents long enough for a repeat, and their first words."""
    key, at = tx.windows(words, hashes, k)
    long = words.count[words.doc[at]] >= WINDOW
    return key[long], at[long]


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _blocks(words: tx.Words, hashes: np.ndarray, parts: int):
    """Block keys of a bucket in the order of its questions: 32 bits within a part."""
    key, at = _keys(words, hashes, BLOCK)
    part = _part(key, parts)
    key = (part.astype(np.uint64) << np.uint64(33)) | (key & np.uint64(0xFFFFFFFF))  # part first, so order is by part
    distinct, place = np.unique(key, return_inverse=True)
    return distinct, np.searchsorted((distinct >> np.uint64(33)).astype(np.int64), np.arange(parts + 1)), place, at


def _table(bucket: int, rows: list[tuple]) -> pa.Table:
    part, *data = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"part": pa.array(part, pa.int32()), "bucket": pa.array([bucket] * len(part), pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip(("keys", "more", "docs"), data)}})


_ASK = "part int, bucket int, keys binary, more binary, docs binary"
_ANSWER = "bucket int, part int, bits binary"


def _probe(parts: int):
    """Ask whether the block keys of a bucket are live; flag 1: an anchor here, flag 2: also in another document here."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, words, hashes, doc = _read(table)
        distinct, bounds, place, at = _blocks(words, hashes, parts)
        anchor = words.pos[at] % BLOCK == 0
        of = doc[words.doc[at]]
        here = np.zeros(len(distinct), dtype=bool)
        here[place[anchor]] = True
        least, most = np.full(len(distinct), _MOST), np.full(len(distinct), _NULL)
        np.minimum.at(least, place, of)
        np.maximum.at(most, place, of)
        flags = here.astype(np.uint8) | ((here & (least < most)).astype(np.uint8) << 1)
        low = (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return _table(key[0].as_py(), [(p, low[a:b].tobytes(), flags[a:b].tobytes(), b"") for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a])

    return run


def _answers(decide):
    """Answer the questions of a part: ``decide`` gives the bits of each of its rows (bucket, keys, more, docs)."""

    def of_part(part: int, rows: list[tuple]) -> pa.RecordBatch:
        bits = decide(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], names=["bucket", "part", "bits"])

    def run(batches):
        part, rows = None, []
        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "bucket", "keys", "more", "docs"))):
                if p != part and rows:
                    yield of_part(part, rows)
                    rows = []
                part = p
                rows.append(row)
        if rows:
            yield of_part(part, rows)

    return run


def _cut(flat: np.ndarray, size: list[int]) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(size)[:-1])


def _live(rows: list[tuple]) -> list[np.ndarray]:
    """Live keys: an anchor somewhere, and another bucket or another document of the same bucket that has the key."""
    keys = [np.frombuffer(r[1], np.uint32) for r in rows]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    flags = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    anchor, inner = np.zeros(len(distinct), dtype=bool), np.zeros(len(distinct), dtype=bool)
    anchor[place[flags & 1 == 1]] = True
    inner[place[flags & 2 == 2]] = True
    live = inner | (anchor & (np.bincount(place, minlength=len(distinct)) > 1))  # a bucket names a key once
    return _cut(live[place], [len(k) for k in keys])


def _smaller(rows: list[tuple]) -> list[np.ndarray]:
    """Classes that another bucket has in a document with a smaller doc_id."""
    keys, other = (np.frombuffer(b"".join(r[i] for r in rows), np.uint64) for i in (1, 2))
    size = [len(r[1]) // 8 for r in rows]
    docs = np.concatenate([_unpack_docs(r[3], n) for r, n in zip(rows, size)])
    order = np.argsort(keys, kind="stable")
    near = keys[order][1:] == keys[order][:-1]
    if (near & (other[order][1:] != other[order][:-1])).any():
        order = np.lexsort((other, keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (other[order][1:] != other[order][:-1])
    least = np.minimum.reduceat(docs[order], np.flatnonzero(new))
    out = np.empty(len(order), dtype=bool)
    out[order] = least[np.cumsum(new) - 1] < docs[order]
    return _cut(out, size)


def _pack_docs(docs: np.ndarray) -> bytes:
    """Ascending doc_ids as distinct ones and their numbers."""
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    return docs[first].tobytes() + np.diff(np.append(first, len(docs))).astype(np.uint32).tobytes()


def _unpack_docs(data: bytes, n: int) -> np.ndarray:
    k = len(data) // 12
    docs = np.repeat(np.frombuffer(data, np.int64, k), np.frombuffer(data, np.uint32, k, 8 * k))
    if len(docs) != n:
        raise ValueError("doc_ids do not match the keys")
    return docs


def _bits(answer: pa.Table, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(int(bounds[-1]), dtype=bool)
    for part, bits in zip(answer.column("part").to_pylist(), answer.column("bits").to_pylist()):
        a, b = bounds[part], bounds[part + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return out


def _candidates(words: tx.Words, hashes: np.ndarray, answer: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the bucket that hold a live block: their hashes and first words."""
    _, bounds, place, at = _blocks(words, hashes, parts)
    live = np.zeros(len(words) + 1, dtype=np.int64)
    if len(at):
        live[at + 1] = _bits(answer, bounds)[place]
    live = np.cumsum(live)
    key, first = _keys(words, hashes, WINDOW)
    holds = live[first + BLOCK] > live[first]
    return key[holds], first[holds]


def _classes(code: np.ndarray, key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each window, the same for windows of the same words only, and the first window of each number.

    Windows are brought side by side by their hash and compared word by word.
    """

    def compared(order: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Which of ``some`` places in ``order`` have the words of the place before."""
        a, b = first[order[some]], first[order[some - 1]]
        same = np.ones(len(a), dtype=bool)
        for j in range(WINDOW):
            same &= code[a + j] == code[b + j]
        return same

    order = np.argsort(key, kind="stable")
    some = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    if not compared(order, some).all():  # two windows have one hash
        order = np.lexsort([code[first + j] for j in range(WINDOW)])
        some = np.arange(1, len(order))
        some = some[compared(order, some)]
    same = np.zeros(len(order) - 1, dtype=bool)
    same[some - 1] = True
    new = np.append(True, ~same)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _asked(words: tx.Words, hashes: np.ndarray, doc: np.ndarray, key: np.ndarray, first: np.ndarray, parts: int):
    """Classes of the candidates, the smallest doc_id of each, and the order of their questions with each part's bounds."""
    number, one = _classes(tx.word_codes(words, hashes), key, first)
    least = doc[words.doc[first[one]]]  # rows ascend with doc_id, and the first window of a class stands first
    part = _part(key[one], parts)
    order = np.lexsort((key[one], least, part))
    return number, one, least, order, np.searchsorted(part[order], np.arange(parts + 1))


def _extend(parts: int):
    """Ask for the classes of windows around hits."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(0, [])
        _, words, hashes, doc = _read(table)
        keys, first = _candidates(words, hashes, answer, parts)
        if not len(first):
            return _table(0, [])
        _, one, least, order, bounds = _asked(words, hashes, doc, keys, first, parts)
        one = one[order]
        keys, other, docs = keys[one], tx.window_at(words.hashes(seed=1), first[one], WINDOW), least[order]
        return _table(key[0].as_py(), [(p, keys[a:b].tobytes(), other[a:b].tobytes(), _pack_docs(docs[a:b])) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a])

    return run


def _remove(parts: int):
    """Drop covered words; ``answer`` holds the live bits (stage 0) and the classes' bits (stage 1)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answer: pa.Table) -> pa.Table:
        stage = answer.column("stage").to_numpy()
        table, words, hashes, doc = _read(table)
        keys, first = _candidates(words, hashes, answer.filter(pa.array(stage == 0)), parts)
        covered = np.zeros(len(words), dtype=bool)
        if len(first):
            number, _, least, order, bounds = _asked(words, hashes, doc, keys, first, parts)
            elsewhere = np.empty(len(order), dtype=bool)
            elsewhere[order] = _bits(answer.filter(pa.array(stage == 1)), bounds)
            start = first[elsewhere[number] | (least[number] < doc[words.doc[first]])]
            step = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(step, start, 1)
            np.add.at(step, start + WINDOW, -1)
            covered = np.cumsum(step)[:-1] > 0
        keep = ~covered
        kept = tx.gather_text(words.buf, words.start[keep], (words.end - words.start)[keep], words.doc[keep], words.rows)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(words.count.astype(np.int64)),
                "n_removed": pa.array(np.bincount(words.doc[covered], minlength=words.rows).astype(np.int64)),
                "kept_text": kept.cast(pa.string()),
            }
        )

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = max(1, size // BUCKET_BYTES + 1), max(16, size // PART_BYTES + 1)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.repartition(max(partitions, buckets // 2), "bucket")  # tasks stay small however few partitions the session has
    asked = texts.groupBy("bucket").applyInArrow(_probe(parts), _ASK)

    def told(questions, decide):
        return questions.repartition(max(partitions, parts // 2), "part").sortWithinPartitions("part").mapInArrow(_answers(decide), _ANSWER)

    live = told(asked, _live)
    windows = texts.groupBy("bucket").cogroup(live.groupBy("bucket")).applyInArrow(_extend(parts), _ASK)
    smaller = told(windows, _smaller)
    answers = live.withColumn("stage", F.lit(0)).unionByName(smaller.withColumn("stage", F.lit(1)))
    return texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_remove(parts), "doc_id long, n_words long, n_removed long, kept_text string")
