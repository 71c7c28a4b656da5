"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased.  A
document is contaminated by an item of n words if some stretch of its words is
within edit distance ``k = floor((1 - similarity) * n)`` of the item's words.

A CGK random walk reads a word sequence and, at each step, stays or moves on by a
random bit of the step and the word, so that sequences at a small edit distance
walk to embeddings of a small Hamming distance.  Its distortion grows with the
square of the edits, so items of more than ``SEGMENT`` x 1.5 words are cut into
segments of about ``SEGMENT`` words: k edits leave some segment with no more than
its share of them.  Every window of a document is embedded as the segments of a
length class are, and compared with them by keys of ``BITS`` sampled positions.
Walks are repeated until at least ``RECALL`` of simulated segments with the most
edits allowed share a key with their window (``repeats``), at every length.

Only windows that may match are embedded: an edit changes at most two pairs of
neighbouring words, so a window of a segment of n words and e edits holds n - 1 - 2e
pairs of the class's segments, and the text around a candidate n - 1 - 2k of the
item's own.  Candidates are verified exactly: the least edit distance between the
item and any stretch around the place.

The benchmark side is broadcast: its size is measured, and beyond
``BLOCK_BYTES`` of text it is cut into blocks, one pass over the documents each.

Defined cases: items without words match nothing; short items
are matched too, with distance 0 to floor(n / 5); equal items
each report; null and empty documents have no hits; a null item_id is reported
as null; a repeated doc_id reports each row's hits; an empty benchmark gives no
hits and keeps all documents; extra columns are ignored by ``hits`` and kept by
``keep_clean``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnp as tx

#: Words of a segment, positions of a key, and keys of a walk.
SEGMENT, BITS, SAMPLES = 16, 3, 6
#: Share of segments with the most edits that must be found, and walks at most.
RECALL, WALKS = 0.9995, 48
#: Words around candidates that are compared at once.
AROUND = 1 << 21
#: Text of items in one broadcast.
BLOCK_BYTES = 4 << 20
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_PAIR_BITS = 23


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """A hash for every word and its right neighbour."""
    return hashes * np.uint64(0x9E3779B97F4A7C15) + (np.append(hashes[1:], np.uint64(0)) >> np.uint64(7))


def _pair_slots(pairs: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A slot for every pair as one of ``item``."""
    mine = (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((pairs ^ mine) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def _class_slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


class Walks:
    """Repeated walks for segments of ``shortest`` words and more, and the positions of each one's keys."""

    def __init__(self, shortest: int, repeats: int):
        rng = np.random.default_rng(shortest)
        steps = max(1, shortest * 8 // 5)
        draws = [(rng.integers(0, 2**32, steps, dtype=np.uint64).astype(np.uint32) | np.uint32(1), np.sort(np.stack([rng.choice(steps, BITS, replace=steps < BITS) for _ in range(SAMPLES)]), axis=1)) for _ in range(WALKS)]
        self.walks = draws[:repeats]

    def keys(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Keys of the windows from ``start`` that read no word from ``end`` on, a column each walk and sample."""
        word = np.append((hashes >> np.uint64(16)).astype(np.uint32), np.uint32(0))
        out = np.empty((len(start), len(self.walks) * SAMPLES), dtype=np.uint64)
        for walk, (steps, places) in enumerate(self.walks):
            wanted = np.unique(places)
            seen = np.empty((len(wanted), len(start)), dtype=np.uint32)
            at, k = start.copy(), 0
            for j in range(int(wanted[-1]) + 1):
                symbol = word[np.where(at < end, at, len(hashes))]
                if j == wanted[k]:
                    seen[k] = symbol
                    k += 1
                at += (_mix32(symbol * steps[j] + np.uint32(j)) >> np.uint32(31)).astype(np.int64)
            for s in range(SAMPLES):
                key = np.full(len(start), walk * SAMPLES + s + 1, dtype=np.uint64)
                for p in np.searchsorted(wanted, places[s]):
                    key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[p])
                out[:, walk * SAMPLES + s] = key
        return out


def edited(rng: np.random.Generator, words: list[int], edits: int) -> list[int]:
    """``words`` after ``edits`` substitutions, deletions and insertions at random."""
    out = list(words)
    for kind in rng.integers(0, 3, edits).tolist():
        at = int(rng.integers(0, len(out))) if out else 0
        new = [int(rng.integers(0, 2**63))]
        out[at : at + (kind < 2)] = [] if kind == 1 and len(out) > 1 else new
    return out


@lru_cache(maxsize=256)
def repeats(shortest: int, length: int, edits: int, trials: int = 2000) -> int:
    """Walks that find ``RECALL`` of simulated segments of ``length`` words with ``edits`` edits; 1 where none is allowed.

    An error where ``WALKS`` do not: a search that misses more is not made.
    """
    if not edits:
        return 1
    rng = np.random.default_rng([shortest, length, edits])
    items = [rng.integers(0, 2**63, length).tolist() for _ in range(trials)]
    texts = [edited(rng, x, edits) + rng.integers(0, 2**63, length).tolist() for x in items]
    tail = [rng.integers(0, 2**63, length).tolist() for _ in items]
    walks = Walks(shortest, WALKS)

    def keys(rows):
        size = np.array([len(r) for r in rows])
        start = np.cumsum(size) - size
        return walks.keys(np.array([w for r in rows for w in r], dtype=np.uint64), start, start + size)

    same = (keys([x + t for x, t in zip(items, tail)]) == keys(texts)).reshape(trials, WALKS, SAMPLES).any(axis=2)
    share = np.maximum.accumulate(same, axis=1).mean(axis=0)
    if share[-1] < RECALL:
        raise ValueError(f"{WALKS} walks find {share[-1]:.4f} of segments of {length} words with {edits} edits, not {RECALL}: ask for a higher similarity or raise WALKS")
    return int(np.argmax(share >= RECALL)) + 1


def words_of(column: pa.Array) -> tuple[tx.Words, np.ndarray]:
    words = tx.Words(*tx.text_bytes(column), letter=_WORD)
    return words, words.hashes(lower=True)


def _spelt(words: tx.Words, a: int, b: int) -> list[bytes]:
    """The words numbered a to b - 1, A-Z lower-cased."""
    if a == b:
        return []
    base = words.start[a]
    raw = tx.LOWER[words.buf[base : words.end[b - 1]]].tobytes()
    return [raw[x:y] for x, y in zip((words.start[a:b] - base).tolist(), (words.end[a:b] - base).tolist())]


def edit_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between ``item`` and any stretch of ``text``, and where the stretch ends."""
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """Embedded segments of one block of items."""

    def __init__(self, ids: list, texts: list, similarity: float):
        words, hashes = words_of(pa.array(texts, pa.string()))
        self.ids = ids
        self.items = [hashes[a : a + n] for a, n in zip(words.first, words.count)]
        self.words = [_spelt(words, a, a + n) for a, n in zip(words.first.tolist(), words.count.tolist())]
        self.length = words.count.astype(np.int64)
        self.edits = np.floor((1 - similarity) * self.length + 1e-9).astype(np.int64)
        parts = np.where(self.length > 0, np.maximum(1, (self.length + SEGMENT // 2) // SEGMENT), 0)
        item = np.repeat(np.arange(len(self.items)), parts)
        part = tx.ragged(np.zeros(len(parts), dtype=np.int64), parts)
        offset = part * self.length[item] // np.maximum(parts[item], 1)
        size = (part + 1) * self.length[item] // np.maximum(parts[item], 1) - offset
        most = self.edits[item] // np.maximum(parts[item], 1)
        own = _pairs(hashes)
        self.classes = []
        low = 1
        while len(size) and low <= size.max():
            high = max(low + 1, low * 4 // 3)
            mine = np.flatnonzero((size >= low) & (size < high))
            low = high
            if not len(mine):
                continue
            kinds = sorted(set(zip(size[mine].tolist(), most[mine].tolist())))
            shortest = kinds[0][0]
            walks = Walks(shortest, max(repeats(shortest, n, e) for n, e in kinds))
            start = words.first[item[mine]] + offset[mine]
            keys = walks.keys(hashes, start, words.first[item[mine]] + self.length[item[mine]])
            order = np.argsort(keys, axis=0, kind="stable")
            known = np.zeros(1 << _PAIR_BITS, dtype=bool)
            known[_class_slots(own[tx.ragged(start, size[mine] - 1)])] = True
            self.classes.append((kinds, walks, np.take_along_axis(keys, order, axis=0), mine[order], np.packbits(known)))
        self.item, self.offset = item, offset
        pairs = np.zeros(1 << _PAIR_BITS, dtype=bool)
        if len(hashes):
            owner = np.repeat(np.arange(len(self.items)), self.length)
            inner = np.append(owner[1:] == owner[:-1], False)
            pairs[_pair_slots(own[inner], owner[inner])] = True
        self.pairs = np.packbits(pairs)

    def matches(self, words: tx.Words, hashes: np.ndarray):
        """(segment, word) of windows that share a key with a segment, class by class."""
        n = len(hashes)
        last = (words.first + words.count)[words.doc]
        slots = _class_slots(_pairs(hashes))
        member = np.zeros(n + 1, dtype=np.int32)
        for kinds, walks, keys, segment, known in self.classes:
            np.cumsum(np.unpackbits(known).view(bool)[slots], out=member[1:])
            warm = np.zeros(n, dtype=bool)
            for size, edits in kinds:
                warm |= member[np.minimum(np.arange(n) + size + edits, last)] - member[:-1] >= size - 1 - 2 * edits
            start = np.flatnonzero(warm)
            for a in range(0, len(start), 65536):
                s = start[a : a + 65536]
                mine = walks.keys(hashes, s, last[s])
                for c in range(keys.shape[1]):
                    lo, hi = np.searchsorted(keys[:, c], mine[:, c]), np.searchsorted(keys[:, c], mine[:, c], side="right")
                    some = np.flatnonzero(hi > lo)
                    if len(some):
                        size = hi[some] - lo[some]
                        yield segment[tx.ragged(lo[some], size), c], np.repeat(s[some], size)

    def candidates(self, words: tx.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, word) by item and place: a stretch that matches the item starts within its allowed edits of such a word."""
        n = len(hashes)
        first, last = words.first[words.doc], (words.first + words.count)[words.doc]
        pairs, own = _pairs(hashes), np.unpackbits(self.pairs).view(bool)
        code = [np.zeros(0, dtype=np.int64)]
        for segment, at in self.matches(words, hashes):
            code.append(np.unique(self.item[segment] * n + np.maximum(at - self.offset[segment], first[at])))
        code = np.unique(np.concatenate(code))
        work = np.cumsum(self.length[code // n] + 2 * self.edits[code // n])
        keep, a = [np.zeros(0, dtype=bool)], 0
        while a < len(code):  # about AROUND words at once
            b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + AROUND, side="right")))
            it, at = code[a:b] // n, code[a:b] % n
            start = np.maximum(at - self.edits[it], first[at])
            width = np.minimum(at + self.length[it] + self.edits[it], last[at]) - start
            held = own[_pair_slots(pairs[tx.ragged(start, width)], np.repeat(it, width))]
            keep.append(np.add.reduceat(held, np.cumsum(width) - width, dtype=np.int64) >= self.length[it] - 1 - 2 * self.edits[it])
            a = b
        code = code[np.concatenate(keep)]
        return code // n, code % n

    def hits(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, least distance, word number where the stretch ends) of every contaminated row and item."""
        words, hashes = words_of(column)
        if not len(words) or not len(self.items):
            return []
        item, at = self.candidates(words, hashes)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        i = 0
        while i < len(item):
            it, row = int(item[i]), int(words.doc[at[i]])
            n, k = int(self.length[it]), int(self.edits[it])
            j = i
            while j + 1 < len(item) and item[j + 1] == it and words.doc[at[j + 1]] == row and at[j + 1] - at[j] <= n:
                j += 1
            first, last = int(words.first[row]), int(words.first[row] + words.count[row])
            lo, hi = max(first, int(at[i]) - k - 2), min(last, int(at[j]) + n + k + 2)
            text, target = hashes[lo:hi], self.items[it]
            if np.isin(target, text).sum() >= n - k:
                distance, end = edit_stretch(target, text)
                if distance <= k:  # hashes agree: look at the words themselves
                    code, _ = pd.factorize(np.array([*self.words[it], *_spelt(words, lo, hi)], dtype=object))
                    distance, end = edit_stretch(code[:n], code[n:])
                best = out.get((row, it))
                if distance <= k and (best is None or distance < best[0]):
                    out[row, it] = (distance, lo + end - first)
            i = j + 1
        return [(row, it, d, e) for (row, it), (d, e) in sorted(out.items())]


def _blocks(benchmark: DataFrame):
    """Broadcast indexes of the items, each of bounded size."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("text", F.col("item_id").cast("string")), F.lit(blocks)) == b) if blocks > 1 else items
        yield sorted(((r.item_id, r.text) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _indexes(docs: DataFrame, benchmark: DataFrame, similarity: float):
    sc = docs.sparkSession.sparkContext
    for block in _blocks(benchmark):
        yield sc.broadcast(Index([r[0] for r in block], [r[1] for r in block], similarity))


def hits(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, distance, n_words, end_word) of every contaminated document and item."""
    out = None
    for index in _indexes(docs, benchmark, similarity):

        def run(batches, index=index):
            for batch in batches:
                for part in tx.slices(batch, "text"):
                    found = index.value.hits(part.column("text"))
                    if found:
                        row, it, distance, end = (list(x) for x in zip(*found))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(row)), pa.array([index.value.ids[i] for i in it], pa.int64()), pa.array(distance), pa.array([int(index.value.length[i]) for i in it]), pa.array(end)],
                            names=["doc_id", "item_id", "distance", "n_words", "end_word"],
                        )

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance long, n_words long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    for index in _indexes(docs, benchmark, similarity):

        def run(batches, index=index):
            for batch in batches:
                for part in tx.slices(batch, "text"):
                    clean = np.ones(part.num_rows, dtype=bool)
                    clean[[h[0] for h in index.value.hits(part.column("text"))]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
