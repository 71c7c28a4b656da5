"""Ranked lexical search over a two-level quantised index.

Building.  Texts are tokenised in slices; each slice of documents becomes one row of
the index, a segment: its documents (ids and lengths), its distinct terms, and for
each term its postings (document and occurrences).  Sums over the segments give N
and L; a second pass adds the quantised levels.  The part of a score that depends
on a posting, x = (10^9 tf) div (1000 tf + 8 m), is below 10^6; its byte is x / STEP
rounded up.  Level one holds the largest byte of each term of a segment, level two a
byte a posting; the exact numbers stand beside them.  Nothing is shuffled, so neither
a frequent term nor a long document gathers anywhere.

Searching.  Items are taken in blocks of about ``BLOCK_BYTES``, each broadcast.

1. Document frequencies of the block's terms are summed over the segments.
2. Every segment adds up weight x byte for its documents.  STEP x that sum is an upper
   bound of the score, and STEP x (sum - matched weights) a lower one.  A task
   keeps the k largest lower bounds of each item, and the k-th over all tasks
   is the item's threshold.  Segments whose level-one bound is below what the task
   has already found are passed over.
3. Every document whose upper bound reaches the threshold is scored again in exact
   integers; a task hands on the k best of each item, and the best of all tasks
   are ranked.  Segments whose level-one bound is below the threshold are passed over.

No document is left out for its number of candidates: where many documents tie at
the threshold, all of them are scored, and only the k best of a task travel.

Memory follows a segment (``SEGMENT_BYTES`` of text, one document at least) and a
block.  Each block passes over the index twice, of which it reads the columns that it
needs.

Defined cases: null and empty texts have no terms and are neither counted in N nor
found; items without terms, or of which no term stands in a document, give no row;
ties are ordered by doc_id, null last; rows that repeat a doc_id are documents of
their own and may both be ranked; items that repeat item_id and text are one item,
and an item_id with several texts is ranked for each; empty tables give no row; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skyloom.llm import textnp as tx
from skyloom.llm.shared import written

K = 10
#: Width of a quantised step: bytes 0..255 cover what is below 10^6.
STEP = 3922
#: Text and documents of a segment.
SEGMENT_BYTES = 1 << 20
SEGMENT_ROWS = 4096
#: Text of a block of items.
BLOCK_BYTES = 4 << 20
#: Pairs of posting and item that are added up at once.
PAIRS = 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x30:0x3A] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True

_RAW = "lengths array<long>, terms array<string>, starts array<int>, places binary, times array<int>, full long, total long"
_LEVELS = "impacts binary, tops binary"


def _tokens(column: pa.Array) -> tuple[tx.Words, np.ndarray]:
    """Terms of a string column and a number for each, equal for equal terms."""
    buf, offs = tx.text_bytes(column)
    words = tx.Words(tx.LOWER[buf], offs, letter=_LETTER)
    return words, tx.word_codes(words, words.hashes())


def _texts(words: tx.Words, at: np.ndarray) -> pa.Array:
    """The words numbered ``at`` as strings."""
    size = words.end[at] - words.start[at]
    body = words.buf[tx.ragged(words.start[at], size)]
    offs = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(body)))


def _list(values: np.ndarray | pa.Array) -> pa.Array:
    """One row that is the list of all values."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "text", SEGMENT_BYTES, SEGMENT_ROWS):
            words, code = _tokens(part.column("text"))
            rows = words.rows
            key, times = np.unique(code.astype(np.int64) * rows + words.doc, return_counts=True)
            first = tx.first_of(code)
            starts = np.searchsorted(key, np.arange(len(first) + 1) * rows).astype(np.int32)
            places = (key % rows).astype("<u2")
            values = [part.column("doc_id"), words.count.astype(np.int64), _texts(words, first), starts]
            yield pa.RecordBatch.from_arrays(
                [*map(_list, values), pa.array([places.tobytes()], pa.binary()), _list(times.astype(np.int32)), pa.array([int((words.count > 0).sum())]), pa.array([len(words)])],
                names=["doc_ids", "lengths", "terms", "starts", "places", "times", "full", "total"],
            )


def _mass(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents: 10 + (90 length N) div L."""
    most = int(lengths.max()) if len(lengths) else 0
    if 90 * most * n < 1 << 63:
        return 10 + (90 * lengths * n) // max(total, 1)
    return np.array([10 + 90 * int(x) * n // total for x in lengths], dtype=np.int64)


def _exact(times: np.ndarray, mass: np.ndarray) -> np.ndarray:
    times = times.astype(np.int64)
    return (1_000_000_000 * times) // (1000 * times + 8 * mass)


def _values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _bytes(batch: pa.RecordBatch, name: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)


def _quantised(n: int, total: int):
    """Segments with their two levels of bytes."""

    def run(batches):
        for batch in batches:
            impacts, tops = [], []
            for i in range(batch.num_rows):
                starts, places = _values(batch, "starts", i), _bytes(batch, "places", i, "<u2")
                x = _exact(_values(batch, "times", i), _mass(_values(batch, "lengths", i), n, total)[places])
                byte = (-(-x // STEP)).astype(np.uint8)
                impacts.append(byte.tobytes())
                tops.append((np.maximum.reduceat(byte, starts[:-1]) if len(byte) else byte).tobytes())
            columns = [*batch.columns, pa.array(impacts, pa.binary()), pa.array(tops, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "impacts", "tops"])

    return run


@dataclass
class Index:
    """A written index: its segments, N and L."""

    segments: DataFrame
    documents: int
    terms: int
    id_type: str


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Index:
    """Index every row of ``docs``."""
    kind = docs.select(doc_id).dtypes[0][1]
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    raw = written(own.mapInArrow(_segments, f"doc_ids array<{kind}>, {_RAW}"))
    sums = raw.agg(F.sum("full"), F.sum("total")).first()
    n, total = (int(x or 0) for x in sums)
    return Index(written(raw.mapInArrow(_quantised(n, total), f"doc_ids array<{kind}>, {_RAW}, {_LEVELS}")), n, total, kind)


class Block:
    """Items of one block: their distinct terms, and weights once they are known."""

    def __init__(self, texts: list[str | None]):
        words, code = _tokens(pa.array(texts, pa.large_string()))
        first = tx.first_of(code)
        count = len(first)
        key = np.unique(words.doc * count + code)
        self.terms = _texts(words, first)
        self.item, self.term = (key // max(count, 1)).astype(np.int64), (key % max(count, 1)).astype(np.int64)  # ascending by item
        self.items = len(texts)
        self.weight = np.zeros(count, dtype=np.int64)

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)

    def found(self, terms: pa.Array) -> np.ndarray:
        """For each term of the block its place among ``terms``, -1 where it is not there."""
        return np.asarray(pc.fill_null(pc.index_in(self.terms, value_set=terms), -1), dtype=np.int64)


def _frequencies(block):
    """Documents of a task that hold each of the block's terms."""

    def run(batches):
        df = np.zeros(len(block.value.terms), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at = block.value.found(batch.column("terms")[i].values)
                there, starts = np.flatnonzero(at >= 0), _values(batch, "starts", i)
                df[there] += starts[at[there] + 1] - starts[at[there]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    return run


def _sums(block: Block, batch: pa.RecordBatch, i: int, least: np.ndarray) -> Iterator[tuple]:
    """For groups of items of which a segment may hold a document with an upper bound of ``least`` or more.

    Gives the items, each pair's place in their items x documents, its posting, weight and term's sums: sum of weight x byte and of weights.
    """
    rows = len(batch.column("doc_ids")[i])
    at = block.found(batch.column("terms")[i].values)[block.term]
    some = np.flatnonzero(at >= 0)
    if not len(some):
        return
    at, item, weight = at[some], block.item[some], block.weight[block.term[some]]
    tops = _bytes(batch, "tops", i, "u1")
    most = np.bincount(item, weights=weight * tops[at].astype(np.int64), minlength=block.items) * STEP
    on = (most >= least)[item] & (most > 0)[item]
    at, item, weight = at[on], item[on], weight[on]
    starts, places, impacts = _values(batch, "starts", i).astype(np.int64), _bytes(batch, "places", i, "<u2"), _bytes(batch, "impacts", i, "u1")
    size = starts[at + 1] - starts[at]
    ends = np.cumsum(size)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
        b = int(np.searchsorted(item, item[b - 1], side="right"))  # whole items
        posting = tx.ragged(starts[at[a:b]], size[a:b])
        items, local = np.unique(item[a:b], return_inverse=True)
        place = np.repeat(local * rows, size[a:b]) + places[posting]
        w = np.repeat(weight[a:b], size[a:b])
        upper = np.bincount(place, weights=w * impacts[posting], minlength=len(items) * rows).reshape(len(items), rows)
        yield items, place, posting, w, upper
        a = b


def _bounds(block, k: int):
    """The k largest lower bounds of each item in a task."""

    def run(batches):
        own = block.value
        best = np.zeros((own.items, k))
        for batch in batches:
            for i in range(batch.num_rows):
                for items, place, _, w, upper in _sums(own, batch, i, best[:, 0] + 1):
                    matched = np.bincount(place, weights=w, minlength=upper.size).reshape(upper.shape)
                    lower = STEP * (upper - matched) + matched * (upper > 0)
                    both = np.concatenate((best[items], lower), axis=1)
                    best[items] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    best[items] = np.sort(best[items], axis=1)
        item, _ = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[best > 0].astype(np.int64))], names=["item", "lower"])

    return run


def _best(block, n: int, total: int, least, k: int, kind: pa.DataType):
    """Exact scores of the documents whose upper bound reaches ``least``: the k best of each item in a task."""

    def run(batches):
        own, best = block.value, {}
        for batch in batches:
            for i in range(batch.num_rows):
                rows, times, mass, ids = len(batch.column("doc_ids")[i]), None, None, batch.column("doc_ids")[i].values
                places = _bytes(batch, "places", i, "<u2")
                for items, place, posting, w, upper in _sums(own, batch, i, least.value):
                    reach = ((STEP * upper >= least.value[items][:, None]) & (upper > 0)).ravel()
                    if not reach.any():
                        continue
                    if times is None:
                        times, mass = _values(batch, "times", i), _mass(_values(batch, "lengths", i), n, total)
                    on = np.flatnonzero(reach[place])
                    score = np.zeros(upper.size, dtype=np.int64)
                    np.add.at(score, place[on], w[on] * _exact(times[posting[on]], mass[places[posting[on]]]))
                    for j in np.flatnonzero((score > 0).reshape(upper.shape).any(axis=1)).tolist():
                        mine = score[j * rows : (j + 1) * rows]
                        some = np.flatnonzero(mine)
                        if len(some) > k:  # all that tie with the k-th stay
                            some = some[mine[some] >= np.partition(mine[some], len(some) - k)[len(some) - k]]
                        found = zip((-mine[some]).tolist(), ids.take(pa.array(some)).to_pylist())
                        item = int(items[j])
                        best[item] = sorted([*best.get(item, []), *((s, d is None, d) for s, d in found)], key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[:k]
        flat = [(item, d, -s) for item, found in best.items() for s, _, d in found]
        item, doc, score = zip(*flat) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _search_block(index: Index, items: list, item_type: str, k: int) -> DataFrame:
    spark, segments = index.segments.sparkSession, index.segments
    block = Block([x["text"] for x in items])
    shared = spark.sparkContext.broadcast(block)
    df = np.zeros(len(block.terms), dtype=np.int64)
    for x in segments.select("terms", "starts").mapInArrow(_frequencies(shared), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
        df[x["term"]] = x["df"]
    block.weigh(df, index.documents)
    shared = spark.sparkContext.broadcast(block)
    lower = segments.select("doc_ids", "terms", "starts", "places", "impacts", "tops").mapInArrow(_bounds(shared, k), "item long, lower long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower")))
    least = np.zeros(block.items)
    for x in lower.withColumn("rank", rank).filter(F.col("rank") == k).collect():  # a row an item of the block at most
        least[x["item"]] = x["lower"]
    exact = _best(shared, index.documents, index.terms, spark.sparkContext.broadcast(least), k, to_arrow_type(segments.schema["doc_ids"].dataType.elementType))
    found = segments.mapInArrow(exact, f"item long, doc_id {index.id_type}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x["item_id"]) for i, x in enumerate(items)], f"item long, item_id {item_type}")
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: Index, items: DataFrame, k: int = K, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score."""
    kind = items.select(item_id).dtypes[0][1]
    own = items.select(items[item_id].alias("item_id"), F.coalesce(items[text].cast("string"), F.lit("")).alias("text")).distinct()
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    mine = lambda b: own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # noqa: E731  a block
    found = [_search_block(index, rows, kind, k) for rows in map(mine, range(blocks)) if rows]
    if not found:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {index.id_type}, score long")
    return reduce(DataFrame.unionByName, found)
