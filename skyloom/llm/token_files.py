"""Token ids in binary files.

A file holds whole documents in ascending doc_id.  Ids are replaced by their
frequency rank over the whole corpus and written in byte-aligned variable length:
a rank takes 1 to 4 little-endian data bytes, and the lengths of four ranks share
one control byte in a separate stream.  Reading looks all control bytes up in a
256 x 4 table of lengths and scatters the data bytes at once.

Layout (little-endian): 8 bytes magic; uint64 n_docs, n_tokens; int64 doc_id,
uint8 "doc_id is null" and uint64 token count by document; control bytes; data
bytes.  The rank table (id and count by rank) stands beside the files.

Documents are range-partitioned by doc_id and tokenised once: drafts hold plain
ids and each draft's counts of ids, whose sum (a row an id of the vocabulary) is
ranked and broadcast to the tasks that write the files.  A task closes a draft
when it has ``FILE_TOKENS`` tokens, so memory follows the file.  Files travel as a
binary column of Parquet files in the shared folder: Spark's committer makes them
whole or absent on any store, which writing bytes from tasks cannot; ``export``
copies them to plain files for readers that map them.  Offsets over all files are
sums of the files' counts: one row a range, then within each range.

The tokenizers library encodes each distinct piece of words once, and a worker
remembers up to ``CACHE_WORDS`` of them: the normaliser and pre-tokeniser never
look across white space, lower-case everything, and always cut between an ASCII
letter and ASCII punctuation other than the apostrophe (which starts
contractions).  Special tokens are matched in the text as it stands, before any
lower-casing, so slices that hold one are cut at white space only and their
pieces are remembered apart, by their unchanged bytes.  Pieces are told by their
bytes, not by a hash.  Drafts are deleted when the files are written.

Defined cases: null counts as empty; an empty text has the end id only; equal
doc_ids (null ones come first) are ordered by a hash of their text, which also
splits many of them over ranges; an empty
table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm import textnp as tx
from skyloom.llm.shared import removed, shared_folder

MAGIC = b"SKYTOK2\n"
#: Tokens after which a file is closed.
FILE_TOKENS = 1 << 20
#: Words whose ids a worker remembers at most.
CACHE_WORDS = 1_500_000

_CODES = np.arange(256)
#: Lengths of the four values of each control byte.
_LENGTHS = np.stack([(_CODES >> (2 * i) & 3) + 1 for i in range(4)], axis=1).astype(np.uint8)


def pack(value: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray) -> bytes:
    """One file of ranks."""
    value = value.astype(np.uint32)
    size = 1 + (value > 0xFF).astype(np.uint8) + (value > 0xFFFF) + (value > 0xFFFFFF)
    code = np.zeros(-(-len(value) // 4) * 4, dtype=np.uint8)
    code[: len(value)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(at[-1]) + int(size[-1]) if len(size) else 0, dtype=np.uint8)
    data[at] = value & 0xFF
    for byte in range(1, int(size.max()) if len(size) else 0):  # few ranks need more than two bytes
        more = np.flatnonzero(size > byte)
        data[at[more] + byte] = value[more] >> (8 * byte)
    head = np.array([len(doc_ids), len(value)], dtype="<u8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), counts.astype("<u8").tobytes(), control.tobytes(), data.tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, doc_ids, nulls and counts of a file."""
    if blob[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    n_docs, n_tokens = (int(x) for x in take("<u8", 2))
    doc_ids, nulls, counts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    control = take("u1", -(-n_tokens // 4))
    size = _LENGTHS[control].reshape(-1)[:n_tokens]
    starts = np.cumsum(size, dtype=np.int64) - size
    data = take("u1", int(size.sum(dtype=np.int64)))
    value = data[starts].astype(np.uint32)
    for byte in range(1, int(size.max()) if n_tokens else 0):
        more = np.flatnonzero(size > byte)
        value[more] |= data[starts[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return value, doc_ids, nulls.astype(bool), counts.astype(np.int64)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Known:
    """Pieces that a worker remembers: number by bytes, and where each one's ids are."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.at = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def add(self, keys: list[bytes], found: list[list[int]]) -> None:
        n, first = len(keys), len(self.number)
        size = np.fromiter(map(len, found), np.int64, n)
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        while first + n > len(self.at):
            self.at, self.size = np.append(self.at, np.zeros_like(self.at)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.number.update(zip(keys, range(first, first + n)))
        self.at[first : first + n] = self.used + np.cumsum(size) - size
        self.size[first : first + n] = size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)


#: By tokenizer, and whether the pieces come from slices with a special token.
_cache: dict[tuple[str, bool], _Known] = {}

_KIND = np.zeros(256, dtype=np.uint8)  # 1: ASCII letter, 2: ASCII punctuation that is no apostrophe
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
for _a, _b in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
    _KIND[_a:_b] = 2
_KIND[0x27] = 0


@lru_cache(maxsize=2)
def _special(path: str) -> tuple[bytes, ...]:
    return tuple(t.content.encode() for t in _tokenizer(path).get_added_tokens_decoder().values())


def _pieces(path: str, buf: np.ndarray, offs: np.ndarray) -> tuple[tx.Words, np.ndarray, bool]:
    """Pieces that are encoded apart, the bytes that they are told by (pieces of the same bytes have the same ids), and whether a special token is among them."""
    raw = buf.tobytes()
    if any(s in raw for s in _special(path)):
        return tx.Words(buf, offs), buf, True
    kind = _KIND[buf]
    breaks = np.zeros(len(buf), dtype=bool)
    breaks[1:] = (kind[1:] ^ kind[:-1]) == 3
    return tx.Words(buf, offs, breaks=breaks), tx.LOWER[buf], False


def encode_column(path: str, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another, each row closed by ``end``, and how many each row has."""
    words, told, special = _pieces(path, *tx.text_bytes(column))
    known = _cache.setdefault((path, special), _Known())
    code = tx.same_runs(told, words.start, words.end)
    if len(code):
        first = tx.first_of(code)
        raw, s, e = told.tobytes(), words.start[first].tolist(), words.end[first].tolist()
        keys = [raw[x:y] for x, y in zip(s, e)]
        number = np.fromiter(map(known.number.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        if len(known.number) + len(new) > CACHE_WORDS:
            known = _cache[path, special] = _Known()
            new = np.arange(len(keys))
        if len(new):
            new = new.tolist()
            found = _tokenizer(path).encode_batch([keys[i].decode("utf-8") for i in new], add_special_tokens=False)
            known.add([keys[i] for i in new], [x.ids for x in found])
            number = np.fromiter(map(known.number.get, keys), np.int64, len(keys))
        per_word, at, table = known.size[number], known.at[number], known.ids
        size = per_word[code]
        body = table[tx.ragged(at[code], size)]
        count = np.bincount(words.doc, weights=size, minlength=words.rows).astype(np.int64)
    else:
        body, count = np.zeros(0, np.uint32), np.zeros(words.rows, np.int64)
    out = np.full(len(body) + words.rows, end, dtype=np.uint32)
    total = count + 1
    out[tx.ragged(np.cumsum(total) - total, count)] = body
    return out, total


def _drafts(path: str, end: int):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, tokens = [], 0

        def close():
            ids, docs, nulls, counts = (np.concatenate(v) for v in zip(*held))
            times = np.bincount(ids)
            known = np.flatnonzero(times)
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([seq]), pa.array([ids.astype("<u2" if known[-1] < 1 << 16 else "<u4").tobytes()], pa.binary()), one(docs, pa.int64()), one(nulls, pa.bool_()), one(counts, pa.int64()), one(known, pa.int64()), one(times[known], pa.int64())],
                names=["part", "seq", "ids", "docs", "nulls", "counts", "known", "times"],
            )

        for batch in batches:
            for piece in tx.slices(batch, "text", 2 << 20):
                ids, counts = encode_column(path, piece.column("text"), end)
                doc = piece.column("doc_id")
                held.append((ids, np.asarray(doc.fill_null(0), dtype=np.int64), np.asarray(doc.is_null()), counts))
                tokens += len(ids)
                if tokens >= FILE_TOKENS:
                    yield close()
                    held, tokens, seq = [], 0, seq + 1
        if held:
            yield close()

    return run


_DRAFT = "part long, seq long, ids binary, docs array<long>, nulls array<boolean>, counts array<long>, known array<long>, times array<long>"
_FILE = "part long, seq long, n_tokens long, file binary"


def _final(rank):
    """Drafts to files, their ids by rank."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, ids = (batch.column(c)[i].as_py() for c in ("part", "seq", "ids"))
                docs, nulls, counts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("docs", "nulls", "counts"))
                value = rank.value[np.frombuffer(ids, "<u2" if len(ids) == 2 * counts.sum() else "<u4")]
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([len(value)]), pa.array([pack(value, docs, nulls, counts)], pa.binary())], names=["part", "seq", "n_tokens", "file"])

    return run


def write_files(docs: DataFrame, tokenizer: str, folder: str, end: int = 2) -> None:
    """Write ``folder``/files: (part, seq, n_tokens, file), ordered by part and seq, and ``folder``/ranks: (rank, id, n)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_drafts(tokenizer, end), _DRAFT).write.option("compression", "none").parquet(f"{folder}/drafts")
    drafts = spark.read.schema(_DRAFT).parquet(f"{folder}/drafts")
    counted = drafts.select(F.explode(F.arrays_zip("known", "times")).alias("x")).groupBy(F.col("x.known").alias("id")).agg(F.sum("x.times").alias("n"))
    order = counted.orderBy(F.desc("n"), "id").toPandas()  # a row an id of the vocabulary
    ids = order["id"].to_numpy(np.int64)
    spark.createDataFrame(order.assign(rank=range(len(order)))[["rank", "id", "n"]], "rank long, id long, n long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    drafts.select("part", "seq", "ids", "docs", "nulls", "counts").mapInArrow(_final(spark.sparkContext.broadcast(rank)), _FILE).write.option("compression", "none").parquet(f"{folder}/files")
    removed(spark, f"{folder}/drafts")


def _read(ids):
    def run(batches):
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "file"))):
                value, doc_ids, nulls, counts = unpack(blob)
                n = len(doc_ids)
                raw = ids.value[value].tobytes()
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(np.full(n, seq)), pa.array(doc_ids, mask=nulls), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return run


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(_FILE).parquet(f"{folder}/files")
    ids = spark.read.schema("rank long, id long, n long").parquet(f"{folder}/ranks").orderBy("rank").select("id").toPandas()["id"]
    ids = spark.sparkContext.broadcast(ids.to_numpy("<u4"))
    sizes = files.select("part", "seq", F.col("n_tokens").alias("size"))
    ranges = sizes.groupBy("part").agg(F.sum("size").alias("total"))
    before = ranges.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    offsets = sizes.join(before, "part").select("part", "seq", (F.col("base") + F.sum("size").over(Window.partitionBy("part").orderBy("seq")) - F.col("size")).alias("offset"))
    docs = files.select("part", "seq", "file").mapInArrow(_read(ids), "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export(spark: SparkSession, folder: str, target: str) -> None:
    """Copy the files to ``target``/<part>-<seq>.tok, a folder that every executor has mounted, and the ids by rank to ``target``/ranks.u4.

    A file takes its name when it is whole, so a task that runs again writes the same file once more.
    """

    def put(name: str, blob: bytes) -> None:
        own = os.path.join(target, f".{name}-{uuid.uuid4().hex}")
        with open(own, "wb") as f:
            f.write(blob)
        os.replace(own, os.path.join(target, name))

    def run(batches):
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "file"))):
                put(f"{part:06d}-{seq:06d}.tok", blob)
                yield pa.RecordBatch.from_arrays([pa.array([len(blob)])], names=["size"])

    ids = spark.read.schema("rank long, id long, n long").parquet(f"{folder}/ranks").orderBy("rank").select("id").toPandas()["id"]
    put("ranks.u4", ids.to_numpy("<u4").tobytes())
    spark.read.schema(_FILE).parquet(f"{folder}/files").select("part", "seq", "file").mapInArrow(run, "size long").agg(F.sum("size")).collect()


def through_files(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return their index read back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/skyloom-tokens-{uuid.uuid4().hex}"
    write_files(docs, tokenizer, folder, end)
    return read_index(spark, folder)
