"""Vectorised word splitting and hashing over Arrow string columns.

Every helper works on one slice of an Arrow batch, so memory follows the slice
and not the table.  Words are runs of bytes other than space and 0x09-0x0D,
which all are single bytes in UTF-8, so splitting bytes splits characters.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=U64))
#: Start of the two chains of hashes.
_SEEDS = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)
#: Runs of more bytes are hashed one by one with BLAKE2b.
_SHORT = 64
#: Runs that are hashed at once, so that the arrays stay small.
_HASHED = 1 << 14
_ALL = U64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text handled at once; arrays of some 60 bytes a byte stand beside it.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def release() -> None:
    """Give memory that arrays of a finished batch have left free back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int = 32768) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    at = 0
    for cut in [*cuts.tolist(), batch.num_rows]:
        while at < cut:
            end = min(cut, at + rows)
            yield batch.slice(at, end - at)
            at = end
    release()


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.append(buf, np.zeros(8, np.uint8))
    return np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))


def _chunks(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from ``at`` on, ``left`` of them at most."""
    return eight[at] & (_ALL >> (U64(8) * (8 - np.minimum(left, 8)).astype(U64)))


def run_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes buf[start:end].

    Up to ``_SHORT`` bytes it is a chain over eight bytes at a time, in which every step is a
    bijection of the bytes: runs of one length that differ in one step never have the same hash,
    others have it with a chance of 2^-64, and in both chains (seeds 0 and 1) with one of 2^-128.
    The constants are known, so who wants to can find two such runs by search; what must not
    depend on that compares bytes (``same_runs``) or takes ``row_digests``.
    """
    size, eight = end - start, _eights(buf)
    out = np.empty(len(start), dtype=U64)
    for i in range(0, len(start), _HASHED):
        first, n = start[i : i + _HASHED], size[i : i + _HASHED]
        mine = mix(n.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(_SEEDS[seed]))
        at, some = 0, np.flatnonzero((n > 0) & (n <= _SHORT))
        while len(some):
            mine[some] = mix(mine[some] ^ _chunks(eight, first[some] + at, n[some] - at))
            at += 8
            some = some[n[some] > at]
        out[i : i + _HASHED] = mine
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        raw, key = memoryview(np.ascontiguousarray(buf)), _SEEDS[seed].to_bytes(8, "little")
        out[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest(), "little") for a, b in zip(start[long].tolist(), end[long].tolist())]
    return out


def same_runs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """A number for each run of bytes, the same for the same bytes only: runs of one hash are compared with the first of them."""
    code, _ = pd.factorize(run_hashes(buf, start, end) if hashes is None else hashes)
    if not len(code):
        return code
    like = first_of(code)[code]
    again = np.flatnonzero(like != np.arange(len(code)))
    x, y, size = start[again], start[like[again]], (end - start)[again]
    same = bool((size == (end - start)[like[again]]).all())
    long = size > _SHORT
    if same and long.any():
        raw = memoryview(np.ascontiguousarray(buf))
        same = all(raw[a : a + n] == raw[b : b + n] for a, b, n in zip(x[long].tolist(), y[long].tolist(), size[long].tolist()))
        x, y, size = x[~long], y[~long], size[~long]
    eight, at = _eights(buf), 0
    while same and len(x):  # eight bytes at once
        same = bool((_chunks(eight, x + at, size - at) == _chunks(eight, y + at, size - at)).all())
        at += 8
        on = size > at
        x, y, size = x[on], y[on], size[on]
    if same:
        return code
    raw = buf.tobytes()  # two runs have one hash
    return pd.factorize(np.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist())], dtype=object))[0]


def first_of(code: np.ndarray) -> np.ndarray:
    """Where each number 0, 1, ... stands first."""
    first = np.empty(int(code.max()) + 1 if len(code) else 0, dtype=np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return first


class Words:
    """Words of a slice: start, end (byte offsets), doc (row number) and counts by row.

    ``letter`` tells for each byte whether it belongs to words (default: all but white space);
    ``breaks`` marks places where a word starts although the byte before belongs to one.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, letter: np.ndarray | None = None, breaks: np.ndarray | None = None):
        n = len(offs) - 1
        inside = (~SPACE if letter is None else letter)[buf]
        before = np.zeros(len(buf), dtype=bool)
        before[1:] = inside[:-1]
        edge = offs[:-1]
        before[edge[edge < len(buf)]] = False
        if breaks is not None:
            before &= ~breaks
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(buf), dtype=bool)
        after[:-1] = inside[1:]
        edge = offs[1:]
        after[edge[edge > 0] - 1] = False
        if breaks is not None:
            after[:-1] &= ~breaks[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.buf, self.offs, self.rows, self._inside = buf, offs, n, inside
        self.first = np.searchsorted(self.start, offs[:-1])  # number of the row's first word
        self.count = np.searchsorted(self.start, offs[1:]) - self.first
        self.doc = np.repeat(np.arange(n), self.count)
        self.pos = np.arange(len(self.start)) - np.repeat(self.first, self.count)

    def __len__(self) -> int:
        return len(self.start)

    @cached_property
    def left(self) -> np.ndarray:
        """Words from each one to its row's end, itself included."""
        return np.repeat(self.count, self.count) - self.pos

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes (``run_hashes``)."""
        return run_hashes(LOWER[self.buf] if lower else self.buf, self.start, self.end, seed)


def window_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each of ``at`` on."""
    out = hashes[at] * _POWERS[0]
    for j in range(1, k):
        out += hashes[at + j] * _POWERS[j]
    return mix(out)


def windows(words: Words, hashes: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of one row, and the number of the first word of each.

    With ``short`` a row of fewer words has its whole sequence as one window.
    """
    n, full = len(hashes), np.flatnonzero(words.left >= k)
    rolled = np.zeros(max(n - k + 1, 0), dtype=U64)
    for j in range(k if len(rolled) else 0):
        rolled += hashes[j : n - k + 1 + j] * _POWERS[j]
    out = mix(rolled[full])
    if not short or not (words.count[words.count > 0] < k).any():
        return out, full
    few = np.flatnonzero((words.pos == 0) & (words.left < k))
    part = np.zeros(len(few), dtype=U64)
    for j in range(k - 1):
        has = words.left[few] > j
        part[has] += hashes[few[has] + j] * _POWERS[j]
    at = np.concatenate((full, few))
    order = np.argsort(at, kind="stable")
    return np.concatenate((out, mix(part)))[order], at[order]


def word_codes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, the same for the same bytes only."""
    return same_runs(words.buf, words.start, words.end, hashes)


def row_digests(words: Words) -> np.ndarray:
    """128 bits of BLAKE2b of each row's words, A-Z lower-cased and joined by one space, as 16 bytes; zeros for rows without words."""
    out = np.zeros((words.rows, 16), dtype=np.uint8)
    full = words.end - words.start + 1
    body = LOWER[np.append(words.buf, np.uint8(0x20))[ragged(words.start, full)]]
    ends = np.cumsum(full)
    body[ends - 1] = 0x20
    raw, ends = memoryview(body), np.concatenate(([0], ends))
    for row in np.flatnonzero(words.count).tolist():
        a, n = words.first[row], words.count[row]
        out[row] = np.frombuffer(hashlib.blake2b(raw[ends[a] : ends[a + n] - 1], digest_size=16).digest(), np.uint8)
    return out


def row_hashes(words: Words, hashes: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each row's whole word sequence, for an order of rows; 0 for rows without words."""
    out = np.zeros(words.rows, U64)
    some = np.flatnonzero(words.count)
    if len(some):
        place = mix(words.pos.astype(U64) + U64(seed * 7919 + 1)) | U64(1)
        terms = mix(hashes ^ U64(seed)) * place
        out[some] = mix(np.add.reduceat(terms, words.first[some]) + words.count[some].astype(U64))
    return out


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64, copy=False).view(np.int64))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary column of a 2-d uint8 array, a row each."""
    rows = np.ascontiguousarray(rows, dtype=np.uint8)
    n, width = rows.shape
    offs = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(rows)])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... for ``size`` steps of each run, runs after one another."""
    at = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - at, size)


def gather_text(buf: np.ndarray, start: np.ndarray, size: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """For each row its pieces buf[start : start+size], joined by one space; ``row`` ascends."""
    last = np.ones(len(row), dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    full = size + ~last
    padded = np.append(buf, np.uint8(0x20))
    body = padded[np.minimum(ragged(start, full), len(buf))]
    ends = np.cumsum(full)
    body[ends[~last] - 1] = 0x20
    offs = np.concatenate(([0], np.cumsum(np.bincount(row, weights=full, minlength=rows).astype(np.int64))))
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body)))
