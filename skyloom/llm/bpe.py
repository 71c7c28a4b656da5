"""BPE encoding and decoding with a tokenization automaton.

The automaton's arcs are tokens, and every arc of one token leads to one state.
``compile_merges`` builds it merge by merge, starting from one state with a loop
for every single byte.  The gadget of merge (a, b) -> c looks at the state that a
leads to; if b leaves it, then c gets an arc wherever a has one, c leads to where
b leads, and a leads from now on to a copy of its state without the arc b.  Of all
ways to cut a pre-split word into tokens exactly one is a path of the automaton,
and it is the BPE encoding.

States are copied only when several tokens lead to them, and tokens that leave
the same states share a column, so the finished transition table is one bit for
each state and class of arcs.  It is compiled once on the driver, bounded by the
vocabulary (50,000 tokens: some tens of MB), and broadcast.

Encoding walks the table: from each place of a word the longest token of a byte
trie that the state lets pass is taken, then shorter ones; a place from which no
arc leads to the word's end is left for good, so the work follows the word's
length.  All words of a slice walk at once; the last few, which may be very long,
go on one by one.  Decoding emits the arcs' labels.

Texts are cut where white space follows a character that is none; the pre-split
pattern never crosses such a place, so each distinct piece of a slice is split
and encoded once.

Defined cases: null counts as empty; an empty text has no tokens and decodes to
the empty text; the strings of special tokens in a text become their ids, as in
the tokenizers library; very long texts are handled whole; an empty table gives
an empty result; other columns are ignored by the digest and kept by ``encode``.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skyloom.llm import textnp as tx

# The public pre-split pattern of byte-level BPE, with the white space it means spelt out.
_S = r"\x09-\x0D\x20\x85\xA0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

# Classes of bytes for the pattern: white space, letter, digit, other, and what only the regular expression tells.
_WHITE, _ALPHA, _DIGIT, _OTHER, _ASK, _CONTINUED = range(6)
_CLASS = np.full(256, _ASK, dtype=np.uint8)
_CLASS[:0x80] = _OTHER
_CLASS[0x09:0x0E] = _CLASS[0x20] = _WHITE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0xC3] = _ALPHA  # 0xC3 begins the letters U+00C0 to U+00FF
_CLASS[0x27] = _ASK  # an apostrophe may start a contraction
_CLASS[0x80:0xC0] = _CONTINUED


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def compile_merges(tokens: int, singles: list[int], merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successive gadgets (a, b, c): the state that each token leads to, each token's class of arcs, and the table of bits state x class."""
    state, arcs = np.full(tokens, -1, dtype=np.int32), np.full(tokens, -1, dtype=np.int32)
    state[singles] = arcs[singles] = 0
    leads, leaves = [len(singles)], [len(singles)]  # tokens that share a state, a class
    table = np.zeros((1024, 128), dtype=np.uint8)
    table[0, 0] = 1
    for a, b, c in merges:
        p, q = int(state[a]), int(arcs[b])
        if state[c] >= 0 or p < 0 or q < 0 or not table[p, q >> 3] >> (q & 7) & 1:
            continue  # no path has this pair side by side
        state[c] = state[b]
        leads[state[c]] += 1
        if leads[p] > 1:  # others lead here too: a gets a copy
            if len(leads) == len(table):
                table = np.vstack((table, np.zeros_like(table)))
            table[len(leads)] = table[p]
            leads[p] -= 1
            p = state[a] = len(leads)
            leads.append(1)
        if leaves[q] > 1:  # other tokens are of this class: b gets its own
            new = len(leaves)
            if new == 8 * table.shape[1]:
                table = np.hstack((table, np.zeros_like(table)))
            rows = table[: len(leads)]
            rows[:, new >> 3] |= (rows[:, q >> 3] >> np.uint8(q & 7) & np.uint8(1)) << np.uint8(new & 7)
            leaves[q] -= 1
            q = arcs[b] = new
            leaves.append(1)
        table[p, q >> 3] &= np.uint8(255 - (1 << (q & 7)))
        arcs[c] = arcs[a]
        leaves[arcs[c]] += 1
    return state, arcs, table[: len(leads), : (len(leaves) + 7) // 8].copy()


class Automaton:
    #: Bytes of words encoded at once, and how many words are too few to walk together.
    BLOCK, FEW = 1 << 18, 24

    def __init__(self, path: str, compiled: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*vocab.values(), *self.special.values()]) + 1
        labels = [b""] * n
        for token, i in vocab.items():
            if token not in self.special:
                labels[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            labels[i] = token.encode()
        self.size = np.array([len(x) for x in labels])
        self.at = np.cumsum(self.size) - self.size
        self.label = np.frombuffer(b"".join(labels), np.uint8)
        if compiled is None:
            pairs = (x if isinstance(x, list) else x.split(" ") for x in merges)
            single = [i for t, i in vocab.items() if len(t) == 1 and t not in self.special]
            compiled = compile_merges(n, single, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.state, self.arcs, self.table = compiled
        self._trie([(x, i) for i, x in enumerate(labels) if x and self.state[i] >= 0])

    def _trie(self, labels: list[tuple[bytes, int]]) -> None:
        nodes: list[dict[int, int]] = [{}]
        token = [-1]
        for label, i in labels:
            at = 0
            for b in label:
                at = nodes[at].setdefault(b, len(nodes))
                if at == len(nodes):
                    nodes.append({})
                    token.append(-1)
            token[at] = i
        #: The longest token that is a beginning of each token; -1 for single bytes.
        self.shorter = np.full(len(self.size), -1, dtype=np.int32)
        for label, i in labels:
            at, last = 0, -1
            for b in label[:-1]:
                at = nodes[at][b]
                last = token[at] if token[at] >= 0 else last
            self.shorter[i] = last
        inner = [k for k, x in enumerate(nodes) if x]
        self._row = np.zeros(len(nodes), dtype=np.int32)  # row 0 has no arcs
        self._row[inner] = np.arange(1, len(inner) + 1)
        self._next = np.full((len(inner) + 1, 256), -1, dtype=np.int32)
        for r, k in enumerate(inner, 1):
            self._next[r, list(nodes[k])] = list(nodes[k].values())
        self._token = np.array(token, dtype=np.int32)

    def follows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether arc y leaves the state that arc x leads to."""
        q = self.arcs[y]
        return (self.table[self.state[x], q >> 3] >> (q & 7).astype(np.uint8) & 1).astype(bool)

    def encode(self, body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of consecutive words of ``body`` (bytes), and how many each word has."""
        ends = np.cumsum(size)
        out, at, base = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, 0
        while at < len(size):  # about BLOCK bytes at once, one word at least
            to = max(at + 1, int(np.searchsorted(ends, base + self.BLOCK, side="right")))
            out.append(self._encode(body[base : ends[to - 1]], size[at:to]))
            at, base = to, int(ends[to - 1])
        return tuple(np.concatenate(x) for x in zip(*out))

    def _longest(self, body: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token from each place that ends by ``end``."""
        best = np.full(len(place), -1, dtype=np.int32)
        who, node, step = np.arange(len(place)), np.zeros(len(place), dtype=np.int32), 0
        while len(who):
            node = self._next[self._row[node], body[place[who] + step]]
            step += 1
            on = node >= 0
            who, node = who[on], node[on]
            token = self._token[node]
            hit = token >= 0
            best[who[hit]] = token[hit]
            on = place[who] + step < end[who]
            who, node = who[on], node[on]
        return best

    def _encode(self, body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum(size)
        base = end - size
        into = np.full(len(body), -1, dtype=np.int32)  # the arc of the path that ends with this byte
        left = np.zeros(len(body), dtype=bool)  # no path goes on after this byte
        who, at, last = np.arange(len(size)), base.copy(), np.full(len(size), -1, dtype=np.int32)
        arc = self._longest(body, at, end)
        while len(who) > self.FEW:
            to = np.where(arc >= 0, at + self.size[arc], at)
            may = (arc >= 0) & ~left[to - 1]
            some = np.flatnonzero(may & (last >= 0))
            may[some] = self.follows(last[some], arc[some])
            go, stay = np.flatnonzero(may), np.flatnonzero(~may)
            into[to[go] - 1] = arc[go]
            at[go], last[go] = to[go], arc[go]
            arc[stay] = np.where(arc[stay] >= 0, self.shorter[arc[stay]], -1)
            back = stay[arc[stay] < 0]  # nothing leads on from here: undo the arc that led here
            if len(back):
                left[at[back] - 1] = True
                undone = into[at[back] - 1]
                at[back] -= self.size[undone]
                last[back] = np.where(at[back] > base[who[back]], into[np.maximum(at[back] - 1, 0)], -1)
                arc[back] = self.shorter[undone]
            more = at[go] < end[who[go]]
            arc[go[more]] = self._longest(body, at[go[more]], end[who[go[more]]])
            alive = np.ones(len(who), dtype=bool)
            alive[go[~more]] = False
            who, at, last, arc = who[alive], at[alive], last[alive], arc[alive]
        for w, p, x, y in zip(who.tolist(), at.tolist(), last.tolist(), arc.tolist()):
            self._walk(body, into, left, int(base[w]), int(end[w]), p, x, y)
        # read the one path back
        count = np.zeros(len(size), dtype=np.int64)
        at, who = end.copy(), np.arange(len(size))
        back_who, back_token = [], []
        while len(who) > self.FEW:
            t = into[at - 1]
            back_who.append(who), back_token.append(t)
            count[who] += 1
            at = at - self.size[t]
            go = at > base[who]
            at, who = at[go], who[go]
        tails = []  # of the last few words, whose first tokens are read one by one
        for w, p in zip(who.tolist(), at.tolist()):
            tail, first = [], int(base[w])
            while p > first:
                tail.append(int(into[p - 1]))
                p -= int(self.size[tail[-1]])
            tails.append(tail)
        read = count.copy()
        count[who] += np.array([len(t) for t in tails], dtype=np.int64)
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int64)
        for i, (w, t) in enumerate(zip(back_who, back_token)):
            out[first[w] + count[w] - 1 - i] = t
        for w, tail in zip(who.tolist(), tails):
            out[first[w] : first[w] + count[w] - read[w]] = tail[::-1]
        return out, count

    def _walk(self, body: np.ndarray, into: np.ndarray, left: np.ndarray, base: int, end: int, at: int, last: int, arc: int) -> None:
        """The rest of one word's walk."""
        raw = body[at:end].tobytes()
        origin, row, step, token = at, self._row, self._next, self._token
        size, shorter, state, arcs, table = self.size, self.shorter, self.state, self.arcs, self.table
        while True:
            if arc >= 0:
                to = at + int(size[arc])
                q = int(arcs[arc])
                if not left[to - 1] and (last < 0 or int(table[state[last], q >> 3]) >> (q & 7) & 1):
                    into[to - 1] = arc
                    if to == end:
                        return
                    at, last, arc, node, p = to, arc, -1, 0, to
                    while p < end:
                        node = int(step[row[node], raw[p - origin] if p >= origin else body[p]])
                        if node < 0:
                            break
                        if token[node] >= 0:
                            arc = int(token[node])
                        p += 1
                    continue
                arc = int(shorter[arc])
                if arc >= 0:
                    continue
            left[at - 1] = True
            undone = int(into[at - 1])
            at -= int(size[undone])
            last = int(into[at - 1]) if at > base else -1
            arc = int(shorter[undone])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the arcs of consecutive runs of ids emit, and how many each run has."""
        body = self.label[tx.ragged(self.at[ids], self.size[ids])]
        ends = np.concatenate(([0], np.cumsum(self.size[ids])))
        cut = np.concatenate(([0], np.cumsum(count)))
        return body, np.diff(ends[cut])


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(path)


_built: dict[str, Automaton] = {}


def _shared(docs: DataFrame, path: str):
    """A function that gives the automaton on a worker: its table is compiled here and broadcast, labels and trie are read there."""
    auto = automaton(path)
    tables = docs.sparkSession.sparkContext.broadcast((auto.state, auto.arcs, auto.table))

    return lambda: _ready(path, tables)


def _ready(path: str, tables) -> Automaton:
    if path not in _built:
        _built[path] = Automaton(path, tables.value)
    return _built[path]


@lru_cache(maxsize=1)
def _splitter():
    return regex.compile(PATTERN)


def _pieces(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Start of every piece: the row's start, and white space after a character that surely is none."""
    n = len(buf)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    if n > 1:
        p1 = buf[:-1]
        p2 = np.concatenate(([0], buf[:-2])).astype(np.uint8)
        p3 = np.concatenate(([0, 0], buf[:-3])).astype(np.uint8)[: n - 1]
        unsure = (p1 >= 0x80) & ((p2 == 0xC2) | ((p3 >= 0xE1) & (p3 <= 0xE3)))
        cut[1:n] |= tx.SPACE[buf[1:]] & ~tx.SPACE[p1] & ~unsure
    start = np.flatnonzero(cut)
    return start[start < n]


def _words(body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pattern's words start in consecutive pieces, and the number of each piece's first word.

    A piece has white space at its start only.  Where all its characters are of
    known classes, its words are the runs of one class, and one space belongs to the
    run after it; the regular expression splits the others.
    """
    base = np.cumsum(size) - size
    kind = _CLASS[body]
    on = np.flatnonzero(kind == _CONTINUED)
    known = (body[on - 1] == 0xC3) & (body[on] != 0x97) & (body[on] != 0xB7)  # the signs of product and quotient are no letters
    kind[on] = np.where(known, _ALPHA, _ASK)
    cut = np.ones(len(body), dtype=bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut[base] = True
    second = base[size > 1] + 1
    ask = np.add.reduceat(kind == _ASK, base, dtype=np.int64) > 0
    ask[np.flatnonzero(size > 1)[(kind[second - 1] == _WHITE) & (kind[second] == _WHITE)]] = True
    cut[second[body[second - 1] == 0x20]] = False
    some = np.flatnonzero(ask)
    if len(some):
        cut[tx.ragged(base[some], size[some])] = False
        split, raw, starts = _splitter().findall, body.tobytes(), []
        for at, n in zip(base[some].tolist(), size[some].tolist()):
            for w in split(raw[at : at + n].decode("utf-8")):
                starts.append(at)
                at += len(w) if w.isascii() else len(w.encode("utf-8"))
        cut[starts] = True
    return cut, (np.cumsum(cut) - 1)[base]


def encode_rows(auto: Automaton, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another, and how many each row has; without special tokens."""
    rows = len(offs) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    start = _pieces(buf, offs)
    end = np.append(start[1:], len(buf))
    code = tx.same_runs(buf, start, end)
    one = tx.first_of(code)  # the first piece of each code
    s, n = start[one], (end - start)[one]
    body = buf[tx.ragged(s, n)]
    cut, first = _words(body, n)
    edge = np.flatnonzero(cut)
    word = np.diff(np.append(edge, len(body)))
    ids, count = auto.encode(body, word)
    per_piece = np.add.reduceat(count, first)
    at = np.cumsum(per_piece) - per_piece
    out = ids[tx.ragged(at[code], per_piece[code])]
    row = np.searchsorted(offs, start, side="right") - 1
    return out, np.bincount(row, weights=per_piece[code], minlength=rows).astype(np.int64)


def encode_column(auto: Automaton, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a string column, special tokens included."""
    buf, offs = tx.text_bytes(column)
    raw = buf.tobytes()
    if not any(s.encode() in raw for s in auto.special):
        return encode_rows(auto, buf, offs)
    cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(auto.special, key=len, reverse=True)) + ")")
    parts, marks, row = [], [], []
    for r, text in enumerate(column.fill_null("").to_pylist()):
        for x in cut.split(text):
            parts.append("" if x in auto.special else x)
            marks.append(auto.special.get(x, -1))
            row.append(r)
    ids, count = encode_rows(auto, *tx.text_bytes(pa.array(parts, pa.large_string())))
    marks = np.array(marks)
    total = count + (marks >= 0)
    out = np.empty(int(total.sum()), dtype=np.int64)
    first = np.cumsum(total) - total
    out[tx.ragged(first, count)] = ids
    out[first[marks >= 0]] = marks[marks >= 0]
    return out, np.bincount(np.array(row), weights=total, minlength=len(column)).astype(np.int64)


def _digest(get):
    def run(batches):
        auto = get()
        for batch in batches:
            for part in tx.slices(batch, "text", 2 << 20):
                ids, count = encode_column(auto, part.column("text"))
                body, size = auto.decode(ids, count)
                raw, out = ids.astype("<u4").tobytes(), body.tobytes()
                a, b = np.concatenate(([0], np.cumsum(count))) * 4, np.concatenate(([0], np.cumsum(size)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(count),
                        pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(a[:-1].tolist(), a[1:].tolist())], pa.string()),
                        pa.array([hashlib.sha256(out[x:y].decode("utf-8", "replace").encode("utf-8")).hexdigest() for x, y in zip(b[:-1].tolist(), b[1:].tolist())], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select("doc_id", "text").mapInArrow(_digest(_shared(docs, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(get):
    def run(batches):
        auto = get()
        for batch in batches:
            for part in tx.slices(batch, "text", 2 << 20):
                ids, count = encode_column(auto, part.column("text"))
                offs = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and its token ids."""
    return docs.select("doc_id", "text").mapInArrow(_encode(_shared(docs, path)), "doc_id long, ids array<int>")


def _decode(get):
    def run(batches):
        auto = get()
        for batch in batches:
            if batch.num_rows:
                col = batch.column("ids").fill_null([])
                count = np.asarray(col.value_lengths(), dtype=np.int64)
                body, size = auto.decode(np.asarray(col.flatten(), dtype=np.int64), count)
                raw, at = body.tobytes(), np.concatenate(([0], np.cumsum(size))).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())], names=["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids."""
    return tokens.select("doc_id", "ids").mapInArrow(_decode(_shared(tokens, path)), "doc_id long, text string")


def _round_trip(get):
    def run(batches):
        auto = get()
        for batch in batches:
            for part in tx.slices(batch, "text", 2 << 20):
                ids, count = encode_column(auto, part.column("text"))
                body, size = auto.decode(ids, count)
                raw, at = body.tobytes(), np.concatenate(([0], np.cumsum(size))).tolist()
                offs = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(count),
                        pa.ListArray.from_arrays(pa.array(offs), pa.array(ids.astype(np.int32))),
                        pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, the token ids and the text decoded from them."""
    return docs.select("doc_id", "text").mapInArrow(_round_trip(_shared(docs, path)), "doc_id long, n_tokens long, ids array<int>, decoded string")
