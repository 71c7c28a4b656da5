"""Near-duplicate linking with SetSketch registers.

A document's set are its distinct k-word shingles.  Register i of its sketch is
``floor(1 - log_b(m_i))``, m_i the least exponential value over the set, cut to
0..254: exponentially spaced truncated minima, mergeable by maximum and
locality-sensitive.  Bands of registers give candidate buckets; pairs within a
bucket are estimated jointly by likelihood from the numbers of larger, smaller
and equal registers and the two set sizes, and those that may reach the
threshold are verified on the full sets.

What keeps it bounded:

* texts with the same word sequence are one node, found by a hash of it with
  partial aggregation, so copies never meet in a bucket;
* only buckets with two nodes or more carry sketches on; a pair is looked at in
  its first common band only;
* a bucket of up to ``SMALL`` nodes gives its likely pairs (28 at most), which
  are joined with the full sets;
* the nodes of larger buckets, up to ``LARGE``, bring their sets along, likely
  pairs are verified on the spot unless verified links connect them already, and
  only a spanning forest of verified links leaves, so that a dense group gives
  links in proportion to its nodes;
* beyond ``LARGE`` no bucket is paired with itself.  Every node brings its set once,
  to the first such bucket that it is in, and is compared with the bucket's
  leaders (about ``LEADERS``, the same ones in all bands), so a family of n near
  copies sends rows in proportion to n.  Links are contracted, and the nodes that
  stay outside the largest component of a bucket meet other leaders of another of
  their buckets.  In buckets that are still of several components each pair between different ones is looked at: the nodes outside the
  largest against all, tile by tile, sets at hand, until verified links connect
  them.  No link between components is lost;
* components come from label propagation with pointer jumping over the verified
  links, materialised in the shared folder.  Nothing is collected to the driver.

Shingles are compared by 55-bit hashes; two of a text's n shingles have the same
one with a chance of n^2 / 2^56.

With 7 registers a band and 32 bands a pair of similarity 0.8 is missed with
probability 3e-4, one of 0.85 with 2e-5.

Defined cases: null and empty texts and texts without words have an empty set,
size 0, no links, and are their own component; a text of fewer than k words has
its sequence as the one shingle; rows that repeat a text are linked (size 1 of
the shared node); a repeated doc_id with another text links under each text; a
null doc_id never becomes a component's id unless there is no other, and a text
that only rows with null doc_id have is linked to its copies only; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnp as tx
from skyloom.llm.shared import cut, written

ROWS, BANDS = 7, 32
REGISTERS = ROWS * BANDS
#: Base and rate of the sketch's exponential spacing.
BASE, RATE = 1.1, 20.0
#: Nodes in a tile's block.
TILE = 256
#: Nodes in a bucket whose pairs are verified by a join, and in one that is a tile of its own.
SMALL, LARGE = 8, 512
#: Nodes that the others of a bucket beyond ``LARGE`` are compared with first, in expectation.
LEADERS = 16
#: Rounds after the first one: of other leaders, and at last of all pairs that are left.
ROUNDS = 2
#: Rows of a slice, and the bits of a shingle that are left beside a row's number.
_ROWS = 512
_BITS = np.uint64(55)
_MASK = np.uint64((1 << 55) - 1)
_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 2**32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)
#: Shingles hashed at once, so that the arrays stay in the processor's cache.
_CHUNK = 16384


def _distinct(words: tx.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles (55 bits) of at most ``_ROWS`` rows, and how many each row has."""
    hashes, at = tx.windows(words, words.hashes(lower=True), k, short=True)
    key = np.sort((words.doc[at].astype(np.uint64) << _BITS) | (hashes & _MASK))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & _MASK, np.bincount((key >> _BITS).astype(np.int64), minlength=words.rows)


def sketch(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS, uint8) of consecutive runs of distinct elements; zeros for empty runs."""
    least = np.full((len(counts), REGISTERS), 0xFFFFFFFF, dtype=np.uint32)
    folded = (elements ^ (elements >> np.uint64(21))).astype(np.uint32)
    some = np.flatnonzero(counts)
    ends = np.cumsum(counts[some])
    at = 0
    while at < len(some):
        base = ends[at] - counts[some[at]]
        to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        x, cuts = folded[base : ends[to - 1]], (ends[at:to] - counts[some[at:to]]) - base
        y, z = np.empty_like(x), np.empty_like(x)
        block = np.empty((to - at, REGISTERS), dtype=np.uint32)
        for i in range(REGISTERS):
            np.multiply(x, _MUL[i], out=y)
            y += _ADD[i]
            np.right_shift(y, 15, out=z)
            y ^= z
            y *= np.uint32(0x2C1B3C6D)
            np.right_shift(y, 13, out=z)
            y ^= z
            block[:, i] = np.minimum.reduceat(y, cuts)
        least[some[at:to]] = block
        at = to
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    out = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 254).astype(np.uint8)
    out[counts == 0] = 0
    return out


def likelihood_similarity(larger: np.ndarray, smaller: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Jaccard similarity that makes the numbers of larger, smaller and equal registers likeliest."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    equal = REGISTERS - larger - smaller
    shift = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * shift) / np.log(BASE)

    def loglik(j):
        a, b = p(u - v * j), p(v - u * j)
        return larger * np.log(a + 1e-12) + smaller * np.log(b + 1e-12) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        m1, m2 = low + (high - low) / 3, high - (high - low) / 3
        up = loglik(m1) < loglik(m2)
        low, high = np.where(up, m1, low), np.where(up, high, m2)
    return (low + high) / 2


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", rows=_ROWS):
                words = tx.Words(*tx.text_bytes(part.column("text")))
                elements, counts = _distinct(words, k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(counts.astype(np.int64)), tx.fixed_binary(tx.row_digests(words)), tx.fixed_binary(sketch(elements, counts))],
                    names=["doc_id", "row", "n_shingles", "node", "regs"],
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (band key, node) for each band; the key holds the band's number and registers themselves."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint8).reshape(n, BANDS, ROWS)
        key = np.zeros((n, BANDS, 8), dtype=np.uint8)
        key[:, :, :ROWS] = regs
        key[:, :, 7] = np.arange(BANDS)
        for band in range(BANDS):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key[:, band]).view(np.int64).ravel()), batch.column("node")], names=["key", "node"])


def _likely(threshold: float, rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile whose first common band this is and that may reach the threshold, with their estimates.

    Rows of side 1, where there are any, meet those of side 0; otherwise all meet.  Nodes of one ``root`` are connected already.
    """
    low = threshold - 3.5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    regs, n, root = rows["regs"], rows["n"], rows["root"]
    if not rows["side"].any():
        a, b = np.triu_indices(len(n), 1)
    else:
        left, right = np.flatnonzero(rows["side"] == 1), np.flatnonzero(rows["side"] == 0)
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    apart = root[a] != root[b]
    a, b = a[apart], b[apart]
    fits = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
    a, b = a[fits], b[fits]
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for at in range(0, len(a), 8192):
        x, y = a[at : at + 8192], b[at : at + 8192]
        same = regs[x] == regs[y]
        first = same.reshape(len(x), BANDS, ROWS).all(axis=2).argmax(axis=1) == rows["band"] if rows["first"] else np.ones(len(x), dtype=bool)
        x, y = x[first], y[first]
        if len(x):
            rx, ry = regs[x], regs[y]
            s = likelihood_similarity((rx > ry).sum(1).astype(float), (rx < ry).sum(1).astype(float), n[x].astype(float), n[y].astype(float))
            may = s >= low
            found.append((x[may], y[may], s[may]))
    return tuple(np.concatenate(v) for v in zip(*found))


def _verified(node: np.ndarray, a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """A spanning forest of the pairs that reach the threshold on their full sets; rows of one ``node`` are one vertex."""
    parent = {x: x for x in node.tolist()}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        p, q = root(int(node[x])), root(int(node[y]))
        if p != q:
            u, v = sets[x], sets[y]
            both = np.concatenate((u, v))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                parent[p] = q
                keep[i] = True
    return keep


def _pairs(percent: int, verify: bool, first: bool = True):
    """Likely pairs of sorted tiles; with ``verify`` a forest, between roots, of those that hold on the sets brought along.

    ``first``: only pairs that have no common band before the tile's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _whole_groups(batches, held):
            n = batch.num_rows
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint8).reshape(n, REGISTERS)
            key, tile, side, size = (batch.column(c).to_numpy() for c in ("key", "tile", "side", "n"))
            root = pd.factorize(np.array(batch.column("root").to_pylist(), dtype=object))[0]
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            edges = [0, *cuts.tolist(), n]
            band = np.ascontiguousarray(key).view(np.uint8).reshape(n, 8)[:, 7]
            if verify:
                offs, values = batch.column("set").offsets.to_numpy(), batch.column("set").values.to_numpy()
            left, right = [], []
            for s, e in zip(edges[:-1], edges[1:]):
                if e - s > 1:
                    a, b, likeness = _likely(percent / 100, {"regs": regs[s:e], "n": size[s:e], "root": root[s:e], "band": band[s], "side": side[s:e], "first": first})
                    if verify and len(a):
                        order = np.argsort(-likeness, kind="stable")
                        a, b = a[order], b[order]
                        keep = _verified(root[s:e], a, b, [values[offs[i] : offs[i + 1]] for i in range(s, e)], percent)
                        a, b = a[keep], b[keep]
                    left.append(a + s), right.append(b + s)
            if left:
                a, b = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
                ends = batch.column("root" if verify else "node")
                yield pa.RecordBatch.from_arrays([ends.take(a), ends.take(b)], names=["a", "b"])

    return run


def _whole_groups(batches, held):
    """Regroup sorted batches so that a (key, tile) run is never cut; a run has 2 x TILE rows or so."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        held.clear()
        key, tile = (table.column(c).to_numpy() for c in ("key", "tile"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
        at = int(cuts[-1]) if len(cuts) else 0
        if at:
            yield from table.slice(0, at).combine_chunks().to_batches()
        held.extend(table.slice(at).to_batches())
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text", rows=_ROWS):
                words = tx.Words(*tx.text_bytes(part.column("text")))
                elements, counts = _distinct(words, k)
                offs = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([tx.fixed_binary(tx.row_digests(words)), pa.ListArray.from_arrays(pa.array(offs), tx.as_long(elements))], names=["node", "set"])

    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label, root): the smallest ``first`` of ``nodes(node, first)`` that links(a, b) reach, and its node; only nodes with links.

    Rounds of contraction: every vertex moves to the smallest vertex next to it,
    then to where that one moved; links are renamed, those within a vertex and
    repeated ones go.  Vertices are ordered by (first, node), so the last one of
    a component carries its label.
    """

    def vertex(node: str, first: str):
        return F.struct(F.col(first).isNull().alias("none"), F.col(first).alias("first"), F.col(node).alias("node"))

    raw = cut(links.select("a", "b").distinct())
    ends = raw.select(F.col("a").alias("node")).union(raw.select("b")).distinct()
    known = cut(ends.join(nodes.select("node", "first"), "node").select("node", vertex("node", "first").alias("v")))
    edges = cut(
        raw.join(known.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(known.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    )
    where = known
    while not edges.isEmpty():
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = cut(near.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to")).withColumn("to", F.least("v", "to")))
        onward = move.select(F.col("v").alias("to"), F.col("to").alias("further"))
        move = cut(move.join(onward, "to").select("v", F.col("further").alias("to")))
        where = cut(where.join(move, "v", "left").select("node", F.coalesce("to", "v").alias("v")))
        left = move.select(F.col("v").alias("a"), F.col("to").alias("x"))
        right = move.select(F.col("v").alias("b"), F.col("to").alias("y"))
        edges = cut(edges.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a != b").distinct())
    return where.select("node", F.col("v.first").alias("label"), F.col("v.node").alias("root"))


def _block(salt: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")


def _every(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))


def leader_tiles(large: DataFrame, members: DataFrame, salt: str) -> DataFrame:
    """(key, tile, side, node, root): each of members(key, node, root) once, beside the leaders of its bucket in large(key, node, root, c)."""
    tiles = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("nb"))
    own = members.join(tiles, "key").select("key", _block("tile", F.col("nb")).alias("tile"), F.lit(0).alias("side"), "node", "root")
    leaders = large.filter(F.shiftrightunsigned(F.xxhash64("node", F.lit(salt)), 33) * F.col("c") < LEADERS * float(1 << 31))
    copies = leaders.select("key", "node", "root").join(tiles, "key").select("key", _every(F.col("nb")).alias("tile"), F.lit(1).alias("side"), "node", "root")
    return own.union(copies)


def outsiders(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of tagged(key, node, root, c): its buckets of several components (key, top, nr, nd), and the nodes outside their largest one."""
    kinds = tagged.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda n: F.ceil(n / TILE).cast("int")
    mixed = kinds.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    mixed = cut(mixed.select("key", "top", blocks(F.col("all") - F.col("most")).alias("nr"), blocks(F.col("all")).alias("nd")))
    return mixed, tagged.join(mixed, "key").filter("root <> top").select("key", "node", "root")


def residual_tiles(tagged: DataFrame, mixed: DataFrame) -> DataFrame:
    """(key, tile, side, node, root): nodes outside the largest component of their bucket (side 1) against all of it, in tiles."""
    rows = tagged.join(mixed, "key")
    rest = rows.filter("root <> top").withColumn("i", _block("rest", F.col("nr"))).withColumn("j", _every(F.col("nd"))).withColumn("side", F.lit(1))
    whole = rows.withColumn("j", _block("all", F.col("nd"))).withColumn("i", _every(F.col("nr"))).withColumn("side", F.lit(0))
    return rest.unionByName(whole).select("key", (F.col("i").cast("long") * F.col("nd") + F.col("j")).alias("tile"), "side", "node", "root")


def _moved(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after the roots of ``labels``, and nodes that had no link, have got those of ``more``."""
    to = more.select(F.col("node").alias("root"), F.col("label").alias("_label"), F.col("root").alias("_root"))
    old = labels.join(to, "root", "left").select("node", F.when(F.col("_root").isNotNull(), F.col("_label")).otherwise(F.col("label")).alias("label"), F.coalesce("_root", "root").alias("root"))
    return cut(old.unionByName(more.join(labels, "node", "left_anti")))


def _labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept); ``row`` is a hash of the text."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    sk = cut(texts.mapInArrow(_sketches(k), "doc_id long, row long, n_shingles long, node binary, regs binary"))
    some = sk.filter("n_shingles > 0")
    nodes = cut(some.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")))
    bands = nodes.select("regs", "node").mapInArrow(_bands, "key long, node binary")
    sizes = cut(bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    met = cut(bands.join(sizes, "key"))
    found = "a binary, b binary"

    def tiles(dealt: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Tiles of (key, tile, side, node, root) with sketches, and sets where given, sorted."""
        rows = dealt.join(nodes.select("node", "n", "regs"), "node")
        rows = rows if sets is None else rows.join(sets, "node")
        columns = ["key", "tile", "side", "n", "regs", "node", "root"] + ([] if sets is None else ["set"])
        return rows.repartition(partitions, "key", "tile").sortWithinPartitions("key", "tile").select(*columns)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, set) of the wanted nodes, each from one of its texts."""
        first = cut(wanted.select("node").distinct().join(nodes.select("node", "first"), "node").select("node", "first"))
        read = texts.join(first.select("first"), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").mapInArrow(_sets(k), "node binary, set array<bigint>")
        return read.join(first.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        common = joined.withColumn("common", F.size(F.array_intersect("x", "y")))
        return common.filter(F.col("common") * 100 >= (F.size("x") + F.size("y") - F.col("common")) * percent).select("a", "b")

    flat = met.select("key", F.lit(0).alias("tile"), F.lit(0).alias("side"), "node", F.col("node").alias("root"), "c")
    pairs = cut(tiles(flat.filter(F.col("c") <= SMALL).drop("c")).mapInArrow(_pairs(percent, False), found))
    ends = lambda p: p.select(F.col("a").alias("node")).union(p.select("b"))
    middle = flat.filter((F.col("c") > SMALL) & (F.col("c") <= LARGE)).drop("c")
    sets = sets_of(ends(pairs).union(middle.select("node")))
    links = verified(pairs, sets).union(tiles(middle, sets).mapInArrow(_pairs(percent, True), found))
    labels = None
    if not sizes.filter(F.col("c") > LARGE).isEmpty():
        large = met.filter(F.col("c") > LARGE).select("key", "node", F.col("node").alias("root"), "c")
        firsts = cut(large.groupBy("node").agg(F.min("key").alias("key"))).withColumn("root", F.col("node"))  # the highest byte of a key is its band
        held = written(sets_of(large.select("node")))  # every round needs them
        stars = tiles(leader_tiles(large, firsts, "leader 0"), held).mapInArrow(_pairs(percent, True, first=False), found)
        labels = cut(components(nodes, links.union(stars)))
        for i in range(1, ROUNDS + 1):
            tagged = cut(large.drop("root").join(labels.select("node", "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "c"))
            mixed, outside = outsiders(tagged)
            if mixed.isEmpty():
                break
            if i < ROUNDS:  # another bucket and other leaders for every node outside
                one = cut(outside.groupBy("node", "root").agg(F.min_by("key", F.xxhash64("key", "node", F.lit(i))).alias("key")))
                dealt = leader_tiles(tagged, one, f"leader {i}")
            else:
                dealt = residual_tiles(tagged, mixed)
            more = cut(tiles(dealt, held).mapInArrow(_pairs(percent, True, first=i == ROUNDS), found))
            if not more.isEmpty():
                labels = _moved(labels, components(nodes, more))
    if labels is None:
        labels = components(nodes, links)
    named = cut(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "first").alias("component_id")))
    component = F.coalesce("component_id", "doc_id")
    return sk.join(named, "node", "left").select("doc_id", "row", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 x intersection >= ``percent`` x union.
    """
    return _labelled(docs, k, percent).drop("row")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; groups as in near_duplicates.

    A row is told by doc_id and text, so of a repeated or null doc_id only the rows go whose own text is a copy.
    """
    dropped = _labelled(docs, k, percent).filter("not kept").select("doc_id", "row").distinct().alias("dropped")
    same = F.col("docs.doc_id").eqNullSafe(F.col("dropped.doc_id")) & (F.xxhash64("docs.text") == F.col("dropped.row"))
    return docs.alias("docs").join(dropped, same, "left_anti")
