"""The prefix trie of all conversations, merged family first.

A conversation is rebuilt from its family's base: the base's first h turns, then
its own turns after its first h.  Conversations of one family share beginnings, so:

1. Rows are shuffled once by base id and sorted, which brings a family's
   conversations together (base first, turns in order).  A task walks them as a
   stream and keeps the family's trie of hashed nodes only: a node is named by 128
   bits of a SHA-256 chain over the lengths and bytes of roles and texts, so texts end
   here.  A family of more than ``HELD`` nodes is handed on in parts.
2. The families' nodes, each with the members that it has there, are merged by name:
   smallest member, number of members, and the bytes from the root.  Children are
   counted by parent.
3. Sums over subtrees need no walk down the trie.  The members of a node u are the
   conversations that pass u, and each node is owned by its smallest member, whose
   owned nodes are the end of its path.  With pre(u) the bytes above u and shared(c)
   the bytes of c's path that others own, the subtree of u saves the sum over its
   members of max(0, shared(c) - pre(u)), and its leaves are the members that own the
   leaf at which they end.  Both are sums over members, so the family nodes meet a
   few numbers of their own conversations (by base id) and are merged once more.
4. ``ends_sha256`` hashes a sorted list.  Pairs of node and conversation are
   range-partitioned by both, each range joins its ids to pieces of about ``PIECE``
   bytes, and pieces of a node are hashed one after another; a node at which a third
   of all conversations end sends few rows.

The smallest member of the parent is looked up with a broadcast of the parents that
have more than ``nodes / (HEAVY x partitions)`` children (so ``HEAVY x partitions`` rows
at most) and a join of the others.

Defined cases: rows without conv_id belong to no conversation; null role or text is
empty; a null turn comes first, and rows of equal turn are ordered by role, then text;
repeated rows are turns like others; a remainder has the sign of conv_id, so base ids
of negative conversations lie above them; a conversation whose base is absent and that
has no turn after its first h is turnless and ends at the root; an empty table has no
node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.shared import written

#: Conversations of a family: ids with the same conv_id - conv_id % FAMILY.
FAMILY = 5
#: h is crc32(conv_id) % HEADS, so a base lends up to HEADS - 1 turns.
HEADS = 9
#: Nodes of a family that a task holds before it hands them on.
HELD = 100_000
#: Bytes of conversation ids that travel as one row.
PIECE = 1 << 16
#: Parents with more than nodes / (HEAVY x partitions) children are broadcast.
HEAVY = 8

_NODES = "base long, k1 long, k2 long, p1 long, p2 long, depth long, bytes long, total long, convs array<long>, ends array<long>"
_ROOT = hashlib.sha256(b"root").digest()


def _named(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def _turn(role: str, text: str) -> tuple[bytes, int]:
    """A turn's hash and the bytes of its text."""
    r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
    return hashlib.sha256(len(r).to_bytes(8, "little") + r + t).digest(), len(t)


class _Family:
    """The trie of one family's conversations, filled path by path."""

    def __init__(self, base: int):
        self.base = base
        self.head: list[tuple[bytes, int]] = []  # the base's first turns
        self.nodes: dict[bytes, tuple] = {}

    def begin(self, conv: int) -> None:
        self.conv, self.seen = conv, 0
        self.lent = 0 if conv == self.base else zlib.crc32(str(conv).encode()) % HEADS
        self.name, self.above, self.depth, self.size, self.total = _ROOT, (None, None), 0, 0, 0
        self._node()[4].append(conv)
        for turn in self.head[: self.lent]:
            self._step(*turn)

    def turn(self, role: str, text: str) -> None:
        self.seen += 1
        if self.seen > self.lent:
            turn = _turn(role, text)
            if self.conv == self.base and len(self.head) < HEADS - 1:
                self.head.append(turn)
            self._step(*turn)

    def end(self) -> None:
        self._node()[5].append(self.conv)

    def _step(self, digest: bytes, size: int) -> None:
        self.above = _named(self.name)
        self.name = hashlib.sha256(self.name + digest).digest()
        self.depth, self.size, self.total = self.depth + 1, size, self.total + size
        self._node()[4].append(self.conv)

    def _node(self) -> tuple:
        """The present node: parent, depth, bytes of its text, bytes from the root, members and those of them that end here."""
        if self.name not in self.nodes:
            self.nodes[self.name] = (self.above, self.depth, self.size, self.total, [], [])
        return self.nodes[self.name]

    def rows(self) -> list[tuple]:
        out = [(self.base, *_named(k), *above, depth, size, total, convs, ends) for k, (above, depth, size, total, convs, ends) in self.nodes.items()]
        self.nodes = {}
        return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to the nodes of families."""
    schema = pa.schema([(n, pa.list_(pa.int64()) if "array" in t else pa.int64()) for n, t in (x.split() for x in _NODES.split(", "))])
    family, conv, done = None, None, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for rows in batches:
        for base, c, role, text in zip(*(rows.column(n).to_pylist() for n in ("base", "conv", "role", "text"))):
            if c != conv:
                if family is not None:
                    family.end()
                if family is None or base != family.base:
                    done += family.rows() if family is not None else []
                    family = _Family(base)
                conv = c
                family.begin(c)
            family.turn(role, text)
            if len(family.nodes) >= HELD:
                done += family.rows()
            if len(done) >= 20_000:
                yield batch()
    if family is not None:
        family.end()
        done += family.rows()
    if done:
        yield batch()


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every family: base, name (k1, k2), parent's name (p1, p2), depth, bytes, total (bytes from the root), convs and ends (members that end here)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text")).filter("conv IS NOT NULL")
    turns = turns.withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(partitions, "base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("base", "conv", "role", "text").mapInArrow(_walk, _NODES)


def _merged(nodes: DataFrame) -> DataFrame:
    """All families' nodes by name, with the number of children (null: none)."""
    once = nodes.groupBy("k1", "k2").agg(
        F.min(F.array_min("convs")).alias("conv_id"),
        F.sum(F.size("convs").cast("long")).alias("n_convs"),
        *[F.max(c).alias(c) for c in ("p1", "p2", "depth", "bytes", "total")],
    )
    once = written(once)
    children = once.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    return written(once.join(children, ["k1", "k2"], "left"))


def _sums(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens by name."""
    own = merged.groupBy(F.col("conv_id").alias("conv")).agg(F.min(F.col("total") - F.col("bytes")).alias("shared"), F.sum(F.col("n_children").isNull().cast("long")).alias("leaf"))
    ends = nodes.select("base", "total", F.explode("ends").alias("conv"))
    known = ends.join(own, "conv", "left").select("base", "conv", F.struct(F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")).alias("x"))
    families = known.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("conv", "x"))).alias("known"))
    there = nodes.select("base", "k1", "k2", (F.col("total") - F.col("bytes")).alias("above"), "convs").join(families, "base")
    zero = F.lit(0).cast("long")
    return there.groupBy("k1", "k2").agg(
        F.sum(F.aggregate("convs", zero, lambda a, c: a + F.greatest(zero, F.col("known")[c]["shared"] - F.col("above")))).alias("saved_tokens"),
        F.sum(F.aggregate("convs", zero, lambda a, c: a + F.col("known")[c]["leaf"])).alias("n_leaves"),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv) to pieces of ids: name, first conv of the piece, decimal ids joined by commas."""
    names, key, held, size, out = ["k1", "k2", "first", "ids"], None, [], 0, []

    def close():
        nonlocal held, size
        if held:
            out.append((*key, held[0], ",".join(map(str, held))))
        held, size = [], 0

    def batch():
        rows = [pa.array(c) for c in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, names=names)

    for rows in batches:
        for k1, k2, conv in zip(*(rows.column(n).to_pylist() for n in ("k1", "k2", "conv"))):
            if (k1, k2) != key or size >= PIECE:
                close()
                key = (k1, k2)
            held.append(conv)
            size += len(str(conv)) + 1
        if len(out) >= 256:
            yield batch()
    close()
    if out:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one SHA-256 a name."""
    key, state, out = None, None, []

    def batch():
        rows = [pa.array(c) for c in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, names=["k1", "k2", "ends_sha256"])

    for rows in batches:
        for k1, k2, ids in zip(*(rows.column(n).to_pylist() for n in ("k1", "k2", "ids"))):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= 4096:
            yield batch()
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield batch()


def _ends(nodes: DataFrame, partitions: int) -> DataFrame:
    """ends_sha256 by name, for nodes at which a conversation ends."""
    pairs = nodes.select("k1", "k2", F.explode("ends").alias("conv")).repartitionByRange(partitions, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    pieces = pairs.mapInArrow(_pieces, "k1 long, k2 long, first long, ids string")
    together = pieces.repartition(partitions, "k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ids")
    return together.mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")


def _parents(merged: DataFrame, partitions: int) -> DataFrame:
    """``merged`` with parent_conv_id."""
    total = merged.count()
    owners = merged.filter("n_children IS NOT NULL").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("owner"), "n_children")
    most = total // (HEAVY * partitions)
    heavy = owners.filter(F.col("n_children") > most).select("p1", "p2", F.col("owner").alias("heavy"))
    light = owners.filter(F.col("n_children") <= most).select("p1", "p2", F.col("owner").alias("light"))
    found = merged.join(F.broadcast(heavy), ["p1", "p2"], "left")
    # children of heavy parents look for their own name, which spreads them and is no light parent's or is not used
    alone = F.col("heavy").isNotNull() | F.col("p1").isNull()
    found = found.withColumn("p1", F.when(alone, F.col("k1")).otherwise(F.col("p1"))).withColumn("p2", F.when(alone, F.col("k2")).otherwise(F.col("p2")))
    found = found.join(light, ["p1", "p2"], "left")
    return found.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("heavy", "light")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = written(family_nodes(conversations))
    merged = _merged(nodes)
    out = _parents(merged, partitions).join(_sums(nodes, merged), ["k1", "k2"]).join(_ends(nodes, partitions), ["k1", "k2"], "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
