"""t-SNE in two dimensions, iterated on Spark.

* Affinities are sparse: each row's ``3 x perplexity`` exact nearest neighbours, with the
  width of its kernel found by bisection, made symmetric by one aggregation.
* Rows are numbered and dealt to blocks, and pairs to cells of two blocks, packed as arrays.
  Attraction joins the cells with the broadcast positions of their two blocks (16 bytes a
  row) and adds up by block.  Beyond ``SHARED`` rows it is a join of single pairs with the
  positions and a sum by row.
* Repulsion is interpolated on a regular grid.  Every row spreads its charges (1, x, y)
  over the 3 x 3 nodes of its cell, charges are summed by node, and the potentials of
  all nodes follow from one convolution with the two kernels (FFT); each row reads them
  back from its own nodes.  Cells are a ``FINE``-th of the map wide, but not wider than
  ``WIDEST`` (the kernels' scale is 1), while the map is at most ``CELLS`` cells wide, and
  wider beyond.  So the grid is bounded whatever the number of rows, and with it what
  passes through the driver and is broadcast.

An iteration costs the pairs, the rows and the bounded grid, in two jobs: one moves the rows
and spreads their new charges, the other sums the charges; the neighbours are the search
of ``knn``.  Positions are written in every iteration, so no lineage grows, and the table
before is deleted; the driver sees sums by node, and Spark's broadcast of the positions.

Defined cases: rows of equal vectors attract each other at distance 0 and part by their
start positions; ids must be unique; an empty table gives none, one row lies at 0, 0; a
table of few rows takes all others as neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import cluster, knn
from skyloom.sources import scratch

#: Cells of the grid along a side at most, and nodes of a cell along a side.
CELLS, NODES = 256, 3
#: Cells along a side of a small map, and how wide they are in a larger one.
FINE, WIDEST = 50, 0.5
#: Factor of the affinities in the first iterations.
EXAGGERATION = 12.0
#: Pairs of a stored part, some 24 MB.
PART = 1 << 20
#: Rows of a block at most (its places take 16 bits), and rows up to which blocks' positions are broadcast.
BLOCK, SHARED = 1 << 16, 1 << 23


def _bisected(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows of conditional affinities with the given perplexity."""
    d2 = d2 - d2.min(axis=1, keepdims=True)
    low, high = np.zeros(len(d2)), np.full(len(d2), np.inf)
    beta = 1 / np.maximum(d2.mean(axis=1), 1e-12)
    for _ in range(64):
        p = np.exp(-d2 * beta[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + beta * (d2 * p).sum(axis=1) / total
        wide = entropy > np.log(perplexity)  # too many neighbours count
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), np.minimum(beta * 2, 1e300), (low + high) / 2)
    return p / total[:, None]


def affinities(near: DataFrame, perplexity: float) -> DataFrame:
    """(i, j, p): symmetric affinities of pairs from near(test_id, train_id, d2), before the division by twice the number of rows."""
    kind = dict(near.dtypes)["test_id"]
    lists = near.groupBy("test_id").agg(F.sort_array(F.collect_list(F.struct("d2", "train_id"))).alias("x")).select(F.col("test_id").alias("i"), F.col("x.train_id").alias("j"), F.col("x.d2").alias("d2"))

    def run(frames):
        for f in frames:
            for n, some in f.groupby(f["j"].map(len)):  # few different lengths
                p = _bisected(np.array(some["d2"].tolist(), dtype=float), min(perplexity, max(n / 3, 1.0)))
                yield pd.DataFrame({"i": some["i"], "j": some["j"], "p": list(p)})

    one = lists.mapInPandas(run, f"i {kind}, j array<{kind}>, p array<double>").select("i", F.explode(F.arrays_zip("j", "p")).alias("x")).select("i", F.col("x.j").alias("j"), F.col("x.p").alias("p"))
    # both directions of a row at once, so that nothing before is run twice
    both = one.select(F.explode(F.array(F.struct("i", "j", "p"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "p"))).alias("x")).select("x.*")
    return both.groupBy("i", "j").agg(F.sum("p").alias("p"))


def _weights(x: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The first of the ``NODES`` nodes of each coordinate's cell, and the weights of the cell's nodes (Lagrange)."""
    cell = np.floor(x / width).astype(np.int64)
    at = x / width - cell
    nodes = (np.arange(NODES) + 0.5) / NODES
    w = np.ones((len(x), NODES))
    for a in range(NODES):
        for b in range(NODES):
            if a != b:
                w[:, a] *= (at - nodes[b]) / (nodes[a] - nodes[b])
    return cell * NODES, w


def charges(x: np.ndarray, y: np.ndarray, width: float) -> pd.DataFrame:
    """(a, b, q, qx, qy): summed charges by node."""
    (ax, wx), (ay, wy) = _weights(x, width), _weights(y, width)
    a = np.repeat(ax[:, None, None] + np.arange(NODES)[None, :, None], NODES, axis=2).ravel()
    b = np.repeat(ay[:, None, None] + np.arange(NODES)[None, None, :], NODES, axis=1).ravel()
    w = (wx[:, :, None] * wy[:, None, :]).ravel()
    span = int(b.max()) - int(b.min()) + 1
    nodes, own = np.unique((a - a.min()) * span + (b - b.min()), return_inverse=True)
    sums = [np.bincount(own, w * q, len(nodes)) for q in (1.0, np.repeat(x, NODES * NODES), np.repeat(y, NODES * NODES))]
    return pd.DataFrame({"a": nodes // span + a.min(), "b": nodes % span + b.min()} | dict(zip(("q", "qx", "qy"), sums)))


def _size(n: int) -> int:
    """The least number from 2 * n on that has no factor but 2, 3 and 5 and is divisible by 2."""
    found = [2 ** (i + 1) * 3**j * 5**k for i in range(12) for j in range(5) for k in range(4)]
    return min(f for f in found if f >= 2 * n)


@lru_cache(maxsize=2)
def _kernels(full: tuple[int, int], step: float) -> tuple[np.ndarray, np.ndarray]:
    """Transforms of the two kernels on a grid with nodes ``step`` apart: 1 / (1 + d2), and its square."""
    steps = [np.minimum(np.arange(n), n - np.arange(n)) * step for n in full]
    near = 1 / (1 + steps[0][:, None] ** 2 + steps[1][None, :] ** 2)
    return np.fft.rfft2(near), np.fft.rfft2(near**2)


class Field:
    """Potentials of all charges at the nodes of a grid, and the normaliser Z."""

    def __init__(self, summed: pd.DataFrame, width: float, rows: int):
        self.width = width
        self.a, self.b = int(summed["a"].min()), int(summed["b"].min())
        shape = (int(summed["a"].max()) - self.a + 1, int(summed["b"].max()) - self.b + 1)
        q = np.zeros((3, *shape))
        q[:, summed["a"] - self.a, summed["b"] - self.b] = summed[["q", "qx", "qy"]].to_numpy().T
        full = tuple(_size(n) for n in shape)
        once, twice = _kernels(full, width / NODES)
        spectrum = np.fft.rfft2(q, full)
        self.square = np.fft.irfft2(spectrum * twice, full)[:, : shape[0], : shape[1]]
        # the sum of the charges times their potentials, by the spectrum; all but its first and last column stand for two
        power = (spectrum[0].real ** 2 + spectrum[0].imag ** 2) * once.real
        total = (2 * power.sum() - power[:, 0].sum() - power[:, -1].sum()) / (full[0] * full[1])
        self.z = max(float(total) - rows, 1e-12)  # without the rows' own terms

    def repulsion(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (ax, wx), (ay, wy) = _weights(x, self.width), _weights(y, self.width)
        a = ax[:, None] - self.a + np.arange(NODES)
        b = ay[:, None] - self.b + np.arange(NODES)
        s, sx, sy = (np.einsum("nij,ni,nj->n", field[a[:, :, None], b[:, None, :]], wx, wy) for field in self.square)
        return (x * s - sx) / self.z, (y * s - sy) / self.z


#: Columns of a row's state, or of a block's, packed: positions, speeds, gains.
STATE = ("x", "y", "ux", "uy", "gx", "gy")
PACKED = "b int, " + ", ".join(f"{c} binary" for c in STATE)
NODE = {"a": "bigint", "b": "bigint", "q": "double", "qx": "double", "qy": "double"}
NODES_SCHEMA = ", ".join(f"n{c} array<{kind}>" for c, kind in NODE.items())


class _Charges:
    """Charges of a task's rows, summed by node frame by frame."""

    def __init__(self, width: float):
        self.width, self.held = width, None

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        mine = charges(x, y, self.width)
        self.held = mine if self.held is None else pd.concat([self.held, mine]).groupby(["a", "b"], as_index=False).sum()

    def cells(self) -> dict[str, np.ndarray]:
        """The columns of ``NODES_SCHEMA`` for one row."""
        return {f"n{c}": self.held[c].to_numpy() for c in NODE}


def _spread(state: DataFrame, width: float) -> DataFrame:
    """``NODES_SCHEMA``: the charges of ``state`` in cells of ``width``, a row a task."""

    def run(frames):
        held = _Charges(width)
        for f in frames:
            if len(f):
                held.add(f["x"].to_numpy(), f["y"].to_numpy())
        if held.held is not None:
            yield pd.DataFrame({c: [v] for c, v in held.cells().items()})

    return state.select("x", "y").mapInPandas(run, NODES_SCHEMA)


def _summed(nodes: DataFrame) -> pd.DataFrame:
    """Charges by node of all tasks; at most the nodes of the grid."""
    each = nodes.filter("na is not null").select(F.inline(F.arrays_zip(*[F.col(f"n{c}").alias(c) for c in NODE])))
    return each.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("q", "qx", "qy")]).toArrow().to_pandas()


def attraction(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """``state`` with the attractive part (fx, fy) of each row's gradient."""
    there = state.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    met = pairs.join(state.withColumnRenamed("id", "i"), "i").join(there, "j")
    dx, dy = F.col("x") - F.col("xj"), F.col("y") - F.col("yj")
    k = F.col("p") / (1 + dx * dx + dy * dy)
    own = [F.first(c).alias(c) for c in state.columns if c != "id"]  # the same in all rows of i
    return met.groupBy(F.col("i").alias("id")).agg(*own, F.sum(k * dx).alias("fx"), F.sum(k * dy).alias("fy"))


def _stepped(at: dict[str, np.ndarray], field: Field, rate: float, momentum: float, factor: float) -> dict[str, np.ndarray]:
    """Positions, speeds and gains of rows after one step; ``at`` has the same and fx, fy."""
    out = {}
    for c, r in zip(("x", "y"), field.repulsion(at["x"], at["y"])):
        grad = 4 * (factor * at[f"f{c}"] - r)
        u, gain = at[f"u{c}"], at[f"g{c}"]
        gain = np.maximum(np.where((grad > 0) != (u > 0), gain + 0.2, gain * 0.8), 0.01)
        u = momentum * u - rate * gain * grad
        out |= {c: at[c] + u, f"u{c}": u, f"g{c}": gain}
    return out


def _moved(field, rate: float, momentum: float, factor: float, width: float):
    """Map: one step of all rows; the last row of a task has its rows' charges in cells of ``width``."""

    def run(frames):
        held, last = _Charges(width), None
        for f in frames:
            if not len(f):
                continue
            at = {c: f[c].to_numpy() for c in (*STATE, "fx", "fy")}
            out = {"id": f["id"]} | _stepped(at, field.value, rate, momentum, factor)
            held.add(out["x"], out["y"])
            if last is not None:
                yield last
            last = pd.DataFrame(out).assign(**{f"n{c}": None for c in NODE})
        if last is not None:
            for c, v in held.cells().items():
                last.at[len(last) - 1, c] = v
            yield last

    return run


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The pairs of a cell (ib, jb) as arrays: places in the two blocks and affinities, sorted by row."""
    at, to, p = (np.asarray(table.column(c)) for c in ("at", "to", "p"))
    order = np.lexsort((to, at))
    packed = at[order].astype(np.uint16), to[order].astype(np.uint16), p[order]
    return pa.table({**{c: pa.array([x.as_py()], pa.int32()) for c, x in zip(("ib", "jb"), key)}, **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("at", "to", "p"), packed)}})


def packed_pairs(pairs: DataFrame, block: int) -> DataFrame:
    """(ib, jb, at, to, p): pairs(i, j, p) of numbered rows by cell of two blocks of ``block`` rows."""
    i, j = (F.col(c) for c in ("i", "j"))
    placed = pairs.select(F.floor(i / block).cast("int").alias("ib"), F.floor(j / block).cast("int").alias("jb"), (i % block).cast("int").alias("at"), (j % block).cast("int").alias("to"), "p")
    return placed.groupBy("ib", "jb").applyInArrow(_pack, "ib int, jb int, at binary, to binary, p binary")


def _pulled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map: the attractive part of the gradient by block, summed over the cells of a batch of rows."""
    for batch in batches:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row in range(batch.num_rows):
            xi, yi, xj, yj, p = (np.frombuffer(batch.column(c)[row].as_buffer()) for c in ("xi", "yi", "xj", "yj", "p"))
            at, to = (np.frombuffer(batch.column(c)[row].as_buffer(), np.uint16) for c in ("at", "to"))
            dx, dy = xi[at] - xj[to], yi[at] - yj[to]
            k = p / (1 + dx * dx + dy * dy)
            sums = held.setdefault(batch.column("ib")[row].as_py(), (np.zeros(len(xi)), np.zeros(len(xi))))
            for to_, d in zip(sums, (dx, dy)):
                to_ += np.bincount(at, k * d, len(xi))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *[pa.array([v[c].tobytes() for v in held.values()], pa.binary()) for c in (0, 1)]], names=["b", "fx", "fy"])


def pulled(state: DataFrame, cells: DataFrame) -> DataFrame:
    """(b, fx, fy): the attractive part of the gradient by block of the packed ``state``; a block may have several rows, which add up."""
    positions, met = F.broadcast(state.select("b", "x", "y")), cells
    for side in ("i", "j"):
        met = met.join(positions.select(F.col("b").alias(f"{side}b"), F.col("x").alias(f"x{side}"), F.col("y").alias(f"y{side}")), f"{side}b")
    return met.select("ib", "at", "to", "p", "xi", "yi", "xj", "yj").mapInArrow(_pulled, "b int, fx binary, fy binary")


def _moved_block(field, rate: float, momentum: float, factor: float, width: float):
    """Group of a block's state and the parts of its attraction: one step, and the new positions' charges in cells of ``width``."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = int(np.flatnonzero(np.asarray(table.column("x").is_valid()))[0])
        at = {c: np.frombuffer(table.column(c)[own].as_buffer()) for c in STATE}
        for c in ("fx", "fy"):
            at[c] = sum((np.frombuffer(f.as_buffer()) for f in table.column(c).drop_null()), np.zeros(len(at["x"])))
        out = _stepped(at, field.value, rate, momentum, factor)
        nodes = charges(out["x"], out["y"], width)
        arrays = {f"n{c}": pa.array([nodes[c].to_numpy()], pa.list_(pa.int64() if kind == "bigint" else pa.float64())) for c, kind in NODE.items()}
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([out[c].tobytes()], pa.binary()) for c in STATE}, **arrays})

    return run


def moved_blocks(state: DataFrame, cells: DataFrame, step) -> DataFrame:
    """The packed state and its charges after ``step`` (of ``_moved_block``)."""
    own = state.select("b", *STATE, *[F.lit(None).cast("binary").alias(c) for c in ("fx", "fy")])
    parts = pulled(state, cells).select("b", *[F.lit(None).cast("binary").alias(c) for c in STATE], "fx", "fy")
    return own.unionByName(parts).groupBy("b").applyInArrow(step, f"{PACKED}, {NODES_SCHEMA}")


def packed_state(start: DataFrame, block: int) -> DataFrame:
    """The packed state of start(i, x, y), rows at rest, a row a block; rows lie in the order of their numbers, without gaps."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("i")))
        at = [np.asarray(table.column(c), dtype=float)[order] for c in ("x", "y")]
        still, ones = np.zeros(len(order)), np.ones(len(order))
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(STATE, (*at, still, still, ones, ones))}})

    return start.groupBy(F.floor(F.col("i") / block).cast("int").alias("b")).applyInArrow(run, PACKED)


def unpacked(state: DataFrame, block: int) -> DataFrame:
    """(i, x, y) of the packed state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[row].as_buffer()) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("b")[row].as_py() * block + np.arange(len(x))), pa.array(x), pa.array(y)], names=["i", "x", "y"])

    return state.select("b", "x", "y").mapInArrow(run, "i long, x double, y double")


def embedded(df: DataFrame, perplexity: float = 30.0, iterations: int = 250, early: int = 100, rate: float | None = None) -> DataFrame:
    """(id, x, y) of df(id, v): a map of the rows that keeps their neighbourhoods.

    The first ``early`` iterations exaggerate the affinities; ``rate`` is rows / (4 x exaggeration), 50 at least, where none is given.
    The map starts from the principal components.
    """
    spark = df.sparkSession
    rows = cluster.numbered(df.select("id", "v"), ["id"], "i")
    n = rows.count()
    if n < 2:
        return rows.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    k = min(int(3 * perplexity), n - 1)
    near = knn.neighbours(rows.select(F.col("i").alias("test_id"), "v"), rows.select(F.col("i").alias("train_id"), F.lit(0).alias("label"), "v"), k + 1)
    near = scratch.written(near.filter("test_id <> train_id").filter(F.col("place") <= k + 1), "tsne")
    sums = affinities(near, perplexity).withColumn("p", F.col("p") / (2 * n))
    start = cluster.projected(rows, 2).select("i", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
    spread = start.agg(F.stddev("x")).first()[0] or 1.0
    start = start.select("i", *[(F.col(c) / spread * 1e-4).alias(c) for c in ("x", "y")])
    cores = spark.sparkContext.defaultParallelism  # as many parts as there are cores at least, so that every iteration is dealt out
    packed, block = n <= SHARED, min(BLOCK, -(-n // cores))
    if packed:
        pairs = scratch.written(packed_pairs(sums, block).repartition(-(-n // block), "ib"), "tsne")
        state = scratch.written(packed_state(start, block), "tsne")
    else:
        pairs = scratch.written(sums.repartition(max(cores, -(-2 * k * n // PART)), "i").sortWithinPartitions("i"), "tsne")
        state = scratch.written(start.select(F.col("i").alias("id"), "x", "y", *[F.lit(v).alias(c) for c, v in zip(STATE[2:], (0.0, 0.0, 1.0, 1.0))]), "tsne")

    def placed(state: DataFrame) -> DataFrame:
        return unpacked(state, block) if packed else state.select(F.col("id").alias("i"), "x", "y")

    def after(state: DataFrame, *step) -> DataFrame:
        if packed:
            return moved_blocks(state, pairs, _moved_block(*step))
        return attraction(state, pairs).mapInPandas(_moved(*step), f"id long, {', '.join(f'{c} double' for c in STATE)}, {NODES_SCHEMA}")

    rate = rate or max(n / EXAGGERATION / 4, 50.0)
    least, most = (placed(state).agg(f("x"), f("y")).first() for f in (F.min, F.max))
    side = max(most[0] - least[0], most[1] - least[1])
    width = min(WIDEST, side / FINE) or WIDEST
    nodes = _spread(placed(state), width)
    for step in range(iterations):
        summed = _summed(nodes)
        while max(summed[c].max() - summed[c].min() for c in ("a", "b")) >= CELLS * NODES:
            width *= 2
            summed = _summed(_spread(placed(state), width))
        side = max(summed[c].max() - summed[c].min() + 1 for c in ("a", "b")) * width / NODES
        field = spark.sparkContext.broadcast(Field(summed, width, n))
        width = min(WIDEST, side / FINE) or WIDEST
        before, table = state, scratch.written(after(state, field, rate, 0.5 if step < early else 0.8, EXAGGERATION if step < early else 1.0, width), "tsne")
        state, nodes = table.select(*before.columns), table.select(*[f"n{c}" for c in NODE])
        scratch.removed(before)
        field.destroy()
    return rows.select("id", "i").join(placed(state), "i").select("id", "x", "y")


def preserved(df: DataFrame, mapped: DataFrame, k: int = 10) -> DataFrame:
    """(id, share): the part of each row's ``k`` nearest rows by ``v`` that is among its ``k`` nearest on the map."""

    def pairs(rows: DataFrame) -> DataFrame:
        near = knn.neighbours(rows.select(F.col("id").alias("test_id"), "v"), rows.select(F.col("id").alias("train_id"), F.lit(0).alias("label"), "v"), k + 1)
        return near.filter("test_id <> train_id").filter(F.col("place") <= k + 1).select("test_id", "train_id")

    kept = pairs(df.select("id", "v")).join(pairs(mapped.select("id", F.array("x", "y").alias("v"))), ["test_id", "train_id"], "left_semi")
    counts = kept.groupBy(F.col("test_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return df.select("id").join(counts, "id", "left").select("id", (F.coalesce("n", F.lit(0)) / k).alias("share"))
