"""Scaling, exact nearest neighbours and voting on embeddings.

Up to ``BLOCK_NUMBERS`` numbers of training vectors are one block, and every pack of test
rows meets it.  Beyond, the training rows are dealt to cells, each of the rows nearest to
one pivot; pivots are a sample of bounded size.  A cell keeps its number of rows and its covering radius, so by the
triangle inequality no row of a cell is nearer to a test row t than d(t, pivot) - radius.

1. Every test row meets the cells nearest to it until these hold k rows.
2. The k-th distance found bounds the search, and so does the k-th over the cells of a block: it meets, of the other cells, only those
   whose least possible distance is not above it.

Cells lie one after another in blocks of bounded size: small cells share a block, and one of
many rows is dealt over several by hash, so a third of all rows around one pivot makes many
tasks.  Test rows are dealt to packs, and a task has a pack and a block; a test row travels
once to every block that has a cell which it meets, a training row once to every pack.
Results are exact; how many pairs of test row and training row are looked at depends on the
data (``pairs_met``), what is shuffled at most on the numbers of packs and blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import vectors
from skyloom.sources import scratch

#: Numbers of the training vectors that one block holds at most: 16 MB of doubles.
BLOCK_NUMBERS = 2_000_000
#: Test rows that are measured against a block at once, in expectation.
PACK = 64
#: Packs of test rows over cells, and blocks, at least: a block has up to ``BLOCK_NUMBERS`` numbers, and so has a pack.
GRID = 8
#: Numbers of a table of distances at most: 32 MB.
TABLE = 4_000_000
#: Pivots at most, and numbers that they hold at most: they are broadcast.
PIVOTS, PIVOT_NUMBERS = 1024, 2_000_000


def scaler_state(df: DataFrame, vector: str = "v") -> DataFrame:
    """(d, n, m, m2) by dimension: count, mean and sum of squared deviations.  Partial sums by dimension, one small shuffle."""
    long = df.select(F.posexplode(vectors.doubles(F.col(vector))).alias("d", "x"))
    return long.groupBy("d").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("m2"))


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows from the states of parts of them, such as batches that came one after another."""
    every = reduce(DataFrame.unionByName, states)
    total = every.groupBy("d").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    parts = every.select("d", F.col("n").alias("_n"), F.col("m").alias("_m"), F.col("m2").alias("_m2"))
    apart = F.col("_m2") + F.col("_n") * (F.col("_m") - F.col("m")) * (F.col("_m") - F.col("m"))
    return parts.join(total, "d").groupBy("d", "n", "m").agg(F.sum(apart).alias("m2"))


def scaler_of(state: DataFrame) -> DataFrame:
    """One row: arrays ``mean`` and ``scale`` by dimension; population deviation, 1 where it is 0."""
    ordered = F.array_sort(F.collect_list(F.struct("d", "m", F.sqrt(F.col("m2") / F.col("n")).alias("s"))))
    return state.agg(ordered.alias("p")).select(F.col("p.m").alias("mean"), F.transform("p.s", lambda s: F.when(s == 0, 1.0).otherwise(s)).alias("scale"))


def fit_scaler(df: DataFrame, vector: str = "v") -> DataFrame:
    """The scaler of all rows of ``df``."""
    return scaler_of(scaler_state(df, vector))


def apply_scaler(df: DataFrame, scaler: DataFrame, vector: str = "v") -> DataFrame:
    """Vectors less the mean, by the scale.  The scaler is one row."""
    z = F.zip_with(F.zip_with(vectors.doubles(F.col(vector)), F.col("mean"), lambda x, m: x - m), F.col("scale"), lambda x, s: x / s)
    return df.crossJoin(F.broadcast(scaler)).withColumn(vector, z).drop("mean", "scale")


def _nearest(k: int):
    """Arrow map: rows (pack of test rows, block of training rows) to the block's k nearest of each test row.

    One matrix product gives all distances of a pack; those near the k-th are taken again exactly, so that ties are ties.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tests, block = batch.column("pack")[i].values, batch.column("block")[i].values
                if not len(block):
                    continue
                ids = np.asarray(block.field("train_id"))
                x, y = (_matrix(c.field("v")) for c in (tests, block))
                far = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
                rough = far - 2 * (x @ y.T)
                most = np.partition(rough, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
                row, near = np.nonzero(rough <= most[:, None] + 1e-9 + 1e-12 * far.max())
                d = ((y[near] - x[row]) ** 2).sum(axis=1).round(9)
                order = np.lexsort((ids[near], d, row))
                row, near, d = row[order], near[order], d[order]
                place = np.arange(len(row)) - np.searchsorted(row, row) + 1
                some = place <= k
                to, at = pa.array(row[some]), pa.array(near[some])
                yield pa.RecordBatch.from_arrays(
                    [tests.field("test_id").take(to), pa.array(ids).take(at), block.field("label").take(at), pa.array(d[some]), pa.array(place[some].astype(np.int32))],
                    names=["test_id", "train_id", "label", "d2", "place"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _number(x: str, parts) -> Column:
    return F.pmod(F.xxhash64(x), parts).cast("int")


def _merged_best(best: DataFrame, k: int) -> DataFrame:
    """The k nearest of each test row among the k nearest of each block."""
    ordered = F.array_sort(F.collect_list(F.struct("d2", "train_id", "label")))
    near = best.groupBy("test_id").agg(F.slice(ordered, 1, k).alias("near"))  # blocks that it met x k rows of a test row
    return near.select("test_id", F.posexplode("near").alias("p", "t")).select("test_id", "t.train_id", "t.label", "t.d2", (F.col("p") + 1).alias("place"))


def neighbours(test: DataFrame, train: DataFrame, k: int = 5, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(test_id, train_id, label, d2, place): the k nearest training rows of every test row.

    ``test`` has (test_id, v), ``train`` (train_id, label, v), ids unique.  Ties go to the smaller train_id.
    """
    v = vectors.doubles(F.col("v")).alias("v")
    test, train = scratch.written(test.select("test_id", v), "knn"), scratch.written(train.select("train_id", "label", v), "knn")
    size = train.agg(F.max(F.size("v")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    kinds = dict(train.dtypes) | dict(test.dtypes)
    schema = f"test_id {kinds['test_id']}, train_id {kinds['train_id']}, label {kinds['label']}, d2 double, place int"
    if (size.w or 1) * size.n > block_numbers:
        return Cells(train, size.w, size.n, block_numbers).nearest(test, k, schema)
    packs = max(1, -(-test.count() // PACK))
    pack = test.groupBy(_number("test_id", F.lit(packs)).alias("p")).agg(F.collect_list(F.struct("test_id", "v")).alias("pack"))
    block = train.agg(F.collect_list(F.struct("train_id", "label", "v")).alias("block"))
    return pack.crossJoin(F.broadcast(block)).select("pack", "block").mapInArrow(_nearest(k), schema)  # one row of bounded size


class Cells:
    """Training rows (written) by their nearest pivot: a metric index."""

    def __init__(self, train: DataFrame, width: int, rows: int, block_numbers: int = BLOCK_NUMBERS):
        self.spark = train.sparkSession
        self.width = max(width or 1, 1)
        count = max(1, min(PIVOTS, PIVOT_NUMBERS // self.width, int(rows**0.5)))
        sample = train.orderBy(F.xxhash64("train_id"), "train_id").limit(count).select("v").collect()
        pivots = np.unique(np.array([r["v"] for r in sample]), axis=0)
        self.pivots = self.spark.sparkContext.broadcast(pivots)
        kinds = dict(train.dtypes)
        rows_of = scratch.written(train.mapInArrow(self._dealt(), f"train_id {kinds['train_id']}, label {kinds['label']}, v array<double>, cell int, far double"), "knn")
        facts = rows_of.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()  # a row a pivot at most
        self.rows, self.radius = np.zeros(len(pivots), dtype=np.int64), np.full(len(pivots), -np.inf)
        for f in facts:
            self.rows[f["cell"]], self.radius[f["cell"]] = f["n"], f["r"]
        most = max(1, max(block_numbers, BLOCK_NUMBERS) // self.width)
        self.each = max(1, min(most, -(-rows // GRID)))
        self.facts = self.spark.sparkContext.broadcast((self.rows, self.radius))
        before, size = (F.array(*[F.lit(int(n)) for n in x]) for x in (np.cumsum(self.rows) - self.rows, self.rows))
        place = F.get(before, F.col("cell")) + F.pmod(F.xxhash64("train_id"), F.get(size, F.col("cell")))
        self.dealt = rows_of.select("train_id", "label", "v", "cell", F.floor(place / self.each).cast("int").alias("block"))

    def _dealt(self):
        pivots = self.pivots

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    far = _apart(_matrix(batch.column("v")), pivots.value)
                    cell = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "far"])

        return run

    def _cells(self, first: bool, k: int, counted: bool):
        """For every test row the cells that it meets: ``first`` those nearest to it that hold k rows, else the others that its bound ``most`` does not rule out.

        A row for each block that has some of them; or, ``counted``, (cell, n) of all meetings.
        """
        pivots, facts, each = self.pivots, self.facts, self.each

        def met_by(batch) -> np.ndarray:
            rows, radius = facts.value
            far = _apart(_matrix(batch.column("v")), pivots.value)
            order = np.argsort(far, axis=1, kind="stable")
            held = np.cumsum(rows[order], axis=1)
            met = np.zeros(far.shape, dtype=bool)
            np.put_along_axis(met, order, (held - rows[order] < k) & (rows[order] > 0), axis=1)
            if first:
                return met
            most = np.sqrt(np.asarray(batch.column("most").fill_null(np.inf)))
            return ~met & (rows > 0) & (far - radius <= (most * (1 + 1e-9) + 1e-6)[:, None])

        def run(batches):
            rows, _ = facts.value
            start = (np.cumsum(rows) - rows) // each
            end = np.where(rows > 0, (np.cumsum(rows) - 1) // each, -1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                met = met_by(batch)
                if counted:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(met.shape[1], dtype=np.int32)), pa.array(met.sum(axis=0, dtype=np.int64))], names=["cell", "n"])
                    continue
                for block in range(int(end.max()) + 1):
                    mine = met & (start <= block) & (end >= block)
                    at = np.flatnonzero(mine.any(axis=1))
                    if len(at):
                        _, cell = np.nonzero(mine[at])
                        offs = np.concatenate(([0], np.cumsum(mine[at].sum(axis=1)))).astype(np.int32)
                        cells = pa.ListArray.from_arrays(pa.array(offs), pa.array(cell.astype(np.int32)))
                        to = pa.array(at)
                        columns = [batch.column(c).take(to) for c in ("test_id", "v", "most")]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int32)), *columns, cells], names=["block", "test_id", "v", "most", "cells"])

        return run

    def _met(self, test: DataFrame, first: bool, k: int) -> DataFrame:
        """(block, test_id, v, most, cells) of all meetings of a step."""
        return test.mapInArrow(self._cells(first, k, False), f"block int, test_id {dict(test.dtypes)['test_id']}, v array<double>, most double, cells array<int>")

    def _compared(self, met: DataFrame, rows: int, k: int, schema: str) -> DataFrame:
        """The k nearest of each test row in each block, of the cells that it meets and within its bound; ``rows`` is the number of test rows."""
        packs = max(GRID, -(-rows * self.width // BLOCK_NUMBERS))
        tests = met.withColumn("pack", _number("test_id", F.lit(packs)))
        trains = self.dealt.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
        return tests.groupBy("block", "pack").cogroup(trains.groupBy("block", "pack")).applyInArrow(_nearest_in_cells(k), schema)

    def nearest(self, test: DataFrame, k: int, schema: str) -> DataFrame:
        """The k nearest rows of every test row (written)."""
        rows = test.count()
        best = scratch.written(self._compared(self._met(self._bounded(test, None, k), True, k), rows, k, schema), "knn")
        more = self._met(self._bounded(test, best, k), False, k)
        return _merged_best(best.unionByName(self._compared(more, rows, k, schema)), k)

    def _bounded(self, test: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
        """Test rows with ``most``, the k-th distance found; null where there is none."""
        if best is None:
            return test.select("test_id", "v", F.lit(None).cast("double").alias("most"))
        bound = _merged_best(best, k).filter(F.col("place") == k).select("test_id", F.col("d2").alias("most"))
        return test.join(bound, "test_id", "left").select("test_id", "v", "most")

    def met(self, test: DataFrame, k: int, schema: str) -> DataFrame:
        """(cell, n): the test rows that meet each cell in a search."""
        bare = self._bounded(test, None, k)
        best = scratch.written(self._compared(self._met(bare, True, k), test.count(), k, schema), "knn")
        steps = [rows.mapInArrow(self._cells(first, k, True), "cell int, n long") for rows, first in ((bare, True), (self._bounded(test, best, k), False))]
        return reduce(DataFrame.unionByName, steps).groupBy("cell").agg(F.sum("n").alias("n"))


def _nearest_in_cells(k: int):
    """Cogroup of a pack of test rows and a block of training rows: the block's k nearest of each test row among the cells that it meets."""
    names = ["test_id", "train_id", "label", "d2", "place"]

    def run(key: tuple[pa.Scalar, ...], tests: pa.Table, block: pa.Table) -> pa.Table:
        own = (tests.column("test_id").combine_chunks(), block.column("train_id").combine_chunks(), block.column("label").combine_chunks())
        row = near = np.zeros(0, dtype=np.int64)
        d = np.zeros(0)
        if tests.num_rows and block.num_rows:
            x, y = (_matrix(t.column("v").combine_chunks()) for t in (tests, block))
            xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            bound = np.asarray(tests.column("most").fill_null(np.inf), dtype=float).copy()
            lists = tests.column("cells").combine_chunks()
            meets = np.repeat(np.arange(len(x)), np.asarray(lists.value_lengths()))
            cells, home = np.asarray(lists.flatten()), np.asarray(block.column("cell"))
            by, at = np.argsort(cells, kind="stable"), np.argsort(home, kind="stable")
            found, best = [], np.full((len(x), k), np.inf)  # the k least so far: the k-th of all cells before bounds the next ones
            slack = 1e-9 + 1e-12 * (xx.max() + yy.max())
            for c in np.unique(home):
                some = at[slice(*np.searchsorted(home[at], [c, c + 1]))]
                here = meets[by[slice(*np.searchsorted(cells[by], [c, c + 1]))]]
                step = max(1, TABLE // len(some))
                for a in range(0, len(here), step):
                    t = here[a : a + step]
                    rough = xx[t][:, None] + yy[some] - 2 * (x[t] @ y[some].T)
                    least = np.partition(rough, k - 1, axis=1)[:, :k] if len(some) > k else rough
                    best[t] = np.partition(np.concatenate((best[t], least), axis=1), k - 1, axis=1)[:, :k]
                    bound[t] = np.minimum(bound[t], best[t].max(axis=1) + slack)
                    i, j = np.nonzero(rough <= bound[t][:, None] + slack)
                    found.append((t[i], some[j], rough[i, j]))
            if found:
                row, near, d = (np.concatenate(f) for f in zip(*found))
                kept = d <= bound[row] + slack
                row, near = row[kept], near[kept]
                d = _exact(x, y, row, near)
                order = np.lexsort((np.asarray(own[1])[near], d, row))
                row, near, d = row[order], near[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row) + 1
        some = place <= k
        to, at = pa.array(row[some]), pa.array(near[some])
        return pa.table([own[0].take(to), own[1].take(at), own[2].take(at), pa.array(d[some]), pa.array(place[some].astype(np.int32))], names=names)

    return run


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs, some at once."""
    step = max(1, TABLE // x.shape[1])
    return np.concatenate([((y[j[a : a + step]] - x[i[a : a + step]]) ** 2).sum(axis=1).round(9) for a in range(0, max(len(i), 1), step)])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0))


def pairs_met(test: DataFrame, train: DataFrame, k: int = 5, block_numbers: int = BLOCK_NUMBERS) -> tuple[int, int]:
    """Pairs of test and training rows that a search over cells looks at, and all pairs."""
    test = scratch.written(test.select("test_id", vectors.doubles(F.col("v")).alias("v")), "knn")
    train = scratch.written(train.select("train_id", "label", vectors.doubles(F.col("v")).alias("v")), "knn")
    size = train.agg(F.max(F.size("v")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    kinds = dict(train.dtypes) | dict(test.dtypes)
    cells = Cells(train, size.w, size.n, block_numbers)
    met = cells.met(test, k, f"test_id {kinds['test_id']}, train_id {kinds['train_id']}, label {kinds['label']}, d2 double, place int")
    return sum(int(cells.rows[r["cell"]]) * r["n"] for r in met.collect()), size.n * test.count()


def vote(near: DataFrame) -> DataFrame:
    """(test_id, y_pred): the most frequent label, the lowest on ties."""
    votes = near.groupBy("test_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    place = F.row_number().over(Window.partitionBy("test_id").orderBy(F.desc("votes"), "label"))
    return votes.withColumn("r", place).filter("r = 1").select("test_id", F.col("label").alias("y_pred"))
