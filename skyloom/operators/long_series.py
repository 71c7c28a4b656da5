"""Statistical features of series of any length, cut into pieces that are tasks of their own.

``features.compute`` takes a whole (sourceid, band) into one window task.  That stays so for
series that have no more rows than a piece, which need one exchange for it.  The observations of longer
ones are sorted over ranges, by series and time and once more by series and
magnitude, and written with the number of their range, ``_p``: a series fills as many
ranges as it needs.  Windows run within a piece (series, range).  What a piece
needs from the ones before it comes from a small table with a row a piece:

* steps and runs take the last two observations before the piece;
* Cusum and Otsu take the sums of the pieces before, as sums merge;
* quantiles are the rows at the ranks asked for, and a rank is a piece's row number after
  the counts before it.  The median absolute deviation sorts once more, by the distance.

The row columns that ``features`` makes by windows over a series are put there
beforehand, so the formulas are the same ones, and every aggregate that is left has
partial sums.  Values equal those of ``features.all_statistical``, but for rounding in
another order of summation.

Rows without mjd or mag are left out.  Null keys are a series like others, equal times keep
the order of obs_id, an empty table gives an empty one, and other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators import features
from skyloom.operators.lightcurve import KEY, with_time_step
from skyloom.sources import scratch

#: Rows of a range, about 50 MB.
PIECE = 1 << 20
#: The shares of ``features.BASIC``'s quantiles, in their order.
SHARES = (0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95)
PLACE = (*KEY, "_p")


def _same(left: DataFrame, right: DataFrame, on: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls meet; the columns of ``on`` stay once."""
    other = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    return left.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]), how).drop(*[f"_on_{c}" for c in on])


def cut(lc: DataFrame, order: tuple[str, ...], pieces: int) -> DataFrame:
    """``lc`` sorted by series and ``order`` over so many ranges of equal size, as a written table with the range's number ``_p``."""
    placed = lc.repartitionByRange(pieces, *KEY, *order).sortWithinPartitions(*KEY, *order)
    return scratch.written(placed.withColumn("_p", F.spark_partition_id()), "pieces")


def _within() -> Window:
    return Window.partitionBy(*PLACE)


def _before() -> Window:
    """The pieces of a series before one; a series has no more of them than there are ranges."""
    return Window.partitionBy(*KEY).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)


def constants(lc: DataFrame) -> DataFrame:
    """What every row of a series is compared with: counts, moments, extremes and the weighted mean."""
    return lc.groupBy(*KEY).agg(
        F.count("mag").alias("_n"),
        F.avg("mag").alias("_mean"),
        F.stddev_samp("mag").alias("_s"),
        F.min("mag").alias("_lo"),
        F.max("mag").alias("_hi"),
        F.min("mjd").alias("_t0"),
        F.sum("mag").alias("_t1"),
        F.sum(F.col("mag") * F.col("mag")).alias("_t2"),
        F.expr("sum(mag / (err * err)) / sum(1 / (err * err))").alias("_wm"),
    )


def in_order_of_magnitude(by_mag: DataFrame, each: DataFrame) -> DataFrame:
    """``by_mag`` with the rank ``_m`` of each row in its series, sums up to it (``_s1``, ``_s2``), and the series' constants."""
    pieces = by_mag.groupBy(*PLACE).agg(F.count("mag").alias("_c"), F.sum("mag").alias("_a"), F.sum(F.col("mag") * F.col("mag")).alias("_b"))
    earlier = [F.coalesce(F.sum(c).over(_before()), F.lit(0)).alias(name) for c, name in (("_c", "_c0"), ("_a", "_a0"), ("_b", "_b0"))]
    up = _within().orderBy("mag", "obs_id")
    rows = _same(by_mag, _same(pieces.select(*PLACE, *earlier), each, KEY), PLACE)
    return (
        rows.withColumn("_m", F.row_number().over(up) + F.col("_c0"))
        .withColumn("_s1", F.sum("mag").over(up.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_a0"))
        .withColumn("_s2", F.sum(F.col("mag") * F.col("mag")).over(up.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_b0"))
        .drop("_c0", "_a0", "_b0")
    )


def in_order_of_time(by_time: DataFrame, each: DataFrame) -> DataFrame:
    """``by_time`` with place ``_k``, steps ``_dm`` and ``_dt``, ``_side`` and ``_run`` of outliers, walk ``_walk``, and the constants."""
    time = _within().orderBy("mjd", "obs_id", "mag")  # rows that repeat an obs_id have one order, however they arrive
    numbered = by_time.withColumn("_i", F.row_number().over(time)).withColumn("_back", F.count(F.lit(1)).over(_within()) - F.col("_i") + 1)
    row = F.struct("mjd", "mag")
    pieces = numbered.groupBy(*PLACE).agg(
        F.count(F.lit(1)).alias("_c"),
        F.sum("mag").alias("_a"),
        F.max(F.when(F.col("_back") == 1, row)).alias("_last"),
        F.max(F.when(F.col("_back") == 2, row)).alias("_second"),
    )
    order = Window.partitionBy(*KEY).orderBy("_p")
    # a piece has a row at least, so the last two rows before one are in the two pieces before it
    pieces = pieces.select(
        *PLACE,
        F.coalesce(F.sum("_c").over(_before()), F.lit(0)).alias("_c0"),
        F.coalesce(F.sum("_a").over(_before()), F.lit(0.0)).alias("_a0"),
        F.lag("_last").over(order).alias("_b1"),
        F.coalesce(F.lag("_second").over(order), F.lag("_last", 2).over(order)).alias("_b2"),
    )
    rows = _same(numbered, _same(pieces, each, KEY), PLACE)
    side = lambda m: F.when(m - F.col("_mean") > 2 * F.col("_s"), 1).when(m - F.col("_mean") < -2 * F.col("_s"), -1).otherwise(0)
    ahead = lambda c: F.coalesce(F.lag(c).over(time), F.when(F.col("_i") == 1, F.col("_b1")[c]))
    second = F.coalesce(F.lag("mag", 2).over(time), F.when(F.col("_i") == 2, F.col("_b1.mag")).when(F.col("_i") == 1, F.col("_b2.mag")))
    return (
        rows.withColumn("_pm", ahead("mag"))
        .withColumn("_ppm", second)
        .withColumn("_dt", F.col("mjd") - ahead("mjd"))
        .withColumn("_dm", F.col("mag") - F.col("_pm"))
        .withColumn("_k", F.col("_i") + F.col("_c0"))
        .withColumn("_walk", F.sum(F.col("mag") - F.col("_mean")).over(time.rowsBetween(Window.unboundedPreceding, 0)) + (F.col("_a0") - F.col("_c0") * F.col("_mean")))
        .withColumn("_side", side(F.col("mag")))
        .withColumn("_run", (F.col("_side") != 0) & F.col("_ppm").isNotNull() & (F.col("_side") == side(F.col("_pm"))) & (F.col("_side") == side(F.col("_ppm"))))
        .withColumn("_t", F.col("mjd") - F.col("_t0"))
        .drop("_i", "_back", "_pm", "_ppm", "_b1", "_b2", "_c0", "_a0")
    )


def time_steps(lc: DataFrame, rows: int = PIECE) -> DataFrame:
    """``lightcurve.with_time_step`` for series of any length: (sourceid, band, obs_id, mjd, dt); the first row's dt is its own mjd."""
    short, long = by_length(_input(lc), rows)
    out = with_time_step(short).select(*KEY, "obs_id", "mjd", "dt")
    return out if long is None else out.unionByName(_time_steps(long, rows))


def _time_steps(lc: DataFrame, rows: int) -> DataFrame:
    by_time = cut(lc, ("mjd", "obs_id"), _pieces(lc, rows))
    stepped = in_order_of_time(by_time, constants(by_time))
    return stepped.select(*KEY, "obs_id", "mjd", F.coalesce("_dt", "mjd").alias("dt"))


def quantiles(ranked: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(sourceid, band, _q): exact quantiles with linear interpolation, of rows that have their rank ``_m`` and count ``_n``.

    Only the rows at the two ranks around a share leave their task.
    """
    place = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    sums = []
    for i, p in enumerate(shares):
        at = F.col("_m") - 1
        sums.append(F.max(F.when(at == F.floor(place(p)), F.col(value))).alias(f"_lower{i}"))
        sums.append(F.max(F.when(at == F.ceil(place(p)), F.col(value))).alias(f"_upper{i}"))
    found = ranked.groupBy(*KEY).agg(F.max("_n").alias("_n"), *sums)
    part = lambda p: place(p) - F.floor(place(p))
    return found.select(*KEY, F.array(*[F.col(f"_lower{i}") * (1 - part(p)) + F.col(f"_upper{i}") * part(p) for i, p in enumerate(shares)]).alias("_q"))


def _input(lc: DataFrame) -> DataFrame:
    return lc.select(*KEY, "obs_id", "mjd", F.col("mag").cast("double").alias("mag"), F.col("err").cast("double").alias("err")).filter("mjd is not null and mag is not null")


def _pieces(lc: DataFrame, rows: int) -> int:
    return max(1, -(-lc.count() // rows))


def by_length(lc: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``lc`` of the series with at most so many rows, and of those with more; None where there are none of these."""
    counts = lc.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_c"))
    over = scratch.written(counts.filter(F.col("_c") > rows).select(*KEY), "long")  # one key for every ``rows`` rows at most
    if over.isEmpty():
        return lc, None
    return _same(lc, over, KEY, "left_anti"), _same(lc, over, KEY, "left_semi")


def _results(found: DataFrame, families: tuple[features.Family, ...]) -> list[Column]:
    every = {name: r for f in families for name, r in f.results.items()}
    return [(F.expr(r) if isinstance(r, str) else r).alias(name) for name, r in every.items()]


def statistical(lc: DataFrame, rows: int = PIECE) -> DataFrame:
    """``features.all_statistical`` for series of any length: the same columns, of series with more than ``features.SHORT`` points."""
    short, long = by_length(_input(lc), rows)
    out = features.all_statistical(short)
    return out if long is None else out.unionByName(_statistical(long, rows))


def _statistical(lc: DataFrame, rows: int) -> DataFrame:
    pieces = _pieces(lc, rows)
    by_time = cut(lc, ("mjd", "obs_id"), pieces)
    each = constants(by_time).filter(F.col("_n") > features.SHORT)
    by_mag = in_order_of_magnitude(cut(by_time.drop("_p"), ("mag", "obs_id"), pieces), each)

    ranks = quantiles(by_mag, "mag", SHARES)
    each = scratch.written(_same(each, ranks, KEY).withColumn("_med", F.col("_q")[SHARES.index(0.5)]), "constants")
    timed = in_order_of_time(by_time, each.drop("_q"))

    # distances from the median, sorted as the magnitudes are
    far = _same(by_time, _same(by_time.select(*PLACE).distinct(), each.select(*KEY, "_med"), KEY), PLACE)
    far = cut(far.select(*KEY, "obs_id", "mjd", F.abs(F.col("mag") - F.col("_med")).alias("mag"), "err"), ("mag", "obs_id"), pieces)
    spread = quantiles(in_order_of_magnitude(far, each.drop("_q", "_med")), "mag", (0.5,)).select(*KEY, F.col("_q")[0].alias("_mad"))

    out = each.select(*KEY, "_q")
    for rows_of, families in ((timed, (features.BASIC, features.MOMENTS, features.WEIGHTED, features.LINEAR, features.RUNS)), (by_mag, (features.OTSU, features.NORMAL))):
        for f in families:
            rows_of = f.rows(rows_of)
        sums = {name: c for f in families for name, c in f.sums().items() if name not in ("_q", "_mad")}
        counted = {} if "n" in out.columns else {"n": F.count("mag")}
        out = _same(out, rows_of.groupBy(*KEY).agg(*[c.alias(name) for name, c in (counted | sums).items()]), KEY)
    out = _same(out, spread, KEY)
    return out.select(*KEY, "n", *_results(out, features.ALL))
