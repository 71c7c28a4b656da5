"""Light curves: from observations to series, windows and back.

Long form is one row per observation: sourceid, band, mjd, mag, err (and obs_id
to order equal times).  Every function partitions by (sourceid, band) only, so a
chain of them needs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("sourceid", "band")


def series() -> Window:
    return Window.partitionBy(*KEY)


def in_time() -> Window:
    return Window.partitionBy(*KEY).orderBy("mjd", "obs_id")


def valid(lc: DataFrame) -> DataFrame:
    """Observations after the epoch; zero counts as missing."""
    return lc.filter("mjd > 0")


def with_time_step(lc: DataFrame, first: str = "mjd") -> DataFrame:
    """``dt`` to the previous observation; the first one has its own mjd, or 0 with ``first='zero'``."""
    before = F.lag("mjd").over(in_time())
    start = F.lit(0.0) if first == "mjd" else F.col("mjd")
    return lc.withColumn("dt", F.col("mjd") - F.coalesce(before, start))


def with_day_step(lc: DataFrame) -> DataFrame:
    """``dt_days``: whole days to the previous observation's day, 0 at first."""
    day = F.floor("mjd")
    return lc.withColumn("dt_days", F.coalesce(day - F.lag(day).over(in_time()), F.lit(0)).cast("bigint"))


def nest(lc: DataFrame) -> DataFrame:
    """One row per series with parallel arrays in time order; times are always sorted."""
    points = F.array_sort(F.collect_list(F.struct("mjd", "obs_id", "mag", "err", "dt")))
    return (
        with_time_step(lc)
        .groupBy(*KEY)
        .agg(points.alias("p"))
        .select(
            *KEY,
            F.struct(
                F.col("p.mjd").alias("mjd"),
                F.col("p.mag").alias("target"),
                F.col("p.err").alias("past_feat_dynamic_real"),
                F.col("p.dt").alias("feat_dynamic_real"),
                F.size("p").cast("bigint").alias("length"),
            ).alias("series"),
        )
    )


def nest_bands(nested: DataFrame) -> DataFrame:
    """One row per source: ``bands_data`` maps a band to its series; a missing band has no entry."""
    return nested.groupBy("sourceid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", "series")))).alias("bands_data"))


def unnest(nested: DataFrame) -> DataFrame:
    """Long form of ``nest``."""
    s = F.col("series")
    zipped = F.arrays_zip(s.mjd.alias("mjd"), s.target.alias("mag"), s.past_feat_dynamic_real.alias("err"), s.feat_dynamic_real.alias("dt"))
    return nested.select(*KEY, F.posexplode(zipped).alias("pos", "o")).select(*KEY, F.col("pos").cast("bigint").alias("obs_id"), "o.mjd", "o.mag", "o.err", "o.dt")


def band_list(nested: DataFrame, shared: list[str]) -> DataFrame:
    """Bands as an array of structs with their name; shared metadata from the first band that has it.

    ``nested`` has a map ``bands_data`` whose values hold the fields in ``shared``.
    """
    entries = F.map_entries("bands_data")
    there = F.filter(entries, lambda e: e["value"].isNotNull() & e["value"][shared[0]].isNotNull())
    lead = F.try_element_at(there, F.lit(1))
    return nested.select(
        "sourceid", *[lead["value"][c].alias(c) for c in shared], F.transform(there, lambda e: F.struct(e["key"].alias("band"), e["value"].alias("series"))).alias("bands_data")
    )


def has_bands(*bands: str) -> Column:
    """All of the bands are present in the map ``bands_data``."""
    out = F.lit(True)
    for b in bands:
        out = out & F.try_element_at("bands_data", F.lit(b)).isNotNull()
    return out


def min_length(n: int = 160) -> Column:
    return F.col("series.length") >= n


def tail(lc: DataFrame, n: int) -> DataFrame:
    """The last n observations of each series, ``pos`` counting from 1 in time order."""
    last = lc.withColumn("back", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("mjd"), F.desc("obs_id")))).filter(F.col("back") <= n)
    return last.withColumn("pos", F.row_number().over(in_time())).drop("back")


def _less(values: Column, by: Column) -> Column:
    return F.transform(values, lambda x: x - by)


def centred_window(series_arrays: DataFrame, n: int = 200, mask_pad: bool = False) -> DataFrame:
    """Window of the last n points, zeros appended, then each column less its mean.

    The padding counts in the mean, as models were trained that way, and becomes
    minus the mean; ``mask_pad`` keeps it out of the mean and at zero.
    """
    out = series_arrays
    for name, field in (("mjd", "mjd"), ("mag", "target"), ("err", "past_feat_dynamic_real")):
        a = F.slice(F.col(f"series.{field}"), F.greatest(F.size(f"series.{field}") - n + 1, F.lit(1)), n)
        pad = F.array_repeat(F.lit(0.0), F.lit(n) - F.size(a))
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        if mask_pad:
            mean = total / F.size(a)
            column = F.concat(_less(a, mean), pad)
        else:
            mean = total / n
            column = _less(F.concat(a, pad), mean)
        out = out.withColumn(name, column)
    return out.select(*KEY, F.arrays_zip("mjd", "mag", "err").alias("window"))


def z_scores(lc: DataFrame, columns=("mag",)) -> DataFrame:
    """``z_<column>``: less the series' mean, by its population deviation; null where that is 0."""
    for c in columns:
        lc = lc.withColumn(f"z_{c}", (F.col(c) - F.avg(c).over(series())) / F.nullif(F.stddev_pop(c).over(series()), F.lit(0.0)))
    return lc


def context(lc: DataFrame, n: int, column: str = "z_mag") -> DataFrame:
    """The last n values of each series, zeros before them: one row per series with ``context`` and ``pad``."""
    a = F.transform(F.array_sort(F.collect_list(F.struct("mjd", "obs_id", F.coalesce(column, F.lit(0.0)).alias("v")))), lambda p: p["v"])
    cut = lc.groupBy(*KEY).agg(a.alias("a")).withColumn("a", F.slice("a", F.greatest(F.size("a") - n + 1, F.lit(1)), n))
    return cut.select(*KEY, (F.lit(n) - F.size("a")).alias("pad"), F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size("a")), "a").alias("context"))


def daily_timestamps(start: Column, pad: Column, n: int) -> Column:
    """n days from ``start`` less ``pad`` days."""
    first = F.date_sub(start.cast("date"), pad)
    return F.sequence(first, F.date_add(first, n - 1))


def held_back(values: Column, ctx: int, horizon: int) -> Column:
    """The ``ctx`` values before the last ``horizon``."""
    last = F.size(values) - horizon
    return F.when(last > 0, F.slice(values, F.greatest(last - ctx + 1, F.lit(1)), F.least(F.lit(ctx), last)))


def target_layout(nested: DataFrame) -> DataFrame:
    """Series as forecasting records: item_id, start (timestamp of the first point), freq, and float arrays."""
    from skyloom.functions.times import timestamp_of_mjd

    s = F.col("series")
    return nested.select(
        F.concat_ws("_", F.col("sourceid").cast("string"), "band").alias("item_id"),
        timestamp_of_mjd(F.try_element_at(s.mjd, F.lit(1))).alias("start"),
        F.lit("1D").alias("freq"),
        *[s[c].cast("array<float>").alias(c) for c in ("target", "past_feat_dynamic_real", "feat_dynamic_real")],
        s.length.cast("int").alias("length"),
    )
