"""Hand-crafted light-curve features as windows and aggregates.

All features of a series need its rows together once: windows partitioned by
(sourceid, band) and the aggregation by the same key share one exchange, however
many families of features are asked for (``compute``).  Constant series give null
where a formula divides by the deviation.  ``SENTINEL`` stands for "band missing
or too short" at the wide edge only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.lightcurve import KEY, in_time, series

SENTINEL = -1.0
#: Series need more points than this for the statistical features.
SHORT = 4


@dataclass(frozen=True)
class Family:
    """Features that are computed together: row columns, aggregates of a series (named ``_...``), results."""

    rows: Callable[[DataFrame], DataFrame]
    sums: Callable[[], dict[str, Column]]
    results: dict[str, str | Column]


def compute(lc: DataFrame, *families: Family) -> DataFrame:
    """The features of all families with one exchange of ``lc``."""
    for f in families:
        lc = f.rows(lc)
    sums = {name: c for f in families for name, c in f.sums().items()}
    out = lc.groupBy(*KEY).agg(F.count("mag").alias("n"), *[c.alias(name) for name, c in sums.items()])
    results = {name: (F.expr(r) if isinstance(r, str) else r) for f in families for name, r in f.results.items()}
    return out.select(*KEY, "n", *[c.alias(name) for name, c in results.items()])


def _with(df: DataFrame, columns: dict[str, Callable[[], Column]]) -> DataFrame:
    """``df`` with those of the columns that it lacks, one after another."""
    for name, make in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, make())
    return df


def _far(i: int) -> Column:
    return F.avg(F.when(F.abs(F.col("mag") - F.col("_mean")) > i * F.col("_s"), 1.0).otherwise(0.0))


_STATS = {
    "_n": lambda: F.count("mag").over(series()),
    "_mean": lambda: F.avg("mag").over(series()),
    "_s": lambda: F.stddev_samp("mag").over(series()),
}
_STEPS = {
    "_dm": lambda: F.col("mag") - F.lag("mag").over(in_time()),
    "_dt": lambda: F.col("mjd") - F.lag("mjd").over(in_time()),
    "_k": lambda: F.row_number().over(in_time()),
}


def _basic_rows(lc: DataFrame) -> DataFrame:
    return _with(
        lc,
        _STATS
        | _STEPS
        | {
            "_med": lambda: F.expr("percentile(mag, 0.5) over (partition by sourceid, band)"),
            "_lo": lambda: F.min("mag").over(series()),
            "_hi": lambda: F.max("mag").over(series()),
            "_walk": lambda: F.sum(F.col("mag") - F.col("_mean")).over(in_time()),
            "_slope": lambda: F.expr("try_divide(_dm, _dt)"),
        },
    )


def _basic_sums() -> dict[str, Column]:
    quantiles = F.expr("percentile(mag, array(0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95))")
    return {
        "_q": quantiles,
        "_range": F.max("mag") - F.min("mag"),
        "_far1": _far(1),
        "_far2": _far(2),
        "_far3": _far(3),
        "_walked": F.max("_walk") - F.min("_walk"),
        "_dm2": F.sum(F.col("_dm") * F.col("_dm")),
        "_slope2": F.sum(F.col("_slope") * F.col("_slope")),
        "_span": F.max("mjd") - F.min("mjd"),
        "_steep": F.max(F.abs(F.col("_slope"))),
        "_avg": F.avg("mag"),
        "_mad": F.expr("percentile(abs(mag - _med), 0.5)"),
        "_near": F.avg(F.when(F.abs(F.col("mag") - F.col("_med")) < 0.1 * (F.col("_hi") - F.col("_lo")) / 2, 1.0).otherwise(0.0)),
        "_off": F.max(F.abs(F.col("mag") - F.col("_med"))),
        "_sd": F.stddev_samp("mag"),
    }


#: Amplitude, shares beyond 1-3 deviations, Cusum, Eta, EtaE, percentile ranges and ratios, slopes, centre and spread.
BASIC = Family(
    _basic_rows,
    _basic_sums,
    {
        "amplitude": "_range / 2",
        "beyond_1_std": "_far1",
        "beyond_2_std": "_far2",
        "beyond_3_std": "_far3",
        "inter_percentile_range_25": "_q[6] - _q[2]",
        "inter_percentile_range_10": "_q[7] - _q[1]",
        "magnitude_percentage_ratio": "try_divide(_q[5] - _q[3], _q[8] - _q[0])",
        "maximum_slope": "_steep",
        "mean": "_avg",
        "median": "_q[4]",
        "median_absolute_deviation": "_mad",
        "median_buffer_range_percentage": "_near",
        "percent_amplitude": "_off",
        "standard_deviation": "_sd",
        "cusum": "try_divide(_walked, n * _sd)",
        "eta": "try_divide(_dm2, (n - 1) * _sd * _sd)",
        "eta_e": "try_divide(_span * _span, power(n - 1, 3)) * try_divide(_slope2, _sd * _sd)",
    },
)

#: Unbiased skewness (G1) and excess kurtosis (G2).
MOMENTS = Family(
    lambda lc: lc,
    lambda: {"_nd": F.count("mag").cast("double"), "_g1": F.skewness("mag"), "_g2": F.kurtosis("mag")},
    {
        "skew": "case when n > 2 then try_divide(_g1 * sqrt(_nd * (_nd - 1)), _nd - 2) end",
        "kurtosis": "case when n > 3 then try_divide(((_nd + 1) * _g2 + 6) * (_nd - 1), (_nd - 2) * (_nd - 3)) end",
    },
)


def _weighted_rows(lc: DataFrame) -> DataFrame:
    return _with(
        lc,
        {
            "_wm": lambda: F.expr("sum(mag / (err * err)) over (partition by sourceid, band) / sum(1 / (err * err)) over (partition by sourceid, band)"),
            "_r": lambda: (F.col("mag") - F.col("_wm")) / F.col("err"),
        },
    )


#: Weighted mean, reduced chi-square about it, and Stetson K.
WEIGHTED = Family(
    _weighted_rows,
    lambda: {"_wmean": F.max("_wm"), "_r2": F.sum(F.col("_r") * F.col("_r")), "_r1": F.sum(F.abs(F.col("_r")))},
    {"weighted_mean": "_wmean", "reduced_chi2": "try_divide(_r2, n - 1)", "stetson_k": "try_divide(_r1, sqrt(n * _r2))"},
)


def _linear_rows(lc: DataFrame) -> DataFrame:
    return _with(lc, {"_t": lambda: F.col("mjd") - F.min("mjd").over(series()), "_w": lambda: 1 / (F.col("err") * F.col("err"))})


def _linear_sums() -> dict[str, Column]:
    terms = {"_sw": "_w", "_swt": "_w * _t", "_swm": "_w * mag", "_swtt": "_w * _t * _t", "_swtm": "_w * _t * mag", "_swmm": "_w * mag * mag"}
    return {name: F.expr(f"sum({e})") for name, e in terms.items()} | {f"_{f}": F.expr(f"regr_{f}(mag, _t)") for f in ("sxx", "sxy", "syy")}


_FIT = "try_divide(_sw * _swtm - _swt * _swm, _sw * _swtt - _swt * _swt)"
_NOISE = "case when n > 2 then sqrt(greatest(_syy - try_divide(_sxy, _sxx) * _sxy, 0) / (n - 2)) end"
#: Weighted fit (slope, its sigma, reduced chi-square) and least-squares trend (slope, its sigma, noise).
#: Times count from each series' first observation, which leaves slopes as they are and keeps sums small.
LINEAR = Family(
    _linear_rows,
    _linear_sums,
    {
        "fit_slope": _FIT,
        "fit_slope_sigma": "sqrt(try_divide(_sw, _sw * _swtt - _swt * _swt))",
        "fit_chi2": f"case when n > 2 then (_swmm - (_swm - {_FIT} * _swt) / _sw * _swm - {_FIT} * _swtm) / (n - 2) end",
        "trend_slope": "try_divide(_sxy, _sxx)",
        "trend_slope_sigma": f"try_divide({_NOISE}, sqrt(_sxx))",
        "trend_noise": _NOISE,
    },
)


def _runs_rows(lc: DataFrame) -> DataFrame:
    t = in_time()
    return _with(
        lc,
        _STATS
        | _STEPS
        | {
            "_side": lambda: F.expr("case when mag - _mean > 2 * _s then 1 when mag - _mean < -2 * _s then -1 else 0 end"),
            "_run": lambda: (F.col("_side") != 0) & (F.col("_side") == F.lag("_side", 1).over(t)) & (F.col("_side") == F.lag("_side", 2).over(t)),
        },
    )


#: Con: runs of three points on one side beyond two deviations, by N - 2.  PairSlopeTrend: rising less falling of the last 30 steps, by 30.
RUNS = Family(
    _runs_rows,
    lambda: {
        "_runs": F.sum(F.when(F.col("_run"), 1).otherwise(0)),
        "_rise": F.sum(F.when((F.col("_k") > F.col("_n") - 30) & F.col("_dm").isNotNull(), F.signum("_dm")).otherwise(0.0)),
    },
    {"con": "cast(case when n > 2 then try_divide(_runs, n - 2) end as double)", "pair_slope_trend": "_rise / 30"},
)


def _otsu_rows(lc: DataFrame) -> DataFrame:
    by_mag = series().orderBy("mag", "obs_id")
    up = by_mag.rowsBetween(-(2**63), 0)
    return _with(
        lc,
        _STATS
        | {
            "_m": lambda: F.row_number().over(by_mag),
            "_s1": lambda: F.sum("mag").over(up),
            "_s2": lambda: F.sum(F.col("mag") * F.col("mag")).over(up),
            "_t1": lambda: F.sum("mag").over(series()),
            "_t2": lambda: F.sum(F.col("mag") * F.col("mag")).over(series()),
            "_below": lambda: F.expr("_s1 / _m"),
            "_above": lambda: F.expr("try_divide(_t1 - _s1, _n - _m)"),
            "_score": lambda: F.expr("case when _m < _n then round((_m / _n) * ((_n - _m) / _n) * power(_above - _below, 2), 9) end"),
        },
    )


def _otsu_sums() -> dict[str, Column]:
    below = F.expr("case when _m > 1 then sqrt(greatest(try_divide(_s2 - _m * _below * _below, _m - 1), 0)) else 0 end")
    above = F.expr("case when _n - _m > 1 then sqrt(greatest(try_divide(_t2 - _s2 - (_n - _m) * _above * _above, _n - _m - 1), 0)) else 0 end")
    best = F.struct(F.expr("_above - _below").alias("diff"), below.cast("double").alias("lower"), above.cast("double").alias("upper"), F.expr("_m / _n").alias("share"))
    return {"_otsu": F.max_by(best, F.when(F.col("_score").isNotNull(), F.struct("_score", F.expr("-_m"))))}


#: Split of the sorted magnitudes with the largest between-class variance: means' difference, deviations below and above, share below.
OTSU = Family(
    _otsu_rows, _otsu_sums, {"otsu_mean_diff": "_otsu.diff", "otsu_std_lower": "_otsu.lower", "otsu_std_upper": "_otsu.upper", "otsu_lower_share": "_otsu.share"}
)


def _normal_rows(lc: DataFrame) -> DataFrame:
    z = F.expr("try_divide(mag - _mean, _s)")
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # Coefficients of the error function's approximation (Abramowitz and Stegun 7.1.26; error below 2e-7).
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    cdf = F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))
    safe = F.greatest(F.least(cdf, F.lit(1 - 1e-15)), F.lit(1e-15))
    return _with(lc, _STATS | {"_m": lambda: F.row_number().over(series().orderBy("mag", "obs_id")), "_cdf": lambda: safe})


#: A-squared against a normal of the series' mean and deviation, with the small-sample factor.
NORMAL = Family(
    _normal_rows,
    lambda: {"_nsd": F.max("_s"), "_a": F.expr("sum((2 * _m - 1) * ln(_cdf) + (2 * (_n - _m) + 1) * ln(1 - _cdf))")},
    {"anderson_darling_normal": "case when _nsd > 0 then (-n - _a / n) * (1 + 4.0D / n - 25.0D / n / n) end"},
)

ALL = (BASIC, MOMENTS, WEIGHTED, LINEAR, RUNS, OTSU, NORMAL)


def basic(lc: DataFrame) -> DataFrame:
    return compute(lc, BASIC)


def moments(lc: DataFrame) -> DataFrame:
    return compute(lc, MOMENTS).drop("n")


def weighted(lc: DataFrame) -> DataFrame:
    return compute(lc, WEIGHTED).drop("n")


def linear(lc: DataFrame) -> DataFrame:
    return compute(lc, LINEAR).drop("n")


def con_and_pair_slope(lc: DataFrame) -> DataFrame:
    return compute(lc, RUNS).drop("n")


def otsu(lc: DataFrame) -> DataFrame:
    return compute(lc, OTSU).filter("otsu_mean_diff is not null").drop("n")


def anderson_darling(lc: DataFrame) -> DataFrame:
    return compute(lc, NORMAL).drop("n")


def all_statistical(lc: DataFrame) -> DataFrame:
    """All built-in features of series with more than ``SHORT`` points; shorter ones are left out."""
    return compute(lc, *ALL).filter(F.col("n") > SHORT)


def wide(features: DataFrame, bands: list[str], names: list[str], sources: DataFrame | None = None) -> DataFrame:
    """``{band}_{feature}`` columns, a row per source; ``SENTINEL`` where a band is missing or has no value."""
    cells = [F.max(F.when(F.col("band") == b, F.col(n))).alias(f"{b}_{n}") for b in bands for n in names]
    out = features.groupBy("sourceid").agg(*cells)
    if sources is not None:
        out = sources.select("sourceid").distinct().join(out, "sourceid", "left")
    return out.na.fill(SENTINEL, [f"{b}_{n}" for b in bands for n in names])
