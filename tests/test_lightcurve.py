"""Light curves and features on hand-made series."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import times
from skyloom.operators import features, lightcurve, periodogram


def lc_of(spark, series):
    rows = [(s, b, i, float(t), None if m is None else float(m), 0.1) for (s, b), points in series.items() for i, (t, m) in enumerate(points)]
    return spark.createDataFrame(rows, "sourceid string, band string, obs_id long, mjd double, mag double, err double").repartition(3)


def one(df):
    return df.collect()[0]


def test_first_time_step(spark):
    lc = lc_of(spark, {("s", "g"): [(15, 3), (10, 1), (12, 2)]})
    steps = lambda d: [r.dt for r in d.orderBy("mjd").collect()]
    assert steps(lightcurve.with_time_step(lc)) == [10, 2, 3]
    assert steps(lightcurve.with_time_step(lc, first="zero")) == [0, 2, 3]


def test_day_step(spark):
    lc = lc_of(spark, {("s", "g"): [(10.9, 1), (11.1, 1), (11.2, 1)]})
    assert [r.dt_days for r in lightcurve.with_day_step(lc).orderBy("mjd").collect()] == [0, 1, 0]


def test_valid_drops_zero(spark):
    assert lightcurve.valid(lc_of(spark, {("s", "g"): [(0, 1), (-1, 1), (2, 1)]})).count() == 1


def test_nest_sorts_and_round_trips(spark):
    lc = lc_of(spark, {("s", "g"): [(3, 30), (1, 10), (2, 20)], ("s", "r"): [(5, 50)], ("t", "g"): [(1, 1)]})
    nested = lightcurve.nest(lc)
    row = one(nested.filter("sourceid = 's' and band = 'g'")).series
    assert row.mjd == [1, 2, 3] and row.target == [10, 20, 30] and row.feat_dynamic_real == [1, 1, 1] and row.length == 3
    assert lightcurve.unnest(nested).count() == 5
    bands = lightcurve.nest_bands(nested)
    assert [r.sourceid for r in bands.filter(lightcurve.has_bands("g", "r")).collect()] == ["s"]
    listed = {r.sourceid: r for r in lightcurve.band_list(bands, ["length"]).collect()}
    assert [b.band for b in listed["s"].bands_data] == ["g", "r"] and listed["t"].length == 1


def test_pad_then_centre(spark):
    nested = lightcurve.nest(lc_of(spark, {("s", "g"): [(1, 4), (2, 8)]}))
    assert [w.mag for w in one(lightcurve.centred_window(nested, 4)).window] == [1, 5, -3, -3]
    assert [w.mag for w in one(lightcurve.centred_window(nested, 4, mask_pad=True)).window] == [-2, 2, 0, 0]


def test_tail_of_unsorted_input(spark):
    lc = lc_of(spark, {("s", "g"): [(5, 50), (1, 10), (4, 40), (2, 20), (3, 30)]})
    assert [(r.pos, r.mag) for r in lightcurve.tail(lc, 3).orderBy("pos").collect()] == [(1, 30), (2, 40), (3, 50)]
    nested = lightcurve.nest(lc)
    assert [w.mag for w in one(lightcurve.centred_window(nested, 3)).window] == [-10, 0, 10]


def test_z_scores_and_left_pad(spark):
    lc = lc_of(spark, {("s", "g"): [(1, 1), (2, 3)], ("c", "g"): [(1, 5), (2, 5)]})
    z = {(r.sourceid, r.mjd): r.z_mag for r in lightcurve.z_scores(lc).collect()}
    assert z[("s", 1)] == -1 and z[("s", 2)] == 1 and z[("c", 1)] is None
    ctx = {r.sourceid: (r.pad, r.context) for r in lightcurve.context(lightcurve.z_scores(lc), 4).collect()}
    assert ctx["s"] == (2, [0, 0, -1, 1])
    long = lc_of(spark, {("s", "g"): [(t, t) for t in range(1, 6)]}).withColumn("z_mag", F.col("mag"))
    assert one(lightcurve.context(long, 3)).context == [3, 4, 5]


def test_daily_timestamps_and_held_back(spark):
    row = one(spark.range(1).select(lightcurve.daily_timestamps(F.lit("2024-01-10").cast("date"), F.lit(2), 3).alias("d"), lightcurve.held_back(F.array(*map(F.lit, range(1, 8))), 3, 2).alias("h"), lightcurve.held_back(F.array(F.lit(1)), 3, 2).alias("n")))
    assert row.d == [datetime.date(2024, 1, 8), datetime.date(2024, 1, 9), datetime.date(2024, 1, 10)] and row.h == [3, 4, 5] and row.n is None


def test_hjd_forms(spark):
    df = spark.createDataFrame([("2455000.12345", 54999.62345), ("5000.1234", 54999.6234), ("5000.12345", 54999.62345)], "t string, want double")
    for r in df.withColumn("mjd", times.mjd_of_hjd_text(F.col("t"), F.col("t"))).collect():
        assert r.mjd == pytest.approx(r.want, abs=1e-8)
    with pytest.raises(Exception, match="unexpected time format"):
        spark.createDataFrame([("500.1234",)], "t string").select(times.mjd_of_hjd_text(F.col("t"), F.col("t"))).collect()


def test_sexagesimal_and_colons(spark):
    df = spark.createDataFrame([("-00:30:00",), ("12:30:36",), ("1 2 3.5",), ("-5 6 7.8",), ("odd",)], "t string")
    rows = df.select(times.degrees_of_sexagesimal(F.col("t")).alias("d"), times.degrees_of_sexagesimal(F.col("t"), True).alias("h"), times.colon_coordinate(F.col("t")).alias("c"), times.colon_coordinate(F.col("t"), True).alias("cd")).limit(4).collect()
    assert rows[0].d == -0.5 and rows[1].h == pytest.approx(187.65)
    assert rows[2].c == "01:02:003.5" and rows[3].cd == "-05:06:07.8"
    assert df.filter("t = 'odd'").select(times.colon_coordinate(F.col("t")).alias("c")).collect()[0].c == "odd"


def test_mjd_of_timestamp(spark):
    df = spark.sql("select timestamp_ntz'1858-11-17 00:00:00' as a, timestamp_ntz'2000-01-01 12:00:00' as b")
    r = one(df.select(times.mjd_of_timestamp("a").alias("a"), times.mjd_of_timestamp("b").alias("b")))
    assert (r.a, r.b) == (0, 51544.5)
    back = one(spark.range(1).select(times.timestamp_of_mjd(F.lit(51544.5)).cast("string").alias("t")))
    assert back.t.startswith("2000-01-01 12:00:00")


def reference_features(t, m):
    n, s, mean, med = len(m), m.std(ddof=1), m.mean(), np.median(m)
    walk = np.cumsum(m - mean) / (n * s)
    dm, dt = np.diff(m), np.diff(t)
    q = lambda p: np.quantile(m, p)
    g1 = ((m - mean) ** 3).mean() / m.std() ** 3
    g2 = ((m - mean) ** 4).mean() / m.std() ** 4 - 3
    return {
        "amplitude": (m.max() - m.min()) / 2,
        "beyond_1_std": (np.abs(m - mean) > s).mean(),
        "cusum": walk.max() - walk.min(),
        "eta": (dm**2).sum() / ((n - 1) * s * s),
        "eta_e": (t[-1] - t[0]) ** 2 / (n - 1) ** 3 * ((dm / dt) ** 2).sum() / s**2,
        "inter_percentile_range_10": q(0.9) - q(0.1),
        "magnitude_percentage_ratio": (q(0.6) - q(0.4)) / (q(0.95) - q(0.05)),
        "maximum_slope": np.abs(dm / dt).max(),
        "median_absolute_deviation": np.median(np.abs(m - med)),
        "percent_amplitude": np.abs(m - med).max(),
        "standard_deviation": s,
        "skew": g1 * math.sqrt(n * (n - 1)) / (n - 2),
        "kurtosis": ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)),
        "trend_slope": np.polyfit(t, m, 1)[0],
        "fit_slope": np.polyfit(t, m, 1)[0],
        "weighted_mean": mean,
        "reduced_chi2": (((m - mean) / 0.1) ** 2).sum() / (n - 1),
        "stetson_k": np.abs(m - mean).sum() / math.sqrt(n * ((m - mean) ** 2).sum()),
    }


def test_features_against_numpy(spark):
    rng = np.random.default_rng(1)
    t, m = np.sort(rng.uniform(0, 100, 40)), rng.normal(15, 1, 40)
    got = one(features.all_statistical(lc_of(spark, {("s", "g"): list(zip(t, m))})))
    for name, want in reference_features(t, m).items():
        assert got[name] == pytest.approx(want, rel=1e-6), name


def test_constant_and_short_series(spark):
    lc = lc_of(spark, {("c", "g"): [(t, 7) for t in range(1, 7)], ("short", "g"): [(1, 1), (2, 2)]})
    row = one(features.basic(lc).filter("sourceid = 'c'"))
    assert row.standard_deviation == 0 and row.eta is None and row.cusum is None and row.amplitude == 0
    every = features.all_statistical(lc)
    assert [r.sourceid for r in every.collect()] == ["c"]
    wide = {r.sourceid: r for r in features.wide(every, ["g", "r"], ["mean"], lc).collect()}
    assert wide["short"].g_mean == -1 and wide["c"].g_mean == 7 and wide["c"].r_mean == -1


def test_con_counts_runs_of_three(spark):
    values = [0.0] * 60 + [50.0, 50.0, 50.0, 50.0]
    row = one(features.con_and_pair_slope(lc_of(spark, {("s", "g"): list(enumerate(values, 1))})))
    assert row.con == pytest.approx(2 / 62) and row.pair_slope_trend == pytest.approx(1 / 30)


def test_otsu_splits_two_levels(spark):
    row = one(features.otsu(lc_of(spark, {("s", "g"): [(1, 1), (2, 1.2), (3, 9), (4, 9.2), (5, 9.4)]})))
    assert row.otsu_lower_share == pytest.approx(0.4) and row.otsu_mean_diff == pytest.approx(8.1)


def test_anderson_darling(spark):
    rng = np.random.default_rng(3)
    m = np.sort(rng.normal(size=30))
    n = len(m)
    cdf = np.array([0.5 * (1 + math.erf((x - m.mean()) / m.std(ddof=1) / math.sqrt(2))) for x in m])
    k = np.arange(1, n + 1)
    want = (-n - ((2 * k - 1) * np.log(cdf) + (2 * (n - k) + 1) * np.log(1 - cdf)).sum() / n) * (1 + 4 / n - 25 / n / n)
    assert one(features.anderson_darling(lc_of(spark, {("s", "g"): list(enumerate(m))}))).anderson_darling_normal == pytest.approx(want, abs=1e-4)


def test_periods_of_a_sine(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 30, 120))
    m = 10 + np.sin(2 * np.pi * t / 2.5) + rng.normal(0, 0.05, 120)
    nested = lightcurve.nest(lc_of(spark, {("s", "g"): list(zip(t, m)), ("short", "g"): [(1, 2), (2, 3)]}))
    got = {r.sourceid: r for r in periodogram.periodic(nested).collect()}
    assert got["s"].period_ls == pytest.approx(2.5, rel=0.02) and got["s"].period_fit < 1e-6
    assert got["s"].freq1_harmonics_amplitude_0 == pytest.approx(1, abs=0.05) and got["s"].freq1_harmonics_rel_phase_0 == pytest.approx(0, abs=1e-9)
    assert got["s"].psi_eta < 0.5 and got["s"].car_tau > 0 and got["short"].period_ls is None


def test_short_period_in_a_long_series(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(50000, 53000, 300))
    series = {("s", "g"): list(zip(t, 15 + np.sin(2 * np.pi * t / 0.2)))}
    row = one(periodogram.periodic(lightcurve.nest(lc_of(spark, series))))
    assert row.period_ls == pytest.approx(0.2, abs=1e-5) and row.freq1_harmonics_amplitude_0 == pytest.approx(1, abs=0.1)
    assert periodogram.grid(t)[-1] == pytest.approx(periodogram.MAX_FREQUENCY, rel=1e-3)


def test_power_is_that_of_a_fit():
    """The power at each frequency is the share of squares that a sine and a cosine explain."""
    rng = np.random.default_rng(6)
    t, y = np.sort(rng.uniform(50000, 50040, 60)), rng.normal(size=60)
    freqs = periodogram.grid(t)
    power = periodogram.lomb_scargle(t, y, freqs)
    z = y - y.mean()
    for i in range(0, len(freqs), 37):
        a = 2 * np.pi * freqs[i] * (t - t[0])
        x = np.stack([np.sin(a), np.cos(a)], axis=1)
        fitted = x @ np.linalg.lstsq(x, z, rcond=None)[0]
        assert power[i] == pytest.approx((fitted**2).sum() / (z**2).sum(), abs=1e-9)


@pytest.mark.parametrize("span", [30, 300, 1000, 4000])
def test_periods_are_found_at_every_span(span):
    """Sines of 0.2 to 1,000 days, irregularly sampled, wherever three periods fit; noise has no convincing period."""
    rng = np.random.default_rng(span)
    t = np.sort(rng.uniform(0, span, 250))
    for period in (p for p in (0.2, 0.57, 1.7, 9.3, 97.0, 1000.0) if 3 * p <= span):
        y = 15 + np.sin(2 * np.pi * t / period + 1) + rng.normal(0, 0.1, len(t))
        got = dict(zip(periodogram.NAMES, periodogram.fit(t, y, np.full(len(t), 0.1))))
        assert got["period_ls"] == pytest.approx(period, rel=max(1e-3, 0.2 * period / span)) and got["period_fit"] < 1e-9
        assert got["freq1_harmonics_amplitude_0"] == pytest.approx(1, abs=0.15) and got["psi_eta"] < 0.5
    noise = dict(zip(periodogram.NAMES, periodogram.fit(t, rng.normal(size=len(t)), np.full(len(t), 0.1))))
    assert noise["period_fit"] > 1e-3


def test_car_fit_finds_the_best_time_scale():
    """The likelihood at the fitted time scale is not beaten by any of a fine grid."""
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 100, 120))
    y = np.cumsum(rng.normal(0, 0.3, len(t))) * 0.5
    e = np.full(len(t), 0.05)
    sigma, tau, mean = periodogram.car1(t, y, e)

    def negative(tau):
        a = np.exp(-np.diff(t) / tau)
        z = y - y.mean()
        gap, square = 1 - a * a, (z[1:] - a * z[:-1]) ** 2
        total = (square / gap).mean() * gap + e[1:] ** 2
        return 0.5 * (np.log(total) + square / total).sum()

    assert negative(tau) <= min(negative(x) for x in np.geomspace(0.1, 100, 400)) + 1e-2
    assert mean == pytest.approx(y.mean() / tau) and sigma > 0
