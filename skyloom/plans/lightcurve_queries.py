"""Light-curve layer and hand-crafted features over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import times
from skyloom.operators import encoder, features, lightcurve, long_series, periodogram
from skyloom.plans.inputs import LC, PREPARED, observations, rounded, table
from skyloom.plans.registry import query, sql_of
from skyloom.sources import scratch, training

KEY = ["sourceid", "band"]

BASIC_SQL = f"""
WITH {PREPARED}, c AS (
  SELECT *, sum(mag - mean) OVER (PARTITION BY sourceid, band ORDER BY mjd, obs_id ROWS UNBOUNDED PRECEDING) AS walk FROM p
), a AS (
  SELECT sourceid, band, count(*) AS n, (max(mag) - min(mag)) / 2 AS amplitude,
    avg(CASE WHEN abs(mag - mean) > s THEN 1.0 ELSE 0.0 END) AS beyond_1_std, avg(CASE WHEN abs(mag - mean) > 2 * s THEN 1.0 ELSE 0.0 END) AS beyond_2_std,
    avg(CASE WHEN abs(mag - mean) > 3 * s THEN 1.0 ELSE 0.0 END) AS beyond_3_std, max(walk) - min(walk) AS wr, sum(dm * dm) AS dm2,
    sum((dm / nullif(dt, 0)) * (dm / nullif(dt, 0))) AS s2, max(mjd) - min(mjd) AS span,
    quantile_cont(mag, 0.75) - quantile_cont(mag, 0.25) AS inter_percentile_range_25, quantile_cont(mag, 0.9) - quantile_cont(mag, 0.1) AS inter_percentile_range_10,
    (quantile_cont(mag, 0.6) - quantile_cont(mag, 0.4)) / nullif(quantile_cont(mag, 0.95) - quantile_cont(mag, 0.05), 0) AS magnitude_percentage_ratio,
    max(abs(dm / nullif(dt, 0))) AS maximum_slope, avg(mag) AS mean, median(mag) AS median, median(abs(mag - med)) AS median_absolute_deviation,
    avg(CASE WHEN abs(mag - med) < 0.1 * (hi - lo) / 2 THEN 1.0 ELSE 0.0 END) AS median_buffer_range_percentage, max(abs(mag - med)) AS percent_amplitude,
    stddev_samp(mag) AS sd
  FROM c GROUP BY sourceid, band
)
SELECT sourceid, band, n, round(amplitude, 6) AS amplitude, round(beyond_1_std, 6) AS beyond_1_std, round(beyond_2_std, 6) AS beyond_2_std, round(beyond_3_std, 6) AS beyond_3_std,
  round(inter_percentile_range_25, 6) AS inter_percentile_range_25, round(inter_percentile_range_10, 6) AS inter_percentile_range_10, round(magnitude_percentage_ratio, 6) AS magnitude_percentage_ratio,
  round(maximum_slope, 6) AS maximum_slope, round(mean, 6) AS mean, round(median, 6) AS median, round(median_absolute_deviation, 6) AS median_absolute_deviation,
  round(median_buffer_range_percentage, 6) AS median_buffer_range_percentage, round(percent_amplitude, 6) AS percent_amplitude, round(sd, 6) AS standard_deviation,
  round(wr / nullif(n * sd, 0), 6) AS cusum, round(dm2 / nullif((n - 1) * sd * sd, 0), 6) AS eta,
  round(span * span / nullif(power(n - 1, 3), 0) * (s2 / nullif(sd * sd, 0)), 6) AS eta_e
FROM a
"""


@query(BASIC_SQL)
def lc_basic_features(spark, sf_dir):
    return rounded(features.basic(observations(spark, sf_dir)), KEY)


@query(f"""
WITH {LC}
SELECT sourceid, band, round(CASE WHEN count(*) > 2 THEN skewness(mag) END, 6) AS skew, round(CASE WHEN count(*) > 3 THEN kurtosis(mag) END, 6) AS kurtosis
FROM lc GROUP BY sourceid, band
""")
def lc_moments(spark, sf_dir):
    return rounded(features.moments(observations(spark, sf_dir)), KEY)


@query(f"""
WITH {LC}, w AS (
  SELECT *, sum(mag / (err * err)) OVER g / sum(1 / (err * err)) OVER g AS wm FROM lc WINDOW g AS (PARTITION BY sourceid, band)
)
SELECT sourceid, band, round(max(wm), 6) AS weighted_mean, round(sum(((mag - wm) / err) * ((mag - wm) / err)) / nullif(count(*) - 1, 0), 6) AS reduced_chi2,
  round(sum(abs((mag - wm) / err)) / nullif(sqrt(count(*) * sum(((mag - wm) / err) * ((mag - wm) / err))), 0), 6) AS stetson_k
FROM w GROUP BY sourceid, band
""")
def lc_weighted_features(spark, sf_dir):
    return rounded(features.weighted(observations(spark, sf_dir)), KEY)


@query(f"""
WITH {LC}, q AS (
  SELECT *, mjd - min(mjd) OVER (PARTITION BY sourceid, band) AS t, 1 / (err * err) AS w FROM lc
), a AS (
  SELECT sourceid, band, count(*)::DOUBLE AS n, sum(w) AS sw, sum(w * t) AS swt, sum(w * mag) AS swm, sum(w * t * t) AS swtt, sum(w * t * mag) AS swtm, sum(w * mag * mag) AS swmm,
    regr_sxx(mag, t) AS sxx, regr_sxy(mag, t) AS sxy, regr_syy(mag, t) AS syy FROM q GROUP BY sourceid, band
), b AS (
  SELECT *, (sw * swtm - swt * swm) / nullif(sw * swtt - swt * swt, 0) AS fs, sxy / nullif(sxx, 0) AS ts FROM a
), c AS (
  SELECT *, CASE WHEN n > 2 THEN sqrt(greatest(syy - ts * sxy, 0) / (n - 2)) END AS tn, (swm - fs * swt) / sw AS c0 FROM b
)
SELECT sourceid, band, round(fs, 4) AS fit_slope, round(sqrt(sw / nullif(sw * swtt - swt * swt, 0)), 4) AS fit_slope_sigma,
  round(CASE WHEN n > 2 THEN (swmm - c0 * swm - fs * swtm) / (n - 2) END, 2) AS fit_chi2, round(ts, 4) AS trend_slope, round(tn / nullif(sqrt(sxx), 0), 4) AS trend_slope_sigma, round(tn, 4) AS trend_noise
FROM c
""")
def lc_linear_trend(spark, sf_dir):
    out = features.linear(observations(spark, sf_dir))
    return out.select(*KEY, *[F.round(c, 2 if c == "fit_chi2" else 4).alias(c) for c in out.columns[2:]])


@query(f"""
WITH {PREPARED}, s AS (
  SELECT *, CASE WHEN mag - mean > 2 * s THEN 1 WHEN mag - mean < -2 * s THEN -1 ELSE 0 END AS side FROM p
), r AS (
  SELECT *, side <> 0 AND side = lag(side, 1) OVER t AND side = lag(side, 2) OVER t AS run FROM s WINDOW t AS (PARTITION BY sourceid, band ORDER BY mjd, obs_id)
)
SELECT sourceid, band, round(CASE WHEN count(*) > 2 THEN sum(CASE WHEN run THEN 1 ELSE 0 END) / (count(*) - 2)::DOUBLE END, 6) AS con,
  round(sum(CASE WHEN k > n - 30 AND dm IS NOT NULL THEN sign(dm) ELSE 0 END) / 30.0::DOUBLE, 6) AS pair_slope_trend
FROM r GROUP BY sourceid, band
""")
def lc_con_pairslope(spark, sf_dir):
    return rounded(features.con_and_pair_slope(observations(spark, sf_dir)), KEY)


@query(f"""
WITH {LC}, o AS (
  SELECT sourceid, band, row_number() OVER m AS k, count(*) OVER g AS n, sum(mag) OVER u AS s1, sum(mag * mag) OVER u AS s2, sum(mag) OVER g AS t1, sum(mag * mag) OVER g AS t2
  FROM lc WINDOW g AS (PARTITION BY sourceid, band), m AS (PARTITION BY sourceid, band ORDER BY mag, obs_id), u AS (PARTITION BY sourceid, band ORDER BY mag, obs_id ROWS UNBOUNDED PRECEDING)
), q AS (
  SELECT *, s1 / k AS lower, (t1 - s1) / (n - k) AS upper FROM o WHERE k < n
), z AS (
  SELECT *, round((k / n::DOUBLE) * ((n - k) / n::DOUBLE) * power(upper - lower, 2), 9) AS score,
    CASE WHEN k > 1 THEN sqrt(greatest((s2 - k * lower * lower) / (k - 1), 0)) ELSE 0 END AS sl, CASE WHEN n - k > 1 THEN sqrt(greatest((t2 - s2 - (n - k) * upper * upper) / (n - k - 1), 0)) ELSE 0 END AS su FROM q
)
SELECT sourceid, band, round(upper - lower, 6) AS otsu_mean_diff, round(sl, 4) AS otsu_std_lower, round(su, 4) AS otsu_std_upper, round(k / n::DOUBLE, 6) AS otsu_lower_share
FROM (SELECT *, row_number() OVER (PARTITION BY sourceid, band ORDER BY score DESC, k) AS r FROM z) WHERE r = 1
""")
def lc_otsu(spark, sf_dir):
    out = features.otsu(observations(spark, sf_dir))
    return out.select(*KEY, *[F.round(c, 4 if "std" in c else 6).alias(c) for c in out.columns[2:]])


@query(f"""
WITH {LC}, q AS (
  SELECT sourceid, band, count(*) OVER g AS n, stddev_samp(mag) OVER g AS s, row_number() OVER m AS k, (mag - avg(mag) OVER g) / nullif(stddev_samp(mag) OVER g, 0) AS z
  FROM lc WINDOW g AS (PARTITION BY sourceid, band), m AS (PARTITION BY sourceid, band ORDER BY mag, obs_id)
), x AS (
  SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * (abs(z) / sqrt(2.0::DOUBLE))) AS t FROM q
), e AS (
  SELECT *, 1 - t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x) AS erf FROM x
), f AS (
  SELECT *, greatest(least(CASE WHEN z >= 0 THEN 0.5 * (1 + erf) ELSE 0.5 * (1 - erf) END, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE) AS cdf FROM e
)
SELECT sourceid, band, round(CASE WHEN max(s) > 0 THEN (-max(n) - sum((2 * k - 1) * ln(cdf) + (2 * (n - k) + 1) * ln(1 - cdf)) / max(n)) * (1 + 4.0::DOUBLE / max(n) - 25.0::DOUBLE / max(n) / max(n)) END, 6) AS anderson_darling_normal
FROM f GROUP BY sourceid, band
""")
def lc_anderson_darling(spark, sf_dir):
    return rounded(features.anderson_darling(observations(spark, sf_dir)), KEY)


@query(f"""
WITH {LC}
SELECT sourceid, band, obs_id, round(mjd - coalesce(lag(mjd) OVER t, 0), 6) AS dt, round(mjd - coalesce(lag(mjd) OVER t, mjd), 6) AS dt_zero
FROM lc WINDOW t AS (PARTITION BY sourceid, band ORDER BY mjd, obs_id)
""")
def lc_delta_t(spark, sf_dir):
    lc = lightcurve.with_time_step(lightcurve.valid(observations(spark, sf_dir)))
    lc = lightcurve.with_time_step(lc.withColumnRenamed("dt", "dt_mjd"), first="zero")
    return lc.select(*KEY, "obs_id", F.round("dt_mjd", 6).alias("dt"), F.round("dt", 6).alias("dt_zero"))


@query(f"""
WITH {LC}
SELECT sourceid, band, obs_id, CAST(coalesce(floor(mjd) - lag(floor(mjd)) OVER t, 0) AS BIGINT) AS dt_days
FROM lc WINDOW t AS (PARTITION BY sourceid, band ORDER BY mjd, obs_id)
""")
def lc_delta_days(spark, sf_dir):
    return lightcurve.with_day_step(observations(spark, sf_dir)).select(*KEY, "obs_id", "dt_days")


@query(f"""
WITH {LC}, r AS (
  SELECT *, row_number() OVER (PARTITION BY sourceid, band ORDER BY mjd DESC, obs_id DESC) AS back FROM lc
), t AS (
  SELECT sourceid, band, mag, row_number() OVER (PARTITION BY sourceid, band ORDER BY mjd, obs_id) AS pos, count(*) OVER (PARTITION BY sourceid, band) AS n FROM r WHERE back <= 10
), m AS (
  SELECT sourceid, band, sum(mag) / 10 AS mean, max(n) AS n FROM t GROUP BY sourceid, band
)
SELECT m.sourceid, m.band, i.pos AS pos, round(coalesce(t.mag, 0) - m.mean, 6) AS mag
FROM m CROSS JOIN (SELECT unnest(range(1, 11)) AS pos) i LEFT JOIN t ON t.sourceid = m.sourceid AND t.band = m.band AND t.pos = i.pos
""")
def lc_tail_window_centered(spark, sf_dir):
    windows = lightcurve.centred_window(lightcurve.nest(observations(spark, sf_dir)), 10)
    return windows.select(*KEY, F.posexplode("window").alias("p", "o")).select(*KEY, (F.col("p") + 1).cast("bigint").alias("pos"), F.round("o.mag", 6).alias("mag"))


@query(f"""
WITH {LC}, z AS (
  SELECT sourceid, band, mjd, obs_id, (mag - avg(mag) OVER g) / nullif(stddev_pop(mag) OVER g, 0) AS z FROM lc WINDOW g AS (PARTITION BY sourceid, band)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY sourceid, band ORDER BY mjd DESC, obs_id DESC) AS back FROM z
), s AS (SELECT DISTINCT sourceid, band FROM z)
SELECT s.sourceid, s.band, i.pos AS pos, round(coalesce(r.z, 0), 6) AS z
FROM s CROSS JOIN (SELECT unnest(range(1, 13)) AS pos) i LEFT JOIN r ON r.sourceid = s.sourceid AND r.band = s.band AND r.back = 13 - i.pos
""")
def lc_zscore_leftpad(spark, sf_dir):
    ctx = lightcurve.context(lightcurve.z_scores(observations(spark, sf_dir)), 12)
    return ctx.select(*KEY, F.posexplode("context").alias("p", "z")).select(*KEY, (F.col("p") + 1).cast("bigint").alias("pos"), F.round("z", 6).alias("z"))


@query(f"""
WITH {LC}
SELECT sourceid, band, row_number() OVER t - 1 AS pos, count(*) OVER (PARTITION BY sourceid, band) AS length, round(mjd, 6) AS mjd, mag, round(err, 6) AS err, round(mjd - coalesce(lag(mjd) OVER t, 0), 6) AS dt
FROM lc WINDOW t AS (PARTITION BY sourceid, band ORDER BY mjd, obs_id)
""")
def lc_nest(spark, sf_dir):
    """Every element of every array of the nested series."""
    s = lightcurve.nest(observations(spark, sf_dir)).select(*KEY, "series.*")
    each = s.select(*KEY, "length", F.posexplode(F.arrays_zip("mjd", "target", "past_feat_dynamic_real", "feat_dynamic_real")).alias("pos", "o"))
    six = lambda c: F.round(c, 6)
    return each.select(*KEY, F.col("pos").cast("bigint").alias("pos"), F.col("length").cast("bigint").alias("length"), six("o.mjd").alias("mjd"), F.col("o.target").alias("mag"), six("o.past_feat_dynamic_real").alias("err"), six("o.feat_dynamic_real").alias("dt"))


@query(f"""
WITH {LC}
SELECT sourceid, band, row_number() OVER (PARTITION BY sourceid, band ORDER BY mjd, obs_id) - 1 AS pos, round(mjd, 6) AS mjd, mag, round(err, 6) AS err FROM lc
""")
def lc_unnest(spark, sf_dir):
    rows = lightcurve.unnest(lightcurve.nest(observations(spark, sf_dir)))
    return rows.select(*KEY, F.col("obs_id").alias("pos"), F.round("mjd", 6).alias("mjd"), "mag", F.round("err", 6).alias("err"))


@query(f"""
WITH {LC}
SELECT sourceid, min(band) AS lead_band, count(DISTINCT band) AS n_bands, string_agg(DISTINCT band, ',' ORDER BY band) AS bands FROM lc GROUP BY sourceid
""")
def lc_reference_band(spark, sf_dir):
    bands = lightcurve.nest_bands(lightcurve.nest(observations(spark, sf_dir)))
    listed = lightcurve.band_list(bands, ["length"])
    return listed.select(
        "sourceid", F.try_element_at("bands_data", F.lit(1))["band"].alias("lead_band"), F.size("bands_data").cast("bigint").alias("n_bands"), F.array_join("bands_data.band", ",").alias("bands")
    )


@query(f"""
WITH {LC}
SELECT sourceid FROM lc GROUP BY sourceid HAVING count(*) FILTER (band = 'click') > 0 AND count(*) FILTER (band = 'purchase') > 0
""")
def lc_both_bands(spark, sf_dir):
    return lightcurve.nest_bands(lightcurve.nest(observations(spark, sf_dir))).filter(lightcurve.has_bands("click", "purchase")).select("sourceid")


@query(f"WITH {LC} SELECT sourceid, band, count(*) AS length FROM lc GROUP BY sourceid, band HAVING count(*) >= 15")
def lc_min_length(spark, sf_dir):
    return lightcurve.nest(observations(spark, sf_dir)).filter(lightcurve.min_length(15)).select(*KEY, F.col("series.length").alias("length"))


@query(f"""
WITH {LC}, a AS (
  SELECT sourceid, band, stddev_samp(mag) AS s, avg(mag) AS m FROM lc GROUP BY sourceid, band HAVING count(*) > 4
), u AS (SELECT DISTINCT sourceid FROM lc)
SELECT u.sourceid, round(coalesce(max(CASE WHEN band = 'click' THEN m END), -1), 6) AS click_mean, round(coalesce(max(CASE WHEN band = 'click' THEN s END), -1), 6) AS click_standard_deviation,
  round(coalesce(max(CASE WHEN band = 'view' THEN m END), -1), 6) AS view_mean, round(coalesce(max(CASE WHEN band = 'view' THEN s END), -1), 6) AS view_standard_deviation
FROM u LEFT JOIN a ON a.sourceid = u.sourceid GROUP BY u.sourceid
""")
def lc_wide_features(spark, sf_dir):
    lc = observations(spark, sf_dir)
    long = lc.withColumn("_n", F.count("mag").over(lightcurve.series())).filter(F.col("_n") > features.SHORT)
    return rounded(features.wide(features.basic(long), ["click", "view"], ["mean", "standard_deviation"], lc), ["sourceid"])


@query(f"""
WITH {LC}, r AS (
  SELECT sourceid, band, mag, row_number() OVER (PARTITION BY sourceid, band ORDER BY mjd DESC, obs_id DESC) AS back FROM lc
)
SELECT sourceid, band, count(*) AS n, round(sum(mag), 6) AS total FROM r WHERE back > 3 AND back <= 8 GROUP BY sourceid, band
""")
def lc_held_back_context(spark, sf_dir):
    s = lightcurve.nest(observations(spark, sf_dir)).withColumn("c", lightcurve.held_back(F.col("series.target"), 5, 3))
    return s.filter("c is not null").select(*KEY, F.size("c").cast("bigint").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""
SELECT event_id, strftime(CAST(ts AS DATE) - CAST(event_id % 5 AS INTEGER), '%Y-%m-%d') AS first_day, strftime(CAST(ts AS DATE) - CAST(event_id % 5 AS INTEGER) + 6, '%Y-%m-%d') AS last_day FROM events
""")
def lc_daily_timestamps(spark, sf_dir):
    days = lightcurve.daily_timestamps(F.col("ts"), F.pmod("event_id", F.lit(5)).cast("int"), 7)
    return table(spark, sf_dir, "events").select("event_id", F.element_at(days, 1).cast("string").alias("first_day"), F.element_at(days, -1).cast("string").alias("last_day"))


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def lc_mjd_round_trip(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", times.timestamp_of_mjd(times.mjd_of_timestamp("ts")).alias("back"), "ts")
    same = F.expr("abs(timestampdiff(MICROSECOND, cast(ts as timestamp), back)) < 10")
    return ev.select("event_id", F.when(same, F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).alias("micros"))


_FAMILIES = ("lc_basic_features", "lc_moments", "lc_weighted_features", "lc_linear_trend", "lc_con_pairslope", "lc_otsu", "lc_anderson_darling")


@query("SELECT * FROM (%s) AS f0 %s WHERE n > 4" % (sql_of(_FAMILIES[0]), " ".join(f"LEFT JOIN ({sql_of(name)}) AS f{i} USING (sourceid, band)" for i, name in enumerate(_FAMILIES[1:], 1))))
def lc_all_statistical(spark, sf_dir):
    """All families with one exchange of the observations."""
    return _shortened(features.all_statistical(observations(spark, sf_dir)))


def _shortened(out):
    digits = lambda c: 2 if c == "fit_chi2" else 4 if c.startswith(("fit_", "trend_", "otsu_std")) else 6
    return out.select(*KEY, *[F.round(c, digits(c)).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes[2:]])


@query(sql_of("lc_all_statistical"))
def lc_long_features(spark, sf_dir):
    """All families with the series cut into pieces of some 4,096 rows."""
    return _shortened(long_series.statistical(observations(spark, sf_dir), 1 << 12))


@query(f"""
WITH {LC}
SELECT sourceid, band, obs_id, round(mjd - coalesce(lag(mjd) OVER t, 0), 6) AS dt FROM lc WINDOW t AS (PARTITION BY sourceid, band ORDER BY mjd, obs_id)
""")
def lc_long_time_steps(spark, sf_dir):
    """Time steps with the series cut into pieces of some 4,096 rows."""
    return long_series.time_steps(observations(spark, sf_dir), 1 << 12).select(*KEY, "obs_id", F.round("dt", 6).alias("dt"))


@query()
def periodic_features(spark, sf_dir):
    return periodogram.periodic(lightcurve.nest(observations(spark, sf_dir)))


@query()
def period_search(spark, sf_dir):
    """Best period of every series, with its frequencies dealt over rows."""
    return periodogram.best_periods(lightcurve.nest(observations(spark, sf_dir)))


@query()
def emb_encoder(spark, sf_dir):
    """Self-attention over the last 200 points of every series, with weights stored as a table and read from it."""
    path = scratch.folder(spark, "encoder")
    training.store(spark, path, 0, encoder.initial(), {})
    last = lambda c: F.slice(c, F.greatest(F.size(c) - 199, F.lit(1)), 200)
    windows = lightcurve.nest(observations(spark, sf_dir)).select(*KEY, last(F.col("series.mjd")).alias("mjd"), last(F.col("series.target")).alias("mag"))
    return encoder.embedded(windows, training.latest(spark, path)[1])
