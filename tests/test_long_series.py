"""Features of series cut into pieces against those of whole series."""

import numpy as np
from pyspark.sql import functions as F

from skyloom.operators import features, lightcurve, long_series

SCHEMA = "sourceid string, band string, obs_id long, mjd double, mag double, err double, _p string"


def observations(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, band, n in (("hot", "g", 3000), ("hot", "r", 40), ("b", "g", 7), (None, "g", 90), ("c", None, 61), ("d", "g", 4), ("e", "g", 5), ("flat", "g", 30)):
        t = np.round(np.sort(rng.uniform(1, 900, n)), 1)  # equal times
        y = np.full(n, 2.0) if name == "flat" else np.round(15 + rng.normal(0, 1, n) + 3 * (np.arange(n) % 97 < 4), 2)  # equal magnitudes, runs beyond two deviations
        rows += [(name, band, i, float(a), float(b), 0.05 + 0.01 * (i % 7), "x") for i, (a, b) in enumerate(zip(t, y))]
    rows += [("hot", "g", 5000, None, 1.0, 0.1, "x"), ("hot", "g", 5001, 3.0, None, 0.1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def by_key(df):
    return {(r["sourceid"], r["band"]): r.asDict() for r in df.collect()}


def test_pieces_give_the_features_of_whole_series(spark):
    lc = observations(spark)
    whole = by_key(features.all_statistical(lc.drop("_p").filter("mjd is not null and mag is not null")))
    got_frame = long_series.statistical(lc, 100)
    got = by_key(got_frame)
    assert set(got) == set(whole) and ("d", "g") not in got and (None, "g") in got and ("c", None) in got
    assert whole[("hot", "g")]["con"] > 0
    for key, row in whole.items():
        assert list(row) == list(got[key])
        for name, value in row.items():
            if isinstance(value, float):
                assert got[key][name] is not None and abs(got[key][name] - value) <= 1e-7 * max(1, abs(value)), (key, name)
            else:
                assert got[key][name] == value, (key, name)


def test_a_long_series_is_many_tasks(spark):
    lc = long_series._input(observations(spark))
    placed = long_series.cut(lc, ("mjd", "obs_id"), 32)
    sizes = [r["count"] for r in placed.groupBy("sourceid", "band", "_p").count().filter("sourceid = 'hot' and band = 'g'").collect()]
    assert len(sizes) > 20 and max(sizes) < 400 and sum(sizes) == 3000
    lower = placed.filter("sourceid = 'hot' and band = 'g'").groupBy("_p").agg(F.min("mjd").alias("a"), F.max("mjd").alias("b")).orderBy("_p").collect()
    assert all(x.b <= y.a for x, y in zip(lower, lower[1:]))


def test_time_steps_and_empty_tables(spark):
    lc = observations(spark)
    want = {(r.sourceid, r.band, r.obs_id): r.dt for r in lightcurve.with_time_step(lc.filter("mjd is not null and mag is not null")).collect()}
    got = {(r.sourceid, r.band, r.obs_id): r.dt for r in long_series.time_steps(lc, 50).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert long_series.time_steps(lc.limit(0)).count() == 0
    assert long_series.statistical(lc.limit(0)).count() == 0


def test_only_long_series_are_cut(spark, monkeypatch):
    """Series of at most a piece's rows take one exchange; nothing of them is sorted over ranges or written."""
    lc, seen = observations(spark), []
    cut = long_series.cut
    monkeypatch.setattr(long_series, "cut", lambda rows, *more: seen.append({(r.sourceid, r.band) for r in rows.select("sourceid", "band").distinct().collect()}) or cut(rows, *more))
    assert long_series.statistical(lc, 3000).count() == long_series.statistical(lc, 2999).count() == 7
    assert seen == [{("hot", "g")}] * 3
    del seen[:]
    assert long_series.time_steps(lc, 90).count() == long_series.time_steps(lc, 3000).count() == 3237
    assert seen == [{("hot", "g")}]
    long_series.time_steps(lc, 89)
    assert seen[1:] == [{("hot", "g"), (None, "g")}]
