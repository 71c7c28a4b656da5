"""Fast periodograms against direct sums, and frequencies dealt over rows."""

import numpy as np
import pytest

from skyloom.operators import lightcurve, periodogram


def series(n, span, seed=0, period=3.3):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(100, 100 + span, n))
    return t, 15 + np.sin(2 * np.pi * t / period) + rng.normal(0, 0.3, n)


@pytest.mark.parametrize(("n", "span"), [(5, 0.3), (40, 60), (700, 1500), (3000, 400)])
def test_spread_waves_equal_direct_sums(n, span):
    t, y = series(n, span)
    t, y = t - t.min(), y - y.mean()
    freqs = periodogram.grid(t)
    for some in (freqs, 2 * freqs, freqs[len(freqs) // 3 :], freqs[:1], freqs[:2]):
        direct = np.array([(y * np.exp(2j * np.pi * f * t)).sum() for f in some[:: max(1, len(some) // 97)]])
        for found in (periodogram.spread_waves(t, y, some), periodogram.direct_waves(t, y, some), periodogram.waves(t, y, some)):
            assert len(found) == len(some)
            assert abs(found[:: max(1, len(some) // 97)] - direct).max() < 1e-9 * abs(y).sum()


def test_powers_equal_least_squares():
    t, y = series(900, 200)
    t = t - t.min()
    freqs = periodogram.grid(t)
    power = periodogram.lomb_scargle(t, y, freqs)
    y = y - y.mean()
    for i in (0, 17, 3030, len(freqs) - 1):
        x = np.stack([np.sin(2 * np.pi * freqs[i] * t), np.cos(2 * np.pi * freqs[i] * t)], axis=1)
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert power[i] == pytest.approx(1 - (rest**2).sum() / (y**2).sum(), abs=1e-6)


def test_tables_of_a_short_series_are_made_once(monkeypatch):
    """All four sums of a fit take the same tables, also where frequencies fill several blocks."""
    for n, span in ((13, 29), (6, 0.2)):
        t, y = series(n, span)
        freqs = periodogram.grid(t)
        direct = lambda values, some: np.array([(values * np.exp(2j * np.pi * f * (t - t.min()))).sum() for f in some])  # noqa: B023, E731
        with monkeypatch.context() as m:
            m.setattr(periodogram, "waves", None)  # nothing goes over the points by itself
            spectrum = periodogram.Spectrum(t, freqs)
            got = [spectrum.power(values) for values in (y, y**2)]
            assert len(periodogram.fit(t, y, np.full(n, 0.1))) == len(periodogram.NAMES)
        twice = direct(np.ones(n), 2 * freqs)
        cc, ss = (n + abs(twice)) / 2, (n - abs(twice)) / 2
        for values, power in zip((y, y**2), got):
            turned = direct(values - values.mean(), freqs) * np.exp(-0.5j * np.angle(twice))
            want = (turned.real**2 / cc + turned.imag**2 / np.where(ss > 1e-12 * n, ss, np.inf)) / ((values - values.mean()) ** 2).sum()
            assert np.allclose(power, want, rtol=1e-7, atol=1e-9)


def test_best_periods_over_slices(spark):
    rows = []
    for name, (n, span, period) in {"a": (300, 400, 3.3), "b": (60, 30, 0.7), "c": (3, 5, 1.0), "d": (9, 3, 0.5)}.items():
        t, y = series(n, span, period=period)
        rows += [(name, "g", i, float(a), float(b) if name != "d" else 2.0, 0.1) for i, (a, b) in enumerate(zip(t, y))]
    rows += [("e", "g", i, 7.0, float(i), 0.1) for i in range(8)]  # one moment
    nested = lightcurve.nest(spark.createDataFrame(rows, "sourceid string, band string, obs_id long, mjd double, mag double, err double"))
    whole = {r.sourceid: r for r in periodogram.periodic(nested).collect()}
    for size in (1000, 1 << 19):
        got = {r.sourceid: r for r in periodogram.best_periods(nested, size).collect()}
        assert set(got) == set("abcde")
        for name in "ab":
            assert got[name].period_ls == pytest.approx(whole[name].period_ls, rel=1e-12)
            assert got[name].period_fit == pytest.approx(whole[name].period_fit, abs=1e-9)
        for name in "cde":
            assert (got[name].frequencies, got[name].period_ls, got[name].period_fit) == (0, None, None)
    assert got["a"].period_ls == pytest.approx(3.3, rel=0.01)
    assert periodogram.best_periods(nested.limit(0)).count() == 0
