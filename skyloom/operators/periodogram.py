"""Features that need a fit per series: Lomb-Scargle periods and harmonics, folded statistics, autocorrelation, CAR(1).

A series is an array column of one row, so the fit is a plain map over Arrow
batches that needs no grouping.
The frequency grid is fixed: ``OVERSAMPLING`` steps a peak's width up to
``MAX_FREQUENCY`` cycles a day, however long the series is.  Its steps are equal,
so the sums over the points for all frequencies are one Fourier transform of the
points spread over a grid (``spread_waves``); for few points they are products of two
tables, of the first frequency of each block and of the steps in a block
(``direct_waves``).  Both give the same sums within 1e-9 of the sum of |y|.

``best_periods`` splits one series' frequencies over rows, so that a long span is no
single task's work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERSAMPLING, MAX_FREQUENCY = 5, 10.0
#: Frequencies of a block, and blocks and points that are multiplied at once.
BLOCK, BLOCKS, POINTS = 512, 512, 2048
#: Cells of the grid that a point is spread over, cells a frequency, and points that are spread at once.
WIDTH, FINER, SPREAD = 13, 2, 1 << 17
#: Frequencies of a row of ``best_periods``.
SLICE = 1 << 19
HARMONICS = 4
FREQUENCIES = 3

NAMES = (
    ["period_ls", "period_fit", "psi_cs", "psi_eta", "autocor_length", "car_sigma", "car_tau", "car_mean"]
    + [f"freq{i}_harmonics_amplitude_{j}" for i in range(1, FREQUENCIES + 1) for j in range(HARMONICS)]
    + [f"freq{i}_harmonics_rel_phase_{j}" for i in range(1, FREQUENCIES + 1) for j in range(HARMONICS)]
)


def grid(t: np.ndarray) -> np.ndarray:
    span = t.max() - t.min()
    step = 1 / (OVERSAMPLING * span)
    return step * np.arange(1, max(2, int(MAX_FREQUENCY / step)) + 1)


def _direct(points: int, freqs: int) -> bool:
    """Whether every point by every frequency is cheaper than a transform."""
    return points * freqs < 60 * WIDTH * points + 12 * FINER * freqs * np.log2(freqs + 2)


def waves(t: np.ndarray, y: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Sum of y exp(2 pi i f t) over the points for each of ``freqs``, which have equal steps; the cheaper of two ways."""
    return direct_waves(t, y, freqs) if _direct(len(t), len(freqs)) else spread_waves(t, y, freqs)


def direct_waves(t: np.ndarray, y: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Every point by every frequency."""
    step = freqs[1] - freqs[0] if len(freqs) > 1 else 0.0
    head = freqs[::BLOCK]
    out = np.zeros((len(head), BLOCK), dtype=complex)
    for p in range(0, len(t), POINTS):
        angle = 2j * np.pi * t[p : p + POINTS]
        within = np.exp(np.outer(angle, step * np.arange(BLOCK)))
        for b in range(0, len(head), BLOCKS):
            out[b : b + BLOCKS] += (np.exp(np.outer(head[b : b + BLOCKS], angle)) * y[p : p + POINTS]) @ within
    return out.ravel()[: len(freqs)]


def spread_waves(t: np.ndarray, y: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """The same by a non-uniform Fourier transform.

    Points are turned by the middle frequency, spread over a grid of one cycle with a
    Kaiser-Bessel window, transformed at once, and divided by the window's transform.
    """
    m = len(freqs)
    step = (freqs[-1] - freqs[0]) / (m - 1) if m > 1 else 1.0  # a difference of neighbours has too few digits
    middle = m // 2
    size = 1 << int(np.ceil(np.log2(max(FINER * m, 2 * WIDTH))))
    beta = np.pi * WIDTH * (1 - 0.5 / FINER)
    reach = np.arange(WIDTH)
    real, imaginary = np.zeros(size), np.zeros(size)
    for p in range(0, len(t), SPREAD):
        now = t[p : p + SPREAD]
        value = y[p : p + SPREAD] * np.exp(2j * np.pi * freqs[middle] * now)
        place = np.mod(now * step, 1.0) * size
        first = np.ceil(place - WIDTH / 2)
        off = (first - place)[:, None] + reach
        window = np.i0(beta * np.sqrt(np.maximum(1 - (2 * off / WIDTH) ** 2, 0)))
        cell = np.mod(first.astype(np.int64)[:, None] + reach, size).ravel()
        real += np.bincount(cell, (value.real[:, None] * window).ravel(), size)
        imaginary += np.bincount(cell, (value.imag[:, None] * window).ravel(), size)
    mode = np.arange(m) - middle
    root = np.sqrt(beta**2 - (np.pi * WIDTH * mode / size) ** 2)
    return np.fft.ifft(real + 1j * imaginary)[mode] * (size / WIDTH) * root / np.sinh(root)


class Spectrum:
    """What all powers at ``freqs``, which have equal steps, of values at ``t`` share: it is made once for a series.

    Of few points the tables of ``direct_waves`` are kept; those of doubled frequencies are their squares.
    """

    def __init__(self, t: np.ndarray, freqs: np.ndarray):
        self.t, self.freqs, self.tables = t - t.min(), freqs, None
        if len(t) <= POINTS and len(freqs) <= BLOCK * BLOCKS and _direct(len(t), len(freqs)):
            step = freqs[1] - freqs[0] if len(freqs) > 1 else 0.0
            angle = 2j * np.pi * self.t
            self.tables = np.exp(np.outer(freqs[::BLOCK], angle)), np.exp(np.outer(angle, step * np.arange(min(BLOCK, len(freqs)))))
            head, within = self.tables
            twice = ((head * head) @ (within * within)).ravel()[: len(freqs)]
        else:
            twice = waves(self.t, np.ones(len(t)), 2 * freqs)
        # turned by half the phase of ``twice``, the sums of squares are these and sine and cosine are orthogonal
        size = abs(twice)
        cc, ss = (len(t) + size) / 2, (len(t) - size) / 2
        self.cc, self.ss = 1 / cc, 1 / np.where(ss > 1e-12 * len(t), ss, np.inf)
        self.turn = np.exp(-0.5j * np.angle(twice))

    def power(self, y: np.ndarray) -> np.ndarray:
        """Standard normalised power (0 to 1) of ``y``."""
        y = y - y.mean()
        total = (y * y).sum()
        if total == 0:
            return np.zeros(len(self.freqs))
        if self.tables:
            found = ((self.tables[0] * y) @ self.tables[1]).ravel()[: len(self.freqs)]
        else:
            found = waves(self.t, y, self.freqs)
        turned = found * self.turn
        return (turned.real**2 * self.cc + turned.imag**2 * self.ss) / total


def lomb_scargle(t: np.ndarray, y: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Standard normalised power (0 to 1) at each of ``freqs``, which have equal steps."""
    return Spectrum(t, freqs).power(y)


def false_alarm(power: float, n: int, m: int) -> float:
    """Probability that noise reaches the peak at one of m independent frequencies."""
    one = (1 - min(power, 1.0)) ** ((n - 3) / 2) if n > 3 else 1.0
    return float(1 - (1 - one) ** m)


def harmonics(t: np.ndarray, y: np.ndarray, spectrum: Spectrum, power: np.ndarray) -> tuple[list[float], list[float]]:
    """Amplitudes and relative phases of the harmonics of successively removed frequencies; ``power`` is that of ``y``."""
    rest = y - y.mean()
    amplitude, phase = [], []
    for i in range(FREQUENCIES):
        f = spectrum.freqs[(spectrum.power(rest) if i else power).argmax()]
        angles = np.multiply.outer(t, 2 * np.pi * f * np.arange(1, HARMONICS + 1))
        x = np.ones((len(t), 1 + 2 * HARMONICS))
        x[:, 1::2], x[:, 2::2] = np.sin(angles), np.cos(angles)
        coef = np.linalg.lstsq(x, rest, rcond=None)[0]
        s, c = coef[1::2], coef[2::2]
        phases = np.arctan2(c, s)
        amplitude += np.hypot(s, c).tolist()
        relative = phases - phases[0] * np.arange(1, HARMONICS + 1)
        phase += np.arctan2(np.sin(relative), np.cos(relative)).tolist()
        rest = rest - x @ coef
    return amplitude, phase


def autocorrelation_length(y: np.ndarray) -> float:
    """First lag whose autocorrelation falls below 1/e; the length where none does."""
    z = y - y.mean()
    total = (z * z).sum()
    if total == 0:
        return float("nan")
    for lag in range(1, len(z)):
        if (z[lag:] * z[:-lag]).sum() / total < np.exp(-1):
            return float(lag)
    return float(len(z))


def _geometric(first: float, last: float, n: int) -> np.ndarray:
    return first * (last / first) ** (np.arange(n) / (n - 1))


def car1(t: np.ndarray, y: np.ndarray, e: np.ndarray) -> tuple[float, float, float]:
    """sigma, tau and mean of a continuous first-order autoregression, by likelihood over a grid of tau that is refined twice."""
    m = y.mean()
    z, dt, noise = y - m, np.diff(t), e[1:] ** 2

    def negative(taus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negative log likelihoods, and the variances that they have, of ``taus``."""
        a = np.exp(-dt / taus[:, None])
        gap = 1 - a * a
        square = (z[1:] - a * z[:-1]) ** 2
        var = np.maximum((square / np.maximum(gap, 1e-12)).mean(axis=1), 1e-12)
        total = var[:, None] * gap + noise
        return 0.5 * (np.log(total) + square / total).sum(axis=1), var

    taus = _geometric(max(dt.min(), 1e-3) / 2, max(t[-1] - t[0], 1e-2), 40)
    some = max(1, POINTS * BLOCK // max(len(dt), 1))  # so many at once
    for _ in range(3):
        values, var = (np.concatenate(x) for x in zip(*(negative(taus[i : i + some]) for i in range(0, len(taus), some))))
        best = int(values.argmin())
        tau, spread = taus[best], var[best]
        taus = _geometric(taus[max(best - 1, 0)], taus[min(best + 1, len(taus) - 1)], 20)
    return float(np.sqrt(2 * spread / tau)), float(tau), float(m / tau)


def fit(t: np.ndarray, y: np.ndarray, e: np.ndarray) -> list[float]:
    """All values of ``NAMES``; NaN for series of fewer than 5 points or without spread."""
    if len(t) < 5 or t[-1] <= t[0] or y.std() == 0:
        return [float("nan")] * len(NAMES)
    freqs = grid(t)
    spectrum = Spectrum(t, freqs)
    power = spectrum.power(y)
    period = 1 / freqs[power.argmax()]
    folded = y[np.argsort(np.mod(t, 2 * period), kind="stable")]
    n, s = len(y), y.std(ddof=1)
    walk = np.cumsum(folded - folded.mean()) / (n * s)
    amplitude, phase = harmonics(t, y, spectrum, power)
    return [
        period,
        false_alarm(power.max(), n, len(freqs) // OVERSAMPLING),
        walk.max() - walk.min(),
        (np.diff(folded) ** 2).sum() / ((n - 1) * s * s),
        autocorrelation_length(y),
        *car1(t, y, e),
        *amplitude,
        *phase,
    ]


def periodic(nested: DataFrame) -> DataFrame:
    """Features of ``nested`` (sourceid, band, series) by name; null instead of NaN."""

    def run(batches):
        for batch in batches:
            s = batch.column("series")
            lists = [s.field(c) for c in ("mjd", "target", "past_feat_dynamic_real")]
            flat = [np.asarray(x.flatten(), dtype=float) for x in lists]
            cuts = [np.concatenate(([0], np.cumsum(np.asarray(x.value_lengths().fill_null(0))))) for x in lists]
            rows = [fit(*(v[c[i] : c[i + 1]] for v, c in zip(flat, cuts))) for i in range(batch.num_rows)]
            values = np.array(rows, dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("sourceid"), batch.column("band"), *(pa.array(v, mask=~np.isfinite(v)) for v in values.T)], names=["sourceid", "band", *NAMES])

    # fits take far longer than their bytes suggest, so series are dealt evenly instead of by size
    partitions = int(nested.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = nested.select("sourceid", "band", "series").repartition(partitions, "sourceid", "band")
    kinds = dict(src.dtypes)
    return src.mapInArrow(run, f"sourceid {kinds['sourceid']}, band {kinds['band']}, " + ", ".join(f"{n} double" for n in NAMES))


def _peak(t: np.ndarray, y: np.ndarray, first: int, count: int) -> tuple[float, float, int]:
    """The largest power, its frequency, and the number of frequencies, of ``count`` frequencies from the ``first``-th on."""
    if len(t) < 5 or t[-1] <= t[0] or y.std() == 0:
        return float("nan"), float("nan"), 0
    step = 1 / (OVERSAMPLING * (t[-1] - t[0]))
    last = max(2, int(MAX_FREQUENCY / step))
    freqs = step * np.arange(first + 1, min(first + count, last) + 1)
    if not len(freqs):
        return float("nan"), float("nan"), 0
    power = lomb_scargle(t, y, freqs)
    return power.max(), freqs[power.argmax()], len(freqs)


def best_periods(nested: DataFrame, size: int = SLICE) -> DataFrame:
    """(sourceid, band, frequencies, period_ls, period_fit) of ``nested``, a row for every ``size`` frequencies on the way.

    A series travels once for each of its slices, which is once for spans up to
    ``size`` / 50 days.  Of equal powers the smaller frequency stays.  Series of fewer than 5
    points or without spread have no frequencies, and nulls.
    """

    def run(batches):
        for batch in batches:
            s = batch.column("series")
            found = [
                _peak(np.asarray(t.values, dtype=float), np.asarray(y.values, dtype=float), i * size, size) if t.is_valid and y.is_valid else (float("nan"), float("nan"), 0)
                for t, y, i in zip(s.field("mjd"), s.field("target"), batch.column("_slice").to_pylist())
            ]
            power, freq, count = np.array(found, dtype=float).reshape(-1, 3).T
            length = [len(y) if y.is_valid else 0 for y in s.field("target")]
            none = ~np.isfinite(power)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sourceid"), batch.column("band"), pa.array(length, pa.int64()), pa.array(count.astype(np.int64)), pa.array(power, mask=none), pa.array(freq, mask=none)],
                names=["sourceid", "band", "n", "m", "power", "freq"],
            )

    # the last time and the first one give a span, hence the number of frequencies, before any fit
    span = F.expr("array_max(series.mjd) - array_min(series.mjd)")
    last = F.floor(F.when((span > 0) & (span < 1e12), F.lit(OVERSAMPLING * MAX_FREQUENCY) * span / size).otherwise(0.0))
    partitions = int(nested.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = nested.select("sourceid", "band", "series", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("_slice")).repartition(partitions, "sourceid", "band", "_slice")
    kinds = dict(src.dtypes)
    peaks = src.mapInArrow(run, f"sourceid {kinds['sourceid']}, band {kinds['band']}, n long, m long, power double, freq double")
    out = peaks.groupBy("sourceid", "band").agg(F.max("n").alias("n"), F.sum("m").alias("frequencies"), F.max(F.struct("power", (-F.col("freq")).alias("minus"))).alias("b"))
    single = F.when(F.col("n") > 3, F.pow(1 - F.least(F.col("b.power"), F.lit(1.0)), (F.col("n") - 3) / 2)).otherwise(1.0)
    return out.select("sourceid", "band", "frequencies", (-1 / F.col("b.minus")).alias("period_ls"), F.when(F.col("frequencies") > 0, 1 - F.pow(1 - single, F.floor(F.col("frequencies") / OVERSAMPLING))).alias("period_fit"))
