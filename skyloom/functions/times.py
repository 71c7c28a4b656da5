"""Time, coordinate and text expressions of survey files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mjd_of_timestamp(ts: str) -> Column:
    """Modified Julian Date (days since 1858-11-17) of a timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") / F.lit(86400000000.0) + F.lit(40587)


def timestamp_of_mjd(mjd: Column) -> Column:
    """Timestamp without time zone of a Modified Julian Date, to the microsecond."""
    micros = F.round((mjd - 40587) * F.lit(86400000000.0)).cast("bigint")
    return F.timestamp_micros(micros)


def mjd_of_hjd_text(first: Column, text: Column) -> Column:
    """MJD of a Heliocentric Julian Date written out in full (13 characters) or less 2450000 (9 or 10).

    ``first`` is a sample entry of the file, whose length tells the form for the whole file; another length fails.
    """
    n = F.length(first)
    return (
        F.when(n == 13, text.cast("double") - 2400000.5)
        .when(n.isin(9, 10), text.cast("double") + 2450000 - 2400000.5)
        .otherwise(F.raise_error(F.concat(F.lit("unexpected time format: "), F.coalesce(first, F.lit("null")))).cast("double"))
    )


def degrees_of_sexagesimal(text: Column, hours: bool = False) -> Column:
    """Decimal degrees of ``[+-]dd:mm:ss`` (or hours, times 15); the sign is read from the string, so -00 keeps it; other text is null."""
    parts = F.split(F.regexp_replace(F.trim(text), r"^[+-]", ""), r"[:\s]+")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    size = part(0) + part(1) / 60 + part(2) / 3600
    return F.when(F.trim(text).startswith("-"), -size).otherwise(size) * (15 if hours else 1)


def colon_coordinate(text: Column, declination: bool = False) -> Column:
    """``d m s`` as zero-filled ``dd:mm:ss``; text of another form passes unchanged."""
    parts = F.split(F.trim(text), r"\s+")
    head, minutes, seconds = (F.get(parts, F.lit(i)) for i in range(3))
    fill = lambda c, n: F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)
    if declination:
        sign = F.when(head.startswith("-"), "-").otherwise("+")
        out = F.concat(sign, fill(F.regexp_replace(head, r"^[+-]+", ""), 2), F.lit(":"), fill(minutes, 2), F.lit(":"), fill(seconds, 4))
    else:
        out = F.concat(fill(head, 2), F.lit(":"), fill(minutes, 2), F.lit(":"), fill(seconds, 5))
    return F.when(F.size(parts) == 3, out).otherwise(text)


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    x = x.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def mean_std_text(mean: Column, std: Column) -> Column:
    return F.format_string("%.4f ± %.4f", mean, std)


def null_if_missing(c: Column) -> Column:
    """Survey files write a missing value as a dash or leave it empty."""
    return F.when(F.trim(c).isin("-", ""), None).otherwise(c)
