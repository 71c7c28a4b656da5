"""Expressions on embeddings: arrays of floats, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.times import finite


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def time_average(steps: Column) -> Column:
    """Mean over time of array<array<float>>; null for no steps."""
    rows = F.transform(steps, doubles)
    total = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.element_at(rows, 1), add)
    return F.when(F.size(rows) > 0, scale(total, F.size(rows).cast("double")))


def as_steps(v: Column, depth: int) -> Column:
    """Embedding as array of steps: depth 1 is one step, 3 is a batch of one."""
    if depth == 1:
        return F.array(v)
    return v if depth == 2 else v.getItem(0)


def reshape(v: Column, width: int) -> Column:
    """A flat array as rows of ``width``."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, width))


def combine_bands(bands: dict[str, Column], mode: str, missing_as_zeros: int | None = None) -> Column:
    """One vector of several bands, in the order of band names.

    ``concat`` joins them, ``avg`` takes the mean of those present, a band's name
    takes that band, or else the first one present.  A missing band makes
    ``concat`` null unless ``missing_as_zeros`` gives its length.
    """
    vectors = [doubles(bands[b]) for b in sorted(bands)]
    if missing_as_zeros is not None:
        vectors = [F.coalesce(v, F.array_repeat(F.lit(0.0), missing_as_zeros)) for v in vectors]
    if mode == "concat":
        return F.concat(*vectors)
    if mode == "avg":
        there = F.filter(F.array(*vectors), lambda v: v.isNotNull())
        return time_average(there)
    return F.coalesce(doubles(bands[mode]) if mode in bands else F.lit(None), *vectors)


def all_finite(v: Column) -> Column:
    return F.coalesce(F.forall(v, finite), F.lit(False))
