"""Catalogue joins: nesting, identifiers, remarks, and the cone search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_series(catalog: DataFrame, nested: DataFrame, on: str = "sourceid") -> DataFrame:
    """Catalogue rows with their series; rows without any are dropped.  Both sides are hashed once on the key."""
    return catalog.join(nested, on)


def without_series(catalog: DataFrame, nested: DataFrame, on: str = "sourceid") -> DataFrame:
    """Catalogue rows that have no series."""
    return catalog.join(nested.select(on).distinct(), on, "left_anti")


def without_listed(df: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in a table of known outliers."""
    return df.join(listed.select(*on).distinct(), on, "left_anti")


def left_fill(catalog: DataFrame, ident: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Columns of ``ident`` by key, empty text where there is none; of repeated keys the smallest row counts once."""
    one = ident.groupBy(on).agg(F.min(F.struct(*columns)).alias("_i"))
    return catalog.join(one, on, "left").select("*", *[F.coalesce(F.col(f"_i.{c}").cast("string"), F.lit("")).alias(c) for c in columns]).drop("_i")


def remarks_by_id(lines: DataFrame, pattern: str) -> DataFrame:
    """(sourceid, remarks): for every id found in the lines (line_no, value), those lines joined by `` | `` in order."""
    ids = F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))))
    told = lines.select("line_no", "value", ids.alias("sourceid"))
    in_order = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    return told.groupBy("sourceid").agg(F.array_join(F.transform(in_order, lambda r: r["value"]), " | ").alias("remarks"))


def _haversine_arcsec(ra1, dec1, ra2, dec2):
    half = lambda x: F.sin(F.radians(x) / 2)
    a = half(dec2 - dec1) * half(dec2 - dec1) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half(ra2 - ra1) * half(ra2 - ra1)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))) * 3600


def cone_match(stars: DataFrame, objects: DataFrame, radius_arcsec: float = 2.0) -> DataFrame:
    """Pairs (star_id, object_id, sep) within the radius; inputs (star_id, ra, dec) and (object_id, ora, odec) in degrees.

    Sky cells: bands of declination as high as the cell, and right ascension cut
    so that a cell is at least the radius wide at the band's edge farthest from
    the equator.  A star looks into its own and the neighbouring cells of the
    bands around it (right ascension wraps), so the join is an equi-join on the
    cell, refined by the exact separation.
    """
    cell = max(radius_arcsec / 3600 * 2, 1 / 3600)
    bands = int(180 / cell)

    def band(dec):
        return F.least(F.floor((dec + 90) / cell), F.lit(bands)).cast("long")

    def columns(b):  # cells around the sky in a band
        edge = F.greatest(F.abs(b * cell - 90), F.abs((b + 1) * cell - 90))
        return F.greatest(F.floor(F.lit(360.0) * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / cell), F.lit(1)).cast("long")

    right = objects.withColumn("_b", band(F.col("odec"))).withColumn("_n", columns(F.col("_b")))
    right = right.withColumn("_c", F.pmod(F.floor(F.pmod("ora", F.lit(360.0)) / 360 * F.col("_n")).cast("long"), F.col("_n"))).drop("_n")
    left = stars.withColumn("_b", F.explode(F.sequence(band(F.col("dec")) - 1, band(F.col("dec")) + 1))).withColumn("_n", columns(F.col("_b")))
    mine = F.floor(F.pmod("ra", F.lit(360.0)) / 360 * F.col("_n")).cast("long")
    left = left.withColumn("_c", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(mine + d, F.col("_n")))))).drop("_n")
    sep = _haversine_arcsec(F.col("ra"), F.col("dec"), F.col("ora"), F.col("odec"))
    return left.join(right, ["_b", "_c"]).withColumn("sep", sep).filter(F.col("sep") <= radius_arcsec).drop("_b", "_c")

