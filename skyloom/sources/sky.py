"""Sky catalogues in a tree of equal-area pixels.

Pixels are those of the published hierarchical scheme with twelve base pixels, each cut into
four again and again, numbered so that a pixel's number is its parent's with two bits
more.  Numbers come from built-in functions.

``write_catalog`` puts rows into folders norder=<order>/npix=<pixel>: a pixel is cut while it
has more than ``limit`` rows, so folders hold about as many rows in crowded parts of the sky as in
empty ones.  Every row carries its number at order 29.  ``cone_search`` finds the pixels that the
cones touch, so only their folders are read, and joins on fine pixels, a few of which
a cone touches; the exact separation decides.

Defined cases: rows without coordinates are not stored and match nothing; right ascension
wraps; the poles are points of their pixels; rows at one place stay together, so a folder
at ``DEEPEST`` may hold more than ``limit``; rows that repeat are stored and matched as
often; ids are passed through; an empty catalogue or list of stars gives no pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order of the number that rows carry, and of the smallest folders.
FULL, DEEPEST = 29, 8
#: Points around a cone whose pixels are looked up, at twice its radius.
AROUND = 24


def _spread(x: Column) -> Column:
    """The bits of a number at the even places: its binary digits read as digits of base 4."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def with_pixel(df: DataFrame, name: str, ra: Column, dec: Column, order: int = FULL) -> DataFrame:
    """``df`` with ``name``, the number of the pixel that holds a place (degrees); null without coordinates.

    Steps are columns of their own (names starting with ``_sky_``), so that no expression is repeated within another.
    """
    n = 1 << order
    whole = lambda c: F.floor(c).cast("long")
    c = lambda x: F.col(f"_sky_{x}")
    put = lambda d, **columns: d.withColumns({f"_sky_{k}": v for k, v in columns.items()})
    out = put(df, at=F.pmod(ra, F.lit(360.0)) / 90, dec=dec)
    # around the poles, 1 - |z| = 2 sin^2 of half the distance to the pole keeps its digits
    out = put(out, z=F.sin(F.radians(c("dec"))), quarter=F.least(whole(c("at")), F.lit(3).cast("long")), width=n * math.sqrt(6) * F.sin(F.radians(90 - F.abs(c("dec"))) / 2))
    # around the equator, pixels are squares in (at + z, at - z)
    out = put(out, up=whole(n * (0.5 + c("at")) - n * 0.75 * c("z")), down=whole(n * (0.5 + c("at")) + n * 0.75 * c("z")), part=c("at") - c("quarter"), belt=F.abs(c("z")) <= 2 / 3)
    top = F.lit(n - 1).cast("long")
    out = put(out, fp=F.shiftright(c("up"), order), fm=F.shiftright(c("down"), order), a=F.least(whole(c("part") * c("width")), top), b=F.least(whole((1 - c("part")) * c("width")), top))
    belt_face = F.when(c("fp") == c("fm"), F.pmod(c("fp"), F.lit(4)) + 4).when(c("fp") < c("fm"), F.pmod(c("fp"), F.lit(4))).otherwise(F.pmod(c("fm"), F.lit(4)) + 8)
    north = c("dec") > 0
    out = put(
        out,
        face=F.when(c("belt"), belt_face).otherwise(F.when(north, c("quarter")).otherwise(c("quarter") + 8)),
        x=F.when(c("belt"), c("down").bitwiseAND(top)).otherwise(F.when(north, top - c("b")).otherwise(c("a"))),
        y=F.when(c("belt"), top - c("up").bitwiseAND(top)).otherwise(F.when(north, top - c("a")).otherwise(c("b"))),
    )
    out = out.withColumn(name, F.shiftleft(c("face"), 2 * order) + _spread(c("x")) + F.shiftleft(_spread(c("y")), 1))
    return out.drop(*[x for x in out.columns if x.startswith("_sky_")])


def coarser(number: Column, order: int, to: int) -> Column:
    """The pixel of order ``to`` that holds a pixel of ``order``."""
    return F.shiftright(number, 2 * (order - to))


def tree(pixels: DataFrame, limit: int) -> DataFrame:
    """(pix, norder, npix): the folder of every pixel of order ``DEEPEST`` in pixels(pix); a folder is the largest pixel of ``limit`` rows at most.

    One row a pixel of that order that holds rows, 786,432 at most.
    """
    counted = pixels.groupBy("pix").agg(F.count(F.lit(1)).alias("n"))
    order = F.lit(DEEPEST)
    for o in range(DEEPEST - 1, -1, -1):
        counted = counted.withColumn(f"n{o}", F.sum("n").over(Window.partitionBy(coarser(F.col("pix"), DEEPEST, o))))
        order = F.when(F.col(f"n{o}") <= limit, F.lit(o)).otherwise(order)
    found = counted.select("pix", order.alias("norder"))
    return found.withColumn("npix", F.expr(f"shiftright(pix, 2 * ({DEEPEST} - norder))"))


def write_catalog(objects: DataFrame, path: str, ra: str = "ora", dec: str = "odec", limit: int = 1_000_000) -> None:
    """Write ``objects`` to ``path``/data, a folder a pixel, and the tree to ``path``/tree."""
    spark = objects.sparkSession
    rows = with_pixel(objects, "_pixel", F.col(ra), F.col(dec)).filter("_pixel IS NOT NULL")
    tree(rows.select(coarser(F.col("_pixel"), FULL, DEEPEST).alias("pix")), limit).write.parquet(f"{path}/tree")
    placed = rows.withColumn("pix", coarser(F.col("_pixel"), FULL, DEEPEST)).join(spark.read.parquet(f"{path}/tree"), "pix").drop("pix")
    # by pixel, and within a crowded one by order 29, so that a folder has few files and none gathers in one task
    placed.repartitionByRange("norder", "npix", "_pixel").write.partitionBy("norder", "npix").parquet(f"{path}/data")


def touched(stars: DataFrame, radius_arcsec: float, order: int) -> DataFrame:
    """``stars`` (ra, dec) with ``fine``: each pixel of ``order`` that a cone touches (and perhaps one more), a row each."""
    known = stars.filter("ra IS NOT NULL AND dec IS NOT NULL").withColumn("_row", F.monotonically_increasing_id())
    around = known.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(AROUND))))  # 0: the star itself
    r = math.radians(2 * radius_arcsec / 3600)
    turn = F.col("_i") * F.lit(2 * math.pi / AROUND)
    around = around.withColumns({"_a": F.radians("ra"), "_d": F.radians("dec"), "_n": math.sin(r) * F.cos(turn), "_e": math.sin(r) * F.sin(turn)})
    # r from the star, so far to the north and to the east of its direction; at the poles as well
    inward = F.lit(math.cos(r)) * F.cos("_d") - F.col("_n") * F.sin("_d")
    around = around.withColumns({"_x": inward * F.cos("_a") - F.col("_e") * F.sin("_a"), "_y": inward * F.sin("_a") + F.col("_e") * F.cos("_a"), "_z": F.lit(math.cos(r)) * F.sin("_d") + F.col("_n") * F.cos("_d")})
    own = F.col("_i") == 0
    flat = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    around = around.withColumns({"_ra": F.when(own, F.col("ra")).otherwise(F.degrees(F.atan2("_y", "_x"))), "_dec": F.when(own, F.col("dec")).otherwise(F.degrees(F.atan2(F.col("_z"), flat)))})
    return with_pixel(around, "fine", F.col("_ra"), F.col("_dec"), order).dropDuplicates(["_row", "fine"]).select(*stars.columns, "fine")


def order_for(radius_arcsec: float) -> int:
    """The finest order whose pixels are four radii wide at least."""
    width = 0.5 * math.degrees(math.sqrt(math.pi / 3)) * 3600
    return max(2, min(FULL, int(math.log2(max(width / (4 * max(radius_arcsec, 1e-6)), 1)))))


def folders(spark: SparkSession, cones: DataFrame, path: str, order: int) -> Column:
    """A filter on the folders that touched cones lie in; the list has at most one entry a folder."""
    common = min(order, DEEPEST)
    known = spark.read.parquet(f"{path}/tree").withColumn("pix", coarser(F.col("pix"), DEEPEST, common))
    mine = cones.select(coarser(F.col("fine"), order, common).alias("pix")).distinct().join(known, "pix").select("norder", "npix").distinct()
    by: dict[int, list[int]] = {}
    for r in mine.collect():
        by.setdefault(r["norder"], []).append(r["npix"])
    out = F.lit(False)
    for o, pixels in sorted(by.items()):
        out = out | ((F.col("norder") == o) & F.col("npix").isin(sorted(pixels)))
    return out


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle between two places in seconds of arc."""
    half = lambda x: F.sin(F.radians(x) / 2)
    a = half(dec2 - dec1) * half(dec2 - dec1) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half(ra2 - ra1) * half(ra2 - ra1)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))) * 3600


def cone_search(stars: DataFrame, path: str, radius_arcsec: float = 2.0, ra: str = "ora", dec: str = "odec") -> DataFrame:
    """Pairs of ``stars`` (with ra, dec) and rows of a written catalogue within the radius, with ``sep``; only the folders that cones touch are read."""
    spark = stars.sparkSession
    if radius_arcsec > 6000:
        raise ValueError("the radius may be 6,000 seconds of arc at most: the pixels of the coarsest order used are four times as wide")
    order = order_for(radius_arcsec)
    cones = touched(stars, radius_arcsec, order)
    data = spark.read.parquet(f"{path}/data").filter(folders(spark, cones, path, order))
    there = data.withColumn("fine", coarser(F.col("_pixel"), FULL, order)).drop("_pixel", "norder", "npix")
    sep = separation(F.col("ra"), F.col("dec"), F.col(ra), F.col(dec))
    return cones.join(there, "fine").withColumn("sep", sep).filter(F.col("sep") <= radius_arcsec).drop("fine")
