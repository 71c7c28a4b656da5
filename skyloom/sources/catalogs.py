"""Readers of survey files: layouts are data, parsing is column expressions.

Every reader takes a path (file, directory or glob) and gives one DataFrame; the
file a row came from is in ``_metadata.file_path`` where an id or band is part of
the name.  A missing value in a catalogue is a dash or empty and becomes null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import times

# Class numbers of the Catalina catalogue.
CATALINA_CLASSES = {
    1: "EW", 2: "EA", 3: "Beta_Lyrae", 4: "RRab", 5: "RRc", 6: "RRd", 7: "Blazhko", 8: "RS CVn", 9: "ACEP",
    10: "Cep-II", 11: "HADS", 12: "LADS", 13: "LPV", 14: "ELL", 15: "Hump", 16: "PCEB", 17: "EA_UP",
}

# Names of the columns of one period; later periods carry their number.
PERIOD_COLUMNS = ("period", "period_unc", "time_of_peak[HJD]", "amp_I", "fourier_R21", "fourier_phi21", "fourier_R31", "fourier_phi31")

# Number of periods by sub-type of the pulsating families.
PERIODS = {
    "cepF": 1, "cep1O": 1, "cep2O": 1, "RRab": 1, "RRc": 1, "t2cep": 1, "acepF": 1, "acep1O": 1,
    "cepF1O": 2, "cep1O2O": 2, "cep1O3O": 2, "cep2O3O": 2, "RRd": 2, "aRRd": 2,
    "cepF1O2O": 3, "cep1O2O3O": 3,
}

# Columns of whitespace-delimited catalogues outside the pulsating families; extra ones go to the remarks.
DELIMITED = {
    "lpv": (("sourceid", "avg_mag_I", "avg_mag_V", "period", "amp_I"), ()),
    "rot": (("sourceid", "avg_mag_V", "p_amp_V", "avg_mag_I", "p_amp_I", "period"), ("p_amp_V", "p_amp_I")),
    "transits": (("sourceid", "avg_mag_I", "avg_mag_V", "period", "t_inferior_conj", "t_14", "depth", "prob_planet", "SNR"), ("t_inferior_conj", "t_14", "depth", "prob_planet", "SNR")),
}

# Fixed values: (start, end) of fixed-width fields.
DSCT_FIELDS = (
    (0, 19), (21, 27), (28, 34),
    (36, 46), (47, 57), (59, 69), (71, 76), (78, 83), (84, 89), (91, 96), (97, 102),
    (104, 114), (115, 125), (127, 137), (139, 144), (146, 151), (152, 157), (159, 164), (165, 170),
    (172, 182), (183, 193), (195, 205), (207, 212), (214, 219), (220, 225), (227, 232), (234, 238),
)
HB_FIELDS = ((0, 16), (17, 23), (24, 30), (31, 44), (45, 55), (56, 61), (62, 68), (69, 74), (75, 81), (82, 91), (92, 94))
HB_NAMES = ("sourceid", "avg_mag_I", "avg_mag_V", "period", "t_peri_passage", "amp_I", "orbit_ecc", "orbit_incl", "arg_peri", "variability", "model_flag")
HB_EXTRA = ("t_peri_passage", "orbit_ecc", "orbit_incl", "arg_peri", "variability", "model_flag")
ECL_FIELDS = {
    "blg": ((0, 19), (21, 27), (28, 34), (35, 47), (49, 58), (60, 65), (66, 71)),
    "lmc": ((0, 18), (20, 26), (27, 33), (34, 46), (48, 60), (62, 67), (68, 73)),
    "smc": ((0, 18), (20, 26), (27, 33), (34, 46), (48, 60), (62, 67), (68, 73)),
}
ECL_NAMES = ("sourceid", "max_mag_I", "max_mag_V", "period", "t_p_ecl", "depth_p_ecl", "depth_s_ecl")
ECL_EXTRA = ("max_mag_I", "max_mag_V", "t_p_ecl", "depth_p_ecl", "depth_s_ecl")

# Identification tables, (start, end) of fields at shift 0.
IDENT_FIELDS = {
    "cep": ((0, 16), (17, 25), (27, 38), (39, 50), (52, 68), (69, 84), (85, 100), (101, 120)),
    "rrlyr": ((0, 20), (22, 26), (28, 39), (40, 51), (53, 69), (70, 85), (86, 101), (102, 121)),
    "dsct": ((0, 19), (21, 31), (33, 44), (45, 56), (58, 74), (75, 90), (91, 107), (108, 130)),
    "lpv": ((0, 19), (21, 25), (27, 38), (39, 50), (52, 68), (69, 84), (85, 101), (102, 130)),
    "t2cep": ((0, 19), (21, 26), (28, 39), (40, 51), (53, 69), (70, 85), (86, 101), (102, 130)),
    "acep": ((0, 17), (18, 21), (23, 34), (35, 46), (48, 64), (65, 80), (81, 96), (97, 130)),
    "hb": ((0, 16), (17, 19), (20, 31), (32, 43), (44, 60), (61, 76), (77, 92), (93, 130)),
    "ecl": ((0, 19), (21, 24), (25, 36), (37, 48), (50, 66), (67, 82), (83, 98), (99, 130)),
    "rot": ((0, 19), (19, 30), (31, 43), (44, 60), (61, 76), (77, 93), (94, 130)),
    "transits": ((0, 12), (13, 24), (25, 36), (37, 53), (54, 69), (70, 85), (86, 131)),
}
# By how much all edges but the line's start move in a region.
IDENT_SHIFT = {
    "cep": {"blg": 0, "gd": 1, "lmc": 1, "smc": 1},
    "rrlyr": {"blg": 0, "lmc": 0, "gd": -1, "smc": -1},
    "dsct": {"blg": 0, "lmc": 0, "smc": -1, "gd": -2},
    "lpv": {"blg": 0, "gd": -1},
    "t2cep": {"blg": 0, "gd": -1, "lmc": -1, "smc": -2},
    "acep": {"gal": 0, "lmc": 0, "smc": 0},
    "hb": {"blg": 0, "lmc": 0, "smc": 0},
    "ecl": {"blg": 0, "lmc": -1, "smc": -1},
}
IDENT_NAMES = ("sourceid", "type", "ra", "dec", "OGLE_IV_id", "OGLE_III_id", "OGLE_II_id", "other_id")
#: Families whose class is completed by the type of the identification table.
TYPED = ("dsct", "t2cep", "acep", "hb", "ecl")
#: Tasks that list folders of light curves.
LISTERS = 64


def period_columns(n: int) -> list[str]:
    """Column names of n periods."""

    def numbered(name: str, i: int) -> str:
        if i == 1:
            return name
        for stem in ("period", "time_of_peak", "amp", "fourier"):
            if name.startswith(stem):
                return f"{stem}{i}{name[len(stem):]}"
        return f"{name}{i}"

    return [numbered(c, i) for i in range(1, n + 1) for c in PERIOD_COLUMNS]


def _lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """Lines with their number in the file, less the first ``skip``.

    Files are read split by split.  A split's lines are numbered by Spark as they
    are read, so a line's number is its distance from the split's first one after
    the lines of the file's splits before; those counts are one row a split.
    """
    raw = spark.read.text(path)
    if not skip:
        return raw
    raw = raw.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block")) - F.col("_n")
    numbered = raw.join(splits.select("_path", "_block", (before - F.col("_first")).alias("_shift")), ["_path", "_block"])
    return numbered.select((F.col("_id") + F.col("_shift")).alias("line_no"), "value").filter(F.col("line_no") >= skip)


def _cell(c: Column, kind: str) -> Column:
    return times.null_if_missing(F.trim(c)).try_cast(kind) if kind != "string" else times.null_if_missing(F.trim(c))


def delimited(spark: SparkSession, path: str, names, kinds=None, skip: int = 0) -> DataFrame:
    """Columns separated by runs of white space, after ``skip`` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    kinds = kinds or ["string"] * len(names)
    rows = _lines(spark, path, skip).filter(F.trim("value") != "")
    return rows.select(*[_cell(F.get(parts, F.lit(i)), k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])


def shifted(fields, shift: int):
    """Fields of a region: every edge but the line's start moves."""
    return tuple((a + shift if i else a, b + shift) for i, (a, b) in enumerate(fields))


def fixed_width(spark: SparkSession, path: str, fields, names, kinds=None) -> DataFrame:
    """Columns at character positions.

    A first field that is longer than its place (writers pad names but do not cut them) is read to its end,
    and the rest of its line is moved by as much; that needs a blank between the first two fields of the layout.
    """
    kinds = kinds or ["string"] * len(names)
    rows = spark.read.text(path).filter(F.trim("value") != "")
    over = F.lit(0)
    if len(fields) > 1 and fields[1][0] > fields[0][1]:
        run = F.regexp_extract(F.substring("value", fields[0][1], 1 << 30), r"^\S+", 0)  # from the field's last place on
        over = F.greatest(F.length(run) - 1, F.lit(0))
    rows = rows.withColumn("_over", over)
    at = lambda i, a, b: F.substring(F.col("value"), F.lit(a + 1) + F.col("_over"), F.lit(b - a)) if i else F.substring(F.col("value"), F.lit(a + 1), F.lit(b - a) + F.col("_over"))
    return rows.select(*[_cell(at(i, a, b), k).alias(n) for i, ((a, b), n, k) in enumerate(zip(fields, names, kinds))])


def photometry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless observations: ID, mjd, mag, magunc, RA, Dec; times after 0 only."""
    return spark.read.schema("ID bigint, mjd double, mag double, magunc double, RA double, Dec double").csv(path, header=False).filter("mjd > 0")


def catalina_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue after its two header lines: rows with a period, coordinates in degrees, class names."""
    raw = delimited(spark, path, ("CS_ID", "Numerical_ID", "RA", "Dec", "magV", "P_d", "Amp", "n_obs", "class"), skip=2)
    names = F.create_map(*[F.lit(x) for pair in CATALINA_CLASSES.items() for x in pair])
    return (
        raw.filter(F.col("P_d").isNotNull() & ~F.col("P_d").rlike(r"^\\*nodata$"))
        .withColumn("ra", times.degrees_of_sexagesimal(F.col("RA"), hours=True))
        .withColumn("dec", times.degrees_of_sexagesimal(F.col("Dec")))
        .select(
            F.col("CS_ID").alias("sourceid"),
            F.col("Numerical_ID").alias("numerical_id"),
            F.col("magV").try_cast("double").alias("avg_mag_V"),
            F.col("P_d").try_cast("double").alias("period"),
            F.try_element_at(names, F.col("class").try_cast("int")).alias("class_str"),
            F.col("class").try_cast("bigint").alias("class_int"),
            "ra",
            "dec",
        )
    )


def catalina(spark: SparkSession, curves: str, catalog: str) -> DataFrame:
    """One row per catalogue star with its series in band C."""
    from skyloom.operators import lightcurve

    lc = photometry_csv(spark, curves).select(F.col("ID").cast("string").alias("sourceid"), F.lit("C").alias("band"), "mjd", "mag", F.col("magunc").alias("err"), F.xxhash64("mag", "magunc").alias("obs_id"))
    series = lightcurve.nest(lc).select(F.col("sourceid").try_cast("bigint").alias("_id"), F.create_map("band", "series").alias("bands_data"))
    stars = catalina_catalog(spark, catalog).withColumn("_id", F.col("numerical_id").try_cast("bigint"))
    return stars.join(series, "_id").drop("_id")


def star_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """The coordinate catalogue after its 34 lines of preamble; degrees carry the sign in their text, so -00 stays negative."""
    names = ("ID", "RAh", "RAm", "RAs", "Decsign", "DEm", "DEs", "magV", "P", "Amp", "class", "flag")
    raw = delimited(spark, path, names, skip=34)
    ra = F.concat_ws(":", "RAh", "RAm", "RAs")
    dec = F.concat_ws(":", "Decsign", "DEm", "DEs")
    return raw.select(F.col("ID").alias("star_id"), times.degrees_of_sexagesimal(ra, hours=True).alias("ra"), times.degrees_of_sexagesimal(dec).alias("dec"), F.col("P").try_cast("double").alias("period"), "class")


def with_remarks_of(df: DataFrame, extra) -> DataFrame:
    """``extra`` columns as text ``name=value | ...`` in ``remarks``; a missing value reads nan."""
    pieces = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in extra]
    return df.withColumn("remarks", F.concat_ws(" | ", *pieces)).drop(*extra)


def ogle_catalog(spark: SparkSession, folder: str, region: str, family: str, sub_type: str) -> DataFrame:
    """A catalogue in the columns of three periods: region, family, sub-type and class are added."""
    region, family = region.lower(), family.lower()
    extra: tuple[str, ...] = ()
    if family in ("cep", "rrlyr", "t2cep", "acep"):
        if sub_type not in PERIODS:
            raise NotImplementedError(f"sub-type {sub_type}")
        names = ["sourceid", "avg_mag_I", "avg_mag_V", *period_columns(PERIODS[sub_type])]
        df = delimited(spark, f"{folder}/{sub_type}.dat", names, ["string"] + ["double"] * (len(names) - 1))
    elif family in DELIMITED:
        names, extra = DELIMITED[family]
        file = {"lpv": f"{sub_type}s.dat", "rot": f"{sub_type.lower()}.dat"}.get(family, f"{sub_type}.dat")
        df = delimited(spark, f"{folder}/{file}", names, ["string"] + ["double"] * (len(names) - 1))
    elif family == "dsct":
        shift = {"blg": 0, "lmc": 0, "smc": -1, "gd": -2}[region]
        names = ["sourceid", "avg_mag_I", "avg_mag_V", *period_columns(3)]
        df = fixed_width(spark, f"{folder}/{sub_type}.dat", shifted(DSCT_FIELDS, shift), names, ["string"] + ["double"] * (len(names) - 1))
    elif family == "hb":
        if region not in IDENT_SHIFT["hb"]:
            raise NotImplementedError(f"hb in {region}")
        extra = HB_EXTRA
        df = fixed_width(spark, f"{folder}/{sub_type}.dat", HB_FIELDS, HB_NAMES, [("string" if n in ("sourceid", "variability", "model_flag") else "double") for n in HB_NAMES])
    elif family == "ecl":
        if region not in ECL_FIELDS:
            raise NotImplementedError(f"ecl in {region}")
        extra = ECL_EXTRA
        df = fixed_width(spark, f"{folder}/{sub_type}.dat", ECL_FIELDS[region], ECL_NAMES, ["string"] + ["double"] * (len(ECL_NAMES) - 1))
    else:
        raise NotImplementedError(f"family {family}")
    df = with_remarks_of(df, extra) if extra else df.withColumn("remarks", F.lit(""))
    for c in ["avg_mag_I", "avg_mag_V", *period_columns(3)]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    own = "" if family in TYPED else sub_type
    return df.withColumns({"region": F.lit(region), "parent_type": F.lit(family), "sub_type": F.lit(own), "class_str": F.lit(own)})


def ogle_ident(spark: SparkSession, path: str, region: str, family: str) -> DataFrame:
    """The identification table; coordinates in colons."""
    region, family = region.lower(), family.lower()
    if family not in IDENT_FIELDS or (family in IDENT_SHIFT and region not in IDENT_SHIFT[family]):
        raise NotImplementedError(f"{family} in {region}")
    fields = shifted(IDENT_FIELDS[family], IDENT_SHIFT.get(family, {}).get(region, 0))
    names = [n for n in IDENT_NAMES if n != "type" or len(fields) == 8]
    df = fixed_width(spark, path, fields, names)
    if family == "hb":
        df = df.withColumn("ra", times.colon_coordinate(F.col("ra"))).withColumn("dec", times.colon_coordinate(F.col("dec"), declination=True))
    return df


def with_ident(catalog: DataFrame, ident: DataFrame, family: str) -> DataFrame:
    """Catalogue rows with their identifiers; the class of typed families is ``family_type``."""
    from skyloom.operators import joins

    columns = [c for c in ident.columns if c != "sourceid" and (c != "type" or family in TYPED)]
    out = joins.left_fill(catalog, ident, "sourceid", columns)
    if family in TYPED:
        out = out.withColumn("sub_type", F.col("type")).withColumn("class_str", F.concat_ws("_", F.lit(family), "type")).drop("type")
    return out


def ogle_remarks(spark: SparkSession, path: str, region: str, family: str) -> DataFrame:
    """(sourceid, remarks) of all identifiers named in the remark lines."""
    from skyloom.operators import joins

    lines = _lines(spark, path, 0).withColumn("line_no", F.monotonically_increasing_id())
    return joins.remarks_by_id(lines, rf"\S*OGLE-{region.upper()}-{family.upper()}\S*")


def with_remarks(catalog: DataFrame, remarks: DataFrame) -> DataFrame:
    """Remarks appended to those a catalogue row has."""
    told = remarks.withColumnRenamed("remarks", "_more")
    both = F.concat_ws(" | ", F.when(F.col("remarks") != "", F.col("remarks")), F.col("_more"))
    return catalog.join(told, "sourceid", "left").withColumn("remarks", both).drop("_more")


def _found(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all text files below a folder, or of a glob's.

    Folders are listed by ``LISTERS`` tasks; Spark's own number is one task a folder, and a glob that names files is walked on the driver alone.
    """
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), LISTERS)))
    try:
        return spark.read.option("recursiveFileLookup", "true").text(path)  # listed here
    finally:
        spark.conf.set(key, before)


def ogle_light_curves(spark: SparkSession, glob: str, layout: str = r"([^/]+)/([^/]+)\.[^./]+$") -> DataFrame:
    """Observations of all files ``.../<band>/<id>.dat`` below a folder or of a glob: sourceid, band, mjd, mag, err, obs_id; ``layout`` finds band and id in a path.

    The length of a file's first time tells how all its times are written.  The
    first line is the one of the first block that its task reads first, so files
    are read split by split and none is opened alone.
    """
    parts = F.split(F.trim("value"), r"\s+")
    raw = _found(spark, glob).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")).filter(F.trim("value") != "")
    rows = raw.select("path", F.get(parts, F.lit(0)).alias("time"), F.get(parts, F.lit(1)).cast("double").alias("mag"), F.get(parts, F.lit(2)).cast("double").alias("err"))
    ordered = raw.select("path", F.get(parts, F.lit(0)).alias("time"), F.struct("block", F.monotonically_increasing_id()).alias("place"))
    first = ordered.groupBy("path").agg(F.min_by("time", "place").alias("first"))
    return rows.join(first, "path").select(
        F.regexp_extract("path", layout, 2).alias("sourceid"), F.regexp_extract("path", layout, 1).alias("band"), times.mjd_of_hjd_text(F.col("first"), F.col("time")).alias("mjd"), "mag", "err", F.xxhash64("mag", "err").alias("obs_id")
    )


def macho_shards(spark: SparkSession, path: str) -> DataFrame:
    """Observations of Parquet shards newID, mjd, mag, errmag in double precision; a star may span shards."""
    raw = spark.read.schema("newID bigint, mjd float, mag float, errmag float").parquet(path)
    return raw.select(F.col("newID").cast("string").alias("sourceid"), F.lit("r").alias("band"), F.col("mjd").cast("double"), F.col("mag").cast("double"), F.col("errmag").cast("double").alias("err"), F.xxhash64("mag", "errmag").alias("obs_id"))


def collections(spark: SparkSession, path: str) -> DataFrame:
    """(region, family, sub_type) of a JSON file of triples."""
    raw = spark.read.text(path, wholetext=True)
    triples = F.from_json("value", "array<array<string>>")
    return raw.select(F.explode(triples).alias("t")).select(F.col("t")[0].alias("region"), F.col("t")[1].alias("family"), F.col("t")[2].alias("sub_type"))


def unified(frames: list[DataFrame]) -> DataFrame:
    """One table of several catalogues; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
