"""Readers of survey and result files: the driver's tables are written in a file's layout and read back; the SQL works on the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators import evaluate
from skyloom.plans.inputs import table
from skyloom.plans.registry import query
from skyloom.sources import catalogs, results, scratch


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _files(rows: DataFrame, name: str, by: list[str], order: list[str]) -> str:
    """Lines ``value`` of each group in one file ``<by>=.../part*``, in order; the folder they are in."""
    path = scratch.folder(rows.sparkSession, name)
    rows.repartition(*by).sortWithinPartitions(*by, *order).select("value", *by).write.partitionBy(*by).text(path)
    return path


def _with_preamble(rows: DataFrame, lines: int) -> DataFrame:
    """(part, place, value) of ``rows`` (part, value) with so many lines before each part's own."""
    head = rows.select("part").distinct().select("part", F.explode(F.sequence(F.lit(-lines), F.lit(-1))).alias("place"), F.lit("# preamble - - 0").alias("value"))
    return rows.select("part", F.lit(0).alias("place"), "value").unionByName(head)


@query("""
SELECT user_id AS "ID", event_id::DOUBLE + 0.25 AS mjd, value AS mag, 0.5::DOUBLE AS magunc, 10.5::DOUBLE AS "RA", -3.0::DOUBLE AS "Dec" FROM events WHERE event_id % 5 > 1
""")
def read_photometry(spark, sf_dir):
    """Headerless observations; times of 0 and before go."""
    e = table(spark, sf_dir, "events")
    kind = F.pmod("event_id", F.lit(5))
    time = F.when(kind == 0, F.lit(0.0)).when(kind == 1, -F.col("event_id").cast("double") - 0.25).otherwise(F.col("event_id").cast("double") + 0.25)
    path = scratch.folder(spark, "photometry")
    e.select("user_id", time.alias("t"), "value", F.lit(0.5), F.lit(10.5), F.lit(-3.0)).write.csv(path)
    return catalogs.photometry_csv(spark, path)


@query("""
SELECT concat('OGLE-LMC-CEP-', c_custkey) AS sourceid, c_acctbal AS "avg_mag_I", NULL::DOUBLE AS "avg_mag_V", c_nationkey::DOUBLE AS period, NULL::DOUBLE AS period_unc, 0.25::DOUBLE AS "amp_I",
  NULL::DOUBLE AS period2, 'lmc' AS region, 'cep' AS parent_type, 'cep1O' AS sub_type, 'cep1O' AS class_str, '' AS remarks FROM customer
""")
def read_delimited_catalog(spark, sf_dir):
    """A catalogue separated by runs of spaces, in the columns of three periods."""
    c = table(spark, sf_dir, "customer")
    line = _text("OGLE-LMC-CEP-", F.col("c_custkey"), "  ", F.col("c_acctbal"), "   -  ", F.col("c_nationkey"), " -  7000.5 0.25  0.1 1 2   3 ")
    path = scratch.folder(spark, "delimited")
    c.select(line.alias("value")).write.text(f"{path}/cep1O.dat")
    out = catalogs.ogle_catalog(spark, path, "LMC", "cep", "cep1O")
    return out.select("sourceid", "avg_mag_I", "avg_mag_V", "period", "period_unc", "amp_I", "period2", "region", "parent_type", "sub_type", "class_str", "remarks")


@query("""
SELECT concat('CSS_', s_suppkey) AS sourceid, CAST(s_suppkey AS VARCHAR) AS numerical_id, s_acctbal AS "avg_mag_V", 0.5::DOUBLE AS period,
  CASE s_nationkey % 3 WHEN 0 THEN 'EW' WHEN 1 THEN 'RRab' END AS class_str, CASE s_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 99 END::BIGINT AS class_int,
  round((s_suppkey % 24 + 0.5) * 15, 6)::DOUBLE AS ra, round(-(s_suppkey % 60) / 60.0::DOUBLE, 6) AS dec
FROM supplier WHERE s_suppkey % 4 <> 3
""")
def read_catalina_catalog(spark, sf_dir):
    """A catalogue after two lines of preamble; rows without a period go, degrees keep the sign of -00."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    number = F.pmod("s_nationkey", F.lit(3))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    period = F.when(F.pmod(key, F.lit(4)) == 3, F.lit("\\nodata")).otherwise(F.lit("0.5"))
    line = _text("CSS_", key, " ", key, "  ", F.pmod(key, F.lit(24)), ":30:00 -00:", two(F.pmod(key, F.lit(60))), ":00 ", F.col("s_acctbal"), " ", period, " 0.3 2 ", F.when(number == 0, F.lit(1)).when(number == 1, F.lit(4)).otherwise(F.lit(99)))
    path = _files(_with_preamble(s.select(F.pmod(key, F.lit(4)).alias("part"), line.alias("value")), 2), "catalina", ["part"], ["place"])
    out = catalogs.catalina_catalog(spark, f"{path}/*/*")
    return out.withColumns({c: F.round(c, 6) for c in ("ra", "dec")})


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS star_id, round(((s_suppkey % 24) + 30 / 60.0::DOUBLE) * 15, 6) AS ra, -0.5::DOUBLE AS dec, s_nationkey::DOUBLE AS period, 'RR' AS class FROM supplier
""")
def read_star_coordinates(spark, sf_dir):
    """Coordinates after 34 lines of preamble."""
    s = table(spark, sf_dir, "supplier")
    line = _text(F.col("s_suppkey"), " ", F.pmod("s_suppkey", F.lit(24)), " 30 0 -00 30 00 14 ", F.col("s_nationkey"), " 0.1 RR 0")
    # the sign and the degrees are one field of the layout and its minutes and seconds two
    path = _files(_with_preamble(s.select(F.pmod("s_suppkey", F.lit(3)).alias("part"), line.alias("value")), 34), "stars", ["part"], ["place"])
    out = catalogs.star_coordinates(spark, f"{path}/*/*")
    return out.withColumns({c: F.round(c, 6) for c in ("ra", "dec")})


@query("""
SELECT concat('OGLE-GD-DSCT-', lpad(CAST(p_partkey AS VARCHAR), 4, '0')) AS sourceid, p_size::DOUBLE AS "avg_mag_I", NULL::DOUBLE AS "avg_mag_V", 0.125::DOUBLE AS period, 'gd' AS region, 'dsct_SINGLE' AS class_str, '01:02:03.4' AS ra, concat('IV', p_size) AS "OGLE_IV_id"
FROM part WHERE p_partkey < 10000
UNION ALL SELECT concat('OGLE-GD-DSCT-', p_partkey), p_size::DOUBLE, NULL, 0.125::DOUBLE, 'gd', 'dsct_SINGLE', '01:02:03.4', concat('IV', p_size) FROM part WHERE p_partkey >= 10000
""")
def read_fixed_width(spark, sf_dir):
    """A catalogue and its identification table at character positions, moved by their region's shift, joined by star."""
    p = table(spark, sf_dir, "part")
    name = _text("OGLE-GD-DSCT-", F.when(F.length(F.col("p_partkey").cast("string")) < 4, F.lpad(F.col("p_partkey").cast("string"), 4, "0")).otherwise(F.col("p_partkey").cast("string")))

    def line(fields, values) -> Column:
        edges = [a for a, _ in fields] + [max(b for _, b in fields)]
        cells = [F.rpad(v.cast("string"), b - a, " ") for v, a, b in zip(values, edges[:-1], edges[1:])]
        # a name is padded, never cut: a longer one moves the rest of its line
        gap = fields[1][0] - fields[0][1]
        return F.concat(F.rpad(values[0], F.greatest(F.length(values[0]) + gap, F.lit(edges[1])), " "), *cells[1:])

    blank = F.lit("")
    fields = catalogs.shifted(catalogs.DSCT_FIELDS, -2)
    path = scratch.folder(spark, "fixed")
    cells = [name, F.col("p_size"), blank, F.lit("0.125"), *[blank] * (len(fields) - 4)]
    p.select(line(fields, cells).alias("value")).write.text(f"{path}/dsct.dat")
    ident = catalogs.shifted(catalogs.IDENT_FIELDS["dsct"], -2)
    cells = [name, F.lit("SINGLE"), F.lit("01:02:03.4"), F.lit("-05:06:07"), _text("IV", F.col("p_size")), blank, blank, blank]
    p.select(line(ident, cells).alias("value")).write.text(f"{path}/ident.dat")
    both = catalogs.with_ident(catalogs.ogle_catalog(spark, path, "gd", "dsct", "dsct"), catalogs.ogle_ident(spark, f"{path}/ident.dat", "gd", "dsct"), "dsct")
    return both.select("sourceid", "avg_mag_I", "avg_mag_V", "period", "region", "class_str", "ra", "OGLE_IV_id")


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT CAST(user_id AS VARCHAR) AS sourceid, CASE WHEN user_id % 2 = 0 THEN 'I' ELSE 'V' END AS band,
  round(2460000 - 2400000.5::DOUBLE + event_id % 300 + CASE WHEN k = 1 THEN 0.1234 ELSE 0.5 END::DOUBLE, 4) AS mjd, value AS mag, 0.25::DOUBLE AS err FROM e
""")
def read_light_curves(spark, sf_dir):
    """A file for each star and band; the first time's length tells the form of all, later ones are shorter."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    full = F.pmod("user_id", F.lit(3)) == 0
    day = (F.when(full, F.lit(2460000)).otherwise(F.lit(10000)) + F.pmod("event_id", F.lit(300))).cast("string")
    time = F.concat(day, F.when(F.col("k") > 1, F.lit(".5")).when(full, F.lit(".12340")).otherwise(F.lit(".1234")))
    lines = e.select(F.when(F.pmod("user_id", F.lit(2)) == 0, "I").otherwise("V").alias("band"), F.col("user_id").alias("star"), "k", F.concat(time, F.lit("  "), F.col("value").cast("string"), F.lit(" 0.25")).alias("value"))
    path = _files(lines, "curves", ["band", "star"], ["k"])
    out = catalogs.ogle_light_curves(spark, path, layout=r"band=([^/]+)/star=([^/]+)/")
    return out.select("sourceid", "band", F.round("mjd", 4).alias("mjd"), "mag", "err")


@query("""
WITH l AS (SELECT c_custkey AS k, concat('OGLE-BLG-CEP-', c_custkey, ' (', c_mktsegment, ') blends with OGLE-BLG-CEP-', c_custkey + 1) AS line FROM customer WHERE c_custkey % 2 = 0)
SELECT concat('OGLE-BLG-CEP-', k + d) AS sourceid, line AS remarks FROM l CROSS JOIN (SELECT unnest([0, 1]) AS d)
""")
def read_remarks(spark, sf_dir):
    """Free text that names stars: one row for each star named."""
    c = table(spark, sf_dir, "customer")
    own = F.when(F.pmod("c_custkey", F.lit(2)) == 0, _text("OGLE-BLG-CEP-", F.col("c_custkey"), " (", F.col("c_mktsegment"), ") blends with OGLE-BLG-CEP-", F.col("c_custkey") + 1)).otherwise("see OGLE-LMC-CEP-1 elsewhere")
    path = scratch.folder(spark, "remarks")
    c.select(own.alias("value")).write.text(path)
    return catalogs.ogle_remarks(spark, path, "blg", "cep").select("sourceid", "remarks")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS region, 'cep' AS family, n_name AS sub_type FROM nation")
def read_collections(spark, sf_dir):
    """A JSON file of triples."""
    n = table(spark, sf_dir, "nation").select(F.array(F.col("n_regionkey").cast("string"), F.lit("cep"), "n_name").alias("t"))  # 25 rows
    path = scratch.folder(spark, "collections")
    n.agg(F.to_json(F.collect_list("t")).alias("value")).write.text(path)
    return catalogs.collections(spark, f"{path}/part-*")


_RUNS = "r AS (SELECT event_type AS embedding, user_id % 3 AS seed, count(*) % 10000 AS n, max(event_id) % 10000 AS m FROM events GROUP BY ALL)"


def _runs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("embedding"), F.pmod("user_id", F.lit(3)).alias("seed"))
    return e.agg(F.pmod(F.count(F.lit(1)), F.lit(10000)).alias("n"), F.pmod(F.max("event_id"), F.lit(10000)).alias("m"))


def _four(c: str) -> Column:
    return F.concat(F.lit("0."), F.lpad(F.col(c).cast("string"), 4, "0"))


@query(f"""
WITH {_RUNS} SELECT embedding, 'test' AS mode, 'concat' AS scenario, 0 AS standardize, 30.0::DOUBLE AS perplexity, CAST(seed AS INTEGER) AS seed, split, method,
  round(-n / 10000.0::DOUBLE, 4) AS ari, round(m / 10000.0::DOUBLE, 4) AS nmi, round(n / 10000.0::DOUBLE, 4) AS f1
FROM r CROSS JOIN (SELECT 'Test' AS split, 'K-Means' AS method UNION ALL SELECT 'Validation', 'Ward')
""")
def read_clustering_logs(spark, sf_dir):
    """Result lines scraped from the logs of each run, with the fields of the run's name."""
    r = _runs(spark, sf_dir).withColumn("run", _text(F.col("embedding"), "_test_c1_std0_p30.0_seed", F.col("seed")))
    line = lambda head: F.concat(F.lit(head), F.lit(" ARI=-"), _four("n"), F.lit(", NMI="), _four("m"), F.lit(", F1="), _four("n"))
    lines = r.select("run", F.explode(F.array(F.lit("loading data"), line("Test → K-Means"), line("Validation -> Ward"), F.lit("done ARI=1"))).alias("value"))
    logs = results.clustering_logs(spark, f"{_files(lines, 'logs', ['run'], [])}/*/*")
    return logs.select(*[c.alias(n) for n, c in results.run_fields(F.col("run")).items()], "split", "method", "ari", "nmi", "f1")


@query(f"""
WITH {_RUNS} SELECT concat(embedding, '_concat_seed', seed) AS run, row, metric, CASE WHEN metric = 'precision' THEN round(n / 10000.0::DOUBLE, 4) ELSE round(m / 10000.0::DOUBLE, 4) END AS value
FROM r CROSS JOIN (SELECT unnest(['0', 'macro avg']) AS row) CROSS JOIN (SELECT unnest(['precision', 'recall']) AS metric)
""")
def read_reports(spark, sf_dir):
    """Report files whose columns stand in another order in every third run."""
    r = _runs(spark, sf_dir).withColumn("run", _text(F.col("embedding"), "_concat_seed", F.col("seed")))
    other = F.col("seed") == 1
    head = F.when(other, ",recall,precision").otherwise(",precision,recall")
    row = lambda name: F.concat(F.lit(name), F.lit(","), F.when(other, F.concat(_four("m"), F.lit(","), _four("n"))).otherwise(F.concat(_four("n"), F.lit(","), _four("m"))))
    lines = r.select("run", F.posexplode(F.array(head, row("0"), row('"macro avg"'))).alias("k", "value"))
    return results.reports(spark, f"{_files(lines, 'reports', ['run'], ['k'])}/*/*").select("run", "row", "metric", "value")


@query("""
WITH e AS (SELECT user_id % 3 AS run, user_id % 20 AS epoch, event_id % 1000 AS loss, event_id % 2 = 0 AS trained FROM events)
SELECT epoch, round(avg(loss) FILTER (trained AND run <> 1), 6) AS train_loss, round(avg(loss) FILTER (NOT trained), 6) AS val_loss FROM e GROUP BY epoch
""")
def read_training_log(spark, sf_dir):
    """Training logs of runs with other columns each, averaged by epoch; cells may be empty."""
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(3)).alias("run"), F.pmod("user_id", F.lit(20)).alias("epoch"), F.pmod("event_id", F.lit(1000)).alias("loss"), (F.pmod("event_id", F.lit(2)) == 0).alias("trained"))
    train, val = (F.coalesce(F.when(c, F.col("loss").cast("string")), F.lit("")) for c in (F.col("trained"), ~F.col("trained")))
    row = F.when(F.col("run") == 1, F.concat_ws(",", val, F.col("epoch"))).otherwise(F.concat_ws(",", F.col("epoch"), train, val))
    head = e.select("run").distinct().select("run", F.lit(0).alias("k"), F.when(F.col("run") == 1, "val_loss,epoch").otherwise("epoch,train_loss,val_loss").alias("value"))
    path = _files(e.select("run", F.lit(1).alias("k"), row.alias("value")).unionByName(head), "training", ["run"], ["k"])
    out = evaluate.mean_by_epoch(results.training_log(spark, f"{path}/*/*"), ["train_loss", "val_loss"])
    return out.select("epoch", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"))


@query("SELECT event_type AS folder, 1::BIGINT AS n, sum(length(CAST(event_id AS VARCHAR)) + 1)::BIGINT AS size FROM events GROUP BY event_type")
def list_files(spark, sf_dir):
    """Files with their sizes; contents are not read."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_id").cast("string").alias("value"))
    found = results.files(spark, f"{_files(e, 'listing', ['event_type'], [])}/*/*")
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("SELECT CAST(user_id AS VARCHAR) AS sourceid, 'r' AS band, CAST(event_id AS FLOAT)::DOUBLE AS mjd, CAST(value AS FLOAT)::DOUBLE AS mag, CAST(0.1 AS FLOAT)::DOUBLE AS err FROM events")
def read_parquet_shards(spark, sf_dir):
    """Observations of single precision in Parquet shards, a star in many of them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("newID"), F.col("event_id").cast("float").alias("mjd"), F.col("value").cast("float").alias("mag"), F.lit(0.1).cast("float").alias("errmag"))
    path = scratch.folder(spark, "shards")
    e.write.parquet(path)
    return catalogs.macho_shards(spark, path).select("sourceid", "band", "mjd", "mag", "err")
