"""Catalogue joins, parsing and text over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import times
from skyloom.operators import joins, lightcurve
from skyloom.plans.inputs import LC, observations, table
from skyloom.plans.registry import query
from skyloom.sources import catalogs, results, scratch, sky


@query("""
SELECT c_custkey, c_name, coalesce(max(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey = m), '') AS first_order
FROM customer LEFT JOIN (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey GROUP BY c_custkey, c_name
""")
def catalog_left_join_fill(spark, sf_dir):
    stars = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    ident = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"))
    return joins.left_fill(stars, ident, "c_custkey", ["first_order"])


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = c_custkey")
def catalog_without_curves(spark, sf_dir):
    stars = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sourceid"))
    return joins.without_series(stars, observations(spark, sf_dir)).select(F.col("sourceid").alias("c_custkey"))


@query(f"WITH {LC} SELECT c_custkey, c_name, band, count(*) AS length FROM customer JOIN lc ON sourceid = c_custkey GROUP BY c_custkey, c_name, band")
def catalog_with_curves(spark, sf_dir):
    stars = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sourceid"), "c_name")
    both = joins.with_series(stars, lightcurve.nest(observations(spark, sf_dir)))
    return both.select(F.col("sourceid").alias("c_custkey"), "c_name", "band", F.col("series.length").alias("length"))


_IDS = r"[A-Za-z0-9._-]+@mail[0-9]\.example\.com"


@query(rf"""
WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_IDS}'))) AS sourceid FROM documents)
SELECT sourceid, string_agg('doc ' || doc_id, ' | ' ORDER BY doc_id) AS remarks FROM m GROUP BY sourceid
""")
def remarks_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("line_no"), F.col("text").alias("value"))
    ids = F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(_IDS), F.lit(0))))
    told = lines.select("line_no", F.concat(F.lit("doc "), F.col("line_no").cast("string")).alias("remark"), ids.alias("value"))
    return joins.remarks_by_id(told.select("line_no", F.concat_ws(" ", "value", "remark").alias("value")), _IDS).select(
        "sourceid", F.expr(r"regexp_replace(remarks, '[A-Za-z0-9._-]+@mail[0-9]\\.example\\.com ', '')").alias("remarks")
    )


@query("""
SELECT c_custkey, 'nation=' || c_nationkey || ' | segment=' || coalesce(c_mktsegment, 'nan') AS remarks FROM customer
""")
def remarks_compact(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return catalogs.with_remarks_of(c, ["nation", "segment"])


@query("""
SELECT event_id, 'emb_' || event_type AS embedding, CASE WHEN event_id % 2 = 0 THEN 'all' ELSE 'test' END AS mode, CASE WHEN event_id % 3 = 0 THEN 'concat' ELSE 'avg' END AS scenario,
  CAST(event_id % 2 AS INTEGER) AS standardize, CAST(user_id AS INTEGER) AS seed FROM events
""")
def run_name_parse(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    two = F.when(F.pmod("event_id", F.lit(2)) == 0, "all").otherwise("test")
    old = F.when(F.pmod("event_id", F.lit(3)) == 0, "c1").otherwise("c0")
    new = F.when(F.pmod("event_id", F.lit(3)) == 0, "concat").otherwise("avg")
    scenario = F.when(F.pmod("event_id", F.lit(5)) == 0, old).otherwise(new)
    run = F.concat(F.lit("emb_"), "event_type", F.lit("_"), two, F.lit("_"), scenario, F.lit("_std"), F.pmod("event_id", F.lit(2)).cast("string"), F.lit("_p30.0_seed"), F.col("user_id").cast("string"))
    f = results.run_fields(F.col("run"))
    return ev.withColumn("run", run).select("event_id", *[f[c].alias(c) for c in ("embedding", "mode", "scenario", "standardize", "seed")])


@query("SELECT event_id, 'emb_' || event_type AS embedding FROM events")
def run_suffix_strip(spark, sf_dir):
    run = F.concat(F.lit("emb_"), "event_type", F.lit("_concat_seed"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", results.embedding_name(run).alias("embedding"))


_STARS = "s AS (SELECT s_suppkey AS star_id, (s_suppkey * 137.508::DOUBLE) % 360 AS ra, ((s_suppkey * 17) % 1780) / 10.0::DOUBLE - 89 AS dec FROM supplier)"
_OBJECTS = """o AS (SELECT c_custkey AS object_id, ((c_custkey % n + 1) * 137.508::DOUBLE) % 360 + ((c_custkey % 7) - 3) / 3600.0::DOUBLE AS ora,
  (((c_custkey % n + 1) * 17) % 1780) / 10.0::DOUBLE - 89 + ((c_custkey % 5) - 2) / 3600.0::DOUBLE AS odec FROM customer, (SELECT count(*) AS n FROM supplier))"""


_CONES = f"""
WITH {_STARS}, {_OBJECTS}, p AS (
  SELECT *, pow(sin(radians(odec - dec) / 2), 2) + cos(radians(dec)) * cos(radians(odec)) * pow(sin(radians(ora - ra) / 2), 2) AS h FROM s JOIN o ON abs(odec - dec) < 0.001
)
SELECT star_id, object_id, round(degrees(2 * asin(least(1.0, sqrt(h)))) * 3600, 3) AS sep FROM p WHERE degrees(2 * asin(least(1.0, sqrt(h)))) * 3600 <= 2
"""


def _sky(spark, sf_dir):
    """Stars and objects some seconds of arc from them."""
    n = table(spark, sf_dir, "supplier").count()
    ra = lambda k: F.pmod(k * F.lit(137.508), F.lit(360.0))
    dec = lambda k: F.pmod(k * 17, F.lit(1780)) / 10.0 - 89
    stars = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("star_id"), ra(F.col("s_suppkey")).alias("ra"), dec(F.col("s_suppkey")).alias("dec"))
    k = F.pmod("c_custkey", F.lit(n)) + 1
    objects = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("object_id"), (ra(k) + (F.pmod("c_custkey", F.lit(7)) - 3) / 3600.0).alias("ora"), (dec(k) + (F.pmod("c_custkey", F.lit(5)) - 2) / 3600.0).alias("odec")
    )
    return stars, objects


@query(_CONES)
def cone_match(spark, sf_dir):
    stars, objects = _sky(spark, sf_dir)
    found = joins.cone_match(stars, objects)
    return found.select("star_id", "object_id", F.round("sep", 3).alias("sep"))


@query(_CONES)
def cone_match_tree(spark, sf_dir):
    """The same against a catalogue in a tree of pixels, of which only the touched folders are read."""
    stars, objects = _sky(spark, sf_dir)
    path = scratch.folder(spark, "catalogue")
    sky.write_catalog(objects, path, limit=4096)
    found = sky.cone_search(stars, path)
    return found.select("star_id", "object_id", F.round("sep", 3).alias("sep"))


@query("SELECT event_id, round(event_id % 5000000 / 1000.0::DOUBLE + 49999.5::DOUBLE + 5000, 5) AS mjd FROM events")
def hjd_normalise(spark, sf_dir):
    day = F.pmod("event_id", F.lit(5000000)) / 1000.0 + 5000  # four digits before the point, as in the files
    full = F.pmod("event_id", F.lit(2)) == 0
    text = F.when(full, F.format_string("%.5f", day + 2450000)).otherwise(F.format_string("%.5f", day))
    ev = table(spark, sf_dir, "events").withColumn("t", text)
    return ev.select("event_id", F.round(times.mjd_of_hjd_text(F.col("t"), F.col("t")), 5).alias("mjd"))


@query("""
WITH p AS (SELECT event_id, event_id % 24 AS h, event_id % 60 AS m, (event_id * 7) % 60 AS s, event_id % 3 = 0 AS neg FROM events)
SELECT event_id, round(15 * (h + m / 60.0::DOUBLE + s / 3600.0::DOUBLE), 6) AS ra, round((CASE WHEN neg THEN -1 ELSE 1 END) * (h + m / 60.0::DOUBLE + s / 3600.0::DOUBLE), 6) AS dec FROM p
""")
def sexagesimal_degrees(spark, sf_dir):
    e = F.col("event_id")
    body = F.format_string("%02d:%02d:%02d", F.pmod(e, F.lit(24)), F.pmod(e, F.lit(60)), F.pmod(e * 7, F.lit(60)))
    signed = F.concat(F.when(F.pmod(e, F.lit(3)) == 0, "-").otherwise("+"), body)
    return table(spark, sf_dir, "events").select("event_id", F.round(times.degrees_of_sexagesimal(body, hours=True), 6).alias("ra"), (F.rint(times.degrees_of_sexagesimal(signed) * 1e6) / 1e6).alias("dec"))


@query("""
SELECT event_id, printf('%02d:%02d:0%d.25', event_id % 24, event_id % 60, event_id % 10) AS ra, printf('-%02d:%02d:0%d.5', event_id % 90, event_id % 60, event_id % 10) AS dec FROM events
""")
def coordinate_format(spark, sf_dir):
    e = F.col("event_id")
    ra = F.format_string("%d %d %d.25", F.pmod(e, F.lit(24)), F.pmod(e, F.lit(60)), F.pmod(e, F.lit(10)))
    dec = F.format_string("-%d %d %d.5", F.pmod(e, F.lit(90)), F.pmod(e, F.lit(60)), F.pmod(e, F.lit(10)))
    return table(spark, sf_dir, "events").select("event_id", times.colon_coordinate(ra).alias("ra"), times.colon_coordinate(dec, declination=True).alias("dec"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_parameters(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", results.parameters(F.col("props"), "k bigint")["k"].alias("k"))


@query("""
SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
""")
def superset_union(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return catalogs.unified([s, c])


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'EW' WHEN 1 THEN 'EA' WHEN 2 THEN 'Beta_Lyrae' WHEN 3 THEN 'RRab' ELSE NULL END AS class_str FROM part")
def class_names(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for k, v in catalogs.CATALINA_CLASSES.items() if k <= 4 for x in (k - 1, v)])
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(names, F.pmod("p_size", F.lit(5)).cast("int")).alias("class_str"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag")
def class_subset(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT user_id) AS sources, count(*) AS observations, count(DISTINCT event_type) AS bands FROM events")
def dataset_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("sources"), F.count(F.lit(1)).alias("observations"), F.countDistinct("event_type").alias("bands"))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name IS NOT NULL GROUP BY ALL")
def catalog_chain(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    named = c.join(n, c.c_nationkey == n.n_nationkey).filter("n_name is not null").select("c_custkey")
    return o.join(named, o.o_custkey == named.c_custkey).groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE NOT (user_id % 10 = 3 AND event_type = 'error')")
def outliers_dropped(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    listed = ev.filter("user_id % 10 = 3").select("user_id").distinct().withColumn("event_type", F.lit("error"))
    return joins.without_listed(ev, listed, ["user_id", "event_type"]).select("event_id")


@query(f"""
WITH {LC}
SELECT sourceid || '_' || band AS item_id, '1D' AS freq, CAST(count(*) AS INTEGER) AS length, round(arg_min(mag, mjd), 2) AS first FROM lc GROUP BY sourceid, band
""")
def target_layout(spark, sf_dir):
    rows = lightcurve.target_layout(lightcurve.nest(observations(spark, sf_dir)))
    return rows.select("item_id", "freq", "length", F.round(F.element_at("target", 1).cast("double"), 2).alias("first"))
