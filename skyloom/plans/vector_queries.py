"""Vector layer over embeddings: two bands are the halves of a vector, a tensor is its rows of eight."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import vectors
from skyloom.operators import embed, knn
from skyloom.plans.inputs import SPLIT, embeddings, table
from skyloom.plans.registry import query


def _bands(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice(v, 1, 32).alias("g"), F.slice(v, 33, 32).alias("r"))


def _long(df, v):
    return df.select("vec_id", F.posexplode(v).alias("dim", "x")).select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


E64 = "e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"WITH {E64} SELECT vec_id, i % 8 AS dim, round(avg(x), 6) AS x FROM e GROUP BY vec_id, i % 8")
def emb_time_avg(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return _long(df, vectors.time_average(vectors.reshape(F.col("embedding").cast("array<double>"), 8)))


@query(f"WITH {E64} SELECT vec_id, i AS dim, round(x, 6) AS x FROM e")
def emb_band_concat(spark, sf_dir):
    b = _bands(spark, sf_dir)
    return _long(b, vectors.combine_bands({"r": F.col("r"), "g": F.col("g")}, "concat"))


@query(f"WITH {E64} SELECT vec_id, i % 32 AS dim, round(avg(x), 6) AS x FROM e GROUP BY vec_id, i % 32")
def emb_band_avg(spark, sf_dir):
    b = _bands(spark, sf_dir)
    return _long(b, vectors.combine_bands({"r": F.col("r"), "g": F.col("g")}, "avg"))


@query(f"WITH {E64} SELECT vec_id, i % 32 AS dim, round(x, 6) AS x FROM e WHERE (vec_id % 3 = 0) = (i < 32)")
def emb_band_single(spark, sf_dir):
    b = _bands(spark, sf_dir).withColumn("r", F.when(F.pmod("vec_id", F.lit(3)) != 0, F.col("r")))
    return _long(b, vectors.combine_bands({"r": F.col("r"), "g": F.col("g")}, "r"))


@query(f"""
WITH {SPLIT}, l AS (SELECT id, split, unnest(range(0, 64)) AS i, unnest(v) AS x FROM es), f AS (
  SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM l WHERE split = 'train' GROUP BY i
)
SELECT id, i AS dim, round((x - m) / s, 6) AS x FROM l JOIN f USING (i) WHERE split = 'test'
""")
def emb_standardize(spark, sf_dir):
    es = embeddings(spark, sf_dir)
    z = knn.apply_scaler(es.filter("split = 'test'"), knn.fit_scaler(es.filter("split = 'train'")))
    return z.select("id", F.posexplode("v").alias("dim", "x")).select("id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0")
def emb_finite(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    broken = F.when(F.pmod("vec_id", F.lit(14)) == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    spoilt = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.concat(v, F.array(broken))).otherwise(v)
    return table(spark, sf_dir, "embeddings").filter(vectors.all_finite(spoilt)).select("vec_id")


@query("""
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: p[1] * p[2])), 6) AS dot,
  round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d2
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def emb_dot_and_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("next")), 6).alias("dot"), F.round(vectors.squared_distance(F.col("embedding"), F.col("next")), 6).alias("d2"))


@query("SELECT CAST(vec_id % 7 + 1 AS INTEGER) AS t, CAST(vec_id % 3 + 1 AS INTEGER) AS d, count(*) AS n FROM embeddings GROUP BY ALL")
def emb_shapes(spark, sf_dir):
    """Nested arrays whose sizes differ by row."""
    inner = F.slice(F.col("embedding"), F.lit(1), (F.pmod("vec_id", F.lit(3)) + 1).cast("int"))
    steps = F.transform(F.sequence(F.lit(0), F.pmod("vec_id", F.lit(7)).cast("int")), lambda i: inner)
    return embed.shapes(table(spark, sf_dir, "embeddings").select(steps.alias("steps")), "steps")


@query("""
WITH e AS (SELECT vec_id, unnest(range(1, 17)) AS i FROM embeddings)
SELECT vec_id, i - 1 AS dim, round(CAST(CAST(concat('0x', substr(md5(concat(vec_id, '|', i, '|42')), 1, 8)) AS BIGINT) / 2147483648.0::DOUBLE - 1 AS FLOAT)::DOUBLE, 6) AS x FROM e
""")
def emb_random_control(spark, sf_dir):
    return _long(embed.random_embedding(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 16), F.col("embedding").cast("array<double>"))


#: A stand-in model: a projection of each step of 8 numbers to 4.
_PROJECTION = [[((i * 5 + j * 3) % 17 - 8) / 8 for j in range(4)] for i in range(8)]


@query(f"""
WITH {E64}, w AS (SELECT i, j, CAST((i * 5 + j * 3) % 17 - 8 AS DOUBLE) / 8 AS w FROM (SELECT unnest(range(0, 8)) AS i) CROSS JOIN (SELECT unnest(range(0, 4)) AS j))
SELECT vec_id, e.i // 8 AS step, j AS dim, round(CAST(sum(x * w) AS FLOAT)::DOUBLE, 6) AS x FROM e JOIN w ON w.i = e.i % 8 GROUP BY ALL
""")
def emb_model_map(spark, sf_dir):
    """A fixed projection of each step through the Arrow map that a pretrained model would use."""

    def loader():
        import numpy as np

        w = np.array(_PROJECTION)
        return lambda x: x.astype(np.float64) @ w

    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.reshape(F.col("embedding"), 8).alias("window"))
    out = embed.embed(e, "vec_id", "window", loader, 4).select("vec_id", F.posexplode("embedding").alias("step", "v"))
    long = out.select("vec_id", F.col("step").cast("bigint").alias("step"), F.posexplode("v").alias("dim", "x"))
    return long.select("vec_id", "step", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query(f"""
WITH {E64}, w AS (SELECT i, j, CAST((i * 5 + j * 3) % 17 - 8 AS DOUBLE) / 8 AS w FROM (SELECT unnest(range(0, 8)) AS i) CROSS JOIN (SELECT unnest(range(0, 4)) AS j)), m AS (
  SELECT vec_id, e.i // 8 AS step, j, CAST(sum(x * w) AS FLOAT)::DOUBLE AS x FROM e JOIN w ON w.i = e.i % 8 GROUP BY ALL
), b AS (
  SELECT vec_id, step // 4 AS band, j, avg(x) AS x FROM m GROUP BY ALL
)
SELECT vec_id, CAST(band * 4 + j AS BIGINT) AS dim, round(x, 6) AS x FROM b WHERE NOT (band = 1 AND vec_id % 5 = 0) AND NOT (band = 0 AND vec_id % 5 = 0)
""")
def emb_attach(spark, sf_dir):
    """Two bands through the model, put back by key; a row without one of its bands has no embedding of both."""

    def loader():
        import numpy as np

        w = np.array(_PROJECTION)
        return lambda x: x.astype(np.float64) @ w

    bands = _bands(spark, sf_dir)
    missing = F.pmod("vec_id", F.lit(5)) == 0
    window = {"g": vectors.reshape(F.col("g"), 8), "r": F.when(~missing, vectors.reshape(F.col("r"), 8))}
    out = bands.select("vec_id")
    for band, w in window.items():
        one = embed.embed(bands.select("vec_id", w.alias("window")), "vec_id", "window", loader, 4)
        out = out.join(one.select("vec_id", F.col("embedding").alias(band)), "vec_id", "left")
    average = {b: F.when(F.col(b).isNotNull(), vectors.time_average(F.col(b).cast("array<array<double>>"))) for b in window}
    return _long(out, F.when(average["r"].isNotNull(), vectors.combine_bands(average, "concat")))
