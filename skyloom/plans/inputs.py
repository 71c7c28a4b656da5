"""The driver's tables as observations, vectors and predictions, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import times
from skyloom.operators import splits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as long light curves; the error column is a stand-in that depends on the event id."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sourceid"),
        F.col("event_type").alias("band"),
        F.col("event_id").alias("obs_id"),
        times.mjd_of_timestamp("ts").alias("mjd"),
        F.col("value").alias("mag"),
        (F.lit(0.05) + F.lit(0.01) * F.pmod("event_id", F.lit(7)).cast("double")).alias("err"),
    )


#: The same in DuckDB: a common table expression to start a WITH.
LC = """lc AS (
  SELECT user_id AS sourceid, event_type AS band, event_id AS obs_id, epoch_us(ts) / 86400000000.0::DOUBLE + 40587 AS mjd,
    value AS mag, 0.05::DOUBLE + 0.01::DOUBLE * (event_id % 7) AS err FROM events
)"""

PREPARED = f"""{LC}, p AS (
  SELECT *, count(*) OVER w AS n, avg(mag) OVER w AS mean, stddev_samp(mag) OVER w AS s, median(mag) OVER w AS med, min(mag) OVER w AS lo, max(mag) OVER w AS hi,
    mag - lag(mag) OVER t AS dm, mjd - lag(mjd) OVER t AS dt, row_number() OVER t AS k
  FROM lc WINDOW w AS (PARTITION BY sourceid, band), t AS (PARTITION BY sourceid, band ORDER BY mjd, obs_id)
)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, v) with an exact stratified split; classes count from 0."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return splits.stratified(rows, "id", "label")


SPLIT = """es AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, CASE WHEN place <= ceil(n * 0.2) THEN 'test'
    WHEN place <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.125) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(vec_id, '|42')), vec_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
)"""


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Floating columns outside the keys rounded, so that engines agree on the last digits."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if c not in keys and kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
