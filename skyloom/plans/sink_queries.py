"""Writers and the ingestion stream: tables are written by the operator and read back; the SQL works on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import times
from skyloom.operators import evaluate
from skyloom.plans.inputs import SPLIT, embeddings, table
from skyloom.plans.registry import query
from skyloom.sources import scratch, sinks, snapshots
from skyloom.streaming import ingest


@query(f"WITH {SPLIT} SELECT id, CAST(label AS BIGINT) AS label, split, round(v[1], 6) AS first FROM es")
def sink_dataset(spark, sf_dir):
    """A dataset by split, in files of bounded rows."""
    path = scratch.folder(spark, "dataset")
    sinks.dataset(embeddings(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", F.col("label").cast("bigint").alias("label"), "split", F.round(F.col("v")[0], 6).alias("first"))


@query("SELECT event_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN value + 1 ELSE value END AS value FROM events WHERE event_type NOT IN ('click', 'view') OR event_id % 2 = 0")
def sink_resumable(spark, sf_dir):
    """Parts that are written again replace the old ones; the others stay."""
    path = scratch.folder(spark, "resumable")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    sinks.resumable(e, path, "event_type")
    again = e.filter("event_type in ('click', 'view') and event_id % 2 = 0").withColumn("value", F.col("value") + 1)
    sinks.resumable(again, path, "event_type")
    return spark.read.parquet(path).select("event_id", "event_type", "value")


@query("SELECT event_id, value * 2 AS value FROM events")
def sink_replaced(spark, sf_dir):
    """A dataset that is rewritten from itself moves to a new place."""
    path = scratch.folder(spark, "replaced")
    table(spark, sf_dir, "events").select("event_id", "value").write.parquet(path)
    place = sinks.replaced(spark.read.parquet(path).withColumn("value", F.col("value") * 2), path)
    return spark.read.parquet(place)


@query("SELECT event_id, value * 2 AS value FROM events")
def sink_snapshots(spark, sf_dir):
    """A dataset that is replaced from itself in place, spoilt, taken back and cleaned."""
    path = scratch.folder(spark, "snapshots")
    snapshots.replaced(table(spark, sf_dir, "events").select("event_id", "value"), path)
    good = snapshots.replaced(snapshots.read(spark, path).withColumn("value", F.col("value") * 2), path)
    snapshots.replaced(snapshots.read(spark, path).filter("event_id % 2 = 0"), path)
    snapshots.back_to(spark, path, good)
    snapshots.cleaned(spark, path)
    return snapshots.read(spark, path)


def _summary(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("embedding"), F.pmod("user_id", F.lit(3)).alias("seed")).agg(F.avg("value").alias("value"))
    return evaluate.summary(runs, ["embedding"])


_SUMMARY = "r AS (SELECT event_type AS embedding, user_id % 3 AS seed, avg(value) AS value FROM events GROUP BY ALL), s AS (SELECT embedding, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n FROM r GROUP BY embedding)"


@query(f"WITH {_SUMMARY} SELECT embedding, round(mean, 6) AS mean, round(std, 6) AS std, CAST(n AS BIGINT) AS n FROM s")
def sink_report_csv(spark, sf_dir):
    path = scratch.folder(spark, "report")
    sinks.report_csv(_summary(spark, sf_dir).select("embedding", "mean", "std", "n"), path, ["embedding"])
    read = spark.read.schema("embedding string, mean double, std double, n bigint").csv(path, header=True)
    return read.select("embedding", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"WITH {_SUMMARY} SELECT embedding, round(mean, 6) AS mean, CAST(n AS BIGINT) AS n FROM s")
def sink_results_json(spark, sf_dir):
    path = scratch.folder(spark, "results")
    sinks.results_json(_summary(spark, sf_dir), path)
    return spark.read.schema("embedding string, mean double, n bigint").json(path).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_SUMMARY} SELECT concat(embedding, ': ', printf('%.4f ± %.4f', mean, std)) AS value FROM s")
def sink_summary_text(spark, sf_dir):
    path = scratch.folder(spark, "summary")
    rows = _summary(spark, sf_dir).withColumn("text", times.mean_std_text(F.col("mean"), F.col("std")))
    sinks.summary_text(rows, path, "%s: %s", ["embedding", "text"], ["embedding"])
    return spark.read.text(path)


@query("SELECT event_id, event_type, value FROM events")
def stream_ingest(spark, sf_dir):
    """Two runs of the ingestion stream: the second one takes up only the files that came after the first."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    arriving, target, marks = (scratch.folder(spark, f"ingest-{x}") for x in ("in", "out", "marks"))
    for part in (0, 1):
        e.filter(F.pmod("event_id", F.lit(2)) == part).write.mode("append").parquet(arriving)
        ingest.ingest(ingest.observation_stream(spark, arriving, "event_id long, event_type string, value double"), target, marks, "event_type").awaitTermination()
    return spark.read.parquet(target).select("event_id", "event_type", "value")
