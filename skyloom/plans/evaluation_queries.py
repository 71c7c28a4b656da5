"""Splits, labels, nearest neighbours and evaluation over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import times
from skyloom.operators import classify, evaluate, knn, splits
from skyloom.plans.inputs import SPLIT, embeddings, rounded, table
from skyloom.plans.registry import query


def _place(by: str) -> str:
    return f"row_number() OVER ({by} ORDER BY md5(concat(vec_id, '|42')), vec_id)"


@query(f"WITH {SPLIT} SELECT id, label, split FROM es")
def split_stratified(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", "label", "split")


@query(f"""
SELECT vec_id, CASE WHEN p <= ceil(n * 0.2) THEN 'test' WHEN p <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.125) THEN 'validation' ELSE 'train' END AS split
FROM (SELECT vec_id, {_place('')} AS p, count(*) OVER () AS n FROM embeddings)
""")
def split_random(spark, sf_dir):
    return splits.random(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id").select("vec_id", "split")


@query(f"WITH {SPLIT} SELECT split, count(*) AS n FROM es WHERE split IN ('train', 'validation') GROUP BY split")
def split_select(spark, sf_dir):
    return splits.select_splits(embeddings(spark, sf_dir), ["train", "validation"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT event_type FROM events)")
def label_vocab(spark, sf_dir):
    return evaluate.vocabulary(table(spark, sf_dir, "events"), "event_type")


@query("""
WITH v AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view'))
SELECT event_id, label_idx FROM events LEFT JOIN v USING (event_type)
""")
def label_index(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    vocab = evaluate.vocabulary(ev.filter("event_type <> 'view'"), "event_type")
    return evaluate.with_label_index(ev, vocab, "event_type").select("event_id", "label_idx")


@query("""
WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, n, round((1.0::DOUBLE / n) / avg(1.0::DOUBLE / n) OVER (), 6) AS inverse_weight, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 6) AS balanced_weight FROM n
""")
def class_weights(spark, sf_dir):
    return rounded(evaluate.class_weights(table(spark, sf_dir, "events"), "event_type"), ["event_type", "n"])


@query("""
WITH v AS (SELECT DISTINCT event_type FROM events), d AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, event_type, (SELECT count(*) FROM events e WHERE e.user_id = d.user_id AND e.event_type = v.event_type AND e.value > 400) AS n FROM d CROSS JOIN v
""")
def dense_counts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    dense = ev.select("user_id").distinct().crossJoin(F.broadcast(ev.select("event_type").distinct()))  # users x 5 types
    counts = ev.filter("value > 400").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return dense.join(counts, ["user_id", "event_type"], "left").na.fill(0, ["n"])


def _test_and_train(spark, sf_dir):
    """(test_id, v) and (train_id, label, v), scaled by the training rows."""
    es = embeddings(spark, sf_dir)
    train, test = classify.standardised(es.filter("split = 'train'"), es.filter("split = 'test'"))
    return test.select(F.col("id").alias("test_id"), "v"), train.select(F.col("id").alias("train_id"), "label", "v")


def predictions(spark, sf_dir):
    """(id, y_true, y_pred) of the test split by its five nearest training rows."""
    got = knn.vote(knn.neighbours(*_test_and_train(spark, sf_dir)))
    return embeddings(spark, sf_dir).select("id", F.col("label").alias("y_true")).join(got.withColumnRenamed("test_id", "id"), "id")


PRED = f"""{SPLIT}, l AS (SELECT id, split, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM es), f AS (
  SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM l WHERE split = 'train' GROUP BY i
), z AS (
  SELECT id, list((x - m) / s ORDER BY i) AS v FROM l JOIN f USING (i) GROUP BY id
), zs AS (
  SELECT es.id, es.label, es.split, z.v FROM es JOIN z USING (id)
), d AS (
  SELECT t.id AS test_id, t.label AS y_true, r.id AS train_id, r.label, round(list_sum(list_transform(list_zip(t.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d2
  FROM zs t JOIN zs r ON t.split = 'test' AND r.split = 'train'
), near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY d2, train_id) AS place FROM d) WHERE place <= 5
), votes AS (
  SELECT test_id, y_true, label, count(*) AS n FROM near GROUP BY ALL
), pred AS (
  SELECT test_id AS id, y_true, label AS y_pred FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1
)"""


@query(f"WITH {PRED} SELECT id, y_true, y_pred FROM pred")
def knn_predict(spark, sf_dir):
    return predictions(spark, sf_dir)


NEAR = f"WITH {PRED} SELECT test_id, train_id, label, round(d2, 6) AS d2, place FROM near"


@query(NEAR)
def knn_indexed(spark, sf_dir):
    """The same through the metric index, with blocks of 512 rows so that it is used at every size."""
    near = knn.neighbours(*_test_and_train(spark, sf_dir), block_numbers=1 << 14)
    return near.select("test_id", "train_id", "label", F.round("d2", 6).alias("d2"), F.col("place").cast("bigint").alias("place"))


@query(NEAR)
def knn_neighbours(spark, sf_dir):
    near = knn.neighbours(*_test_and_train(spark, sf_dir))
    return near.select("test_id", "train_id", "label", F.round("d2", 6).alias("d2"), F.col("place").cast("bigint").alias("place"))


REPORT = """t AS (SELECT y_true AS y, count(*) AS support, count(*) FILTER (y_true = y_pred) AS tp FROM pred GROUP BY y_true), s AS (
  SELECT y_pred AS y, count(*) AS said FROM pred GROUP BY y_pred
), c AS (
  SELECT CAST(y AS VARCHAR) AS row, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(said, 0) AS said FROM t FULL JOIN s USING (y)
), m AS (
  SELECT row, coalesce(tp::DOUBLE / nullif(said, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(said + support, 0), 0) AS f1, support, tp FROM c
), r AS (
  SELECT row, precision, recall, f1, support FROM m
  UNION ALL SELECT 'accuracy', sum(tp)::DOUBLE / sum(support), sum(tp)::DOUBLE / sum(support), sum(tp)::DOUBLE / sum(support), sum(support) FROM m
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m
)
SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r"""


@query(f"WITH {PRED}, {REPORT}")
def knn_report(spark, sf_dir):
    return rounded(evaluate.report(predictions(spark, sf_dir)), ["row", "support"])


@query(f"""
WITH {PRED}, y AS (SELECT y_true AS y FROM pred UNION SELECT y_pred FROM pred), c AS (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL), g AS (
  SELECT a.y AS y_true, b.y AS y_pred, coalesce(n, 0) AS n FROM y a CROSS JOIN y b LEFT JOIN c ON c.y_true = a.y AND c.y_pred = b.y
)
SELECT y_true, y_pred, n, round(n / nullif(sum(n) OVER (PARTITION BY y_true), 0)::DOUBLE, 6) AS share FROM g
""")
def knn_confusion(spark, sf_dir):
    return rounded(evaluate.confusion(predictions(spark, sf_dir)), ["y_true", "y_pred", "n"])


_LABELS = "pred AS (SELECT doc_id AS id, quality AS y_true, toxic AS y_pred FROM labels)"


@query(f"WITH {_LABELS}, {REPORT}")
def label_report(spark, sf_dir):
    pred = table(spark, sf_dir, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
    return rounded(evaluate.report(pred), ["row", "support"])


@query("""
WITH c AS (SELECT quality, toxic, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), m AS (
  SELECT *, sum(n) OVER (PARTITION BY quality) AS a, sum(n) OVER (PARTITION BY toxic) AS b, sum(n) OVER () AS t FROM c
), s AS (
  SELECT max(t) AS t, sum(n * (n - 1) / 2) AS ij, sum(a * (a - 1) / 2 * n / a) AS i, sum(b * (b - 1) / 2 * n / b) AS j,
    sum(n / t * ln(n * t / (a * b))) AS mi, -sum(n / t * ln(a / t)) AS ha, -sum(n / t * ln(b / t)) AS hb FROM m
)
SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi FROM s
""")
def cluster_ari_nmi(spark, sf_dir):
    pred = table(spark, sf_dir, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
    return rounded(evaluate.cluster_scores(pred), [])


def _runs(spark, sf_dir):
    """A value of each (embedding, seed): events' mean by type and user modulo 3."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("embedding"), F.pmod("user_id", F.lit(3)).alias("seed"), "value")
    return ev.groupBy("embedding", "seed").agg(F.avg("value").alias("value"))


_RUNS = "r AS (SELECT event_type AS embedding, user_id % 3 AS seed, avg(value) AS value FROM events GROUP BY ALL)"


@query(f"WITH {_RUNS} SELECT embedding, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds FROM r GROUP BY embedding")
def seed_summary_samp(spark, sf_dir):
    return rounded(evaluate.summary(_runs(spark, sf_dir), ["embedding"]), ["embedding"])


@query(f"WITH {_RUNS} SELECT embedding, round(avg(value), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS std, count(*) AS n, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds FROM r GROUP BY embedding")
def seed_summary_pop(spark, sf_dir):
    return rounded(evaluate.summary(_runs(spark, sf_dir), ["embedding"], ddof=0), ["embedding"])


@query(f"WITH {_RUNS} SELECT embedding, printf('%.4f ± %.4f', avg(value), coalesce(stddev_samp(value), 0)) AS text FROM r GROUP BY embedding")
def seed_summary_text(spark, sf_dir):
    return evaluate.summary(_runs(spark, sf_dir), ["embedding"]).select("embedding", times.mean_std_text(F.col("mean"), F.col("std")).alias("text"))


@query(f"WITH {_RUNS} SELECT embedding, seed, row_number() OVER (PARTITION BY seed ORDER BY value DESC, embedding) AS rank FROM r")
def f1_rank(spark, sf_dir):
    ranked = evaluate.rank_within(_runs(spark, sf_dir), "seed", "value", "embedding")
    return ranked.select("embedding", "seed", F.col("rank").cast("bigint").alias("rank"))


_CELLS = "c AS (SELECT user_id % 3 AS seed, event_id % 4 AS y_true, (event_id + user_id) % 4 AS y_pred, count(*) AS n FROM events GROUP BY ALL)"


def _cells(spark, sf_dir):
    pred = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(3)).alias("seed"), F.pmod("event_id", F.lit(4)).alias("y_true"), F.pmod(F.col("event_id") + F.col("user_id"), F.lit(4)).alias("y_pred"))
    return evaluate.contingency(pred, ["seed"])


@query(f"WITH {_CELLS} SELECT y_true, y_pred, round(avg(n), 6) AS mean_n, round(stddev_pop(n), 6) AS std_n FROM c GROUP BY ALL")
def confusion_mean_std(spark, sf_dir):
    return rounded(evaluate.confusion_summary(_cells(spark, sf_dir)), ["y_true", "y_pred"])


@query(f"WITH {_CELLS} SELECT seed, round(sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS accuracy FROM c GROUP BY seed")
def confusion_accuracy(spark, sf_dir):
    return rounded(evaluate.accuracy_of_cells(_cells(spark, sf_dir), ["seed"]), ["seed"])


@query("SELECT user_id % 20 AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY user_id % 20")
def epoch_means(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(20)).alias("epoch"), F.col("value").alias("loss"))
    return rounded(evaluate.mean_by_epoch(log, ["loss"]), ["epoch"])


@query("""
SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS best FROM (SELECT vec_id, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c FROM embeddings)
""")
def argmax_label(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", evaluate.best_label({"a": e[0], "b": e[1], "c": e[2]}).alias("best"))


@query("""
WITH g AS (SELECT CAST(user_id % 3 * 100 + 100 AS INTEGER) AS trees, CAST(event_id % 4 * 5 + 5 AS INTEGER) AS depth, CAST(event_id % 3 * 4 + 2 AS INTEGER) AS split, round(avg(value) / 500, 2) AS f1 FROM events GROUP BY ALL)
SELECT trees, depth, split, f1 FROM g ORDER BY f1 DESC, trees, depth, split DESC LIMIT 1
""")
def best_of_grid(spark, sf_dir):
    """The best row of a search, ties broken towards the smaller forest."""
    part = lambda c, n: F.pmod(c, F.lit(n)).cast("int")
    keys = [(part("user_id", 3) * 100 + 100).alias("trees"), (part("event_id", 4) * 5 + 5).alias("depth"), (part("event_id", 3) * 4 + 2).alias("split")]
    return classify.best_parameters(table(spark, sf_dir, "events").groupBy(*keys).agg(F.round(F.avg("value") / 500, 2).alias("f1")))


@query("SELECT event_id, user_id, value FROM events ORDER BY user_id, value DESC, event_id LIMIT 50")
def report_top_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value").orderBy("user_id", F.desc("value"), "event_id").limit(50)
