"""Evaluation as SQL over one prediction table (run columns, y_true, y_pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(df: DataFrame, label: str) -> DataFrame:
    """(label, label_idx): distinct labels in order, counted from 0.  One row a class."""
    return df.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("label_idx", F.row_number().over(Window.orderBy(label)) - 1)


def with_label_index(df: DataFrame, vocab: DataFrame, label: str) -> DataFrame:
    """``label_idx`` of each row; null for labels outside the vocabulary, such as anomalies."""
    return df.join(vocab, label, "left")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: count, inverse frequency scaled to mean 1, and n / (classes x count)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return n.select(label, "n", ((1 / F.col("n")) / F.avg(1 / F.col("n")).over(every)).alias("inverse_weight"), (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("balanced_weight"))


def contingency(pred: DataFrame, by=()) -> DataFrame:
    return pred.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion(pred: DataFrame, by=()) -> DataFrame:
    """Dense counts over all labels seen, and the share of each true class; null for a class that never is true."""
    cells = contingency(pred, by)
    # classes x classes of each run, from the set of its labels
    labels = cells.select(*by, F.explode(F.array("y_true", "y_pred")).alias("y")).groupBy(*by).agg(F.collect_set("y").alias("ys"))
    dense = labels.select(*by, "ys", F.explode("ys").alias("y_true")).select(*by, "y_true", F.explode("ys").alias("y_pred"))
    full = dense.join(cells, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.expr("try_divide(n, 1.0D * sum(n) over (partition by %s))" % ", ".join([*by, "y_true"])))


def report(pred: DataFrame, by=()) -> DataFrame:
    """Per class precision, recall, F1 and support (0 where undefined), with accuracy, macro and weighted averages.

    Rows: (row, precision, recall, f1, support); accuracy stands in every column of its row but support.
    """
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    roles = F.explode(
        F.array(
            F.struct(F.col("y_true").alias("y"), F.col("n").alias("support"), zero.alias("said"), hit.alias("tp")),
            F.struct(F.col("y_pred").alias("y"), zero.alias("support"), F.col("n").alias("said"), zero.alias("tp")),
        )
    )
    per = contingency(pred, by).select(*by, roles.alias("r")).groupBy(*by, "r.y").agg(*[F.sum(f"r.{c}").alias(c) for c in ("support", "said", "tp")])
    per = (
        per.withColumn("precision", F.coalesce(F.expr("try_divide(tp, said)"), F.lit(0.0)))
        .withColumn("recall", F.coalesce(F.expr("try_divide(tp, support)"), F.lit(0.0)))
        .withColumn("f1", F.coalesce(F.expr("try_divide(2 * tp, said + support)"), F.lit(0.0)))
    )
    names = ("precision", "recall", "f1")
    # the classes of a run are few; their rows and the averages leave as one array, so the input is read once
    total = per.groupBy(*by).agg(
        F.collect_list(F.struct(F.col("y").cast("string").alias("row"), *names, "support")).alias("rows"),
        F.sum("support").alias("all"),
        F.expr("try_divide(sum(tp), sum(support))").alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.expr(f"try_divide(sum({c} * support), sum(support))").alias(f"w_{c}") for c in names],
    )

    def line(name: str, columns) -> Column:
        return F.struct(F.lit(name).alias("row"), *[F.col(c).alias(n) for c, n in zip(columns, names)], F.col("all").alias("support"))

    averages = F.array(line("accuracy", ["acc"] * 3), line("macro avg", [f"m_{c}" for c in names]), line("weighted avg", [f"w_{c}" for c in names]))
    return total.select(*by, F.explode(F.concat("rows", averages)).alias("r")).select(*by, "r.*")


def cluster_scores(pred: DataFrame, by=()) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean of entropies) from the contingency table."""
    cells = contingency(pred, by)
    rows = Window.partitionBy(*by, "y_true")
    cols = Window.partitionBy(*by, "y_pred")
    every = Window.partitionBy(*by)
    c = cells.withColumn("a", F.sum("n").over(rows)).withColumn("b", F.sum("n").over(cols)).withColumn("t", F.sum("n").over(every))
    two = lambda x: f"({x} * ({x} - 1) / 2.0D)"
    sums = c.groupBy(*by).agg(
        F.max("t").alias("t"),
        F.expr(f"sum{two('n')}").alias("ij"),
        F.expr(f"sum({two('a')} * n / a)").alias("i"),
        F.expr(f"sum({two('b')} * n / b)").alias("j"),
        F.expr("sum(n / t * ln(n * t / (a * b * 1.0D)))").alias("mi"),
        F.expr("-sum(n / t * ln(a / t))").alias("ha"),
        F.expr("-sum(n / t * ln(b / t))").alias("hb"),
    )
    return (
        sums.withColumn("e", F.expr(f"try_divide(i * j, {two('t')})"))
        .withColumn("ari", F.expr("coalesce(try_divide(ij - e, (i + j) / 2 - e), 1.0D)"))
        .withColumn("nmi", F.expr("coalesce(try_divide(mi, (ha + hb) / 2), 1.0D)"))
        .select(*by, "ari", "nmi")
    )


def summary(values: DataFrame, by, value: str = "value", seed: str = "seed", ddof: int = 1) -> DataFrame:
    """Mean, deviation (sample: ddof 1, population: ddof 0; 0 for one value), count and sorted seeds of each group.  Nulls and NaN are left out."""
    v = F.when(F.isnan(value), None).otherwise(F.col(value))
    spread = F.stddev_samp(v) if ddof else F.stddev_pop(v)
    return values.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.coalesce(spread, F.lit(0.0)).alias("std"), F.count(v).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set(seed)), lambda x: x.cast("string")), ",").alias("seeds")
    )


def confusion_summary(cells: DataFrame) -> DataFrame:
    """Mean and population deviation of every confusion cell over seeds."""
    return cells.groupBy("y_true", "y_pred").agg(F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("std_n"))


def accuracy_of_cells(cells: DataFrame, by=()) -> DataFrame:
    """Trace by total of a confusion matrix, counts or shares alike."""
    return cells.groupBy(*by).agg(F.expr("try_divide(sum(if(y_true = y_pred, n, 0)), sum(n))").alias("accuracy"))


def rank_within(scores: DataFrame, by: str, score: str, order: str) -> DataFrame:
    """``rank`` 1 for the best score within ``by``; ties in the order of ``order``."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), order)))


def mean_by_epoch(log: DataFrame, columns) -> DataFrame:
    return log.groupBy("epoch").agg(*[F.avg(c).alias(c) for c in columns])


def best_label(scores: dict[str, Column]) -> Column:
    """Name of the largest of several score columns; the first in order on ties."""
    names = list(scores)
    top = F.greatest(*scores.values())
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(scores[n] == top, n).otherwise(out)
    return out
