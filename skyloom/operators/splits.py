"""Exact, reproducible splits: the order within a class is an md5 of id and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f"|{seed}")))


def _named(place: Column, n: Column, test: float, validation: float) -> Column:
    """train, validation or test by place among n: a fifth to test by default, an eighth of the rest to validation."""
    tests = F.ceil(n * test)
    rest = n - tests
    vals = F.ceil(rest * validation)
    return F.when(place <= tests, "test").when(place <= tests + vals, "validation").otherwise("train")


def _placed(df: DataFrame, by: list[str], id_column: str, seed: int) -> DataFrame:
    """``df`` with ``_place``, counted from 1 in the order of the key within ``by``, and ``_n``, the rows of ``by``.

    A rank over a whole class would need one task.  The first three hex digits of
    the order key form 4,096 buckets; their sizes are summed, and places within a
    bucket are counted by a window of that bucket.
    """
    keyed = df.withColumn("_key", order_key(id_column, seed)).withColumn("_bucket", F.substring("_key", 1, 3))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_size")
    total = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_bucket").alias("_b"), before.alias("_before"), F.sum("_size").over(Window.partitionBy(*by)).alias("_n"))
    same = F.col("_bucket") == F.col("_b")
    for c in by:  # rows without a class are a class
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_key", id_column))
    return keyed.join(total, same).withColumn("_place", F.col("_before") + within).drop("_key", "_bucket", "_b", "_before", *[f"_{c}" for c in by])


def stratified(df: DataFrame, id_column: str, label: str, seed: int = 42, test: float = 0.2, validation: float = 0.125) -> DataFrame:
    """``split`` with exact quotas in every class."""
    return _placed(df, [label], id_column, seed).withColumn("split", _named(F.col("_place"), F.col("_n"), test, validation)).drop("_place", "_n")


def random(df: DataFrame, id_column: str, seed: int = 42, test: float = 0.2, validation: float = 0.125) -> DataFrame:
    """``split`` with exact quotas over the whole table."""
    return _placed(df, [], id_column, seed).withColumn("split", _named(F.col("_place"), F.col("_n"), test, validation)).drop("_place", "_n")


def select_splits(df: DataFrame, wanted, known=("train", "validation", "test", "anom")) -> DataFrame:
    """Rows of the wanted splits; ``all`` takes every one, an unknown name fails at once."""
    if wanted == "all":
        return df
    unknown = [s for s in wanted if s not in known]
    if unknown:
        raise ValueError(f"unknown splits: {unknown}; known: {list(known)}")
    return df.filter(F.col("split").isin(*wanted))


def with_split(df: DataFrame) -> DataFrame:
    """A table without ``split`` is one training split."""
    return df if "split" in df.columns else df.withColumn("split", F.lit("train"))
