"""Writers.  Spark's committer makes an output whole or absent, so no shard is moved or renamed by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows in a file at most, where files are cut by rows.
ROWS_PER_FILE = 500_000


def dataset(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet by split, with files of even size: AQE cuts and joins partitions before the write."""
    df.hint("rebalance", "split").write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("split").parquet(path)


def resumable(df: DataFrame, path: str, key: str) -> None:
    """Only partitions of ``key`` in ``df`` are replaced; those written earlier stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def replaced(df: DataFrame, path: str) -> str:
    """Write beside ``path`` and return the new place; a dataset is never overwritten while it is read."""
    place = f"{path.rstrip('/')}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(place)
    return place


def report_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A small report as one CSV file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def results_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def summary_text(df: DataFrame, path: str, template: str, columns: list[str], order: list[str]) -> None:
    """One formatted line a row of a small summary."""
    df.orderBy(*order).coalesce(1).select(F.format_string(template, *columns).alias("value")).write.mode("overwrite").text(path)


def model(fitted, path: str) -> None:
    """A fitted Spark ML model, replaced as a whole."""
    fitted.write().overwrite().save(path)
